import pytest


from conftest import SALES_SCHEMA, ts
from tidemark.functions.periods import Span
from tidemark.functions.text import clean_missing_text, money_text
from tidemark.operators import sales


def _s(spark, rows):
    return spark.createDataFrame(rows, SALES_SCHEMA)


def test_clean_number(spark):
    df = spark.createDataFrame([("1,000",), ("x",), (None,), ("12.5",), ("1,234,567.89",)], "t string")
    got = [r.v for r in sales.clean_number_column(df, "t", "v").collect()]
    assert got == [1000.0, None, None, 12.5, 1234567.89]
    num = spark.createDataFrame([(3,)], "t int")
    assert sales.clean_number_column(num, "t").collect()[0].t == 3.0


def test_trim_extremes_keeps_nulls_and_drops_all_ties(spark):
    d = ts("2024-01-01")
    df = _s(spark, [("a", "c", 10.0, d, "m", 1.0), ("a", "c", 10.0, d, "m", 1.0), ("a", "c", 5.0, d, "m", 1.0),
                    ("a", "c", 1.0, d, "m", 1.0), ("a", "c", None, d, "m", 1.0)])
    got = sorted([r.price for r in sales.trim_extremes(df).collect()], key=lambda x: (x is None, x))
    assert got == [5.0, None]


def test_trim_extremes_of_nan_and_infinity(spark):
    d, nan, inf = ts("2024-01-01"), float("nan"), float("inf")
    trimmed = lambda xs: [r.price for r in sales.trim_extremes(
        _s(spark, [("a", "c", x, d, "m", 1.0) for x in xs])).collect()]
    got = trimmed([1.0, 2.0, 9.0, nan])
    assert [x for x in got if x == x] == [2.0] and len(got) == 2
    assert trimmed([1.0, 2.0, inf, None]) == [2.0, None]
    assert len(trimmed([nan, nan])) == 2


def test_sales_of_absent_parts_stay(spark):
    from tidemark.sources.views import sales_from

    lines = spark.createDataFrame([(1, 1, 5.0, ts("2024-01-01")), (2, 9, 6.0, None)],
                                  "l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate timestamp_ntz")
    part = spark.createDataFrame([(1, "b", "t", 3)], "p_partkey long, p_brand string, p_type string, p_size int")
    supplier = spark.createDataFrame([(1, "s")], "s_suppkey long, s_name string")
    got = sorted((r.artist or "", r.company or "", r.price) for r in sales_from(lines, part, supplier).collect())
    assert got == [("", "", 6.0), ("b", "s", 5.0)]
    assert sales_from(lines, part, supplier, "company", "price").columns == ["company", "price"]


def test_before_after_spine_and_means(spark):
    df = _s(spark, [("a", "c", 10.0, ts("2022-01-01"), "m", 1.0), ("a", "c", None, ts("2022-02-01"), "m", 1.0),
                    ("a", "c", 30.0, None, "m", 1.0)])
    vol = {r.period: r.transaction_volume for r in sales.volume_before_after(df, "2023-01-01").collect()}
    assert vol == {"before": 1, "after": 0}
    rows = {r.period: r.transaction_volume for r in sales.volume_before_after(df, "2023-01-01", True).collect()}
    assert rows == {"before": 2, "after": 0}
    mean = {r.period: r.avg_price for r in sales.mean_before_after(df, "price", "2023-01-01").collect()}
    assert mean == {"before": 10.0, "after": None}


def test_compare_before_after_inner_and_zero_division(spark):
    b, a = ts("2022-01-01"), ts("2023-01-01")
    df = _s(spark, [("x", "c", 10.0, b, "small", 1.0), ("x", "c", 20.0, a, "small", 1.0),
                    ("x", "c", 5.0, b, "only_before", 1.0),
                    ("x", "c", None, b, "zero", 1.0), ("x", "c", 7.0, a, "zero", 1.0),
                    ("x", "c", 7.0, a, None, 1.0)])
    got = {r.category_size: r for r in sales.compare_before_after(df, "2022-10-01").collect()}
    assert set(got) == {"small", "zero"}
    assert got["small"].transaction_count_change_pct == 0.0 and got["small"].avg_price_change_pct == 100.0
    assert got["zero"].transaction_count_change_pct is None and got["zero"].avg_price_change_pct is None


def test_yearly_summary_previous_present_year(spark):
    rows = [("a", "c", 10.0, ts("2019-06-01"), "m", 1.0), ("a", "c", 20.0, ts("2021-06-01"), "m", 1.0),
            ("a", "c", None, ts("2022-06-01"), "m", 1.0), ("a", "c", 40.0, ts("2023-06-01"), "m", 1.0)]
    got = {r.year: r for r in sales.yearly_summary(_s(spark, rows), Span("2019-01-01", "2024-12-31")).collect()}
    assert got[2021].avg_price_change_pct == 100.0  # 2019 -> 2021, the previous present year
    assert got[2022].avg_price is None and got[2022].avg_price_change_pct is None
    assert got[2023].avg_price_change_pct is None  # NULL in, NULL out (no forward fill)
    assert got[2022].transaction_count == 0


def test_top_groups_null_sorts_last_and_total_zero(spark):
    d = ts("2024-01-01")
    df = _s(spark, [("a", "h1", 10.0, d, "m", 1.0), ("a", "h2", None, d, "m", 1.0), ("b", "h3", 5.0, d, "m", 1.0)])
    top = [r.company for r in sales.top_groups_by_mean(df, ["company"], k=3).collect()]
    assert top == ["h1", "h3", "h2"]
    tot = {r.company: r.total for r in sales.top_by_total(df, "company", 5).collect()}
    assert tot == {"h1": 10.0, "h2": 0.0, "h3": 5.0}


def test_country_cleaning_order(spark):
    df = spark.createDataFrame([("",), ("-",), (" - ",), ("   ",), (None,), ("KR ",)], "c string")
    got = [r[0] for r in df.select(clean_missing_text("c")).collect()]
    assert got == ["미상", "미상", "-", "미상", "미상", "KR"]


def test_money_text_half_even(spark):
    df = spark.createDataFrame([(2.5,), (1234567.5,), (0.4,)], "x double")
    assert [r[0] for r in df.select(money_text("x")).collect()] == ["₩2", "₩1,234,568", "₩0"]


def test_union_sources_with_own_columns(spark):
    a = spark.createDataFrame([("2020-01-05", "1,000")], "date string, KRW string")
    b = spark.createDataFrame([(ts("2021-03-01"), 5.0)], "`Auction Date` timestamp_ntz, price_krw double")
    out = sales.union_sources({"A": (a, "date", "KRW"), "B": (b, "Auction Date", "price_krw")})
    got = sorted((r.artist, r.date.year, r.price) for r in out.collect())
    assert got == [("A", 2020, 1000.0), ("B", 2021, 5.0)]
    years = [r.year for r in sales.years_union(out).collect()]
    assert years == [2020, 2021]


def test_profile_of_top_and_mean_by(spark):
    prof = spark.createDataFrame([("h1", "", "KR", "KR", 2.0), ("h2", "KR", None, None, 4.0), ("h3", "US", "US", "US", 6.0)],
                                 "name string, country_birth string, country_of_activity string, "
                                 "country_of_activity2 string, number_museum double")
    top = spark.createDataFrame([("h1",), ("h2",)], "company string")
    p = sales.profile_of_top(prof, top, "company")
    assert sorted((r.name, r.country_birth) for r in p.collect()) == [("h1", "미상"), ("h2", "KR")]
    by_act = [tuple(r) for r in sales.mean_by(p, ["country_of_activity"]).collect()]
    assert by_act == [("KR", 2.0)]  # NULL activity country dropped


def test_null_group_keys_dropped(spark):
    d = ts("2024-01-01")
    df = _s(spark, [("a", None, 99.0, d, "m", 1.0), ("a", "h1", 10.0, d, "m", 1.0)])
    assert [r.company for r in sales.top_groups_by_mean(df, ["company"], k=5).collect()] == ["h1"]
    by = spark.createDataFrame([(None, d, 1.0), ("A", d, 2.0)], "artist string, date timestamp_ntz, price double")
    ys = sales.yearly_summary(by, Span("2020-01-01", "2024-12-31"), by="artist")
    assert [(r.artist, r.avg_price) for r in ys.collect()] == [("A", 2.0)]


def test_exact_means_and_sums(spark):
    from tidemark.functions.numbers import exact_mean, exact_sum

    of = lambda xs: spark.createDataFrame([(x,) for x in xs], "x double").agg(
        exact_sum("x").alias("s"), exact_mean("x").alias("m")).first()
    assert of([0.001, 0.002]).m == 0.0015
    assert of([float("nan"), 2.0, None]) == (2.0, 2.0)
    assert of([]) == (None, None) and of([None]) == (None, None)
    assert of([1.0, float("inf")]).s == float("inf") and of([1e300, 1.0]).s == 1e300
    big = [9007199254740993.0, 0.25, 1e16, -1e16, 0.25]
    assert of(big) == of(big[::-1])
    # numbers below a unit keep their digits
    small = of([4e-7, 4e-7, 3e-7])
    assert small.s == pytest.approx(1.1e-6, rel=1e-15) and small.m == pytest.approx(1.1e-6 / 3, rel=1e-15)
    assert of([1e-300, 3e-300, -1e-300]).s == pytest.approx(3e-300, rel=1e-15) and of([1e-7, -1e-7]).s == 0
    assert of([1 / 3] * 3).s == 1.0 and of([2.5, -1e-9]).s == 2.5 - 1e-9


def test_sums_are_the_same_in_every_order(spark):
    """Money, thirds and mixed signs over many partitionings; the money's total is the decimals' own."""
    import random
    from decimal import Decimal

    from tidemark.functions.numbers import exact_sum

    rng = random.Random(4)
    money = [round(rng.uniform(-10_000, 90_000), 2) for _ in range(3000)]
    thirds = [rng.uniform(-5, 5) / 3 for _ in range(3000)]
    for xs in (money, thirds, money + thirds):
        seen = set()
        for i in range(4):
            rng.shuffle(xs)
            seen.add(spark.createDataFrame([(x,) for x in xs], "x double").repartition(i + 1).agg(exact_sum("x")).first()[0])
        assert len(seen) == 1
    want = float(sum(Decimal(repr(x)) for x in money))
    assert spark.createDataFrame([(x,) for x in money], "x double").agg(exact_sum("x")).first()[0] == want


def test_summary_reports_equal_line_reports(spark):
    """Every report of a summary equals that of the raw lines, with absent parts, NULLs and NaN among them."""
    from pyspark.sql import functions as F

    from tidemark.functions.periods import period_trunc
    from tidemark.sources.views import sales_from, summary_from

    nan, d = float("nan"), [ts("2022-01-31"), ts("2022-02-01"), ts("2023-05-05 10:00:00"), None]
    rows = [(i % 4 or None, i % 3, [1.5, None, nan, 2.25, 0.1][i % 5], d[i // 4 % 4]) for i in range(60)]
    lines = spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate timestamp_ntz")
    part = spark.createDataFrame([(1, "b", "t", 3), (2, "b", "u", 4)], "p_partkey long, p_brand string, p_type string, p_size int")
    supplier = spark.createDataFrame([(1, "s"), (2, "t")], "s_suppkey long, s_name string")
    flat = sales_from(lines, part, supplier)
    short = lambda cols, by=None: summary_from(lines, part, supplier, cols, by)
    cut = "2022-02-01"
    pairs = [
        (sales.monthly_mean_by_category(flat),
         sales.monthly_mean_by_category(short(["category_size"], {"month_start": lambda x: period_trunc("date", "month")}))),
        (sales.category_counts(flat), sales.category_counts(short(["category_size"]))),
        (sales.monthly_price_and_count(flat, "t"),
         sales.monthly_price_and_count(short(["category_size"], {"month": lambda x: F.last_day("date")}), "t")),
        (sales.compare_before_after(flat, cut),
         sales.compare_before_after(short(["category_size"], {"side": lambda x: sales.side_of("date", cut, x)}), cut)),
        (sales.top_groups_by_mean(flat, ["artist", "company"], min_count=1),
         sales.top_groups_by_mean(short(["artist", "company"]), ["artist", "company"], min_count=1)),
        (sales.top_by_total(flat, "company"), sales.top_by_total(short(["company"]), "company")),
    ]
    for a, b in pairs:
        assert a.schema.simpleString() == b.schema.simpleString()
        got = sorted(map(str, a.collect()))
        assert got and got == sorted(map(str, b.collect()))


def test_padded_percent_change(spark):
    rows = [("a", "c", x, ts(f"{y}-06-01"), "m", 1.0) for y, x in
            [(2018, None), (2019, 10.0), (2020, None), (2021, 20.0), (2022, None)]]
    got = {r.year: r.avg_price_change_pct for r in sales.yearly_summary(
        _s(spark, rows), Span("2018-01-01", "2024-12-31"), fill="pad").collect()}
    assert got == {2018: None, 2019: None, 2020: 0.0, 2021: 100.0, 2022: 0.0}


def test_date_formats_and_strict(spark):
    import pytest

    from tidemark.functions.text import clean_number, parse_date

    texts = ["2019-06-01", "2019/6/1", "06/01/2019", " June 1, 2019", "2019-06-01 00:00:00", "20190601", "x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] and r[0].strftime("%Y%m%d") for r in df.select(parse_date("t")).collect()]
    assert got == ["20190601"] * 6 + [None, None]
    with pytest.raises(Exception, match="not a date: x"):
        df.select(parse_date("t", strict=True)).collect()
    with pytest.raises(Exception, match="not a number: x"):
        df.where("t = 'x'").select(clean_number("t", strict=True)).collect()
    assert df.where("t is null").select(clean_number("t", strict=True)).collect()[0][0] is None


def test_distinct_values_and_first_rows(spark):
    df = spark.createDataFrame([(2, "b"), (1, "b"), (1, "a"), (None, None)], "n int, s string")
    assert [r[0] for r in sales.distinct_values(df, "s").collect()] == [None, "a", "b"]
    assert [tuple(r) for r in sales.first_rows(df, 3, "n").collect()] == [(None, None), (1, "a"), (1, "b")]


def test_profile_of_all_columns(spark):
    """A value of a third of all rows, near ties, ties, flat columns, NULLs, an empty column; exact whatever the sketch holds."""
    import random
    from collections import Counter

    from tidemark.operators.profiling import profile_table

    rng = random.Random(5)
    rows = [("hot" if i % 3 == 0 else rng.choice("abcdefgh"), None if i % 10 == 0 else i % 40, float(i), i % 2 == 0, None,
             ts(f"2024-01-{1 + min(i % 29, 27):02d}"), {"m": 1}) for i in range(3000)]
    schema = "s string, near int, flat double, flag boolean, none string, at timestamp_ntz, m map<string,int>"
    df = spark.createDataFrame(rows, schema).repartition(4)
    for tracked in (20, 64, 10_000):
        got = {}
        for r in profile_table(df, 3, tracked=tracked).collect():
            got.setdefault(r["column_name"], []).append(r)
        assert set(got) == {"s", "near", "flat", "flag", "none", "at"}
        for at, name in enumerate(("s", "near", "flat", "flag", "none", "at")):
            values = [r[at] for r in rows if r[at] is not None]
            want = sorted(Counter(values).items(), key=lambda x: (-x[1], x[0]))[:3]
            text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
            assert [(r["value"], r["value_count"]) for r in got[name]] == ([(text(v), n) for v, n in want] or [(None, None)]), (name, tracked)
            assert {(r["row_count"], r["non_null"]) for r in got[name]} == {(3000, len(values))}
            if values:
                assert got[name][0]["min_value"] == text(min(values)) and got[name][0]["max_value"] == text(max(values))
    assert profile_table(df.limit(0)).count() == 6 and profile_table(df.select("m")).count() == 0

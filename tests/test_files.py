import os
import tempfile

from tidemark.sources import files


def test_read_sheet_trims_names_and_coerces(spark):
    d = tempfile.mkdtemp(prefix="tidemark-files-")
    p = os.path.join(d, "artist.csv")
    with open(p, "w", encoding="utf-8") as fh:
        fh.write(" date , price ,category_size\n2022-01-05,\"1,000\",medium\nnot a date,x,small\n")
    df = files.read_sheet(spark, p)
    assert df.columns == ["date", "price", "category_size"]
    stacked = files.read_sources(spark, {"A": (p, "date", "price")})
    rows = sorted(((r.date is None), r.price) for r in stacked.collect())
    assert rows == [(False, 1000.0), (True, None)]


def test_schema_is_found_by_name_and_per_sheet(spark):
    import pytest

    d = tempfile.mkdtemp(prefix="tidemark-files-")
    a, b = os.path.join(d, "a.csv"), os.path.join(d, "b.csv")
    with open(a, "w", encoding="utf-8") as fh:
        fh.write("price , size\n100,7\nx,8\n")
    with open(b, "w", encoding="utf-8") as fh:
        fh.write("name\nKim\n")
    got = files.read_sheets(spark, {"a": a, "b": b}, {"a": "size int, price double", "b": "name string"})
    assert got["a"].dtypes == [("size", "int"), ("price", "double")]
    assert sorted(tuple(r) for r in got["a"].collect()) == [(7, 100.0), (8, None)]
    assert [r.name for r in got["b"].collect()] == ["Kim"]
    with pytest.raises(ValueError, match="no column"):
        files.read_sheet(spark, b, "name string, age int")


def test_missing_columns_of_a_table(spark, tmp_path):
    import pytest

    from tidemark.sources.tables import SCHEMAS, read_table

    path = str(tmp_path / "nation.parquet")
    spark.createDataFrame([(1, "A")], "n_nationkey int, n_name string").write.parquet(path)
    assert [tuple(r) for r in read_table(spark, str(tmp_path), "nation").collect()] == [(1, "A", None)]
    with pytest.raises(ValueError, match="n_regionkey"):
        read_table(spark, str(tmp_path), "nation", strict=True)
    spark.createDataFrame([(1, "A", 2)], SCHEMAS["nation"]).write.mode("overwrite").parquet(path)
    assert [tuple(r) for r in read_table(spark, str(tmp_path), "nation", strict=True).collect()] == [(1, "A", 2)]

"""Workbooks against hand-written XML, and round trips through the writer."""

import datetime as dt
import os
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files, workbook

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
STYLES = f"""<styleSheet {NS}><numFmts count="3"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="&quot;day&quot;0.0"/>
<numFmt numFmtId="166" formatCode="[Red]0;[h]:mm"/></numFmts><cellXfs count="5"><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="166"/></cellXfs></styleSheet>"""


def _book(path, sheets, shared="", epoch="", absolute=False):
    """A workbook of raw sheet XML by name; members in no special order, targets relative or absolute."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        rels, listed = [], []
        for i, (name, xml) in enumerate(sheets.items(), 1):
            member = f"worksheets/s{9 - i}.xml"
            z.writestr(f"xl/{member}", f'<worksheet {NS}>{xml}</worksheet>')
            rels.append(f'<Relationship Id="rId{i}" Target="{"/xl/" if absolute else ""}{member}"/>')
            listed.append(f'<sheet name="{name}" sheetId="{i}" r:id="rId{i}"/>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(rels)}</Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook {NS} {R}>{epoch}<sheets>{"".join(listed)}</sheets></workbook>')
        z.writestr("xl/styles.xml", STYLES)
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst {NS}>{shared}</sst>')
    return str(path)


SHARED = ("<si><t> Artist </t></si><si><t>price</t></si><si><t>Sold</t></si><si><r><t>Ol</t></r><r><rPr/><t xml:space=\"preserve\">d </t></r><rPh><t>x</t></rPh></si>"
          "<si><t>a_x0041_b &amp; _x000D_</t></si><si><t>ok</t></si>")
ART = """<dimension ref="A2:E6"/><sheetData>
<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="C2" t="s"><v>2</v></c><c r="E2" t="s"><v>5</v></c></row>
<row r="3"><c r="A3" t="s"><v>3</v></c><c r="B3"><v>12.5</v></c><c r="C3" s="1"><v>45292</v></c><c r="E3" t="b"><v>1</v></c></row>
<row r="4"/><row r="5"><c r="A5" t="s"><v>4</v></c><c r="B5" t="e"><v>#N/A</v></c><c r="C5" s="2"><v>45292.75</v></c><c r="E5" t="b"><v>0</v></c></row>
<row r="6"><c r="A6" t="inlineStr"><is><t>in</t></is></c><c r="B6" t="str"><f>1&amp;2</f><v>12</v></c><c r="C6" t="d"><v>2024-02-03T04:05:06</v></c></row>
<row r="7"><c r="B7"><v>1E-3</v></c><c r="C7" s="3"><v>59</v></c></row></sheetData>"""
PLAIN = "<sheetData><row><c t=\"inlineStr\"><is><t>k</t></is></c><c t=\"inlineStr\"><is><t>k</t></is></c></row><row><c><v>1</v></c><c s=\"4\"><v>2</v></c></row></sheetData>"


def test_hand_written_sheets(spark, tmp_path):
    path = _book(tmp_path / "a.xlsx", {"Art": ART, "Plain &amp; bare": PLAIN}, SHARED)
    assert workbook.sheet_names(path) == ["Art", "Plain & bare"]
    schema = "Sold timestamp_ntz, Artist string, price double, ok boolean"
    want = [(dt.datetime(2024, 1, 1), "Old ", 12.5, True), (dt.datetime(2024, 1, 1, 18), "aAb & \r", None, False),
            (dt.datetime(2024, 2, 3, 4, 5, 6), "in", 12.0, None), (dt.datetime(1900, 2, 28), None, 0.001, None)]
    for size in (1, 2, 100):
        got = workbook.read_workbook(spark, path, "Art", schema, rows_per_partition=size)
        assert sorted(map(tuple, got.collect())) == sorted(want), size
    assert workbook.read_workbook(spark, path, "Art", schema, rows_per_partition=1).rdd.getNumPartitions() == 4  # row 7 is beyond the stated end
    text = workbook.read_workbook(spark, path, 0)
    assert text.columns == ["Artist", "price", "Sold", "_c3", "ok"]
    assert [tuple(r) for r in text.collect()][:2] == [("Old ", "12.5", "2024-01-01", None, "true"), ("aAb & \r", None, "2024-01-01 18:00:00", None, "false")]
    bare = workbook.read_workbook(spark, path, "Plain & bare")
    assert bare.columns == ["k", "k.1"] and [tuple(r) for r in bare.collect()] == [("1", "1900-01-02")]
    rows = workbook.read_workbook(spark, path, "Plain & bare", "a string, b long", header=False).collect()
    assert [tuple(r) for r in rows] == [("k", None), ("1", 2)]


def test_second_workbook_with_the_other_calendar(spark, tmp_path):
    path = _book(tmp_path / "b.xlsx", {"One": "<sheetData/>", "Two": ART}, SHARED, '<workbookPr date1904="1"/>', absolute=True)
    got = workbook.read_workbook(spark, path, "Two", "Sold date, price decimal(6,2)").collect()
    assert [tuple(r) for r in got] == [(dt.date(2028, 1, 2), Decimal("12.50")), (dt.date(2028, 1, 2), None), (dt.date(2024, 2, 3), Decimal("12.00")),
                                       (dt.date(1904, 2, 29), Decimal("0.00"))]
    assert workbook.read_workbook(spark, path, "One", "a string").collect() == [] and workbook.read_workbook(spark, path, "One").count() == 0
    sheets = workbook.read_workbook_sheets(spark, path, schema={"Two": "price double"})
    assert list(sheets) == ["One", "Two"] and sheets["Two"].count() == 4
    again = files.read_sheets(spark, {"Two": path}, {"Two": "price double"}, fmt="workbook")
    assert again["Two"].agg(F.sum("price")).first()[0] == 24.501


def test_errors_name_what_is_missing(spark, tmp_path):
    path = _book(tmp_path / "c.xlsx", {"Art": ART}, SHARED)
    with pytest.raises(Exception, match="no sheet 'Nope'"):
        workbook.read_workbook(spark, path, "Nope", "a string").collect()
    with pytest.raises(Exception, match="no column"):
        workbook.read_workbook(spark, path, "Art", "missing string").collect()


def _table(spark, n):
    rows = [(i, None if i % 7 == 0 else f"näme {i}\n<&>\t_x0041_ \x07\"'", i * 0.1, i % 2 == 0, Decimal(i).scaleb(-3),
             dt.date(1900, 1, 1) + dt.timedelta(days=37 * i), dt.datetime(1999, 12, 31, 23, 59, 59, 999_999) + dt.timedelta(seconds=i * 1001.000001), 2 ** 62 + i)
            for i in range(n)]
    rows.append((None, "", float("nan"), None, None, None, None, None))
    return spark.createDataFrame(rows, "id int, text string, x double, flag boolean, d decimal(12,3), day date, at timestamp_ntz, big long")


@pytest.mark.parametrize("n_files", [1, 3])
def test_round_trip_of_all_types(spark, tmp_path, n_files):
    df, other = _table(spark, 200).repartition(4), spark.range(5).toDF("only")
    path = str(tmp_path / "books")
    workbook.write_workbook({"Data 'x' & y": df, "Other": other}, path, n_files)
    got = workbook.read_workbook(spark, path, "Data 'x' & y", df.schema, rows_per_partition=30)
    key = lambda r: (r["id"] is None, r["id"])
    a, b = sorted(df.collect(), key=key), sorted(got.collect(), key=key)
    assert a[:-1] == b[:-1]
    assert b[-1]["text"] in ("", None) and b[-1]["x"] is None  # NaN is no number in a sheet
    assert sorted(r[0] for r in workbook.read_workbook(spark, path, "Other", "only long").collect()) == list(range(5))
    assert len(workbook.workbook_files(path)) == n_files
    with open(os.path.join(path, "part-left-by-a-failed-task.xlsx"), "w") as f:
        f.write("half")
    assert got.count() == 201  # a file that is not on the list is not read


def test_overwrite_and_full_sheets(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "books")
    workbook.write_workbook({"S": spark.range(10).toDF("i")}, path)
    assert workbook.read_workbook(spark, path, "S", "i long").count() == 10
    workbook.write_workbook({"S": spark.range(3).toDF("i")}, path)
    assert workbook.read_workbook(spark, path, "S", "i long").count() == 13
    workbook.write_workbook({"S": spark.range(4).toDF("i")}, path, mode="overwrite")
    assert workbook.read_workbook(spark, path, "S", "i long").count() == 4 and len(os.listdir(path)) == 2
    monkeypatch.setattr(workbook, "MAX_ROWS", 5)  # a sheet that is full goes on in the next workbook, with its header
    writer = workbook.WorkbookWriter(path, True)
    rows = [(True, "S", [("s", "i")])] + [(False, "S", [("n", str(i))]) for i in range(11)] + [(True, "T", [("s", "i")]), (False, "T", [("n", "7")])]
    done = writer.write(iter(rows))
    writer.commit([done])
    assert len(done.files) == 3
    assert sorted(r[0] for r in workbook.read_workbook(spark, path, "S", "i long").collect()) == list(range(11))


def test_empty_sheet_round_trip(spark, tmp_path):
    path = str(tmp_path / "books")
    workbook.write_workbook({"E": spark.range(0).toDF("i")}, path)
    assert workbook.read_workbook(spark, path, "E", "i long").collect() == [] and workbook.read_workbook(spark, path, "E").columns == ["i"]
    with pytest.raises(ValueError, match="no sheet"):
        workbook.write_workbook({}, path)

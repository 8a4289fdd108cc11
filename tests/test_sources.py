import random
import struct
import zipfile
import zlib
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlane.sources import archive, files, records, storage, workbook


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "300b")
    spark.conf.set(names[1], "1b")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def one_task(spark, path):
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    return df.toDF(*[c.strip() for c in df.columns])


def messy(rng, rows):
    """CSV text with quotes, commas and line feeds in fields, some of them long."""
    def field():
        kind = rng.randrange(9)
        if kind == 0:
            return '"' + rng.choice(['a,b', 'say ""hi""', "two\nlines", "three\n\n\nlines", ',"",\n', '""', "x\r\ny", "\n"]) + '"'
        if kind == 1:
            return '"' + "\n".join("long " * rng.randrange(30) for _ in range(rng.randrange(1, 12))) + '"'
        return rng.choice(["plain", "1.50", "", '5" pipe', "ü€", "a b"])

    return "id, name ,note,x\n" + "".join(f"{k},{field()},{field()},{field()}\n" + "\n" * (rng.random() < 0.05) for k in range(rows))


@pytest.mark.parametrize("seed", range(2))
def test_records_that_span_lines_are_read_by_many_tasks(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text(messy(rng, 60 if k < 2 else 2), newline="")
    path = str(tmp_path)
    lines = records.lines(spark, path)
    assert lines.select("file", "start").distinct().count() > 20 and records.span_lines(spark, path)
    got, want = files.read_csv(spark, path), one_task(spark, path)
    assert got.columns == want.columns == ["id", "name", "note", "x"]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    paths = {(r["path_"].rsplit("/", 1)[1], r["n"]) for r in files.read_csv(spark, path, with_path=True).groupBy("path_").agg(F.count("*").alias("n")).collect()}
    assert paths == {("0.csv", 60), ("1.csv", 60), ("2.csv", 2)}


def test_a_record_over_many_splits(spark, tmp_path, small_splits):
    note = "\n".join(f"line {k}, of a \"\"long\"\" note" for k in range(150))
    (tmp_path / "a.csv").write_text(f'id,note\n1,"{note}"\n2,short\n3,"{note}"\n4,\n')
    got = {r["id"]: r["note"] for r in files.read_csv(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {"1": note.replace('""', '"'), "2": "short", "3": note.replace('""', '"'), "4": None}


@pytest.mark.parametrize("text", ["id,name\n1,a\n2,\"b,c\"\n3,5\" pipe\n", "id,name\r\n1,a\r\n2,\"b\"\r\n", "id,name\n", "\n\nid,name\n\n1,x\n"])
def test_plain_files_are_scanned_by_spark(spark, tmp_path, text):
    (tmp_path / "a.csv").write_text(text, newline="")
    path = str(tmp_path / "a.csv")
    assert not records.span_lines(spark, path)
    got = files.read_csv(spark, path)
    assert "multiLine" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, got.collect())) == sorted(map(str, one_task(spark, path).collect())) and got.columns == ["id", "name"]


def test_states_of_lines():
    for line, out, in_ in (
        ("a,b", False, True), ('a,"b', True, False), ('"a,""b"', False, False), ('x"y,z', False, False), ('"', True, False), ('""', False, True), ('a,"b""', True, False),
        ('"a",b', False, False), ('b",c,"d', True, True), ('5" pipe,"x', True, True), ("", False, True),
    ):
        assert (records.ends_inside(line, False), records.ends_inside(line, True)) == (out, in_), line
    assert not records.ends_inside('"' + "x" * 200_000 + '""' * 50_000 + '"' + ",a" * 50_000, False)


def test_splits_compose():
    told = [(1, 0, True, False, True), (1, 10, False, True, False), (1, 20, False, False, True), (1, 30, False, True, False), (2, 0, False, True, False), (2, 10, True, True, True), (2, 20, True, True, True)]
    assert records.beginnings(told) == {(1, 0): (False, -1), (1, 10): (True, 0), (1, 20): (True, 0), (1, 30): (False, -1), (2, 0): (False, -1), (2, 10): (False, -1), (2, 20): (True, 10)}


@pytest.mark.parametrize("sizes", [(0, 0), (1, 5), (1000, 1), (70_000, 3_000_000)])
def test_crcs_are_joined(sizes):
    a, b = (random.Random(n).randbytes(n) for n in sizes)
    assert archive.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_archive(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "PIECE", 1000)
    contents = {"a/long.bin": random.Random(0).randbytes(12_345), "b.txt": b"text\n" * 2_000, "empty": b"", "ü.txt": "ü".encode()}
    members = {}
    for k, (name, data) in enumerate(contents.items()):
        (tmp_path / f"f{k}").write_bytes(data)
        members[name] = str(tmp_path / f"f{k}")
    path = archive.assemble(archive.pieces_of(spark, members), f"file://{tmp_path}/x.zip", {"note.txt": "hello"})
    with zipfile.ZipFile(tmp_path / "x.zip") as z:
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == {**contents, "note.txt": b"hello"}
    assert storage.exists(path) and not storage.exists(path + ".partial")


def test_large_archives_use_wide_fields(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "SHORT", 5_000)  # beyond it sizes and places go to the wide fields
    pack = struct.pack
    wide = lambda form, *v: pack(form, *[0xFFFFFFFF if form == "<II" and v == (5_000, 5_000) and x == 5_000 else x for x in v])
    monkeypatch.setattr(archive.struct, "pack", wide)
    data = random.Random(1).randbytes(9_000)
    (tmp_path / "f").write_bytes(data)
    archive.assemble(archive.pieces_of(spark, {"x": str(tmp_path / "f")}), str(tmp_path / "x.zip"))
    with zipfile.ZipFile(tmp_path / "x.zip") as z:
        assert z.read("x") == data


def typed(spark, n):
    return spark.range(0, n, numPartitions=3).select(
        F.col("id"), F.concat(F.lit("<a & \"b\"> ü\n\x07 _x0041_ "), F.col("id").cast("string")).alias("text"), (F.col("id") / 8).alias("number"), (F.col("id") % 2 == 0).alias("flag"),
        F.date_add(F.lit("2024-02-28").cast("date"), F.col("id").cast("int")).alias("day"), F.lit("2024-03-01 06:30:00").cast("timestamp").alias("at"),
        F.when(F.col("id") % 3 == 0, F.lit("12.50").cast("decimal(18,2)")).alias("money"), F.array(F.col("id")).alias("list"),
    )


def test_workbook_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/book.xlsx"
    workbook.write_workbook({"typed/rows": typed(spark, 700), "none": typed(spark, 0), "TYPED_rows": spark.range(2).toDF("a")}, path)
    book = workbook.Book((tmp_path / "book.xlsx").read_bytes())
    assert list(book.sheets) == ["typed_rows", "none", "TYPED_rows (2)"]
    got = workbook.read_excel(spark, path)
    assert got.columns == ["id", "text", "number", "flag", "day", "at", "money", "list"] and got.count() == 700
    r = {x["id"]: x for x in got.collect()}["3"]
    assert tuple(r) == ("3", '<a & "b"> ü\n\x07 _x0041_ 3', "0.375", "False", "2024-03-02", "2024-03-01 06:30:00", "12.5", "[3]")
    assert {x["id"]: x["money"] for x in got.collect()}["4"] is None
    assert [x["message"] for x in workbook.read_excel(spark, path, "none").collect()] == ["No records"]
    with pytest.raises(Exception, match="no sheet"):
        workbook.read_excel(spark, path, "other").collect()


def test_more_rows_than_a_sheet_holds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "SHEET_ROWS", 100)
    monkeypatch.setattr(workbook, "PIECE_ROWS", 40)
    path = str(tmp_path / "book.xlsx")
    workbook.write_workbook({"rows": spark.range(0, 450, numPartitions=2).toDF("a")}, path)
    sheets = list(workbook.Book((tmp_path / "book.xlsx").read_bytes()).sheets)
    assert sheets[:2] == ["rows", "rows 2"] and len(sheets) >= 5
    read = [[int(r["a"]) for r in workbook.read_excel(spark, path, s).collect()] for s in sheets]
    assert max(map(len, read)) <= 100 and sum(read, []) == list(range(450))


SHARED = """<?xml version="1.0"?><sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t> Emp ID </t></si><si><r><t>Check</t></r><r><t xml:space="preserve"> Date</t></r><rPh><t>no</t></rPh></si><si><t>EE Deferral $</t></si></sst>"""
SHEET = """<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cols><col/></cols><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c><c r="E1" t="str"><v>Emp ID</v></c></row>
<row r="2"><c r="A2"><v>1001</v></c><c r="B2" s="1"><v>45660</v></c><c r="C2"><v>5.0999999999999996</v></c><c r="E2" t="b"><v>1</v></c></row>
<row r="3"/><row r="4"><c r="A4" t="inlineStr"><is><t>E-2</t></is></c><c r="B4" s="2"><v>45660.25</v></c><c r="C4" t="e"><v>#N/A</v></c></row>
</sheetData></worksheet>"""
STYLES = """<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="171" formatCode="[Red]0.00&quot;days&quot;"/></numFmts>
<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>"""


def test_workbook_of_a_spreadsheet_program(spark, tmp_path):
    """Shared strings, styles, sparse and empty rows, as such programs write them; several files at once."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    for name in ("a.xlsx", "b.XLSX"):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("xl/workbook.xml", f'<workbook {main}><sheets><sheet name="Data" sheetId="1" r:id="rId7"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="/xl/worksheets/s.xml"/></Relationships>')
            for member, text in (("worksheets/s.xml", SHEET), ("sharedStrings.xml", SHARED), ("styles.xml", STYLES)):
                z.writestr(f"xl/{member}", text)
    got = files.read_table(spark, str(tmp_path / "a.xlsx"))
    assert got.columns == ["Emp ID", "Check Date", "EE Deferral $", "Unnamed: 3", "Emp ID.1"]
    assert [tuple(r) for r in got.collect()] == [("1001", "2025-01-03", "5.1", None, "True"), ("E-2", "2025-01-03 06:00:00", None, None, None)]
    assert workbook.read_excel(spark, str(tmp_path)).count() == 4
    rows = files.prepared(got.drop("Unnamed: 3", "Emp ID.1"), "payroll")[0].collect()
    assert [(r["employee_id"], r["pay_date"], r["pretax"]) for r in rows] == [("1001", date(2025, 1, 3), Decimal("5.10")), ("E-2", date(2025, 1, 3), Decimal("0.00"))]
    with pytest.raises(ValueError, match="save it as .xlsx"):
        files.read_table(spark, "old.xls")


def test_a_sheet_is_streamed():
    """Rows go as they have been read: a sheet of many rows never stands in memory as a whole."""
    import io
    import tracemalloc

    body = "".join(f'<row><c t="inlineStr"><is><t>{k} {"x" * 50}</t></is></c></row>' for k in range(60_000))
    text = f'<worksheet xmlns="{workbook.MAIN}"><sheetData>{body}</sheetData></worksheet>'.encode()
    del body
    tracemalloc.start()
    n = sum(1 for _ in workbook._ended(io.BytesIO(text), "row"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60_000 and peak < len(text) / 3
    assert datetime(1899, 12, 30) == workbook.DAY_0

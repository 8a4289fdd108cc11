"""Workbooks (.xlsx): reading their sheets and writing tables as sheets, both by tasks.

Reading: a task gets a workbook's bytes from Spark's scan of binary files, on whatever file system, and
streams the sheet's XML and the shared strings out of the archive row by row; a sheet is never held as a
whole. Every cell becomes text, as with CSV: whole numbers without a point, dates in ISO form by the
cell's number format.

Writing: tasks turn runs of rows into deflated pieces of sheet XML, which are written to the shared
folder; the commit deals the pieces to sheets by their numbers of rows, a further sheet being begun
where one is full, and joins them to an archive (sources.archive), piece by piece.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerlane.sources import archive
from ledgerlane.sources.scratch import materialize

#: Rows that a sheet holds below its header, and rows of a piece.
SHEET_ROWS, PIECE_ROWS = 1_048_575, 20_000
#: Fixed values of the format: XML namespaces, built-in number formats of dates, the day of serial 0.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATED = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
DAY_0, DAY_0_1904 = datetime(1899, 12, 30), datetime(1904, 1, 1)

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_HIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
_HEX = re.compile("_x([0-9A-Fa-f]{4})_")


# Reading.


class Book:
    """An archive's sheets, streamed."""

    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.zip.namelist())
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        of = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        place = lambda target: target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        self.sheets = {s.get("name"): place(of[s.get(f"{{{RELATED}}}id")]) for s in book.iter(f"{{{MAIN}}}sheet")}
        told = book.find(f"{{{MAIN}}}workbookPr")
        self.day_0 = DAY_0_1904 if told is not None and told.get("date1904") in ("1", "true") else DAY_0
        self.strings = [_text(x) for x in _ended(self.zip.open("xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in names else []
        self.dates = self._dates() if "xl/styles.xml" in names else set()

    def _dates(self) -> set[int]:
        """Numbers of the cell styles whose number format is one of dates."""
        styles = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        own = {f.get("numFmtId"): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "")) for f in styles.iter(f"{{{MAIN}}}numFmt")}
        is_date = lambda k: re.search("[ymdhs]", own[k], re.I) is not None if k in own else int(k or 0) in DATE_FORMATS
        cells = styles.find(f"{{{MAIN}}}cellXfs")
        return {i for i, x in enumerate(cells if cells is not None else []) if is_date(x.get("numFmtId", "0"))}

    def rows(self, sheet: str | None = None) -> Iterator[dict[int, str]]:
        """Column number to text of each row that has cells, of the named or first sheet."""
        if sheet is not None and sheet not in self.sheets:
            raise ValueError(f"no sheet {sheet!r} among {list(self.sheets)}")
        name = self.sheets[sheet] if sheet is not None else next(iter(self.sheets.values()))
        for row in _ended(self.zip.open(name), "row"):
            out, at = {}, -1
            for cell in row.iter(f"{{{MAIN}}}c"):
                at = _column(cell.get("r")) if cell.get("r") else at + 1
                text = self._value(cell)
                if text is not None:
                    out[at] = text
            if out:
                yield out

    def _value(self, cell: ElementTree.Element) -> str | None:
        kind, v = cell.get("t", "n"), cell.find(f"{{{MAIN}}}v")
        if kind == "inlineStr":
            inside = cell.find(f"{{{MAIN}}}is")
            return None if inside is None else _text(inside)
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self.strings[int(v.text)]
        if kind == "b":
            return "True" if v.text == "1" else "False"
        if kind == "n":
            return self._date(float(v.text)) if int(cell.get("s", 0)) in self.dates else _number(v.text)
        return None if kind == "e" else _plain(v.text)

    def _date(self, serial: float) -> str:
        moment = self.day_0 + timedelta(seconds=round(serial * 86_400))
        return moment.isoformat(sep=" ") if moment.time() != datetime.min.time() else moment.date().isoformat()


def _ended(stream, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of a name as they end; each goes from its parent once it has been used."""
    above: list[ElementTree.Element] = []
    for event, e in ElementTree.iterparse(stream, events=("start", "end")):
        if event == "start":
            above.append(e)
            continue
        above.pop()
        if e.tag == f"{{{MAIN}}}{tag}":
            yield e
            if above:
                above[-1].remove(e)


def _text(e: ElementTree.Element) -> str:
    """Text of a string's runs, without phonetic hints."""
    parts = [t.text or "" for child in e for t in ([child] if child.tag == f"{{{MAIN}}}t" else child.iter(f"{{{MAIN}}}t") if child.tag == f"{{{MAIN}}}r" else [])]
    return _plain("".join(parts))


def _plain(text: str) -> str:
    return _HEX.sub(lambda m: chr(int(m[1], 16)), text)


def _number(text: str) -> str:
    value = float(text)
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def _column(place: str) -> int:
    n = 0
    for c in place:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _names(first: dict[int, str]) -> list[str]:
    """Headers, trimmed; a column without one is named by its number, a repeated one gets a suffix."""
    out: list[str] = []
    for k in range(max(first, default=-1) + 1):
        name = first.get(k, "").strip() or f"Unnamed: {k}"
        n = sum(x == name or re.fullmatch(re.escape(name) + r"\.\d+", x) is not None for x in out)
        out.append(f"{name}.{n}" if n else name)
    return out


def read_excel(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The rows of a workbook's named (or first) sheet as text columns, by the headers of its first row.
    path may name several workbooks (a folder or pattern): their columns must be those of the first."""
    books = spark.read.format("binaryFile").load(path).select("path", "content")

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame({"path": [name], "names": [_names(next(Book(content).rows(sheet), {}))]})

    found = books.mapInPandas(headers, "path string, names array<string>").orderBy("path").collect()  # one row a workbook
    if not found:
        raise FileNotFoundError(f"no workbook at {path}")
    names = list(found[0]["names"])
    others = [r["path"] for r in found if list(r["names"]) != names]
    if others:
        raise ValueError(f"other columns than {names}: {others}")
    schema = StructType([StructField(n, StringType()) for n in names])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                held, all_rows = [], Book(content).rows(sheet)
                next(all_rows, None)
                for row in all_rows:
                    held.append([row.get(k) for k in range(len(names))])
                    if len(held) == PIECE_ROWS:
                        yield pd.DataFrame(held, columns=names, dtype=object)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names, dtype=object)

    return books.mapInPandas(rows, schema) if names else spark.createDataFrame([], schema)


# Writing.


def _shown(text: str) -> str:
    """Text as XML; characters that XML cannot hold are written by their number."""
    return escape(_HIDDEN.sub(lambda m: f"_x{ord(m[0]):04X}_", text))


def _cell(value: object) -> str:
    if value is None or value is pd.NaT or isinstance(value, float) and value != value:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and abs(value) < 1e15:
        return f"<c><v>{value!r}</v></c>"
    if isinstance(value, datetime):
        return f'<c s="2"><v>{(value.replace(tzinfo=None) - DAY_0) / timedelta(days=1)!r}</v></c>'
    if isinstance(value, date):
        return f'<c s="1"><v>{(value - DAY_0.date()).days}</v></c>'
    return f'<c t="inlineStr"><is><t xml:space="preserve">{_shown(str(value))}</t></is></c>'


def _row(values: list) -> str:
    return f"<row>{''.join(map(_cell, values))}</row>"


def _pieces(rows: DataFrame) -> DataFrame:
    """Pieces of sheet XML by task and number, with their rows. Decimals become doubles, as Excel has
    no other numbers; what is neither number, date nor flag becomes text."""
    kinds = {c: t for c, t in rows.dtypes}
    simple = ("int", "bigint", "smallint", "tinyint", "double", "float", "boolean", "date", "timestamp_ntz", "string")
    cast = lambda c, t: F.col(f"`{c}`").cast("double") if t.startswith("decimal") else F.col(f"`{c}`").cast("timestamp_ntz") if t == "timestamp" else F.col(f"`{c}`") if t in simple else F.col(f"`{c}`").cast("string")
    row = F.struct(*[cast(c, t).alias(f"c{k}") for k, (c, t) in enumerate(kinds.items())])
    plain = rows.select(F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at"), row.alias("row")).select("task", "at", "row.*")

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def piece(task: int, first: int, held: list[str]) -> pa.RecordBatch:
            data, crc, length = archive.deflated("".join(held).encode())
            return pa.RecordBatch.from_pylist([{"task": task, "at": first, "rows": len(held), "data": data, "crc": crc, "plain": length}], shape)

        shape = pa.schema([("task", pa.int32()), ("at", pa.int64()), ("rows", pa.int64()), ("data", pa.binary()), ("crc", pa.int64()), ("plain", pa.int64())])
        for batch in batches:
            tasks, first = batch.column(0), batch.column(1)
            columns = [c.to_pylist() for c in batch.columns[2:]]
            for start in range(0, batch.num_rows, min(PIECE_ROWS, SHEET_ROWS)):
                held = [_row([c[k] for c in columns]) for k in range(start, min(start + min(PIECE_ROWS, SHEET_ROWS), batch.num_rows))]
                yield piece(tasks[start].as_py(), first[start].as_py(), held)

    return plain.mapInArrow(write, "task int, at long, rows long, data binary, crc long, plain long")


def _sheet_names(names: list[str]) -> list[str]:
    """Names as sheets can have them: without the characters that they can't, cut to 31, and distinct."""
    out: list[str] = []
    for name in names:
        base = re.sub(r"[\[\]:*?/\\]", "_", name)
        fit, k = base[:31], 1
        while fit.lower() in (x.lower() for x in out):
            k += 1
            fit = f"{base[: 31 - len(f' ({k})')]} ({k})"
        out.append(fit)
    return out


def write_workbook(tables: dict[str, DataFrame], path: str) -> str:
    """A sheet per table, in order of its partitions (a placeholder row where it is empty), and further
    sheets for rows beyond SHEET_ROWS."""
    spark = SparkSession.active()
    sheets: list[tuple[str, DataFrame | None, list, list[str]]] = []  # name, table's pieces, those that it holds, columns
    for name, rows in tables.items():
        pieces = materialize(_pieces(rows))
        known = [(r["task"], r["at"], r["rows"]) for r in pieces.select("task", "at", "rows").orderBy("task", "at").collect()]  # a line per piece
        parts: list[list] = [[]]
        held = 0
        for task, at, n in known:
            if held + n > SHEET_ROWS:
                parts.append([])
                held = 0
            parts[-1].append((task, at))
            held += n
        sheets += [(name if k == 0 else f"{name} {k + 1}", pieces if part else None, part, rows.columns) for k, part in enumerate(parts)]
    names = _sheet_names([s[0] for s in sheets])
    whole = None
    for number, (_, pieces, part, columns) in enumerate(sheets, 1):
        member = f"xl/worksheets/sheet{number}.xml"
        begin = f'{_HEAD}<worksheet xmlns="{MAIN}"><sheetData>{_row(columns if pieces is not None else ["message"])}'
        begin += "" if pieces is not None else _row(["No records"])
        edges = [(member, -1, *_edge(begin)), (member, len(part), *_edge("</sheetData></worksheet>"))]
        own = spark.createDataFrame(edges, archive.PIECES)
        if pieces is not None:
            places = spark.createDataFrame([(t, a, k) for k, (t, a) in enumerate(part)], "task int, at long, place long")
            own = own.union(pieces.join(F.broadcast(places), ["task", "at"]).select(F.lit(member).alias("member"), "place", "data", "crc", "plain"))
        whole = own if whole is None else whole.union(own)
    numbers = range(1, len(sheets) + 1)
    sheet = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    texts = {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{sheet}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{sheet}.styles+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{sheet}.worksheet+xml"/>' for k in numbers) + "</Types>",
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATED}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{MAIN}" xmlns:r="{RELATED}"><sheets>'
        + "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="rId{k}"/>' for k, n in zip(numbers, names, strict=True)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{PACKAGE}/relationships">'
        + "".join(f'<Relationship Id="rId{k}" Type="{RELATED}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in numbers)
        + f'<Relationship Id="rId{len(sheets) + 1}" Type="{RELATED}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'{_HEAD}<styleSheet xmlns="{MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
        '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
    }
    return archive.assemble(whole if whole is not None else spark.createDataFrame([], archive.PIECES), path, texts)


def _edge(text: str) -> tuple[bytes, int, int]:
    data, crc, length = archive.deflated(text.encode())
    return bytearray(data), crc, length

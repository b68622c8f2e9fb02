"""Workbooks (xlsx) read and written in tasks, with the standard library alone.

A workbook is a row of Spark's binary files; its task streams the sheet's XML and gives rows in batches, so only the bytes of a file and its shared strings are held.
Many workbooks are read in many tasks. Writing deals rows over workbooks, which tasks build; the driver only hands one file's bytes at a time to the store, as tasks can't reach it.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the format: name spaces, the number formats that are dates, and the day that counts 0.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATES = {*range(14, 23), 45, 46, 47}
DAY_0 = datetime(1899, 12, 30)
#: What is not XML can't be a cell's text.
NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
ROWS = 10_000


def column_of(cell: str) -> int:
    """The place of a cell's column, from 0, by its letters."""
    n = 0
    for c in cell:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def letters(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def texts_of(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def sheet_path(book: zipfile.ZipFile, sheet: int | str) -> str:
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    found = list(root.iter(f"{MAIN}sheet"))
    own = found[sheet] if isinstance(sheet, int) else next(s for s in found if s.get("name") == sheet)
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = links[own.get(RELATION)]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def date_styles(book: zipfile.ZipFile) -> set[int]:
    """The cell styles that show a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{MAIN}numFmt") if re.search("[ymdhs]", re.sub(r'"[^"]*"|\\[^\\]|\[[^\]]*\]', "", f.get("formatCode", "")).lower())}
    formats = next(root.iter(f"{MAIN}cellXfs"), [])
    return {i for i, f in enumerate(formats) if int(f.get("numFmtId", 0)) in DATES | own}


def rows_of(content: bytes, sheet: int | str = 0) -> Iterator[list]:
    """The sheet's rows: texts, numbers, truth values and ISO dates; missing cells are None, empty rows are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as f:
                for _, node in ElementTree.iterparse(f):
                    if node.tag == f"{MAIN}si":
                        shared.append(texts_of(node))
                        node.clear()
        dates = date_styles(book)
        with book.open(sheet_path(book, sheet)) as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag != f"{MAIN}row":
                    continue
                row: list = []
                for i, c in enumerate(node.iter(f"{MAIN}c")):
                    at = column_of(c.get("r")) if c.get("r") else i
                    row += [None] * (at + 1 - len(row))
                    row[at] = value_of(c, shared, dates)
                node.clear()
                if any(v is not None for v in row):
                    yield row


def value_of(cell: ElementTree.Element, shared: list[str], dates: set[int]):
    kind, v = cell.get("t", "n"), cell.find(f"{MAIN}v")
    if kind == "inlineStr":
        return texts_of(cell)
    if v is None or v.text is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind in ("str", "d"):
        return v.text
    if kind == "b":
        return v.text == "1"
    number = float(v.text)
    if int(cell.get("s", 0)) in dates:
        at = DAY_0 + timedelta(days=number)
        return at.date().isoformat() if number == int(number) else at.isoformat(sep=" ", timespec="seconds")
    return int(v.text) if re.fullmatch(r"-?[0-9]{1,18}", v.text) else number


def kind_of(value) -> str:
    return "boolean" if isinstance(value, bool) else "long" if isinstance(value, int) else "double" if isinstance(value, float) else "date" if isinstance(value, str) and re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", value) else "string"


def read(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """The rows of one workbook, or of all that a folder or pattern names, by the headers of their first rows; a column that a workbook lacks is null in its rows.

    A column is a number, truth value or date if all its values are, text otherwise. The files are read twice: for the columns, and for the rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def headers(batches):
        for b in batches:
            for content in b.content:
                rows = rows_of(content, sheet)
                names = next(rows, [])
                kinds: list[set] = [set() for _ in names]
                for row in rows:
                    for kind, v in zip(kinds, row):
                        if v is not None:
                            kind.add(kind_of(v))
                known = [i for i, v in enumerate(names) if v is not None]
                if known:
                    yield pd.DataFrame({"at": known, "name": [str(names[i]) for i in known], "kinds": pd.Series([sorted(kinds[i]) for i in known], dtype=object)})

    found = files.mapInPandas(headers, "at int, name string, kinds array<string>").groupBy("name").agg(F.min("at").alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds")).orderBy("at", "name").collect()
    types = {r.name: "string" if not r.kinds else r.kinds[0] if len(r.kinds) == 1 else "double" if set(r.kinds) == {"double", "long"} else "string" for r in found}  # one row a column

    def rows(batches):
        for b in batches:
            for content in b.content:
                own = rows_of(content, sheet)
                names, some = [None if v is None else str(v) for v in next(own, [])], []
                for row in own:
                    cells = dict(zip(names, row))
                    some.append([None if (v := cells.get(c)) is None else str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, float) else str(v) for c in types])
                    if len(some) == ROWS:
                        yield pd.DataFrame(some, columns=list(types), dtype=object)
                        some = []
                if some:
                    yield pd.DataFrame(some, columns=list(types), dtype=object)

    if not types:
        return spark.createDataFrame([], T.StructType())
    plain = files.mapInPandas(rows, T.StructType([T.StructField(c, T.StringType()) for c in types]))
    return plain.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()])


def cell_xml(value, at: str) -> str:
    if value is None or isinstance(value, float) and value != value:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, datetime):
        return f'<c r="{at}" t="inlineStr"><is><t>{value.isoformat(sep=" ")}</t></is></c>'
    if isinstance(value, date):
        return f'<c r="{at}" s="1"><v>{(datetime(value.year, value.month, value.day) - DAY_0).days}</v></c>'
    if isinstance(value, (int, float)) and abs(value) != float("inf"):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(NO_XML.sub("", str(value)))}</t></is></c>'


def book_of(names: list[str], rows: list[tuple], sheet: str) -> bytes:
    """A workbook of one sheet."""
    head, office = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    main = MAIN.strip("{}")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        kinds = {"xl/workbook.xml": "sheet.main", "xl/worksheets/sheet1.xml": "worksheet", "xl/styles.xml": "styles"}
        overrides = "".join(f'<Override PartName="/{p}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{k}+xml"/>' for p, k in kinds.items())
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{overrides}</Types>')
        link = lambda i, kind, target: f'<Relationship Id="rId{i}" Type="{office}/{kind}" Target="{target}"/>'
        links = lambda inner: f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{inner}</Relationships>'
        book.writestr("_rels/.rels", links(link(1, "officeDocument", "xl/workbook.xml")))
        book.writestr("xl/_rels/workbook.xml.rels", links(link(1, "worksheet", "worksheets/sheet1.xml") + link(2, "styles", "styles.xml")))
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs></styleSheet>')
        with book.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
            for n, row in enumerate([names, *rows], 1):
                f.write(f'<row r="{n}">{"".join(cell_xml(v, f"{letters(i)}{n}") for i, v in enumerate(row))}</row>'.encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def write(df: DataFrame, folder: str, sheet: str = "Prognose", most: int = 100_000) -> int:
    """df as workbooks part-00000.xlsx and so on in a folder, each of at most so many rows; gives their number. An empty table is one workbook of its header.

    Numbers, truth values, dates and texts keep their type; a time is written as text. What XML can't hold is left out of texts.
    """
    spark, names = df.sparkSession, df.columns
    plain = df.select(*[F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, (T.DecimalType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema])
    kinds = [f.dataType for f in plain.schema]

    def exact(v, kind):
        if v is None or v is pd.NaT or isinstance(v, float) and v != v and not isinstance(kind, T.DoubleType):
            return None
        if isinstance(kind, T.IntegralType):
            return int(v)
        return bool(v) if isinstance(kind, T.BooleanType) else float(v) if isinstance(kind, T.DoubleType) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v

    def books(batches):
        rows: list[tuple] = []
        for b in batches:
            for r in zip(*[b[c].astype(object) for c in b.columns]):
                rows.append(tuple(exact(v, k) for v, k in zip(r, kinds)))
                if len(rows) == most:
                    yield pd.DataFrame({"content": [book_of(names, rows, sheet)]})
                    rows = []
        if rows:
            yield pd.DataFrame({"content": [book_of(names, rows, sheet)]})

    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(root)
    n = 0

    def put(content: bytes) -> None:
        out = store.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, f"part-{n:05}.xlsx"), True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()

    for r in plain.mapInPandas(books, "content binary").toLocalIterator():
        put(bytes(r.content))
        n += 1
    if not n:
        put(book_of(names, [], sheet))
        n = 1
    return n

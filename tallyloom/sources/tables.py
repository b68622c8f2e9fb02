"""Readers and writers: delimited text, Excel, Parquet, image folders, catalogues; header normalisation."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.sources import workbooks

#: Other names of the columns, the first that is there counts.
OFFER_ALIASES = {
    "angebot_id": ("angebot_id", "angebotsnummer", "id", "nr"),
    "datum": ("datum", "date"),
    "kunde": ("kunde", "kundenname", "customer", "kunden"),
    "produkt": ("produkt", "produktname", "product"),
    "kategorie": ("kategorie", "category", "cat"),
    "listenpreis": ("listenpreis", "list_price", "brutto"),
    "verkaufspreis": ("verkaufspreis", "vk", "netto", "preis", "sell_price"),
    "rabatt_pct": ("rabatt_pct", "rabatt", "discount", "discount_pct"),
    "menge": ("menge", "quantity", "qty"),
    "umsatz": ("umsatz", "revenue", "erlös"),
    "deckungsbeitrag_pct": ("deckungsbeitrag_pct", "deckungsbeitrag", "marge", "margin"),
    "vertriebsmitarbeiter": ("vertriebsmitarbeiter", "mitarbeiter", "sales_rep", "vma"),
    "region": ("region", "gebiet"),
}
PURCHASE_ALIASES = {
    "kunde_id": ("kunde_id", "customer_id", "kunden_id"),
    "kunde_name": ("kunde_name", "kundenname", "customer_name", "kunde"),
    "produkt_id": ("produkt_id", "product_id"),
    "produkt_name": ("produkt_name", "produktname", "product_name", "produkt"),
    "kategorie": ("kategorie", "category", "kat"),
    "umsatz": ("umsatz", "revenue", "betrag"),
    "menge": ("menge", "quantity", "qty"),
}

#: Columns that must stay text though all their values may look like numbers.
TEXT_COLUMNS = frozenset({"plz", "firma_id", "kunde_id", "produkt_id", "opp_id"})


def lower_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower().strip() for c in df.columns])


def renamed(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Canonical column names: a column that has one already stays, otherwise the first alias there is renamed."""
    there = {c.lower(): c for c in df.columns}
    names = {}
    for canonical, others in aliases.items():
        if canonical not in df.columns:
            found = next((there[a] for a in others if a in there and there[a] not in names), None)
            if found:
                names[found] = canonical
    return df.withColumnsRenamed(names)


def purchases(df: DataFrame) -> DataFrame:
    """Purchases with keys made from names, revenue 1 and category Unbekannt where they are missing."""
    df = renamed(df, PURCHASE_ALIASES)
    missing = {"produkt_id": lambda: F.upper(F.substring("produkt_name", 1, 4)), "kunde_id": lambda: F.upper(F.substring("kunde_name", 1, 3)), "umsatz": lambda: F.lit(1.0), "kategorie": lambda: F.lit("Unbekannt")}
    return df.withColumns({c: make() for c, make in missing.items() if c not in df.columns})


def sniff(spark: SparkSession, path: str) -> str:
    """The first of tab, semicolon and comma that splits the header; comma if none does."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    return next((s for s in ("\t", ";", ",") if s in line), ",")


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str | None = None, dates: tuple[str, ...] = ()) -> DataFrame:
    """Text with a header. Without a schema, types are inferred but for columns that are names or codes; columns in dates are days (what is none becomes NULL)."""
    if dates:
        df = read_delimited(spark, path, schema, sep)
        return df.withColumns({c: F.to_date(F.try_to_timestamp(F.col(c).cast("string"))) for c in dates if c in df.columns})
    reader = spark.read.option("header", True).option("sep", sep or sniff(spark, path)).option("encoding", "UTF-8")
    if schema is not None:
        return reader.schema(schema).csv(path)
    plain = reader.csv(path)
    typed = reader.option("inferSchema", True).csv(path).schema
    fields = [T.StructField(f.name, T.StringType() if f.name.lower().strip() in TEXT_COLUMNS else f.dataType) for f in typed]
    return reader.schema(T.StructType(fields)).csv(path) if fields else plain


def read_excel(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """A sheet of a workbook, or of all that a folder or pattern names."""
    return workbooks.read(spark, path, sheet)


def read_old_excel(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """A sheet of the binary format of old, of 65,536 rows at most; needs a reader of it for pandas."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet))


READERS = {".csv": read_delimited, ".txt": read_delimited, ".tsv": read_delimited, ".xlsx": read_excel, ".xls": read_old_excel, ".parquet": lambda spark, path: spark.read.parquet(path), ".orc": lambda spark, path: spark.read.orc(path), ".json": lambda spark, path: spark.read.json(path)}


def read(spark: SparkSession, path: str, **how) -> DataFrame:
    """A table by the ending of its path."""
    ending = os.path.splitext(path.rstrip("/"))[1].lower()
    if ending not in READERS:
        raise ValueError(f"can't read files of type {ending or '(none)'}")
    return READERS[ending](spark, path, **how)


def preview(df: DataFrame, n: int = 10) -> tuple[DataFrame, int]:
    """The first rows and the number of all."""
    return df.limit(n), df.count()


def freshness(df: DataFrame, column: str = "datum") -> DataFrame:
    """The latest date: a scan of one column."""
    return df.agg(F.max(column).alias(column))


def catalogue(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Files of a folder with their header and description (from a .meta.txt beside it, else the name), by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path").orderBy("path").collect()
    notes = {r[0]: r[1] for r in spark.read.option("wholetext", True).option("pathGlobFilter", "*.meta.txt").text(folder).select(F.input_file_name(), "value").collect()}
    rows = []
    for (path,) in files:
        stem = os.path.splitext(os.path.basename(path))[0]
        note = next((v.strip() for k, v in notes.items() if os.path.basename(k) == f"{stem}.meta.txt"), stem)
        rows.append((os.path.basename(path), read_delimited(spark, path).columns, note))
    return spark.createDataFrame(rows, "name string, columns array<string>, description string")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Image files with the label of their folder (normal or defect)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{png,jpg,jpeg,bmp,webp,ppm,pgm}").load(folder)
    return files.select("path", "length", F.regexp_extract("path", r"/(normal|defect)/[^/]*$", 1).alias("label"), "content")


IMAGE_ENDINGS = (".png", ".jpg", ".jpeg", ".bmp", ".webp", ".ppm", ".pgm")


def zipped_images(spark: SparkSession, path: str, most_bytes: int = 1 << 28) -> DataFrame:
    """Images inside ZIP files: path (archive!entry), length, label (of the entry's folder) and content.

    Archives are opened where they are read; an entry of more than most_bytes is refused, others than images are skipped.
    """
    import io
    import zipfile

    def run(batches):
        import pandas as pd

        for b in batches:
            for name, content in zip(b.path, b.content):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for entry in archive.infolist():
                        if entry.is_dir() or not entry.filename.lower().endswith(IMAGE_ENDINGS):
                            continue
                        if entry.file_size > most_bytes:
                            raise ValueError(f"{entry.filename} in {name} is too large")
                        data = archive.read(entry)
                        yield pd.DataFrame({"path": [f"{name}!{entry.filename}"], "length": [len(data)], "content": [data]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    rows = files.mapInPandas(run, "path string, length long, content binary")
    return rows.select("path", "length", F.regexp_extract("path", r"(?:^|[/!])(normal|defect)/[^/]*$", 1).alias("label"), "content")


def decoded(df: DataFrame, column: str) -> DataFrame:
    """Base64 text as bytes."""
    return df.withColumn(column, F.unbase64(column))


def time_column(df: DataFrame) -> str | None:
    """The first column whose name hints at time and whose first values are times."""
    for f in df.schema:
        if any(w in f.name.lower() for w in ("time", "date", "datum", "ts", "timestamp")):
            first = df.select(F.col(f"`{f.name}`").cast("string").alias("v")).where("v IS NOT NULL").limit(5)
            if first.where(F.try_to_timestamp("v").isNotNull()).count() == first.count() > 0:
                return f.name
    return None


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_excel(df: DataFrame, folder: str, sheet: str = "Prognose", most: int = 100_000) -> int:
    """Workbooks of one sheet and at most so many rows each in a folder; gives their number."""
    return workbooks.write(df, folder, sheet, most)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))

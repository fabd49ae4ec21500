"""Readers and writers: tables, logs, evaluation sets, archives, directories, snapshots."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What may be read as a table, and how much.
FORMATS = {"csv": "csv", "tsv": "tsv", "json": "json", "parquet": "parquet", "pq": "parquet", "xlsx": "xlsx", "xls": "xlsx"}
MAX_TABLES, MAX_BYTES = 50, 200 << 20


def sniff(extension: str | None, name: str | None, mime: str | None = None) -> str | None:
    """Table format from the extension, else the end of the name, else the MIME type."""
    for guess in (extension, (name or "").rpartition(".")[2]):
        if guess and (kind := FORMATS.get(guess.lower().lstrip("."))):
            return kind
    mimes = {"text/csv": "csv", "text/tab-separated-values": "tsv", "application/json": "json", "application/vnd.apache.parquet": "parquet"}
    return mimes.get(mime or "")


def check_size(spark: SparkSession, path: str, most: int = MAX_BYTES) -> None:
    """Raises ValueError if a file at `path` is larger than `most` bytes; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    if large := files.filter(F.col("length") > most).first():
        raise ValueError(f"{large['path']} has {large['length']} bytes, more than {most}")


def read_table(spark: SparkSession, path: str, kind: str, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """A user's table with types inferred from all of its rows; None in `max_bytes` lifts the limit on files."""
    if max_bytes is not None:
        check_size(spark, path, max_bytes)
    if kind in ("csv", "tsv"):
        return spark.read.csv(path, header=True, inferSchema=True, samplingRatio=1.0, sep="\t" if kind == "tsv" else ",", multiLine=True, escape='"')
    if kind == "json":
        return spark.read.json(path, multiLine=True)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "xlsx":
        return read_workbook(spark, path)
    raise ValueError(f"no reader for {kind}")


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """All sheets by column name, every cell a string, with __sheet_name. Needs openpyxl."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading workbooks needs openpyxl") from e

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                for sheet, rows in pd.read_excel(io.BytesIO(content), sheet_name=None, dtype=str).items():
                    yield pd.DataFrame({"sheet": sheet, "row": [{str(k): v for k, v in r.items() if isinstance(v, str)} for r in rows.to_dict("records")]})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(cells, "sheet string, row map<string,string>")
    names = [r[0] for r in rows.select(F.explode(F.map_keys("row"))).distinct().orderBy("col").collect()]  # column names
    return rows.select(*[F.col("row")[n].alias(n) for n in names], F.col("sheet").alias("__sheet_name"))


def write_csv(df: DataFrame, path: str, limit: int = 100_000) -> bool:
    """Writes the first `limit` rows as one file with a byte order mark and a header; True if there were more."""
    first, *others = df.columns
    df.limit(limit).coalesce(1).toDF(f"\ufeff{first}", *others).write.mode("overwrite").csv(path, header=True)
    return df.offset(limit).limit(1).count() > 0


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no (from 1 in each file) and text of every line of plain UTF-8 files of any size.

    Files are split as Spark splits them; a window numbers the lines of one split, and splits are counted before.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"), F.col("value").alias("text"), F.monotonically_increasing_id().alias("_id"))
    counts = rows.groupBy("path", "_at").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("path").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(F.col("path").alias("_p"), F.col("_at").alias("_a"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("path", "_at").orderBy("_id"))
    numbered = rows.withColumn("_in", inside).join(before, (F.col("path") == F.col("_p")) & (F.col("_at") == F.col("_a")))
    return numbered.select("path", (F.col("_before") + F.col("_in")).cast("long").alias("line_no"), "text")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1 in each file), text and path of every line; gzip is read as it is. For large plain files `read_lines`.

    Bytes are decoded as UTF-8 with or without mark, else UTF-16 with mark, else Latin-1.
    """

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                text = decode(raw)
                found = text.splitlines()
                for at in range(0, len(found), 50_000):
                    part = found[at : at + 50_000]
                    yield pd.DataFrame({"path": name, "line_no": range(at + 1, at + 1 + len(part)), "text": part})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(lines, "path string, line_no long, text string")


def decode(raw: bytes) -> str:
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, title, text of an evaluation corpus by line; rows without an id are skipped."""
    rows = spark.read.schema("_id string, id string, title string, text string").json(path)
    return rows.select(F.coalesce("_id", "id").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text")).filter("doc_id IS NOT NULL")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("_id string, id string, text string").json(path)
    return rows.select(F.coalesce("_id", "id").alias("query_id"), "text").filter("query_id IS NOT NULL AND trim(text) <> ''")


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """query_id, entry_id, rel from three columns, or four with an ignored second one; the last of repeats wins.

    A header and lines that can't be read are skipped; of a decimal judgement the digits behind the point go.
    """
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"), F.monotonically_increasing_id().alias("line"))
    at = F.size("p")
    rows = parts.filter(at.isin(3, 4)).select("line", F.col("p")[0].alias("query_id"), F.element_at("p", -2).alias("entry_id"), F.element_at("p", -1).try_cast("double").alias("r"))
    rows = rows.filter("NOT isnan(r) AND abs(r) < 2147483648")
    return rows.groupBy("query_id", "entry_id").agg(F.max_by(F.col("r").cast("int"), "line").alias("rel"))


def archive_members(spark: SparkSession, path: str, with_content: bool = False) -> DataFrame:
    """archive, member, size (and content) of zip and tar archives and of single gzip files."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                for member, data in _members(name, content):
                    yield pd.DataFrame({"archive": [name], "member": [member], "size": [len(data)], "content": [data if with_content else None]})

    rows = spark.read.format("binaryFile").load(path).select("path", "content")
    return rows.mapInPandas(members, "archive string, member string, size long, content binary")


def _members(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    if zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            yield from ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir())
        return
    try:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            yield from ((m.name, t.extractfile(m).read()) for m in t if m.isfile())
    except tarfile.TarError:
        if content[:2] == b"\x1f\x8b":
            yield name.rpartition("/")[2].removesuffix(".gz"), gzip.decompress(content)


def hashed_files(spark: SparkSession, path: str) -> DataFrame:
    """path, size and sha256 of every file below a folder; anything on a dotted path is skipped."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.filter(~F.col("path").rlike(r"/\.")).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def write_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines below `path`, and a manifest of row counts."""
    counts = []
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
        counts.append(df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows")))
    manifest = counts[0]
    for c in counts[1:]:
        manifest = manifest.union(c)
    manifest.write.mode("overwrite").json(f"{path}/manifest")


def read_snapshot(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table of a snapshot; a malformed line fails the read."""
    return spark.read.schema(schema).json(f"{path}/{name}", mode="FAILFAST")


@dataclass(frozen=True)
class Format:
    """How files of one format are told: by MIME type, its start, extension, or patterns of whole names.

    `by_name_first`: extensions and patterns go before any MIME type, as for formats whose usual type is a general one.
    """

    name: str
    mimes: tuple[str, ...] = ()
    mime_starts: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    by_name_first: bool = False
    fallback: bool = False


def resolve_format(mime: Column, extension: Column, name: Column, formats: Sequence[Format]) -> Column:
    """The name of the first format that takes a file, in seven steps: names that go first (extensions, then patterns), the MIME
    type, its start, extensions, patterns, and the fallback. Extensions may lack their dot; nulls are empty."""
    mime, name = F.coalesce(mime, F.lit("")), F.lower(F.coalesce(name, F.lit("")))
    bare = F.lower(F.coalesce(extension, F.lit("")))
    extension = F.when((bare == "") | bare.startswith("."), bare).otherwise(F.concat(F.lit("."), bare))
    fits_extension = lambda f: (extension != "") & extension.isin(*[e.lower() for e in f.extensions])

    def fits_pattern(f: Format) -> Column:
        found = F.lit(False)
        for p in f.patterns:
            found = found | name.rlike(p)
        return (name != "") & found

    def fits_start(f: Format) -> Column:
        found = F.lit(False)
        for p in f.mime_starts:
            found = found | mime.startswith(p)
        return found

    steps = [
        (lambda f: f.by_name_first and f.extensions, fits_extension), (lambda f: f.by_name_first and f.patterns, fits_pattern), (lambda f: f.mimes, lambda f: (mime != "") & mime.isin(*f.mimes)), (lambda f: f.mime_starts, fits_start),
        (lambda f: f.extensions, fits_extension), (lambda f: f.patterns, fits_pattern), (lambda f: f.fallback, lambda f: F.lit(True)),
    ]
    return F.coalesce(*[F.when(fits(f), F.lit(f.name)) for takes, fits in steps for f in formats if takes(f)], F.lit(None).cast("string"))

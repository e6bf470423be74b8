"""Documents from files: pages and ordered lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the line before each page of a recognised text.
PAGE_MARK = r"--- OCR PAGE (\d+) \([^)]*\) ---"

# Limits of an upload.
MOST_BYTES, MOST_FILES, MANY_FILES, MANY_PAGES, SCANNED_BELOW = 50 * 1024 * 1024, 10, 3, 80, 250


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each text file of a folder as one row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_binaries(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, length, content) of binary files, for an extraction stage that yields text."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def year_in_path(path: Column) -> Column:
    """The last plausible year in a file name."""
    found = F.regexp_extract_all(F.element_at(F.split(path, "/"), -1), F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1))
    return F.get(found, F.size(found) - 1).cast("int")


def pages(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, page_no, text): texts cut at page marks; what stands before the first is page 0."""
    parts = F.split(F.regexp_replace(F.col(text), PAGE_MARK, "\u0001$1\u0002"), "\u0001")
    rows = docs.select(*keys, F.explode(parts).alias("part"))
    numbered = F.regexp_extract("part", r"^(\d+)\x02", 1)
    out = rows.select(*keys, F.when(numbered != "", numbered.cast("int")).otherwise(0).alias("page_no"), F.regexp_replace("part", r"^\d+\x02\r?\n?", "").alias("text"))
    return out.where((F.col("page_no") > 0) | (F.trim("text") != ""))


def lines(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, line_no, line): lines in order, white space collapsed, empty ones kept as numbers only."""
    rows = docs.select(*keys, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line_no", "line"))
    return rows.select(*keys, "line_no", F.trim(F.regexp_replace("line", r"\s+", " ")).alias("line")).where("line <> ''")


def inspected(docs: DataFrame, text: str = "text") -> DataFrame:
    """Pages, length and whether a text looks like a scan without one."""
    return docs.withColumn("n_pages", F.greatest(F.lit(1), F.regexp_count(F.col(text), F.lit(PAGE_MARK)))).withColumn("n_text", F.length(F.col(text))).withColumn("scanned", F.coalesce(F.length(F.trim(F.col(text))), F.lit(0)) < SCANNED_BELOW)


def validated(files: DataFrame, name: str = "name", size: str = "size", mime: str = "mime") -> DataFrame:
    """Files with an array of what speaks against each."""
    n, s, m = F.col(name), F.col(size), F.col(mime)
    errors = F.array_compact(
        F.array(
            F.when(~F.lower(n).endswith(".pdf") | n.isNull(), F.lit("not a pdf")),
            F.when(F.coalesce(s, F.lit(0)) <= 0, F.lit("empty")),
            F.when(s > MOST_BYTES, F.lit("too large")),
            F.when(m.isNotNull() & ~m.isin("", "application/pdf", "application/octet-stream"), F.lit("wrong type")),
        )
    )
    return files.withColumn("errors", errors)


def extracted(files: DataFrame, extract, schema: T.StructType | str) -> DataFrame:
    """Run a pluggable text extractor (an iterator of pandas frames to another) over binary rows."""
    return files.mapInPandas(extract, schema)


def fixtures(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Golden rows from JSON files, one array or object each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_or_recognised(reports: DataFrame, needed: Column, recognise: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Reports, those that need it through a dearer recognition stage; a null condition counts as not needed."""
    flag = F.coalesce(needed, F.lit(False))
    return reports.where(~flag).unionByName(recognise(reports.where(flag)))

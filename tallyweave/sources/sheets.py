"""Fixed-layout sheets: rows by periods as tables, TSV, Markdown and JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sheet(cells: DataFrame, catalogue: DataFrame, periods: Sequence[int | str], key: str = "field_id", period: str = "year", value: str = "value") -> DataFrame:
    """One row for each catalogue row, one column for each period; missing cells are null.

    ``catalogue`` is a small dimension (key, row, label); it is joined after
    the pivot, so the fact side is shuffled once.
    """
    wide = cells.groupBy(key).pivot(period, list(periods)).agg(F.first(value, ignorenulls=True))
    return catalogue.join(wide, key, "left")


def tsv_line(columns: Sequence[Column], sep: str = "\t") -> Column:
    """Cells joined by tabs; a missing one is empty, tabs and line ends inside become blanks."""
    return F.concat_ws(sep, *[F.coalesce(F.regexp_replace(c.cast("string"), r"[\t\r\n]", " "), F.lit("")) for c in columns])


def tsv(wide: DataFrame, periods: Sequence[int | str], first_row: int | None = None, last_row: int | None = None, labels: bool = True) -> DataFrame:
    """(row, line) in row order; with bounds, rows that the sheet lacks come as empty lines."""
    shown = [F.col("label")] * labels + [F.col(str(p)) for p in periods]
    out = wide.select("row", tsv_line(shown).alias("line"))
    if first_row is not None and last_row is not None:
        grid = wide.sparkSession.range(first_row, last_row + 1).select(F.col("id").cast("int").alias("row"))
        out = grid.join(out, "row", "left").select("row", F.coalesce("line", F.lit("\t" * (len(shown) - 1))).alias("line"))
    return out.orderBy("row")


def markdown(wide: DataFrame, periods: Sequence[int | str]) -> DataFrame:
    """(row, line) with a header and a rule above."""
    spark = wide.sparkSession
    names = ["", *map(str, periods)]
    head = spark.createDataFrame([(-2, "| " + " | ".join(names) + " |"), (-1, "|" + " --- |" * len(names))], "row int, line string")
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("label", *map(str, periods))]
    body = wide.select(F.col("row").cast("int").alias("row"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    return head.unionByName(body).orderBy("row")


def json_rows(wide: DataFrame, periods: Sequence[int | str]) -> DataFrame:
    """(row, json): each sheet row as a JSON object, nulls included."""
    values = F.struct(*[F.col(str(p)).alias(str(p)) for p in periods])
    return wide.select("row", F.to_json(F.struct("field_id", "label", values.alias("values")), {"ignoreNullFields": "false"}).alias("json"))


def template_lines(layout: DataFrame, values: DataFrame, title: str) -> DataFrame:
    """(row, label, value, line): a two-column sheet as its template lays it out, rows without a value included.

    ``layout`` is a small dimension (row, kind, section, label, indent) whose
    kind is ``blank``, ``section``, ``subheader`` or ``value``; ``values`` has
    (section, label, value).  Layout rows stay in order whatever is missing.
    """
    found = values.select(F.col("section").alias("__s"), F.col("label").alias("__l"), "value")
    both = layout.join(found, (F.col("section") == F.col("__s")) & (F.col("label") == F.col("__l")) & (F.col("kind") == "value"), "left")
    label = F.when(F.col("kind") == "blank", "").when(F.col("kind") == "section", F.col("section")).otherwise(F.concat(F.repeat(F.lit(" "), F.coalesce("indent", F.lit(0))), "label"))
    value = F.when(F.col("kind") == "section", title).when(F.col("kind") == "value", F.coalesce("value", F.lit(""))).otherwise("")
    line = F.when(F.col("kind") == "blank", "").otherwise(F.concat(label, F.lit("\t"), value))
    return both.select("row", label.alias("label"), value.alias("value"), line.alias("line")).orderBy("row")


def table_lines(values: DataFrame, title: str, order: Sequence[Column]) -> DataFrame:
    """(line): section, label and value of each row below a header."""
    head = values.sparkSession.createDataFrame([(0, f"Section\tLabel\t{title}")], "at int, line string")
    body = values.select(F.lit(1).alias("at"), *[c.alias(f"__o{i}") for i, c in enumerate(order)], tsv_line([F.col("section"), F.col("label"), F.col("value")]).alias("line"))
    return head.unionByName(body, allowMissingColumns=True).orderBy("at", *[f"__o{i}" for i in range(len(order))]).select("line")

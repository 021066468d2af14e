"""Results for people and tools: ranked rows as JSON, Markdown or a plain table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.functions import text

#: Characters of a cell in a table.
WIDTH = 40


def ranked(rows: DataFrame, score: str, *ties: str) -> DataFrame:
    """A result list (bounded by its limit) with its rank from 1."""
    from pyspark.sql import Window as W

    return rows.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), *ties)))


def render(rows: DataFrame, form: str = "table", order: str | None = None) -> DataFrame:
    """line_no, line of a result list in ``json`` (a row per line), ``markdown`` or ``table``; nulls are left out of JSON and shown as ``null`` otherwise."""
    if form not in ("json", "markdown", "table"):
        raise ValueError(f"no format {form}")
    from pyspark.sql import Window as W

    numbered = rows.withColumn("__n", F.row_number().over(W.orderBy(order or F.monotonically_increasing_id())))
    if form == "json":
        return numbered.select(F.col("__n").alias("line_no"), F.to_json(F.struct(*rows.columns)).alias("line"))
    cells = [F.coalesce(F.regexp_replace(text.truncate(F.col(c).cast("string"), WIDTH), r"\s+", " "), F.lit("null")) for c in rows.columns]
    if form == "markdown":
        cells = [F.replace(c, F.lit("|"), F.lit("\\|")) for c in cells]
        line, head = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")), ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    else:
        line, head = F.concat_ws("  ", *[F.rpad(c, WIDTH + 3, " ") for c in cells]), ["  ".join(c.ljust(WIDTH + 3) for c in rows.columns)]
    top = rows.sparkSession.createDataFrame([(i - len(head), h) for i, h in enumerate(head, 1)], "line_no int, line string")
    return top.unionByName(numbered.select(F.col("__n").alias("line_no"), line.alias("line")))

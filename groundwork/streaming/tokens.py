"""A model's streamed output, one JSON object a line, as pieces of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = "message struct<content: string>, error string, done boolean"


def pieces(lines: DataFrame, line: str = "value") -> DataFrame:
    """(text, done) of every line; works on streams and tables alike. A line with an error object raises its message."""
    r = F.from_json(F.col(line), LINE)
    text: Column = F.when(r["error"].isNotNull(), F.raise_error(r["error"]).cast("string")).otherwise(F.coalesce(r["message"]["content"], F.lit("")))
    return lines.where(F.trim(F.col(line)) != "").select(text.alias("text"), F.coalesce(r["done"], F.lit(False)).alias("done"))

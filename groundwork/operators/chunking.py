"""Texts cut into windows and blocks, one row per piece. Array functions only: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_window(size: int, overlap: int) -> None:
    if size <= overlap or overlap < 0:
        raise ValueError(f"size {size} must exceed overlap {overlap}, and overlap must not be negative")


def windows(text: Column, size: int, overlap: int) -> Column:
    """Array of (start, piece) at 0, step, 2 * step ... with step = size - overlap; empty text gives none."""
    check_window(size, overlap)
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap))
    pieces = F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("piece")))
    return F.when(n > 0, pieces)


def chunk_windows(df: DataFrame, text: str = "text", size: int = 800, overlap: int = 150) -> DataFrame:
    """``df`` without ``text``, with ``piece_no, start, piece`` per window; null and empty texts give no row."""
    d = df.withColumn("_w", windows(F.col(text), size, overlap)).drop(text)
    d = d.select(*[c for c in d.columns if c != "_w"], F.posexplode("_w").alias("piece_no", "_p"))
    return d.withColumn("start", F.col("_p.start")).withColumn("piece", F.col("_p.piece")).drop("_p")


def with_path(path: Column, piece: Column) -> Column:
    """The piece behind its heading path (``A › B`` and a line end), which does not count in the window."""
    return F.when(F.size(path) > 0, F.concat(F.array_join(path, " › "), F.lit("\n"), piece)).otherwise(piece)


def spanned_pages(start: Column, end: Column, breaks: Column) -> Column:
    """Distinct printed pages, in order, whose stretch overlaps [start, end).

    ``breaks`` is an array of (offset, page) in rising order; without an overlap the last break at or
    before ``start`` counts.
    """
    hit = F.filter(breaks, lambda b, i: (b["offset"] < end) & ((i == F.size(breaks) - 1) | (F.get(breaks, i + 1)["offset"] > start)))
    pages = F.array_distinct(F.filter(F.transform(hit, lambda b: b["page"]), lambda p: p.isNotNull()))
    before = F.filter(breaks, lambda b: b["offset"] <= start)
    return F.when(F.size(hit) > 0, pages).otherwise(F.array(F.get(before, F.size(before) - 1)["page"]))


def paragraph_blocks(text: Column, target: int = 1200) -> Column:
    """Paragraphs packed greedily until the next one would exceed ``target``."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, p: Column) -> Column:
        full = (acc["cur"] != "") & (F.length(acc["cur"]) + F.length(p) > target)
        done = F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])
        cur = F.when(full | (acc["cur"] == ""), p).otherwise(F.concat(acc["cur"], F.lit("\n\n"), p))
        return F.struct(done.alias("done"), cur.alias("cur"))

    return F.aggregate(paragraphs, zero, step, lambda a: F.when(a["cur"] != "", F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))


def page_chunks(pages: DataFrame, page: str, text: str, size: int, overlap: int) -> DataFrame:
    """``pages`` (of any reader) as windows of their text with runs of whitespace collapsed; pages without text give none."""
    spaced = pages.withColumn(text, F.trim(F.regexp_replace(F.col(text), r"(?U)\s+", " ")))
    return chunk_windows(spaced.where(F.col(text) != "").where(F.col(page).isNotNull()), text, size, overlap)


def pages_read(files: DataFrame, read, schema: str) -> DataFrame:
    """Rows out of whole files: ``read(path, content)`` yields one tuple a page. The seam for readers that Spark lacks.

    ``files`` is a ``binaryFile`` table; a task reads one file at a time.
    """
    import pandas as pd

    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(parts):
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                yield pd.DataFrame(list(read(path, content)), columns=names)

    return files.select("path", "content").mapInPandas(run, schema)

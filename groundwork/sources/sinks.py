"""Writing tables and runs: once, in whole partitions, never over other content."""

from __future__ import annotations

import json
import os
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def no_link(path: str) -> str:
    """``path`` unless it, or a folder on its way, is a symbolic link of this machine's file system; a remote path has none."""
    local = re.sub(r"^file:(//)?", "", path)
    if re.match(r"^[a-z][a-z0-9+.-]*:", local):
        return path
    at = os.path.abspath(local)
    while True:
        if os.path.islink(at):
            raise ValueError(f"{path}: {at} is a symbolic link")
        up = os.path.dirname(at)
        if up == at:
            return path
        at = up


def write_json_lines(df: DataFrame, path: str) -> None:
    """A new folder of JSON Lines; an existing one is an error. Null fields are left out, as in the records."""
    df.write.mode("errorifexists").json(no_link(path))


def content_hash(df: DataFrame) -> str:
    """A hash of the rows whatever their order: count, sum and xor of row hashes, one row to the driver."""
    r = df.select(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).alias("h")).agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()
    return "-".join(str(x) for x in r)


def write_once(df: DataFrame, path: str) -> str:
    """``geschrieben`` or, where the same rows are there already, ``unveraendert``; other rows there are an error."""
    spark = df.sparkSession
    no_link(path)
    if exists(spark, path):
        if content_hash(spark.read.parquet(path)) != content_hash(df):
            raise ValueError(f"{path} holds other rows")
        return "unveraendert"
    df.write.mode("errorifexists").parquet(path)
    return "geschrieben"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def replace_whole(df: DataFrame, path: str) -> None:
    """``df`` in place of a table: written beside it and renamed when complete, so that no reader sees half of it."""
    spark = df.sparkSession
    beside = no_link(path).rstrip("/") + ".neu"
    df.write.mode("overwrite").parquet(beside)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(p(path), True)
    if not fs.rename(p(beside), p(path)):
        raise OSError(f"{beside} could not take the place of {path}")


def rewrite_collections(df: DataFrame, path: str, by: tuple[str, ...] = ("konfig", "spiel_id")) -> None:
    """The collections (and configurations) that ``df`` has in place of the stored ones; all others stay untouched."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(no_link(path))


def drop_collections(spark: SparkSession, path: str, gone: DataFrame, key: str = "spiel_id") -> int:
    """Deletes the partitions of collections that are gone, by their folders; returns how many. Keys of collections only reach the driver."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    n = 0
    for r in gone.select(key).distinct().toLocalIterator():
        for at in fs.globStatus(p(f"{path}/*/{key}={r[0]}")) or []:
            n += bool(fs.delete(at.getPath(), True))
        at = p(f"{path}/{key}={r[0]}")
        n += bool(fs.exists(at) and fs.delete(at, True))
    return n


def write_run(answers: DataFrame, root: str, name: str, meta: dict[str, Any]) -> str:
    """A run's answers and its description under ``root/name``; a run that is there is never written over."""
    spark = answers.sparkSession
    at = f"{no_link(root).rstrip('/')}/{name}"
    if exists(spark, at):
        raise ValueError(f"the run {at} is there already")
    answers.write.mode("errorifexists").parquet(f"{at}/antworten")
    row = spark.range(1).select(F.lit(json.dumps(meta, sort_keys=True, ensure_ascii=False)).alias("value"))
    row.coalesce(1).write.mode("errorifexists").text(f"{at}/meta")
    return at


def write_verdicts(verdicts: DataFrame, run: str, judge: str) -> None:
    """The verdicts of one judge beside the answers of a run; those that are there are never written over."""
    verdicts.write.mode("errorifexists").parquet(f"{no_link(run)}/urteile-{judge}")


def upserted(stored: DataFrame, new: DataFrame, key: str, defaults: dict[str, Any] | None = None) -> DataFrame:
    """Descriptions of collections: a field that ``new`` leaves null keeps its stored value, or gets its default."""
    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in new.columns if c != key])
    j = stored.join(n, key, "full")
    cols = [F.coalesce(*([F.col(f"_{c}")] if c in new.columns else []), F.col(c), F.lit((defaults or {}).get(c))).alias(c) if c != key else F.col(key) for c in stored.columns]
    return j.select(*cols)


def report(df: DataFrame, title: str, rows: int = 100) -> str:
    """A small table as text with a title, rates and counts as they are; more than ``rows`` rows are an error, for a report is no export."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"{title}: more than {rows} rows")
    cells = [df.columns, *[["-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r] for r in got]]
    width = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    return "\n".join([title, *["  ".join(c.rjust(w) for c, w in zip(r, width)) for r in cells]])

"""Measuring answers: hits and misses, rates with their parts, confusion, run comparison.

Rates are null where nothing was counted, and denominators depend on the questions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("richtig", "teilweise", "falsch", "unsicher")
VERDICTS = (*LABELS, "unparsebar")


def rate(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def category(refusal: Column, expected: Column, retrieved: Column) -> Column:
    """``verweigerung``, ``getroffen`` or ``verfehlt``; null for a question that has no expected page."""
    return (
        F.when(F.coalesce(refusal, F.lit(False)), "verweigerung")
        .when(F.coalesce(F.size(expected), F.lit(0)) <= 0, F.lit(None))
        .when(F.coalesce(F.arrays_overlap(expected, retrieved), F.lit(False)), "getroffen")
        .otherwise("verfehlt")
    )


def hit_counts(df: DataFrame, *by: str) -> DataFrame:
    """questions, denominator, hits, misses, refusals and hit rate of rows with a ``kategorie``."""
    c = F.col("kategorie")
    d = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("fragen"), F.count_if(c.isin("getroffen", "verfehlt")).alias("nenner"),
        F.count_if(c == "getroffen").alias("getroffen"), F.count_if(c == "verfehlt").alias("verfehlt"), F.count_if(c == "verweigerung").alias("verweigerung"),
    )
    return d.withColumn("quote", F.round(rate(F.col("getroffen"), F.col("nenner")), 6))


def confusion(df: DataFrame, label: str = "label", verdict: str = "urteil") -> DataFrame:
    """One row per label with a count for each verdict, zeros included."""
    spark = df.sparkSession
    got = df.groupBy(F.col(label).alias("label")).pivot(verdict, list(VERDICTS)).count()
    every = spark.createDataFrame([(x,) for x in LABELS], "label string")
    return every.join(got, "label", "left").na.fill(0)


def run_counts(df: DataFrame, *by: str) -> DataFrame:
    """Counts of each verdict, ``treffsicherheit`` (right among the decided), typical and largest time."""
    v = F.col("urteil")
    t = F.when(F.col("sekunden") >= 0, F.col("sekunden"))
    d = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(v == x).alias(x) for x in VERDICTS], F.round(F.median(t), 6).alias("median_s"), F.max(t).alias("max_s"))
    return d.withColumn("treffsicherheit", F.round(rate(F.col("richtig"), F.col("n") - F.col("unsicher")), 6))


def stable(df: DataFrame, question: list[str]) -> DataFrame:
    """Questions whose verdict is the same in all repetitions, of at least two."""
    return df.groupBy(*question).agg(F.min("urteil").alias("urteil"), F.max("urteil").alias("_b"), F.count(F.lit(1)).alias("n")).where("urteil = _b and n >= 2").drop("_b")


ORDER = {"falsch": 0, "unsicher": 1, "teilweise": 2, "richtig": 3}


def directions(base: DataFrame, other: DataFrame, question: list[str], least: int = 2) -> DataFrame:
    """``verbessert`` where every verdict of ``other`` is better than every one of ``base``, ``verschlechtert`` the other way."""
    score = F.coalesce(*[F.when(F.col("urteil") == k, F.lit(v)) for k, v in ORDER.items()])

    def span(d: DataFrame, p: str) -> DataFrame:
        g = d.groupBy(*question).agg(F.min(score).alias(f"{p}min"), F.max(score).alias(f"{p}max"), F.count(score).alias("n"), F.count(F.lit(1)).alias("m"))
        return g.where((F.col("n") == F.col("m")) & (F.col("n") >= least)).drop("n", "m")

    j = span(base, "b").join(span(other, "o"), question)
    d = F.when(F.col("omin") > F.col("bmax"), "verbessert").when(F.col("omax") < F.col("bmin"), "verschlechtert")
    return j.select(*question, d.alias("richtung")).where("richtung is not null")


def confidence_bins(df: DataFrame, confidence: str, right: str, edges: tuple = (0.0, 0.5, 0.7, 0.9, 0.97, 1.0001)) -> DataFrame:
    """Number and share of right rows per bin of confidence, empty bins included."""
    c = F.col(confidence)
    no = sum((F.when(c >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    got = df.where((c >= edges[0]) & (c < edges[-1])).groupBy(no.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(right)).alias("treffer"))
    every = df.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, von double, bis double")
    return every.join(got, "bin", "left").na.fill(0, ["n", "treffer"]).withColumn("quote", F.round(rate(F.col("treffer"), F.col("n")), 6))


def threshold_curve(df: DataFrame, confidence: str, right: str, at: tuple = (0.7, 0.8, 0.9, 0.95)) -> DataFrame:
    """For each threshold the rows below it, and the wrong ones among those not below: one pass over the rows."""
    c, ok = F.col(confidence), F.col(right)
    row = df.agg(F.count(F.lit(1)).alias("n"), *[x for i, t in enumerate(at) for x in (F.count_if(c < t).alias(f"e{i}"), F.count_if((c >= t) & ~ok).alias(f"w{i}"), F.count_if(c >= t).alias(f"a{i}"))])
    parts = F.array(*[F.struct(F.lit(t).alias("schwelle"), F.col("n"), F.col(f"e{i}").alias("eskaliert"), F.col(f"w{i}").alias("fehler"), F.col(f"a{i}").alias("darueber")) for i, t in enumerate(at)])
    return row.select(F.explode(parts).alias("p")).select("p.*")


def worst(df: DataFrame, key: str, part: str, whole: str) -> DataFrame:
    """The group with the largest rate, on ties the largest key; groups without denominator don't count."""
    q = rate(F.col(part), F.col(whole))
    return df.where(F.col(whole) > 0).agg(F.max_by(F.struct(F.col(key).alias("gruppe"), F.col(part).alias("zaehler"), F.col(whole).alias("nenner")), F.struct(q.alias("q"), F.col(key).alias("k"))).alias("w")).select("w.*")


def retrieved_pages(hits: DataFrame, by: list[str], rank: str, book: str, pages: str) -> DataFrame:
    """(by, abgerufen): every page that any hit spans, with its book, in rank order and once each."""
    one = F.struct(F.col(rank).alias("r"), F.transform(pages, lambda p: F.struct(F.col(book).alias("buch_id"), p.alias("seite"))).alias("p"))
    g = hits.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("_h"))
    return g.select(*by, F.array_distinct(F.flatten(F.transform("_h", lambda x: x["p"]))).alias("abgerufen"))


def comparison(rows: DataFrame, setting: str, base: str, question: list[str]) -> DataFrame:
    """(setting, verbessert, verschlechtert): questions that all runs of a setting judge better, or worse, than all runs of ``base``."""
    score = F.coalesce(*[F.when(F.col("urteil") == k, F.lit(v)) for k, v in ORDER.items()])
    g = rows.groupBy(setting, *question).agg(F.min(score).alias("lo"), F.max(score).alias("hi"), F.count(score).alias("n"), F.count(F.lit(1)).alias("m")).where("n = m and n >= 2")
    b = g.where(F.col(setting) == base).select(*question, F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    j = g.where(F.col(setting) != base).join(b, question)
    return j.groupBy(setting).agg(F.count_if(F.col("lo") > F.col("bhi")).alias("verbessert"), F.count_if(F.col("hi") < F.col("blo")).alias("verschlechtert"))

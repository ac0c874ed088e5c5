"""Vector and word ranking for many questions at once, with filters before ranking and fixed tie order."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions.text import tokens

K1, B = 1.2, 0.75


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, elements in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalized(v: Column) -> Column:
    # repeated, as a lambda would take the norm anew for every element
    norms = F.array_repeat(F.sqrt(dot(v, v)) + F.lit(1e-9), F.size(v))
    return F.zip_with(v, norms, lambda x, n: x.cast("double") / n)


def ranked(df: DataFrame, by: list[str], score: str, ties: list[str], k: int | None = None, name: str = "rank") -> DataFrame:
    """Rank from 1 by score descending, then ``ties`` ascending; Catalyst cuts to ``k`` before the shuffle too."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    out = df.withColumn(name, F.row_number().over(w))
    return out.where(F.col(name) <= k) if k else out


def drop_types(df: DataFrame, types: list[str], column: str = "typ") -> DataFrame:
    """Rows of other types; a null type is kept."""
    return df.where(F.col(column).isNull() | ~F.trim(column).isin(types)) if types else df


def equal_to(df: DataFrame, **values) -> DataFrame:
    """Rows equal to all values.

    No condition at all, a column that is not there and a value that no row has are errors; the
    values are looked for in one pass.
    """
    if not values:
        raise ValueError("a filter needs at least one condition")
    if missing := set(values) - set(df.columns):
        raise ValueError(f"no such fields: {sorted(missing)}")
    same = {c: F.col(c).eqNullSafe(F.lit(v)) for c, v in values.items()}
    seen = df.agg(*[F.max(x).alias(c) for c, x in same.items()]).first()
    if unseen := [c for c in values if not seen[c]]:
        raise ValueError(f"no row has these values: { {c: values[c] for c in unseen} }")
    for x in same.values():
        df = df.where(x)
    return df


#: Questions and chunks that one task compares at most.
BLOCK = 20_000


def gridded(questions: DataFrame, chunks: DataFrame, best: Callable[[pa.Table, pa.Table], pa.Table], block: int = BLOCK, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(question, id, pos, score) of ``best`` over all pairs of a block of questions and a block of chunks of one collection.

    A collection of any size is a grid of blocks of bounded size, so no task holds a hot collection; both
    sides have ``collection``, questions ``question``, chunks ``id``. Only what ``best`` returns is shuffled on.
    ``prepare`` is done to the chunks where the blocks are, behind their one shuffle.
    """

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("collection").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))

    grid = blocks(questions, "_q").join(blocks(chunks, "_c"), "collection")

    def at(key: str, n: str):
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = questions.join(grid, "collection").withColumn("qb", at("question", "_q")).withColumn("cb", every("_c")).drop("_q", "_c")
    right = chunks.join(grid, "collection").withColumn("cb", at("id", "_c")).withColumn("qb", every("_q")).drop("_q", "_c")
    keys = ["collection", "qb", "cb"]
    if prepare:
        right = prepare(right.repartition(*keys))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "question string, id bigint, pos int, score double")


def _kept(question: pa.ChunkedArray, right: pa.Table, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    """Table of (question number, chunk numbers, scores)."""
    q = np.repeat(np.array([r[0] for r in rows], np.int64), [len(r[1]) for r in rows])
    c = np.concatenate([r[1] for r in rows]) if rows else np.empty(0, np.int64)
    s = np.concatenate([r[2] for r in rows]) if rows else np.empty(0)
    return pa.table({"question": question.take(pa.array(q)), "id": right["id"].take(pa.array(c)), "pos": right["pos"].take(pa.array(c)), "score": pa.array(s, pa.float64())})


def _best(score: np.ndarray, of: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of ``of`` (chunk numbers) with their scores; ties in ``order``."""
    if len(of) > k:
        least = np.partition(score, len(of) - k)[len(of) - k]
        keep = score >= least
        of, score = of[keep], score[keep]
    chosen = np.lexsort((order[of], -score))[:k]
    return of[chosen], score[chosen]


def _order(right: pa.Table) -> np.ndarray:
    """Place of each chunk by position and id."""
    out = np.empty(right.num_rows, np.int64)
    out[np.lexsort((right["id"].to_numpy(), right["pos"].to_numpy()))] = np.arange(right.num_rows)
    return out


def vector_topk(questions: DataFrame, chunks: DataFrame, collection: str, k: int, digits: int = 9) -> DataFrame:
    """(question, id, score, rank): per question the ``k`` nearest chunks of its collection.

    Both sides have ``collection`` and a vector of one length (``q`` and ``v``), chunks also ``id`` and
    ``pos``. One matrix product per pair of blocks; scores are rounded to ``digits`` before ranking, so
    that equal vectors tie and take the lower position.
    """

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list = []
        if left.num_rows and right.num_rows:
            a, b = (t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1) for t, c in ((left, "q"), (right, "v")))
            every, order = np.arange(right.num_rows), _order(right)
            for s in range(0, len(a), 512):
                for i, row in enumerate(np.round(a[s : s + 512] @ b.T, digits)):
                    rows.append((s + i, *_best(row, every, order, k)))
        return _kept(left["question"], right, rows)

    q = questions.select(F.col("question").cast("string").alias("question"), F.col(collection).cast("string").alias("collection"), "q")
    c = chunks.select("id", F.col("pos").cast("int").alias("pos"), F.col(collection).cast("string").alias("collection"), "v")
    return ranked(gridded(q, c, best), ["question"], "score", ["pos", "id"], k).select("question", "id", "score", "rank")


def pairwise_topk(questions: DataFrame, chunks: DataFrame, collection: str, k: int, digits: int = 9) -> DataFrame:
    """``vector_topk`` by a join and column expressions alone: the plain way, for comparison."""
    j = questions.join(chunks, collection).withColumn("score", F.round(dot(F.col("q"), F.col("v")), digits))
    return ranked(j, ["question"], "score", ["pos", "id"], k).select(F.col("question").cast("string").alias("question"), "id", "score", "rank")


def topk_difference(old: DataFrame, new: DataFrame, digits: int = 6) -> DataFrame:
    """(question, gleich, abweichung): whether two ranked lists have the same chunks in the same places, and the largest difference of scores."""
    o = old.select("question", "rank", F.col("id").alias("a"), F.col("score").alias("x"))
    n = new.select("question", "rank", F.col("id").alias("b"), F.col("score").alias("y"))
    j = o.join(n, ["question", "rank"], "full")
    return j.groupBy("question").agg(F.bool_and(F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("gleich"), F.round(F.max(F.abs(F.col("x") - F.col("y"))), digits).alias("abweichung"))


def same_but_ties(got: DataFrame, wanted: DataFrame, every: DataFrame, digits: int = 6) -> DataFrame:
    """(question, gleich): two top lists are the same but for the order inside ties.

    ``every`` has the scores (question, id, score) of all chunks. A tie that is whole in the list must
    have the same chunks; of one cut by the end of the list only the number of members counts.
    """

    def tied(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("question", F.round("score", digits).alias("score")).agg(F.sort_array(F.collect_list("id")).alias(name))

    members = every.groupBy("question", F.round("score", digits).alias("score")).agg(F.count(F.lit(1)).alias("alle"))
    j = tied(wanted, "soll").join(tied(got, "ist"), ["question", "score"], "full").join(members, ["question", "score"], "left")
    whole = F.size("soll") == F.col("alle")
    same = F.when(whole, F.col("soll") == F.col("ist")).otherwise(F.size("soll") == F.size("ist"))
    return j.groupBy("question").agg(F.bool_and(F.coalesce(same, F.lit(False))).alias("gleich"))


def postings(chunks: DataFrame) -> DataFrame:
    """(id, collection, term, tf, len): words of each text with their number; ``len`` counts one tag more."""
    t = chunks.where("text is not null").select("id", "collection", tokens(F.col("text")).alias("w"))
    t = t.select("id", "collection", (F.size("w") + 1).alias("len"), F.explode("w").alias("term"))
    return t.groupBy("id", "collection", "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(question, id, score, rank): per question the ``k`` best chunks of its collection by BM25.

    Word statistics are those of all chunks. A non-positive inverse frequency counts as 1e-6, ties
    take the lower position. Postings live in blocks only: a task inverts its block of chunks and adds up
    the weights question by question, so no pair of question and chunk is shuffled but the best ones.
    """
    c = chunks.where("text is not null").select("id", F.col("pos").cast("int").alias("pos"), F.col("collection").cast("string").alias("collection"), "text")
    cut = lambda df: df.withColumn("w", tokens(F.col("text"))).drop("text")
    q = questions.select(F.col("question").cast("string").alias("question"), F.col("collection").cast("string").alias("collection"), F.array_distinct(tokens(F.col("frage"))).alias("w"))
    asked = q.select("question", "collection", F.explode("w").alias("term"))
    counted = cut(c)
    df = counted.select(F.explode(F.array_distinct("w")).alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = counted.agg(F.count(F.lit(1)).cast("double").alias("docs"), F.avg(F.size("w") + 1).alias("mean"))
    # a table of one row
    df = df.join(F.broadcast(total))
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weighed = asked.join(df.select("term", idf.alias("idf"), "mean"), "term").groupBy("question", "collection").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("t"), F.first("mean").alias("mean"))
    weighed = weighed.select("question", "collection", F.col("t.term").alias("term"), F.col("t.idf").alias("idf"), "mean")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list = []
        if left.num_rows and right.num_rows:
            words = right["w"].combine_chunks()
            length = np.diff(words.offsets.to_numpy())
            flat = words.flatten().dictionary_encode()
            number = {w: i for i, w in enumerate(flat.dictionary.to_pylist())}
            code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) * right.num_rows + np.repeat(np.arange(right.num_rows), length)
            pair, tf = np.unique(code, return_counts=True)
            term, doc = pair // right.num_rows, pair % right.num_rows
            start = np.searchsorted(term, np.arange(len(number) + 1))
            mean = left["mean"][0].as_py()
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * (length[doc] + 1) / mean))
            order = _order(right)
            score = np.zeros(right.num_rows)
            for i, (terms, weights) in enumerate(zip(left["term"].to_pylist(), left["idf"].to_pylist())):
                hit = []
                for t, idf in zip(terms, weights):
                    n = number.get(t)
                    if n is not None:
                        at = slice(start[n], start[n + 1])
                        score[doc[at]] += idf * part[at]
                        hit.append(doc[at])
                if hit:
                    of = np.unique(np.concatenate(hit))
                    rows.append((i, *_best(np.round(score[of], 9), of, order, k)))
                    score[of] = 0
        return _kept(left["question"], right, rows)

    return ranked(gridded(weighed, c, best, prepare=cut), ["question"], "score", ["pos", "id"], k).select("question", "id", "score", "rank")


def fused(lists: list[DataFrame], n: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (question, id, rank) lists: (question, id, score, rank); ties take the first appearance."""
    u = None
    for no, x in enumerate(lists):
        part = x.select("question", "id", F.lit(no).alias("list"), "rank")
        u = part if u is None else u.unionByName(part)
    g = u.groupBy("question", "id").agg(F.round(F.sum(1.0 / (F.lit(constant) + F.col("rank"))), 12).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    return ranked(g, ["question"], "score", ["first"], n).select("question", "id", "score", "rank")


def reranked(candidates: DataFrame, score: Column, k: int) -> DataFrame:
    """Candidates (question, id, rank ...) in the order of a pair score, ties in candidate order."""
    c = candidates.withColumn("pair_score", score).withColumnRenamed("rank", "candidate")
    return ranked(c, ["question"], "pair_score", ["candidate"], k)


def hybrid(questions: DataFrame, chunks: DataFrame, k: int, candidates: int = 20) -> DataFrame:
    """(question, id, score, rank): the ``candidates`` best by vector and by BM25, fused by reciprocal ranks; ties take the vector list first.

    Questions have ``question, collection, frage, q``, chunks ``id, collection, pos, text, v``.
    """
    return fused([vector_topk(questions, chunks, "collection", candidates), bm25(questions, chunks, candidates)], k)


def pages_of(hits: DataFrame, by: list[str], rank: str, page: str, name: str = "seiten") -> DataFrame:
    """The distinct pages of each group's hits in the order of their ranks."""
    g = hits.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(page).alias("p")))).alias("_h"))
    return g.select(*by, F.array_distinct(F.filter(F.transform("_h", lambda x: x["p"]), lambda p: p.isNotNull())).alias(name))


def context(hits: DataFrame, by: list[str], rank: str, head: Column, text: str) -> DataFrame:
    """``kontext``: the hits of each group as blocks with a head in brackets, in the order of their ranks, blank lines between."""
    block = F.concat(F.lit("["), head, F.lit("]\n"), F.coalesce(F.col(text), F.lit("")))
    g = hits.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b")))).alias("_h"))
    return g.select(*by, F.array_join(F.transform("_h", lambda x: x["b"]), "\n\n").alias("kontext"))

"""The N best items of every group by a mergeable, bounded heap per group.

The heap of a group is the list of its N best rows so far. It is filled inside every input
partition, so at most N rows per group and partition are shuffled, and the same function merges
the heaps afterwards. A group of any size costs N rows per partition, never more.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.session import table

#: Rows a heap table takes up before it is brought back to N rows per group.
BUFFER_ROWS = 100_000
#: Rows of a partition's heaps above which finished heaps are passed on.
HEAP_ROWS = 1_000_000


def _best(rows: pd.DataFrame, group: list[str], order: list[str], asc: list[bool], n: int) -> pd.DataFrame:
    rows = rows.sort_values(group + order, ascending=[True] * len(group) + asc, na_position="last", kind="stable")
    rows = rows.drop_duplicates(group + order)
    return rows[rows.groupby(group, sort=False, dropna=False).cumcount() < n]


def _heaps(batches: Iterable[pa.RecordBatch], group: list[str], order: list[str], asc: list[bool], n: int, grouped: bool) -> Iterator[pa.RecordBatch]:
    """Heaps of one partition. ``grouped``: its rows are sorted by group, so all but the last are complete."""
    held: list[pa.RecordBatch] = []
    schema, rows, heap = None, 0, None

    def reduce() -> pd.DataFrame:
        new = pa.Table.from_batches(held).to_pandas()
        held.clear()
        return _best(new if heap is None else pd.concat([heap, new], ignore_index=True), group, order, asc, n)

    def out(d: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        yield from pa.Table.from_pandas(d, schema=schema, preserve_index=False).to_batches(max_chunksize=10_000)

    for batch in batches:
        schema = batch.schema
        held.append(batch)
        rows += batch.num_rows
        if rows < BUFFER_ROWS:
            continue
        heap, rows = reduce(), 0
        if len(heap) > HEAP_ROWS:
            if grouped:
                last = (heap[group] == heap[group].iloc[-1]) | (heap[group].isna() & heap[group].iloc[-1].isna())
                last = last.all(axis=1)
                yield from out(heap[~last])
                heap = heap[last]
            else:
                yield from out(heap)
                heap = None
    if held:
        heap = reduce()
    if heap is not None and len(heap):
        yield from out(heap)


def bounded_heaps(df: DataFrame, group: Sequence[str], order: Sequence[tuple[str, bool]], n: int) -> DataFrame:
    """At most the ``n`` best rows of each group and partition; no shuffle. Equal order keys are one row."""
    by, keys, asc = list(group), [c for c, _ in order], [a for _, a in order]
    return df.mapInArrow(lambda batches: _heaps(batches, by, keys, asc, n, False), df.schema)


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[tuple[str, bool]], n: int, rank: str = "rank") -> DataFrame:
    """The ``n`` best rows of every group with their rank from 1.

    ``order`` has (column, ascending) pairs; the last ones should be unique in the group, for rows
    equal in all of them count as one delivered twice. Nulls and NaN sort last in either direction,
    a null group is a group of its own, an empty table gives no rows, and columns not named here
    stay as they are. ``n`` must be positive.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    if rank in df.columns:
        raise ValueError(f"the table already has a column {rank}; name the rank otherwise")
    by, keys, asc = list(group), [c for c, _ in order], [a for _, a in order]
    merged = (
        bounded_heaps(df, group, order, n)
        .repartition(*by)
        .sortWithinPartitions(*by)
        .mapInArrow(lambda batches: _heaps(batches, by, keys, asc, n, True), df.schema)
    )

    def ranked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of a group come one behind the other, best first
        carry, count = None, 0
        for batch in batches:
            d = pa.Table.from_batches([batch]).to_pandas()
            k = d.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
            first = [None if pd.isna(v) else v for v in d[by].iloc[0]] if len(d) else None
            pos = d.groupby(by, sort=False, dropna=False).cumcount().to_numpy() + 1
            if first is not None and first == carry:
                pos[k == k[0]] += count
            if len(d):
                carry = [None if pd.isna(v) else v for v in d[by].iloc[-1]]
                count = int(pos[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pos, pa.int32())], names=[*batch.schema.names, rank])

    return merged.mapInArrow(ranked, df.withColumn(rank, F.lit(0).cast("int")).schema)


def retrieved_entries(answers: DataFrame) -> DataFrame:
    """(answer, place, chunk, score) of every place that has both a chunk and a usable score."""
    return (
        answers.where("antwort_id is not null")
        .select("antwort_id", F.posexplode(F.arrays_zip(F.col("abgerufen_id").alias("c"), F.col("scores").alias("s"))).alias("stelle", "e"))
        .select("antwort_id", "stelle", F.col("e.c").alias("chunk_id"), F.col("e.s").alias("score"))
        .where("chunk_id is not null and score is not null and not isnan(score)")
    )


def best_retrieved(chunks: DataFrame, answers: DataFrame, n: int = 10) -> DataFrame:
    """Per game the ``n`` best retrieved entries over all answers, ranked by score, chunk position, answer and place."""
    # A chunk that everything retrieves is cut to its own n best before the join: no hot join key is left.
    entries = bounded_heaps(retrieved_entries(answers), ["chunk_id"], [("score", False), ("antwort_id", True), ("stelle", True)], n)
    games = chunks.where("spiel_id is not null").select(F.col("id").alias("chunk_id"), "spiel_id", "pos")
    rows = entries.join(games, "chunk_id").select("spiel_id", "score", "pos", "antwort_id", "stelle")
    order = [("score", False), ("pos", True), ("antwort_id", True), ("stelle", True)]
    return top_n(rows, ["spiel_id"], order, n, rank="rang")


def p2_found(spark, sf_dir: str) -> DataFrame:
    return best_retrieved(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "antworten")).select("spiel_id", "rang", "antwort_id", "stelle")


P2_SQL = """
with a as (select antwort_id, any_value(abgerufen_id) ids, any_value(scores) sc from antworten where antwort_id is not null group by antwort_id),
e as (select antwort_id, unnest(range(0, least(len(ids), len(sc)))) st, ids, sc from a),
v as (select antwort_id, st, ids[st + 1] cid, sc[st + 1] score from e),
j as (select c.spiel_id, v.antwort_id, v.st, row_number() over (partition by c.spiel_id order by v.score desc, c.pos, v.antwort_id, v.st) r
      from v join chunks c on c.id = v.cid where v.score is not null and not isnan(v.score) and c.spiel_id is not null)
select spiel_id, cast(r as int) as rang, antwort_id, cast(st as int) as stelle from j where r <= 10
"""

QUERIES = {"p2_found": p2_found}
SQL = {"p2_found": P2_SQL}

"""A consensus verdict per question out of the verdicts of several judges.

Iteratively reweighted voting. A judge's vote for a label is weighted, for every possible true
label, with the log of how often the judge gives this label where the consensus of the *others* is
that true label, smoothed towards the average judge. Consensus and these leave-one-out accuracies
alternate until the weights stand still. Judges who always say the same or guess get no weight,
those who swap labels get a telling one.

The votes of a question are packed in one row, once. A round is one pass over these rows with the
weights of all judges, in numpy, and gives three sums per judge and label; no vote is shuffled again.
Where there are too many judges for a table that travels to the tasks, weights are joined instead.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.session import cut, table

#: The verdicts that count as votes, in the order that settles exact ties.
LABELS = ("richtig", "teilweise", "falsch")
#: Up to so many (judge, label) rows the weights travel as a broadcast table; beyond, by a join.
BROADCAST_ROWS = 300_000
SMOOTHING = 6.0
#: Rounds at most, with a warning if the weights still move by more than TOLERANCE then.
ROUNDS = 100
TOLERANCE = 1e-3


def normal_label(c):
    """A label without stray whitespace, end points and capitals."""
    return F.regexp_replace(F.lower(c), r"^[\s ]+|[\s .!]+$", "")


def votes(verdicts: DataFrame) -> DataFrame:
    """The vote that counts of every judge on every question: the latest of the three labels.

    Rows without game, question or judge, and other labels, are no votes. Of two verdicts of one
    moment the one with the larger ``urteil_id`` counts; a repeated row changes nothing.
    """
    v = verdicts.select("spiel_id", "frage_id", "pruefer", normal_label(F.col("urteil")).alias("label"), "gefaellt", "urteil_id")
    v = v.where(F.col("spiel_id").isNotNull() & F.col("frage_id").isNotNull() & F.col("pruefer").isNotNull() & F.col("label").isin(*LABELS))
    last = F.max_by("label", F.struct(F.coalesce("gefaellt", F.lit(0).cast("timestamp")).alias("g"), "urteil_id"))
    return v.groupBy("spiel_id", "frage_id", "pruefer").agg(last.alias("label"))


def _softmax(scores: list):
    top = F.greatest(*scores)
    e = [F.exp(s - top) for s in scores]
    total = e[0] + e[1] + e[2]
    return [x / total for x in e]


def _weights(sums: DataFrame) -> DataFrame:
    """(judge, label, w0..w2) out of (judge, label, c0..c2): log of the smoothed share of the label, given each truth."""
    j = Window.partitionBy("pruefer")
    every = sums.select("pruefer").distinct().select("pruefer", F.explode(F.array(*map(F.lit, LABELS))).alias("label"))
    s = every.join(sums, ["pruefer", "label"], "left").fillna(0.0)
    out = ["pruefer", "label"]
    for k, truth in enumerate(LABELS):
        base = F.when(F.col("label") == truth, 0.7).otherwise(0.15)
        share = (F.col(f"c{k}") + SMOOTHING * base) / (F.sum(f"c{k}").over(j) + SMOOTHING)
        out.append(F.log(share).alias(f"w{k}"))
    return s.select(*out)


def _left_out(weights: np.ndarray, prior: np.ndarray, vote: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Shares of the three labels for every vote by the other votes of its question; ``size`` are the votes of each question."""
    w = weights[vote]
    total = np.add.reduceat(w, np.cumsum(size) - size, axis=0) if len(w) else np.zeros((0, 3))
    rest = np.repeat(total, size, axis=0) - w + prior
    e = np.exp(rest - rest.max(axis=1, keepdims=True)) if len(w) else rest
    return e / e.sum(axis=1, keepdims=True)


class Packed:
    """Votes as one row a question, for as many judges as can travel to the tasks."""

    def __init__(self, v: DataFrame, judges: list[str], prior: list[float]):
        self.judges, self.prior = sorted(judges), np.array(prior)
        shared = v.sparkSession.sparkContext.broadcast({x: i for i, x in enumerate(self.judges)})

        def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = shared.value
            for b in batches:
                d = b.to_pydict()
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([number[j] * 3 + LABELS.index(x) for j, x in zip(d["pruefer"], d["label"])], pa.int32())], names=["spiel_id", "frage_id", "vote"])

        coded = v.select("spiel_id", "frage_id", "pruefer", "label").mapInArrow(code, "spiel_id string, frage_id int, vote int")
        # a question has one vote of a judge at most, so its row is bounded by the judges
        self.rows = cut(coded.groupBy("spiel_id", "frage_id").agg(F.sort_array(F.collect_list("vote")).alias("votes")))
        first = np.full((3, 3), 0.15) + np.eye(3) * 0.55
        self.weights = np.tile(np.log(first), (len(self.judges), 1))

    def sums(self, own: bool = False) -> np.ndarray:
        """Per judge and label the shares of each truth by the others' votes; with ``own`` those of the label itself and the votes."""
        weights, prior, n = self.weights, self.prior, 3 * len(self.judges)
        shared = self.rows.sparkSession.sparkContext.broadcast(weights)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n, 3))
            for b in batches:
                votes = b.column(0)
                size = np.diff(votes.offsets.to_numpy()).astype(np.int64)
                vote = votes.flatten().to_numpy().astype(np.int64)
                p = _left_out(shared.value, prior, vote, size)
                if own:
                    p = np.column_stack([p[np.arange(len(vote)), vote % 3], np.ones(len(vote)), np.zeros(len(vote))])
                for k in range(3):
                    total[:, k] += np.bincount(vote, p[:, k], n)
            some = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *(pa.array(total[some, k]) for k in range(3))], names=["i", "c0", "c1", "c2"])

        out = np.zeros((n, 3))
        t = self.rows.select("votes").mapInArrow(run, "i bigint, c0 double, c1 double, c2 double").groupBy("i").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(3)])
        for r in t.collect():  # three rows a judge, below BROADCAST_ROWS
            out[r["i"]] = r["c0"], r["c1"], r["c2"]
        shared.unpersist()
        return out

    def round(self) -> float:
        """New weights out of the others' consensus; how far the farthest moved."""
        c = self.sums()
        base = np.tile(np.eye(3) * 0.55 + 0.15, (len(self.judges), 1))
        judge = np.repeat(c.reshape(-1, 3, 3).sum(axis=1), 3, axis=0)
        new = np.log((c + SMOOTHING * base) / (judge + SMOOTHING))
        moved = float(np.abs(new - self.weights).max()) if len(new) else 0.0
        self.weights = new
        return moved

    def soft(self) -> DataFrame:
        """(spiel_id, frage_id, stimmen, p0, p1, p2) of every question with a vote."""
        prior = self.prior
        shared = self.rows.sparkSession.sparkContext.broadcast(self.weights)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                votes = b.column(2)
                size = np.diff(votes.offsets.to_numpy()).astype(np.int64)
                w = shared.value[votes.flatten().to_numpy().astype(np.int64)]
                total = np.add.reduceat(w, np.cumsum(size) - size, axis=0) + prior if len(w) else np.zeros((0, 3))
                e = np.exp(total - total.max(axis=1, keepdims=True)) if len(w) else total
                p = e / e.sum(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size), *(pa.array(p[:, k]) for k in range(3))], names=["spiel_id", "frage_id", "stimmen", "p0", "p1", "p2"])

        return self.rows.mapInArrow(run, "spiel_id string, frage_id int, stimmen bigint, p0 double, p1 double, p2 double")

    def reliable(self) -> DataFrame:
        """(pruefer, hit, stimmen): sums of the others' shares of what a judge said."""
        c = self.sums(own=True).reshape(-1, 3, 3).sum(axis=1)
        rows = [(j, float(x[0]), int(x[1])) for j, x in zip(self.judges, c)]
        return self.rows.sparkSession.createDataFrame(rows, "pruefer string, hit double, stimmen bigint")


class Joined:
    """The same for any number of judges: weights are a table that every round joins to the votes."""

    def __init__(self, v: DataFrame, prior: list[float]):
        self.v, self.prior = cut(v.repartition("spiel_id", "frage_id")), prior
        self.names = [f"w{k}" for k in range(3)]
        self.weights: DataFrame | None = None

    def weighted(self) -> DataFrame:
        if self.weights is None:
            first = [F.when(F.col("label") == x, math.log(0.7)).otherwise(math.log(0.15)).alias(n) for n, x in zip(self.names, LABELS)]
            return self.v.select("spiel_id", "frage_id", "pruefer", "label", *first)
        return self.v.join(self.weights, ["pruefer", "label"]).select("spiel_id", "frage_id", "pruefer", "label", *self.names)

    def left_out(self) -> DataFrame:
        q = Window.partitionBy("spiel_id", "frage_id")
        p = self.weighted().select("pruefer", "label", *[(F.sum(n).over(q) - F.col(n) + x).alias(f"r{k}") for k, (n, x) in enumerate(zip(self.names, self.prior))])
        return p.select("pruefer", "label", *[s.alias(f"p{k}") for k, s in enumerate(_softmax([F.col(f"r{k}") for k in range(3)]))])

    def round(self) -> float:
        new = cut(_weights(self.left_out().groupBy("pruefer", "label").agg(*[F.sum(f"p{k}").alias(f"c{k}") for k in range(3)])))
        moved = math.inf
        if self.weights is not None:
            old = self.weights.select("pruefer", "label", *[F.col(n).alias(f"o{n}") for n in self.names])
            moved = new.join(old, ["pruefer", "label"]).agg(F.max(F.greatest(*[F.abs(F.col(n) - F.col(f"o{n}")) for n in self.names]))).first()[0] or 0.0
        self.weights = new
        return moved

    def soft(self) -> DataFrame:
        t = self.weighted().groupBy("spiel_id", "frage_id").agg(*[(F.sum(n) + x).alias(n) for n, x in zip(self.names, self.prior)], F.count(F.lit(1)).alias("stimmen"))
        return t.select("spiel_id", "frage_id", "stimmen", *[s.alias(f"p{k}") for k, s in enumerate(_softmax([F.col(n) for n in self.names]))])

    def reliable(self) -> DataFrame:
        hit = F.when(F.col("label") == LABELS[0], F.col("p0")).when(F.col("label") == LABELS[1], F.col("p1")).otherwise(F.col("p2"))
        return self.left_out().groupBy("pruefer").agg(F.sum(hit).alias("hit"), F.count(F.lit(1)).alias("stimmen"))


def consensus(verdicts: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(questions, judges) of a table of verdicts.

    questions: ``spiel_id, frage_id, urteil, sicherheit, stimmen``, one row for every question with
    a non-null game, those without a single vote by the commonest verdict (``stimmen`` 0,
    ``sicherheit`` null). judges: ``pruefer, verlaesslichkeit, stimmen``, the leave-one-out smoothed
    accuracy. Ties take the first of ``LABELS``. An empty table gives two empty tables.
    """
    v = votes(verdicts)
    counts = {r["label"]: r["count"] for r in v.groupBy("label").count().collect()}  # at most three rows
    every = sum(counts.values())
    prior = [math.log((counts.get(x, 0) + 1) / (every + 3)) for x in LABELS]
    judges = [r["pruefer"] for r in v.select("pruefer").distinct().limit(broadcast_rows // 3 + 1).collect()]
    state = Packed(v, judges, prior) if len(judges) * 3 <= broadcast_rows else Joined(v, prior)
    moved = math.inf
    for _ in range(rounds if every else 0):
        moved = state.round()
        if moved < tolerance:
            break
    if every and moved >= tolerance:
        warnings.warn(f"weights still moved by {moved:.2g} after {rounds} rounds", RuntimeWarning, stacklevel=2)
    best = F.greatest("p0", "p1", "p2")
    label = F.when(F.col("p0") == best, LABELS[0]).when(F.col("p1") == best, LABELS[1]).otherwise(LABELS[2])
    found = state.soft().select("spiel_id", "frage_id", label.alias("urteil"), best.alias("sicherheit"), "stimmen")
    asked = verdicts.where("spiel_id is not null").select("spiel_id", "frage_id").distinct()
    common = max(LABELS, key=lambda x: (counts.get(x, 0), -LABELS.index(x)))
    a, f = asked.alias("a"), found.alias("f")
    same = F.col("a.spiel_id").eqNullSafe(F.col("f.spiel_id")) & F.col("a.frage_id").eqNullSafe(F.col("f.frage_id"))
    questions = a.join(f, same, "left").select(
        "a.spiel_id", "a.frage_id", F.coalesce("f.urteil", F.lit(common)).alias("urteil"), "f.sicherheit", F.coalesce("f.stimmen", F.lit(0)).alias("stimmen")
    )
    reliability = (F.col("hit") + 0.5 * SMOOTHING) / (F.col("stimmen") + SMOOTHING)
    return questions, state.reliable().select("pruefer", reliability.alias("verlaesslichkeit"), "stimmen")


def agreement(verdicts: DataFrame) -> DataFrame:
    """Krippendorff's alpha of the votes (nominal, missing ratings allowed), over questions with two votes or more.

    One row ``fragen, stimmen, uebereinstimmung, zufall, alpha``; ``alpha`` is null where nothing can
    disagree by chance (no such question, or one label only).
    """
    per = votes(verdicts).groupBy("spiel_id", "frage_id").agg(*[F.count_if(F.col("label") == x).cast("double").alias(f"n{k}") for k, x in enumerate(LABELS)])
    n = F.col("n0") + F.col("n1") + F.col("n2")
    pairs = sum((F.col(f"n{k}") * (F.col(f"n{k}") - 1) for k in range(3)), F.lit(0.0))
    t = per.where(n >= 2).agg(
        F.count(F.lit(1)).alias("fragen"), F.sum(n).alias("stimmen"), F.sum(pairs / (n - 1)).alias("o"), *[F.sum(f"n{k}").alias(f"t{k}") for k in range(3)]
    )
    chance = sum((F.col(f"t{k}") * (F.col(f"t{k}") - 1) for k in range(3)), F.lit(0.0))
    t = t.select("fragen", F.coalesce("stimmen", F.lit(0.0)).cast("long").alias("stimmen"), F.try_divide("o", "stimmen").alias("uebereinstimmung"), F.try_divide(chance, F.col("stimmen") * (F.col("stimmen") - 1)).alias("zufall"))
    return t.withColumn("alpha", F.try_divide(F.col("uebereinstimmung") - F.col("zufall"), 1 - F.col("zufall")))


def p3_found(spark, sf_dir: str) -> DataFrame:
    return consensus(table(spark, sf_dir, "urteile"))[0].select("spiel_id", "frage_id", "urteil")


def p3_reliability(spark, sf_dir: str) -> DataFrame:
    return consensus(table(spark, sf_dir, "urteile"))[1].select("pruefer", F.round("verlaesslichkeit", 4).alias("verlaesslichkeit"), "stimmen")


def p3_agreement(spark, sf_dir: str) -> DataFrame:
    return agreement(table(spark, sf_dir, "urteile")).select("fragen", "stimmen", *[F.round(c, 6).alias(c) for c in ("uebereinstimmung", "zufall", "alpha")])


AGREEMENT_SQL = r"""
with v as (select spiel_id, frage_id, pruefer, gefaellt, urteil_id, regexp_replace(lower(urteil), '^[\s\x{00a0}]+|[\s\x{00a0}.!]+$', '', 'g') l from urteile),
w as (select spiel_id, frage_id, pruefer, arg_max(l, (coalesce(gefaellt, timestamp '1970-01-01'), urteil_id)) l from v
      where spiel_id is not null and frage_id is not null and pruefer is not null and l in ('richtig', 'teilweise', 'falsch') group by all),
q as (select spiel_id, frage_id, count(*) n, count(*) filter (l = 'richtig') a, count(*) filter (l = 'teilweise') b, count(*) filter (l = 'falsch') c from w group by all having count(*) >= 2),
t as (select count(*) fragen, cast(sum(n) as bigint) stimmen, sum((a * (a - 1) + b * (b - 1) + c * (c - 1)) / (n - 1)) o, cast(sum(a) as double) a, cast(sum(b) as double) b, cast(sum(c) as double) c from q),
u as (select fragen, stimmen, o / stimmen ue, (a * (a - 1) + b * (b - 1) + c * (c - 1)) / (cast(stimmen as double) * (stimmen - 1)) z from t)
select fragen, stimmen, round(ue, 6) uebereinstimmung, round(z, 6) zufall, round((ue - z) / (1 - z), 6) alpha from u
"""

QUERIES = {"p3_found": p3_found, "p3_reliability": p3_reliability, "p3_agreement": p3_agreement}
SQL = {"p3_agreement": AGREEMENT_SQL}

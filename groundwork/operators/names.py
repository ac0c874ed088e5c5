"""Names that people say or type, resolved to collections."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions.text import name_key
from groundwork.session import cut

#: Least similarity of a hit, distance below which two hits are a toss-up, and the bounds of
#: lengths and of suggestions, for catalogues of one name and of several.
HIT, CLOSE, LENGTHS, SUGGEST, SUGGEST_LENGTHS, SUGGEST_ALONE = 0.8, 0.05, 0.8, 0.6, 0.7, 0.5


def catalogue(collections: DataFrame, name: str, aliases: str) -> DataFrame:
    """(name, form) of every spelling that is not blank, in its key form."""
    c = collections.select(F.col(name).alias("name"), F.explode(F.array_append(F.coalesce(aliases, F.array().cast("array<string>")), F.col(name))).alias("f"))
    return c.select("name", name_key(F.col("f")).alias("form")).where("form <> ''").distinct()


#: Spellings that are held at once, least and most requests of a group, and groups between the two (each gets all spellings).
FORMS, LEAST_ASKED, MOST_ASKED, GROUPS = 20_000, 64, 2_000, 256


class Spellings:
    """Spellings by length, with their letters by place: ``columns[j]`` has letter j of those from ``first[j]`` on, the ones that have it."""

    def __init__(self, forms: list[str]):
        self.forms = sorted(forms, key=len)
        self.lengths = np.array([len(f) for f in self.forms], np.int64)
        signs, codes = np.unique(np.frombuffer("".join(self.forms).encode("utf-32-le"), np.uint32), return_inverse=True)
        self.number = {chr(s): i for i, s in enumerate(signs.tolist())}
        starts = np.cumsum(self.lengths) - self.lengths
        self.first = np.searchsorted(self.lengths, np.arange(self.lengths[-1] if forms else 0), "right")
        self.columns = [codes[starts[i:] + j] for j, i in enumerate(self.first.tolist())]

    def common(self, n: str, lo: int, hi: int) -> np.ndarray:
        """Length of the longest common subsequence of ``n`` and each of the spellings from ``lo`` to before ``hi``.

        A bit for each letter of ``n``, set as long as the letter is not in the subsequence; Python's integers where 64 are too few.
        """
        kind = np.uint64 if len(n) <= 64 else object
        full = (1 << len(n)) - 1
        at = dict.fromkeys(self.number, 0)
        for i, sign in enumerate(n):
            if sign in at:
                at[sign] |= 1 << i
        bits = np.array(list(at.values()), kind)
        v = np.full(hi - lo, full, kind)
        for first, column in zip(self.first.tolist(), self.columns):
            s = max(lo, first)
            if s >= hi:
                break
            w = v[s - lo :]
            u = w & bits[column[s - first : hi - first]]
            v[s - lo :] = ((w + u) | (w - u)) & full
        free = np.bitwise_count(v) if kind is np.uint64 else np.array([x.bit_count() for x in v])
        return len(n) - free.astype(np.int64)

    def alike(self, n: str, least: float, lengths: float, close: float | None) -> Iterator[tuple[str, float]]:
        """The spellings whose Ratcliff/Obershelp ratio to ``n`` is ``least`` or more and whose lengths differ no more than by ``lengths``.

        Those that are ``close`` or further behind the best may be missing. Matching blocks lie in order in both
        texts, so the longest common subsequence bounds the ratio; only what the bound lets through is compared.
        """
        short = np.minimum(self.lengths, len(n))
        band = np.flatnonzero((2.0 * short / (self.lengths + len(n)) >= least) & (short / np.maximum(self.lengths, len(n)) >= lengths))
        if not len(band):
            return
        lo, hi = band[0], band[-1] + 1
        bound = 2.0 * self.common(n, lo, hi) / (self.lengths[lo:hi] + len(n))
        best = least
        for i in np.argsort(-bound, kind="stable"):
            if bound[i] < least or (close is not None and best - bound[i] >= close):
                return
            r = difflib.SequenceMatcher(None, n, self.forms[lo + i], autojunk=False).ratio()
            if r >= least:
                best = max(best, r)
                yield self.forms[lo + i], r


def alike(asked: DataFrame, forms: DataFrame, least: float, lengths: float, close: float | None = None, block: int = FORMS) -> DataFrame:
    """(n, form, r) of every ``n`` asked and every spelling that ``Spellings.alike`` gives for it.

    Both sides are distinct. They are a grid of groups of requests and blocks of spellings, so no task holds a whole catalogue.
    """
    some, many = asked.count(), forms.count()
    groups, blocks = -(-some // min(MOST_ASKED, max(LEAST_ASKED, -(-some // GROUPS)))) or 1, -(-many // block) or 1
    tasks = min(groups * blocks, 2000)

    def at(c: str, k: int):
        return F.pmod(F.xxhash64(c), F.lit(k)).cast("int")

    def every(k: int):
        return F.explode(F.sequence(F.lit(0), F.lit(k - 1)))

    # a given number of partitions is kept; by their few bytes all groups would be put into one task
    left = asked.select("n", at("n", groups).alias("g")).select("n", "g", every(blocks).alias("b")).repartition(tasks, "g", "b")
    right = forms.select("form", at("form", blocks).alias("b")).select("form", "b", every(groups).alias("g")).repartition(tasks, "g", "b")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            held = Spellings(right["form"].to_pylist())
            for n in left["n"].to_pylist():
                for form, r in held.alike(n, least, lengths, close):
                    for column, x in zip(rows, (n, form, r)):
                        column.append(x)
        return pa.table([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.float64())], ["n", "form", "r"])

    return left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(run, "n string, form string, r double")


def resolved(asked: DataFrame, names: DataFrame, key: str = "anfrage") -> DataFrame:
    """(anfrage, art, namen): ``treffer`` with one name, or ``unbekannt`` with the names that may be meant.

    ``names`` is a ``catalogue``. An exact spelling of one name is a hit, of several is none. Otherwise the
    most similar spelling counts from ``HIT`` on unless another name comes within ``CLOSE`` of it; with
    several names in the catalogue only spellings of about the same length do. Names that may be meant are
    looked for where nothing is a hit only.
    """
    several = names.select("name").distinct().limit(2).count() > 1
    a = asked.select(key).distinct().withColumn("n", name_key(F.col(key)))
    exact = a.where("n <> ''").join(names, a["n"] == names["form"]).groupBy(key).agg(F.sort_array(F.collect_set("name")).alias("genau"))
    open_ = cut(a.where("n <> ''").join(exact, key, "left_anti").select("n").distinct())
    forms = cut(names.select("form").distinct())
    hits = cut(alike(open_, forms, HIT, LENGTHS if several else 0.0, CLOSE))
    rest = alike(open_.join(hits, "n", "left_anti"), forms, SUGGEST if several else SUGGEST_ALONE, SUGGEST_LENGTHS if several else 0.0)
    near = hits.withColumn("hit", F.lit(True)).unionByName(rest.withColumn("hit", F.lit(False))).join(names, "form")
    best = near.groupBy("n", "hit", "name").agg(F.max("r").alias("r")).withColumn("top", F.max("r").over(Window.partitionBy("n")))
    named = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("o"), F.col("name").alias("x")))), lambda s: s["x"])
    fuzzy = best.where(~F.col("hit") | (F.col("top") - F.col("r") < CLOSE)).groupBy("n", "hit").agg(named.alias("unscharf"))
    j = a.join(exact, key, "left").join(fuzzy, "n", "left")
    none = F.array().cast("array<string>")
    art = F.when((F.size("genau") == 1) | (F.col("genau").isNull() & F.col("hit") & (F.size("unscharf") == 1)), "treffer").otherwise("unbekannt")
    return j.select(key, art.alias("art"), F.coalesce("genau", "unscharf", none).alias("namen"))


def shared_names(collections: DataFrame, collection: str, name: str) -> DataFrame:
    """(schluessel, spiele): name keys that several collections show; empty if all is well."""
    k = collections.select(collection, name_key(F.col(name)).alias("schluessel")).where("schluessel <> ''")
    return k.groupBy("schluessel").agg(F.sort_array(F.collect_set(collection)).alias("spiele")).where(F.size("spiele") > 1)

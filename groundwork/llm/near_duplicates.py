"""Groups of near-duplicate texts by an exact prefix join on shingle sets.

A text is the set of its distinct runs of three words; texts with the same set are one representative
from the start, so copies cost nothing. Two sets are joined at a Jaccard similarity of 0.5.

Candidates. All elements have one order, the rare ones first. Sets of n and m elements that are joined
share at least ``a = ceil((n + m) / 3)``, so their first common element is at most the ``n - a``-th of
the one and the ``m - a``-th of the other (from 0). Each set posts every element that can be this one:
about its rarest half. How common an element is, is estimated from a sample of texts; the order only
decides the cost, any order finds every pair.

A pair of postings must fit both places, both sizes and the sketches. A sketch holds for each of 256 to
2048 classes of elements whether the set has an odd number of them; as many classes differ at most as
elements do, so it rejects no joined pair. Every other candidate is verified on the full sets. The join
misses nothing but for collisions of 64-bit hashes (32 bits in the verification of one pair).

Postings travel in packets, one for each batch of texts and bucket of elements, so a text's sketch goes
once to a bucket. A list of more than ``LONG`` postings is first compared with one centre only; what is
found is closed to groups, and members still in different groups are compared afterwards. So a list of
any length that belongs to one group costs one comparison a member.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.arrow import groups
from groundwork.session import cut, table

WORDS, RUN, SIMILARITY = 20, 3, 0.5
#: Texts whose elements are counted for the order (about so many), and texts a bucket of elements.
SAMPLE, BUCKET = 50_000, 50_000
#: Longer lists are compared in two passes.
LONG = 1000
#: Copies that are left out by a broadcast; a join beyond.
BROADCAST_ROWS = 500_000
#: Classes of the largest sketch, and pairs compared at once.
CLASSES, PAIRS = 2048, 1_000_000

WORD = re.compile(r"[^\W_]+", re.UNICODE)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(texts: list[str | None], least_words: int = WORDS, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, first place) of the distinct word runs of each text, sorted by row and hash; short texts have none."""
    seen: dict[str, int] = {}
    hashes, lengths = [], []
    for t in texts:
        w = WORD.findall(t.lower()) if t else []
        if len(w) < max(least_words, run):
            w = []
        for x in w:
            h = seen.get(x)
            if h is None:
                h = seen[x] = xxhash.xxh3_64_intdigest(x)
            hashes.append(h)
        lengths.append(len(w))
    n = np.array(lengths, np.int64)
    h = np.array(hashes, np.uint64)
    row = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    whole = place <= np.repeat(n, n) - run
    with np.errstate(over="ignore"):
        mix = np.zeros(max(len(h) - run + 1, 0), np.uint64)
        for k in range(run):
            mix = _mixed(mix * np.uint64(31) + h[k : len(h) - run + 1 + k])
    whole = whole[: len(mix)]
    row, place, mix = row[: len(mix)][whole], place[: len(mix)][whole], mix[whole]
    order = np.lexsort((place, mix, row))
    row, place, mix = row[order], place[order], mix[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (mix[1:] != mix[:-1])
    return row[new], mix[new], place[new]


def common_elements(df: DataFrame, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, count) of the elements that several texts of a sample have, sorted by hash; ``texts`` is their number.

    The sample is of fixed size, so the table fits the driver and every task at any size.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = np.unique(shingles(batch.column(0).to_pylist())[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], names=["h", "n"])

    some = df.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_003)) < F.lit(1_000_003.0 * SAMPLE / max(texts, 1)))
    c = some.select("text").mapInArrow(run, "h bigint, n int").groupBy("h").agg(F.sum("n").cast("int").alias("n")).where("n > 1").toArrow()
    h = c.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], c.column("n").to_numpy()[order]


def least_common(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Elements that sets of n and m elements share at least if they are joined."""
    return np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9).astype(np.int64)


def sketch_words(size: np.ndarray) -> np.ndarray:
    """64-bit words of the sketches of sets of these sizes; sizes of joined sets give one doubling at most at 0.5."""
    return np.where(size <= 128, 4, np.where(size <= 256, 8, np.where(size <= 512, 16, CLASSES // 64)))


def sketches(row: np.ndarray, mix: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of all sketches, where each row's begin)."""
    width = sketch_words(size)
    start = np.concatenate([[0], np.cumsum(width)])
    at = start[row] * 64 + ((mix >> np.uint64(20)) % (width[row] * 64).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=start[-1] * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64), start


#: Columns of a packet, each a packed array: per text, per posting, per word of a sketch.
PACKET = {"ids": np.int64, "sizes": np.int32, "counts": np.int32, "keys": np.uint32, "places": np.int32, "bits": np.uint64}


def postings(df: DataFrame, known: tuple[np.ndarray, np.ndarray], buckets: int, similarity: float) -> DataFrame:
    """(bucket, packet columns) of the elements that each text posts, out of (id, text)."""
    shared = df.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            row, mix, _ = shingles(batch.column(1).to_pylist())
            if not len(row):
                continue
            size = np.bincount(row, minlength=len(ids))
            bits, begin = sketches(row, mix, size)
            width = sketch_words(size)
            count = np.zeros(len(mix), np.int32)
            if len(often):
                k = np.minimum(np.searchsorted(often, mix), len(often) - 1)
                count = np.where(often[k] == mix, times[k], 0)
            order = np.lexsort((mix, count, row))
            row, mix = row[order], mix[order]
            place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
            # the least that any partner shares is a part of this set
            post = place <= size[row] - np.ceil(similarity * size[row] - 1e-9)
            row, mix, place = row[post], mix[post], place[post]
            bucket = ((mix >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((row, bucket))
            row, mix, place, bucket = row[order], mix[order], place[order], bucket[order]
            out: dict[str, list] = {"bucket": [], **{c: [] for c in PACKET}}
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[b], cuts[b + 1])
                some, counts = np.unique(row[part], return_counts=True)
                w = width[some]
                flat = np.repeat(begin[some] - (np.cumsum(w) - w), w) + np.arange(w.sum())
                for name, x in zip(PACKET, (ids[some], size[some], counts, mix[part] & np.uint64(0xFFFFFFFF), place[part], bits[flat])):
                    out[name].append(x.astype(PACKET[name]).tobytes())
                out["bucket"].append(int(b))
            yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), *(pa.array(out[c], pa.binary()) for c in PACKET)], names=list(out))

    return df.mapInArrow(run, "bucket int, " + ", ".join(f"{c} binary" for c in PACKET))


class Sets:
    """Sizes and sketches of the sets of one bucket or list."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, bits: np.ndarray):
        self.ids, self.size, self.bits = ids, sizes.astype(np.int64), bits
        self.width = sketch_words(self.size)
        self.begin = np.cumsum(self.width) - self.width

    def sketch(self, s: np.ndarray, width: int) -> np.ndarray:
        """Sketches of some sets in as many words; larger ones are folded."""
        out = self.bits[self.begin[s][:, None] + np.arange(width)]
        for fold in range(1, CLASSES // 64 // width):
            more = np.flatnonzero(self.width[s] > fold * width)
            if not len(more):
                break
            out[more] ^= self.bits[self.begin[s[more]][:, None] + fold * width + np.arange(width)]
        return out

    def fit(self, x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
        """Which sets x and y can be joined with a first common element at places i and j."""
        n, m = self.size[x], self.size[y]
        least = least_common(n, m, similarity)
        fine = np.flatnonzero((self.ids[x] != self.ids[y]) & (i <= n - least) & (j <= m - least))
        x, y, differ = x[fine], y[fine], (n + m - 2 * least)[fine]
        width = np.minimum(self.width[x], self.width[y])
        keep = np.zeros(len(fine), bool)
        for w in (4, 8, 16, CLASSES // 64):
            p = np.flatnonzero(width == w)
            keep[p] = np.bitwise_count(self.sketch(x[p], w) ^ self.sketch(y[p], w)).sum(axis=1, dtype=np.int64) <= differ[p]
        return fine[keep]


def paired(sets: Sets, of: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> Iterator[np.ndarray]:
    """Pairs of sets, as one number each, of the postings a and b that fit each other."""
    for s in range(0, len(a), PAIRS):
        x, y = of[a[s : s + PAIRS]], of[b[s : s + PAIRS]]
        k = sets.fit(x, place[a[s : s + PAIRS]], y, place[b[s : s + PAIRS]], similarity)
        if len(k):
            yield np.minimum(x[k], y[k]) * len(sets.ids) + np.maximum(x[k], y[k])


def matches(sets: Sets, of: np.ndarray, place: np.ndarray, skip: np.ndarray, end: np.ndarray, similarity: float) -> Iterator[np.ndarray]:
    """Pairs of sets of each posting with those from ``skip`` on up to ``end``."""
    left = np.flatnonzero(skip < end)
    nxt, end = skip[left], end[left]
    while len(left):
        yield from paired(sets, of, place, left, nxt, similarity)
        nxt = nxt + 1
        more = nxt < end
        left, nxt, end = left[more], nxt[more], end[more]


def _distinct(sets: Sets, found: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The ids (a, b) of the distinct pairs; repeats are dropped as they come."""
    held: list[np.ndarray] = []
    rows, least = 0, PAIRS
    for f in found:
        held.append(f)
        rows += len(f)
        if rows > least:
            held = [np.unique(np.concatenate(held))]
            rows = len(held[0])
            least = max(PAIRS, 2 * rows)
    p = np.unique(np.concatenate(held)) if held else np.empty(0, np.int64)
    x, y = sets.ids[p // len(sets.ids)], sets.ids[p % len(sets.ids)]
    return np.minimum(x, y), np.maximum(x, y)


LISTED = "a bigint, b bigint, list bigint, size int, place int, bits binary"


def _listed(a, b=None, lists=None, size=None, place=None, bits=None) -> pa.RecordBatch:
    n = len(a)
    cols = [(b, pa.int64()), (lists, pa.int64()), (size, pa.int32()), (place, pa.int32()), (bits, pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), *(pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in cols)], names=["a", "b", "list", "size", "place", "bits"])


def candidates(packets: DataFrame, similarity: float, long: int = LONG) -> DataFrame:
    """Pairs (a, b) that can be joined, and with no ``b`` the postings of long lists, of which only the centre's pairs are given."""

    def one(bucket: int, rows: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        c = {k: np.frombuffer(b"".join(v), PACKET[k]) for k, v in rows.items()}
        sets = Sets(c["ids"], c["sizes"], c["bits"])
        of = np.repeat(np.arange(len(sets.ids)), c["counts"])
        order = np.lexsort((sets.ids[of], c["keys"]))
        of, key, place = of[order], c["keys"][order], c["places"][order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        length = np.diff(np.append(start, len(key)))
        end = np.repeat(start + length, length)
        much = np.repeat(length > long, length)
        first = np.arange(len(key)) == np.repeat(start, length)
        rest = np.flatnonzero(much & ~first)
        every = matches(sets, of, place, np.arange(len(key)) + 1, np.where(much, 0, end), similarity)
        a, b = _distinct(sets, chain(every, paired(sets, of, place, np.repeat(start, length)[rest], rest, similarity)))
        for s in range(0, len(a), 100_000):
            yield _listed(a[s : s + 100_000], b[s : s + 100_000])
        for s in range(0, len(rest), 10_000):
            p = rest[s : s + 10_000]
            w = [sets.bits[sets.begin[x] : sets.begin[x] + sets.width[x]].tobytes() for x in of[p]]
            yield _listed(sets.ids[of[p]], None, (bucket << 32) + key[p].astype(np.int64), sets.size[of[p]], place[p], w)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["bucket"]):
            yield from one(t.column("bucket")[0].as_py(), {k: t.column(k).to_pylist() for k in PACKET})

    return packets.sortWithinPartitions("bucket").mapInArrow(run, LISTED)


def between_groups(lists: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of long lists that can be joined and are in different groups, out of (list, a, size, place, bits, root)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["list"]):
            c = {k: t.column(k).to_numpy() for k in ("a", "size", "place", "root")}
            sets = Sets(c["a"], c["size"], np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64))
            of = np.argsort(c["root"], kind="stable")
            skip = np.searchsorted(c["root"][of], c["root"][of], side="right")
            a, b = _distinct(sets, matches(sets, of, c["place"][of], skip, np.full(len(of), len(of)), similarity))
            for s in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[s : s + 100_000]), pa.array(b[s : s + 100_000])], names=["a", "b"])

    return lists.repartition("list").sortWithinPartitions("list").mapInArrow(run, "a bigint, b bigint")


def named(df: DataFrame) -> DataFrame:
    """(id, h1, h2, n): name and size of each text's set, out of (id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, mix, _ = shingles(batch.column(1).to_pylist())
            size = np.bincount(row, minlength=batch.num_rows)
            some = np.flatnonzero(size)
            if not len(some):
                continue
            first = (np.cumsum(size) - size)[some]
            with np.errstate(over="ignore"):
                h1 = np.add.reduceat(mix, first)
                h2 = np.bitwise_xor.reduceat(_mixed(mix + np.uint64(1)), first)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[some]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(size[some], pa.int32())], names=["id", "h1", "h2", "n"])

    return df.mapInArrow(run, "id bigint, h1 bigint, h2 bigint, n int")


def full_sets(df: DataFrame) -> DataFrame:
    """(id, set): the hashes of each text's word runs (32 bits of them), out of (id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, mix, _ = shingles(batch.column(1).to_pylist())
            count = np.bincount(row, minlength=batch.num_rows)
            offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array((mix >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["id", "set"])

    return df.mapInArrow(run, "id bigint, set array<int>")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The distinct pairs (a, b) whose sets reach the similarity, compared on the full sets; ``texts`` has (id, text)."""
    d = cut(pairs.distinct())
    some = d.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = full_sets(texts.join(some, "id", "left_semi").dropDuplicates(["id"]))
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return d.join(left, "a").join(right, "b").where(both >= similarity * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root): the least id of each node's component, for all nodes with an edge.

    Large-star and small-star rounds in turn; each is two shuffles of the edges, which are cut to the
    checkpoint folder, and their number grows with the logarithm of the longest chain.
    """
    if rounds < 1:
        raise ValueError("at least one round")
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        # stable when every node points at one root and no root points anywhere
        moved = new.select("u").groupBy("u").count().where("count > 1").limit(1).count() or new.join(new.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        e = new
        if not moved:
            break
    else:
        raise RuntimeError(f"components are not closed after {rounds} rounds")
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("root"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)


def near_duplicate_groups(df: DataFrame, id: str = "id", text: str = "text", similarity: float = SIMILARITY, long: int = LONG) -> DataFrame:
    """(id, root, links): the group of every text that has a near duplicate; ``root`` is a group's name.

    ``links`` counts the verified links of the text's representative (0 where it only has copies).
    Null, empty and short texts are in no group; an empty table gives no rows; a repeated id is one
    text. Other columns of ``df`` are not used.
    """
    texts = df.select(F.col(id).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    # the least id of each set is found by an aggregate that combines before the shuffle; the copies of one text are many at times
    sets = cut(named(texts).distinct())
    first = sets.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"))
    member = cut(sets.join(first, ["h1", "h2", "n"]).select("id", "rep"))
    copies = member.where("id <> rep").select("id")
    if copies.count() <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
    reps = texts.join(copies, "id", "left_anti")
    number = member.count()
    spark = df.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-number // BUCKET))
    packets = postings(reps, common_elements(reps, number), buckets, similarity).repartition(buckets, "bucket")
    found = cut(candidates(packets, similarity, long))
    links = cut(verified(found.where("b is not null").select("a", "b"), texts, similarity))
    lists = found.where("b is null")
    if lists.limit(1).count():
        # what a long list still has in different groups
        group = components(links).withColumnRenamed("id", "a")
        rest = lists.join(group, "a", "left").select("list", "a", "size", "place", "bits", F.coalesce("root", "a").alias("root"))
        links = links.unionByName(cut(verified(between_groups(rest, similarity), texts, similarity)))
    closed = components(links)
    degree = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    m = member.join(closed.select(F.col("id").alias("rep"), "root"), "rep", "left").join(degree, "rep", "left")
    m = m.select("id", F.coalesce("root", "rep").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    alone = m.groupBy("root").count().where("count > 1").select("root")
    return m.join(alone, "root", "left_semi").select("id", "root", "links")


def p6_groups(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "chunks"))


def p6_found(spark, sf_dir: str) -> DataFrame:
    g = near_duplicate_groups(table(spark, sf_dir, "chunks")).select("id", "root")
    a, b = g.alias("a"), g.alias("b")
    return a.join(b, (F.col("a.root") == F.col("b.root")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))


P6_SQL = r"""
with recursive w as (select id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: true) w from chunks where text is not null),
s as (select id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) s from w where len(w) >= 20),
e as (select id, unnest(s) t from s),
o as (select a.id a, b.id b, count(*) n from e a join e b on a.t = b.t and a.id < b.id group by 1, 2),
l as (select a, b from o join s x on x.id = a join s y on y.id = b where n >= 0.5 * (len(x.s) + len(y.s) - n)),
d as (select a, b from l union select b, a from l),
r(id, m) as (select a, a from d union select d.b, r.m from r join d on d.a = r.id where r.m < d.b),
g as (select id, min(m) m from r group by id)
select x.id id_a, y.id id_b from g x join g y on x.m = y.m and x.id < y.id
"""

GROUPS_SQL = r"""
with recursive w as (select id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: true) w from chunks where text is not null),
s as (select id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) s from w where len(w) >= 20),
k as (select id, s, min(id) over (partition by list_sort(s)) rep from s), x as (select id, s from k where id = rep),
e as (select id, unnest(s) t from x),
o as (select a.id a, b.id b, count(*) n from e a join e b on a.t = b.t and a.id < b.id group by 1, 2),
l as (select a, b from o join x p on p.id = a join x q on q.id = b where n >= 0.5 * (len(p.s) + len(q.s) - n)),
d as (select a, b from l union select b, a from l),
r(id, m) as (select a, a from d union select d.b, r.m from r join d on d.a = r.id where r.m < d.b),
g as (select id, min(m) m from r group by id), n as (select a id, count(*) n from d group by 1),
z as (select k.id, coalesce(g.m, k.rep) root, coalesce(n.n, 0) links from k left join g on g.id = k.rep left join n on n.id = k.rep)
select id, root, links from z where root in (select root from z group by 1 having count(*) > 1)
"""

QUERIES = {"p6_found": p6_found, "p6_groups": p6_groups}
SQL = {"p6_found": P6_SQL, "p6_groups": GROUPS_SQL}

"""The k most similar vectors of every vector, within its game, by randomly rotated one-bit codes.

A task has the vectors to search divided in cells of about ``CELL`` (spherical k-means on ``SAMPLE``
vectors a cell, at most ``CELLS``). Of each vector the residual to its cell's mean is rotated by a fixed
random rotation and kept as 32 sign bits with three correction scalars. The inner products of a query
with all codes are sums of four table entries, one for each byte of packed bits; together with the
scalars they estimate the cosine, and the scalars also give the error bound of the estimate.

Queries of neighbouring cells come together, and search the cells nearest to most of them first. Of up
to ``COLUMNS`` vectors in the first ``PROBES`` cells those with the best estimates are compared exactly;
what they reach is a bound that real neighbours pass. Of all vectors only those are reranked exactly, in
double precision, whose estimate plus its error reaches the bound, and whole cells are left out whose
centre and radius show that they cannot. The bound rises with what is found, so queries far from the
first cells don't let everything through. What is lost is only what lies outside ``EPSILON`` deviations
of its estimate.

Games over ``WHOLE`` vectors are a grid of blocks of queries (about ``BLOCK``, at most ``BLOCKS`` a
game) and parts of up to ``PART`` vectors to search; a task has one block and one part. Where a game has
several parts, the best of each part are ranked again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.llm.arrow import groups
from groundwork.session import cut, table

DIM = 32
K = 5
#: Cosines closer than this count as tied.
TIE = 1e-6
WHOLE, CELL, CELLS, SAMPLE, PROBES, BLOCK = 4096, 512, 4096, 48, 24, 4096
#: Width of the error bound in standard deviations of the estimate.
EPSILON = 3.0
QUERY_ROWS = 256
#: Best estimates that are compared exactly first.
FIRST = 64
#: Cells whose queries come together, nearest cells by which a query says where to look first, and vectors of a cell looked at at once.
TOGETHER, VOTES, TILE = 16, 4, 1024
#: Vectors that a task searches, blocks of queries a game, and vectors compared exactly at once with one run of queries.
PART, BLOCKS, COLUMNS = 262_144, 64, 4096
#: Rounding of single-precision estimates, with a margin.
ROUNDING = 2e-6


@cache
def rotation(dim: int) -> np.ndarray:
    """The fixed random rotation of all codes."""
    q, r = np.linalg.qr(np.random.default_rng(20240229).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(df: DataFrame, vector: str = "emb", dim: int = DIM) -> DataFrame:
    """Rows with ``dim`` finite components that are not all zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(v.isNotNull() & (F.size(v) == dim) & fine)


def _unit(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(x[a : a + 8192] @ c.T, axis=1) for a in range(0, len(x), 8192)] or [np.empty(0, int)])


def _centres(x: np.ndarray, cell: int, cells: int) -> np.ndarray:
    """Centres of about ``len(x) / cell`` cells by spherical k-means on a sample."""
    k = int(min(max(1, round(len(x) / cell)), cells))
    x = x[np.random.default_rng(7).permutation(len(x))[: SAMPLE * k]]
    c = x[:k]
    for _ in range(4 if k > 1 else 1):
        total = np.zeros_like(c)
        np.add.at(total, _nearest(x, c), x)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-9)[:, None], c)
    return c


def _raised(top: np.ndarray, i: np.ndarray, cos: np.ndarray) -> np.ndarray:
    """The best values of every row of ``top``, its least first, after some more: ``cos`` in rows ``i``."""
    k = top.shape[1]
    better = cos > top[i, 0]
    i, cos = i[better], cos[better]
    order = np.lexsort((-cos, i))
    i, cos = i[order], cos[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    new = np.full_like(top, -2.0)
    new[i[rank < k], rank[rank < k]] = cos[rank < k]
    return np.sort(np.concatenate([top, new], axis=1), axis=1)[:, k:]


class Codes:
    """Packed sign bits of vectors in cells, and the scalars that make estimates of inner products from them."""

    #: Signs of the eight bits of every byte.
    SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1).T

    def __init__(self, x: np.ndarray, at: np.ndarray, cells: int, epsilon: float):
        dim, self.kept = x.shape[1], {}
        self.turn = rotation(dim)
        count = np.maximum(np.bincount(at, minlength=cells), 1)
        mean = np.zeros((cells, dim))
        np.add.at(mean, at, x)
        self.mean, self.at = mean / count[:, None], at
        res = x - self.mean[at]
        norm = np.linalg.norm(res, axis=1)
        y = (res / np.maximum(norm, 1e-12)[:, None]) @ self.turn
        packed = np.packbits(y > 0, axis=1)
        self.codes = np.ascontiguousarray(packed.T).astype(np.intp)
        fit = np.maximum(np.abs(y).sum(axis=1) / np.sqrt(dim), 1e-6)
        # not 0, for a vector that is its cell's mean: it divides below
        self.scale = np.maximum(norm / fit / np.sqrt(dim), 1e-9).astype(np.float32)
        wide = norm * np.sqrt(np.maximum(1 - fit**2, 0)) / fit * epsilon / np.sqrt(dim - 1)
        # what the mean of the own cell adds to an estimate
        of = np.zeros(len(x), np.float32)
        table = self.tables(self.mean)
        for byte, code in enumerate(self.codes):
            of += table[byte, code, at]
        self.base = (np.einsum("nd,nd->n", self.mean[at], res) - self.scale * of).astype(np.float32)
        self.factors = (np.stack([np.ones(len(x)), -self.base, -wide], axis=1) / self.scale[:, None]).astype(np.float32)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Sums of each byte's possible signs with the rotated vectors: (byte, 256, vector)."""
        turned = (q @ self.turn).astype(np.float32).reshape(len(q), -1, 8)
        return np.ascontiguousarray(np.matmul(turned.transpose(1, 0, 2), self.SIGNS).transpose(0, 2, 1))

    def estimates(self, table: np.ndarray, to_mean: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Estimates of the cosines of some vectors with queries, given by their tables: (vector, query)."""
        est = table[0][self.codes[0, cols]]
        for byte in range(1, len(self.codes)):
            est += table[byte][self.codes[byte, cols]]
        est *= self.scale[cols][:, None]
        est += self.base[cols][:, None]
        est += to_mean[self.at[cols]]
        return est

    def reaching(self, table: np.ndarray, to_mean: np.ndarray, away: np.ndarray, least: np.ndarray, start: int, end: int) -> np.ndarray:
        """Which of the vectors from ``start`` to ``end``, all of one cell, may reach ``least`` of some query by the upper end of their error.

        What the sum of table entries must be for that is a product of three factors a vector and three a query.
        """
        need, total, entry = (self.room(n, (end - start, len(least))) for n in ("need", "total", "entry"))
        asked = np.empty((3, len(least)), np.float32)
        np.subtract(least, to_mean, out=asked[0])
        asked[1], asked[2] = 1, away
        np.matmul(self.factors[start:end], asked, out=need)
        table[0].take(self.codes[0, start:end], axis=0, out=total, mode="clip")
        for byte in range(1, len(self.codes)):
            total += table[byte].take(self.codes[byte, start:end], axis=0, out=entry, mode="clip")
        return start + np.flatnonzero(np.greater_equal(total, need, out=self.room("reaching", need.shape, bool)).any(axis=1))

    def room(self, name: str, shape: tuple[int, int], kind: type = np.float32) -> np.ndarray:
        """An array with any content that is kept for its name: fresh memory costs more than the sums made in it."""
        flat, n = self.kept.get(name), shape[0] * shape[1]
        if flat is None or len(flat) < n:
            flat = self.kept[name] = np.empty(n, kind)
        return flat[:n].reshape(shape)


def search_cells(
    ids: np.ndarray, x: np.ndarray, ask: np.ndarray, base: np.ndarray, k: int = K, tie: float = TIE, cell: int = CELL, cells: int = CELLS, probes: int = PROBES, epsilon: float = EPSILON
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, neighbour id, cosine) for the rows marked ``ask``, among the rows marked ``base`` (unit vectors), all ties included."""
    q, b = np.flatnonzero(ask), np.flatnonzero(base)
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if not len(q) or not len(b):
        return none
    c = _centres(x[b], cell, cells)
    at = _nearest(x[b], c)
    order = np.argsort(at, kind="stable")
    b, at = b[order], at[order]
    first = np.searchsorted(at, np.arange(len(c) + 1))
    full = np.flatnonzero(np.diff(first))
    radius = np.zeros(len(c))
    radius[full] = np.arccos(np.clip(np.minimum.reduceat(np.einsum("nd,nd->n", x[b], c[at]), first[full]), -1, 1))
    codes = Codes(x[b], at, len(c), epsilon)
    size = np.einsum("nd,nd->n", codes.mean, codes.mean)
    own = _nearest(x[q], c)
    # queries of cells that lie together come together: most cells are then left out for all of them
    q = q[np.lexsort((own, _nearest(c, _centres(c, TOGETHER, cells))[own]) if len(c) > TOGETHER else (own,))]
    single = x[b].astype(np.float32)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(q), QUERY_ROWS):
        rows = q[a : a + QUERY_ROWS]
        asked = x[rows].astype(np.float32)
        table = codes.tables(x[rows])
        exact = x[rows] @ codes.mean.T
        away = np.ascontiguousarray(np.sqrt(np.maximum(1 - 2 * exact + size, 0)).astype(np.float32).T)
        to_mean = np.ascontiguousarray(exact.astype(np.float32).T) + np.float32(ROUNDING)
        to = np.clip(c @ x[rows].T, -1, 1)

        # cells that are among the nearest of most queries come first
        votes = np.bincount(np.argpartition(-to[full], min(VOTES, len(full)) - 1, axis=0)[:VOTES].ravel(), minlength=len(full))
        scan = full[np.lexsort((-to[full].max(axis=1), -votes))]
        near = scan[:probes]
        near = near[: max(1, np.searchsorted(np.cumsum(first[near + 1] - first[near]), COLUMNS))]
        cols = np.concatenate([np.arange(first[n], first[n + 1]) for n in near])[:COLUMNS]
        # the k-th of a few that look best, exactly: no real neighbour is below it; one more, for the query itself may be among them
        m = min(FIRST, len(cols))
        best = cols[np.argpartition(np.ascontiguousarray(codes.estimates(table, to_mean, cols).T), len(cols) - m, axis=1)[:, len(cols) - m :]]
        cos = np.einsum("qmd,qd->qm", x[b[best]], x[rows])
        cos[b[best] == rows[:, None]] = -2
        bound = np.partition(cos, m - k, axis=1)[:, m - k] if m >= k else np.full(len(rows), -2.0)

        def passing(cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(query, vector, cosine) of the vectors that reach the bound of some query; a query is none of its own neighbours."""
            # in single precision first, so that double precision has little left
            shape = len(cols), len(rows)
            cos = np.matmul(single[cols], asked.T, out=codes.room("cosines", shape))
            reach = np.greater_equal(cos, (bound - tie - ROUNDING).astype(np.float32), out=codes.room("passing", shape, bool))
            some = np.flatnonzero(reach.any(axis=1))
            j, i = np.nonzero(reach[some])
            j = b[cols[some[j]]]
            other = rows[i] != j
            i, j = i[other], j[other]
            cos = np.einsum("nd,nd->n", x[rows[i]], x[j])
            keep = cos >= bound[i] - tie
            return i[keep], j[keep], cos[keep]

        # the largest cosine that a vector of the cell can have with the query
        most = np.cos(np.maximum(np.arccos(to) - radius[:, None] - 1e-7, 0))
        tiles = [(n, s, min(s + TILE, first[n + 1])) for n in scan for s in range(first[n], first[n + 1], TILE)]
        top = np.full((len(rows), k), -2.0)
        least = (bound - tie).astype(np.float32)
        hits, held, count = [], [], 0
        for turn, (n, s, e) in enumerate(tiles, 1):
            if (most[n] >= bound - tie).any():
                held.append(codes.reaching(table, to_mean[n], away[n], least, s, e))
                count += len(held[-1])
            if count >= COLUMNS or (count and turn == len(tiles)):
                hits.append(passing(np.concatenate(held)))
                held, count = [], 0
                # the k best so far are a bound, too
                top = _raised(top, *hits[-1][::2])
                bound = np.maximum(bound, top[:, 0])
                least = (bound - tie).astype(np.float32)
        if not hits:
            continue
        i, j, cos = (np.concatenate(h) for h in zip(*hits))
        if not len(i):
            continue
        order = np.lexsort((-cos, i))
        i, j, cos = i[order], j[order], cos[order]
        start = np.searchsorted(i, np.arange(len(rows)))
        count = np.bincount(i, minlength=len(rows))
        least = np.where(count >= k, cos[np.minimum(start + k - 1, len(cos) - 1)], -2.0)
        keep = cos >= least[i] - tie
        found.append((ids[rows[i[keep]]], ids[j[keep]], cos[keep]))
    return tuple(np.concatenate(f) for f in zip(*found)) if found else none


def nearest(
    df: DataFrame, k: int = K, whole: int = WHOLE, cell: int = CELL, cells: int = CELLS, probes: int = PROBES, block: int = BLOCK, epsilon: float = EPSILON, part: int = PART
) -> DataFrame:
    """(id, mate) of every vector and its ``k`` most similar ones in the same game, all ties included.

    ``df`` has ``id, spiel_id, emb`` (other columns are not used). Unusable vectors and rows without
    id or game neither ask nor answer; repeated ids are one vector; a game of up to ``k`` others gives
    all of them. Exact but for the error bound of the codes.
    """
    v = usable(df.select("id", "spiel_id", "emb").where("id is not null and spiel_id is not null"))
    size = v.groupBy("spiel_id").agg(F.count(F.lit(1)).alias("n"))
    large = cut(size.where(F.col("n") > whole))
    grid = large.select("spiel_id", F.least(F.lit(BLOCKS), F.ceil(F.col("n") / block)).cast("int").alias("blocks"), F.ceil(F.col("n") / part).cast("int").alias("parts"))
    big = v.join(F.broadcast(grid), "spiel_id")
    small = v.join(F.broadcast(large), "spiel_id", "left_anti")
    big = big.withColumn("b", F.pmod(F.xxhash64("id", F.lit(11)), F.col("blocks")).cast("int")).withColumn("p", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int"))
    # once to every block of its part, and to its own block of the other parts
    blocks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.col("p").alias("part"), x.alias("block")))
    parts = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(x.alias("part"), F.col("b").alias("block")))
    copies = big.select("spiel_id", "id", "emb", "b", "p", F.explode(F.array_union(blocks, parts)).alias("t"))
    copies = copies.select("spiel_id", F.col("t.part").alias("part"), F.col("t.block").alias("block"), "id", "emb", (F.col("b") == F.col("t.block")).alias("ask"), (F.col("p") == F.col("t.part")).alias("base"))
    alone = small.select("spiel_id", F.lit(-1).alias("part"), F.lit(0).alias("block"), "id", "emb", F.lit(True).alias("ask"), F.lit(True).alias("base"))
    keys = ["spiel_id", "part", "block"]
    work = copies.unionByName(alone).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, keys):
            ids = t.column("id").to_numpy()
            ids, first = np.unique(ids, return_index=True)
            if len(ids) < 2:
                continue
            x = _unit(t.column("emb"), DIM)[first]
            ask, base = (t.column(n).to_numpy(zero_copy_only=False)[first].astype(bool) for n in ("ask", "base"))
            a, b, cos = search_cells(ids, x, ask, base, k=k, cell=cell, cells=cells, probes=probes, epsilon=epsilon)
            game = t.column("spiel_id")[0].as_py()
            for s in range(0, len(a), 100_000):
                n = len(a[s : s + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array([game] * n, pa.string()), pa.array(a[s : s + 100_000]), pa.array(b[s : s + 100_000]), pa.array(cos[s : s + 100_000])], names=["spiel_id", "id", "mate", "cos"])

    found = work.mapInArrow(run, "spiel_id string, id bigint, mate bigint, cos double")
    many = [r["spiel_id"] for r in grid.where("parts > 1").select("spiel_id").collect()]
    if not many:
        return found.select("id", "mate")
    found = cut(found)
    whole_games = ~F.col("spiel_id").isin(many)
    ranked = found.where(~whole_games).withColumn("r", F.row_number().over(Window.partitionBy("spiel_id", "id").orderBy(F.desc("cos"))))
    least = F.coalesce(F.max(F.when(F.col("r") == k, F.col("cos"))).over(Window.partitionBy("spiel_id", "id")), F.lit(-2.0))
    ranked = ranked.withColumn("least", least).where(F.col("cos") >= F.col("least") - TIE)
    return found.where(whole_games).select("id", "mate").unionByName(ranked.select("id", "mate"))


def p5_found(spark, sf_dir: str) -> DataFrame:
    pairs = nearest(table(spark, sf_dir, "chunks"))
    return pairs.select(F.least("id", "mate").alias("id_a"), F.greatest("id", "mate").alias("id_b")).distinct()


P5_SQL = """
with v as (select id, spiel_id, list_transform(emb, lambda x: x::double) e from chunks where spiel_id is not null and len(emb) = 32
   and len(list_filter(emb, lambda x: x is null or isnan(x))) = 0 and len(list_filter(emb, lambda x: x <> 0)) > 0),
p as (select a.id, b.id mate, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) c
   from v a join v b on a.spiel_id = b.spiel_id and a.id <> b.id),
r as (select *, nth_value(c, 5) over (partition by id order by c desc rows between unbounded preceding and unbounded following) fifth from p)
select distinct least(id, mate) id_a, greatest(id, mate) id_b from r where c >= coalesce(fifth, -2) - 0.000001
"""

QUERIES = {"p5_found": p5_found}
SQL = {"p5_found": P5_SQL}

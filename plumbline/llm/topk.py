"""Exact top-k search by inner product over a pivot-distance index.

Vectors become integers.  With one more component, sqrt(M^2 - |x|^2), all lie at distance M
from the origin; a query's is zero, so the largest inner products with it are its nearest
vectors.  The index keys each vector by its nearest pivot and its distance to it; there are
about as many pivots as the root of the number of vectors, up to a limit.  Each pivot's vectors
fall into rings of distance, cut into blocks.  The triangle inequality bounds the best score in
a ring.  A query reads rings in order of their bounds, a growing number in each round, and
stops as soon as no ring left can reach its k-th best score.  Queries meet rings in groups: a query goes once
to a group of rings, with a bit for each ring that it reads, so what is sent are some thousands of queries and
some ten thousand vectors at a time, and no task holds more.  Pivots are fitted on a bounded
sample; every vector is in the index and the result is exact.

How much is skipped depends on the vectors: among random directions in many dimensions all
pivots are nearly equally far from everything, and the bounds exclude almost nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.llm.common import partitions, small_batches, table, written

SCALE = 1024
#: Pivots at most, rings of each, vectors in the sample they are fitted on, vectors of a block, queries of a
#: pack, and how many times more rings each round reads.
PIVOTS, RINGS, SAMPLE, BLOCK, PACK, GROWTH = 1024, 8, 8192, 2048, 256, 16
#: Vectors of a group of rings and queries that a group meets at a time, about and at most.
GROUP, DEAL = 32768, 16384


def integers(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v array<long>, row: floor(1024 * x) of each component, and a number of the row; rows whose
    id or vector is null or that hold a null or non-finite component are left out.  Written in the
    shared folder, so that a row keeps its number."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    ok = F.col(id_col).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(False))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return written(df.where(ok).select(F.col(id_col).alias("vec_id"), v.alias("v"), F.monotonically_increasing_id().alias("row")), "vectors")


def _matrix(vectors, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors are filled with zeros, which change no product."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _asked(q: np.ndarray) -> np.ndarray:
    """Queries among lifted vectors."""
    return np.concatenate([q.astype(float), np.zeros((len(q), 1))], axis=1)


def _lifted(x: np.ndarray, norm2: float) -> np.ndarray:
    f = x.astype(float)
    return np.concatenate([f, np.sqrt(np.maximum(norm2 - (f**2).sum(axis=1, keepdims=True), 0))], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0))


def few(vectors: DataFrame, total: int) -> DataFrame:
    """About 1.25 * SAMPLE of the rows, those of least hash.  Each task sends its least ones to the driver, so their
    number must be bounded in all tasks together."""
    share = 1.25 * SAMPLE / max(total, 1)
    return vectors.where(F.xxhash64("vec_id", "row") < int(2.0**64 * share) - 2**63) if share < 1 else vectors


class Index:
    """Pivots and ring limits; at most PIVOTS and RINGS of each, whatever the number of vectors."""

    def __init__(self, vectors: DataFrame, seed: int = 7):
        norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        row = vectors.agg(F.max(F.size("v")), F.max(norm), F.count(F.lit(1))).first()
        self.width, self.norm2, self.total = int(row[0] or 0), float(row[1] or 0.0), row[2]
        if self.norm2 >= 2.0**63:
            raise ValueError("scores of these vectors don't fit 64 bits: the longest one's with itself is beyond 2**63")
        some = few(vectors, self.total).orderBy(F.xxhash64("vec_id", "row"), "row").limit(SAMPLE).toPandas()
        s = _lifted(_matrix(some["v"], self.width), self.norm2)
        rng = np.random.default_rng(seed)
        pivots = s[rng.permutation(len(s))[: min(PIVOTS, max(16, math.isqrt(self.total)))]]
        for _ in range(6 if len(s) else 0):
            near = _distances(s, pivots).argmin(1)
            n = np.bincount(near, minlength=len(pivots))
            sums = np.zeros_like(pivots)
            np.add.at(sums, near, s)
            pivots = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], pivots)
        self.pivots = pivots
        d = _distances(s, pivots)
        near = d.argmin(1) if len(s) else np.zeros(0, np.int64)
        self.cuts = np.stack([np.quantile(d[near == i, i], np.arange(1, RINGS) / RINGS) if (near == i).any() else np.zeros(RINGS - 1) for i in range(len(pivots))]) if len(s) else np.zeros((0, RINGS - 1))
        #: Distances are floating point; bounds give way by this much.
        self.slack = 1e-6 * (1 + np.sqrt(self.norm2))

    def cell(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell number (pivot and ring) and distance to the pivot."""
        d = _distances(_lifted(x, self.norm2), self.pivots)
        near = d.argmin(1)
        dist = d[np.arange(len(x)), near]
        ring = np.array([np.searchsorted(self.cuts[p], t, side="right") for p, t in zip(near, dist)], np.int64)
        return near * RINGS + ring, dist


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products, as doubles where these hold them."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    return q.astype(float) @ x.T.astype(float) if most < 2**53 else q @ x.T


def _best(queries, ids, rows, scores, k: int) -> pd.DataFrame:
    """The k best rows of each query: highest score, then smallest id, then row."""
    o = np.lexsort((rows, ids, -scores, queries))
    queries, ids, rows, scores = queries[o], ids[o], rows[o], scores[o]
    first = np.maximum.accumulate(np.where(np.concatenate([[True], queries[1:] != queries[:-1]]), np.arange(len(o)), 0)) if len(o) else o
    keep = np.arange(len(o)) - first < k
    return pd.DataFrame({"query_row": queries[keep], "vec_id": ids[keep], "row": rows[keep], "score": scores[keep]})


class Rings:
    """The index's rings with their ranges of distance and numbers of vectors: at most PIVOTS * RINGS.  Neighbours by
    number are in one group."""

    def __init__(self, index: Index, cells: pd.DataFrame, tasks: int):
        self.index = index
        cells = cells.sort_values("cell")
        self.cells, self.n = cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.int64)
        self.lo, self.hi = cells["lo"].to_numpy(float), cells["hi"].to_numpy(float)
        each = min(GROUP, max(BLOCK, index.total // (4 * tasks)))
        starts = np.unique((np.cumsum(self.n) - self.n) // each, return_index=True)[1]
        #: First rings of the groups, the group of each ring, and over how many tasks the blocks of a crowded ring,
        #: and so of its group, are dealt.
        self.starts = np.append(starts, len(self.n))
        self.group = np.repeat(np.arange(len(starts)), np.diff(self.starts))
        self.salts = np.maximum(1, self.n // GROUP)
        self.group_salts = np.maximum.reduceat(self.salts, starts)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """What no score of a query (row) in a ring (column) exceeds."""
        asked = _asked(q)
        d = _distances(asked, self.index.pivots)[:, self.cells // RINGS]
        gap = np.maximum(np.maximum(self.lo[None] - d, d - self.hi[None]) - self.index.slack, 0)
        # dist^2 = |q|^2 + M^2 - 2 q.x, and dist is the gap at least.
        return ((asked**2).sum(1)[:, None] + self.index.norm2 - gap**2) / 2 * (1 + 1e-9) + 1

    def wanted(self, q: np.ndarray, beat: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Which rings each query reads: those of place start to stop in the order of its bounds that may
        hold a score of ``beat`` or more."""
        bound = self.bounds(q)
        place = np.empty(bound.shape, np.int64)
        np.put_along_axis(place, np.argsort(-bound, axis=1, kind="stable"), np.arange(bound.shape[1])[None], axis=1)
        return (place >= start) & (place < stop) & (bound >= beat[:, None])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, read: list | None = None) -> DataFrame:
    """query_id, rank, vec_id, score, query_row: each query's k vectors of highest inner product, other
    than its own row; all if there are fewer; ties to the smaller vec_id.

    ``vectors`` comes from ``integers`` and ``queries`` are rows of it, whole.  Rows that repeat a vec_id
    are rows of their own, as queries (told apart by query_row) and as results.  Vectors of unequal
    length multiply over the shorter one.  Vectors so long that a score could leave 64 bits are an error, since no
    product may wrap.  Empty tables give no rows.  ``read`` gets the number of
    vectors that each round compares, summed over queries.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    index = Index(vectors)
    n = partitions(spark)
    if not len(index.pivots):
        zero = F.lit(0).cast("long")
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", zero.alias("score"), zero.alias("query_row")).where("false")
    shared = spark.sparkContext.broadcast(index)

    def place(batches):
        ix = shared.value
        for b in batches:
            if len(b):
                x = _matrix(b["v"], ix.width)
                cell, dist = ix.cell(x)
                yield pd.DataFrame({"cell": cell.astype(np.int32), "dist": dist, "vec_id": b["vec_id"], "row": b["row"], "v": list(x)})

    keyed = written(vectors.mapInPandas(place, "cell int, dist double, vec_id long, row long, v array<long>"), "pivot-index")
    rings = Rings(index, keyed.groupBy("cell").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.count(F.lit(1)).alias("n")).toPandas(), n)
    known = spark.sparkContext.broadcast(rings)
    deals = -(-queries.count() // DEAL)

    def block(batches):
        def out(rows: pd.DataFrame) -> tuple:
            ids, numbers, at = (rows[x].to_numpy(np.int64).tobytes() for x in ("vec_id", "row", "ring"))
            return int(rows["group"].iloc[0]), int(rows["salt"].iloc[0]), ids, numbers, at, np.stack(rows["v"].to_list()).astype(np.int64).tobytes()

        names, rest = ["group", "salt", "ids", "rows", "rings", "vectors"], None
        for b in batches:
            whole = b if rest is None else pd.concat([rest, b], ignore_index=True)
            cuts = [rows.iloc[k : k + BLOCK] for _, rows in whole.groupby(["group", "salt"], sort=False) for k in range(0, len(rows), BLOCK)]
            rest = cuts.pop() if cuts else None  # goes on, perhaps
            if cuts:
                yield pd.DataFrame([out(x) for x in cuts], columns=names)
        if rest is not None:
            yield pd.DataFrame([out(rest)], columns=names)

    # A crowded ring is dealt over several tasks by salt.
    of_cell = spark.createDataFrame(list(zip(rings.cells.tolist(), range(len(rings.cells)), rings.group.tolist(), rings.salts.tolist())), "cell int, ring int, group int, salts long")
    spread = keyed.join(F.broadcast(of_cell), "cell").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int"))
    spread = spread.select("group", "salt", "ring", "vec_id", "row", "v").repartition(n, "group", "salt").sortWithinPartitions("group", "salt", "ring")
    blocks = written(spread.mapInPandas(block, "group int, salt int, ids binary, rows binary, rings binary, vectors binary"), "pivot-blocks")
    keys = ["group", "salt", "deal"]
    dealt = blocks.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(max(deals, 1) - 1)))).repartition(n, *keys)

    def ask(start: int, stop: int):
        """Packs of queries for each group of rings some of which they read in this round, with a bit for each ring."""
        names = [*keys, "pairs", "q_rows", "q_vectors", "beat", "bits"]

        def run(batches):
            rings = known.value
            for b in batches:
                every = _matrix(b["v"], rings.index.width) if len(b) else None
                for k in range(0, len(b), PACK):
                    q, beat, rows = every[k : k + PACK], b["beat"].to_numpy(float)[k : k + PACK], b["row"].to_numpy(np.int64)[k : k + PACK]
                    go = rings.wanted(q, beat, start, stop)
                    deal, out = int(rows[0] % 1000003 % max(deals, 1)), []
                    for g in np.unique(rings.group[go.any(0)]):
                        mine = slice(rings.starts[g], rings.starts[g + 1])
                        who = np.flatnonzero(go[:, mine].any(1))
                        bits = go[who, mine]
                        what = rows[who].tobytes(), q[who].tobytes(), beat[who].tobytes(), np.packbits(bits, axis=1).tobytes()
                        pairs = int((bits @ rings.n[mine]).sum())
                        out += [(int(g), salt, deal, 0 if salt else pairs, *what) for salt in range(int(rings.group_salts[g]))]
                        if len(out) >= 32:
                            yield pd.DataFrame(out, columns=names)
                            out = []
                    if out:
                        yield pd.DataFrame(out, columns=names)

        return run

    def score(key, packs, blocks):
        rings = known.value
        first, last = rings.starts[key[0]], rings.starts[key[0] + 1]
        numbers = lambda x: np.frombuffer(x, np.int64)
        held = [(numbers(i), numbers(r), numbers(c) - first, numbers(v).reshape(len(numbers(i)), rings.index.width)) for i, r, c, v in zip(*(blocks[x] for x in ("ids", "rows", "rings", "vectors")))]
        found = [_best(*[np.zeros(0, np.int64)] * 4, k)]
        for q_rows, q, beat, bits in zip(*(packs[x] for x in ("q_rows", "q_vectors", "beat", "bits"))):
            q_rows, beat = numbers(q_rows), np.frombuffer(beat, np.float64)
            q = numbers(q).reshape(len(q_rows), rings.index.width)
            reads = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(len(q_rows), -1), axis=1, count=int(last - first)).astype(bool)
            good = found[0].iloc[:0]
            for ids, rows, ring, x in held:
                some, which = np.unique(ring, return_inverse=True)
                who = np.flatnonzero(reads[:, some].any(1))
                if not len(who):
                    continue
                s = _scores(q[who], x)
                ok = s >= beat[who, None]
                ok &= reads[np.ix_(who, some)][:, which] & (q_rows[who, None] != rows[None, :])
                if len(ids) > 4 * k and ok.sum() > 4 * k * len(who):  # no more than the ties of each query's k-th best
                    masked = np.where(ok, s, -np.inf if s.dtype.kind == "f" else np.iinfo(np.int64).min)
                    ok &= s >= np.partition(masked, len(ids) - k, axis=1)[:, len(ids) - k][:, None]
                r, c = np.nonzero(ok)
                if not len(r):
                    continue
                columns = zip((good[x].to_numpy(np.int64) for x in good.columns), (q_rows[who][r], ids[c], rows[c], s[r, c].astype(np.int64)))
                good = _best(*(np.concatenate(pair) for pair in columns), k)
            found.append(good)
        return pd.concat(found, ignore_index=True)

    best = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    found, start, stop = None, 0, 1
    while start < len(rings.cells):
        asked = queries.select("row", "v", F.lit(float("-inf")).alias("beat"))
        if found is not None:  # with fewer than k so far, nothing is beaten yet
            kth = found.groupBy("query_row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
            asked = queries.join(kth, queries["row"] == kth["query_row"], "left").select("row", "v", F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf"))).alias("beat"))
        packs = written(asked.mapInPandas(ask(start, stop), "group int, salt int, deal int, pairs long, q_rows binary, q_vectors binary, beat binary, bits binary"), "packs")
        pairs = packs.agg(F.sum("pairs")).first()[0]
        if read is not None:
            read.append(pairs or 0)
        if found is not None and not pairs:
            break
        met = packs.repartition(n, *keys).groupBy(*keys).cogroup(dealt.groupBy(*keys))
        now = met.applyInPandas(score, "query_row long, vec_id long, row long, score long")
        every = now if found is None else now.unionByName(found.drop("rank"))
        found = written(every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "best")
        start, stop = stop, stop * GROWTH + 1
    names = queries.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    return found.join(names, "query_row").select("query_id", "rank", "vec_id", "score", "query_row")


def op9_topk(spark, sf_dir):
    v = integers(table(spark, sf_dir, "embeddings"))
    return top_k(v, v.where("vec_id % 100 = 0")).drop("query_row")


ORACLE = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.row AS query_row, c.vec_id, c.row, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.row <> q.row WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id, row) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

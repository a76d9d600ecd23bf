"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are grouped so that correlated bits share a partition.  With thresholds
t_1..t_m of -1 or more that sum to tau - m + 1, two fingerprints within tau differ by at
most t_i in some partition i.  Each fingerprint gets its own thresholds, by dynamic
programming on the number of candidates estimated for each partition and threshold from a
bounded sample, so crowded partition values are probed narrowly or not at all.  The probes
are the partition's values within t_i; where fingerprints meet at a value they are verified,
and a spanning forest of the links found there, never all pairs, goes on to the components.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import only, partitions, small_batches, sole, table, text_key, written
from plumbline.llm.components import components

TAU = 4
SHINGLE = 4
#: Distinct fingerprints in the sample that bit groups and candidate estimates are fitted on.
SAMPLE = 2048
#: Entries under one value that a task takes; more are dealt in blocks, and pairs of blocks to tasks.
CROWD = 1 << 16
#: Members of a value up to which all offsets are compared at once; larger ones by search.
RUN = 64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a whole text: A-Z in lower case, words, word shingles with repeats,
    XXH64 with seed 42; a bit is set if it is set in over half of the hashes."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined, size = b" ".join(words), len(words)
    digest = xxhash.xxh64_intdigest
    if size <= shingle:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, size) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, size) - 1).tolist()
    stops = (ends - 1).tolist()
    ones, n = np.zeros(64, np.int64), size - shingle + 1
    for at in range(0, n, 65536):
        part = [digest(joined[a:b], 42) for a, b in zip(starts[at : min(at + 65536, n)], stops[at + shingle - 1 :])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int((2 * ones > n).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key (``text_key``), fp (the fingerprint's 64 bits as a signed long)."""
    small_batches(docs.sparkSession)

    def run(batches):
        sole("simhash")
        for b in batches:
            fp = np.fromiter((fingerprint(t) for t in b["text"]), np.uint64, len(b))
            yield pd.DataFrame({"doc_id": b["doc_id"], "key": b["key"], "fp": fp.view(np.int64)})

    return docs.select("doc_id", text_key().alias("key"), "text").mapInPandas(run, "doc_id long, key long, fp long")


def bit_groups(sample: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits; each is grown by the bit most correlated with it."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(float)
    bits -= bits.mean(axis=0)
    norm = np.sqrt((bits**2).sum(axis=0))
    norm[norm == 0] = 1
    near = np.abs((bits / norm).T @ (bits / norm))
    left, out = list(range(64)), []
    for k in range(m):
        size = len(left) // (m - k)
        group = [left.pop(0)]
        while len(group) < size:
            group.append(left.pop(int(np.argmax(near[np.ix_(group, left)].sum(axis=0)))))
        out.append(sorted(group))
    return out


def allocate(cost: np.ndarray, tau: int) -> np.ndarray:
    """Thresholds per row by dynamic programming.  cost[q, i, t + 1]: of threshold t (from -1) in
    partition i.  The sum of t_i + 1 is tau + 1 in each row."""
    q, m, _ = cost.shape
    need = tau + 1
    best, pick = np.full((q, need + 1), np.inf), np.zeros((m, q, need + 1), np.int64)
    best[:, 0] = 0
    for i in range(m):
        now = np.full_like(best, np.inf)
        for have in range(need + 1):
            for t in range(have + 1):
                c = best[:, have - t] + cost[:, i, t]
                less = c < now[:, have]
                now[less, have] = c[less]
                pick[i, less, have] = t
        best = now
    out, have = np.zeros((q, m), np.int64), np.full(q, need)
    for i in reversed(range(m)):
        out[:, i] = pick[i, np.arange(q), have]
        have = have - out[:, i]
    return out - 1


def _packed(fps: np.ndarray, group: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(group):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


class Plan:
    """Partitions, a sample of their values, and what a probe and a candidate cost."""

    def __init__(self, sample: np.ndarray, total: int, tau: int, m: int):
        self.tau, self.groups = tau, bit_groups(sample, m)
        self.values = [_packed(sample, g) for g in self.groups]
        self.scale = max(total, 1) / max(len(sample), 1)

    def cost(self, fps: np.ndarray) -> np.ndarray:
        out = np.zeros((len(fps), len(self.groups), self.tau + 2))
        for i, (g, v) in enumerate(zip(self.groups, self.values)):
            near = np.bitwise_count(_packed(fps, g)[:, None] ^ v[None, :])
            probes = 0
            for t in range(self.tau + 1):
                probes += comb(len(g), t)
                # An even spread of values is the least that any estimate can be.
                seen = (near <= t).sum(axis=1) * self.scale
                out[:, i, t + 1] = np.maximum(seen, self.scale * len(v) * probes / 2.0 ** len(g)) + 3.0 * probes
        return out

    def thresholds(self, fps: np.ndarray) -> np.ndarray:
        return allocate(self.cost(fps), self.tau)

    def price(self, fps: np.ndarray) -> float:
        cost = self.cost(fps)
        t = allocate(cost, self.tau)
        return float(np.take_along_axis(cost, t[:, :, None] + 1, axis=2).sum())


def plan_for(fps: DataFrame, tau: int, sample: int = SAMPLE) -> Plan:
    """Fit on the ``sample`` fingerprints of least hash (a bounded number); the count is of all."""
    total = fps.count()
    some = fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    if not len(some):
        some = np.zeros(1, np.uint64)
    plans = [Plan(some, total, tau, m) for m in (2, 3, 4, 5)]
    return min(plans, key=lambda p: p.price(some[:256]))


def _masks(size: int, t: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for k in range(t + 1) for bits in combinations(range(size), k)], np.uint64)


def probes(fps: DataFrame, plan: Plan) -> DataFrame:
    """part, value, fp, node: each fingerprint under its own values and at those it probes."""

    def run(batches):
        masks = {}
        for b in batches:
            all_fps, nodes = b["fp"].to_numpy(np.int64).view(np.uint64), b["node"].to_numpy(np.int64)
            for at in range(0, len(all_fps), 2000):
                f, n = all_fps[at : at + 2000], nodes[at : at + 2000]
                ts = plan.thresholds(f)
                for i, g in enumerate(plan.groups):
                    own = _packed(f, g)
                    for t in range(-1, plan.tau + 1):
                        rows = np.flatnonzero(ts[:, i] == t)
                        if not len(rows):
                            continue
                        m = masks.setdefault((len(g), t), _masks(len(g), max(t, 0)))
                        step = max(1, 200_000 // len(m))
                        for k in range(0, len(rows), step):
                            r = rows[k : k + step]
                            v = (own[r][:, None] ^ m[None, :]).ravel()
                            yield pd.DataFrame({"part": np.int32(i), "value": v.view(np.int64), "fp": np.repeat(f[r], len(m)).view(np.int64), "node": np.repeat(n[r], len(m))})

    return fps.mapInPandas(run, "part int, value long, fp long, node long")


def _forest(fp: np.ndarray, node: np.ndarray, tau: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among these fingerprints."""
    out = []
    while len(fp) > 1:
        stack = [(fp[-1], node[-1])]
        fp, node = fp[:-1], node[:-1]
        while stack and len(fp):
            x, at = stack.pop()
            hit = np.bitwise_count(fp ^ x) <= tau
            if hit.any():
                found = node[hit]
                out.append((np.full(len(found), at), found))
                stack += zip(fp[hit], found)
                fp, node = fp[~hit], node[~hit]
    return out


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of these links, each as a star around its least node: one row for each
    other node, however many links there are."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        now, low = label.copy(), np.minimum(label[a], label[b])
        np.minimum.at(now, label[a], low)
        np.minimum.at(now, label[b], low)
        now = now[now]
        if (now == label).all():
            break
        label = now
    other = np.flatnonzero(label != np.arange(len(ids)))
    return ids[other], ids[label[other]]


def dealt(probed: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``probed`` with a group number ``deal``.  Entries of a value are one group; those of a value
    with more than ``crowd`` fall into blocks by hash, and each pair of blocks is a group, so
    every two entries still meet and no group outgrows two blocks."""
    crowded = probed.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd)
    crowded = written(crowded.select("part", "value", F.ceil(F.col("n") / crowd).cast("int").alias("g")), "crowded-values")
    if crowded.isEmpty():
        return probed.withColumn("deal", F.lit(0).cast("long"))
    light = probed.join(crowded, ["part", "value"], "left_anti").withColumn("deal", F.lit(0).cast("long"))
    heavy = probed.join(crowded, ["part", "value"]).withColumn("b", F.pmod(F.xxhash64("node", "fp"), F.col("g")))
    pair = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda o: F.least(o, F.col("b")).cast("long") * F.col("g") + F.greatest(o, F.col("b")))
    return light.unionByName(heavy.withColumn("deal", F.explode(pair)).drop("g", "b"))


def linked(probed: DataFrame, tau: int, crowd: int = CROWD) -> DataFrame:
    """u, v: stars that join what is linked under the values that a task has read."""

    def edges_of(part, value, deal, fp, node):
        change = np.flatnonzero((part[1:] != part[:-1]) | (value[1:] != value[:-1]) | (deal[1:] != deal[:-1])) + 1
        starts = np.concatenate([[0], change])
        sizes = np.diff(np.concatenate([starts, [len(part)]]))
        run = np.repeat(np.arange(len(starts)), sizes)
        out = []
        for s, n in zip(starts[sizes > RUN], sizes[sizes > RUN]):
            f, first = np.unique(fp[s : s + n], return_index=True)
            out += _forest(f, node[s : s + n][first], tau)
        keep = sizes[run] <= RUN
        run, fp, node = run[keep], fp[keep], node[keep]
        for k in range(1, min(RUN, len(run))):
            same = run[k:] == run[:-k]
            if not same.any():
                break
            hit = np.flatnonzero(same & (np.bitwise_count(fp[k:] ^ fp[:-k]) <= tau) & (node[k:] != node[:-k]))
            out.append((node[hit], node[hit + k]))
        if not out:
            return None
        u, v = stars(*(np.concatenate(x) for x in zip(*out)))
        return pd.DataFrame({"u": u, "v": v}) if len(u) else None

    def run(batches):
        held, rows = [], 0
        for b in batches:
            # A value that spans batches is held until it ends.
            held.append([b["part"].to_numpy(), b["value"].to_numpy(np.int64), b["deal"].to_numpy(np.int64), b["fp"].to_numpy(np.int64).view(np.uint64), b["node"].to_numpy(np.int64)])
            rows += len(b)
            if rows < 200_000:
                continue
            cols = [np.concatenate(x) for x in zip(*held)]
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
            cut = last[-1] + 1 if len(last) else 0
            held, rows = [[c[cut:] for c in cols]], len(cols[0]) - cut
            if cut and (out := edges_of(*[c[:cut] for c in cols])) is not None:
                yield out
        if held:
            cols = [np.concatenate(x) for x in zip(*held)]
            if len(cols[0]) and (out := edges_of(*cols)) is not None:
                yield out

    n = max(partitions(probed.sparkSession), 1)
    rows = dealt(written(probed, "probes"), crowd)
    return rows.repartition(n, "part", "value", "deal").sortWithinPartitions("part", "value", "deal").select("part", "value", "deal", "fp", "node").mapInPandas(run, "u long, v long")


def _grouped(docs: DataFrame, tau: int) -> DataFrame:
    """doc_id, key, fp, label (a fingerprint that stands for the component) of each row."""
    rows = written(fingerprints(docs), "fingerprints")
    fps = written(rows.select("fp", F.col("fp").alias("node")).distinct(), "distinct-fingerprints")
    comps = components(linked(probes(fps, plan_for(fps, tau)), tau))
    named = fps.join(comps, "node", "left").select("fp", F.coalesce("component", "node").alias("label"))
    return rows.join(written(named, "labels"), "fp")  # written, as a fingerprint may be many rows'


def near_duplicates(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of ``tau`` or fewer differing
    bits.  Null and wordless texts have fingerprint zero and link like any other.  Rows with a
    null doc_id link too; if no other id is reachable their component_id is null.  Repeated
    rows each give a row.  Further columns are ignored.
    """
    rows = _grouped(docs, tau)
    least = written(rows.groupBy("label").agg(F.min("doc_id").alias("component_id")), "components")
    return rows.join(least, "label").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_copies(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """The rows of ``docs``, whole and in all columns, that stay: of each component the smallest doc_id,
    null after all others; of rows that share it the text of least hash, and of those one."""
    rows = _grouped(docs, tau)
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best"))
    rows = rows.groupBy("label", "doc_id", "key").agg(F.count(F.lit(1)).alias("n"))
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key"))
    return only(docs, rows.join(first, "label").where(same).select("doc_id", "key", "n"))


def op8_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))

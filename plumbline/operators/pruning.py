"""Pruning of candidate pools by score and jitter, with keep-all fallbacks, and its thresholds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.text import let
from plumbline.sources.tables import fresh, materialised

#: What a threshold is that doesn't exist.
NO_THRESHOLD = 10000.0
#: Values among which ranks are looked up by sorting them in one task, at most, and 1 over a summary's error.
SMALL, ACCURACY = 1_000_000, 10_000


def high_or_all(pool: Column, least: float) -> Column:
    """Candidates whose ``score`` is at least ``least``; all of them if none is."""
    return let(F.filter(pool, lambda x: x["score"] >= least), lambda h: F.when(F.size(h) > 0, h).otherwise(pool))


def _stays(score: Column, jitter: Column, least: float, t_hi: Column, t_lo: Column) -> Column:
    over = ~F.isnan(jitter) & ~F.isnan(t_hi) & (jitter > t_hi)
    below = ~F.isnan(jitter) & ~F.isnan(t_lo) & (jitter < t_lo)
    return F.when(score >= least, ~over).otherwise(~below)


def veto_or_all(pool: Column, least: float, t_hi: Column, t_lo: Column) -> Column:
    """Drop high scorers of a jitter over t_hi and others of one below t_lo; all stay if none would.
    Nothing is over or below NaN, nor is NaN over or below anything."""

    def stays(x):
        return _stays(x["score"], x["jitter"], least, t_hi, t_lo)

    return let(F.filter(pool, stays), lambda k: F.when(F.size(k) > 0, k).otherwise(pool))


def _of_key(rows: DataFrame, key: str, flag: Column) -> DataFrame:
    """``rows`` where the flag holds, or holds for no row of the key.  Whether it does is combined map-side and joined
    back, so that no window gathers the rows of a key; ``rows`` are read twice."""
    stays, some = fresh(rows, "stays"), fresh(rows, "some")
    marked = rows.withColumn(stays, F.coalesce(flag, F.lit(False)))
    keys = marked.groupBy(F.col(key).alias(some)).agg(F.bool_or(stays).alias(stays)).where(stays).select(some)
    kept = marked.where(stays)
    rest = marked.where(~F.col(stays)).join(keys, F.col(key).eqNullSafe(F.col(some)), "left_anti")
    return kept.unionByName(rest).select(*[F.col(f"`{c}`") for c in rows.columns])


def high_or_all_long(rows: DataFrame, least: float, key: str = "question_id") -> DataFrame:
    """``high_or_all`` over long rows with ``score``."""
    return _of_key(rows, key, F.col("score") >= least)


def veto_or_all_long(rows: DataFrame, least: float, thresholds: DataFrame, key: str = "question_id") -> DataFrame:
    """``veto_or_all`` over long rows with ``score`` and ``jitter``; thresholds is one row."""
    hi, lo = fresh(rows, "t_hi"), fresh(rows, "t_lo")
    limits = thresholds.select(F.col("t_hi").alias(hi), F.col("t_lo").alias(lo))
    joined = rows.crossJoin(F.broadcast(limits))  # one row by construction
    return _of_key(joined, key, _stays(F.col("score"), F.col("jitter"), least, F.col(hi), F.col(lo))).drop(hi, lo)


def between(a: float, b: float, share: float) -> float:
    """The value a share of the way from one rank's to the next one's."""
    if a == b or share == 0:
        return a
    return a * (1 - share) + b * share if math.isinf(b - a) else a + (b - a) * share


def percentiles(values: DataFrame, column: str, points: list[float], small: int = SMALL) -> list[float | None]:
    """Exact percentiles (linear between ranks) at any size.  Nulls don't count; a NaN among the values
    makes all of them NaN; without values all are None.

    Two passes over the values, whatever the number of points.  The first makes a quantile summary, which
    executors merge, and brackets every rank by its guaranteed error.  The second writes the values within brackets
    and counts, by observation, those below each.  What is written is smaller by some orders of magnitude; as
    long as a bracket has more than ``small`` values, it is treated in the same way.
    """
    v = values.select(F.col(column).cast("double").alias("v")).where("v is not null")
    if not points:
        return []
    n, bad, summary = v.agg(F.count(F.lit(1)), F.count_if(F.isnan("v")), _summary(points)).first()
    if n == 0 or bad:
        return [float("nan") if bad else None] * len(points)
    at = [p * (n - 1) for p in points]
    ranks = sorted({k for x in at for k in (int(x), min(int(x) + 1, n - 1))})
    of = dict(zip(ranks, ranked(v, ranks, n, small, _brackets(summary))))
    return [between(of[int(x)], of[min(int(x) + 1, n - 1)], x - int(x)) for x in at]


def _summary(shares: list[float]) -> Column:
    """Values somewhat below and above each share of the ranks, by more than the summary errs."""
    near = [min(max(s + d / ACCURACY, 0.0), 1.0) for s in shares for d in (-3, 3)]
    return F.percentile_approx("v", near, F.lit(ACCURACY))


def _brackets(summary: list[float]) -> list[tuple[float, float]]:
    """Disjoint intervals, in order."""
    out: list[tuple[float, float]] = []
    for low, high in sorted(zip(summary[::2], summary[1::2])):
        if out and low <= out[-1][1]:
            low, high = out[-1][0], max(high, out.pop()[1])
        out.append((low, high))
    return out


def ranked(v: DataFrame, ranks: list[int], n: int, small: int = SMALL, brackets: list[tuple[float, float]] | None = None) -> list[float]:
    """The values of these ranks (from 0) among the n values of column v."""
    if not ranks:
        return []
    if n <= small:  # so many rows at most, in one task
        upto = v.groupBy("v").count().select("v", F.sum("count").over(W.orderBy("v")).alias("upto"))
        return list(upto.agg(*[F.min(F.when(F.col("upto") > k, F.col("v"))).alias(f"r{i}") for i, k in enumerate(ranks)]).first())
    if brackets is None:
        brackets = _brackets(v.agg(_summary([k / (n - 1) for k in ranks])).first()[0])
    edges = sorted({x for pair in brackets for x in pair})
    counts = {f"{kind}{i}": (v_below, x) for i, x in enumerate(edges) for kind, v_below in (("below", F.col("v") < x), ("upto", F.col("v") <= x))}
    seen = Observation()
    within = [(F.col("v") > low) & (F.col("v") < high) for low, high in brackets]
    some = within[0]
    for w in within[1:]:
        some = some | w
    inside = materialised(v.observe(seen, *[F.count_if(c).alias(name) for name, (c, _) in counts.items()]).where(some), "ranks")
    below, upto = ([seen.get[f"{kind}{i}"] for i in range(len(edges))] for kind in ("below", "upto"))
    found: dict[int, float] = {k: x for k in ranks for i, x in enumerate(edges) if below[i] <= k < upto[i]}
    place = {x: i for i, x in enumerate(edges)}
    for (low, high), w in zip(brackets, within):
        first, stop = upto[place[low]], below[place[high]]
        mine = [k for k in ranks if first <= k < stop]
        found |= zip(mine, ranked(inside.where(w), [k - first for k in mine], stop - first, small))
    missed = [k for k in ranks if k not in found]
    if missed:  # the summary erred by more than it says: everything between the edges is looked through
        ends = v.agg(F.min("v"), F.max("v")).first()
        found |= zip(missed, ranked(v, missed, n, small, [(ends[0], ends[1])]))
    return [found[k] for k in ranks]


def threshold_point(ratio: float, direction: str = "top") -> float | None:
    """The percentile (0 to 1) that a ratio in percent stands for; None where it isn't positive."""
    if ratio <= 0:
        return None
    ratio = min(100.0, float(ratio))
    return (100 - ratio if direction == "top" else ratio) / 100


def thresholds(values: DataFrame, column: str, v100: float, v0: float) -> DataFrame:
    """One row: t_hi above which high scorers go (the top ``v100`` percent) and t_lo below which
    others go (all but the top ``v0`` percent); 10000 where the ratio isn't positive or there are
    no values, NaN where one of them is.  Lazy, for tables whose distinct values fit one task; ``exact_thresholds``, the
    default everywhere, is for any."""

    def of(ratio: float) -> Column:
        point = threshold_point(ratio)
        found = F.when(F.count_if(F.isnan(column)) > 0, F.lit(float("nan"))).otherwise(F.percentile(column, F.lit(0.0 if point is None else point)))
        return F.lit(NO_THRESHOLD) if point is None else F.coalesce(found, F.lit(NO_THRESHOLD))

    return values.agg(of(v100).alias("t_hi"), of(v0).alias("t_lo"))


def exact_thresholds(values: DataFrame, column: str, v100: float, v0: float) -> DataFrame:
    """``thresholds`` at any size; runs jobs at once."""
    points = [threshold_point(r) for r in (v100, v0)]
    found = iter(percentiles(values, column, [p for p in points if p is not None]))
    got = [NO_THRESHOLD if p is None or (x := next(found)) is None else float(x) for p in points]
    return values.sparkSession.range(1).select(F.lit(got[0]).alias("t_hi"), F.lit(got[1]).alias("t_lo"))

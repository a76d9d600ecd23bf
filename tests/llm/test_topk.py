import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import topk
from plumbline.llm.common import table


def plain(rows, step, k=10):
    """[(query_id, rank, vec_id, score)] by brute force; each row is a query and a vector of its own."""
    ok = [(i, np.floor(np.array(v, float) * 1024).astype(np.int64)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for m, (q, a) in enumerate(ok):
        if q % step == 0:
            s = sorted((-int(a[: len(b)] @ b[: len(a)]), i) for n, (i, b) in enumerate(ok) if n != m)[:k]
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


def found(spark, rows, step, k=10, read=None):
    v = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell int, n int, row int") if rows else spark.createDataFrame([], "vec_id long, embedding array<float>"))
    return sorted(tuple(r) for r in topk.top_k(v, v.where(F.col("vec_id") % step == 0), k, read).drop("query_row").collect())


def test_against_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()]
    v = topk.integers(table(spark, sf_dir, "embeddings"))
    got = sorted(tuple(r) for r in topk.top_k(v, v.where("vec_id % 20 = 0")).drop("query_row").collect())
    assert got == plain(rows, 20)


@pytest.mark.parametrize("k", [1, 10])
def test_ties_lengths_and_bad_vectors(spark, k):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 5) / 2]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")]), (303, [float("inf"), 0.0]), (304, []), (305, [0.5, -0.5]), (400, [0.0] * 5)]
    assert found(spark, [(*r, 1, 2, 3) for r in rows], 10, k) == plain(rows, 10, k)


def test_few_and_none(spark):
    assert found(spark, [], 1) == []
    assert found(spark, [(0, [1.0], 0, 0, 0)], 1) == []
    assert found(spark, [(0, [1.0], 0, 0, 0), (1, [2.0], 0, 0, 0)], 1) == [(0, 1, 1, 2097152), (1, 1, 0, 2097152)]


def test_repeated_ids_are_rows_of_their_own(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)], 0, 0, 0) for i in (0, 0, *range(1, 21), 10, 10)]
    rows += [(0, rows[0][1], 0, 0, 0)]  # repeated in full
    assert found(spark, rows, 10) == plain([r[:2] for r in rows], 10)


def test_clustered_vectors_are_skipped(spark):
    """Far clusters are never read; random directions are, which the bounds can't exclude."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 8)) * 4
    rows = [(i, [float(x) for x in centres[i % 40] + rng.normal(size=8) * 0.02], 0, 0, 0) for i in range(4000)]
    read: list = []
    assert found(spark, rows, 50, read=read) == plain([r[:2] for r in rows], 50)
    assert sum(read) < 0.3 * 80 * 4000


def test_scores_beyond_64_bits_are_an_error(spark):
    """No product wraps: vectors are short enough for that, or refused."""
    large = [(i, [float(2**20), float(i)], 0, 0, 0) for i in range(4)]
    assert found(spark, large, 2) == plain([r[:2] for r in large], 2)
    for x in (3e9, 1e38):
        with pytest.raises(ValueError, match="64 bits"):
            found(spark, [(0, [x, 1.0], 0, 0, 0), (1, [x, 2.0], 0, 0, 0)], 1)


def test_what_comes_to_the_driver_is_bounded(spark, monkeypatch):
    """All tasks together send little more than the sample, which is that of least hash."""
    monkeypatch.setattr(topk, "SAMPLE", 100)
    rows = spark.range(20_000).repartition(16).select(F.col("id").alias("vec_id"), F.col("id").alias("row")).cache()
    order = [F.xxhash64("vec_id", "row"), "row"]
    some = topk.few(rows, 20_000)
    assert 100 <= some.count() < 200
    assert some.orderBy(*order).limit(100).collect() == rows.orderBy(*order).limit(100).collect()
    assert topk.few(rows, 100).count() == 20_000


def test_groups_crowded_rings_and_deals(spark, monkeypatch):
    """Small groups of rings, a ring that is dealt by salt, and queries that are dealt."""
    for name, n in (("GROUP", 64), ("BLOCK", 16), ("DEAL", 10)):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in ([1.0, 2.0, 0.5] if i % 3 == 0 else rng.normal(size=3))], 0, 0, 0) for i in range(900)]
    assert found(spark, rows, 9) == plain([r[:2] for r in rows], 9)
    assert found(spark, [(i, [], 0, 0, 0) for i in range(4)], 2) == plain([(i, []) for i in range(4)], 2)

"""Exact, suffix, substring and near-duplicate operators against plain versions."""

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import block_names, components, inducing, rolling, simhash, substring_dedup, suffix_dedup
from plumbline.llm.common import table
from plumbline.llm.queries import QUERIES


def rows_of(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def pairs(spark, sf_dir):
    return [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]


@pytest.mark.parametrize("name, plain", [("op1_suffix_dedup", brute.suffix_dedup), ("op2_substring_dedup", brute.substring_dedup), ("op8_simhash", brute.simhash)])
def test_queries_match_plain_versions(spark, sf_dir, name, plain):
    got = QUERIES[name](spark, sf_dir)
    assert rows_of(got) == plain(pairs(spark, sf_dir))


@pytest.mark.parametrize("crowd", [1, 3, suffix_dedup.CROWD])
def test_suffix_dedup_edges(make, odd_rows, crowd):
    out = suffix_dedup.suffix_dedup(make(odd_rows), crowd=crowd).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_text", 256))
    assert rows_of(out) == brute.suffix_dedup(odd_rows)


def test_substring_dedup_edges(make, odd_rows):
    out = substring_dedup.substring_dedup(make(odd_rows)).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256))
    assert rows_of(out) == brute.substring_dedup(odd_rows)


def test_substring_batches_agree(make, odd_rows):
    one, many = (rows_of(substring_dedup.substring_dedup(make(odd_rows), batches=n)) for n in (1, 5))
    assert one == many


def test_repeated_rows_count_once(make):
    text = " ".join(f"t{i}" for i in range(80))
    docs = make([(1, text), (1, text), (2, text)])
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup.substring_dedup(docs).collect()) == [(1, 0), (1, 0), (2, 80)]
    assert sorted((r.doc_id, r.n_removed) for r in suffix_dedup.suffix_dedup(docs).collect()) == [(1, 0), (1, 0), (2, len(text))]


def test_null_ids_and_empty_tables(make):
    text = " ".join(f"t{i}" for i in range(80))
    for f in (suffix_dedup.suffix_dedup, substring_dedup.substring_dedup, simhash.near_duplicates, block_names.exact_duplicates):
        assert f(make([])).count() == 0
        assert f(make([(None, text), (3, text), (None, None)])).count() == 3
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(make([(None, text), (3, text)])).collect()}
    assert got == {None: 0, 3: 0}


def test_simhash_edges(make, odd_rows):
    assert rows_of(simhash.near_duplicates(make(odd_rows))) == brute.simhash(odd_rows)


def test_simhash_links_all_within_distance():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near, near ^ np.uint64(5)]))
    for m in (2, 3, 4, 5):
        plan = simhash.Plan(fps[:200], len(fps), 4, m)
        t = plan.thresholds(fps)
        assert (t.sum(axis=1) == 4 - m + 1).all() and (t >= -1).all()
        d = np.bitwise_count(fps[:, None] ^ fps[None, :])
        for a, b in np.argwhere((d <= 4) & (d > 0)):
            parts = [int(np.bitwise_count(simhash._packed(fps[[a]], g) ^ simhash._packed(fps[[b]], g))[0]) for g in plan.groups]
            assert any(p <= x for p, x in zip(parts, t[a]))


@pytest.mark.parametrize("crowd", [5, 10**6])
def test_crowded_values_are_dealt_in_blocks(spark, crowd):
    rng = np.random.default_rng(4)
    base = np.uint64(0x0123456789ABCDEF)
    fps = np.unique(base ^ (np.uint64(1) << rng.integers(0, 64, 90).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 90).astype(np.uint64)))
    df = spark.createDataFrame([(int(f), i) for i, f in enumerate(fps.view(np.int64))], "fp long, node long")
    plan = simhash.Plan(fps, len(fps), 4, 4)
    got = components.components(simhash.linked(simhash.probes(df, plan), 4, crowd)).collect()
    assert {r.node for r in got} == set(range(len(fps))) and {r.component for r in got} == {0}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (3, 4), (200, 150), (150, 149)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in [*range(100, 151), 200])
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_exact(rows):
    key = lambda t: brute.SPACE.sub("", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(key(t), []).append((-len(t or ""), i))
    return {i: (min(groups[key(t)])[1], len(groups[key(t)]), min(groups[key(t)])[1] == i, brute.sha(key(t).encode())) for i, t in rows}


@pytest.mark.parametrize("size", [1, 3, 64, 4096])
def test_exact_dedup_edges(make, odd_rows, size):
    rows = [(i, t if t is None or size > 3 or len(t) < 2000 else t[:50]) for i, t in odd_rows]
    assert rows_of(block_names.exact_duplicates(make(rows), size)) == plain_exact(rows)


def test_exact_dedup_tells_orders_and_lengths_apart(make):
    rows = [(1, "aabb"), (2, "bbaa"), (3, "aa"), (4, "aabbaabb"), (5, "aabb"), (6, "aab b"), (7, "aabbaa"), (8, "aabbaabb"), (9, "bb")]
    got = rows_of(block_names.exact_duplicates(make(rows), 2))
    assert got == plain_exact(rows) and got[6][2] and not got[1][2]


def test_exact_dedup_repeated_and_null_ids(make):
    got = [tuple(r) for r in block_names.exact_duplicates(make([(1, "ab"), (1, "ab"), (1, "cd"), (None, "a b"), (None, None)]), 1).select("doc_id", "keep_id", "group_size", "kept").collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, None, 3, False), (1, None, 3, False), (1, 1, 1, True), (None, None, 3, True), (None, None, 1, True)]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=0, max_size=60), st.sampled_from([3, 100]), st.sampled_from([0, 4, 1000]), st.sampled_from([1, 1000]))
def test_induced_order_and_common_prefixes(symbols, cap, base, queued):
    text = np.array([*symbols, 0], np.int16)
    got = [(int(p), int(v)) for ps, vs in inducing.descending(text, cap, queued, base) for p, v in zip(ps, vs)]
    assert sorted(p for p, _ in got) == list(range(len(text)))
    suffix = lambda i: text[i : i + cap].tolist()
    for (a, _), (b, v) in zip(got, got[1:]):
        x, y = suffix(a), suffix(b)
        assert x >= y
        assert v == next((k for k, (s, t) in enumerate(zip(x, y)) if s != t), min(len(x), len(y)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=30, max_size=120), st.integers(2, 9))
def test_anchors_cover_every_window(values, w):
    h = rolling.mixed(np.array(values, np.uint64) + np.uint64(1))
    whole = np.ones(max(len(h) - w + 1, 0), bool)
    at = set(rolling.anchors(h, w, whole).tolist())
    for i in range(len(h) - w + 1):
        least = h[i : i + w].min()
        assert all(i + k in at for k in np.flatnonzero(h[i : i + w] == least))


def test_hashes_follow_content():
    a = np.frombuffer(b"xxhello worldyyhello world", np.uint8)
    s = rolling.prefix(rolling.byte_values(a))
    got = rolling.spans(s, np.array([2, 15]), np.array([13, 26]))
    assert got[0] == got[1] and len(set(rolling.grams(s, 11).tolist())) == 15

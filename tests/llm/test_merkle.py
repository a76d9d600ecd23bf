"""The manifest against a plain tree, its proofs, and what tampering does to them."""

import zlib
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import merkle
from plumbline.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tie string, leaf int, pid int"


def plain_h(x):
    return sha256(x.encode("utf-8", "surrogatepass")).hexdigest()


def plain_leaf(row, text):
    i, _, lang, source, n = row[:5]
    return plain_h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def plain_tree(hashes):
    """The root, and for each leaf its [(place, siblings)]."""
    at, paths = list(range(len(hashes))), [[] for _ in hashes]
    while len(hashes) > 1:
        runs = [hashes[k : k + 3] for k in range(0, len(hashes), 3)]
        for leaf, k in enumerate(at):
            run, place = runs[k // 3], k % 3
            paths[leaf].append((place, run[:place] + run[place + 1 :]))
        at, hashes = [k // 3 for k in at], [plain_h("".join(r)) for r in runs]
    return hashes[0], paths


def plain_manifest(rows):
    """Sorted (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        of = sorted(((r[0] is not None, r[0] or 0, plain_leaf(r, r[1]), r) for r in groups[s]), key=lambda x: x[:3])
        trees[s] = ([x[3] for x in of], *plain_tree([x[2] for x in of]))
    if not order:
        return []
    root, tops = plain_tree([trees[s][1] for s in order])
    out = []
    for s, top in zip(order, tops):
        of, sub, paths = trees[s]
        for r, path in zip(of, paths):
            hit = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            h = plain_leaf(r, r[1].replace("\n", "") if hit else r[1])
            for place, siblings in path + top:
                h = plain_h("".join(siblings[:place]) + h + "".join(siblings[place:]))
            out.append((r[0], plain_leaf(r, r[1]), sub, root, plain_h("".join(x for _, y in path + top for x in y)), h, h == root))
    return sorted(out, key=str)


@pytest.fixture()
def query(spark, monkeypatch):
    def f(rows):
        monkeypatch.setattr(merkle, "table", lambda *_: spark.createDataFrame(rows, SCHEMA))
        return sorted((tuple(r) for r in merkle.op11_merkle(spark, "").collect()), key=str)

    return f


def row(i, text, source="s", lang="en", n=1):
    return (i, text, lang, source, n, "t", 1, 2)


@pytest.mark.parametrize("step", [1, 2, 6])
def test_many_sources_over_many_partitions(query, monkeypatch, step):
    monkeypatch.setattr(merkle, "STEP", step)
    monkeypatch.setattr(merkle, "LEAVES", 17)
    rows = [row(i * 7919 % 1009, f"text\n{i % 50}" if i % 9 else None, [None, "", "hot", "hot", "é", "Z", f"s{i % 30}"][i % 7], None if i % 5 else "de", i % 3 or None) for i in range(500)]
    assert query(rows) == plain_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 28])
def test_small_tables(query, n):
    rows = [row(i, f"a\n{i}") for i in range(n)]
    assert query(rows) == plain_manifest(rows)
    rows = [row(i, "x", f"source {i}") for i in range(n)]
    assert query(rows) == plain_manifest(rows)


def test_repeated_rows_null_ids_and_long_texts(query, monkeypatch):
    monkeypatch.setattr(merkle, "LEAVES", 5)
    rows = [row(3, "same\n")] * 40 + [row(None, "a\nb"), row(None, None), row(3, "other"), row(4, "\n" * 100_000), row(6, ""), row(-5, "é\n", None)]
    assert query(rows) == plain_manifest(rows)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 200), st.data())
def test_subtrees_of_a_stretch(total, data):
    """What is complete within a stretch are nodes of the tree; those without a parent cover it once."""
    first = data.draw(st.integers(0, total - 1))
    n = data.draw(st.integers(1, total - first))
    hashes = [str(i) for i in range(total)]
    whole = merkle.climbed(hashes, 0, total)
    assert [len(row) for _, row in whole] == [merkle.width(total, k) for k in range(merkle.height(total) + 1)]
    part = merkle.climbed(hashes[first : first + n], first, total)
    for level, (lo, row) in enumerate(part):
        assert row == whole[level][1][lo : lo + len(row)]
    covered = []
    for level, index, h in merkle.without_parent(part):
        assert h == whole[level][1][index]
        covered += range(index * 3**level, min((index + 1) * 3**level, total))
    assert sorted(covered) == list(range(first, first + n))
    for i in range(first, first + n):
        level, index, path = merkle.path_within(part, i)
        assert (index, len(path)) == (i // 3**level, level) and (level, index) in {x[:2] for x in merkle.without_parent(part)}


def test_tampering_shows(spark, sf_dir):
    got = QUERIES["op11_merkle"](spark, sf_dir)
    m = {r.doc_id: r for r in merkle.manifest(merkle.table(spark, sf_dir, "documents")).collect()}
    for r in got.collect():
        assert r.verified == (m[r.doc_id].tampered is None)
    assert got.select("root").distinct().count() == 1 and got.where(F.col("verified")).count() > 0 and got.where(~F.col("verified")).count() > 0

"""Importance resampling against a plain version."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import resampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), Counter(" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))


def plain_resampled(docs, goal, percent=5, least=20, buckets=10_000):
    """{(doc_id, n_features, weight, score, rank)}, ranks of equal rows in any order."""
    bucket = lambda f: zlib.crc32(f.encode("utf-8", "surrogatepass")) % buckets
    s, t = Counter(), Counter()
    for texts, into in (([x for _, x in docs], s), (goal, t)):
        for x in texts:
            for f, n in plain_features(x)[1].items():
                into[bucket(f)] += n
    S, T = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for i, x in docs:
        n, features = plain_features(x)
        weight = sum(k * gain(bucket(f)) for f, k in features.items())
        h = int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((n < least, -(weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))), i is None, i or 0, i, features.total(), weight))
    rows.sort(key=lambda r: r[:4])
    drawn = percent * sum(not r[0] for r in rows) // 100
    return sorted(((r[4], r[5], r[6], -r[1], k + 1 if k < drawn else None) for k, r in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in df.collect()), key=str)


GOAL = ["the quick brown fox", "Ünder the moon", None, "a b c d e f g h"]


@pytest.mark.parametrize("chunk, part", [(resampling.CHUNK, resampling.PART), (60, 50)])
def test_edges(make, spark, odd_rows, monkeypatch, chunk, part):
    monkeypatch.setattr(resampling, "CHUNK", chunk)
    monkeypatch.setattr(resampling, "PART", part if chunk > 60 else 2_000)
    rows = [*odd_rows, (20, "The quick brown fox " * 30), (20, "The quick brown fox " * 30), (None, "moon " * 25), (21, "\x00a\x7fb İ ß " * 9), (22, "one two"), (23, "x" * 100_000)]
    goal = spark.createDataFrame([(k, t) for k, t in enumerate(GOAL)], "item_id long, text string")
    assert got(resampling.resampled(make(rows), goal, percent=40)) == plain_resampled(rows, GOAL, percent=40)


def test_empty_tables(make, spark):
    goal = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert got(resampling.resampled(make([]), goal)) == []
    rows = [(1, "a b c"), (2, None)]
    assert got(resampling.resampled(make(rows), goal.where("false"))) == plain_resampled(rows, [])
    assert got(resampling.resampled(make([(1, None), (2, "")]), goal.where("false"))) == plain_resampled([(1, None), (2, "")], [])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab C\né.", max_size=12), max_size=8), st.integers(1, 5))
def test_a_chunk_sends_each_feature_once_and_gets_its_weights_back(texts, parts):
    counts, ranks, words = resampling.encoded([t.encode() for t in texts])
    chunk = resampling.Chunk(resampling.packed((list(range(len(texts))), counts, ranks, words)), parts)
    want = Counter()
    for t in texts:
        want += plain_features(t)[1]
    sent, buckets = Counter(), {}
    gains = np.arange(97) ** 2
    for p in range(parts):
        if (blob := chunk.request(p)) is not None:
            strings, n = resampling.strings_of(blob)
            strings = [x.decode() for x in strings.to_pylist()]
            assert not sent.keys() & set(strings) and len(set(strings)) == len(strings)
            sent.update(dict(zip(strings, n.tolist())))
            buckets[p] = np.array([zlib.crc32(x.encode()) % 97 for x in strings], np.int64)
    assert sent == want
    weight = lambda t: sum(k * int(gains[zlib.crc32(f.encode()) % 97]) for f, k in plain_features(t)[1].items())
    assert chunk.weights(buckets, gains).tolist() == [weight(t) for t in texts]


def test_requests_are_small():
    """Words go without their lengths, and counts in as few bytes as they need."""
    import numpy as np

    from plumbline.llm import resampling as r

    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 123, int(n)).astype(np.uint8)) for n in rng.integers(1, 12, 2000)]
    texts = [b" ".join(words[i] for i in rng.zipf(1.3, 400) % 2000) for _ in range(100)] + [b"", "größe 中文".encode()]
    chunk = r.Chunk(r.packed((list(range(102)), *r.encoded(texts))), 2)
    sent = [chunk.request(p) for p in range(2)]
    got = {x: int(n) for s in sent for x, n in zip(*(a.tolist() for a in r.strings_of(s)))}
    want: dict = {}
    for t in texts:
        w = t.split()
        for f in (b" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)):
            want[f] = want.get(f, 0) + 1
    assert got == want
    lengths = [r.strings_out(chunk.words.take(__import__("pyarrow").array(i))) for p in range(2) for i in (chunk.of_part(p)[0], chunk.third[chunk.of_part(p)[2]])]
    assert sum(map(len, sent)) < 1.6 * len(r.packed(lengths))

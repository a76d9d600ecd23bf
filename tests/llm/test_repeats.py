"""Substring operators: adversarial words, crowded anchors, an index reopened, sorting beyond memory."""

import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import anchored, inducing, rolling, substring_dedup, suffix_dedup


def words_removed(make, rows, **how):
    out = substring_dedup.substring_dedup(make(rows), **how)
    return {r[0]: tuple(r[1:]) for r in out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256)).collect()}


def test_words_that_collide_under_polynomial_hashes(make):
    """The Thue-Morse word of 1024 letters and its complement have equal sums for any odd base."""
    letters = ["ab"[i.bit_count() % 2] for i in range(1024)]
    one, two = "".join(letters), "".join("ab"["ba".index(c)] for c in letters)
    fill = [f"w{i}" for i in range(59)]
    rows = [(1, " ".join([*fill[:30], one, *fill[30:]])), (2, " ".join([*fill[:30], two, *fill[30:]])), (3, " ".join([*fill[:30], one, *fill[30:]])), (4, one), (5, two)]
    got = words_removed(make, rows)
    assert got == brute.substring_dedup(rows) and got[2][1] == 0 and got[3][1] == 60
    out = suffix_dedup.suffix_dedup(make(rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_text", 256))
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == brute.suffix_dedup(rows)


def crowd(seed=1):
    """One line in many documents, each time in other surroundings, some of which repeat."""
    rng = random.Random(seed)
    line = " ".join(f"line{i}" for i in range(20))
    some = [" ".join(f"v{rng.randrange(400)}" for _ in range(40)) for _ in range(30)]
    side = lambda: rng.choice(some) if rng.random() < 0.5 else " ".join(f"v{rng.randrange(400)}" for _ in range(40))
    return [(i, f"{side()} {line} {side()}") for i in range(150)]


@pytest.mark.parametrize("many", [1, 5, 10**6])
def test_crowded_anchors_go_by_marks(make, monkeypatch, many):
    monkeypatch.setattr(anchored, "MANY", many)
    rows = crowd()
    assert words_removed(make, rows) == brute.substring_dedup(rows)
    out = suffix_dedup.suffix_dedup(make(rows), crowd=20).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_text", 256))
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == brute.suffix_dedup(rows)


@pytest.mark.parametrize("many", [2, 10**6])
def test_index_is_saved_and_opened_again(spark, make, tmp_path, monkeypatch, odd_rows, many):
    """Batches added by indexes opened anew find what one run over all documents finds."""
    monkeypatch.setattr(anchored, "MANY", many)
    rows = [r for r in odd_rows if r[0] != 13] + [(100 + i, t) for i, t in crowd(2)]
    folder = f"file://{tmp_path}/index"
    told = {}
    parts = [rows[:6], rows[6:12], rows[12:90], rows[90:]]
    for n, part in enumerate(parts):
        index = substring_dedup.FingerprintIndex.open(spark, folder) if n else substring_dedup.FingerprintIndex(spark, folder=folder)
        for r in index.removed(make(part)).collect():
            told.setdefault(r.doc_id, set()).update(range(r.lo, r.hi))
        assert all(index.levels.count(x) < index.fanout for x in index.levels)
    want = {i: gone for i, (_, gone, _) in brute.substring_dedup(rows).items() if gone}
    assert {i: len(x) for i, x in told.items()} == want
    with pytest.raises(ValueError):
        substring_dedup.FingerprintIndex(spark).removed(make(rows))


def test_index_grows_in_buckets(spark, make, tmp_path, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROWN", 20)
    rows = crowd(3)
    folder, told = f"file://{tmp_path}/index", {}
    index = substring_dedup.FingerprintIndex(spark, fanout=2, folder=folder)
    for a in range(0, 150, 50):
        for r in index.removed(make(rows[a : a + 50])).collect():
            told.setdefault(r.doc_id, set()).update(range(r.lo, r.hi))
    assert index.buckets > 4 and index.levels == [1, 0]
    assert {i: len(x) for i, x in told.items()} == {i: gone for i, (_, gone, _) in brute.substring_dedup(rows).items() if gone}


def test_word_slices_overlap():
    data = " ".join(f"w{i}" for i in range(1000)).encode() + b" " + b"x" * 500 + b" end"
    words = data.split()
    seen = []
    for offset, part, begin, last in anchored.word_slices(data, 300, 20):
        assert part == words[offset : offset + len(part)]
        assert begin - offset == min(20, begin) and offset + len(part) >= min(len(words), last + 20)
        seen += range(begin, last)
    assert seen == list(range(len(words)))


def test_long_texts_in_slices(make, monkeypatch):
    monkeypatch.setattr(anchored, "CHUNK", 200)
    rng = random.Random(4)
    text = " ".join(f"v{rng.randrange(300)}" for _ in range(3000))
    rows = [(1, text), (2, text[5000:9000] + " other"), (3, "y" * 3000 + " " + text[:2000])]
    assert words_removed(make, rows) == brute.substring_dedup(rows)
    out = suffix_dedup.suffix_dedup(make(rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_text", 256))
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == brute.suffix_dedup(rows)


def test_sorting_beyond_memory(monkeypatch):
    """A shard many times the limits: queues stay within theirs, the rest is in files, results are the same."""
    monkeypatch.setattr(inducing, "BATCH", 256)
    rng = random.Random(6)
    segments = [bytes(rng.choices(b"abc", k=rng.randint(50, 200))) for _ in range(150)]
    segments += [s[20:90] + rng.choice(segments)[:70] for s in segments[:60]]
    docs, los = np.arange(len(segments)), np.zeros(len(segments), np.int64)
    most, files = [0], [0]

    class Watched(inducing.Queues):
        def push(self, symbol, positions, values):
            super().push(symbol, positions, values)
            most[0] = max(most[0], self.held)

        def _spill(self):
            files[0] += 1
            super()._spill()

    monkeypatch.setattr(inducing, "Queues", Watched)

    def told(**limits):
        out = set()
        for f in suffix_dedup.covered_windows(docs, los, segments, 40, **limits):
            for d, lo, hi in f.itertuples(index=False):
                out |= {(d, i) for i in range(lo, hi)}
        return out

    plain = told()
    assert files[0] == 0 and plain
    most[0] = 0
    assert told(queued=500, memory=1000, base=200) == plain
    assert files[0] > 10 and most[0] <= 500 < sum(map(len, segments)) / 20


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 6), st.data())
def test_every_whole_window_has_its_anchors(values, w, data):
    """Hashes of 0 are hashes as others are, whichever windows are whole."""
    h = np.array(values, np.uint64)
    n = max(len(h) - w + 1, 0)
    whole = np.array(data.draw(st.lists(st.booleans(), min_size=n, max_size=n)), bool)
    want = set()
    for i in np.flatnonzero(whole):
        window = [max(v, 1) for v in values[i : i + w]]
        want |= {int(i) + k for k, v in enumerate(window) if v == min(window)}
    assert set(rolling.anchors(h, w, whole).tolist()) == want


def test_copies_of_a_text_whose_gram_has_the_hash_0(make):
    """60 bytes of this text have the polynomial sum 0 modulo 2**64, hence the hash 0."""
    text = "Twenty bytes before.HbnEqMdwJyjvmPXeaXPHrNmfcsRYtwisLklDAXkUgrsp LFOg hEfbMqYrgrand twenty behind it"
    h = rolling.grams(rolling.prefix(rolling.byte_values(np.frombuffer(text.encode(), np.uint8))), 60)
    assert len(text) == 100 and 0 in h
    for t in (text, text[::-1]):
        got = suffix_dedup.suffix_dedup(make([(1, t), (2, t), (3, f"a{t}b")]))
        assert {r.doc_id: r.n_removed for r in got.collect()} == {1: 0, 2: 100, 3: 100}


def test_fingerprints_are_rewritten_as_often_as_batches_have_digits(make, spark, tmp_path):
    """Sixteen batches: a run of each level at most, and each fingerprint in four compactions; what is found is that of one
    batch."""
    rows = [(i, " ".join(f"w{(i * 31 + k) % 997}" for k in range(70))) for i in range(48)] + [(100 + i, "also " + " ".join(f"w{(i * 31 + k) % 997}" for k in range(70))) for i in range(0, 48, 5)]
    index = substring_dedup.FingerprintIndex(spark, folder=f"file://{tmp_path}/index", fanout=2)
    gone, entries = {}, 0
    rows.sort(key=lambda r: r[0])
    for b in range(16):
        if b == 9:  # another session goes on
            again = substring_dedup.FingerprintIndex.open(spark, f"file://{tmp_path}/index", fanout=2)
            assert (again.levels, again.sizes) == (index.levels, index.sizes)
            again.rewritten, index = index.rewritten, again
        for r in index.removed(make(rows[len(rows) * b // 16 : len(rows) * (b + 1) // 16])).collect():
            gone.setdefault(r.doc_id, set()).update(range(r.lo, r.hi))
        assert len(set(index.levels)) == len(index.levels) <= 4 and len(index.paths["runs"]) == len(index.runs) == len(index.sizes)
    entries = sum(index.sizes)
    assert index.levels == [4] and index.rewritten <= 4 * entries * 1.2
    plain = brute.substring_dedup(rows)
    assert {i: len(x) for i, x in gone.items()} == {i: n for i, (_, n, _) in plain.items() if n}

"""BPE, packing, language, toxicity and chat operators."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import bpe, chat, langid, packing, toxicity
from plumbline.llm.common import table
from plumbline.llm.queries import QUERIES

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  a", "a  b", "a   b  ", "\n\n a\n", "<|endoftext|> x<|endoftext|>", "I'm you're 'sss", "日本語 한국어", "é 🙂🙂", "x" * 3000, " " * 500, "\x1c\x1d a\x85b c  d", "123 4567"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdehinorst \n'.é1"), max_size=80))
def test_bpe_like_library(text):
    a, lib = bpe.automaton(BYTE), Tokenizer.from_file(BYTE) if not hasattr(test_bpe_like_library, "lib") else test_bpe_like_library.lib
    test_bpe_like_library.lib = lib
    ids = lib.encode(text, add_special_tokens=False).ids
    assert a.encode(text) == ids and a.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_odd_texts_and_documents(spark, sf_dir, library):
    a = bpe.automaton(BYTE)
    for t in [*ODD, *(r.text for r in table(spark, sf_dir, "documents").collect())]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert a.encode(t) == ids
        assert a.decode(a.encode(t)) == t


def test_bpe_query_rows(make):
    rows = [(1, None), (2, ""), (3, "ab c"), (3, "ab c"), (None, "x" * 5000)]
    got = [tuple(r) for r in bpe.digests(make(rows), BYTE).collect()]
    assert len(got) == 5 and got[0][1:] == got[1][1:] and got[2] == got[3] and got[0][1] == 0
    out = bpe.encoded(make(rows), BYTE).collect()
    assert [r.decoded for r in out] == ["", "", "ab c", "ab c", "x" * 5000]
    assert bpe.digests(make([]), BYTE).count() == 0


def test_word_ids_like_library():
    lib = Tokenizer.from_file(WORD)
    for t in [*ODD, None, "ÀÉ İSTANBUL ΣΑΣ Σ", "<|startoftext|>x"]:
        assert packing.token_bytes(t, WORD) == np.array(lib.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aZés'tlmrvd .,$1²ªµßÉÞ<|>"), st.characters(min_codepoint=0x20, max_codepoint=0x24F), st.sampled_from("İΣǅ\u0301日")), max_size=25))
def test_word_ids_of_any_letters(text):
    packing.token_bytes("", WORD)
    lib = packing._loaded[WORD].tokenizer
    assert packing.token_bytes(text, WORD) == np.array(lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def check_packing(rows, capacity):
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


def test_packing_query(spark, sf_dir):
    rows = QUERIES["op5_pack"](spark, sf_dir).collect()
    lib, texts = Tokenizer.from_file(WORD), {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    ids = {i: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
    seen = Counter()
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + 2048]
        assert (r.start, r.length, r.ids_crc32) == (2048 * r.piece, len(part), zlib.crc32(part.tobytes()))
        seen[r.doc_id] += r.length
    assert seen == {i: len(x) for i, x in ids.items()}
    assert check_packing(rows, 2048) <= -(-sum(seen.values()) // 2048) + 1


def test_packing_edges(make):
    rows = [(1, None), (2, ""), (3, "word " * 9000), (3, "word " * 9000), (None, "a b"), (5, " ")]
    got = packing.pack_documents(make(rows), WORD).collect()
    assert sum(r.length for r in got if r.doc_id == 3) == 2 * 9001 and {r.length for r in got if r.doc_id in (1, 2, 5)} == {1}
    check_packing(got, 2048)
    assert packing.pack_documents(make([]), WORD).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=15))
def test_plan_holds_the_histogram(histogram):
    packed = packing.plan(dict(histogram), 40)
    total = Counter()
    for n, content in packed:
        assert n > 0 and sum(a * b for a, b in content.items()) <= 40
        for size, copies in content.items():
            total[size] += n * copies
    assert total == histogram


def test_plan_finds_full_sequences():
    assert sum(n for n, _ in packing.plan({1200: 500, 848: 500, 700: 300, 1348: 300, 512: 400}, 2048)) == 900


def test_program_beats_best_fit():
    histogram = {1044: 600, 552: 600, 532: 600, 472: 1200}
    assert sum(n for n, _ in packing.best_fit(dict(histogram), [], 2048)) == 1100
    assert sum(n for n, _ in packing.plan(histogram, 2048)) == 900


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 39), st.integers(1, 30), min_size=1, max_size=15))
def test_fractional_solution_covers(histogram):
    lengths, counts = np.array(list(histogram)), np.array(list(histogram.values()))
    solution = packing.fractional(lengths, counts, 40)
    cover = np.zeros(len(lengths))
    for config, n in solution.items():
        assert n > 0 and sum(int(lengths[k]) * c for k, c in config) <= 40 and all(c <= counts[k] for k, c in config)
        for k, c in config:
            cover[k] += n * c
    assert (cover >= counts - 1e-6).all() and sum(solution.values()) >= lengths @ counts / 40 - 1e-6


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.tuples(st.integers(1, 9), st.floats(0.1, 5)), min_size=1, max_size=6), st.integers(1, 30))
def test_knapsack_is_bounded_and_best(items, capacity):
    lengths, counts, values = np.array(list(items)), np.array([n for n, _ in items.values()]), np.array([v for _, v in items.values()])
    best = {0: 0.0}
    for size, n, v in zip(lengths.tolist(), counts.tolist(), values.tolist()):
        best = _with(best, size, n, v, capacity)
    sack = packing.Knapsack(lengths, counts, values, capacity)
    got = sack.solution(capacity)
    assert all(n <= counts[i] for i, n in got.items()) and sum(int(lengths[i]) * n for i, n in got.items()) <= capacity
    assert sum(values[i] * n for i, n in got.items()) == pytest.approx(max(best.values()), abs=1e-6)


def _with(best, size, n, v, capacity):
    out = {}
    for c, w in best.items():
        for m in range(n + 1):
            if c + size * m <= capacity:
                out[c + size * m] = max(out.get(c + size * m, 0.0), w + v * m)
    return out


def test_program_places_most_pieces(spark):
    """On the lengths of real tokens the program places nine tenths, and the plan reaches the bound."""
    parts = packing.pieces(table(spark, "/root/testdata/sf0.01", "documents"), WORD)
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    total, bound = sum(histogram.values()), -(-sum(k * n for k, n in histogram.items()) // 2048)
    placed = [total - sum(left.values()) for _, left in packing.program(histogram)]
    assert max(placed) >= 0.9 * total
    assert sum(n for n, _ in packing.plan(histogram)) <= bound + 1


def test_langid_held_out_accuracy(spark, sf_dir):
    got = QUERIES["op3_langid"](spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents"), "doc_id").where("held_out")
    n, good, low, high = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred")), F.min("score"), F.max("score")).first()
    assert n > 150 and good / n >= 0.95 and low >= 0 and high <= 1


def test_langid_edges(make):
    dicts = {"en": b"the cat sat on the mat and the dog", "de": "der hund und die katze über straße".encode()}
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "the cat and the dog sat"), (4, "the cat and the dog sat"), (5, "Die Katze und der Hund"), (6, "zz " * 50_000), (None, "und")]
    got = [(r.doc_id, r.lang_pred) for r in langid.classified(make(rows), dicts).collect()]
    assert got[:6] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de")] and got[6][1] in dicts and len(got) == 8
    assert {r.lang_pred for r in langid.classified(make(rows), {}).collect()} == {"und"}
    assert langid.dictionaries(make([])) == {} and langid.classified(make([]), dicts).count() == 0


def plain_language(text, dicts):
    """Each language's size by zstandard alone, pieces and words compressed one by one."""
    import re

    import zstandard

    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not words or not dicts:
        return "und"
    how = zstandard.ZstdCompressionParameters(**langid.EFFORT, strategy=zstandard.STRATEGY_LAZY2, write_checksum=0, write_content_size=0, write_dict_id=0)
    data, keys = " ".join(words).encode(), []
    for lang, d in dicts.items():
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)
        whole = sum(len(c.compress(data[i : i + 131072])) for i in range(0, len(data), 131072))
        keys.append((whole, sum(len(c.compress(w.encode())) for w in set(words)), lang))
    return min(keys)[2]


def test_langid_against_a_plain_loop(spark):
    """Dictionaries counted over whole texts here, and sizes without the classifier: the query's rows."""
    sf = "/root/testdata/sf0.001"
    rows = table(spark, sf, "documents").select("doc_id", "lang", "text").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows}
    counts = {}
    for r in rows:
        if r.lang is not None and r.text is not None and not held[r.doc_id]:  # fewer than the sample's bound
            words = langid.normalised(r.text).split()
            counts.setdefault(r.lang, Counter()).update([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))])
    dicts = {}
    for lang, c in counts.items():
        size, chosen = 0, []
        for p, n in sorted(c.items(), key=lambda x: (-x[1], x[0])):
            size += len(p.encode()) + 1
            if size > langid.DICTIONARY:
                break
            chosen.append(p)
        dicts[lang] = " ".join(reversed(chosen)).encode()
    assert dicts == langid.dictionaries(table(spark, sf, "documents").where(langid.fold(5) != 0))
    got = {r.doc_id: (r.held_out, r.lang_pred) for r in QUERIES["op3_langid"](spark, sf).collect()}
    assert got == {r.doc_id: (held[r.doc_id], plain_language(r.text, dicts)) for r in rows}


def test_langid_reads_long_texts_whole(make):
    """A text whose first 200 KB are of one language and whose longer rest is of another."""
    rng = random.Random(2)
    words = {x: [x + "".join(rng.choices("abcdefghij", k=6)) for _ in range(400)] for x in "qz"}
    dicts = {x: " ".join(w).encode() for x, w in words.items()}
    text = " ".join(rng.choices(words["q"], k=25_000)) + " " + " ".join(rng.choices(words["z"], k=60_000))
    got = langid.classified(make([(1, text)]), dicts).first()
    assert got.lang_pred == "z" and got.accepted


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op6_toxicity"](spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in got if r.toxic == 1]
    clean = [r.predicted for r in got if r.toxic == 0]
    assert sum(toxic) / len(toxic) >= 0.8 and sum(clean) / len(clean) <= 0.03


@pytest.fixture(scope="module")
def model():
    rng = random.Random(5)
    words = "stone river quiet morning letter garden winter silver candle paper orange travel music simple corner window yellow basket moment summer".split()
    text = lambda: [rng.choice(words) for _ in range(30)]
    clean = [" ".join(text()) for _ in range(300)]
    bad = []
    for _ in range(120):
        t = text()
        for _ in range(3):
            t.insert(rng.randrange(len(t)), rng.choice(["idiot", "moron", "stupid"]))
        bad.append(" ".join(t))
    return toxicity.Model(clean + bad, [0] * 300 + [1] * 120)


@pytest.mark.parametrize("token, word", [("1d10t", "idiot"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("idiiiiot", "idiot"), ("m0r0n", "moron"), ("$tupid", "stupid"), ("stuuupid", "stupid"), ("window", "window")])
def test_restored_words(model, token, word):
    assert model.chars.restore(token) == word


def plain_paths(chars, token):
    """All readings of a token with their costs, by recursion over every choice."""

    def go(i, state, cost, out):
        if i == len(token):
            yield cost + chars.cost(state, " "), out
            return
        c = token[i]
        ways = []
        for r, extra in ([(c, 0.0)] if c.isalpha() else []) + [(r, toxicity.SUBSTITUTE) for r in toxicity.SIGNS.get(c, "")]:
            ways.append((state[1] + r, extra + chars.cost(state, r), r))
            if state[1] == r:
                ways.append((state, extra + toxicity.REPEAT, ""))
        if c in toxicity.SEPARATORS or c.isspace():
            ways.append((state, toxicity.DROP, ""))
        if c.isspace() and state != "  ":
            ways.append(("  ", toxicity.BOUNDARY + chars.cost(state, " "), " "))
        for to, extra, r in ways or [(state, 2 * toxicity.DROP, "")]:
            yield from go(i + 1, to, cost + extra, out + r)

    return list(go(0, "  ", 0.0, ""))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("idotmrns10$*.- |§"), max_size=7))
def test_decoding_is_exact(model, token):
    paths = plain_paths(model.chars, token)
    best = min(c for c, _ in paths)
    assert model.chars.restore(token) in {out for c, out in paths if c <= best + 1e-9}


def test_no_state_is_dropped(model):
    token = "*1|!" * 40 + "idiot"
    assert model.chars.restore(token)  # far more states than a beam of 64 would keep
    assert len({p for p in model.chars.restore("*" * 200)} - set("aeiou")) == 0


@pytest.mark.parametrize("text", ["stuupid stone", "morron river", "s\tt\tu\tp\ti\td", "i  d  i  o  t", "i\nd\ni\no\nt", "s t u p i d i d i o t", "a st0ne m o r o n"])
def test_more_disguises_are_caught(model, text):
    assert model.score(text) >= 0.7


def test_all_words_weigh(model):
    """The eleventh toxic word and those after it still count."""
    some = [w + x for w in ("idiot", "moron", "stupid") for x in ("", "s", "ed", "ing", "er")]
    few, more = (model.strength(" ".join(some[:n])) for n in (10, 15))
    assert more > few


def test_disguised_texts_score_like_plain_ones(model):
    plain = model.score("you idiot stone moron river stupid")
    for t in ("you 1d10t stone m0r0n river $tupid", "you i d i o t stone mooooron river s.t.u.p.i.d", "YOU IDIOT!! stone MORON, river (stupid)"):
        assert model.score(t) >= 0.7 and abs(model.score(t) - plain) < 0.3
    assert model.score("stone river 10 w1nter 2024-01-05 a.b@c.de") < 0.3


def test_toxicity_edges(make, model):
    rows = [(1, None), (2, ""), (3, "quiet " * 60_000), (4, "idiot moron stupid"), (4, "idiot moron stupid"), (None, "river")]
    got = [tuple(r) for r in toxicity.scored(make(rows), model).collect()]
    assert got[0][1:] == got[1][1:] and got[3] == got[4] and [r[2] for r in got] == [0, 0, 0, 1, 1, 0] and all(0 <= r[1] <= 1 for r in got)
    assert toxicity.scored(make([]), model).count() == 0
    kept = toxicity.without_toxic(make(rows), model)
    assert kept.columns == make(rows).columns and kept.count() == 4
    assert toxicity.Model([], []).score("anything") < 0.7


def test_toxicity_query_against_a_plain_version(spark):
    """The query's scores from counts, weights and curve worked out here on the driver."""
    sf = "/root/testdata/sf0.001"
    part = lambda i: zlib.crc32(str(i).encode()) % 3
    docs = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    marks = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect() if part(r.doc_id) != 1 and r.toxic is not None and r.doc_id in docs}
    by = [[docs[i] for i in sorted(marks) if marks[i] == y] for y in (0, 1)]
    words = [Counter(w for t in texts for w in (x.strip(toxicity._EDGE) for x in t.lower().split()) if w.isalpha()) for texts in by]
    uses = [Counter() for _ in by]
    for n, c in zip(uses, words):
        for w, k in c.items():
            for f in {w, *(w[:m] + "-" for m in (4, 5, 6) if len(w) > m)}:
                n[f] += k
    total = [1 + sum(c.values()) for c in words]
    likely = {f for f, n in uses[1].items() if n >= toxicity.SUPPORT and (n / total[1]) / ((uses[0][f] + 0.5) / total[0]) >= toxicity.RATIO}
    around = {f: [set(), set()] for f in likely}
    for y, texts in enumerate(by):
        for t in texts:
            tokens = ["", *(x.strip(toxicity._EDGE) for x in t.lower().split()), ""]
            for a, w, b in zip(tokens, tokens[1:], tokens[2:]):
                for f in {w, *(w[:m] + "-" for m in (4, 5, 6) if len(w) > m)} & likely if w.isalpha() else ():
                    around[f][y].add((a, b))
    letters = Counter(w for i, t in docs.items() if part(i) != 1 for w in (x.strip(toxicity._EDGE) for x in t.lower().split()) if w.isalpha())
    plain = toxicity.Model.counted({f: (len(a), len(b)) for f, (a, b) in around.items()}, total, toxicity.trigrams(letters.items()))
    order = sorted(marks)
    plain._fit(np.array([plain.strength(docs[i]) for i in order]), np.array([marks[i] for i in order], float))
    got = {r.doc_id: r for r in QUERIES["op6_toxicity"](spark, sf).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        assert got[i].score == pytest.approx(plain.score(t), abs=1e-6) and got[i].held_out == (part(i) == 1) and got[i].predicted == (got[i].score >= 0.7)


def labelled(spark, make, rows):
    """Documents and labels of (doc_id, text, toxic)."""
    return make([r[:2] for r in rows]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def test_toxicity_fit_reads_whole_texts(spark, make):
    """Toxic words far into long documents are learned, as by the model fitted on all texts here."""
    rng = random.Random(7)
    words = "stone river quiet morning letter garden winter silver candle paper orange travel".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, f"{text(2500)} you {rng.choice(words)} moron {text(3)} moron {text(3)}", 1) for i in range(40)]
    rows += [(i, text(400), 0) for i in range(100, 200)] + [(500, None, 1)]
    docs, labels = labelled(spark, make, [*rows, rows[0]])
    got, want = toxicity.fit(docs, labels), toxicity.Model([t for _, t, _ in rows[:-1]], [y for *_, y in rows[:-1]])
    assert "moron" in got.weights and got.weights == want.weights
    assert got.slope == pytest.approx(want.slope) and got.shift == pytest.approx(want.shift)
    assert got.score("stone moron river") >= 0.7 > got.score("stone river")
    assert toxicity.fit(make([]), labels).weights == {} and toxicity.fit(docs, labels.where("false")).weights == {}


def test_toxicity_letters_of_all_texts(spark, make):
    """Words that only late and unlabelled texts hold enter the character model."""
    rng = random.Random(9)
    words = "stone river quiet morning letter garden winter silver candle paper orange travel".split()
    text = lambda: " ".join(rng.choice(words) for _ in range(8))
    rows = [(i, text() + " moron" * (i % 3 == 0) + " " + text(), int(i % 3 == 0)) for i in range(2400)]
    late = [(i, "Zyxwomat, zyxwomat! the zyxwomats") for i in range(5000, 5020)]
    docs, labels = labelled(spark, make, rows)
    got = toxicity.fit(docs.unionByName(make([*late, (9000, None)])), labels)
    assert got.chars.three == toxicity.CharModel(toxicity.trigrams(toxicity.words_in([t for _, t, _ in rows] + [t for _, t in late]).items())).three
    assert got.chars.restore("zyxw0m4t") == "zyxwomat"
    less = toxicity.fit(docs, labels)
    assert less.weights == got.weights and toxicity._mark(less) != toxicity._mark(got)


def test_chat_layouts(spark):
    want = [("user", "hi"), ("assistant", "yo")]
    tables = [
        ("conv_id long, messages array<struct<role:string,content:string>>", (1, [("user", "hi"), ("assistant", "yo")])),
        ("conv_id long, conversations array<struct<from:string,value:string>>, extra int", (1, [("human", "hi"), ("gpt", "yo")], 3)),
        ("conv_id long, instruction string, output string", (1, "hi", "yo")),
        ("conv_id long, prompt string, completion string, text string", (1, "hi", "yo", "x")),
        ("conv_id long, prompt string, response string", (1, "hi", "yo")),
        ("conv_id long, question string, answer string, turn int", (1, "hi", "yo", 9)),
    ]
    for schema, row in tables:
        got = chat.canonical_turns(spark.createDataFrame([row], schema)).orderBy("turn").collect()
        assert [(r.role, r.text) for r in got] == want, schema
    both = spark.createDataFrame([(1, "do", "this", "ok")], "conv_id long, instruction string, input string, output string")
    assert [r.text for r in chat.canonical_turns(both).orderBy("turn").collect()] == ["do\n\nthis", "ok"]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, 2)], "conv_id long, other int"))


def test_chat_json_of_mixed_layouts(spark):
    lines = ['{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}', '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', '{"prompt":"a","response":"b"}', '{"system":"s","prompt":"a","response":"b"}', "{bad", '{"zzz":1}']
    got = chat.canonical_json(spark.createDataFrame(list(enumerate(lines)), "conv_id long, line string"), "line").orderBy("conv_id", "turn").collect()
    by = {}
    for r in got:
        by.setdefault(r.conv_id, []).append((r.layout, r.role, r.text))
    assert [x[1:] for x in by[0]] == [x[1:] for x in by[1]] == [x[1:] for x in by[2]] == [("user", "a"), ("assistant", "b")]
    assert by[3][0] == ("system_prompt", "system", "s") and by[4] == by[5] == [(None, None, None)]


def test_fingerprints_select_mappings(spark):
    """Every mapping is found under the hash of its own paths, extra columns or not; the hash decides."""
    for m in chat.MAPPINGS:
        assert chat.BY_FINGERPRINT[chat.fingerprint(m.paths)] is m
        assert chat.known([*m.paths, "zzz", "zzz.role"]) == set(m.paths)
    assert len(chat.BY_FINGERPRINT) > 1000 and chat.fingerprint(["a", "b"]) == chat.fingerprint(["b", "a", "b"])
    schema = spark.createDataFrame([], "turn long, role string, prompt string, response string, messages array<struct<role:string>>").schema
    assert chat.known(chat.field_paths(schema)) == {"prompt", "response"} and chat.mapping_for(schema).name == "prompt_response"
    lines = ['{"prompt":"a","response":"b","question":"q","answer":null}', '{"messages":[{"role":"user"}],"question":"a","answer":"b"}', '{"instruction":"a","input":"","output":"b"}', "[]", ""]
    got = chat.canonical_json(spark.createDataFrame(list(enumerate(lines)), "conv_id long, line string"), "line").select("conv_id", "layout").distinct().collect()
    assert {r.conv_id: r.layout for r in got} == {0: "prompt_response", 1: "question_answer", 2: "instruction_input", 3: None, 4: None}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "<x>"]), st.text(alphabet="ab&<[;lt|>turnend\n/", max_size=25)), min_size=1, max_size=6))
def test_chat_reads_back(spark, turns):
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.format_conversations(df)).first()
    assert [(x.role, x.text) for x in got.turns] == turns
    assert got.loss_text == "".join(t for r, t in turns if r == "assistant")


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, after string, piece int"
    rows = [(1, 0, None, None, "", 0), (1, 0, None, None, "", 0), (None, 5, "assistant", "x" * 100_000, "", 0), (2, None, "assistant", "late", "", 0), (2, 1, "user", "", "", 0)]
    turns = chat.canonical_turns(spark.createDataFrame(rows, schema))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    assert [tuple(x) for x in got[1].turns] == [("", "")] * 2 and len(got[None].loss_text) == 100_000 and [x.text for x in got[2].turns] == ["late", ""]
    assert chat.format_conversations(chat.canonical_turns(spark.createDataFrame([], schema))).count() == 0


def test_letters_of_many_scripts_are_bounded(spark, monkeypatch):
    """Letters beyond the most frequent ones count as one; what is restored in frequent letters stays."""
    draw = random.Random(8)
    han = ["".join(chr(draw.randrange(0x4E00, 0x9FA5)) for _ in range(draw.randint(1, 4))) for _ in range(3000)]
    latin = ["stupid", "idiot", "the", "weather", "is", "fine", "today", "moron"]
    rows = [(" ".join(latin * 40),)] * 5 + [(" ".join(han[i : i + 50]),) for i in range(0, 3000, 50)]
    texts = spark.createDataFrame(rows, "text string")
    monkeypatch.setattr(toxicity, "LETTERS", 20)
    got = toxicity.letters(texts)
    alone = toxicity.trigrams(toxicity.words_in(t for (t,) in rows).items())
    assert len({c for s in alone for c in s}) > 2000 and len({c for s in got for c in s}) <= 22 and len(got) <= 22**3
    assert sum(got.values()) == sum(alone.values())
    assert all(got[s] == n for s, n in alone.items() if set(s) <= set("stupid hewarnfoym"))
    few, many = toxicity.CharModel(got), toxicity.CharModel(alone)
    for token in ("5tup1d", "w-e-a-t-h-e-r", "m0ron", "id10t"):
        assert few.restore(token) == many.restore(token)
    rare = next(w for w in han if len(w) > 2)
    assert few.restore(rare) == rare

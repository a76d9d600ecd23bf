"""The token automaton: every character beside letters, digits and spaces; its table; the query's columns."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import bpe
from plumbline.llm.common import table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    lib = Tokenizer.from_file(PATH)
    lib.no_truncation()
    lib.no_padding()
    return lib


def test_every_character_splits_like_the_library(library):
    """Also characters that newer Unicode tables than the library's call letters or numbers."""
    a = bpe.automaton(PATH)
    for c in [*range(0xD800), *range(0xE000, 0x33480), 0xE0001, 0x10FFFF]:
        text = f"b{chr(c)}1 {chr(c)}b{chr(c)} 2{chr(c)}"
        assert a.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(c)
    assert a.encode("\U00010eda阗") == library.encode("\U00010eda阗", add_special_tokens=False).ids


@pytest.mark.parametrize("states", [2, 50, 1 << 18])
def test_table_starts_afresh(library, monkeypatch, states):
    monkeypatch.setattr(bpe, "STATES", states)
    a, rng = bpe.Automaton(PATH), random.Random(8)
    for text in ["", "x" * 3000, "".join(rng.choices("abcdefgh0123 é日", k=20_000)), "the cat the cat internationalization"]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert a.encode(text) == ids and a.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert len(a.ended) <= max(states, 1) + 2


def test_table_is_deterministic_and_used(library):
    a = bpe.Automaton(PATH)
    a.encode("reading the reader reads")
    before = dict(a.table)
    a.paths.clear(), a.first.clear(), a.words.clear()
    a.encode("reads the reading reader")
    assert all(a.table[k] == v for k, v in before.items())
    assert all(a.ended[v] >= 0 for v in a.table.values())


def test_query_columns_are_the_library_s(spark, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.digests(docs, PATH).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        want = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want

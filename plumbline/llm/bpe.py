"""BPE encoding and decoding through a token automaton built merge by merge.

Two machines are composed.  The first reads tokens; its states are named by the token read
last.  It starts with one arc for each byte at every state.  The gadget of a merge
(a, b -> c) cuts arc b at the state after a; it adds arc c at every state that had arc a,
leading to a state that copies the arcs of the state after b.  (Where a and b are the same
token, pairs are taken from the left, so arc c isn't added at the state after a itself.)
After the last gadget every text has exactly one path, its BPE encoding, and the path's arc
labels spell the text.  ``_arc`` says what the gadgets, applied in order, have left of an arc.

The second spells tokens: a trie of their bytes.  Their composition reads bytes and is made
deterministic by subsets: a state holds every (token-state, trie node) that a token begun at
an earlier byte may be in, and the one token that ends here.  Words are encoded by its table,
a row of transitions by byte for each state.  The whole table would have billions of entries,
of which texts use few, so a row is filled when its transition is first asked for, and kept.
"""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import DataFrame

from plumbline.llm.common import small_batches, sole, table

#: Words and arcs kept in a worker's memory, and states of the table; beyond that they start afresh.
KEPT, STATES = 1 << 20, 1 << 18
START = -1
_WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: how byte-level BPE splits text into words before merging.  Only texts below LATIN are
#: split by it; which other characters are letters or numbers is for the library to say.
LATIN = "\u0250"
SPLIT = f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{_WHITE}\\p{{L}}\\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
#: Runs of white space across which words can't be split at each space.
_RUNS = re.compile(r"\s\s\s|\s\s\Z")


def byte_of_symbol() -> dict[str, int]:
    """Vocabulary files write each byte as one visible character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Words(dict):
    """part -> (ids joined by commas, labels); a part stands for itself behind ``lead``."""

    def __init__(self, automaton: "Automaton", lead: str):
        self.automaton, self.lead = automaton, lead

    def __missing__(self, part: str):
        if len(self) >= KEPT:
            self.clear()
        a = self.automaton
        ids = [i for w in a.split(self.lead + part) for i in a.paths[w]]
        self[part] = got = (",".join(map(str, ids)), b"".join([a.labels[i] for i in ids]))
        return got


class Paths(dict):
    """Word -> its ids; parts that differ in punctuation share words."""

    def __init__(self, automaton: "Automaton"):
        self.automaton = automaton

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= KEPT // 2:
            self.clear()
        self[word] = got = self.automaton.path(word.encode("utf-8", "surrogatepass"))
        return got


class Automaton:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        code = byte_of_symbol()
        raw = lambda s: bytes(code[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.ids = {raw(s): i for s, i in vocab.items()}
        self.labels = {i: s for s, i in self.ids.items()}
        self.size = {i: len(s) for i, s in self.labels.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.labels |= {i: s.encode() for s, i in self.special.items()}
        # The trie: node << 8 | byte -> node, and the token that ends at a node.
        self.child: dict[int, int] = {}
        self.ends = [-1]
        for label, i in self.ids.items():
            node = 0
            for byte in label:
                to = self.child.setdefault(node << 8 | byte, len(self.ends))
                if to == len(self.ends):
                    self.ends.append(-1)
                node = to
            self.ends[node] = i
        #: Nodes from which a token goes on.
        self.inner = bytearray(len(self.ends))
        for step in self.child:
            self.inner[step >> 8] = 1
        self.gadget: dict[tuple[int, int], int] = {}  # (a, b) -> rank
        self.parts: dict[int, tuple[int, int, int]] = {}  # c -> (rank, a, b)
        for rank, (x, y) in enumerate(m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]):
            a, b, c = vocab[x], vocab[y], vocab[x + y]
            self.gadget.setdefault((a, b), rank)
            self.parts.setdefault(c, (rank, a, b))
        self.arcs: dict[tuple[int, int], bool] = {}
        self.made: dict[int, bool] = {}
        self._afresh()
        self._latin = regex.compile(SPLIT)
        self._library = Tokenizer.from_file(path).pre_tokenizer
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.first, self.words, self.paths = Words(self, ""), Words(self, " "), Paths(self)

    def _arc(self, state: int, token: int, before: int) -> bool:
        """Whether the state has the arc once all gadgets of rank under ``before`` are applied."""
        cut = self.gadget.get((state, token))
        if cut is not None and cut < before:
            return False
        made, a, b = self.parts.get(token, (-1, 0, 0))
        born, _, right = self.parts.get(state, (-1, 0, 0)) if state != START else (-1, 0, 0)
        if made < 0 and born < 0:
            return True
        if born > made:
            return self._arc(right, token, born)  # the state copied the arcs of another one
        if born == made:
            return self._arc(right, a, made)
        if a == b == state:
            return False
        return self._arc(state, a, made)

    def fires(self, token: int) -> bool:
        """Whether any text leads to the token: its parts' arc is there when its gadget comes."""
        if token not in self.parts:
            return True
        got = self.made.get(token)
        if got is None:
            rank, a, b = self.parts[token]
            self.made[token] = got = self.fires(a) and self.fires(b) and self.gadget[a, b] == rank and self._arc(a, b, rank)
        return got

    def allowed(self, state: int, token: int) -> bool:
        got = self.arcs.get((state, token))
        if got is None:
            if len(self.arcs) >= 4 * KEPT:
                self.arcs.clear()
            self.arcs[state, token] = got = self.fires(token) and (state == START or self._arc(state, token, len(self.gadget) + 1))
        return got

    def _afresh(self, name: tuple = (START,)) -> int:
        """An empty table that holds the start, state 0, and the state of this name, whose number it returns."""
        #: The table, state << 8 | byte -> state, and of each state its name (the token that ends here, or
        #: START, and the pairs of token-state << 24 | trie node that tokens begun before are in).
        self.table: dict[int, int] = {}
        self.names: list[tuple] = list(dict.fromkeys([(START,), name]))
        self.states: dict[tuple, int] = {x: i for i, x in enumerate(self.names)}
        self.ended: list[int] = [x[0] for x in self.names]
        return self.states[name]

    def _step(self, state: int, byte: int) -> int:
        """The transition, worked out and entered in the table."""
        child, ends, inner, arcs = self.child.get, self.ends, self.inner, self.arcs.get
        at, *begun = self.names[state]
        to = child(byte)
        name = [START, at << 24 | to] if inner[to] else [START]
        token = START
        if (t := ends[to]) >= 0 and ((ok := arcs((at, t))) or ok is None and self.allowed(at, t)):
            token = t
        for pair in begun:
            to = child((pair & 0xFFFFFF) << 8 | byte)
            if to is not None:
                at = pair >> 24
                if inner[to]:
                    name.append(at << 24 | to)
                if token < 0 and (t := ends[to]) >= 0 and ((ok := arcs((at, t))) or ok is None and self.allowed(at, t)):
                    token = t
        if token < 0:
            raise ValueError(f"no arc spells byte {byte} behind token {self.ended[state]}")
        name[0] = token
        key = tuple(name)
        got = self.states.get(key)
        if got is None:
            self.states[key] = got = len(self.ended)
            self.names.append(key)
            self.ended.append(token)
        self.table[state << 8 | byte] = got
        return got

    def path(self, word: bytes) -> list[int]:
        """The tokens of the one path that spells the word."""
        table, ended, state, tokens = self.table.get, self.ended, 0, []
        for byte in word:
            to = table(state << 8 | byte)
            if to is None:
                if len(ended) >= STATES:
                    state = self._afresh(self.names[state])
                    table, ended = self.table.get, self.ended
                to = self._step(state, byte)
            state = to
            tokens.append(ended[state])
        out, n, size = [], len(word), self.size
        while n:
            t = tokens[n - 1]
            out.append(t)
            n -= size[t]
        out.reverse()
        return out

    def split(self, text: str) -> list[str]:
        """The words that merges don't cross."""
        if not text or max(text) < LATIN:
            return self._latin.findall(text)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def _plain(self, text: str) -> list[tuple[str, bytes]]:
        if not text:
            return []
        if _RUNS.search(text):
            return [self.first[w] for w in self.split(text)]
        head, *rest = text.split(" ")
        got = list(map(self.words.__getitem__, rest))
        return [self.first[head], *got] if head else got

    def read(self, text: str) -> tuple[str, bytes]:
        """The ids of a text joined by commas, and its labels."""
        if self.marks is None or not self.marks.search(text):
            got = self._plain(text)
        else:
            got = []
            for k, part in enumerate(self.marks.split(text)):
                got += [(str(self.special[part]), self.labels[self.special[part]])] if k % 2 else self._plain(part)
        return ",".join([g[0] for g in got]), b"".join([g[1] for g in got])

    def encode(self, text: str) -> list[int]:
        ids = self.read(text)[0]
        return list(map(int, ids.split(","))) if ids else []

    def decode(self, ids) -> str:
        return b"".join([self.labels[i] for i in ids]).decode("utf-8", "replace")


_loaded: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """The automaton of a vocabulary file, kept for the life of a worker."""
    sole("bpe", _loaded.clear)
    if path not in _loaded:
        _loaded[path] = Automaton(path)
    return _loaded[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids array<int>, decoded string.

    Null and empty texts have no ids and decode to the empty text.  Special tokens in texts are read
    as such.  Rows that repeat, or have no doc_id, give a row each; an empty table gives none.
    Further columns are ignored."""
    small_batches(docs.sparkSession)

    def run(batches):
        a = automaton(path)
        for b in batches:
            ids = [a.encode(t or "") for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": ids, "decoded": [a.decode(i) for i in ids]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256: ``encoded`` without its
    long columns, with the same results for null, empty and repeated rows."""
    small_batches(docs.sparkSession)

    def run(batches):
        a, sha = automaton(path), lambda b: hashlib.sha256(b).hexdigest()
        for b in batches:
            rows = []
            for t in b["text"]:
                ids, labels = a.read(t or "")
                text = labels.decode("utf-8", "replace")
                rows.append((ids.count(",") + 1 if ids else 0, sha(ids.encode()), sha(text.encode())))
            n, i, d = zip(*rows) if rows else ((), (), ())
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": n, "ids_sha256": i, "decoded_sha256": d})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark, sf_dir):
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

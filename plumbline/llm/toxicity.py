"""Toxicity of texts that may be written to deceive: a noisy channel undone.

A token that mixes in digits, signs or repeated letters, and runs of single letters, are
character lattices: each sign may stand for a letter, separators may be noise, repeated
letters may be one, and white space in a run of letters may be noise or end a word.  Viterbi
decoding under a character language model, over all states, restores the likeliest words.  The restored text is then scored: words and word beginnings that labelled toxic texts
use in many different surroundings, and others don't, weigh in a logistic score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import partitions, small_batches, sole, table, written
from plumbline.llm.langid import fold

#: Labelled documents that the model is fitted on (those of least hash), each with its whole text.
SAMPLE = 8000
#: Surroundings of a word or beginning in toxic texts, at least; how much likelier it is there.
SUPPORT, RATIO = 8, 12.0
THRESHOLD = 0.7
#: Tokens, and letters behind two others, whose weights a worker keeps.
KEPT = 1 << 18
#: Different words or letters that a task counts before it passes them on.
HELD = 200_000
#: Weights of letters are whole numbers of this part, so that their sums don't depend on the order.
PART = 1 << 20
#: The most frequent letters, which the letter model tells apart, and what stands for any other: what comes to
#: the driver and goes to workers is (LETTERS + 2)**3 trigrams at most, whatever scripts the texts are in.
LETTERS, OTHER = 96, "\uFFFD"
#: Letters that signs stand for, with the cost (negative log) of each reading.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
SEPARATORS = ".-_*~'`,:;/\\^\"#%&="
SUBSTITUTE, DROP, REPEAT, BOUNDARY = 1.5, 0.7, 0.4, 1.0
_EDGE = ".,;:!?\"'()[]{}<>*#&%$=~`^_-/\\|+…“”‘’«»"
#: Single characters in a row, whatever white space stands between them.
_SINGLES = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S)){3,}")
_REPEATS = re.compile(r"(.)\1+", re.S)


def squeezed(word: str) -> str:
    """The word with every letter that repeats written once."""
    return _REPEATS.sub(r"\1", word)


def words_in(texts) -> Counter:
    """How often each alphabetic word stands in these texts, in lower case and without its edges."""
    tokens: Counter = Counter()
    for t in texts:
        tokens.update(t.lower().split())
    out: Counter = Counter()
    for token, n in tokens.items():
        if (w := token.strip(_EDGE)).isalpha():
            out[w] += n
    return out


def trigrams(words) -> Counter:
    """Weights of three letters in a row, in PARTs, from words and their numbers in a corpus."""
    out: Counter = Counter()
    for w, n in words:
        n = round((1 + math.log(n)) * PART)
        s = f"  {w} "
        for i in range(2, len(s)):
            out[s[i - 2 : i + 1]] += n
    return out


class CharModel:
    """A trigram model of the letters of words, interpolated with shorter ones."""

    def __init__(self, three: Counter):
        self.one, self.two, self.three, self.pairs, self.firsts = Counter(), Counter(), Counter(), Counter(), Counter()
        for s, n in sorted(three.items()):
            n = n / PART
            self.one[s[2]] += n
            self.two[s[1:]] += n
            self.three[s] += n
            self.firsts[s[1]] += n
            self.pairs[s[:2]] += n
        self.total = sum(self.one.values()) or 1
        self.memo: dict[str, float] = {}

    def cost(self, context: str, c: str) -> float:
        """Negative log likelihood of c behind two letters."""
        got = self.memo.get(context + c)
        if got is None:
            if len(self.memo) > KEPT:
                self.memo.clear()
            seen = context + c
            context, c = "".join(x if x in self.one else OTHER for x in context), c if c in self.one else OTHER
            key = context + c
            p = 0.02 * (self.one[c] + 0.1) / (self.total + 10)
            if f := self.firsts[context[1]]:
                p += 0.28 * self.two[key[1:]] / f
            if f := self.pairs[context]:
                p += 0.7 * self.three[key] / f
            self.memo[seen] = got = -math.log(p)
        return got

    def restore(self, token: str) -> str:
        """The likeliest word behind a lower-case token; ``token`` may hold signs and separators.  White
        space in it may part words."""
        # state: last two letters -> (cost, letters so far as a linked list)
        states = {"  ": (0.0, None)}
        for c in token:
            now: dict[str, tuple] = {}

            def put(state, cost, path):
                if state not in now or cost < now[state][0]:
                    now[state] = (cost, path)

            readings = [(c, 0.0)] if c.isalpha() else []
            readings += [(r, SUBSTITUTE) for r in SIGNS.get(c, "")]
            for state, (cost, path) in states.items():
                for r, extra in readings:
                    put(state[1] + r, cost + extra + self.cost(state, r), (r, path))
                    if state[1] == r:
                        put(state, cost + extra + REPEAT, path)
                if c in SEPARATORS or c.isspace():
                    put(state, cost + DROP, path)
                if c.isspace() and state != "  ":
                    put("  ", cost + BOUNDARY + self.cost(state, " "), (" ", path))
            if not now:  # a sign that no letter explains stays out
                now = {s: (cost + 2 * DROP, path) for s, (cost, path) in states.items()}
            states = now
        _, path = min(((cost + self.cost(s, " "), path) for s, (cost, path) in states.items()), key=lambda x: x[0])
        out = []
        while path:
            out.append(path[0])
            path = path[1]
        return "".join(reversed(out))


def plain_word(token: str) -> str | None:
    """The word of a lower-case token that holds letters alone between its edges, else None."""
    core = token.strip(_EDGE)
    if core and token[0] in "$@|+€£¡":  # in front, these are letters
        return None
    return core if not core or core.isalpha() else None


def beginnings(word: str):
    """The word and its beginnings, as features."""
    yield word
    for n in (4, 5, 6):
        if len(word) > n:
            yield f"{word[:n]}-"


def features_in(words: Counter) -> Counter:
    """How often each feature stands among these words."""
    out: Counter = Counter()
    for w, n in words.items():
        for f in beginnings(w):
            out[f] += n
    return out


def around_in(texts, features) -> set[tuple[str, int]]:
    """These features with the hashes of their surroundings, the tokens before and behind."""
    import xxhash

    out = set()
    for text in texts:
        tokens = [t.strip(_EDGE) for t in text.lower().split()]
        for a, w, b in zip(["", *tokens], tokens, [*tokens[1:], ""]):
            if w.isalpha():
                for f in beginnings(w):
                    if f in features:
                        out.add((f, xxhash.xxh64_intdigest(f"{a} {b}".encode("utf-8", "surrogatepass")) - (1 << 63)))
    return out


class Model:
    """Features with weights, the character model, and the logistic curve over the weights met."""

    def __init__(self, texts: list[str], toxic: list[int]):
        """Fitted here; ``fit`` does the same in executors."""
        by = [[t for t, y in zip(texts, toxic) if y == label] for label in (0, 1)]
        words = [words_in(t) for t in by]
        total = [1 + w.total() for w in words]
        good, bad = map(features_in, words)
        # Of what toxic texts use often enough and others far less often, the surroundings.
        likely = {f for f, n in bad.items() if n >= SUPPORT and (n / total[1]) / ((good[f] + 0.5) / total[0]) >= RATIO}
        around = [Counter(f for f, _ in around_in(t, likely)) for t in by]
        self._weigh({f: (around[0][f], around[1][f]) for f in likely}, total, trigrams((words[0] + words[1]).items()))
        if texts:
            self._fit(np.array([self.strength(t) for t in texts]), np.array(toxic, float))

    @classmethod
    def counted(cls, around: dict[str, tuple[int, int]], total: list[int], three: Counter) -> Model:
        """A model from what others and toxic texts hold, without its curve."""
        model = cls([], [])
        model._weigh(around, total, three)
        return model

    def _weigh(self, around: dict[str, tuple[int, int]], total: list[int], three: Counter) -> None:
        """around: for each feature its different surroundings in other and in toxic texts."""
        self.weights: dict[str, float] = {}
        for f, (other, n) in around.items():
            if n < SUPPORT:
                continue
            sure = n - 2 * math.sqrt(n)  # as few as chance may have made many
            ratio = (sure / total[1]) / ((other + 0.5) / total[0])
            if ratio >= RATIO and n > other:
                self.weights[f] = math.log(ratio)
        #: What a word must begin with for a decoding that only drops repeated letters to find a weight.
        self.squeezed = {squeezed(f.removesuffix("-")) for f in self.weights}
        self.longest = max(map(len, self.squeezed), default=0)
        self.chars = CharModel(three)
        self.slope, self.shift = 1.0, -4.0

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression on one variable, by Newton steps with a small penalty."""
        a, b = 1.0, -4.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            w = p * (1 - p) + 1e-9
            g = np.array([((p - y) * x).sum() + 0.1 * (a - 1), (p - y).sum()])
            h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(h, g)
            step *= min(1, 2 / (np.abs(step).max() + 1e-9))
            a, b = a - step[0], b - step[1]
        self.slope, self.shift = float(max(a, 1e-3)), float(b)

    def of_word(self, word: str) -> float:
        return max((self.weights.get(f, 0.0) for f in beginnings(word)), default=0.0)

    def of_token(self, token: str) -> float:
        """The weight of a lower-case token, restored if it looks disguised."""
        word = plain_word(token)
        if word is None:
            return max(self.of_word(self.chars.restore(token)), self.of_word(self.chars.restore(token.strip(_EDGE))))
        got = self.of_word(word)
        if not got and _REPEATS.search(word):
            short = squeezed(word)
            if any(short[:n] in self.squeezed for n in range(1, min(len(short), self.longest) + 1)):
                return self.of_word(self.chars.restore(word))
        return got

    def strength(self, text: str, weight=None) -> float:
        low = text.lower()
        weight = weight or self.of_token
        met = [w for w in map(weight, set(low.split())) if w]
        for run in _SINGLES.finditer(low):
            met += [w for w in map(self.of_word, self.chars.restore(" ".join(run.group().split())).split()) if w]
        # The strongest counts whole, more of them add less and less.
        met.sort(reverse=True)
        return sum(w / (i + 1) for i, w in enumerate(met))

    def score(self, text: str | None, weight=None) -> float:
        z = self.slope * self.strength(text or "", weight) + self.shift
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


class _Weights(dict):
    """Token -> weight, kept for a worker's life."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, token: str) -> float:
        if len(self) >= KEPT:
            self.clear()
        self[token] = got = self.model.of_token(token)
        return got


def letters(texts: DataFrame) -> Counter:
    """``trigrams`` of all words of the column ``text``, counted in executors: words are summed up in
    each task, then over all.  Letters beyond the ``LETTERS`` of most weight become one, so that what comes back
    is bounded."""
    small_batches(texts.sparkSession)

    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["part", "n"])

    def counted(count):
        def run(batches):
            held: Counter = Counter()
            for b in batches:
                held.update(count(b))
                if len(held) > HELD:
                    yield batch(held)
                    held = Counter()
            yield batch(held)

        return run

    words = counted(lambda b: words_in(t for t in b["text"].to_pylist() if t))
    grams = counted(lambda b: trigrams(zip(b["part"].to_pylist(), b["n"].to_pylist())))
    out = texts.select("text")
    for step in (words, grams):
        out = out.mapInArrow(step, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
    out = written(out, "trigrams")
    last = F.substring("part", 3, 1)
    often = out.where(last != " ").groupBy(last.alias("c")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").limit(LETTERS)
    known = [" ", *(r["c"] for r in often.collect())]
    letter = lambda i: F.when(F.substring("part", i, 1).isin(known), F.substring("part", i, 1)).otherwise(OTHER)
    out = out.groupBy(F.concat(letter(1), letter(2), letter(3)).alias("part")).agg(F.sum("n").alias("n"))
    return Counter({r["part"]: r["n"] for r in out.collect()})


def counts(rows: DataFrame) -> tuple[dict[str, tuple[int, int]], list[int]]:
    """Of the likely features of ``rows`` (text, toxic) the numbers of surroundings in other and
    in toxic texts, and the words of both, one more each; counted in executors."""

    def uses(batches):
        for b in batches:
            for y in (0, 1):
                words = words_in(b["text"][b["toxic"] == y])
                got = features_in(words)
                got[""] = words.total()  # no word is empty
                yield pd.DataFrame({"feature": list(got.keys()), "toxic": np.int32(y), "n": list(got.values())})

    def n(y):
        return F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0))

    used = rows.mapInPandas(uses, "feature string, toxic int, n long").groupBy("feature").agg(n(0).alias("good"), n(1).alias("bad"))
    used = written(used, "toxicity-features")
    total = [1, 1]
    for r in used.where("feature = ''").collect():
        total = [1 + r["good"], 1 + r["bad"]]
    often = (F.col("bad") / total[1]) / ((F.col("good") + 0.5) / total[0]) >= RATIO
    likely = {r["feature"] for r in used.where((F.col("feature") != "") & (F.col("bad") >= SUPPORT) & often).select("feature").collect()}

    def around(batches):
        for b in batches:
            for y in (0, 1):
                if got := around_in(b["text"][b["toxic"] == y], likely):
                    f, h = zip(*got)
                    yield pd.DataFrame({"feature": f, "toxic": np.int32(y), "around": h})

    seen = rows.mapInPandas(around, "feature string, toxic int, around long").distinct().groupBy("feature", "toxic").agg(F.count(F.lit(1)).alias("n"))
    out = {f: [0, 0] for f in likely}
    for r in seen.collect():
        out[r["feature"]][r["toxic"]] = r["n"]
    return {f: (a, b) for f, (a, b) in out.items()}, total


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents: those of least hash of their id, each with its
    whole text.  The letters are those of all rows of ``docs``, labelled or not.  Texts stay in
    executors; counts and one number for each document come back."""
    spark = docs.sparkSession
    ids = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    keys = spark.createDataFrame([(r["doc_id"], int(r["toxic"])) for r in ids.collect()], "doc_id long, toxic int")
    small_batches(spark)
    rows = docs.join(F.broadcast(keys), "doc_id").where("text is not null").select("doc_id", "text", "toxic")
    rows = written(rows.repartition(partitions(spark), "doc_id").distinct(), "toxicity-sample")
    model = Model.counted(*counts(rows), letters(docs.where("text is not null")))
    shared, mark = spark.sparkContext.broadcast(model), _mark(model)

    def strengths(batches):
        m, weights = _in_worker(mark, shared)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "strength": [m.strength(t, weights.__getitem__) for t in b["text"]], "toxic": b["toxic"]})

    # In one order always, for the same sums.
    got = sorted(tuple(r) for r in rows.mapInPandas(strengths, "doc_id long, strength double, toxic int").collect())
    if got:
        model._fit(np.array([x for _, x, _ in got]), np.array([y for *_, y in got], float))
    return model


_loaded: dict[int, tuple[Model, _Weights]] = {}


def _mark(model: Model) -> int:
    return zlib.crc32(repr((sorted(model.weights.items()), sorted(model.chars.three.items()), model.slope, model.shift)).encode())


def _in_worker(mark: int, shared) -> tuple[Model, _Weights]:
    """The broadcast model and the weights met so far, kept from task to task."""
    sole("toxicity", _loaded.clear)
    if mark not in _loaded:
        _loaded.clear()
        _loaded[mark] = (shared.value, _Weights(shared.value))
    return _loaded[mark]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1), predicted (1 from 0.7 on).

    Null and empty texts have the score of a text without any toxic word.  Further columns are
    ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    mark = _mark(model)

    def run(batches):
        m, weights = _in_worker(mark, shared)
        for b in batches:
            s = np.array([m.score(t, weights.__getitem__) for t in b["text"]], float)
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, whole and in all columns, that aren't predicted toxic."""
    spark = docs.sparkSession
    small_batches(spark)
    shared, mark = spark.sparkContext.broadcast(model), _mark(model)

    def run(batches):
        m, weights = _in_worker(mark, shared)
        for b in batches:
            at = b.schema.names.index("text")
            keep = [m.score(t, weights.__getitem__) < THRESHOLD for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = scored(docs, fit(docs.where(fold(3) != 1), labels.where(fold(3) != 1)))
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")

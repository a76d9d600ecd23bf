"""Best-fit packing by a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits a sequence.  The program asks for the
fewest configurations that cover the histogram; it is solved by multiplicative weights.
In each round a knapsack dynamic program, bounded by the copies there are, prices lengths by
their weights and gives for each length the best configuration that holds it.  Lengths behind
the round's goal get of theirs what they lack; then the weight of each length falls or rises
exponentially by what it got.  After the last round the fractional solution covers the
histogram.  It is rounded: configurations are taken whole, largest share first, as often as
there are pieces, if they are full or the space that any packing leaves free allows what they
leave.  The program is solved again for the pieces left, until few are; these are placed by
best fit, longest first, into what space is left and new sequences.

All of this works on the histogram, whose size is bounded by the capacity.  Pieces then find
their places by their rank among the pieces of the same length, which is counted in buckets.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.llm.bpe import byte_of_symbol
from plumbline.llm.common import small_batches, sole, table, written

CAPACITY = 2048
#: Rounds of the multiplicative weights, knapsacks of a round and of the last one, and their rate.
ROUNDS, PASSES, LAST, RATE = 8, 6, 64, 0.5
#: Parts of all pieces down to which the program is solved and rounded, one time after the other.
LEFT = (0.6, 0.3, 0.1, 0)
#: Pieces of one length in a bucket, within which ranks are counted row by row.
BUCKET = 256
#: Words kept in a worker's memory.
KEPT = 1 << 20


class WordIds(dict):
    """Word -> its ids as little-endian 32-bit numbers; words are what stands between white space.

    Words of Latin letters, which normalisation only turns to lower case, are split here and
    go to the library's model piece by piece; all others go through the whole library.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(spec)
        self.shown = {b: c for c, b in byte_of_symbol().items()}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            if len(self.pieces) >= KEPT // 2:
                self.pieces.clear()
            shown = piece if piece.isascii() else "".join([self.shown[b] for b in piece.encode()])
            self.pieces[piece] = got = np.array([t.id for t in self.tokenizer.model.tokenize(shown)], "<u4").tobytes()
        return got

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        low = word.lower()
        if max(word) < "\u0250" and len(low) == len(word) and word.isprintable() and "<|" not in word:
            got = b"".join([self._piece(x) for x in self.split.findall(low)])
        else:
            got = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = got
        return got


#: \x1C-\x1F are white space to str.split but not to the tokenizer.
_ODD = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_loaded: dict[str, WordIds] = {}


def token_bytes(text: str | None, path: str) -> bytes:
    """Ids of the whole text as little-endian 32-bit numbers, without an end."""
    sole("packing", _loaded.clear)
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    words = _WHITE.split(text or "") if _ODD.search(text or "") else (text or "").split()
    return b"".join(map(_loaded[path].__getitem__, [w for w in words if w]))


def pieces(docs: DataFrame, path: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and ``end``, cut only where
    they exceed the capacity."""
    small_batches(docs.sparkSession)
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                ids = token_bytes(text, path) + last
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    rows.append((doc, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Knapsack:
    """Best values of bounded copies of lengths within every capacity, with their solutions."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, values: np.ndarray, capacity: int):
        best, at = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
        # Node 0 is empty; every other one adds ``copies`` of a length to the node before it.
        before, items, sizes, made = [np.zeros(1, np.int64)], [(0, 0)], [1], 1
        here = counts.nonzero()[0]
        for i, size, n, v in zip(here.tolist(), lengths[here].tolist(), counts[here].tolist(), values[here].tolist()):
            left, copies = min(n, capacity // size), 1
            while left:
                copies = min(copies, left)
                s, gain = size * copies, v * copies
                with_it = best[: capacity + 1 - s] + gain
                up = (with_it > best[s:] + 1e-9).nonzero()[0]
                if len(up):
                    before.append(at[up])
                    items.append((i, copies))
                    sizes.append(len(up))
                    at[up + s] = np.arange(made, made + len(up))
                    best[up + s] = with_it[up]
                    made += len(up)
                left -= copies
                copies *= 2
        self.best, self.at, self.before = best, at, np.concatenate(before)
        self.items, self.number = items, np.repeat(np.arange(len(items)), sizes)

    def solution(self, capacity: int) -> dict[int, int]:
        """Index of length -> copies of the best that fits."""
        out: dict[int, int] = {}
        node = int(self.at[capacity])
        while node:
            i, copies = self.items[self.number[node]]
            out[i] = out.get(i, 0) + copies
            node = int(self.before[node])
        return out


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> dict[tuple, float]:
    """Configurations (sorted (length index, copies) pairs) and their fractional numbers, which cover
    every length as often as it is there."""
    out: dict[tuple, float] = {}
    weight, share = np.ones(len(lengths)), np.zeros(len(lengths))  # share: part of the demand covered
    longest = np.argsort(-lengths, kind="stable").tolist()
    for r in range(rounds):
        goal, most, before = (r + 1) / rounds, min((r + 2) / rounds, 1.0), share.copy()
        last = r + 1 == rounds
        for n in range(LAST if last else PASSES):  # lengths that have got enough leave the knapsack until the next round
            lagged = share < goal - 1e-9
            if not lagged.any():
                break
            sack = Knapsack(lengths, np.where(lagged if last else share < most - 1e-9, counts, 0), lengths * weight, capacity)
            for i in longest:
                if share[i] >= goal - 1e-9:
                    continue
                config = sack.solution(capacity - int(lengths[i]))
                config[i] = min(config.get(i, 0) + 1, int(counts[i]))
                step = (goal - share[i]) * counts[i] / config[i]
                if not last or n + 1 < LAST:  # in the end what lags is covered in any case
                    step = min(step, *((most - share[k]) * counts[k] / m for k, m in config.items()))
                if step <= 1e-9:
                    continue
                key = tuple(sorted(config.items()))
                out[key] = out.get(key, 0.0) + step
                for k, m in key:
                    share[k] += step * m / counts[k]
        weight *= np.exp(-RATE * ((share - before) * rounds - 1))
        weight /= weight.max()
    return out


def rounded(solution: dict[tuple, float], lengths: np.ndarray, left: np.ndarray, capacity: int, slack: int, few: float = 0) -> tuple[list[tuple[int, dict[int, int]]], int]:
    """Whole configurations of a fractional solution, for which pieces are ``left`` (which falls, down to
    a ``few``), and the slack that they leave: space that stays free in any packing."""
    bins, many = [], int(left.sum())
    for config, n in sorted(solution.items(), key=lambda x: (sum(c for _, c in x[0]), -x[1], x[0])):
        whole = min(math.ceil(n - 1e-9), *(int(left[k]) // c for k, c in config))
        free = capacity - sum(int(lengths[k]) * c for k, c in config)
        if free:
            whole = min(whole, slack // free)
        whole = min(whole, math.ceil((many - few) / sum(c for _, c in config)))
        if whole > 0:
            many -= whole * sum(c for _, c in config)
            bins.append((whole, {int(lengths[k]): c for k, c in config}))
            slack -= whole * free
            for k, c in config:
                left[k] -= whole * c
    return bins, slack


def best_fit(left: dict[int, int], bins: list[tuple[int, dict[int, int]]], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Place the lengths ``left`` (with counts) into the free space of ``bins`` (number, content)
    and new ones: longest first, each into the fullest sequence that takes it.  Sequences of
    like content are kept as one entry, so counts don't matter."""
    free: dict[int, list] = {}
    for n, content in bins:
        free.setdefault(capacity - sum(a * b for a, b in content.items()), []).append((n, content))
    open_ = np.zeros(capacity + 1, bool)
    open_[list(free)] = True
    for size in sorted(left, reverse=True):
        todo = left[size]
        while todo:
            at = np.flatnonzero(open_[size:])
            if not len(at):
                each = min(capacity // size, todo)
                n = todo // each
                space = capacity - each * size
                free.setdefault(space, []).append((n, {size: each}))
                open_[space] = True
                todo -= n * each
                continue
            space = size + int(at[0])
            n, content = free[space].pop()
            took = min(n, todo)
            if took < n:
                free[space].append((n - took, content))
            if not free[space]:
                open_[space] = False
            free.setdefault(space - size, []).append((took, content | {size: content.get(size, 0) + 1}))
            open_[space - size] = True
            todo -= took
    return [x for group in free.values() for x in group]


def program(histogram: dict[int, int], capacity: int = CAPACITY):
    """After each time that the program is solved and rounded: (bins so far, histogram of what is left)."""
    bins = [(histogram[capacity], {capacity: 1})] if capacity in histogram else []
    left = {k: v for k, v in sorted(histogram.items()) if k < capacity}
    slack = -sum(k * v for k, v in left.items()) % capacity
    total = sum(histogram.values())
    yield bins, left
    for part in LEFT:
        few = part * total
        if sum(left.values()) <= few:
            continue
        lengths, counts = np.array(list(left)), np.array(list(left.values()))
        more, slack = rounded(fractional(lengths, counts, capacity), lengths, counts, capacity, slack, few)
        if not more:
            return
        bins = bins + more
        left = {int(k): int(v) for k, v in zip(lengths, counts) if v}
        yield bins, left


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(number of sequences, {length: copies}) that hold exactly the histogram: the program's bins as
    far as it is best to follow it, with the rest placed by best fit."""
    states = list(program(histogram, capacity))
    least = -(-sum(k * v for k, v in histogram.items()) // capacity)
    best = None
    for bins, left in reversed(states):  # of equally good ones, what the program did most of
        packed = best_fit(dict(left), [(n, dict(c)) for n, c in bins], capacity)
        size = sum(n for n, _ in packed)
        if best is None or size < best[0]:
            best = (size, packed)
        if size == least:
            break
    return best[1] if best else []


def places(packed: list[tuple[int, dict[int, int]]]) -> pd.DataFrame:
    """Which ranks of each length go where: rank_from, first sequence, copies, base offset."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for n, content in packed:
        base = 0
        for size, copies in sorted(content.items(), reverse=True):
            rows.append((size, used.get(size, 0), sequence, copies, base))
            used[size] = used.get(size, 0) + n * copies
            base += size * copies
        sequence += n
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "copies", "base"]).sort_values(["length", "rank"], ignore_index=True)


def ranked(parts: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """parts with ``rank``, from 0 among the pieces of the same length.  A length has a bucket for
    each BUCKET of its pieces."""
    buckets = parts.sparkSession.createDataFrame([(k, -(-n // BUCKET)) for k, n in histogram.items()], "length long, buckets long")  # at most ``capacity`` rows
    parts = parts.join(F.broadcast(buckets), "length")
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets"))).drop("buckets")
    sizes = parts.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    parts = parts.withColumn("within", F.row_number().over(within))
    return parts.join(sizes, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within") - 1).drop("bucket", "before", "within")


def packed_pieces(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = parts.sparkSession
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    where = spark.sparkContext.broadcast(places(plan(histogram, capacity)))

    def run(batches):
        p = where.value
        span = int(p["rank"].max()) + 1 if len(p) else 1
        key = p["length"].to_numpy(np.int64) * span + p["rank"].to_numpy(np.int64)
        for b in batches:
            if not len(b):
                continue
            at = np.searchsorted(key, b["length"].to_numpy(np.int64) * span + np.minimum(b["rank"].to_numpy(np.int64), span - 1), side="right") - 1
            row = p.iloc[at]
            k = b["rank"].to_numpy(np.int64) - row["rank"].to_numpy(np.int64)
            copies = row["copies"].to_numpy(np.int64)
            yield b.drop(columns="rank").assign(sequence_id=row["sequence"].to_numpy(np.int64) + k // copies, offset=row["base"].to_numpy(np.int64) + k % copies * b["length"].to_numpy(np.int64))

    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    order = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    return ranked(parts, histogram).select(order).mapInPandas(run, out)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the end token alone.  Rows that repeat, even in
    doc_id, are each packed.  An empty table gives no rows.  Further columns are ignored.
    """
    return packed_pieces(written(pieces(docs, path, capacity=capacity), "pieces"), capacity)


def op5_pack(spark, sf_dir):
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

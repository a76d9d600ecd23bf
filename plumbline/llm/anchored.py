"""Which stretches of documents can repeat: shared first half of the substring operators.

Every window of ``size`` units (bytes or words) holds a k-gram whose hash is least among its
k-grams.  Equal windows choose alike, so two equal windows share such an *anchor* at the same
place.  Around each anchor lies the *segment* of all windows that hold it.  Anchors are
grouped by hash:

* an anchor found once: its windows repeat nowhere (unless another anchor tells so);
* occurrences whose whole segments are equal: all but the first are covered outright;
* groups of different segments: one occurrence of each is *needed* in full, and an operator
  decides between them window by window.

Hashes of words and k-grams only bring candidates together.  Segments count as equal by a
128-bit BLAKE2b digest of their bytes.  Equal segments are folded inside each task before
anything is shuffled, so a passage that sits in a third of all rows reaches its bucket once per
task; an anchor that has many different surroundings in one task is needed outright and sends
only a mark.  Anchors travel packed, in chunks by ranges of their key, and meet in a merge that
holds the chunks of one range at a time.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import rolling
from plumbline.llm.common import partitions, small_batches, sole, written

#: Bytes handled at once, anchors held before a task hands them on, and entries of a chunk.
CHUNK, HELD, ENTRIES = 1 << 20, 1 << 18, 1 << 16
#: Different segments of an anchor in one task from which on it goes by a mark.
MANY = 256
#: Words whose hashes a worker keeps.
KEPT = 1 << 17
_SPACE_RUN = re.compile(rb"[ \t-\r]")


def as_bytes(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


class _WordHashes(dict):
    """Word -> a 64-bit hash of it."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KEPT:
            self.clear()
        self[word] = got = xxhash.xxh3_64_intdigest(word)
        return got


_words = _WordHashes()


def own_worker() -> None:
    sole("words", _words.clear)


def word_slices(data: bytes, step: int, margin: int):
    """(offset, words, begin, last) of slices of about ``step`` bytes: places from begin to last count,
    and ``margin`` words stand before and behind them, if there are any."""
    at, done, tail, ready = 0, 0, [], None
    while at < len(data):
        start, part = at, []
        while at < len(data) and (at - start < step or len(part) < 2 * margin):
            stop = min(at + step, len(data))
            if stop < len(data):  # not within a word
                found = _SPACE_RUN.search(data, stop)
                stop = found.start() if found else len(data)
            part += data[at:stop].split()
            at = stop
        if ready:
            yield ready[0], ready[1] + part[:margin], ready[2], ready[3]
        ready = (done - len(tail), tail + part, done, done + len(part))
        done += len(part)
        tail = ready[1][-margin:]
    if ready:
        yield ready


@dataclass(frozen=True)
class Units:
    """size: units of a window.  k: units of an anchor.  words: units are words, else bytes.
    across: only another, smaller doc_id counts as earlier."""

    size: int
    k: int
    words: bool
    across: bool

    def chunks(self, docs):
        """Lists of (index of document, offset of its units, bytes or words, first and last place that
        counts) of about CHUNK bytes; very long texts come in overlapping slices."""
        held, total = [], 0
        margin, step = 2 * self.size, 4 * CHUNK
        for i, text in enumerate(docs):
            data = as_bytes(text)
            if self.words:
                spans = ((i, *x) for x in word_slices(data, step, margin))
            else:
                spans = ((i, max(0, s - margin), data[max(0, s - margin) : s + step + margin], s, s + step) for s in range(0, len(data), step))
            for x in spans:
                held.append(x)
                total += len(data) if len(data) < step else step
                if total >= CHUNK:
                    yield held
                    held, total = [], 0
        if held:
            yield held

    def units(self, held) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
        """Hashes of a chunk's units, where each item starts (with the end), and the bytes with the start
        and stop of each unit; words stand one space apart."""
        at = np.concatenate([[0], np.cumsum([len(x[2]) for x in held])])
        if not self.words:
            data = b"".join(x[2] for x in held)
            where = np.arange(len(data) + 1)
            return rolling.byte_values(np.frombuffer(data, np.uint8)), at, data, where[:-1], where[1:]
        words = [w for x in held for w in x[2]]
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], stops[:-1] + 1]) if words else stops
        return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words)), at, b" ".join(words), starts, stops

    def find(self, held) -> dict[str, np.ndarray]:
        """Anchors of a chunk: item, pos, lo, hi (within the item's document), anchor, and the digest of
        the segment in two halves."""
        values, at, data, starts, stops = self.units(held)
        n = len(values)
        if n < self.size:
            return {}
        h = rolling.grams(rolling.prefix(values), self.k)
        end = np.repeat(at[1:], np.diff(at))
        whole = np.arange(n - self.size + 1) + self.size <= end[: n - self.size + 1]
        p = rolling.anchors(h, self.size - self.k + 1, whole)
        item = np.searchsorted(at, p, side="right") - 1
        first = np.array([x[1] for x in held])[item] - at[item]
        keep = (p + first >= np.array([x[3] for x in held])[item]) & (p + first < np.array([x[4] for x in held])[item])
        p, item, first = p[keep], item[keep], first[keep]
        lo, hi = np.maximum(p - (self.size - self.k), at[item]), np.minimum(p + self.size, at[item + 1])
        marks = digests(data, starts[lo], stops[hi - 1])
        # The place of the anchor and the ends of the document's units are part of what must agree.
        d0 = marks[:, 0] ^ rolling.mixed((p - lo).astype(np.uint64))
        return {"item": np.array([x[0] for x in held])[item], "pos": p + first, "lo": lo + first, "hi": hi + first, "anchor": h[p] >> np.uint64(16), "d0": d0, "d1": marks[:, 1]}


def digests(data: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Two halves of a 128-bit digest of each stretch of the bytes."""
    blake = hashlib.blake2b
    return np.frombuffer(b"".join([blake(data[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), stops.tolist())]), "<u8").reshape(-1, 2)


BYTES = Units(size=100, k=60, words=False, across=False)
WORDS = Units(size=50, k=16, words=True, across=True)

KINDS = {"anchor": "<u8", "d0": "<u8", "d1": "<u8", "doc": "<i8", "pos": "<i8", "left": "<u1", "right": "<u1"}
#: Columns whose bytes don't shrink.
DENSE = ("d0", "d1", "check")


def pack(columns: dict[str, np.ndarray]) -> bytes:
    """Columns of equal length as one compressed value; sorted ones shrink well."""
    import zstandard

    n = len(next(iter(columns.values())))
    out = [np.int64(n).tobytes()]
    for name, c in columns.items():
        raw = np.ascontiguousarray(np.diff(c, prepend=c.dtype.type(0)) if name not in DENSE else c)
        if name in DENSE:
            part = raw.tobytes()
        else:
            part = zstandard.compress(raw.view(np.uint8).reshape(n, -1).T.tobytes(), 1)  # like bytes together
        out += [np.int64(len(part)).tobytes(), part]
    return b"".join(out)


def unpack(blob: bytes, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    import zstandard

    n, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 8, {}
    for name, kind in kinds.items():
        size = int(np.frombuffer(blob, np.int64, 1, at)[0])
        part = blob[at + 8 : at + 8 + size]
        at += 8 + size
        if name in DENSE:
            out[name] = np.frombuffer(part, kind)
        else:
            raw = np.frombuffer(zstandard.decompress(part), np.uint8).reshape(-1, n) if n else np.zeros((np.dtype(kind).itemsize, 0), np.uint8)
            c = np.ascontiguousarray(raw.T).view(kind).ravel()
            out[name] = np.cumsum(c, dtype=c.dtype)
    return out


def _groups(*keys: np.ndarray) -> np.ndarray:
    """For sorted keys: index of the first row of each row's group."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.maximum.accumulate(np.where(new, np.arange(n), 0))


def _together(parts: list[dict]) -> dict:
    return {k: np.concatenate([x[k] for x in parts]) for k in parts[0]}


def ordered(c: dict, across: bool) -> tuple[dict, np.ndarray]:
    """Sorted by anchor, digest and place, older entries first; and which rows are covered by an equal
    segment before them."""
    keys = (c["pos"], c["doc"], *([~c["old"]] if "old" in c else []), c["d1"], c["d0"], c["anchor"])
    o = np.lexsort(keys)
    c = {k: v[o] for k, v in c.items()}
    first = _groups(c["anchor"], c["d0"], c["d1"])
    later = (c["doc"] > c["doc"][first]) | ((c["pos"] > c["pos"][first]) & (not across))
    if "old" in c:
        later = ~c["old"] & (later | c["old"][first])
    return c, later


def mixed(c: dict) -> np.ndarray:
    """Of rows in order: which are of an anchor with different segments."""
    first = _groups(c["anchor"])
    last = len(first) - 1 - _groups(c["anchor"][::-1])[::-1]
    return (c["d0"][first] != c["d0"][last]) | (c["d1"][first] != c["d1"][last])


def rows(c: dict, which: np.ndarray, kind) -> pd.DataFrame:
    pos = c["pos"][which]
    return pd.DataFrame({"doc_id": c["doc"][which], "lo": pos - c["left"][which], "hi": pos + c["right"][which], "pos": pos, "anchor": c["anchor"][which].view(np.int64), "kind": np.int8(kind)})


def covers(found: pd.DataFrame) -> pd.DataFrame:
    """Covered stretches of one document that touch, as one."""
    if len(found) < 2:
        return found
    found = found.sort_values(["doc_id", "lo"], kind="stable")
    doc, lo, hi = (found[c].to_numpy() for c in ("doc_id", "lo", "hi"))
    first = _groups(doc)
    span = int(hi.max()) + 1
    number = np.searchsorted(np.unique(first), first)
    top = np.maximum.accumulate(hi + number * span) - number * span
    new = np.ones(len(found), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > top[:-1])
    starts = np.flatnonzero(new)
    ends = np.concatenate([starts[1:], [len(found)]]) - 1
    return pd.DataFrame({"doc_id": doc[starts], "lo": lo[starts], "hi": top[ends], "pos": lo[starts], "anchor": np.int64(0), "kind": np.int8(COVER)})


#: Kinds of found rows: covered; needed, as its group has different segments; the same, of an older
#: entry that is needed for the first time or again; the same, of an anchor that goes by a mark.
COVER, NEED, OLD, AGAIN, CROWDED = 0, 1, 2, 3, 4
FOUND = "doc_id long, lo long, hi long, pos long, anchor long, kind byte"
SENT = "batch int, bucket int, low long, old boolean, blob binary"


def by_anchor(c: dict) -> np.ndarray:
    """The key of 63 bits by whose ranges entries are dealt."""
    return rolling.mixed(c["anchor"]) >> np.uint64(1)


def dealt(c: dict, buckets: int, kinds: dict[str, str] = KINDS, key_of=by_anchor, run: bool = False):
    """(bucket, low, blob) of chunks: buckets are ranges of the key, and so are the chunks of a bucket;
    ``low`` is the least key of one.  A run's chunks have a set size and are in the order of the
    entries; others are in order of place, which shrinks better."""
    key = key_of(c)
    o = np.argsort(key, kind="stable")
    c, key = {k: c[k][o] for k in kinds}, key[o]
    width = -(-(2**63) // buckets)
    bucket = (key // np.uint64(width)).astype(np.int64)
    parts = 1 if run else max(1, min(16, len(key) // (buckets * 1024)))
    cell = bucket * parts + (key % np.uint64(width) // np.uint64(-(-width // parts))).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])).tolist() if len(cell) else []
    for a, b in zip(starts, [*starts[1:], len(cell)]):
        for at in range(a, b, ENTRIES if run else b - a):
            part = {k: v[at : min(at + ENTRIES, b) if run else b] for k, v in c.items()}
            if not run:
                p = np.lexsort((part["pos"], part["doc"]))
                part = {k: v[p] for k, v in part.items()}
            yield int(bucket[at]), int(key[at]), pack(part)


def sent_frame(chunks: list[tuple], done: list[pd.DataFrame], buckets: int) -> pd.DataFrame:
    """Rows of SENT and FOUND: (batch, bucket, low, blob) of chunks, and rows found out already."""
    out = [pd.DataFrame(chunks, columns=["batch", "bucket", "low", "blob"])]
    for n, d in enumerate(done):
        out.append(d.assign(batch=np.int32(-1), bucket=((np.arange(len(d)) + n) % buckets).astype(np.int32), low=np.int64(0)))
    every = pd.concat(out, ignore_index=True).assign(old=False)
    every = every.reindex(columns=["batch", "bucket", "low", "old", "blob", "doc_id", "lo", "hi", "pos", "anchor", "kind"])
    return every.astype({"batch": "int32", "bucket": "int32", "low": "int64", **{x: "Int64" for x in ("doc_id", "lo", "hi", "pos", "anchor")}, "kind": "Int8"})


def batches_of(doc: np.ndarray, cuts) -> np.ndarray:
    """The batch of each doc_id; ``cuts`` are the last ids of all batches but the last."""
    return np.searchsorted(np.array(cuts, np.int64), doc, side="left") if cuts else np.zeros(len(doc), np.int64)


def sent_anchors(docs: DataFrame, units: Units, buckets: int, cuts=()) -> DataFrame:
    """Anchors of ``docs`` in chunks (SENT), beside what a task has found out already (FOUND)."""

    def find(batches):
        own_worker()
        held: list[dict] = []
        size = 0

        def flush():
            c, later = ordered(_together(held), units.across)
            done = [covers(rows(c, later, COVER))] if later.any() else []
            c = {k: v[~later] for k, v in c.items()}
            new = np.concatenate([[True], (c["anchor"][1:] != c["anchor"][:-1]) | (c["d0"][1:] != c["d0"][:-1]) | (c["d1"][1:] != c["d1"][:-1])])
            first = _groups(c["anchor"])
            many = np.bincount(first, new, len(first))[first] > MANY
            if many.any():
                done.append(rows(c, many, CROWDED))
                batch = batches_of(c["doc"], cuts)
                heads = many & ((first == np.arange(len(first))) | (np.diff(batch, prepend=-1) != 0))  # a mark in each batch
                marks = {k: v[heads] for k, v in c.items()} | {"right": np.zeros(int(heads.sum()), np.uint8)}
                c = _together([{k: v[~many] for k, v in c.items()}, marks])
            batch, chunks = batches_of(c["doc"], cuts), []
            for i in np.unique(batch):
                here = batch == i
                chunks += [(i, *x) for x in dealt({k: v[here] for k, v in c.items()}, buckets)]
            return sent_frame(chunks, done, buckets)

        for b in batches:
            ids = b["doc_id"].to_numpy(np.int64)
            for chunk in units.chunks(b["text"]):
                if f := units.find(chunk):
                    held.append({"anchor": f["anchor"], "d0": f["d0"], "d1": f["d1"], "doc": ids[f["item"]], "pos": f["pos"], "left": (f["pos"] - f["lo"]).astype(np.uint8), "right": (f["hi"] - f["pos"]).astype(np.uint8)})
                    size += len(f["pos"])
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return docs.select("doc_id", "text").mapInPandas(find, f"{SENT}, {FOUND}")


def merged(batches, found: list, kinds: dict[str, str] = KINDS, key_of=by_anchor):
    """Entries of complete ranges, from chunks in order of ``low``; rows that are found out already are
    appended to ``found``.  Held are the chunks that begin in one range."""
    held, size, enough = [], 0, 4 * ENTRIES
    for b in batches:
        known = b[b["blob"].isnull()]
        if len(known):
            found.append(known[[x.split()[0] for x in FOUND.split(", ")]].astype({"doc_id": "int64", "lo": "int64", "hi": "int64", "pos": "int64", "anchor": "int64", "kind": "int8"}))
        for low, old, blob in zip(b["low"], b["old"], b["blob"]):
            if blob is None:
                continue
            if size >= enough:
                c = _together(held)
                below = key_of(c) < np.uint64(low)
                if 4 * below.sum() >= size:
                    yield {k: v[below] for k, v in c.items()}
                    c = {k: v[~below] for k, v in c.items()}
                held, size = [c], len(c["doc"])
                enough = max(4 * ENTRIES, 2 * size)
            c = unpack(blob, kinds)
            held.append(c | {"old": np.full(len(c["doc"]), old)})
            size += len(c["doc"])
    if held:
        yield _together(held)


def met(c: dict, across: bool):
    """What these entries, complete for their anchors, tell: frames of found rows, and at last the heads,
    the new entries that stand for segments and marks."""
    mark = c["right"] == 0  # no segment ends at its anchor
    marks = {k: v[mark] for k, v in c.items()}
    c, later = ordered({k: v[~mark] for k, v in c.items()}, across)
    if later.any():
        yield covers(rows(c, later, COVER))
    c = {k: v[~later] for k, v in c.items()}
    old, first = c["old"], _groups(c["anchor"])
    need = (mixed(c) if len(old) else np.zeros(0, bool)) | np.isin(c["anchor"], marks["anchor"])
    if need.any():
        yield rows(c, need & ~old, NEED)
    if old.any():
        fresh = np.bincount(first, ~old, len(first))[first] > 0
        fresh |= np.isin(c["anchor"], marks["anchor"][~marks["old"]])
        before = np.zeros(len(old), bool)
        before[old] = mixed({k: v[old] for k, v in c.items()})
        before |= np.isin(c["anchor"], marks["anchor"][marks["old"]])
        yield rows(c, need & old & fresh & ~before, OLD)
        yield rows(c, need & old & fresh & before, AGAIN)
    head = ~old & (_groups(c["anchor"], c["d0"], c["d1"]) == np.arange(len(old)))
    again = np.isin(marks["anchor"], marks["anchor"][marks["old"]])
    _, one = np.unique(marks["anchor"], return_index=True)
    one = one[~again[one]]
    yield _together([{k: v[head] for k, v in c.items()}, {k: v[one] for k, v in marks.items()}])


def repeated(docs: DataFrame, units: Units) -> DataFrame:
    """doc_id, lo, hi, pos, anchor, kind: stretches that are covered (COVER), and anchors whose windows
    from lo to hi must be compared within their anchor's group (the other kinds).

    Written in the shared folder.  Null and short texts give no rows.  doc_id must not be null.
    """
    small_batches(docs.sparkSession)
    n = partitions(docs.sparkSession)

    def meet(batches):
        found: list = []
        for c in merged(batches, found):
            yield from found
            found.clear()
            yield from (x for x in met(c, units.across) if isinstance(x, pd.DataFrame))
        yield from found

    sent = sent_anchors(docs, units, n)
    return written(sent.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "low").mapInPandas(meet, FOUND), "repeated")

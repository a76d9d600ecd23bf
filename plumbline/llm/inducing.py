"""External suffix sorting by induction, with common-prefix values carried along.

Suffixes are sorted in two scans.  A queue for each first symbol holds (position, common
prefix) tuples in the order in which they were induced; taking the least symbol first, each
batch that leaves a queue induces the suffixes one place to its left into theirs.  The left
scan (ascending) induces the L-suffixes from the sorted leftmost S-suffixes, the right scan
(descending) all S-suffixes from the L-suffixes.  The order of the leftmost S-suffixes comes
from naming the substrings between them, themselves sorted by the same two scans, and
sorting the shorter string of names in the same way, level by level, down to a base case
that is ranked by doubling.

The common prefix of an induced suffix with the one before it in its queue is one more than
the least value met between their inducers, so it is carried without reading the text.  Values
count up to ``cap``; order beyond that many symbols is left open.

Queues, those of the L-suffixes between the scans included, go to files beyond ``queued`` tuples
and come back batch by batch; arrays with an entry per symbol or seed are files beyond
``memory`` bytes.  The files are a task's scratch space, unlinked at once: no other task reads
them, and a task that is run again makes them anew.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Tuples that the queues of one scan keep in memory; the rest is in a file.
QUEUED = 1 << 20
#: Length up to which a string of names is ranked by doubling instead of a further level.
BASE = 1 << 22
#: Bytes up to which an array is in memory, and tuples that leave a queue at once.
MEMORY, BATCH = 1 << 25, 1 << 18


def scratch():
    """An unlinked file where executors keep scratch data."""
    named = os.environ.get("SPARK_LOCAL_DIRS") or os.environ.get("LOCAL_DIRS")
    folder = named.split(",")[0] if named else None
    return tempfile.TemporaryFile(dir=folder if folder and os.path.isdir(folder) else None)


def room(n: int, kind, memory: int) -> np.ndarray:
    """An array to fill; a file if it is large."""
    if n * np.dtype(kind).itemsize <= memory:
        return np.empty(n, kind)
    return np.memmap(scratch(), kind, "w+", shape=(n,))


class Queues:
    """A first-in first-out queue of (position, value) tuples for each symbol, kept on disk
    beyond ``limit`` tuples."""

    def __init__(self, limit: int):
        self.limit, self.held, self.batches, self.file = limit, 0, {}, None

    def push(self, symbol: int, positions: np.ndarray, values: np.ndarray) -> None:
        self.batches.setdefault(symbol, []).append((positions, values))
        self.held += len(positions)
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = scratch()
        self.file.seek(0, 2)
        for symbol, batches in self.batches.items():
            for i, (p, v) in enumerate(batches):
                if isinstance(p, np.ndarray):
                    at = self.file.tell()
                    self.file.write(p.tobytes())
                    self.file.write(v.tobytes())
                    batches[i] = ((at, len(p), p.dtype, v.dtype), None)
        self.held = 0

    def pop(self, symbol: int, last: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """The first (or last) batches that wait for this symbol, about BATCH tuples, in order."""
        waiting = self.batches.get(symbol)
        if not waiting:
            return None
        n, size = 0, 0
        while n < len(waiting) and size < BATCH:
            p = waiting[-1 - n if last else n][0]
            size += len(p) if isinstance(p, np.ndarray) else p[1]
            n += 1
        got = waiting[-n:] if last else waiting[:n]
        self.batches[symbol] = waiting[:-n] if last else waiting[n:]
        out = []
        for p, v in got:
            if not isinstance(p, np.ndarray):
                at, k, pk, vk = p
                self.file.seek(at)
                p = np.frombuffer(self.file.read(k * pk.itemsize), pk)
                v = np.frombuffer(self.file.read(k * vk.itemsize), vk)
            else:
                self.held -= len(p)
            out.append((p, v))
        return (out[0] if len(out) == 1 else tuple(np.concatenate(x) for x in zip(*out)))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Least:
    """Least values between earlier and later pushes of one scan."""

    def __init__(self, cap: int):
        self.cap, self.since = cap, {}  # symbol -> least value since its last push
        self.low = []  # (batch number, least value) of batches, ascending in value: a monotone stack
        self.batch = 0

    def between(self, number: int) -> int:
        """The least value of the batches after batch ``number``."""
        lo, hi = 0, len(self.low)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.low[mid][0] > number:
                hi = mid
            else:
                lo = mid + 1
        return self.low[lo][1] if lo < len(self.low) else self.cap

    def push(self, queues: Queues, symbols: np.ndarray, where: np.ndarray, positions: np.ndarray, values: np.ndarray) -> None:
        """Queue ``positions`` (whose inducers stand at ``where`` in a batch with these values) by symbol."""
        self.batch += 1
        if len(where):
            order = np.argsort(symbols, kind="stable")
            symbols, where, positions = symbols[order], where[order], positions[order]
            starts = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
            stops = np.concatenate([starts[1:], [len(symbols)]])
            ahead = np.minimum.accumulate(values)
            behind = np.minimum.accumulate(values[::-1])[::-1]
            got = np.empty(len(where), values.dtype)
            got[1:] = _range_least(values, where[:-1] + 1, where[1:], starts[1:] - 1)
            for a, b in zip(starts.tolist(), stops.tolist()):
                s = int(symbols[a])
                least = int(ahead[where[a]])
                if s in self.since:
                    number, rest = self.since[s]
                    got[a] = min(least, rest, self.between(number))
                else:
                    got[a] = 0
                    self.since[s] = None
                last = int(where[b - 1])
                rest = int(behind[last + 1]) if last + 1 < len(values) else self.cap
                v = np.minimum(got[a:b].astype(np.int16) + 1, self.cap).astype(np.uint8)
                if self.since[s] is None:
                    v[0] = 0  # set by the caller where the bucket's first suffix has a neighbour
                self.since[s] = (self.batch, rest)
                queues.push(s, positions[a:b], v)
        if len(values):
            low = int(values.min())
            while self.low and self.low[-1][1] >= low:
                self.low.pop()
            self.low.append((self.batch, low))


def _range_least(values: np.ndarray, a: np.ndarray, b: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Least of values[a..b] inclusive for each pair; pairs in ``skip`` may be anything."""
    if not len(a):
        return values[:0]
    a, b = a.copy(), b.copy()
    a[skip], b[skip] = 0, 0
    size = b - a + 1
    out = np.empty(len(a), values.dtype)
    level, table = 1, values
    one = size == 1
    out[one] = values[a[one]]
    left = np.flatnonzero(~one)
    while len(left):
        # table[i] is the least of values[i : i + level]
        now = left[size[left] <= 2 * level]
        if len(now):
            out[now] = np.minimum(table[a[now]], table[b[now] - level + 1])
            left = left[size[left] > 2 * level]
        if len(left):
            table = np.minimum(table[:-level], table[level:])
            level *= 2
    return out


def _types(text: np.ndarray, memory: int = MEMORY) -> np.ndarray:
    """True for S-suffixes; the last symbol, less than all others, counts as S."""
    n = len(text)
    s = room(n, bool, memory)
    s[-1] = True
    ahead = True  # the type behind the part in hand
    for stop in range(n - 1, 0, -BATCH * 4):
        start = max(0, stop - BATCH * 4)
        part, behind = text[start:stop], text[start + 1 : stop + 1]
        differs = np.flatnonzero(part != behind)  # the type of these is seen at once
        less = np.append(part[differs] < behind[differs], ahead)
        s[start:stop] = less[np.searchsorted(differs, np.arange(stop - start))]
        ahead = bool(s[start])
    return s


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of the suffixes at a and b, up to cap, read from the text."""
    out = np.zeros(len(a), np.uint8)
    left = np.arange(len(a))
    n = len(text)
    for k in range(cap):
        x, y = a[left] + k, b[left] + k
        same = (x < n) & (y < n)
        same[same] = text[x[same]] == text[y[same]]
        left = left[same]
        if not len(left):
            break
        out[left] = k + 1
    return out


def _scan(text: np.ndarray, s: np.ndarray, seeds: np.ndarray, values: np.ndarray, cap: int, queued: int):
    """Both scans from the seeds (leftmost S-suffixes in order, with common prefixes).

    Yields (positions, values) in descending order: each value is the suffix's common prefix
    with the one yielded before it.
    """
    kind = seeds.dtype
    # Left scan: at each symbol its L-suffixes, then its seeds.
    queues, least, lefts = Queues(queued), _Least(cap), Queues(queued)
    seeded = _seeded(text, seeds)
    tail: dict[int, np.ndarray] = {}  # the last L-suffix of each symbol
    waiting = _symbols(text)
    for c in waiting:
        while (got := queues.pop(c)) is not None:
            p, v = got
            if c not in tail:
                v = v.copy()
                v[0] = 0
            tail[c] = p[-1:].copy()
            lefts.push(c, p, v)
            _induce(text, s, p, v, False, queues, least, kind)
        if c in seeded:
            for a in range(*seeded[c], BATCH):
                b = min(a + BATCH, seeded[c][1])
                v = values[a:b].copy()
                if a == seeded[c][0]:
                    v[0] = common(text, tail[c], seeds[a : a + 1], cap)[0] if c in tail else 0
                _induce(text, s, seeds[a:b], v, False, queues, least, kind)
    queues.close()
    # Right scan: at each symbol its S-suffixes, then its L-suffixes, all descending.
    queues, least = Queues(queued), _Least(cap)
    end = np.array([len(text) - 1], kind)  # the last suffix has no inducer
    for c in reversed(waiting):
        before = None
        while (got := queues.pop(c)) is not None:
            p, v = got
            if before is None:
                v = v.copy()
                v[0] = 0
            before = p[-1:].copy()
            yield p, v
            _induce(text, s, p, v, True, queues, least, kind)
        if c == text[-1]:
            v = np.zeros(1, np.uint8) if before is None else common(text, before, end, cap)
            before = end
            yield end, v
            _induce(text, s, end, v, True, queues, least, kind)
        link = None  # common prefix of the last suffix yielded with the one before it in the left scan
        while (got := lefts.pop(c, last=True)) is not None:
            p, v = got[0][::-1], got[1][::-1]
            v, link = np.concatenate([[0 if link is None else link], v[:-1]]).astype(np.uint8), int(v[-1])
            if before is not None and p[0] == tail[c][0]:
                v[0] = common(text, before, p[:1], cap)[0]
            yield p, v
            _induce(text, s, p, v, True, queues, least, kind)
    queues.close()
    lefts.close()


def _symbols(text: np.ndarray) -> list[int]:
    found: set[int] = set()
    for at in range(0, len(text), 4 * BATCH):
        found.update(np.unique(text[at : at + 4 * BATCH]).tolist())
    return sorted(found)


def _seeded(text: np.ndarray, seeds: np.ndarray) -> dict[int, tuple[int, int]]:
    """Where the seeds of each first symbol stand."""
    out: dict[int, tuple[int, int]] = {}
    for at in range(0, len(seeds), BATCH):
        heads = text[seeds[at : at + BATCH]]
        cut = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]])).tolist()
        for a, b in zip(cut, [*cut[1:], len(heads)]):
            c = int(heads[a])
            out[c] = (out[c][0] if c in out else at + a, at + b)
    return out


def _induce(text, s, p, v, to_s: bool, queues: Queues, least: _Least, kind) -> None:
    where = np.flatnonzero(p > 0)
    before = p[where] - 1
    pick = s[before] == to_s
    where, before = where[pick], before[pick].astype(kind)
    least.push(queues, text[before], where, before, v)


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes of a string of names, by at least ``depth`` names."""
    n = len(names)
    rank, have = names.astype(np.int64), 1
    while True:
        nxt = np.zeros(n, np.int64)
        if have < n:
            nxt[:-have] = rank[have:] + 1
        key = rank * (int(rank.max()) + 2) + nxt
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        have *= 2
        if new[-1] == n - 1 or have >= depth:
            return order


def _names(text: np.ndarray, order: np.ndarray, lms: np.ndarray, memory: int) -> np.ndarray:
    """The name of the substring from each leftmost S-place to the next, by place; ``order`` has the
    places in order."""
    n, name = len(text), -1
    out = room(len(lms), np.int64, memory)
    for at in range(0, len(order), BATCH):
        part = np.asarray(order[max(at - 1, 0) : at + BATCH])
        index = np.searchsorted(lms, part)
        stop = np.where(index + 1 < len(lms), lms[np.minimum(index + 1, len(lms) - 1)], n)
        size = stop - part + 1
        a, b = part[:-1], part[1:]
        same = size[:-1] == size[1:]
        left = np.flatnonzero(same)
        k = 0
        while len(left):
            left = left[size[left] > k]
            x, y = a[left] + k, b[left] + k
            ok = (x < n) & (y < n)
            ok[ok] = text[x[ok]] == text[y[ok]]
            same[left[~ok]] = False
            left = left[ok]
            k += 1
        new = ~same if at else np.concatenate([[True], ~same])
        got = name + np.cumsum(new)
        out[index if not at else index[1:]] = got
        name = int(got[-1]) if len(got) else name
    return out


def _filled(parts, n: int, kind, memory: int) -> np.ndarray:
    """Parts one behind the other, from the end to the start."""
    out, at = room(n, kind, memory), n
    for p in parts:
        out[at - len(p) : at] = p[::-1]
        at -= len(p)
    return out


def descending(text: np.ndarray, cap: int, queued: int = QUEUED, base: int = BASE, memory: int = MEMORY):
    """Batches (positions, values) of all suffixes of ``text`` in descending order, by at least
    ``cap`` symbols; each value is the common prefix with the suffix before, up to cap.

    text: integers of 0 or more; the last is less than all others.
    """
    kind = np.int32 if len(text) < 2**31 else np.int64
    s = _types(text, memory)
    found = []
    for at in range(0, len(text), 4 * BATCH):
        part = s[max(at - 1, 0) : at + 4 * BATCH]
        found.append((np.flatnonzero(part[1:] & ~part[:-1]) + max(at - 1, 0) + 1).astype(kind))
    lms = _filled((p[::-1] for p in reversed(found)), sum(map(len, found)), kind, memory)
    del found
    if not len(lms):
        lms = np.array([len(text) - 1], kind)
    seeds = lms
    if len(lms) > 1:
        rough = room(len(lms), kind, memory)
        rough[:] = lms[np.argsort(text[lms], kind="stable")]
        rough_values = room(len(rough), np.uint8, memory)
        rough_values[:] = 0
        picked = (p[(p > 0) & s[p] & ~s[p - 1]] for p, _ in _scan(text, s, rough, rough_values, cap, queued))
        order = _filled(picked, len(lms), kind, memory)
        del rough, rough_values
        names = _names(text, order, lms, memory)
        if int(names.max()) + 1 == len(names):
            seeds = order
        elif len(names) <= base:
            seeds = lms[_doubled(names, cap)]
        else:
            below = room(len(names) + 1, np.int64, memory)
            below[:-1], below[-1] = names, 0
            below[:-1] += 1
            ranked = (lms[p[p < len(lms)]] for p, _ in descending(below, min(cap, 255), queued, base, memory))
            seeds = _filled(ranked, len(lms), kind, memory)
    values = room(len(seeds), np.uint8, memory)
    values[:1] = 0
    for at in range(1, len(seeds), BATCH):
        stop = min(at + BATCH, len(seeds))
        values[at:stop] = common(text, seeds[at - 1 : stop - 1], seeds[at:stop], cap)
    yield from _scan(text, s, seeds.astype(kind, copy=False), values, cap, queued)

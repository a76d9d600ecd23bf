"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

SPACE = re.compile("[\x20\x09-\x0d]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def suffix_dedup(docs, size=100):
    """{doc_id: (n_bytes, n_removed, n_spans, sha)} of [(doc_id, text)]."""
    first, rows = {}, sorted((i, (t or "").encode()) for i, t in docs)
    for i, b in rows:
        for k in range(len(b) - size + 1):
            first.setdefault(b[k : k + size], (i, k))
    out = {}
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if first[b[k : k + size]] != (i, k):
                gone[k : k + size] = b"\1" * size
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g)))
    return out


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def substring_dedup(docs, size=50):
    first, rows = {}, sorted((i, words(t)) for i, t in docs)
    for i, w in rows:
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    out = {}
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode()))
    return out


def simhash(docs, tau=4):
    """{doc_id: (fingerprint, component_id)}"""
    import xxhash

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fp = {}
    for i, t in docs:
        w = words((t or "").translate(lower))
        s = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        fp[i] = sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {f: f for f in fp.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    every = list(root)
    for a in range(len(every)):
        for b in range(a):
            if (every[a] ^ every[b]).bit_count() <= tau:
                root[find(every[a])] = find(every[b])
    least = {}
    for i, f in fp.items():
        least[find(f)] = min(i, least.get(find(f), i))
    return {i: (f"{f:016x}", least[find(f)]) for i, f in fp.items()}

"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier.

``anchored`` finds which stretches can repeat, and names segments that are equal byte for byte
(by a 128-bit digest) so that a copy follows the first of its name.  The different segments
around an anchor go to shards by anchor.  Each shard's segments form one text; its suffixes are
sorted by external induction with common-prefix values (``inducing``), and suffixes with 100
bytes in common are one string: all of its starts but the earliest are covered.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import inducing
from plumbline.llm.anchored import BYTES, COVER, Units, _groups, as_bytes, covers, repeated
from plumbline.llm.common import partitions, small_batches, table, written

#: Symbols that are sorted as one shard; a single anchor's segments stay together.
SHARD = 1 << 22
#: Segments of one anchor that are sorted together; those of more frequent ones are cut into
#: their windows, which go to shards by their content.
CROWD = 100_000
#: Windows held while equal ones are folded.
HELD = 1 << 18


def shard_text(segments: list[bytes], memory: int = inducing.MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """The segments as one string of symbols (bytes from 2, 1 after each segment, 0 at the
    end), and where each starts."""
    size = np.array([len(s) for s in segments])
    at = np.concatenate([[0], np.cumsum(size + 1)])
    text = inducing.room(int(at[-1]) + 1, np.int16, memory)
    for i in range(0, len(segments), 4096):
        part = np.frombuffer(b"\0".join(segments[i : i + 4096]) + b"\0", np.uint8).astype(np.int16) + 2
        text[at[i] : at[i] + len(part)] = part
    text[at[1:] - 1] = 1
    text[-1] = 0
    return text, at[:-1]


def covered_windows(docs: np.ndarray, los: np.ndarray, segments: list[bytes], size: int, **limits):
    """doc_id, lo, hi of the windows of ``size`` bytes in these segments that also start earlier, a
    frame for about HELD suffixes in whole runs of equal windows."""
    text, at = shard_text(segments, limits.get("memory", inducing.MEMORY))
    ends = np.concatenate([at[1:], [len(text) - 1]]) - 1

    def told(p: np.ndarray, number: np.ndarray):
        seg = np.searchsorted(at, p, side="right") - 1
        ok = p + size <= ends[seg]
        p, g, seg = p[ok], number[ok], seg[ok]
        doc, start = docs[seg], los[seg] + p - at[seg]
        o = np.lexsort((start, doc, g))
        doc, start, g = doc[o], start[o], g[o]
        first = _groups(g)
        later = (doc != doc[first]) | (start != start[first])
        out = pd.DataFrame({"doc_id": doc[later], "lo": start[later], "hi": start[later] + size})
        return covers(out)[["doc_id", "lo", "hi"]]

    held: list[np.ndarray] = []  # the last run, which may go on
    runs: list[tuple[np.ndarray, np.ndarray]] = []
    n, size_of_runs = 0, 0
    for p, v in inducing.descending(text, size, **limits):
        long = v >= size
        starts = np.flatnonzero(~long)
        if not len(starts):
            held.append(p)
            continue
        before = sum(map(len, held))
        p = np.concatenate([*held, p])
        long = np.concatenate([np.arange(before) > 0, long])
        last = before + int(starts[-1])
        held = [p[last:]]
        pick = long[:last].copy()
        pick[:-1] |= long[1:last]
        if pick.any():
            number = n + np.cumsum(~long[:last])
            runs.append((p[:last][pick], number[pick]))
            n, size_of_runs = int(number[-1]), size_of_runs + len(runs[-1][0])
        if size_of_runs >= HELD:
            yield told(*map(np.concatenate, zip(*runs)))
            runs, size_of_runs = [], 0
    p = np.concatenate(held)
    if len(p) > 1:
        runs.append((p, np.full(len(p), n + 1)))
    if runs:
        yield told(*map(np.concatenate, zip(*runs)))


def suffix_covers(docs: DataFrame, needs: DataFrame, size: int, crowd: int = CROWD) -> DataFrame:
    """doc_id, lo, hi of what the suffix arrays of the needed segments cover.

    An anchor of more than ``crowd`` segments would make one shard grow with the corpus.  Its
    segments are cut into windows, equal ones are folded in each task, and the rest is dealt
    by content: equal windows still meet in one suffix array.
    """
    n = partitions(docs.sparkSession)
    crowded = written(needs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("anchor"), "crowded-anchors")

    def wanted(rows: DataFrame) -> DataFrame:
        return docs.select("doc_id", "text").join(rows.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi", "anchor")).alias("wanted")), "doc_id")

    def cut(batches):
        for b in batches:
            rows = []
            for doc, text, wanted in zip(b["doc_id"], b["text"], b["wanted"]):
                data = as_bytes(text)
                rows += [(w["anchor"], doc, w["lo"], data[w["lo"] : w["hi"]]) for w in wanted]
            yield pd.DataFrame(rows, columns=["anchor", "doc_id", "lo", "segment"])

    def cut_windows(batches):
        first: dict[bytes, tuple[int, int]] = {}
        again: list[tuple[int, int]] = []

        def out():
            rows = [(int(np.frombuffer(hashlib.blake2b(w, digest_size=8).digest(), np.int64)[0]), doc, at, w) for w, (doc, at) in first.items()]
            rows += [(doc + at, doc, at, None) for doc, at in again]  # any place will do
            first.clear()
            again.clear()
            return pd.DataFrame(rows, columns=["anchor", "doc_id", "lo", "segment"])

        for b in batches:
            for doc, text, wanted in zip(b["doc_id"], b["text"], b["wanted"]):
                data = as_bytes(text)
                for at in {at for w in wanted for at in range(w["lo"], w["hi"] - size + 1)}:
                    window, here = data[at : at + size], (doc, at)
                    there = first.setdefault(window, here)
                    if there != here:
                        first[window] = min(there, here)
                        again.append(max(there, here))
                if len(first) + len(again) >= HELD:
                    yield out()
        if first or again:
            yield out()

    def of_shard(now: pd.DataFrame):
        return covered_windows(now["doc_id"].to_numpy(np.int64), now["lo"].to_numpy(np.int64), list(now["segment"]), size)

    def sort(batches):
        rows, total = [], 0
        for b in batches:
            known = b[b["segment"].isnull()]  # folded before
            if len(known):
                yield pd.DataFrame({"doc_id": known["doc_id"], "lo": known["lo"], "hi": known["lo"] + size})
            b = b[b["segment"].notnull()]
            if not len(b):
                continue
            rows.append(b)
            total += int(b["segment"].map(len).sum())
            if total >= SHARD:
                every = pd.concat(rows, ignore_index=True)
                ends = np.flatnonzero(every["anchor"].to_numpy() != every["anchor"].iloc[-1])
                if len(ends):
                    now = every.iloc[: ends[-1] + 1]
                    yield from of_shard(now)
                    every = every.iloc[ends[-1] + 1 :]
                rows, total = [every], int(every["segment"].map(len).sum())
        if rows:
            now = pd.concat(rows, ignore_index=True)
            yield from of_shard(now)

    kind = "anchor long, doc_id long, lo long, segment binary"
    if crowded.isEmpty():
        segments = wanted(needs).mapInPandas(cut, kind)
    else:
        segments = wanted(needs.join(crowded, "anchor", "left_anti")).mapInPandas(cut, kind)
        segments = segments.unionByName(wanted(needs.join(crowded, "anchor", "left_semi")).mapInPandas(cut_windows, kind))
    return segments.repartition(n, "anchor").sortWithinPartitions("anchor").mapInPandas(sort, "doc_id long, lo long, hi long")


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order; those that touch or overlap become one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for lo, hi in spans:
        out.append(data[at:lo])
        at = hi
    return b"".join([*out, data[at:]])


def with_covers(docs: DataFrame, found: DataFrame, name: str, on: str = "doc_id") -> DataFrame:
    """docs with a column ``name``, the covered stretches of each document, which ``on`` identifies."""
    per_doc = found.groupBy(F.col("doc_id").alias(on)).agg(F.collect_list(F.struct("lo", "hi")).alias(name))
    return docs.join(per_doc, on, "left")


def removed_spans(docs: DataFrame, units: Units = BYTES, crowd: int = CROWD) -> DataFrame:
    """doc_id, lo, hi: all stretches of bytes to remove, in pieces that may overlap."""
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    found = repeated(docs, units)
    told = found.where(F.col("kind") == COVER).select("doc_id", "lo", "hi")
    return told.unionByName(suffix_covers(docs, found.where(F.col("kind") != COVER), units.size, crowd))


def suffix_dedup(docs: DataFrame, units: Units = BYTES, crowd: int = CROWD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_text.

    A null or empty text keeps nothing and loses nothing.  Matches never cross documents.
    doc_id names a text: rows that repeat an id and its text count as one document and get
    equal results.  Rows with a null doc_id neither match nor lose anything.  ``kept_text`` is
    binary, since a cut may split a character.  Further columns are ignored.
    """

    def finish(batches):
        for b in batches:
            rows = []
            for doc, text, spans in zip(b["doc_id"], b["text"], b["spans"]):
                data = as_bytes(text)
                cut = joined([(s["lo"], s["hi"]) for s in spans]) if spans is not None else []
                rows.append((doc, len(data), sum(b - a for a, b in cut), len(cut), kept_bytes(data, cut)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_text"]).astype({"doc_id": "Int64"})

    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    return with_covers(docs, removed_spans(docs, units, crowd), "spans").mapInPandas(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_text binary")


def op1_suffix_dedup(spark, sf_dir):
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"))


#: On hexadecimal texts, two digits for each byte.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, i, substring(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win),
dup AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM ranked WHERE r > 1),
runs AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM dup),
spans AS (SELECT doc_id, run, min(i) AS lo, max(i) + 100 AS hi FROM runs GROUP BY doc_id, run),
edges AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS from_ FROM spans),
parts AS (SELECT e.doc_id, e.from_ AS place, substring(h, 2 * e.from_ + 1, 2 * (e.lo - e.from_)) AS t FROM edges e JOIN d USING (doc_id)
  UNION ALL SELECT d.doc_id, s.hi, substring(h, 2 * s.hi + 1) FROM d JOIN (SELECT doc_id, max(hi) AS hi FROM spans GROUP BY doc_id) s USING (doc_id)),
kept AS (SELECT doc_id, string_agg(t, '' ORDER BY place) AS t FROM parts GROUP BY doc_id),
removed AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(r.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.t, d.h))) AS kept_sha256
FROM d LEFT JOIN removed r USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

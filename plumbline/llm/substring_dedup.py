"""Substring dedup of words: a log-structured index of window fingerprints.

Of every 50 consecutive words a smaller window, the anchor, is chosen by its content
(``anchored``); the index holds the fingerprints of these windows and of the segments around
them, in sorted immutable runs, one for each batch of documents.  A new batch is merge-joined
with the runs, read chunk by chunk in order of their key, and with itself.  Its anchors that
meet no others end there.  A segment that equals an older one byte for byte is covered.  Where
segments of an anchor differ, their windows of 50 words are verified: windows are equal by a
128-bit digest of their words.  The batch's new fingerprints become one more run; several runs of
about a size are compacted into one of the next, so that a fingerprint is rewritten as often as the number of
batches has digits.  Runs are dealt into more buckets as the index grows.

An index that has a folder can be opened again later, and tells what a further batch repeats.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.anchored import AGAIN, COVER, CROWDED, FOUND, HELD, NEED, OLD, SENT, WORDS, Units, _groups, _together, as_bytes, covers, dealt, digests, merged, met, sent_anchors, sent_frame
from plumbline.llm.common import drop_written, fresh, numbered, partitions, small_batches, table, written
from plumbline.llm.suffix_dedup import joined, with_covers
from plumbline.sources.tables import deleted

#: Batches that a whole table is taken in, runs of a level that are compacted into one of the next, and entries of
#: a bucket from which on there are more buckets.
BATCHES, FANOUT, GROWN = 3, 2, 1 << 23
WINDOW = {"d0": "<u8", "d1": "<u8", "doc": "<i8", "pos": "<i4"}
RUN = "bucket int, low long, n int, blob binary"


class FingerprintIndex:
    """Sorted immutable runs of fingerprints, as tables: in ``folder``, with the texts that verification
    reads and a manifest, or else in the shared folder for this session alone."""

    def __init__(self, spark: SparkSession, units: Units = WORDS, fanout: int = FANOUT, folder: str | None = None):
        self.spark, self.units, self.fanout, self.folder = spark, units, fanout, folder
        self.runs: list[DataFrame] = []
        #: What deletes the tables of these runs, where they aren't kept; how often each was compacted and its entries
        #: then (0 for one that wasn't); and what all compactions wrote.
        self.drops: list[Callable[[], None]] = []
        self.levels: list[int] = []
        self.sizes: list[int] = []
        self.rewritten = 0
        self.buckets, self.version = partitions(spark), 0
        self.paths: dict[str, list[str]] = {"runs": [], "texts": [], "crowds": []}
        #: Runs that a manifest to come will no longer name.
        self.replaced: list[str] = []

    @classmethod
    def open(cls, spark: SparkSession, folder: str, units: Units = WORDS, fanout: int = FANOUT) -> FingerprintIndex:
        """The index as it was after its last batch."""
        index = cls(spark, units, fanout, folder)
        last = spark.read.json(f"{folder}/manifest-*").orderBy(F.desc("version")).first()
        index.version, index.buckets = last["version"], last["buckets"]
        index.paths = {k: list(last[k]) for k in index.paths}
        index.runs = [spark.read.schema(RUN).parquet(p) for p in index.paths["runs"]]
        index.drops, index.levels, index.sizes = [lambda: None] * len(index.runs), list(last["levels"]), list(last["sizes"])
        return index

    def _kept(self, df: DataFrame, kind: str) -> DataFrame:
        if self.folder is None:
            return written(df, kind)
        path = f"{self.folder}/{kind}-{uuid.uuid4().hex}"
        df.write.parquet(path, compression="zstd")
        self.paths[kind].append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete the runs of an index that isn't kept."""
        for f in self.drops:
            f()
        self.runs, self.drops, self.levels, self.sizes = [], [], [], []

    def add(self, sent: DataFrame, last: bool = False) -> DataFrame:
        """FOUND rows of a batch of ``sent_anchors``; then the batch's fingerprints are in the index.  Behind
        the ``last`` batch of an index that isn't kept, runs need no compaction."""
        n, across = self.buckets, self.units.across

        def frame(x: pd.DataFrame) -> pd.DataFrame:
            return x.assign(bucket=np.int32(0), low=np.int64(0), n=np.int32(0), blob=None)

        def merge(batches):
            found: list = []
            for c in merged(batches, found):
                for x in met(c, across):
                    if isinstance(x, pd.DataFrame):
                        yield frame(x)
                    elif len(x["doc"]):
                        chunks = [(bucket, low, int(np.frombuffer(blob, np.int64, 1)[0]), blob) for bucket, low, blob in dealt(x, n, run=True)]
                        out = pd.DataFrame(chunks, columns=["bucket", "low", "n", "blob"]).reindex(columns=[*(x.split()[0] for x in f"{FOUND}, {RUN}".split(", "))])
                        yield out.astype({**{x: "Int64" for x in ("doc_id", "lo", "hi", "pos", "anchor")}, "kind": "Int8", "bucket": "int32", "n": "int32"})
            yield from map(frame, found)

        every = sent
        for r in self.runs:
            nulls = [F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in FOUND.split(", "))]
            every = every.unionByName(r.select(F.lit(0).alias("batch"), "bucket", "low", F.lit(True).alias("old"), "blob", *nulls))
        out = every.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "low").mapInPandas(merge, f"{FOUND}, {RUN}")
        out = written(out.withColumn("is_run", F.col("blob").isNotNull().cast("int")), "met", by=("is_run",))
        run = out.where("is_run = 1").select("bucket", "low", "n", "blob")
        self.runs.append(run if self.folder is None else self._kept(run, "runs"))
        self.drops.append(lambda: drop_written(out, "is_run=1"))
        self.levels.append(0)
        self.sizes.append(0)
        if not last:
            self.compact()
        return out.where("is_run = 0").select(*[x.split()[0] for x in FOUND.split(", ")])

    def compact(self) -> None:
        """Merge the runs of a level into one of the next, from the lowest on, wherever there are ``fanout``."""
        level = 0
        while self.levels.count(level) >= self.fanout:
            self._merge([i for i, x in enumerate(self.levels) if x == level], level + 1)
            level += 1

    def _merge(self, which: list[int], level: int) -> None:
        """Replace these runs by one of this level; all of them, where the index has grown out of its buckets."""

        def union(of: list[int]) -> DataFrame:
            rows = self.runs[of[0]]
            for i in of[1:]:
                rows = rows.unionByName(self.runs[i])
            return rows

        rows = union(which)
        size = rows.agg(F.sum("n")).first()[0] or 0
        total = size + sum(x for i, x in enumerate(self.sizes) if i not in which)
        n = self.buckets
        while total > n * GROWN:
            n *= 2
        if n != self.buckets:
            which, size, level = list(range(len(self.runs))), total, max(level, *self.levels)
            rows = union(which)

        def split(batches):  # each bucket into those that take its place
            for b in batches:
                for blob in b["blob"]:
                    for c in merged([pd.DataFrame({"low": [0], "old": [False], "blob": [blob]})], []):
                        yield pd.DataFrame([(*x, False) for x in dealt(c, n, run=True)], columns=["bucket", "low", "blob", "old"])

        def merge(batches):
            for c in merged(batches, []):
                o = np.lexsort((c["doc"], c["right"] == 0, c["d1"], c["d0"], c["anchor"]))
                c = {k: v[o] for k, v in c.items()}
                head = _groups(c["anchor"], c["d0"], c["d1"], c["right"] == 0) == np.arange(len(o))
                chunks = [(bucket, low, int(np.frombuffer(blob, np.int64, 1)[0]), blob) for bucket, low, blob in dealt({k: v[head] for k, v in c.items()}, n, run=True)]
                yield pd.DataFrame(chunks, columns=["bucket", "low", "n", "blob"]).astype({"bucket": "int32", "n": "int32"})

        kind = "bucket int, low long, old boolean, blob binary"
        rows = rows.select("bucket", "low", F.lit(False).alias("old"), "blob") if n == self.buckets else rows.select("blob").mapInPandas(split, kind)
        self.buckets = n
        run = self._kept(rows.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "low").mapInPandas(merge, RUN), "runs")
        self.rewritten += size
        for i in which:
            self.drops[i]()
        rest = [i for i in range(len(self.runs)) if i not in which]
        if self.folder is not None:
            paths = self.paths["runs"]
            self.replaced += [paths[i] for i in which]
            self.paths["runs"] = [paths[i] for i in rest] + paths[-1:]
        self.runs = [self.runs[i] for i in rest] + [run]
        self.drops = [self.drops[i] for i in rest] + [(lambda: drop_written(run)) if self.folder is None else (lambda: None)]
        self.levels, self.sizes = [self.levels[i] for i in rest] + [level], [self.sizes[i] for i in rest] + [size]

    def removed(self, docs: DataFrame) -> DataFrame:
        """doc_id, lo, hi: the words of a further batch that repeat windows of documents added before, or
        of the batch's documents of smaller doc_id.  Then the batch is in the index, and in its folder."""
        if self.folder is None:
            raise ValueError("an index that takes one batch after another needs a folder")
        docs = docs.select("doc_id", "text").where("doc_id is not null")
        small_batches(self.spark)
        sent = written(sent_anchors(docs, self.units, self.buckets), "sent")
        found = written(self.add(sent), "found")
        kind = F.col("kind")
        new, old = found.where(kind.isin(NEED, CROWDED)), found.where(kind.isin(OLD, AGAIN))
        for path in self.paths["crowds"]:
            old = old.unionByName(self.spark.read.schema(found.schema).parquet(path).join(new.select("anchor").distinct(), "anchor", "left_semi").select(*found.columns))
        rows = windows(docs, new, self.units, self.buckets)
        for path in self.paths["texts"]:
            rows = rows.unionByName(windows(self.spark.read.schema(docs.schema).parquet(path), old, self.units, self.buckets, True))
        told = found.where(kind == COVER).select("doc_id", "lo", "hi").unionByName(verified(rows, self.units, self.buckets))
        told = written(told, "told")
        self._kept(docs, "texts")
        self._kept(found.where(kind == CROWDED), "crowds")
        self.version += 1
        state = (self.version, self.buckets, self.levels, self.sizes, *self.paths.values())
        self.spark.createDataFrame([state], "version int, buckets int, levels array<int>, sizes array<long>, runs array<string>, texts array<string>, crowds array<string>").coalesce(1).write.json(f"{self.folder}/manifest-{self.version}")
        for path in self.replaced:
            deleted(self.spark, path)
        self.replaced = []
        return told


def by_digest(c: dict) -> np.ndarray:
    return c["d0"] >> np.uint64(1)


def _later(c: dict) -> tuple[dict, np.ndarray]:
    """Windows in order, and which of them an earlier document holds too."""
    o = np.lexsort((c["pos"], c["doc"], *([~c["old"]] if "old" in c else []), c["d1"], c["d0"]))
    c = {k: v[o] for k, v in c.items()}
    first = _groups(c["d0"], c["d1"])
    later = c["doc"] > c["doc"][first]
    return c, ~c["old"] & (later | c["old"][first]) if "old" in c else later


def _rows(c: dict, which: np.ndarray, size: int) -> pd.DataFrame:
    pos = c["pos"][which].astype(np.int64)
    return covers(pd.DataFrame({"doc_id": c["doc"][which], "lo": pos, "hi": pos + size, "pos": pos, "anchor": np.int64(0), "kind": np.int8(COVER)}))


def windows(docs: DataFrame, needs: DataFrame, units: Units, buckets: int, old: bool = False) -> DataFrame:
    """The windows in the needed stretches, in chunks by ranges of their digest (SENT and FOUND).

    Of equal windows in one task only those of its smallest document travel on.
    """
    wanted = needs.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("wanted"))

    def find(batches):
        held, size = [], 0

        def flush():
            c, later = _later(_together(held))
            done = [_rows(c, later, units.size)] if later.any() and not old else []
            c = {k: v[~later] for k, v in c.items()}
            out = sent_frame([(0, *x) for x in dealt(c, buckets, WINDOW, by_digest)], done, buckets)
            return out.assign(old=old)

        for b in batches:
            for doc, text, wanted in zip(b["doc_id"], b["text"], b["wanted"]):
                words = as_bytes(text).split()
                start = np.zeros(len(words) + 1, np.int32)
                for w in wanted:
                    start[w["lo"]] += 1
                    start[w["hi"] - units.size + 1] -= 1
                pos = np.flatnonzero(np.cumsum(start)[:-1] > 0)
                stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                starts = np.concatenate([[0], stops[:-1] + 1])
                marks = digests(b" ".join(words), starts[pos], stops[pos + units.size - 1])
                held.append({"d0": marks[:, 0], "d1": marks[:, 1], "doc": np.full(len(pos), doc, np.int64), "pos": pos.astype(np.int32)})
                size += len(pos)
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return docs.select("doc_id", "text").join(wanted, "doc_id").mapInPandas(find, f"{SENT}, {FOUND}")


def verified(rows: DataFrame, units: Units, buckets: int) -> DataFrame:
    """doc_id, lo, hi of the windows that an earlier document holds too, word for word."""

    def merge(batches):
        found: list = []
        for c in merged(batches, found, WINDOW, by_digest):
            c, later = _later(c)
            if later.any():
                yield _rows(c, later, units.size)
        yield from found

    rows = rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "low")
    return rows.mapInPandas(merge, FOUND).select("doc_id", "lo", "hi")


def removed_words(docs: DataFrame, units: Units = WORDS, batches: int = BATCHES) -> DataFrame:
    """doc_id, lo, hi: stretches of words to remove, in pieces that may overlap.

    The table goes through an index in batches that are ranges of doc_id, so that each meets only
    earlier documents there; the windows that all batches ask for are verified in one pass."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    cuts = sorted({int(x) for x in docs.select("doc_id").approxQuantile("doc_id", [(i + 1) / batches for i in range(batches - 1)], 0.01)}) if batches > 1 else []
    index = FingerprintIndex(spark, units)
    sent = written(sent_anchors(docs, units, index.buckets, cuts), "sent", by=("batch",))
    # Batch -1 is what tasks have found out before.
    found = written(sent.where("batch = -1").select(*[x.split()[0] for x in FOUND.split(", ")]), "found")
    for i in range(len(cuts) + 1):
        found = found.unionByName(index.add(sent.where(F.col("batch") == i), i == len(cuts)))
    drop_written(sent)
    index.drop()
    needs = found.where((F.col("kind") != COVER) & (F.col("kind") != AGAIN))
    told = verified(windows(docs, needs, units, index.buckets), units, index.buckets)
    return found.where(F.col("kind") == COVER).select("doc_id", "lo", "hi").unionByName(told)


def kept_words(words: list[bytes], spans) -> list[bytes]:
    kept, at = [], 0
    for lo, hi in joined([(s["lo"], s["hi"]) for s in spans]) if spans is not None else []:
        kept += words[at:lo]
        at = hi
    return kept + words[at:]


def without_passages(docs: DataFrame, units: Units = WORDS, batches: int = BATCHES) -> DataFrame:
    """The rows of ``docs`` in all columns; ``text`` without repeated passages, and ``n_chars``, if
    there is one, of the new text.  Texts that lose nothing stay as they are.  Rows that share a doc_id and
    differ in their text are documents of their own, in order of their text's hash; rows that repeat in
    full get equal results.  Null texts, and rows with a null doc_id, stay as they are."""
    small_batches(docs.sparkSession)
    names, extra, number = docs.columns, fresh(docs, "spans"), fresh(docs, "number")

    def run(batches):
        for b in batches:
            table = pa.Table.from_batches([b])
            spans, texts = table.column(extra).to_pylist(), table.column("text").to_pylist()
            new = [b" ".join(kept_words(as_bytes(t).split(), s)).decode("utf-8", "surrogatepass") if s else t for t, s in zip(texts, spans)]
            for name, values in (("text", new), ("n_chars", [len(t) if s else None for t, s in zip(new, spans)])):
                if name in names:
                    at, kind = names.index(name), table.schema.field(name).type
                    old = table.column(name).to_pylist() if name == "n_chars" else new
                    table = table.set_column(at, name, pa.array([o if v is None else v for v, o in zip(values, old)], kind))
            yield from table.select(names).to_batches()

    rows = numbered(docs, number)
    told = removed_words(rows.select(F.col(number).alias("doc_id"), "text"), units, batches)
    return with_covers(rows, told, extra, number).select(*[F.col(f"`{x}`") for x in (*names, extra)]).mapInArrow(run, docs.schema)


def substring_dedup(docs: DataFrame, units: Units = WORDS, batches: int = BATCHES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text.

    A word is removed where a window of 50 words around it also starts in a document with a
    smaller doc_id.  Kept words are joined by one space.  Null texts have no words; texts of
    fewer than 50 words lose nothing.  doc_id names a text; repeated rows get equal results.
    Rows with a null doc_id neither match nor lose anything.  Further columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")

    def finish(batches):
        for b in batches:
            rows = []
            for doc, text, spans in zip(b["doc_id"], b["text"], b["spans"]):
                words = as_bytes(text).split()
                kept = kept_words(words, spans)
                rows.append((doc, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_text"]).astype({"doc_id": "Int64"})

    return with_covers(docs, removed_words(docs, units, batches), "spans").mapInPandas(finish, "doc_id long, n_words long, n_removed long, kept_text string")


def op2_substring_dedup(spark, sf_dir):
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
least_doc AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
dup AS (SELECT win.doc_id, i FROM win JOIN least_doc USING (s) WHERE m < win.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM dup),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM w WHERE len(w) > 0),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY k) AS t, count(*) AS n FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.k = gone.k GROUP BY word.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

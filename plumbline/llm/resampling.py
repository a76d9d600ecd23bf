"""Target-distribution importance resampling with a dictionary of distinct features.

Features are runs of one to three words.  Texts are encoded in chunks of some megabytes.  The
distinct features of a chunk go with their counts to the parts of a dictionary, dealt by what they say, so
that each part meets a string from all chunks, counts it for the corpus and for the target, and hashes it
once.  The parts' sums by bucket are added up; what comes to the driver is one number for each bucket.  Each
part also tells every chunk the buckets of the strings it sent, in their order, and chunks join the buckets' gains
to their documents' feature counts.  Chunks are encoded again for that, instead of being kept: a table is read
in the same order each time, other plans are written first, and a chunk that isn't the same as before is an error.

Strings of a chunk travel as a trie: first words, their second words, their third words; what is frequent in a
chunk is sent once, so a word or passage that a third of all rows hold reaches its part once for each chunk.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WORDS, partitions, ship, table, written
from plumbline.llm.merkle import CRC_OF_BYTES, CRC_TABLE
from plumbline.llm.rolling import mixed

#: Bytes of text in a chunk (a longer text is one of its own), features that a part of the dictionary gets on
#: average from all chunks before they are folded, at most, and strings that are hashed at once.
CHUNK, PART, SLICE = 6 << 20, 4_000_000, 1 << 16
#: Tasks over which the parts' sums by bucket are dealt before they are added up.
SUMS = 16
BINARY = pa.large_binary()


def packed(value) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(value, 5))


def unpacked(blob: bytes):
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def strings_out(a: pa.Array) -> tuple[np.ndarray, bytes]:
    """Lengths and joined bytes of a binary array."""
    a = pa.concat_arrays([a])  # without an offset
    edges = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1) if len(a) else np.zeros(1, np.int64)
    data = a.buffers()[2] if len(a) else None
    return np.diff(edges).astype(np.uint32), data[int(edges[0]) : int(edges[-1])].to_pybytes() if data is not None else b""


def strings_in(lengths: np.ndarray, data: bytes) -> pa.Array:
    edges = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return pa.Array.from_buffers(BINARY, len(lengths), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)])


def spaced(a: pa.Array) -> bytes:
    """Words, each with a space behind it, which compress better than words and their lengths."""
    return strings_out(joined_words(a, pa.scalar(b"", BINARY)))[1]


def unspaced(data: bytes) -> pa.Array:
    letters = np.frombuffer(data, np.uint8)
    return strings_in(np.diff(np.flatnonzero(letters == 32), prepend=-1) - 1, letters[letters != 32].tobytes())


def narrow(n: np.ndarray) -> np.ndarray:
    return n.astype(np.min_scalar_type(int(n.max(initial=0))))


def given_back() -> None:
    """In a worker: memory that is free again goes back to the system.  Workers wait for further tasks side by side, and
    each would hold what its largest chunk or part took."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def large_ones_mapped() -> None:
    """In a worker: arrays of 256 KB or more have pages of their own, which go back to the system when they do."""
    import ctypes

    if set_option := getattr(ctypes.CDLL(None), "mallopt", None):
        set_option(-3, 1 << 18)  # M_MMAP_THRESHOLD


def joined_words(*columns: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(*columns, pa.scalar(b" ", BINARY))


def encoded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, bytes]]:
    """Words of each text, ids of all words by falling frequency, and the words."""
    lines = pa.array([t.translate(WORDS).strip() for t in texts], BINARY).view(pa.large_string())
    split = pc.ascii_split_whitespace(lines)
    counts, words = np.diff(np.asarray(split.offsets)), split.flatten()
    empty = np.asarray(pc.equal(pc.binary_length(lines), 0))
    if empty.any():  # an empty text splits into one empty word
        words = words.filter(pc.not_equal(pc.binary_length(words), 0))
        counts = np.where(empty, 0, counts)
    coded = words.view(BINARY).dictionary_encode()
    ids = np.asarray(coded.indices).astype(np.int64)
    order = np.argsort(-np.bincount(ids, minlength=len(coded.dictionary)), kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    return counts.astype(np.uint32), rank[ids], strings_out(coded.dictionary.take(pa.array(order)))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order, which of them each key is, and how often each occurs."""
    order = np.argsort(keys)
    ordered = keys[order]
    head = np.ones(len(keys), bool)
    head[1:] = ordered[1:] != ordered[:-1]
    inverse = np.empty(len(keys), np.int32)
    inverse[order] = np.cumsum(head, dtype=np.int32) - np.int32(1)
    del order
    at = np.flatnonzero(head)
    return ordered[at], inverse, np.diff(np.append(at, len(keys)))


class Chunk:
    """The features of some documents: distinct ones by number of words, and the parts of the dictionary."""

    def __init__(self, blob: bytes, parts: int):
        import xxhash

        self.ids, counts, ranks, words = unpacked(blob)
        self.counts, u, self.words = counts.astype(np.int64), ranks.astype(np.int32), strings_in(*words)
        v = max(len(self.words), 1)
        doc = np.repeat(np.arange(len(counts), dtype=np.int32), self.counts)
        two = doc[1:] == doc[:-1]
        del doc
        three = two[1:] & two[:-1]
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in self.words.to_numpy(zero_copy_only=False)], np.uint64)
        pairs, of_pair, n_pairs = distinct((u[:-1].astype(np.int64) * v + u[1:])[two])
        self.first, self.second = (pairs // v).astype(np.int32), (pairs % v).astype(np.int32)
        before = of_pair[(np.cumsum(two, dtype=np.int32) - 1)[:-1][three]]
        triples, of_triple, n_triples = distinct(before.astype(np.int64) * v + u[2:][three])
        del before
        self.pair, self.third = (triples // v).astype(np.int32), (triples % v).astype(np.int32)
        self.at = [(None, u), (two, of_pair), (three, of_triple)]
        self.n = [np.bincount(u, minlength=len(self.words)), n_pairs, n_triples]
        low, small = np.uint64(max(parts, 1)), np.uint16 if parts < 1 << 16 else np.uint32  # short ones sort by radix
        part_of_pair = (mixed(hashes[self.first] * np.uint64(3) + hashes[self.second]) % low).astype(small)
        part = [(hashes % low).astype(small), part_of_pair, part_of_pair[self.pair]]
        # Features by part, in order within it, and where each part ends.
        self.by_part = [np.argsort(p, kind="stable").astype(np.int32) for p in part]
        self.edges = [np.concatenate([[0], np.cumsum(np.bincount(p, minlength=parts))]) for p in part]

    def of_part(self, p: int) -> list[np.ndarray]:
        return [order[edges[p] : edges[p + 1]] for order, edges in zip(self.by_part, self.edges)]

    def request(self, p: int) -> bytes | None:
        """The strings of a part and their counts."""
        one, two, three = self.of_part(p)
        if not len(one) + len(two):
            return None
        firsts, _, n_second = distinct(self.first[two])
        n_third = np.bincount(np.searchsorted(two, self.pair[three]), minlength=len(two))
        words = [spaced(self.words.take(pa.array(i))) for i in (one, firsts, self.second[two], self.third[three])]
        counts = np.concatenate([n[i] for n, i in zip(self.n, (one, two, three))])
        return packed((words, narrow(n_second), narrow(n_third), narrow(counts)))

    def weights(self, buckets: dict[int, np.ndarray], gains: np.ndarray) -> np.ndarray:
        """Sums of gains over the features of each document; ``buckets``: what the parts reply."""
        gain = [np.zeros(len(n), np.int64) for n in self.n]
        for p, told in buckets.items():
            mine, at = self.of_part(p), 0
            for g, i in zip(gain, mine):
                g[i] = gains[told[at : at + len(i)]]
                at += len(i)
        each = np.zeros(int(self.counts.sum()), np.int64)
        for (whether, which), g in zip(self.at, gain):
            where = slice(None) if whether is None else np.flatnonzero(whether)
            each[where] += g[which]
        total = np.concatenate([[0], np.cumsum(each)])
        ends = np.cumsum(self.counts)
        return total[ends] - total[ends - self.counts]


def strings_of(blob: bytes) -> tuple[pa.Array, np.ndarray]:
    """The strings of a request and their counts."""
    words, n_second, n_third, counts = unpacked(blob)
    one, first, second, third = map(unspaced, words)
    two = joined_words(first.take(pa.array(np.repeat(np.arange(len(n_second)), n_second))), second)
    three = joined_words(two.take(pa.array(np.repeat(np.arange(len(n_third)), n_third))), third)
    return pa.concat_arrays([one, two, three]), counts.astype(np.int64)


def merged(rows: Iterable, buckets: int) -> Iterator[tuple]:
    """One part of the dictionary: the senders of its requests, their counts, and the buckets of their strings, each
    distinct string hashed once."""
    senders, strings, counts = [], [], []
    for _, (place, target, blob) in rows:
        s, n = strings_of(blob)
        senders.append((place, target))
        strings.append(s)
        counts.append(n)
    if not senders:
        return
    coded = pa.concat_arrays(strings).dictionary_encode()
    strings.clear()
    names = coded.dictionary
    bucket = np.empty(len(names), np.int64)
    for k in range(0, len(names), SLICE):
        bucket[k : k + SLICE] = [crc32(x) % buckets for x in names[k : k + SLICE].to_numpy(zero_copy_only=False)]
    which, at = np.asarray(coded.indices), 0
    for (place, target), n in zip(senders, counts):
        yield place, target, n, bucket[which[at : at + len(n)]]
        at += len(n)


def bucket_gains(sums: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over its share in the corpus, one added to each count."""
    buckets = sums.shape[1]
    s, t = (int(x) for x in sums.sum(axis=1))
    return np.array([math.floor(1000 * math.log((b + 1) * (s + buckets) / ((a + 1) * (t + buckets)))) for a, b in sums.T.tolist()], np.int64)


def chunking(most: int):
    """A function from rows (doc_id, text, whether it is of the target) to chunks of ``most`` bytes: whether it is of the
    target, ids, texts.  It refers to nothing of this module, so a worker that only gathers loads no library."""

    def chunks(rows):
        ids, texts, size, goal = [], [], 0, False
        for i, text, is_target in rows:
            data = (text or "").encode("utf-8", "surrogatepass")
            if ids and (is_target != goal or size + len(data) > most):
                yield goal, ids, texts
                ids, texts, size = [], [], 0
            goal = is_target
            ids.append(i)
            texts.append(data)
            size += len(data) + 16
        if ids:
            yield goal, ids, texts

    return chunks


def _rows(docs: DataFrame, target: DataFrame, empty: int = 0) -> RDD:
    """doc_id, text and whether it is of the target of both tables, then so many empty partitions.  As an RDD, so that one
    Python worker encodes texts and makes requests of them."""

    def rows(df: DataFrame, goal: bool) -> DataFrame:
        i = F.col("doc_id").cast("long") if not goal else F.lit(None).cast("long")
        return df.select(i.alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(goal).alias("target"))

    both = rows(docs, False).unionByName(rows(target, True))
    if empty:
        none = docs.sparkSession.range(0, empty, 1, empty).where("id < 0")
        both = both.unionByName(none.select(F.col("id").alias("doc_id"), F.lit("").alias("text"), F.lit(False).alias("target")))
    return both.rdd


def _as_table(df: DataFrame) -> DataFrame:
    """df, written unless it is read from files in a fixed order."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return df if "FileScan" in plan and not any(x in plan for x in ("Exchange", "Join", "Python", "Pandas", "Arrow", "Limit")) else written(df, "texts")


def weighed(docs: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row of ``docs``, written."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    ship(spark)
    docs, target = _as_table(docs.select("doc_id", "text")), _as_table(target.select("text"))
    size = sum(df.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0] for df in (docs, target))
    # A word and the space behind it take some six bytes and make three features.
    parts = max(partitions(spark), -(-size // (2 * PART)))
    source, chunks = _rows(docs, target), chunking(CHUNK)
    n, n_sums = max(source.getNumPartitions(), 1), min(SUMS, parts)

    def requests(pid: int, rows: Iterable) -> Iterator[tuple]:
        large_ones_mapped()
        for k, (goal, ids, texts) in enumerate(chunks(rows)):
            blob = packed((ids, *encoded(texts)))
            texts.clear()
            chunk, check = Chunk(blob, parts), crc32(blob)
            for p in range(parts):
                if (sent := chunk.request(p)) is not None:
                    yield p, ((pid, k, p, check), goal, sent)
            del chunk
            given_back()

    def replies(part: int, rows: Iterable) -> Iterator[tuple]:
        """To each chunk's partition its buckets; to those behind, the sums."""
        large_ones_mapped()
        small, sums = np.min_scalar_type(buckets), np.zeros((2, buckets), np.int64)
        for (pid, k, p, check), goal, counts, bucket in merged(rows, buckets):
            np.add.at(sums[int(goal)], bucket, counts)
            if not goal:
                yield pid, (k, p, check, packed(bucket.astype(small)))
        given_back()
        if sums.any():
            yield n + part % n_sums, sums

    told = source.mapPartitionsWithIndex(requests).partitionBy(parts, lambda p: p).mapPartitionsWithIndex(replies).partitionBy(n + n_sums, lambda pid: pid)
    all_sums = told.mapPartitionsWithIndex(lambda pid, rows: (x for _, x in rows) if pid >= n else iter(()))
    gains = sc.broadcast(bucket_gains(all_sums.treeAggregate(np.zeros((2, buckets), np.int64), np.add, np.add)))

    def gathered(rows):
        yield list(rows)

    def held(rows):  # light as well: texts are encoded where the answers are joined
        import pickle
        import zlib

        yield [None if goal else zlib.compress(pickle.dumps((ids, texts), 5), 1) for goal, ids, texts in chunks(rows)]

    def weigh(pair) -> Iterator[tuple]:
        import zlib

        large_ones_mapped()
        rows, answers = pair
        by_chunk: dict[int, dict[int, bytes]] = {}
        for _, answer in answers:
            if isinstance(answer, tuple):
                k, p, check, blob = answer
                by_chunk.setdefault(k, {})[p] = blob
                by_chunk[k][-1] = check
        answers.clear()
        for k, kept in enumerate(rows):
            if kept is not None:
                ids, texts = pickle.loads(zlib.decompress(kept))
                rows[k] = kept = None
                blob = packed((ids, *encoded(texts)))
                del texts
                known = by_chunk.pop(k, {})
                if known.pop(-1, crc32(blob)) != crc32(blob):
                    raise ValueError("the texts of a task came in another order than before")
                chunk = Chunk(blob, parts)
                got = chunk.weights({p: unpacked(x) for p, x in known.items()}, gains.value)
                counts = chunk.counts.tolist()
                del chunk, known
                given_back()
                for i, words, w in zip(ids, counts, got.tolist()):
                    yield i, words, words + max(words - 1, 0) + max(words - 2, 0), w

    # Partitions of both sides in the same number: behind the chunks' there are those of the sums.
    more = told.getNumPartitions() - source.getNumPartitions()
    rows = _rows(docs, target, more).mapPartitions(held).zip(told.mapPartitions(gathered)).flatMap(weigh)
    return written(spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long", verifySchema=False), "weights")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, least: int = 20, buckets: int = 10_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, score, rank.

    Of the N texts of at least ``least`` words the floor(percent * N / 100) highest scores are drawn: the weight plus
    Gumbel noise that follows from the seed and the id, ties to the smaller id (null last).  ``rank`` counts them
    from 1 and is null for the others.  Null and empty texts have no features and the weight 0, as has everything
    where both tables are empty of words.  Repeated rows have equal scores and ranks of their own; the noise of a null
    id is that of an empty one.  Further columns are ignored.
    """
    spark = docs.sparkSession
    rows = weighed(docs, target, buckets)
    drawn = percent * rows.where(F.col("n_words") >= least).count() // 100
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = rows.withColumn("score", F.col("weight") + noise)
    order = scored.orderBy(F.col("n_words") < least, F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = order.rdd.zipWithIndex().map(lambda x: (*x[0], x[1] + 1 if x[1] < drawn else None))
    return spark.createDataFrame(ranked, "doc_id long, n_words long, n_features long, weight long, score long, rank long", verifySchema=False)


def op13_resampling(spark, sf_dir):
    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_BYTES = "list_transform(range(strlen(f)), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT))"
_FEATURES = """SELECT {id} AS doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f
  FROM (SELECT *, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {of})"""
ORACLE = f"""
WITH {CRC_TABLE},
mine AS MATERIALIZED (SELECT doc_id, f, count(*) AS n FROM ({_FEATURES.format(id="doc_id", of="documents")}) GROUP BY ALL),
goal AS (SELECT f, count(*) AS n FROM ({_FEATURES.format(id="0", of="benchmark")}) GROUP BY ALL),
every AS (SELECT f, sum(s) AS s, sum(g) AS goal FROM (SELECT f, n AS s, 0 AS g FROM mine UNION ALL SELECT f, 0, n FROM goal) GROUP BY f),
named AS MATERIALIZED (SELECT f, s, goal AS t, {CRC_OF_BYTES.format(bytes=_BYTES)} % 10000 AS b FROM every, crc),
sums AS (SELECT b, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM named GROUP BY b),
gains AS (SELECT b, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000)))) AS BIGINT) AS g FROM sums),
weights AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * g) AS BIGINT) AS weight, CAST(sum(n) FILTER (WHERE NOT contains(f, ' ')) AS BIGINT) AS n_words
  FROM mine JOIN named USING (f) JOIN gains USING (b) GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(n_words, 0) AS n_words,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (ORDER BY n_words < 20, score DESC, doc_id) AS k FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= (SELECT count(*) FROM scored WHERE n_words >= 20) * 5 // 100 THEN k END AS rank FROM ranked
"""

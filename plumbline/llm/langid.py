"""Language identification by compression.

Each language has a zstandard raw-content dictionary: the words and pairs of words that are
most frequent in the whole texts of a bounded sample of its documents, the most frequent last.
A text is compressed whole with each dictionary, in pieces that leave the dictionary within
reach; the one that makes it smallest names the language.  Narrow margins are marked as
rejected.  Equal sizes are told apart by compressing word by word.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.llm.common import small_batches, table, written

#: Documents per language that dictionaries are built from, bytes of each dictionary, and bytes of text
#: that are compressed at once: with the dictionary they stay within the window.
SAMPLE, DICTIONARY, PIECE = 300, 64 * 1024, 128 * 1024
#: Parts of a language in which its sample is drawn at first.
PARTS = 256
#: How thoroughly matches of four bytes or more are sought.
EFFORT = {"window_log": 18, "chain_log": 17, "hash_log": 17, "search_log": 4, "min_match": 4, "target_length": 8}
#: A best size within this part of the second best is rejected.
MARGIN = 0.004
_REST = re.compile(r"[\W\d_]+")


def normalised(text: str | None) -> str:
    """Lower case, runs of anything but letters as one space."""
    return _REST.sub(" ", (text or "").lower()).strip()


def phrases(text: str | None) -> Counter:
    """Words and pairs of words of a normalised text."""
    words = normalised(text).split()
    out = Counter(words)
    out.update(map(" ".join, zip(words, words[1:])))
    return out


def dictionaries(docs: DataFrame, sample: int = SAMPLE, size: int = DICTIONARY) -> dict[str, bytes]:
    """Language -> dictionary, from ``sample`` documents of each language in ``docs`` (doc_id,
    text, lang), those of least hash of their id, each with its whole text.  Counted in executors; only
    the dictionaries come back.  Rows that repeat count once; null texts, languages and ids not at all."""
    small_batches(docs.sparkSession)
    known = docs.select("lang", "doc_id", "text").where("lang is not null and text is not null and doc_id is not null")
    ids = known.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).distinct()
    # First within parts of a language, so that no task ranks all of a frequent one.
    for part in (F.pmod("h", F.lit(PARTS)), F.lit(0)):
        least = W.partitionBy("lang", "part").orderBy("h", "doc_id")
        ids = ids.withColumn("part", part).withColumn("k", F.row_number().over(least)).where(F.col("k") <= sample).drop("k", "part")
    rows = known.join(F.broadcast(ids.drop("h")), ["lang", "doc_id"]).distinct()  # at most ``sample`` ids of each language

    def count(batches):
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                held: Counter = Counter()
                for t in texts:
                    held.update(phrases(t))
                yield pd.DataFrame({"lang": lang, "phrase": list(held.keys()), "n": list(held.values())})

    found = rows.mapInPandas(count, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("n"), "phrase")
    up_to = F.sum(F.octet_length("phrase") + 1).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    best = written(found.withColumn("at", up_to).where(F.col("at") <= size), "phrases")
    out: dict[str, list[str]] = {r["lang"]: [] for r in rows.select("lang").distinct().collect()}
    for r in sorted(best.collect(), key=lambda r: (r["lang"], -r["at"])):
        out[r["lang"]].append(r["phrase"])
    return {lang: " ".join(p).encode("utf-8", "surrogatepass") for lang, p in out.items()}


class Classifier:
    def __init__(self, dicts: dict[str, bytes]):
        import zstandard

        self.langs = sorted(dicts)
        self.coders = []
        how = zstandard.ZstdCompressionParameters(**EFFORT, strategy=zstandard.STRATEGY_LAZY2, write_checksum=0, write_content_size=0, write_dict_id=0)
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dicts[lang] or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))

    def sizes(self, parts: list[bytes]) -> list[int]:
        """For each language the bytes that these parts take, compressed one by one."""
        return [sum(len(c.compress(p)) for p in parts) for c in self.coders]

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin is wide enough; ``und`` without any letter."""
        plain = normalised(text)
        if not any(map(str.isalpha, plain)) or not self.langs:
            return "und", 0.0, False
        data = plain.encode("utf-8", "surrogatepass")
        got = self.sizes([data[i : i + PIECE] for i in range(0, len(data), PIECE)])
        a, *more = sorted(got)
        if not more:
            return self.langs[0], 1.0, True
        b = more[0]
        if a == b:
            fine = self.sizes(sorted(set(data.split())))
            got = [(n, x) for n, x in zip(got, fine)]
        lang = self.langs[min(range(len(got)), key=lambda i: got[i])]
        return lang, 1 - math.exp(-(b - a) / 4), (b - a) >= MARGIN * b and b > a


_loaded: dict[int, Classifier] = {}


def _in_worker(mark: int, shared) -> Classifier:
    """The classifier of the broadcast dictionaries, kept from task to task."""
    if mark not in _loaded:
        _loaded.clear()
        _loaded[mark] = Classifier(shared.value)
    return _loaded[mark]


def classified(docs: DataFrame, dicts: dict[str, bytes]) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (0 to 1), accepted.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text where
    there are no dictionaries.  Of equal sizes the dictionary that compresses the text's words best one by
    one wins, then the language that sorts first; the score is 0.
    Further columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(dicts)
    mark = zlib.crc32(repr(sorted(dicts.items())).encode())

    def run(batches):
        c = _in_worker(mark, shared)
        for b in batches:
            lang, score, ok = zip(*map(c.classify, b["text"])) if len(b) else ((), (), ())
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": lang, "score": score, "accepted": ok})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double, accepted boolean")


def fold(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op3_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = classified(docs, dictionaries(docs.where(fold(5) != 0)))
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score", "accepted")

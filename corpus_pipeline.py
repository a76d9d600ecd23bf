"""The corpus pipeline: documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet in the shared folder and reads it back for the next.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import block_names, packing, simhash, substring_dedup, toxicity
from plumbline.llm.common import drop_written, table, written
from plumbline.llm.langid import fold
from plumbline.sources.tables import scope


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts toxic go."""
    labels = table(spark, sf_dir, "labels").where(fold(3) != 1)
    return toxicity.without_toxic(docs, toxicity.fit(docs.where(fold(3) != 1), labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original, then the smallest doc_id, stays; of rows that repeat in full
    one."""
    return block_names.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest doc_id stays; of rows that repeat it one."""
    return simhash.without_near_copies(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of an earlier document go; what is left is joined by single spaces.
    Documents without such passages keep their text as it is."""
    return substring_dedup.without_passages(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_passages),
    ("pack", pack),
]

#: SQL can't express the stages: they learn, hash and solve a program.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages.  Tables that a stage makes go when its result is written, its input when the next
    stage's result is; what the last stage makes stays as long as the process, which reads it."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES[:-1]):
        with scope(spark):
            out = written(stage(spark, docs, sf_dir), f"stage-{name}", outer=True)
        if n:
            drop_written(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)

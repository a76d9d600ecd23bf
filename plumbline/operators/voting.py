"""Majority votes: over the candidate array of a record, or over long rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions.text import let
from plumbline.sources.tables import fresh

INVALID = "INVALID"


def effective(flag: Column, answer: Column, gold: Column) -> Column:
    """Correct by flag, or because the normalised answer is the (not empty) gold."""
    return F.coalesce(flag, F.lit(False)) | ((gold != "") & (answer == gold))


def ballot(answer: Column, is_correct: Column, gold: Column) -> Column:
    """What a candidate votes for: its answer; without one the gold if it is flagged correct."""
    return F.when(answer != "", answer).otherwise(F.when(is_correct & (gold != ""), gold).otherwise(F.lit(INVALID)))


def vote_array(pool: Column, gold: Column) -> Column:
    """struct<answer, confidence, is_correct, cluster> of an array of structs with ``ans`` (the
    ballot) and ``ok`` (effectively correct).  Ties go to the answer that comes first.  An empty
    pool gives an empty answer, 0.0, false and an empty cluster.  Meant for pools of the size of a
    record, whose arrays are at hand anyway: no explode, no shuffle."""

    def winner(p):
        names = F.array_distinct(F.transform(p, lambda x: x["ans"]))
        tally = F.transform(names, lambda a, i: F.struct(F.size(F.filter(p, lambda x: x["ans"] == a)).alias("n"), (-i).alias("first"), a.alias("ans")))
        return F.array_max(tally)

    def result(p):
        def of(w):
            cluster = F.filter(p, lambda x: x["ans"] == w["ans"])
            return F.struct(
                F.coalesce(w["ans"], F.lit("")).alias("answer"),
                F.coalesce(w["n"] / F.size(p), F.lit(0.0)).alias("confidence"),
                F.coalesce(((gold != "") & (w["ans"] == gold)) | F.exists(cluster, lambda x: x["ok"]), F.lit(False)).alias("is_correct"),
                cluster.alias("cluster"),
            )

        return let(winner(p), of)

    return let(pool, result)


def vote_long(rows: DataFrame, key: str = "question_id", answer: str = "answer", pos: str = "pos") -> DataFrame:
    """key, answer, votes, pool_size, confidence: the most frequent answer of each key, ties to
    the one seen first.  Counts are combined map-side, so a key of very many rows costs no more
    than its number of answers."""
    counts = rows.groupBy(key, answer).agg(F.count(F.lit(1)).alias("votes"), F.min(pos).alias("first"))
    best = counts.groupBy(key).agg(
        F.max(F.struct(F.col("votes"), (-F.col("first")).alias("near"), F.col(answer).alias("answer"))).alias("b"),
        F.sum("votes").alias("pool_size"),
    )
    return best.select(key, F.col("b.answer").alias("answer"), F.col("b.votes").alias("votes"), "pool_size", (F.col("b.votes") / F.col("pool_size")).alias("confidence"))


def clusters_long(rows: DataFrame, key: str = "question_id", answer: str = "ans", pos: str = "pos") -> DataFrame:
    """The rows whose answer wins their key."""
    name = fresh(rows, "won")
    won = vote_long(rows, key, answer, pos).select(key, F.col("answer").alias(name))
    return rows.join(won, key).where(F.col(answer) == F.col(name)).drop(name)


def occurrence_ratio(pool: Column, answer: Column) -> Column:
    """Share of a pool that votes for ``answer``; 0 for an empty pool."""
    return F.coalesce(F.try_divide(F.size(F.filter(pool, lambda x: x["ans"] == answer)), F.size(pool)), F.lit(0.0))


def record_stats(candidates: Column) -> Column:
    """struct<total, correct, accuracy> of an array of structs with is_correct."""
    total = F.coalesce(F.size(candidates), F.lit(0))
    good = F.size(F.filter(candidates, lambda x: F.coalesce(x["is_correct"], F.lit(False))))
    return F.struct(total.cast("int").alias("total"), good.cast("int").alias("correct"), F.coalesce(F.try_divide(good, total), F.lit(0.0)).alias("accuracy"))


def row_numbers(df: DataFrame, key: str, *order: str) -> DataFrame:
    """``pos`` from 0 within key, in this order."""
    return df.withColumn("pos", F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1)

"""Selection: jitter and score features, two-stage pruning, two votes, report and metrics.

Records stay nested all the way.  A record's candidates are already together, so features,
pruning and votes are row-local expressions; the only exchange is the percentile's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.arrays import jitter, overflows, python_slice, token_probabilities
from plumbline.functions.text import normalize_veto
from plumbline.operators.pruning import exact_thresholds, high_or_all, thresholds, veto_or_all
from plumbline.operators.voting import ballot, effective, occurrence_ratio, vote_array
from plumbline.schemas import SelectionConfig
from plumbline.sources.tables import materialised


def features(records: DataFrame, config: SelectionConfig = SelectionConfig()) -> DataFrame:
    """question_id, gold, pool of records with candidates: for each candidate of the slice ``ans`` (its
    ballot), ``ok``, ``score`` and ``jitter``.  Texts are not read.  A record without a candidate in the
    slice is left out, and so is one with a log-probability whose exp is beyond doubles; null
    log-probabilities count as none, a null first score as 0."""
    # The fields that are needed, drawn from the array as columns, so that a scan can prune the rest.
    names = ("extracted_answer", "is_correct", "token_logprobs", "interval_scores")
    slim = records.where("candidates is not null").select(
        "question_id",
        normalize_veto(F.col("gold_answer")).alias("gold"),
        python_slice(F.arrays_zip(*[F.col(f"candidates.{n}").alias(n) for n in names]), config.sample_s, config.sample_e).alias("c"),
    )
    ok = lambda a, c: effective(c["is_correct"], a, F.col("gold"))

    def row(c):
        score = F.coalesce(F.try_element_at(c["interval_scores"], F.lit(1)), F.lit(0.0)).cast("double")
        return F.struct(normalize_veto(c["extracted_answer"]).alias("raw"), c["is_correct"].alias("is_correct"), score.alias("score"), jitter(token_probabilities(c["token_logprobs"]), config.block_size).alias("jitter"))

    made = slim.where((F.size("c") > 0) & ~F.exists("c", lambda c: overflows(c["token_logprobs"]))).select("question_id", "gold", F.transform("c", row).alias("c"))
    pool = F.transform(
        "c",
        lambda c: F.struct(
            ballot(c["raw"], F.coalesce(c["is_correct"], F.lit(False)), F.col("gold")).alias("ans"),
            ok(c["raw"], c).alias("ok"),
            c["score"].alias("score"),
            c["jitter"].alias("jitter"),
        ),
    )
    return made.select("question_id", "gold", pool.alias("pool"))


def jitters(pools: DataFrame) -> DataFrame:
    # Outer, so that no filter on the array's size works the features out a second time.
    return pools.select(F.explode_outer("pool.jitter").alias("jitter"))


def selected(pools: DataFrame, config: SelectionConfig = SelectionConfig(), limits: DataFrame | None = None) -> DataFrame:
    """pools with base and final vote.  ``limits`` may be thresholds that are known already; without them the pools,
    which are far smaller than the log-probabilities they come from, are written once, and exact thresholds are
    found by jobs of their own."""
    if limits is None:
        pools = materialised(pools, "features")
        limits = exact_thresholds(jitters(pools), "jitter", config.v100_jitter, config.v0_jitter)
    high = high_or_all(F.col("pool"), config.min_score)
    rows = pools.crossJoin(F.broadcast(limits)).withColumn("high", high)  # limits is one row
    rows = rows.withColumn("pruned", veto_or_all(F.col("high"), config.min_score, F.col("t_hi"), F.col("t_lo")))
    return rows.withColumns({"base": vote_array(F.col("pool"), F.col("gold")), "final": vote_array(F.col("pruned"), F.col("gold"))})


def report(records: DataFrame, config: SelectionConfig = SelectionConfig(), large: bool = True) -> DataFrame:
    """The report rows of scored records.

    By default for tables of any size (``selected``).  Without ``large`` all is one lazy plan, whose percentile holds
    all distinct values in one task.  Both give the same rows.
    """
    pools = features(records, config)
    return report_rows(selected(pools, config, None if large else thresholds(jitters(pools), "jitter", config.v100_jitter, config.v0_jitter)))


def report_rows(rows: DataFrame) -> DataFrame:
    won = F.col("final.cluster")
    return rows.select(
        "question_id",
        F.col("final.is_correct").alias("is_correct"),
        F.lit("JITTER").alias("strategy"),
        (F.col("final.answer") == F.col("base.answer")).alias("is_same_as_base"),
        occurrence_ratio(F.col("pool"), F.col("final.answer")).alias("final_ans_original_ratio"),
        F.size(won).alias("pool_size"),
        F.col("base.confidence").alias("baseline_confidence"),
        F.col("final.confidence").alias("final_confidence"),
        F.lit(0).alias("total_tokens"),
        F.lit("final verbalize").alias("stop_reason"),
        won["score"].alias("current_score"),
        won["ok"].alias("current_corrrect"),
    )


def metrics(rows: DataFrame) -> DataFrame:
    """Two rows, baseline and final: accuracy and oracle in percent, and mean pool size.  The baseline
    is of whole pools, final of winning clusters.  Zeros if there are no records."""
    pair = F.explode(
        F.array(
            F.struct(F.lit("baseline").alias("run"), F.col("base.is_correct").alias("hit"), F.exists("pool", lambda x: x["ok"]).alias("any"), F.size("pool").alias("n")),
            F.struct(F.lit("final").alias("run"), F.col("final.is_correct").alias("hit"), F.exists(F.col("final.cluster"), lambda x: x["ok"]).alias("any"), F.size("final.cluster").alias("n")),
        )
    )
    percent = lambda c: 100 * F.avg(F.col(c).cast("int"))
    found = rows.select(pair.alias("m")).select("m.*").groupBy("run").agg(percent("hit").alias("accuracy"), percent("any").alias("oracle"), F.avg("n").alias("mean_pool_size"))
    runs = rows.sparkSession.sql("SELECT * FROM VALUES ('baseline'), ('final') AS t(run)")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return runs.join(found, "run", "left").select("run", zero("accuracy"), zero("oracle"), zero("mean_pool_size"))


"""Re-extracting and re-judging answers, and scores of confidence per candidate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from plumbline.functions.arrays import interval_slices
from plumbline.functions.text import extract_fix, normalize_fix
from plumbline.operators.prompts import judge_prompt
from plumbline.operators.voting import record_stats
from plumbline.schemas import SamplingConfig, candidates_of, field_of, first_present, or_empty
from plumbline.sources.tables import fresh, identified


def gold_letter(gold: Column) -> Column:
    """The gold answer as it is compared: of one character as it is, longer ones extracted."""
    return F.when(F.length(gold) > 1, extract_fix(gold)).otherwise(gold)


def rejudged(pred: Column, gold: Column) -> Column:
    """Whether a prediction is right: equal when normalised (two empty ones are), or equal as is."""
    return (normalize_fix(pred) == normalize_fix(gold)) | F.coalesce(gold == pred, F.lit(False))


def _keys(df: DataFrame) -> list[str]:
    """The columns that go along with what belongs to a record: its identity, if it has one."""
    return ["record_id", "question_id"] if "record_id" in df.columns else ["question_id"]


def _by_position(rows: DataFrame, records: DataFrame, value: Column, name: str) -> tuple[DataFrame, str]:
    """One row for each record: its key and ``name``, a map from position to value.  Records are told apart by their
    identity, where both tables have it, or else by question_id, which then must not repeat."""
    key = "record_id" if {"record_id"} <= set(rows.columns) & set(records.columns) else "question_id"
    pairs = F.collect_list(F.struct("pos", value.alias("v")))
    once = F.size(F.array_distinct(F.transform(pairs, lambda x: x["pos"]))) == F.size(pairs)
    shared = F.raise_error(F.concat(F.lit("several records have the question_id "), F.col(key).cast("string"), F.lit("; tell them apart by a record_id (sources.tables.identified)")))
    return rows.groupBy(key).agg(F.when(once, F.map_from_entries(pairs)).otherwise(shared).alias(name)), key


def _kind(records: DataFrame):
    """The type of a candidate."""
    name = "candidates" if "candidates" in records.columns else "continuations"
    return records.schema[name].dataType.elementType


def _gold(records: DataFrame) -> Column:
    """The gold answer, by either name; a null or empty one gives way to the other."""
    return or_empty(first_present(records, "gold_answer"), F.coalesce(first_present(records, "answer"), F.lit("")))


def _question(records: DataFrame) -> Column:
    return or_empty(first_present(records, "problem"), F.coalesce(first_present(records, "question"), F.lit("")))


def fix_records(records: DataFrame) -> DataFrame:
    """Records with extracted_answer, is_correct and stats redone.  Answers that are there are kept;
    others are read from the text.  What stays without an answer is for ``to_judge``.  Only ``candidates`` are
    read: a table without that column, whatever else it has, keeps its rows with stats of none."""
    if "candidates" not in records.columns:
        return records.withColumn("stats", record_stats(F.array().cast("array<struct<is_correct:boolean>>")))
    kind = records.schema["candidates"].dataType.elementType
    text = lambda c: F.coalesce(field_of(c, kind, "text", "full_text", "continuation_text"), F.lit(""))
    gold = fresh(records, "gold")
    rows = records.withColumn(gold, gold_letter(_gold(records)))
    rows = rows.withColumn("candidates", F.transform(F.coalesce("candidates", F.array()), lambda c: c.withField("extracted_answer", F.coalesce(field_of(c, kind, "extracted_answer"), extract_fix(text(c))))))
    rows = rows.withColumn("candidates", F.transform("candidates", lambda c: c.withField("is_correct", F.when(c["extracted_answer"].isNull(), F.lit(False)).otherwise(rejudged(c["extracted_answer"], F.col(gold))))))
    return rows.withColumn("stats", record_stats(F.col("candidates"))).drop(gold)


def to_judge(records: DataFrame) -> DataFrame:
    """question_id (and record_id, if there is one), pos, prompt of the candidates that have no answer after
    ``fix_records``; questions, gold answers and texts by any of their names."""
    if "candidates" not in records.columns:
        return records.where("false").select(*_keys(records), F.lit(0).alias("pos"), F.lit("").alias("prompt"))
    kind = records.schema["candidates"].dataType.elementType
    c = records.select(*_keys(records), _question(records).alias("q"), _gold(records).alias("g"), F.posexplode("candidates").alias("pos", "c")).where("c.extracted_answer is null")
    text = F.coalesce(field_of(F.col("c"), kind, "text", "full_text", "continuation_text"), F.lit(""))
    return c.select(*_keys(records), "pos", judge_prompt(F.col("q"), F.col("g"), text).alias("prompt"))


def _counts() -> list[Column]:
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return [
        F.count(F.lit(1)).alias("records"),
        n(F.size("candidates")).alias("candidates"),
        n(F.col("stats.correct")).alias("correct"),
        n(F.size(F.filter("candidates", lambda c: c["extracted_answer"].isNull()))).alias("judge_calls"),
    ]


def run_counts(fixed: DataFrame) -> DataFrame:
    """One row on records after ``fix_records``: records, candidates, correct ones, and those that a judge
    is asked about.  A job of its own; ``observed`` counts in the pass that writes the records."""
    return fixed.agg(*_counts())


def observed(fixed: DataFrame, seen: Observation) -> DataFrame:
    """``fixed``, whose ``run_counts`` are in ``seen`` as soon as it has been written."""
    return fixed.observe(seen, *_counts())


def with_verdicts(records: DataFrame, replies: DataFrame) -> DataFrame:
    """Records with the judge's replies (the keys of ``to_judge``, pos, reply as JSON) taken in.  Only a true
    boolean counts as right; a reply that isn't JSON leaves the candidate without an answer and wrong."""
    if "candidates" not in records.columns:
        return records
    said = fresh(records, "said")
    verdicts, key = _by_position(replies, records, F.from_json("reply", "extracted_answer string, is_correct boolean"), said)
    rows = records.join(verdicts, key, "left")

    def judged(c, i):
        v = F.try_element_at(F.col(said), i)
        unread = c["extracted_answer"].isNull() & v.isNotNull()
        c = c.withField("is_correct", F.when(unread, F.coalesce(v["is_correct"], F.lit(False))).otherwise(c["is_correct"]))
        return c.withField("extracted_answer", F.when(unread, v["extracted_answer"]).otherwise(c["extracted_answer"]))

    rows = rows.withColumn("candidates", F.transform("candidates", judged))
    return rows.withColumn("stats", record_stats(F.col("candidates"))).select(*[F.col(f"`{c}`") for c in dict.fromkeys([*records.columns, "stats"])])


def judged_records(records: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The whole fixing stage: answers read again, ``ask`` (prompts to replies) asked about the rest, its verdicts
    taken in.  Every record keeps its own, whether or not question_ids repeat."""
    fixed = fix_records(identified(records))
    out = with_verdicts(fixed, ask(to_judge(fixed)))
    return out if "record_id" in records.columns else out.drop("record_id")


def scored_records(records: DataFrame, ask: Callable[[DataFrame], DataFrame], config: SamplingConfig = SamplingConfig(), flag: str = "\n\n") -> DataFrame:
    """The whole scoring stage: slices of the scorable records, ``ask`` (slices to scores) about each, scores back into
    their records, whether or not question_ids repeat."""
    mine = identified(records)
    out = with_scores(mine, ask(slices_of(scorable(mine), config, flag)))
    return out if "record_id" in records.columns else out.drop("record_id")


def scorable(records: DataFrame) -> DataFrame:
    """The records that the scoring stage keeps: those without candidates, which it hands on as they
    are, and those with stats whose candidates all have a text."""
    kind = _kind(records)
    c = candidates_of(records)
    whole = F.forall(c, lambda x: field_of(x, kind, "text", "full_text").isNotNull())
    stats = F.col("stats").isNotNull() if "stats" in records.columns else F.lit(False)
    return records.where((F.size(c) == 0) | (stats & whole))


def slices_of(records: DataFrame, config: SamplingConfig = SamplingConfig(), flag: str = "\n\n") -> DataFrame:
    """question_id (and record_id, if there is one), problem, pos, slice_idx, slice: what a scorer is asked about."""
    kind = _kind(records)
    prefix = F.coalesce(first_present(records, "full_poisoned_prefix"), F.lit(""))
    c = records.select(*_keys(records), F.coalesce("problem", F.lit("")).alias("problem"), prefix.alias("prefix"), F.posexplode(candidates_of(records)).alias("pos", "c"))
    text = F.coalesce(field_of(F.col("c"), kind, "text", "full_text"), F.lit(""))
    slices = interval_slices(text, config.num_intervals, flag, F.col("prefix") if config.poisoned else None)
    return c.select(*_keys(records), "problem", "pos", F.posexplode(slices).alias("slice_idx", "slice"))


def candidate_scores(scores: DataFrame) -> DataFrame:
    """The keys of ``slices_of``, pos, interval_scores in order of slice, their mean and least."""
    g = scores.groupBy(*_keys(scores), "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("slice_idx", "score"))), lambda x: x["score"]).alias("interval_scores"), F.avg("score").alias("avg_verbal_score"), F.min("score").alias("min_verbal_score"))
    return g.withColumn("verbal_score", F.col("avg_verbal_score"))


def with_scores(records: DataFrame, scores: DataFrame) -> DataFrame:
    """The ``scorable`` records with scores in their ``candidates`` and ``stats.avg_confidence``;
    candidates that have no score get an empty list and zeros.  Records without candidates stay as
    they are, their confidence null.  A slice has one score: records that share a question_id need a record_id."""
    said = fresh(records, "said")
    order = F.array_sort(F.collect_list(F.struct("slice_idx", "score")))
    slices = scores.groupBy(*_keys(scores), "pos").agg(order.alias("of"), F.avg("score").alias("mean"), F.min("score").alias("least"))
    once = F.size(F.array_distinct(F.col("of.slice_idx"))) == F.size("of")
    shared = F.raise_error(F.lit("a slice has several scores; tell records that share a question_id apart by a record_id (sources.tables.identified)"))
    value = F.when(once, F.struct(F.col("of.score").alias("interval_scores"), F.col("mean").alias("avg_verbal_score"), F.col("least").alias("min_verbal_score"))).otherwise(shared)
    scored_rows = scorable(records).withColumn("candidates", candidates_of(records)).drop("continuations")
    per, key = _by_position(slices, scored_rows, value, said)
    rows = scored_rows.join(per, key, "left")

    def scored(c, i):
        s = F.try_element_at(F.col(said), i)
        mean = F.coalesce(s["avg_verbal_score"], F.lit(0.0))
        c = c.withField("interval_scores", F.coalesce(s["interval_scores"].cast("array<double>"), F.array().cast("array<double>")))
        return c.withField("avg_verbal_score", mean).withField("min_verbal_score", F.coalesce(s["min_verbal_score"], F.lit(0))).withField("verbal_score", mean)

    rows = rows.withColumn("candidates", F.transform("candidates", scored)).select(*[F.col(f"`{c}`") for c in scored_rows.columns])
    mean = F.aggregate("candidates", F.lit(0.0), lambda a, c: a + c["avg_verbal_score"]) / F.size("candidates")
    if "stats" not in records.columns:
        return rows
    return rows.withColumn("stats", F.col("stats").withField("avg_confidence", F.when(F.size("candidates") > 0, mean)))

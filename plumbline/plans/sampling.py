"""From generated texts to sampled records: extraction, judging, end-token cut, stats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import arrays, text
from plumbline.operators import prompts, sampling
from plumbline.operators.voting import record_stats
from plumbline.schemas import SamplingConfig, gold_of, id_of, question_of


def asked(questions: DataFrame, config: SamplingConfig = SamplingConfig(), visual: bool = False) -> DataFrame:
    """question_id, problem, gold_answer, prompt (and image_1, if there is one) of a sample of a question
    table.  Visual tables keep multiple-choice rows only, where they say which those are.  A record_id, if there is
    one, goes along."""
    df = sampling.only_if_present(questions, "question_type", "multiple-choice") if visual else questions
    q = question_of(df)
    shown = q
    for name in ("options", "choices"):
        if name in df.columns and shown is q:
            kind = df.schema[name].dataType.simpleString()
            if kind.startswith("struct"):
                shown = prompts.option_struct(q, F.col(name))
            else:
                lines = prompts.option_letters(F.col(name)) if kind.startswith("array") else prompts.option_list(F.col(name))
                shown = prompts.with_options(q, lines)
    more = [F.col(c) for c in ("record_id", *(["image_1"] if visual else [])) if c in df.columns]
    rows = df.select(id_of(df).alias("question_id"), q.alias("problem"), gold_of(df).alias("gold_answer"), prompts.prompt(shown).alias("prompt"), *more)
    return sampling.hash_sample(rows, "question_id", config.sample_size, config.seed)


def judged(generated: DataFrame, task: str = "GPQ", eos: int | None = None, visual: bool = False) -> DataFrame:
    """Generated rows (question_id, problem, gold_answer, pos, text, token_logprobs, and token_ids where an
    end token is given) with extracted_answer, is_correct, and log-probabilities cut and rounded."""
    extract, normalize = (text.extract_vl, text.normalize_vl) if visual else (text.extract_build, text.normalize_build)
    lp = F.col("token_logprobs") if eos is None else arrays.until_eos(F.col("token_logprobs"), F.col("token_ids"), eos)
    rows = generated.withColumn("extracted_answer", extract(F.col("text"), task))
    rows = rows.withColumn("is_correct", text.correct(F.col("extracted_answer"), F.col("gold_answer"), normalize))
    return rows.withColumn("token_logprobs", F.transform(lp, lambda x: F.round(x, 4)))


def sampled_records(rows: DataFrame) -> DataFrame:
    """One record for each question, candidates in order of pos, with stats.  Candidates of a question
    are few by design (its number of samples).  Rows with a record_id are gathered by it, so that questions that
    repeat stay records of their own; without one, by question_id, problem and gold_answer."""
    c = F.struct("pos", "text", "extracted_answer", "is_correct", "token_logprobs")
    keys = [c for c in ("record_id", "question_id", "problem", "gold_answer") if c in rows.columns]
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(c)).alias("candidates"))
    g = g.withColumn("candidates", F.transform("candidates", lambda x: x.dropFields("pos")))
    return g.withColumn("stats", record_stats(F.col("candidates")))

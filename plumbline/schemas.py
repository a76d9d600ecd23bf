"""Schemas of the four stages, parameters, and column aliases that depend on what is there."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "double": T.DoubleType()}


def _struct(fields: str, **nested: T.DataType) -> T.StructType:
    """A struct of ``name type`` pairs; ``type[]`` is an array, other types are nested ones by name."""
    out = []
    for field in fields.split(", "):
        name, kind = field.split(" ")
        of = {**_TYPES, **nested}[kind.removesuffix("[]")]
        out.append(T.StructField(name, T.ArrayType(of) if kind.endswith("[]") else of))
    return T.StructType(out)


_SAMPLED = "text string, extracted_answer string, is_correct boolean, token_logprobs double[]"
_SCORED = f"{_SAMPLED}, interval_scores double[], avg_verbal_score double, min_verbal_score int, verbal_score double"
STATS = _struct("total int, correct int, accuracy double")
STATS_SCORED = _struct("total int, correct int, accuracy double, avg_confidence double")

#: S1: sampled records, one for each question.
SAMPLED = _struct("question_id string, problem string, gold_answer string, candidates candidate[], stats stats", candidate=_struct(_SAMPLED), stats=STATS)
#: S2: re-judged records; the aliases of older files are read too.
FIXED = _struct(
    "question_id string, problem string, question string, gold_answer string, answer string, candidates candidate[], stats stats",
    candidate=_struct(f"{_SAMPLED}, full_text string, continuation_text string"),
    stats=STATS,
)
#: What the scoring stage reads: S2 by any of its names, and a prefix that all of a record's texts share.
TO_SCORE = _struct(
    "question_id string, problem string, gold_answer string, full_poisoned_prefix string, candidates candidate[], continuations candidate[], stats stats",
    candidate=_struct(f"{_SAMPLED}, full_text string"),
    stats=STATS,
)
#: S3: records with confidence scores.
SCORED = _struct("question_id string, problem string, gold_answer string, full_poisoned_prefix string, candidates candidate[], stats stats", candidate=_struct(f"{_SCORED}, full_text string"), stats=STATS_SCORED)
#: S4: report rows.  ``current_corrrect`` is spelled as files have it.
REPORT = _struct(
    "question_id string, is_correct boolean, strategy string, is_same_as_base boolean, final_ans_original_ratio double, pool_size int, baseline_confidence double,"
    " final_confidence double, total_tokens int, stop_reason string, current_score double[], current_corrrect boolean[]"
)


@dataclass(frozen=True)
class SelectionConfig:
    """Parameters of the selection: the slice of candidates, jitter percentiles and least score."""

    sample_s: int = 0
    sample_e: int = 16
    v100_jitter: float = 10
    v0_jitter: float = 90
    min_score: float = 100
    block_size: int = 20

    def __post_init__(self):
        if self.sample_s < 0 or self.sample_e < 0:
            raise ValueError("bounds of the slice of candidates must not be negative")


@dataclass(frozen=True)
class SamplingConfig:
    """Parameters of sampling and scoring; models are outside the engine."""

    sample_size: int = 250
    seed: int = 42
    n_samples: int = 16
    max_new_tokens: int = 8192
    temperature: float = 0.7
    top_p: float = 0.95
    num_intervals: int = 10
    batch_size: int = 8
    #: Generations asked for at once, failures in a row that end a question (None: each failure skips
    #: its batch), tasks that hold a model (None: as the table is dealt), the rubric of the scorer, and
    #: whether the records' shared prefix is set apart in front of each slice.
    micro_batch: int = 1
    retries: int | None = None
    workers: int | None = None
    rubric: str = "path"
    poisoned: bool = False


def first_present(df: DataFrame, *names: str) -> Column:
    """The first of these columns that the table has, whatever its values; null if none."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    return F.lit(None).cast("string")


def question_of(df: DataFrame) -> Column:
    """The question: by column presence, then ``prompt`` where it is null or empty."""
    q = first_present(df, "Problem", "problem", "question").cast("string")
    return F.coalesce(F.nullif(q, F.lit("")), first_present(df, "prompt").cast("string"), F.lit(""))


def gold_of(df: DataFrame) -> Column:
    """The gold answer as text; null becomes ``None``, as text."""
    if not {"Answer", "answer", "answerKey"} & set(df.columns):
        return F.lit("")
    return F.coalesce(first_present(df, "Answer", "answer", "answerKey").cast("string"), F.lit("None"))


def id_of(df: DataFrame) -> Column:
    """question_id or id; without either a hash of the question."""
    if {"question_id", "id"} & set(df.columns):
        return first_present(df, "question_id", "id")
    return F.xxhash64(question_of(df)).cast("string")


def field_of(c: Column, kind: T.DataType, *names: str) -> Column:
    """The first of a struct's fields by these names that it has and that isn't null."""
    have = {f.name for f in kind.fields}
    return F.coalesce(*[c[n] for n in names if n in have], F.lit(None).cast("string"))


def candidates_of(df: DataFrame) -> Column:
    """The candidates of records, by either name."""
    names = [n for n in ("candidates", "continuations") if n in df.columns]
    return F.coalesce(*[F.col(n) for n in names], F.array())


def or_empty(first: Column, then: Column) -> Column:
    """``first`` unless it is null or empty."""
    return F.coalesce(F.nullif(first, F.lit("")), then)

"""The engine's expressions under names that SQL can call.

A function's body is the text of the column expression that DataFrames use, so there is one definition of each; Spark
expands it where it is called, and plans are the same as with columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import arrays, text
from plumbline.operators import voting

POOL = "ARRAY<STRUCT<ans: STRING, ok: BOOLEAN>>"
#: Arguments, result and expression of each function.
FUNCTIONS: dict[str, tuple[str, str, Callable[[], Column]]] = {
    "token_jitter": ("logprobs ARRAY<DOUBLE>, block INT DEFAULT 20", "DOUBLE", lambda: arrays.jitter(arrays.token_probabilities(F.col("logprobs")), F.col("block"))),
    "majority_vote": (f"pool {POOL}, gold STRING", f"STRUCT<answer: STRING, confidence: DOUBLE, is_correct: BOOLEAN, cluster: {POOL}>", lambda: voting.vote_array(F.col("pool"), F.col("gold"))),
    "boxed_answer": ("answer STRING", "STRING", lambda: text.boxed(F.col("answer"))),
    "option_answer": ("answer STRING", "STRING", lambda: text.extract_build(F.col("answer"), "GPQ")),
    "number_answer": ("answer STRING", "STRING", lambda: text.extract_build(F.col("answer"), "MATH")),
    "normal_answer": ("answer STRING", "STRING", lambda: text.normalize_build(F.col("answer"))),
    "stated_confidence": ("reply STRING", "INT", lambda: text.confidence(F.col("reply"))),
}


def sql_text(c: Column) -> str:
    """A column expression as SQL that can be parsed: operators are called by their quoted names, fields are quoted, and
    fractions are doubles."""
    parts = re.split(r"('(?:[^'\\]|\\.)*')", c._jc.node().sql())
    for i in range(0, len(parts), 2):  # between quoted texts
        p = re.sub(r"(?<![\w`])(and|or|not)\(", r"`\1`(", parts[i])
        p = re.sub(r"(?<![-\w`])(<=>|[!<>=+*/%|&^]+|-)\((?!\))", r"`\1`(", p)
        p = re.sub(r" AS ([a-z_]\w*)", r" AS `\1`", p)
        parts[i] = re.sub(r"(?<![\w.])(\d+\.\d+(?:E-?\d+)?)(?![\w.])", r"\1D", p)
    return "".join(parts)


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Make ``FUNCTIONS`` known to this session's SQL; returns their names."""
    for name, (arguments, result, made) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS {result} RETURN {sql_text(made())}")
    return [prefix + n for n in FUNCTIONS]


def register_generator(spark: SparkSession, name: str, factory: Callable[[], Callable[[str, int], list[str]]], kept: str | None = None) -> None:
    """A table function ``name(prompt, n)`` for SQL: pos and text of the candidates that a generator makes of a prompt.
    ``kept`` is the name under which the generator stays in its worker process."""
    from plumbline.sources.scorer import held

    class Candidates:
        def __init__(self):
            self.make = held(kept, factory)

        def eval(self, prompt: str, n: int):
            if prompt is not None and n:
                yield from enumerate(self.make(prompt, n)[:n])

    spark.udtf.register(name, F.udtf(Candidates, returnType="pos int, text string"))

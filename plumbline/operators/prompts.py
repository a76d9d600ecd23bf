"""Prompts, options and messages for external models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Instructions of the sampling stage, in words of this engine's own.
SOLVE = "Reason step by step and put the final answer in \\boxed{}."
_HARSH = " Do not be lenient: work that wanders or disagrees with itself gets 0%."
_END = " Answer with nothing but this line: **Confidence: [Score]%**"
_SCALE = " Say, from 0 to 100, how sure you are that this path will reach the right result in the end."
_PATH = "Verify a path of reasoning strictly. Hold the thoughts so far against what the problem demands; they must be sound and agree with each other."
_PATH_GOOD, _PATH_BAD = "the step is a valid inference that brings the solution nearer", "numbers or assumptions come from nowhere, or the logic contradicts the problem or an earlier step, or the approach is wrong at its root or cannot lead anywhere"
_STEP = "Verify the work step by step and strictly. Hold the last step against the problem; school arithmetic leaves nothing open to interpretation."
_STEP_GOOD, _STEP_BAD = "the step plainly follows from the sentence before it and its numbers are those of the problem", "a number has no visible source, or the operation makes no sense for the things described, or the calculation is wrong"
#: What a scorer is asked: for paths of any kind or steps of school mathematics, on a scale or as yes or no.
RUBRICS = {
    "path": f"{_PATH}{_SCALE} High: {_PATH_GOOD}. Low: {_PATH_BAD}.{_HARSH}{_END}",
    "path_simple": f"{_PATH} 100%: {_PATH_GOOD}. 0%: {_PATH_BAD}.{_HARSH}{_END}",
    "steps": f"{_STEP}{_SCALE} High: {_STEP_GOOD}. Low: {_STEP_BAD}.{_HARSH}{_END}",
    "steps_simple": f"{_STEP} 100%: {_STEP_GOOD}. 0%: {_STEP_BAD}.{_HARSH}{_END}",
}
RATE = RUBRICS["path"]
#: What a judge is asked, before and behind the question, the reference and the response.
JUDGE = "Grade a mathematical response strictly: does it agree with the reference answer?"
JUDGE_RULES = (
    "Only the final answer counts, whatever mistakes the reasoning holds. A response that corrects itself and ends with the right number, in a box or at the close, is right. "
    "One that gives several answers which contradict each other is wrong. Reply with JSON only: "
    '{"extracted_answer": "the number that the response gives", "is_correct": true or false}'
)


def option_letters(options: Column) -> Column:
    """``A. first`` and so on, a line each, of an array of texts; a null one reads ``None``."""
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), F.coalesce(o, F.lit("None")), F.lit("\n"))), "")


#: Quoted texts without escapes.
_QUOTED = r"""'[^'\\\x00-\x1F]*+'|"[^"\\\x00-\x1F]*+\""""


def option_list(literal: Column) -> Column:
    """``option_letters`` of a Python list literal, with escapes, signs, adjacent texts and nesting as Python has them;
    empty if it isn't a list.  Lists of quoted texts without escapes, which most are, are read by built-in
    functions; only others go through Python, in batches."""
    import ast

    def lines(text):
        if text is None:
            return None
        try:
            value = ast.literal_eval(text)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None
        return "".join(f"{chr(65 + i)}. {x}\n" for i, x in enumerate(value)) if isinstance(value, list) else None

    def read(literals: pd.Series) -> pd.Series:
        return literals.map(lines)

    # Each quoted text becomes one mark; a plain list is then marks between commas.
    marks = F.translate(F.regexp_replace(literal, _QUOTED, "\u0001"), " ", "")
    plain = ~F.contains(literal, F.lit("\u0001")) & ~F.startswith(literal, F.lit("\n")) & marks.rlike("^\\[(?:\u0001(?:,\u0001)*+)?\\]$")
    plain = F.coalesce(plain, F.lit(True))
    listed = F.from_json(literal, "array<string>")
    other = F.pandas_udf(read, "string")(F.when(~plain, literal))
    return F.coalesce(F.when(plain, option_letters(listed)).otherwise(other), F.lit(""))


def with_options(question: Column, lines: Column) -> Column:
    """A question with lettered options under a heading, if there are any."""
    return F.concat(question, F.when(F.coalesce(lines, F.lit("")) == "", "").otherwise(F.concat(F.lit("\n\nOptions:\n"), lines)))


def option_struct(question: Column, options: Column) -> Column:
    """A question with its options given as struct<label: array, text: array>."""
    lines = F.array_join(F.zip_with(options["label"], options["text"], lambda a, b: F.concat(a, F.lit(". "), b)), "\n")
    return F.when(options.isNull(), question).otherwise(F.concat(F.lit("Question: "), question, F.lit("\nOptions:\n"), lines))


def prompt(question: Column, instruction: str = SOLVE) -> Column:
    return F.concat(question, F.lit("\n\n" + instruction))


def verification(question: Column, slice_: Column, rubric: str = RATE) -> Column:
    """Messages that ask for the confidence of a slice of an answer."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(turn("user", question), turn("assistant", slice_), turn("user", F.lit(rubric)))


def judge_prompt(question: Column, gold: Column, response: Column) -> Column:
    """One prompt with the rules of judging; any judge that replies in JSON will do."""
    return F.concat(F.lit(f"{JUDGE}\n\nQuestion:\n"), question, F.lit("\n\nReference answer:\n"), gold, F.lit("\n\nResponse:\n"), response, F.lit(f"\n\n{JUDGE_RULES}"))

"""Token-probability and text-segment arrays, row-local and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import let, strip

NO_DOUBLES = "array<double>"


def token_probabilities(logprobs: Column) -> Column:
    """exp of the log-probabilities above -100; nulls and NaN are left out."""
    kept = F.filter(F.coalesce(logprobs, F.array().cast(NO_DOUBLES)), lambda x: x.isNotNull() & ~F.isnan(x) & (x > -100))
    return F.transform(kept, lambda x: F.exp(x))


def overflows(logprobs: Column) -> Column:
    """Whether exp of some log-probability, itself finite, is beyond doubles."""
    inf = float("inf")
    return F.coalesce(F.exists(logprobs, lambda x: (x < inf) & (x > 0) & (F.exp(x) == inf)), F.lit(False))


def mean_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def block_means(probs: Column, block: int) -> Column:
    """Means of consecutive blocks; a last block of one value doesn't count."""
    n = F.size(probs)
    count = (n / block).cast("int") + F.when(n % block >= 2, 1).otherwise(0)
    empty = F.array().cast(NO_DOUBLES)
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: mean_of(F.slice(probs, i * block + 1, F.lit(block))))).otherwise(empty)


def middle_mean(values: Column, start: float = 0.25, end: float = 0.75) -> Column:
    """Mean of the sorted values from rank n*start up to n*end; of all if the first cut is 0."""

    def cut(s):
        n = F.size(s)
        a, b = F.floor(n * F.lit(float(start))).cast("int"), F.floor(n * F.lit(float(end))).cast("int")
        return F.when(a > 0, F.slice(s, a + 1, F.greatest(b - a, F.lit(0)))).otherwise(s)

    middle = let(F.array_sort(values), cut)
    return let(middle, lambda m: F.when(F.size(m) > 0, mean_of(m)).otherwise(F.lit(0.0)))


def jitter(probs: Column, block: int = 20, start: float = 0.25, end: float = 0.75) -> Column:
    """How much block means jump: the middle mean of their absolute differences; 0 if there are
    fewer values than a block or fewer than two blocks."""

    def of(p):
        differences = lambda m: F.transform(F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0))), lambda x, i: F.abs(x - m[i]))
        means = block_means(p, block)
        value = let(means, lambda m: F.when(F.size(m) >= 2, middle_mean(differences(m), start, end)).otherwise(F.lit(0.0)))
        return F.when(F.size(p) >= block, value).otherwise(F.lit(0.0))

    return let(probs, of)


def until_eos(values: Column, ids: Column, eos: int) -> Column:
    """The values up to and with the first end token; all if there is none."""
    at = F.array_position(ids, F.lit(eos)).cast("int")
    return F.when(at > 0, F.slice(values, F.lit(1), at)).otherwise(values)


def python_slice(a: Column, start: int, end: int) -> Column:
    """a[start:end] for bounds of 0 or more."""
    if start < 0 or end < 0:
        raise ValueError("negative bounds are not supported")
    return F.slice(a, start + 1, max(end - start, 0))


def _with_steps(text: Column, flag: str, prefix: Column | None, end_mark: str, slices) -> Column:
    """slices(steps, front) of a text, which is without its end mark and, where given, the prefix that is put in front
    of each slice; [text] where there are no steps."""
    import re

    clean = strip(F.replace(text, F.lit(end_mark), F.lit("")))
    lead = strip(F.coalesce(prefix, F.lit(""))) if prefix is not None else F.lit("")

    def of(t):
        body = F.when((lead != "") & F.startswith(t, lead), strip(F.substr(t, F.length(lead) + 1))).otherwise(t)
        steps = F.filter(F.split(body, re.escape(flag).replace("\\\n", "\n"), -1), lambda x: x.rlike(r"(?U)\S"))
        front = F.when(lead == "", "").otherwise(F.concat(lead, F.lit("\n")))
        return let(steps, lambda s: F.when(F.size(s) == 0, F.array(t)).otherwise(slices(s, front)))

    return let(clean, of)


def _target(steps: Column, num_intervals: int, flag: str) -> Column:
    """The length by which an interval ends: a share of the whole."""
    total = F.aggregate(steps, F.lit(0), lambda a, x: a + F.length(x)) + (F.size(steps) - 1) * len(flag)
    return total / F.lit(float(max(1, num_intervals)))


def interval_slices(text: Column, num_intervals: int = 10, flag: str = "\n\n", prefix: Column | None = None, end_mark: str = "<|im_end|>") -> Column:
    """[full text, first interval], or [full text] if there is only one interval.

    The text splits into steps at ``flag``; the first interval ends with the step by which a
    share of 1/num_intervals of the length is reached.  ``prefix``, where given and not blank,
    is taken off the text and put in front of each slice with a line break.
    """

    def cut(s, front):
        def step(target):
            def of(a, x):
                met = a["end"] > 0
                size, at = a["size"] + F.length(x) + len(flag), a["at"] + 1
                return F.struct(F.when(met, a["size"]).otherwise(size).alias("size"), at.alias("at"), F.when(met, a["end"]).when(size >= target, at).otherwise(0).alias("end"))

            return of

        zero = F.struct(F.lit(0).alias("size"), F.lit(0).alias("at"), F.lit(0).alias("end"))
        end = let(_target(s, num_intervals, flag), lambda t: F.aggregate(s, zero, step(t), lambda a: a["end"])) if num_intervals > 1 else F.lit(0)
        full = F.concat(front, F.array_join(s, flag))
        first = lambda e: F.concat(front, F.array_join(F.slice(s, F.lit(1), e), flag))
        return let(end, lambda e: F.when((e > 0) & (e < F.size(s)), F.array(full, first(F.greatest(e, F.lit(1))))).otherwise(F.array(full)))

    return _with_steps(text, flag, prefix, end_mark, cut)


def interval_ends(steps: Column, num_intervals: int = 10, flag: str = "\n\n") -> Column:
    """Numbers of steps up to the end of each interval.  An interval ends with the step by which it has a share of
    1/num_intervals of the whole length; the last takes what is left."""

    def step(target):
        def of(a, x):
            size, at = a["size"] + F.length(x) + len(flag), a["at"] + 1
            cuts = (size >= target) & (F.size(a["ends"]) < num_intervals - 1)
            return F.struct(F.when(cuts, 0).otherwise(size).alias("size"), at.alias("at"), F.when(cuts, F.array_append(a["ends"], at)).otherwise(a["ends"]).alias("ends"))

        return of

    def of(s):  # the steps and their share are worked out once for a text, not once for a step
        zero = F.struct(F.lit(0).alias("size"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))
        ends = let(_target(s, num_intervals, flag), lambda t: F.aggregate(s, zero, step(t), lambda a: a["ends"]))
        return let(ends, lambda e: F.when(F.coalesce(F.try_element_at(e, F.lit(-1)), F.lit(0)) < F.size(s), F.array_append(e, F.size(s))).otherwise(e))

    return let(steps, of)


def cumulative_slices(text: Column, num_intervals: int = 10, flag: str = "\n\n", prefix: Column | None = None, end_mark: str = "<|im_end|>") -> Column:
    """The text up to the end of each interval, in order; the last is the full text.  ``interval_slices`` are the last
    and the first of them."""

    def every(s, front):
        return let(interval_ends(s, num_intervals, flag), lambda ends: F.transform(ends, lambda e: F.concat(front, F.array_join(F.slice(s, F.lit(1), e), flag))))

    return _with_steps(text, flag, prefix, end_mark, every)

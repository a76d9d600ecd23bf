"""Intervals of texts in long form: a row for each step, for texts whose steps are rows already.

Where an interval ends depends on where the one before ended, so no window function can tell.  But from
any step the end of an interval that would begin there follows from prefix sums alone.  These jumps are composed with
themselves (pointer doubling), so the beginnings of all intervals are known after as many joins as the number
of intervals has binary digits.  Both sides grow with the texts, however small their files are, so none is sent to all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.sources.tables import materialised


def jumps(steps: DataFrame, num_intervals: int, flag: int) -> DataFrame:
    """key, step, to: where the interval after one that begins at ``step`` would begin; null if none does.

    For each text lengths up to each step, and lengths that beginnings ask for, are put in one order; the end that
    a beginning asks for is the next one there.
    """
    order = W.partitionBy("key").orderBy("step")
    upto = F.sum(F.col("length") + flag).over(order)
    whole = F.sum("length").over(W.partitionBy("key")) + (F.count(F.lit(1)).over(W.partitionBy("key")) - 1) * flag
    need = F.ceil(whole / F.lit(num_intervals))
    sums = steps.select("key", "step", upto.alias("upto"), (upto - F.col("length") - flag + need).alias("asked"))
    asked = F.array(F.struct(F.col("upto").alias("at"), F.lit(1).alias("is_end"), F.col("step").alias("step")), F.struct(F.col("asked").alias("at"), F.lit(0).alias("is_end"), F.col("step").alias("step")))
    rows = sums.select("key", F.inline(asked))
    falling = W.partitionBy("key").orderBy(F.desc("at"), F.desc("is_end"), F.desc("step"))
    nearest = F.last(F.when(F.col("is_end") == 1, F.col("step")), ignorenulls=True).over(falling.rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("to", nearest + 1).where("is_end = 0").select("key", "step", "to")


def segments(steps: DataFrame, num_intervals: int = 10, flag: int = 2) -> DataFrame:
    """key, step, segment of ``steps`` (key, step from 0 on, length): the interval, from 0 on, that each step is in.

    ``flag`` is the length of what joins steps.  The result is that of ``functions.arrays.interval_ends``.  Keys and
    steps aren't null, and a step comes once.  One text's steps are ordered in one task.
    """
    rows = materialised(steps.select("key", F.col("step").cast("int").alias("step"), F.col("length").cast("long").alias("length")), "steps")
    starts = rows.where("step = 0").select("key", "step", F.lit(0).alias("segment"))
    if num_intervals > 1:
        jump = materialised(jumps(rows, num_intervals, flag), "jumps")
        hops = 1
        while hops < num_intervals:
            there = starts.join(jump.hint("merge"), ["key", "step"]).where("to is not null").select("key", F.col("to").alias("step"), (F.col("segment") + hops).alias("segment"))
            starts = materialised(starts.unionByName(there), "starts")
            hops *= 2
            if hops < num_intervals:
                twice = jump.select("key", F.col("step").alias("to"), F.col("to").alias("then"))
                jump = materialised(jump.join(twice.hint("merge"), ["key", "to"]).select("key", "step", F.col("then").alias("to")), "jumps")
        starts = starts.where(F.col("segment") < num_intervals)
    latest = F.max("segment").over(W.partitionBy("key").orderBy("step"))
    return rows.join(starts.hint("merge"), ["key", "step"], "left").select("key", "step", latest.alias("segment"))

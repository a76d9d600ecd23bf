"""A sink that a run which was stopped goes on with.

Each round writes the results of some of the records as a part of its own, and then a manifest of the records that
are in it.  What counts is what manifests name: a part without one, which a stopped run may leave, is deleted when the
run goes on, and its records are worked on again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.tables import children, deleted, identified

PART, MANIFEST = "part-", "manifest-"


def _names(spark: SparkSession, path: str, prefix: str) -> set[str]:
    """Suffixes of folders in ``path``; of manifests those that were committed."""
    found = {n.removeprefix(prefix) for n in children(spark, path) if n.startswith(prefix)}
    return {n for n in found if prefix != MANIFEST or "_SUCCESS" in children(spark, f"{path}/{prefix}{n}")}


def finished(spark: SparkSession, path: str, key: str = "record_id") -> DataFrame | None:
    """The keys of the records whose results are in the sink; None before the first."""
    names = sorted(_names(spark, path, MANIFEST))
    return spark.read.parquet(*[f"{path}/{MANIFEST}{n}" for n in names]).select(key) if names else None


def results(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What finished rounds wrote."""
    names = sorted(_names(spark, path, MANIFEST))
    return spark.read.schema(schema).json([f"{path}/{PART}{n}" for n in names]) if names else spark.createDataFrame([], schema)


def resumed(records: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], key: str = "record_id", rounds: int = 8) -> int:
    """Write ``work(records)`` as JSON lines under ``path``, but for records that are there already; returns the number
    of rounds that had something to do.

    ``key`` tells records apart and is the same in each run: a column, or else the identity of rows of a file.  ``work``
    keeps it.  Records are dealt over rounds by its hash, so a stopped run loses one round at most.
    """
    spark = records.sparkSession
    rows = records if key in records.columns else identified(records, key)
    for name in _names(spark, path, PART) - _names(spark, path, MANIFEST):
        deleted(spark, f"{path}/{PART}{name}")
    before = finished(spark, path, key)
    todo = rows if before is None else rows.join(before, key, "left_anti")
    done = 0
    for i in range(rounds):
        mine = todo.where(F.pmod(F.xxhash64(key), F.lit(rounds)) == i)
        if mine.isEmpty():
            continue
        name = uuid.uuid4().hex
        work(mine).write.option("ignoreNullFields", "false").json(f"{path}/{PART}{name}")
        mine.select(key).write.parquet(f"{path}/{MANIFEST}{name}")
        done += 1
    return done

"""Questions to a model outside, each asked once: replies are kept by the digest of what was asked.

Equal prompts meet before anything is asked, and a reply table in a folder holds what earlier runs were told, so a run
asks only what is new to it.  What a model failed to answer isn't kept and will be asked again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.scorer import scored_batches
from plumbline.sources.tables import children, fresh, materialised

KEPT = "replies-"


def kept_replies(spark: SparkSession, folder: str, kind: str = "string") -> DataFrame:
    """digest, reply of what was answered so far."""
    parts = [f"{folder}/{n}" for n in sorted(children(spark, folder)) if n.startswith(KEPT) and "_SUCCESS" in children(spark, f"{folder}/{n}")]
    schema = f"digest string, reply {kind}"
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def answered(df: DataFrame, column: str, out: str, factory: Callable[[], Callable[[list], list]], folder: str | None = None, kind: str = "string", **how) -> DataFrame:
    """df with ``out``, the reply to ``column``; a null question has none.

    Each different text is asked once, whatever the number of its rows, and not at all where ``folder`` holds its
    reply; there new replies are added.  A batch that fails, or a null reply, leaves its rows without one.  ``how``
    goes to ``scored_batches``.  Runs jobs at once.
    """
    spark = df.sparkSession
    digest = fresh(df, "digest")
    rows = df.withColumn(digest, F.sha2(F.encode(F.col(column), "UTF-8"), 256))
    texts = rows.where(F.col(digest).isNotNull()).groupBy(F.col(digest).alias("digest")).agg(F.first(column).alias("text"))
    before = kept_replies(spark, folder, kind) if folder else None
    todo = texts if before is None else texts.join(before.select("digest"), "digest", "left_anti")
    new = scored_batches(todo, "text", "reply", factory, kind=kind, **({"on_error": None} | how)).where("reply is not null").select("digest", "reply")
    if folder:
        new.write.parquet(f"{folder}/{KEPT}{uuid.uuid4().hex}")
        known = kept_replies(spark, folder, kind).dropDuplicates(["digest"])  # two runs at a time may both have asked
    else:
        known = materialised(new, "replies")
    return rows.join(known.select(F.col("digest").alias(digest), F.col("reply").alias(out)), digest, "left").select(*[F.col(f"`{c}`") for c in df.columns if c != out], out)

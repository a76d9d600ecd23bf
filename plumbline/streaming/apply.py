"""Selection over a stream of scored records, with thresholds that are known already.

The percentile needs all jitters, so a stream takes its thresholds from a table that a batch
run wrote; everything else is row-local and keeps no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline import schemas
from plumbline.plans.selection import features, report_rows, selected
from plumbline.sources.jsonl import tolerant


def scored_stream(spark: SparkSession, path: str) -> DataFrame:
    """Scored records from JSON-lines files as they arrive; malformed lines are dropped."""
    return tolerant(spark.readStream.text(path), schemas.SCORED)


def report_stream(records: DataFrame, limits: DataFrame, config: schemas.SelectionConfig = schemas.SelectionConfig()) -> DataFrame:
    """Report rows of a stream of records; ``limits`` is a static table of one row."""
    return report_rows(selected(features(records, config), config, limits))

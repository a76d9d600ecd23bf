"""Selection from the command line: scored records in, report out, metrics shown."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from plumbline.plans import selection
from plumbline.schemas import SelectionConfig
from plumbline.sources import jsonl


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    p.add_argument("--input", required=True, help="JSON lines of scored records")
    p.add_argument("--output", required=True, help="folder of the report")
    p.add_argument("--sample_s", type=int, default=0)
    p.add_argument("--sample_e", type=int, default=16)
    p.add_argument("--v100_jitter", type=float, default=10, help="percent of high scorers' jitters that are too high")
    p.add_argument("--v0_jitter", type=float, default=90, help="percent of other candidates' jitters that are high enough")
    p.add_argument("--min_score", type=float, default=100)
    a = vars(p.parse_args(args))
    source, target = a.pop("input"), a.pop("output")
    config = SelectionConfig(**a)
    spark = spark or SparkSession.builder.appName("plumbline").getOrCreate()
    rows = selection.selected(selection.features(jsonl.read_scored(spark, source), config), config)
    jsonl.write_records(selection.report_rows(rows), target)
    selection.metrics(rows).show()


if __name__ == "__main__":
    main()

"""Selection over a stream whose thresholds aren't known: they are refreshed with every batch.

Each batch leaves two small things in a folder: its pools, which are far smaller than the records they come from,
and a quantile sketch of its jitters.  Sketches merge, so the thresholds of all that has arrived cost one row for each
batch to read.  A batch that is run again replaces what it left.  Once everything has arrived, exact
thresholds give the batch engine's report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.pruning import NO_THRESHOLD, threshold_point
from plumbline.plans.selection import features, jitters, report_rows, selected
from plumbline.schemas import SelectionConfig
from plumbline.sources.tables import children


class StreamedSelection:
    """What a stream of scored records has left in ``folder`` so far.  ``k``: the sketch's size; its ranks err by
    some 1.3 / k, and are exact up to about k values."""

    def __init__(self, spark: SparkSession, folder: str, config: SelectionConfig = SelectionConfig(), k: int = 4096):
        self.spark, self.folder, self.config, self.k = spark, folder, config, k

    def update(self, records: DataFrame, batch: int) -> None:
        """Take in a batch; for ``foreachBatch``."""
        at = f"{self.folder}/pools/batch={batch}"
        features(records, self.config).write.mode("overwrite").parquet(at)
        j = jitters(self.spark.read.parquet(at)).where("jitter is not null")
        good = F.when(~F.isnan("jitter"), F.col("jitter"))
        sketch = j.agg(F.kll_sketch_agg_double(good, F.lit(self.k)).alias("sketch"), F.count(good).alias("n"), F.count_if(F.isnan("jitter")).alias("nans"))
        sketch.write.mode("overwrite").parquet(f"{self.folder}/sketches/batch={batch}")

    def _read(self, kind: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.folder}/{kind}").drop("batch") if children(self.spark, f"{self.folder}/{kind}") else None

    def limits(self) -> DataFrame:
        """One row: t_hi and t_lo of all batches so far, by their merged sketches; 10000 where there are none, NaN where
        a jitter is."""
        sketches = self._read("sketches")
        if sketches is None:
            return self.spark.range(1).select(F.lit(NO_THRESHOLD).alias("t_hi"), F.lit(NO_THRESHOLD).alias("t_lo"))
        merged = sketches.agg(F.kll_merge_agg_double(F.when(F.col("n") > 0, F.col("sketch"))).alias("s"), F.sum("n").alias("n"), F.sum("nans").alias("nans"))

        def of(ratio: float) -> Column:
            point = threshold_point(ratio)
            if point is None:
                return F.lit(NO_THRESHOLD)
            found = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("s", F.lit(float(point))))
            return F.when(F.col("nans") > 0, float("nan")).otherwise(F.coalesce(found, F.lit(NO_THRESHOLD)))

        return merged.select(of(self.config.v100_jitter).alias("t_hi"), of(self.config.v0_jitter).alias("t_lo"))

    def report(self, exact: bool = True) -> DataFrame | None:
        """Report rows of all records so far: with exact thresholds, as a batch run over them would give, or with those
        of the sketches; None before the first batch."""
        pools = self._read("pools")
        return None if pools is None else report_rows(selected(pools, self.config, None if exact else self.limits()))

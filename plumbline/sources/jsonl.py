"""JSON-lines sources and sinks for nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import schemas


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of the lines that parse; blank and malformed lines, and those whose types don't fit,
    are dropped."""
    return tolerant(spark.read.text(path), schema)


def _parsed(lines: DataFrame, schema: T.StructType, column: str) -> DataFrame:
    """``lines`` with ``r``: the record of a line, null or with ``_corrupt_record`` where it is none."""
    with_bad = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return lines.withColumn("r", F.when(F.trim(column) != "", F.from_json(column, with_bad, {"columnNameOfCorruptRecord": "_corrupt_record"})))


GOOD = "r is not null and r._corrupt_record is null"


def tolerant(lines: DataFrame, schema: T.StructType, column: str = "value", seen: Observation | None = None) -> DataFrame:
    """``read_tolerant`` of lines that are a table already.  ``seen`` observes, in the pass that reads them, the
    numbers of ``lines``, of ``blank`` and of ``dropped`` ones (neither blank nor a record)."""
    parsed = _parsed(lines.select(column), schema, column)
    if seen is not None:
        blank = F.coalesce(F.trim(column) == "", F.lit(True))
        parsed = parsed.observe(seen, F.count(F.lit(1)).alias("lines"), F.count_if(blank).alias("blank"), F.count_if(~blank & ~F.expr(GOOD)).alias("dropped"))
    return parsed.where(GOOD).select(*[F.col(f"r.{f.name}") for f in schema.fields])


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, block, at: each line with its file, where the file's split that it begins in starts, and its place
    among the split's lines.  They are an identity without a pass of its own; ``row_index`` makes row numbers."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # Splits of a task follow each other, so what ids count beyond a split's least is a place in it.
    return lines.withColumn("at", F.monotonically_increasing_id())


def row_index(placed: DataFrame, lines: DataFrame) -> DataFrame:
    """``placed``, some of ``lines`` (``placed_lines``), with ``row``: the index of each in its file, from 0 on.  One
    more pass counts the lines of each split."""
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    starts = splits.select("file", "block", "least", F.coalesce(before, F.lit(0)).alias("before"))
    return placed.join(starts, ["file", "block"]).withColumn("row", F.col("at") - F.col("least") + F.col("before")).drop("least", "before")


def quarantined(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The records of ``read_tolerant`` and the lines that it drops: file, row (index in the file, from 0 on), value,
    reason (``blank``, ``not JSON``, or ``other types`` where it is JSON of another shape)."""
    lines = placed_lines(spark, path)
    parsed = _parsed(lines, schema, "value")
    kept = parsed.where(GOOD).select(*[F.col(f"r.{f.name}") for f in schema.fields])
    reason = F.when(F.trim("value") == "", "blank").when(F.try_parse_json("value").isNull(), "not JSON").otherwise("other types")
    bad = parsed.where(f"not coalesce({GOOD}, false)").withColumn("reason", reason)
    return kept, row_index(bad.drop("r"), lines).select("file", "row", "value", "reason")


def read_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All records; a malformed line fails the query.  Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_sampled(spark: SparkSession, path: str) -> DataFrame:
    return read_tolerant(spark, path, schemas.SAMPLED)


def read_to_score(spark: SparkSession, path: str) -> DataFrame:
    return read_tolerant(spark, path, schemas.TO_SCORE)


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """Scored records with at least one candidate."""
    return read_tolerant(spark, path, schemas.SCORED).where("candidates is not null and size(candidates) > 0")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table of questions: question_id, problem, gold_answer beside its own columns."""
    df = spark.read.parquet(path)
    return df.select(schemas.id_of(df).alias("question_id"), schemas.question_of(df).alias("problem"), schemas.gold_of(df).alias("gold_answer"), *[F.col(c) for c in df.columns if c not in ("question_id", "problem", "gold_answer")])


def write_records(df: DataFrame, path: str, files: int | None = None) -> None:
    """One part file per task, replaced as a whole when the job commits; null fields stay."""
    (df.coalesce(files) if files else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _there(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def merge_parts(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """All records of several outputs; outputs that aren't there are skipped."""
    found = [p for p in paths if _there(spark, p)]
    return spark.read.schema(schema).json(found) if found else spark.createDataFrame([], schema)


def part_counts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """part (its place in the list), found, lines of several outputs: what a merge would take from each."""
    out = spark.createDataFrame([(i, False, 0) for i in range(len(paths))], "part int, found boolean, lines long").where("false")
    for i, p in enumerate(paths):
        there = _there(spark, p)
        lines = spark.read.text(p).agg(F.count(F.lit(1)).alias("lines")) if there else spark.range(1).select(F.lit(0).cast("long").alias("lines"))
        out = out.unionByName(lines.select(F.lit(i).alias("part"), F.lit(there).alias("found"), "lines"))
    return out

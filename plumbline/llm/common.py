"""Shared plumbing of the training-data operators: tables, shared folders, row keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.sources.tables import deleted, fresh, materialised, ship

#: Bytes in one Arrow batch, the same for all operators; a row that is longer comes alone.
ARROW_BYTES = "4194304"
#: The characters that count as white space in every contract: space and \x09-\x0D.
SPACE = "[ \\t\\n\\x0B\\f\\r]"
#: A-Z to lower case, every other ASCII byte that is no letter or digit to a space; the rest stays.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark opens the path, so any Hadoop store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str, outer: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here, and
    a lost executor costs no recomputation of what came before."""
    return materialised(df, label, outer, by)


def drop_written(df: DataFrame, part: str = "") -> None:
    """Delete a table of ``written`` that no later plan reads, or of one with ``by`` a part, ``name=value``."""
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        while "=" in folder.rsplit("/", 1)[1]:
            folder = folder.rsplit("/", 1)[0]
        deleted(df.sparkSession, f"{folder}/{part}" if part else folder)


_caches: dict[str, Callable[[], None]] = {}


def sole(operator: str, clear: Callable[[], None] | None = None) -> None:
    """In a worker: what other operators keep there from task to task goes, so that the memory of one is
    enough.  ``clear`` empties what this one keeps, if it keeps anything."""
    if operator not in _caches:
        for other in list(_caches):
            _caches.pop(other)()
        _caches[operator] = clear or (lambda: None)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small by their bytes, and send this package to the workers.  The setting is
    one constant, so plans that are built at different times run alike."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def text_key(name: str = "text") -> Column:
    """Tells rows that repeat a doc_id with another text apart."""
    return F.xxhash64(F.coalesce(F.col(name), F.lit("")))


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with ``name``: the doc_id, where no two texts share one; else a number for each doc_id and
    ``text_key``, in their order.  Null where doc_id is null."""
    key = fresh(docs, "key")
    rows = docs.withColumn(key, text_key())
    pairs = rows.where("doc_id is not null").select("doc_id", key).distinct()
    if pairs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.withColumn(name, F.col("doc_id"))
    order = written(pairs.orderBy("doc_id", key).select("doc_id", key, F.monotonically_increasing_id().alias(name)), "numbers")
    return rows.join(order, ["doc_id", key], "left").select(*[F.col(f"`{c}`") for c in docs.columns], name)


def only(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of ``docs``, whole, that ``keep`` (doc_id, key, n) names by doc_id and ``text_key``; a null
    id is an id.  Of the n rows that share both, one stays: that of least hash of all its columns."""
    keep = written(keep, "kept")
    name, place = fresh(docs, "key"), fresh(docs, "place")
    rows = docs.withColumn(name, text_key())
    same = rows["doc_id"].eqNullSafe(keep["doc_id"]) & (rows[name] == keep["key"])
    rows_of = lambda which: rows.join(which, same, "left_semi")
    if keep.where("n > 1").isEmpty():
        return rows_of(keep).drop(name)
    order = W.partitionBy("doc_id", name).orderBy(F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))))
    one = rows_of(keep.where("n > 1")).withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return rows_of(keep.where("n = 1")).drop(name).unionByName(one.drop(name, place))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

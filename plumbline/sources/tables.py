"""Tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of this process: its own shared folder in tests, and paths of tables by scope.
_own: list[str] = []
_scopes: list[list[str]] = []
_run = uuid.uuid4().hex
_folders: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.  Only where that is unset and the
    master is local, as in tests, a folder of this process's own, which goes when the process ends."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="plumbline-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a folder by the file system that it is in."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []


def _at_exit(system, folder) -> None:
    from py4j.protocol import Py4JError

    try:
        system.delete(folder, True)
    except (Py4JError, OSError):  # the JVM has gone before
        pass


def deleted_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder when the process ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    atexit.register(_at_exit, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder)


def run_folder(spark: SparkSession) -> str:
    """The folder of this process's tables, deleted when the process ends."""
    path = f"{shared_folder(spark)}/plumbline/{_run}"
    if path not in _folders:
        _folders.add(path)
        deleted_at_exit(spark, path)
    return path


def materialised(df: DataFrame, label: str, outer: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: read twice, it is worked out
    once, and a lost executor costs nothing of it.  With ``outer`` it outlives the scope; ``by`` are
    columns whose values have folders of their own."""
    path = f"{run_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    for held in _scopes[:-1][-1:] if outer else _scopes[-1:]:
        held.append(path)
    df.write.parquet(path, compression="zstd", partitionBy=list(by) or None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Add this package to the Python path of all workers, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_plumbline_sent", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp()  # on the driver alone; Spark serves the file to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    out = Path(folder) / "plumbline_workers.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(f.relative_to(root.parent)))
    context.addPyFile(str(out))
    context._plumbline_sent = True


def fresh(df: DataFrame, name: str) -> str:
    """``name``, longer where the table has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def identified(df: DataFrame, name: str = "record_id") -> DataFrame:
    """df with an identity of each row, the same however often the result is read: of a Parquet file its path and the
    row's index there, without a pass over the data; rows of other plans are numbered and written once.  A
    table that has such a column keeps it."""
    if name in df.columns:
        return df
    try:
        place = F.concat(F.xxhash64("_metadata.file_path").cast("string"), F.lit(":"), F.col("_metadata.row_index").cast("string"))
        return df.select("*", place.alias(name))
    except AnalysisException:  # not the rows of files, or of files without such an index
        return materialised(df.withColumn(name, F.monotonically_increasing_id().cast("string")), "identified")


@contextmanager
def scope(spark: SparkSession):
    """Tables materialised within, but for outer ones, are deleted at the end.  What is read of them
    must have been written or collected by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            deleted(spark, path)

"""Question tables: conditional filters and samples that any engine can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def only_if_present(df: DataFrame, column: str, value) -> DataFrame:
    """Rows where the column has this value; all rows where there is no such column."""
    return df.where(F.col(column) == value) if column in df.columns else df


def hash_sample(df: DataFrame, key: str, n: int, seed: int | None = None) -> DataFrame:
    """n rows, the same whatever the order and partitions: those of least md5 of the key, behind the
    seed if there is one.  -1 takes all rows.  Each task keeps its n least before anything is
    shuffled."""
    text = F.col(key).cast("string") if seed is None else F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))
    return df if n < 0 else df.orderBy(F.md5(F.encode(text, "UTF-8")), key).limit(n)

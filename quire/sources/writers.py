"""Writing records and keeping stores within bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAME = r"^[\p{L}\p{N}_][\p{L}\p{N}_.\-]*$"


def object_name(prefix: str, *parts: Column) -> Column:
    """prefix and parts joined by slashes; null where a part could leave the prefix."""
    safe = None
    for p in parts:
        ok = F.coalesce(p.rlike(NAME) & ~F.contains(p, F.lit("..")), F.lit(False))
        safe = ok if safe is None else safe & ok
    return F.when(safe, F.concat_ws("/", F.lit(prefix.strip("/")), *parts))


def append_capped(stored: DataFrame, new: DataFrame, order: list[str], keep: int = 2000) -> DataFrame:
    """stored and new rows, the last `keep` by order: a distributed top-k."""
    return stored.unionByName(new).orderBy(*[F.desc(c) for c in order]).limit(keep)


def append_capped_per(stored: DataFrame, new: DataFrame, by: list[str], order: list[str], keep: int = 2000) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]))
    return stored.unionByName(new).withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank")


def write_records(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Parquet with Spark's commit protocol, partitioned where asked."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)

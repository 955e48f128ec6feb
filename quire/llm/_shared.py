"""Helpers that the training-data operators share: scratch tables, typed reads, heavy keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that separate words: space and U+0009 to U+000D.
WORD_SPACE = r"\x20\x09-\x0D"
WORD_SPACE_RUN = f"[{WORD_SPACE}]+"
#: Bitmaps of keep_keys that are broadcast: 64 MB, for 500 million rows.
MAX_BITMAPS = 16_384


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path is only ever opened by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only a local master (as in tests) may fall back to a temporary folder; on a cluster a missing
    setting is an error, since a machine-local folder would lose rows.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="quire-scratch-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/quire/{label}-{uuid.uuid4().hex}"


#: Scratch tables written in this process, in order; those dropped since are still named.
written: list[str] = []


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared scratch folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _keyed(df: DataFrame, key: str, wanted: DataFrame, keep: bool) -> DataFrame:
    bucket, bits, at = spare_name(df, "kk_bucket"), spare_name(df, "kk_bits"), F.bitmap_bit_position(ticked(key))
    maps = wanted.groupBy(F.bitmap_bucket_number("key").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("key")).alias(bits))
    maps = materialise(maps, "bitmaps")
    small = maps.count() <= MAX_BITMAPS
    byte = F.conv(F.hex(F.substring(ticked(bits), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = df.withColumn(bucket, F.bitmap_bucket_number(ticked(key))).join(F.broadcast(maps) if small else maps, bucket, "inner" if keep else "left")
    among = F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return found.where(among if keep else ~among).select(*[ticked(c) for c in df.columns])


def keep_keys(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of df whose key (a row number from monotonically_increasing_id) is in wanted(key).

    The keys travel as bitmaps, 4 KB for 32,768 neighbouring row numbers. Up to MAX_BITMAPS of them are
    broadcast, so df is not shuffled; beyond, each bitmap meets its rows by a join on the bucket, which is
    the same size for every key.
    """
    return _keyed(df, key, wanted, True)


def drop_keys(df: DataFrame, key: str, unwanted: DataFrame) -> DataFrame:
    """The rows of df whose key is not in unwanted(key), by the same bitmaps."""
    return _keyed(df, key, unwanted, False)


def join_salted(rows: DataFrame, small: DataFrame, key: str, how: str = "left", salts: int = 64) -> DataFrame:
    """rows joined to `small`, one row a key: a hot key's rows are dealt over `salts`, however the join runs.

    The optimizer broadcasts small while its size allows it. Both sides have the column `key`.
    """
    salt = spare_name(rows, "salt")
    dealt = rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [key, salt], how).drop(salt)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_tables(spark: SparkSession, paths: list[str], readers: DataFrame) -> list[str]:
    """Delete the scratch tables at paths that `readers` does not read; returns those it reads, which stay."""
    read = {part for file in readers.inputFiles() for part in file.split("/")[-3:]} if paths else set()
    kept = [p for p in paths if p.rsplit("/", 1)[1] in read]
    for p in set(paths).difference(kept):
        _delete(spark, p)
    return kept


def clear_scratch(spark: SparkSession) -> None:
    """Delete all written tables of this package; call it when no result that reads them is still needed."""
    _delete(spark, f"{scratch_root(spark)}/quire")


def words_of(text: Column) -> Column:
    """Array of words `[^\\x20\\x09-\\x0D]+`; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPACE_RUN), lambda w: w != "")


def lines_of(text: Column) -> Column:
    """Array of the lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def count_chars(text: Column, chars: str) -> Column:
    """How many code points of text are in the character class `chars` (a regular expression)."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))).cast("long")


def settled(value: Column) -> Column:
    """value, worked out once per row where it is defined.

    A condition on a column is otherwise rewritten in terms of the column's inputs, which repeats costly
    array expressions inside each other's lambdas. A row counter, which may not be moved, stops that.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lower the session's rows per Arrow batch to `rows`, never raise them: whole texts are long rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def spare_name(df: DataFrame, name: str) -> str:
    """name, prefixed until no column of df has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ticked(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")

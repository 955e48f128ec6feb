"""Proportional stratified interleaving into shards of equal row counts.

Rows are shuffled by a seeded digest, ranked within their source, given the fractional rank
(2 * rank - 1) / (2 * rows of the source), and sorted by it; the global order is cut into equal runs, so
every shard holds each source in the proportion of the whole (law `rows`).

Ranks are never taken over a whole source in one task. Digests are uniform, so a source is split by the
digest's leading digits into cells, more of them for larger tables; a rank is the rows of earlier cells (a
running sum over the small table of cells) plus the rank inside the cell. The global order is dealt by
ranges and sorted within them; a row's place is the rows of earlier ranges plus its number in its own. Only
narrow rows are shuffled; texts stay in the scan.

Defined cases: null text has size 8 and the checksum of no bytes; a null source is a stratum of its own; a
row without an id is shuffled by its text; repeated rows take one slot each; rows alike in every ranked column are interchangeable; an empty table
gives an empty result; further columns are ignored. Fewer rows than shards leave later shards empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm._shared import materialise, table, ticked

SHARDS = 24
SEED = "42"
#: A source is split by at least this many hex digits of the digest, and by more until a cell holds about so many rows.
CELL_DIGITS, CELL_ROWS = 3, 100_000


def seeded_digest(id_col: Column, text: Column, seed: str = SEED) -> Column:
    """Seeded digest of the id, or of the text where there is no id."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.concat(F.lit("-"), F.md5(text)))).cast("binary"))


def ranked_in_cells(rows: DataFrame, group: list[str], cell: str, order: list[str]) -> DataFrame:
    """rows with `rank`, from 1 in each group by (cell, order), and `of`, the rows of the group, without a window over it."""
    cells = rows.groupBy(*group, cell).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(*group, cell, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias("of"))
    inside = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*group, cell).orderBy(*order)))
    return inside.join(starts, [*group, cell]).withColumn("rank", F.col("__before") + F.col("__rank")).drop("__before", "__rank")


def interleave(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """(id, source, size, text_crc32, shard, slot): one row per row of docs."""
    text = F.coalesce(ticked(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        ticked(id_col).alias("id"),
        ticked(source_col).alias("source"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        seeded_digest(ticked(id_col), text, seed).alias("digest"),
    )
    # A null source and the text of the same letters stay apart.
    rows = rows.withColumn("stratum", F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source").cast("string"))))
    rows = materialise(rows, "shuffled")
    total = rows.count()
    digits = max(CELL_DIGITS, math.ceil(math.log(max(total / CELL_ROWS, 1), 16)))
    ranked = ranked_in_cells(rows.withColumn("cell", F.substring("digest", 1, digits)), ["stratum"], "cell", ["digest", "id", "text_crc32", "size"])
    placed = _global_rank(ranked.withColumn("fraction", (2 * F.col("rank") - 1).cast("double") / (2 * F.col("of")).cast("double")))
    at = F.col("position") - 1
    exact = F.expr(f"(position - 1) * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", exact.cast("int")).withColumn("slot", (at - first).cast("long")).select("id", "source", "size", "text_crc32", "shard", "slot")


def _global_rank(share: DataFrame) -> DataFrame:
    """position: the rank from 1 over all rows by fraction; the table of ranges has one row a partition."""
    order = ["fraction", "stratum", "digest", "id", "text_crc32", "size"]
    numbered = share.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    numbered = materialise(numbered.withColumn("range", F.shiftright("at", 33)), "ordered")
    ranges = numbered.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.col("at") - F.shiftleft("range", 33)
    return numbered.join(F.broadcast(starts), "range").withColumn("position", F.col("before") + inside + 1)


def op5_interleave(spark, sf_dir: str) -> DataFrame:
    found = interleave(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

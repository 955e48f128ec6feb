"""Figures and captioned tables of word-processor documents, from their blocks in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import caption

# How captions start here, and how many rows a document keeps.
FIGURE_START = r"(?i)^\s*(?:Fig(?:ure)?|Scheme)\.?\s*S?\d+[a-z]?\b"
TABLE_START = r"(?i)^\s*Table\.?\s*S?\d+[a-z]?\b"
MOST = 200


def docx_figures(blocks: DataFrame, doc: str, order: str, most: int = MOST) -> DataFrame:
    """(doc, n, kind, order, image, caption, content): images with the caption that serves them, and captioned tables.

    blocks: (doc, order, kind, text, images); kind is `table`, whose text is its cells, or anything else for a
    paragraph, whose images are an array. Images wait for the next block that has text or is a table: a
    paragraph that starts like a figure caption serves all that wait, any other block discards them. A
    paragraph may caption its own images; while others wait it serves those instead. A table needs a paragraph
    that starts like a table caption before it, with no other text between, unless that text belongs to images.
    Rows come in the order in which they are settled, numbered from 1.
    """
    by = Window.partitionBy("d").orderBy("o")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
    table = F.col("kind") == "table"
    none = F.array().cast("array<string>")
    rows = blocks.select(F.col(doc).alias("d"), F.col(order).alias("o"), table.alias("table"), caption(F.col("text")).alias("said"), F.when(table, none).otherwise(F.coalesce("images", none)).alias("shown"), F.col("text").alias("content"))
    rows = rows.withColumn("fig", ~F.col("table") & F.col("said").rlike(FIGURE_START)).withColumn("tab", ~F.col("table") & F.col("said").rlike(TABLE_START))
    rows = rows.withColumn("images", F.size("shown") > 0).withColumn("event", F.col("table") | (F.col("said") != ""))
    # A run: blank paragraphs and the event that ends them. Images wait there if a blank paragraph of the run
    # has some, or the event before it was a paragraph of images and plain text.
    rows = rows.withColumn("run", F.coalesce(F.sum(F.col("event").cast("int")).over(before), F.lit(0)))
    left = F.last(F.when(F.col("event"), F.col("images") & ~F.col("fig")), ignorenulls=True).over(before)
    blank = F.max(F.col("images") & ~F.col("event")).over(Window.partitionBy("d", "run"))
    rows = rows.withColumn("waiting", blank | F.coalesce(left, F.lit(False)))
    serves = F.col("fig") & F.col("waiting")
    ended = F.first(F.when(F.col("event"), F.struct(F.col("o").alias("at"), "fig", "said")), ignorenulls=True).over(after)
    held = F.when(F.col("tab"), F.struct(F.lit(True).alias("open"), F.col("said").alias("said")))
    held = held.when(F.col("table") | ((F.col("said") != "") & ~F.col("images") & ~serves), F.struct(F.lit(False).alias("open"), F.lit("").alias("said")))
    rows = rows.withColumn("ended", ended).withColumn("held", F.last(held, ignorenulls=True).over(before))
    own = F.when(F.col("fig") & ~F.col("waiting"), F.struct(F.col("o").alias("at"), "said"))
    other = F.when(~F.col("fig") & F.col("ended.fig"), F.struct(F.col("ended.at").alias("at"), F.col("ended.said").alias("said")))
    figures = rows.where("images").withColumn("cap", F.coalesce(own, other)).where("cap IS NOT NULL")
    figures = figures.select("d", "cap.at", "o", F.posexplode("shown").alias("pos", "image"), F.lit("figure").alias("kind"), F.col("cap.said").alias("caption"), F.lit(None).cast("string").alias("content"))
    tables = rows.where(F.col("table") & (F.col("said") != "") & F.col("held.open"))
    tables = tables.select("d", F.col("o").alias("at"), "o", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("image"), F.lit("table").alias("kind"), F.col("held.said").alias("caption"), "content")
    settled = figures.unionByName(tables).withColumn("n", F.row_number().over(Window.partitionBy("d").orderBy("at", "o", "pos")))
    return settled.where(F.col("n") <= most).select(F.col("d").alias(doc), "n", "kind", F.col("o").alias(order), "image", "caption", "content")

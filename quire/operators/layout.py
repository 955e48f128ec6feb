"""Reading order of page blocks, caption lines from words, figure lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.refs import caption_key, caption_order
from quire.functions.text import normalize_page

# What makes a page two columns; what joins words into lines.
LEAST_BLOCKS, LEAST_IN_COLUMN, LEAST_GAP = 4, 2, 0.18
LINE_PT, WORD_GAP_PT = 2.0, 14.0
MOST_FIGURES = 200


def usable_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with text of at least two ASCII letters or digits and a positive box."""
    letters = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]", ""))
    return blocks.where((letters >= 2) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))


def reading_order(blocks: DataFrame, page: list[str], once: bool = False) -> DataFrame:
    """(page keys, text, is_multicolumn) from blocks (page keys, block_no, x0, y0, x1, y1, text, page_width).

    A page is two columns when its blocks split at the median centre into two sides far enough apart;
    then the left side comes before the right, each from top to bottom. `once` is that of normalize_page.
    """
    centre = (F.col("x0") + F.col("x1")) / 2
    by_page = Window.partitionBy(*page)
    ranked = blocks.withColumn("c", centre).withColumn("k", F.row_number().over(by_page.orderBy("c", "block_no"))).withColumn("n", F.count(F.lit(1)).over(by_page))
    middle = F.max(F.when(F.col("k") == F.floor(F.col("n") / 2) + 1, F.col("c"))).over(by_page)
    sided = ranked.withColumn("right", F.col("c") >= middle)
    width = F.when(F.max("page_width") > 0, F.max("page_width")).otherwise(F.greatest(F.max("x1") - F.min("x0"), F.lit(0.0)))
    place = F.struct("right", F.round("y0", 1).alias("y"), "x0", "block_no", "text")
    flow = F.struct("y0", "x0", "block_no", "text")
    pages = sided.groupBy(*page).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("right")).alias("n_right"),
        (F.avg(F.when(F.col("right"), F.col("c"))) - F.avg(F.when(~F.col("right"), F.col("c")))).alias("gap"),
        F.when(width > 0, width).otherwise(1.0).alias("width"),
        F.sort_array(F.collect_list(place)).alias("columns"),
        F.sort_array(F.collect_list(flow)).alias("flow"),
    )
    two = (F.col("n") >= LEAST_BLOCKS) & (F.col("n_right") >= LEAST_IN_COLUMN) & (F.col("n") - F.col("n_right") >= LEAST_IN_COLUMN) & (F.col("gap") >= F.col("width") * LEAST_GAP)
    side = lambda right: F.array_join(F.transform(F.filter("columns", lambda b: b["right"] == right), lambda b: b["text"]), "\n")
    text = F.when(two, F.concat(side(False), F.lit("\n\n"), side(True))).otherwise(F.array_join(F.transform("flow", lambda b: b["text"]), "\n"))
    return pages.select(*page, normalize_page(text, once).alias("text"), F.coalesce(two, F.lit(False)).alias("is_multicolumn"))


def join_pages(pages: DataFrame, doc: str, page: str, text: str = "text") -> DataFrame:
    """(doc, text): pages with text, in order, with a blank line between."""
    kept = pages.where(F.trim(text) != "").groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(page, text))).alias("all"))
    return kept.select(doc, F.array_join(F.transform("all", lambda p: p[text]), "\n\n").alias(text))


def caption_lines(words: DataFrame, page: list[str]) -> DataFrame:
    """(page keys, line, part, x0, y0, x1, y1, text) from words (page keys, x0, y0, x1, y1, word).

    Words share a line when their tops fall into the same 2-point band; a wide gap cuts the line.
    """
    banded = words.withColumn("line", F.round(F.col("y0") / LINE_PT).cast("long"))
    along = Window.partitionBy(*page, "line").orderBy("x0", "word", "x1")
    cut = (F.col("x0") - F.lag("x1").over(along) > WORD_GAP_PT).cast("int")
    parts = banded.withColumn("cut", F.coalesce(cut, F.lit(0))).withColumn("part", F.sum("cut").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = parts.groupBy(*page, "line", "part").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sort_array(F.collect_list(F.struct("x0", "word"))).alias("w")
    )
    return grouped.select(*page, "line", "part", "x0", "y0", "x1", "y1", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"))


def overlap_share(a: Column, b: Column) -> Column:
    """Intersection of two boxes (structs of x0, y0, x1, y1) over the smaller area."""
    w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
    h = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    least = F.least(area(a), area(b))
    return F.when(least > 0, w * h / least).otherwise(0.0)


def heavily_overlap(a: Column, b: Column) -> Column:
    return overlap_share(a, b) > 0.55


def assemble_figures(found: DataFrame, doc: str, caption: str = "caption", place: tuple[str, ...] = ("page", "y0", "x0"), most: int = MOST_FIGURES) -> DataFrame:
    """(doc, ord, figure_id, caption): figures in caption order, one per caption key, numbered by kind."""
    key = F.coalesce(caption_key(F.col(caption)), F.concat(F.lit("raw:"), F.lower(F.substring(caption, 1, 40))))
    keyed = found.withColumn("_o", caption_order(F.col(caption))).withColumn("_k", key)
    order = ["_o", *place]
    first = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(doc, "_k").orderBy(*order))).where("_n = 1")
    placed = first.withColumn("ord", F.row_number().over(Window.partitionBy(doc).orderBy(*order)) - 1).where(F.col("ord") < most)
    table = F.col("_o")["kind"] == 2
    number = F.row_number().over(Window.partitionBy(doc, table).orderBy("ord"))
    return placed.withColumn("_i", number).select(doc, "ord", F.format_string("%s-%04d", F.when(table, "tbl").otherwise("fig"), "_i").alias("figure_id"), caption)


# A label without its number, the number that may follow it, a caption that starts inside a line.
LABEL_ALONE, NUMBER_FIRST = r"(?i)^\s*(Fig(?:ure)?|Scheme|Table)\.?\s*$", r"(?i)^\s*S?\d+[a-z]?\b"
INLINE_CAPTION = r"(?i)(?:^|(?<![A-Za-z])\s+)((?:Fig(?:ure)?|Scheme|Table)\.?\s*S?\d+[a-z]?\b.*)$"
BAND_PT, FOLLOW_PT = 4.0, 28.0
ABSTRACT_PAGES, ABSTRACT_SIDE, ABSTRACT_AREA, HEADER_SHARE = 1, 80.0, 12_000.0, 0.08


def join_labels(lines: DataFrame, page: list[str], order: str = "line_no") -> DataFrame:
    """Lines with a lone label joined to the number that follows it in the same band."""
    along = Window.partitionBy(*page).orderBy(order)
    nxt = lambda c: F.lead(c).over(along)
    joins = F.col("text").rlike(LABEL_ALONE) & F.coalesce(nxt("text").rlike(NUMBER_FIRST), F.lit(False)) & (F.abs(F.col("y0") - nxt("y0")) <= BAND_PT)
    marked = lines.withColumn("_j", F.coalesce(joins, F.lit(False)))
    # A number that starts a line is never a lone label, so joins cannot chain.
    wide = {"x0": F.least("x0", nxt("x0")), "y0": F.least("y0", nxt("y0")), "x1": F.greatest("x1", nxt("x1")), "y1": F.greatest("y1", nxt("y1")), "text": F.concat_ws(" ", F.trim("text"), F.trim(nxt("text")))}
    made = marked.withColumn("_gone", F.coalesce(F.lag("_j").over(along), F.lit(False))).select("*", *[v.alias("_" + k) for k, v in wide.items()])
    return made.where(~F.col("_gone")).select(*page, order, *[F.when(F.col("_j"), F.col("_" + k)).otherwise(F.col(k)).alias(k) for k in ("x0", "y0", "x1", "y1", "text")])


def caption_hits(lines: DataFrame, page: list[str], order: str = "line_no", figures: bool = True, tables: bool = False) -> DataFrame:
    """(page, line_no, caption_key, caption): captions with the lines that follow closely.

    A caption may start inside a line. It takes the lines behind it until the next caption, or until one
    stands too far below its first line.
    """
    from quire.functions.refs import is_caption
    from quire.functions.text import caption

    along = Window.partitionBy(*page).orderBy(order)
    inline = F.trim(F.regexp_extract("text", INLINE_CAPTION, 1))
    head = lines.withColumn("_h", F.when(inline != "", inline).otherwise(F.col("text")))
    head = head.withColumn("_is", is_caption(F.col("_h"), figures, tables)).withColumn("_g", F.sum(F.col("_is").cast("int")).over(along)).where("_g > 0")
    inside = Window.partitionBy(*page, "_g").orderBy(order)
    far = (F.col("y0") > F.first("y1").over(inside) + FOLLOW_PT) & ~F.col("_is")
    near = head.withColumn("_far", far.cast("int")).withColumn("_out", F.max("_far").over(inside)).where("_out = 0")
    parts = near.groupBy(*page, "_g").agg(F.min(order).alias(order), F.sort_array(F.collect_list(F.struct(order, F.when(F.col("_is"), F.col("_h")).otherwise(F.col("text")).alias("t")))).alias("p"))
    made = parts.select(*page, order, caption(F.array_join(F.transform("p", lambda x: x["t"]), " ")).alias("caption")).withColumn("caption_key", caption_key(F.col("caption")))
    table = F.col("caption_key").startswith("table:")
    return made.where(F.col("caption_key").isNotNull() & (table if tables and not figures else ~table if figures and not tables else F.lit(True)))


def graphical_abstracts(images: DataFrame, blocks: DataFrame, page: list[str], page_no: str = "page") -> DataFrame:
    """Images of the first pages that are large, below the header, and near the word abstract."""
    from quire.operators.figures import beside

    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    large = (F.col(page_no) <= ABSTRACT_PAGES) & (F.least(w, h) >= ABSTRACT_SIDE) & (w * h >= ABSTRACT_AREA) & (F.col("y1") >= HEADER_SHARE * F.col("page_height"))
    boxes = ("x0", "y0", "x1", "y1")
    label = blocks.where(F.col("text").rlike(r"(?i)\babstract\b")).select(*page, *[F.col(c).alias("b" + c) for c in boxes])
    near = images.where(large).select("*", *[F.col(c).alias("i" + c) for c in boxes]).join(label, page)
    band = (F.col("by1") >= F.col("iy0") - 80) & (F.col("by0") <= F.col("iy1") + 40)
    gap = F.greatest(F.col("ix0") - F.col("bx1"), F.col("bx0") - F.col("ix1"), F.lit(0.0))
    hits = near.where(band & (beside("b", "i") | (gap < 120)))
    return hits.select(*images.columns).distinct()


def nearest_caption(anchors: DataFrame, blocks: DataFrame, page: list[str], anchor: str, above: bool) -> DataFrame:
    """(page, anchor, caption): the closest caption above a table, or below an image."""
    from quire.functions.refs import is_caption
    from quire.functions.text import caption
    from quire.operators.figures import ABOVE, BELOW, beside

    boxes = ("x0", "y0", "x1", "y1")
    text = blocks.where(is_caption(F.col("text"), figures=not above, tables=above)).select(*page, caption(F.col("text")).alias("caption"), *[F.col(c).alias("b" + c) for c in boxes])
    pairs = anchors.select(*page, anchor, *[F.col(c).alias("i" + c) for c in boxes]).join(text, page).where(beside("b", "i"))
    if above:
        return pairs.where(F.col("by1").between(F.col("iy0") - ABOVE, F.col("iy0") + 4)).groupBy(*page, anchor).agg(F.max_by("caption", F.struct("by0", "caption")).alias("caption"))
    return pairs.where(F.col("by0").between(F.col("iy1") - 2, F.col("iy1") + BELOW)).groupBy(*page, anchor).agg(F.min_by("caption", F.struct("by0", "caption")).alias("caption"))

"""Pairing captions with images and tables on a page."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values, in points: how far an image may be from its caption.
BELOW, ABOVE, SLACK, SIDE, SHARE = 150.0, 120.0, 10.0, 40.0, 0.12
OVERLAP = 0.55
LEAST_SIDE, LEAST_BYTES = 40.0, 2000
TABLE_WIDTH, TABLE_HEIGHT, TABLE_OVERLAP = 40.0, 30.0, 0.5


def embedded(images: DataFrame, keys: list[str]) -> DataFrame:
    """Image placements large enough to be figures, once each."""
    side = F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return images.where((side >= LEAST_SIDE) & (F.col("bytes") >= LEAST_BYTES)).dropDuplicates([*keys, "xref", "x0", "y0", "x1", "y1"])


def beside(a: str, b: str) -> Column:
    """Whether box a overlaps box b sideways enough, or has its middle near it (columns prefixed a, b)."""
    c = lambda p, n: F.col(f"{p}{n}")
    overlap = F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0"))
    middle = (c(a, "x0") + c(a, "x1")) / 2
    return (overlap >= SHARE * F.greatest(c(b, "x1") - c(b, "x0"), F.lit(1.0))) | middle.between(c(b, "x0") - SIDE, c(b, "x1") + SIDE)


def candidates(captions: DataFrame, images: DataFrame, page: list[str]) -> DataFrame:
    """Pairs (page, caption_no, image_no, mode, gap, area) that the distances allow; mode 0: image above."""
    boxes = ("x0", "y0", "x1", "y1")
    c = captions.select(*page, "caption_no", *[F.col(b).alias("c" + b) for b in boxes])
    i = images.select(*page, "image_no", *[F.col(b).alias("i" + b) for b in boxes])
    near = c.join(i, page).where(beside("c", "i") | beside("i", "c"))
    below, above = F.col("cy0") - F.col("iy1"), F.col("iy0") - F.col("cy1")
    mode = F.when(below.between(0, BELOW), 0).when(above.between(0, ABOVE), 1)
    area = (F.col("ix1") - F.col("ix0")) * (F.col("iy1") - F.col("iy0"))
    return near.withColumn("mode", mode).where("mode is not null").select(*page, "caption_no", "image_no", "mode", F.when(F.col("mode") == 0, below).otherwise(above).alias("gap"), area.alias("area"), *[F.col("i" + b).alias(b) for b in boxes])


def table_candidates(captions: DataFrame, tables: DataFrame, page: list[str]) -> DataFrame:
    """The same for tables (page, image_no, x0, y0, x1, y1) of a least size; mode 0: the table below its caption."""
    boxes = ("x0", "y0", "x1", "y1")
    c = captions.select(*page, "caption_no", *[F.col(b).alias("c" + b) for b in boxes])
    i = tables.where((F.col("x1") - F.col("x0") >= TABLE_WIDTH) & (F.col("y1") - F.col("y0") >= TABLE_HEIGHT)).select(*page, "image_no", *[F.col(b).alias("i" + b) for b in boxes])
    under, over = F.col("iy0") - F.col("cy1"), F.col("cy0") - F.col("iy1")
    mode = F.when(under.between(0, ABOVE), 0).when(over.between(0, BELOW), 1)
    area = (F.col("ix1") - F.col("ix0")) * (F.col("iy1") - F.col("iy0"))
    near = c.join(i, page).where(beside("c", "i")).withColumn("mode", mode).where("mode is not null")
    return near.select(*page, "caption_no", "image_no", "mode", F.when(F.col("mode") == 0, under).otherwise(over).alias("gap"), area.alias("area"), *[F.col("i" + b).alias(b) for b in boxes])


def _shares(a: tuple, b: tuple, part: float = OVERLAP) -> bool:
    """Whether two boxes (x0, y0, x1, y1) overlap by more than `part` of the smaller."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return w > 0 and h > 0 and w * h > part * min((x[2] - x[0]) * (x[3] - x[1]) for x in (a, b))


def assign(captions: DataFrame, images: DataFrame, page: list[str], tables: bool = False, after: DataFrame | None = None) -> DataFrame:
    """(page, caption_no, image_no, mode): in caption order each takes its best image not yet covered.

    Candidates come from a join bounded by the page, best first; the choice is sequential within a page
    and runs over whole partitions, holding the boxes taken on one page. Images of `after` (page, image_no,
    box) come behind all captions, in their own order: each is taken, without a caption, if nothing covers it.
    Of candidates alike in all else the box decides, so that the answer is one.
    """
    boxes = ["x0", "y0", "x1", "y1"]
    found = (table_candidates if tables else candidates)(captions, images, page)
    part = TABLE_OVERLAP if tables else OVERLAP
    kinds = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in [*page, "caption_no", "image_no", "mode"])
    if after is not None:
        alone = after.select(*page, F.lit(None).alias("caption_no"), "image_no", F.lit(None).alias("mode"), F.lit(0.0).alias("gap"), F.lit(0.0).alias("area"), *boxes)
        found = found.unionByName(alone)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, served, used = None, None, []
        for pdf in batches:
            keep = []
            for row in zip(*[pdf[c] for c in [*page, "caption_no", *boxes]]):
                where, caption, box = row[: len(page)], row[len(page)], row[len(page) + 1 :]
                if where != here:
                    here, served, used = where, None, []
                take = (pd.isna(caption) or caption != served) and not any(_shares(box, u, part) for u in used)
                if take:
                    served = caption
                    used.append(box)
                keep.append(take)
            yield pdf.loc[keep, [*page, "caption_no", "image_no", "mode"]].astype({"caption_no": "Int64", "mode": "Int32"})

    order = [F.asc_nulls_last("caption_no"), F.asc_nulls_last("mode"), "gap", F.desc("area"), "image_no", *boxes]
    return found.repartition(*page).sortWithinPartitions(*page, *order).mapInPandas(choose, kinds)


def column_band(page_x0: Column, page_x1: Column, x0: Column, x1: Column, bleed: float) -> Column:
    """The page column that a caption stands in, a little wider, never narrower than the caption."""
    middle, pad = (page_x0 + page_x1) / 2, 6.0
    spill = (page_x1 - page_x0) * bleed
    left = (x0 + x1) / 2 <= middle
    low = F.when(left, page_x0 + pad).otherwise(F.greatest(page_x0 + pad, middle - spill))
    high = F.when(left, F.least(page_x1 - pad, middle + spill)).otherwise(page_x1 - pad)
    return F.struct(F.least(low, x0).alias("x0"), F.greatest(high, x1).alias("x1"))


def figure_clip(page: dict[str, Column], cap: dict[str, Column]) -> Column:
    """Where a caption without an image has its drawing: above it."""
    band = column_band(page["x0"], page["x1"], cap["x0"], cap["x1"], 0.08)
    return F.struct(band["x0"].alias("x0"), F.greatest(page["y0"], cap["y0"] - 280).alias("y0"), band["x1"].alias("x1"), F.least(page["y1"], cap["y1"] + 4).alias("y1"))


def table_clip(page: dict[str, Column], cap: dict[str, Column]) -> Column:
    """Where a table caption has its table: below it."""
    band = column_band(page["x0"], page["x1"], cap["x0"], cap["x1"], 0.10)
    return F.struct(band["x0"].alias("x0"), F.greatest(page["y0"], cap["y0"] - 4).alias("y0"), band["x1"].alias("x1"), F.least(page["y1"], cap["y1"] + 260).alias("y1"))


def _captioned(first: DataFrame, taken: DataFrame, images: DataFrame, pages: DataFrame, page: list[str], tables: bool) -> DataFrame:
    """Rows of captions with their targets: the clip of both boxes, or where the target must be."""
    boxes = images.select(*page, "image_no", *[F.col(b).alias("i" + b) for b in ("x0", "y0", "x1", "y1")])
    rows = first.join(taken, [*page, "caption_no"], "left").join(boxes, [*page, "image_no"], "left").join(pages, page)
    sheet, cap = {b: F.col("p" + b) for b in ("x0", "y0", "x1", "y1")}, {b: F.col(b) for b in ("x0", "y0", "x1", "y1")}
    band = column_band(sheet["x0"], sheet["x1"], cap["x0"], cap["x1"], 0.10 if tables else 0.08)
    joint = F.struct(F.least("x0", "ix0", band["x0"]).alias("x0"), F.least("y0", "iy0").alias("y0"), F.greatest("x1", "ix1", band["x1"]).alias("x1"), F.greatest("y1", "iy1").alias("y1"))
    alone = (table_clip if tables else figure_clip)(sheet, cap)
    clip = F.when(F.col("image_no").isNotNull(), joint).otherwise(alone)
    return rows.select(*page, "caption_no", "caption_key", "image_no", clip.alias("clip"), F.least("y0", "iy0").alias("y"), F.least("x0", "ix0").alias("x"))


def _first_keys(captions: DataFrame, page: list[str]) -> DataFrame:
    """Captions (page, caption_no, caption_key, box): of equal keys on a page the first."""
    return captions.groupBy(*page, "caption_key").agg(F.min(F.struct("caption_no", "x0", "y0", "x1", "y1")).alias("c")).select(*page, "caption_key", "c.*")


def captioned_rows(captions: DataFrame, images: DataFrame, pages: DataFrame, page: list[str], tables: bool = False) -> DataFrame:
    """One row per caption of a page, its image or table attached: (page, caption_no, caption_key, image_no, clip, y, x).

    captions has (page, caption_no, caption_key, box); of equal keys on a page the first counts. Each takes its
    best target in turn; the clip joins both boxes and is no narrower than the caption's column. A caption
    without a target gets the clip where its drawing must be. pages has (page, px0, py0, px1, py1).
    """
    first = _first_keys(captions, page)
    return _captioned(first, assign(first, images, page, tables).select(*page, "caption_no", "image_no"), images, pages, page, tables)


def figure_rows(captions: DataFrame, images: DataFrame, tables: DataFrame, abstracts: DataFrame, pages: DataFrame, page: list[str]) -> DataFrame:
    """All rows of a page in one list: figures and tables by their captions, then graphical abstracts.

    (page, n, kind, caption_no, caption_key, image_no, clip). captions has a column `kind`, figure or table;
    abstracts are the images that may be one. Captions of figures choose first; an abstract is what no caption's
    image and no earlier abstract covers, clipped with the room of a caption below it. Tables are chosen apart.
    Rows are numbered from 1, top down, then from the left.
    """
    figures = _first_keys(captions.where("kind = 'figure'"), page)
    taken = assign(figures, images, page, after=abstracts.select(*page, "image_no", "x0", "y0", "x1", "y1"))
    # One choice serves both kinds of rows.
    found = _captioned(figures, taken.where("caption_no IS NOT NULL").select(*page, "caption_no", "image_no"), images, pages, page, False).withColumn("kind", F.lit("figure"))
    free = taken.where("caption_no IS NULL").select(*page, "image_no").join(abstracts.select(*page, "image_no", "x0", "y0", "x1", "y1"), [*page, "image_no"]).join(pages, page)
    clip = F.struct("x0", "y0", "x1", F.least("py1", F.col("y1") + BELOW).alias("y1"))
    number = found.schema["caption_no"].dataType
    free = free.select(*page, F.lit(None).cast(number).alias("caption_no"), F.lit("abstract").alias("caption_key"), "image_no", clip.alias("clip"), F.col("y0").alias("y"), F.col("x0").alias("x"), F.lit("abstract").alias("kind"))
    others = captioned_rows(captions.where("kind = 'table'"), tables, pages, page, tables=True).withColumn("kind", F.lit("table"))
    rows = found.unionByName(free).unionByName(others)
    place = F.row_number().over(Window.partitionBy(*page).orderBy("y", "x", "kind", "caption_no", "image_no"))
    return rows.select(*page, place.alias("n"), "kind", "caption_no", "caption_key", "image_no", "clip")


def panel_grid(n: Column, width: Column, height: Column) -> Column:
    """(rows, cols) that n panels of a compound figure most likely stand in."""
    wide = width >= height
    pair = lambda r, c: F.struct(F.lit(r).cast("int").alias("rows"), F.lit(c).cast("int").alias("cols"))
    line = F.struct(F.lit(1).cast("int").alias("rows"), n.cast("int").alias("cols"))
    stack = F.struct(n.cast("int").alias("rows"), F.lit(1).cast("int").alias("cols"))
    even = lambda k: F.when(wide, pair(2, k // 2)).otherwise(pair(k // 2, 2))
    return (
        F.when(n <= 1, pair(1, 1))
        .when(n == 2, F.when(wide, line).otherwise(stack))
        .when(n == 3, F.when(width >= height * 1.15, line).otherwise(stack))
        .when(n == 4, pair(2, 2))
        .when(n == 6, even(6))
        .when(n == 8, even(8))
        .otherwise(F.when(wide | (width * 2 >= height * n), line).otherwise(stack))
    )


def figure_window(figures: DataFrame, cursors: DataFrame, doc: str, span: int = 1) -> DataFrame:
    """Figures around each document's cursor, which is held inside the list."""
    counts = figures.groupBy(doc).agg(F.count(F.lit(1)).alias("_n"))
    centre = cursors.join(counts, doc).select(doc, F.greatest(F.least("cursor", F.col("_n") - 1), F.lit(0)).alias("_c"))
    return figures.join(centre, doc).where(F.abs(F.col("ord") - F.col("_c")) <= min(max(span, 0), 2)).drop("_c")

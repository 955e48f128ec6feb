"""Document enrichment in stages, with the models' answers as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import plain

# Stages that count as final; sizes of chunks and samples.
FINAL_STAGES = ("polish", "harmonize")
CHUNK, SURVEY = 5000, 120_000


def chunks_of(text: str | None, size: int = CHUNK) -> list[str]:
    """Pieces of at most `size` characters, cut after a paragraph or sentence past a third of the piece."""
    rest, out = (text or "").strip(), []
    while len(rest) > size:
        window = rest[:size]
        at = max(window.rfind(mark) for mark in ("\n\n", ". ", "? "))
        cut = size if at <= size // 3 else at + (2 if window.startswith("\n\n", at) else 1)
        out.append(rest[:cut].strip())
        rest = rest[cut:]
    return [c for c in [*out, rest.strip()] if c]


def chunk_text(text: Column, size: int = CHUNK) -> Column:
    @F.pandas_udf("array<string>")
    def chunk(texts: pd.Series) -> pd.Series:
        return pd.Series([chunks_of(t, size) for t in texts])

    return chunk(text)


def head_and_tail(text: Column, most: int = SURVEY) -> Column:
    """A text of at most `most` characters: four fifths from its start, one fifth from its end."""
    head = most * 4 // 5
    cut = F.concat(F.substring(text, 1, head), F.lit("\n\n[...middle omitted...]\n\n"), F.right(text, F.lit(most - head)))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def best_stage(*stages: Column) -> Column:
    """The last stage whose answer is not blank: enrichment falls back to the stage before."""
    return F.coalesce(*[F.when(F.trim(s) != "", s) for s in reversed(stages)])


def work_units(sentences: DataFrame, captions: DataFrame, doc: str = "doc_id", section: str = "section", text: str = "text") -> DataFrame:
    """(doc, units): two passes over the sentences of each section and one digest, plus captions; 1 at least."""
    full = sentences.where(plain(F.col(text)) != "").groupBy(doc, section).agg((2 * F.count(F.lit(1)) + 1).alias("units")).groupBy(doc).agg(F.sum("units").alias("units"))
    extra = captions.where(plain(F.col("caption")) != "").groupBy(doc).agg(F.count(F.lit(1)).alias("extra"))
    both = sentences.select(doc).distinct().join(full, doc, "left").join(extra, doc, "left")
    return both.select(doc, F.greatest(F.coalesce("units", F.lit(0)) + F.coalesce("extra", F.lit(0)), F.lit(1)).alias("units"))


def needs_translation(sentences: DataFrame, doc: str = "doc_id", text: str = "text", ko: str = "text_ko", stage: str = "text_ko_stage", share: float = 0.05) -> DataFrame:
    """(doc, needs): whether a stored document lacks translations or has unfinished ones."""
    rows = sentences.where(plain(F.col(text)) != "")
    filled = F.trim(F.coalesce(ko, F.lit(""))) != ""
    staged = F.lower(F.trim(F.coalesce(stage, F.lit(""))))
    final = staged.isin(*FINAL_STAGES)
    found = rows.groupBy(doc).agg(F.bool_or(~filled | (filled & (staged != "") & ~final)).alias("open"), F.avg((filled & final).cast("int")).alias("done"), F.avg(filled.cast("int")).alias("filled"))
    return found.select(doc, (F.col("open") | (F.greatest("done", "filled") < share)).alias("needs"))


def replace_pages(pages: DataFrame, recovered: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """pages with the recovered text where there is one."""
    new = recovered.select(*keys, F.col(text).alias("_new"))
    return pages.join(new, keys, "left").withColumn(text, F.when(F.trim("_new") != "", F.col("_new")).otherwise(F.col(text))).drop("_new")

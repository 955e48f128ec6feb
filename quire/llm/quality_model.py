"""Quality classifier: boosted trees over document statistics.

Statistics of every whole text are computed by Spark's own functions, once a text. A bounded sample of the
labelled documents (at most MAX_TRAINING_ROWS, those with the smallest digests of their ids) is enough to
fit the forest on the driver; it is chosen among the labels of documents at hand, on narrow rows, before any
statistic is joined. Every row is scored by a vectorised walk over the flattened trees.

Defined cases: a null text counts as empty and gets the score of all-zero statistics; repeated rows
repeat (one of them, by its statistics, is learned from); labels that are null or name no document are
ignored, several labels of one document count as 1 when at least half say so; without labels every score is
0.5; an empty table gives an empty result; further columns are never inputs. A row without an id is scored
and never held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm._shared import WORD_SPACE, count_chars, lines_of, materialise, settled, spare_name, table, ticked, words_of
from quire.llm.boosting import Forest, fit_forest

MAX_TRAINING_ROWS = 60_000
FOLDS, HELD_OUT_FOLD = 3, 1
FEATURES = [
    "chars", "words", "word_length", "symbols", "bangs", "bars", "capitals", "digits", "stops", "commas", "beyond_ascii",
    "lines", "line_length", "dup_lines", "distinct_words", "word_runs",
]


def with_statistics(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """docs with the array<double> column `out` of the statistics named by FEATURES."""
    words, lines = spare_name(docs, "s_words"), spare_name(docs, "s_lines")
    text = F.coalesce(ticked(text_col).cast("string"), F.lit(""))
    split = docs.withColumn(words, words_of(text)).withColumn(lines, lines_of(text))
    n, w, rows = F.length(text).cast("double"), F.size(words).cast("double"), F.size(lines).cast("double")
    per = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))
    runs = F.size(F.filter(F.col(words), lambda x, i: x == F.get(F.col(words), i - 1)))
    values = {
        "chars": F.log1p(n),
        "words": F.log1p(w),
        "word_length": per(F.length(text) - count_chars(text, WORD_SPACE), w),
        "symbols": per(count_chars(text, "#*$%&<>"), w),
        "bangs": per(count_chars(text, "!?"), w),
        "bars": per(count_chars(text, "|"), w),
        "capitals": per(count_chars(text, "A-Z"), n),
        "digits": per(count_chars(text, "0-9"), n),
        "stops": per(count_chars(text, "."), w),
        "commas": per(count_chars(text, ",;:"), w),
        "beyond_ascii": per(F.octet_length(text) - F.length(text), n),
        "lines": F.log1p(rows),
        "line_length": per(w, rows),
        "dup_lines": per(F.size(lines) - F.size(F.array_distinct(lines)), rows),
        "distinct_words": per(F.size(F.array_distinct(words)), w),
        "word_runs": per(runs, w),
    }
    return split.withColumn(out, settled(F.array(*[values[f] for f in FEATURES]))).drop(words, lines)


def fold_of(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS


def sampled_labels(labels: DataFrame, label_id: str, label_col: str, most: int) -> DataFrame:
    """(id, y) of labelled ids outside the held-out fold: all, or about `most` and never more.

    The digests' first 16 bits cut the table: every bucket below the cut is taken whole, so no task merges
    rows of all partitions, and the table of buckets is at most 65,536 rows.
    """
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(label_id).alias("id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("y"))
    known = materialise(known.where(fold_of(F.col("id")) != HELD_OUT_FOLD).withColumn("bucket", F.conv(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 4), 16, 10).cast("int")), "known")
    if known.count() <= most:
        return known.select("id", "y")
    cut, total = -1, 0
    for r in known.groupBy("bucket").count().orderBy("bucket").collect():
        total += r["count"]
        if total > most:
            break
        cut = r.bucket
    if cut < 0:
        return known.where("bucket = 0").orderBy("id").limit(most).select("id", "y")
    return known.where(F.col("bucket") <= cut).select("id", "y")


def training_rows(features: DataFrame, labels: DataFrame, label_id: str, label_col: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most `most` labelled documents outside the held-out fold."""
    # Labels of documents that are not here must not use up the bound.
    here = labels.join(features.select(F.col("id").alias(label_id)), label_id, "left_semi")
    known = F.broadcast(sampled_labels(here, label_id, label_col, most))  # at most `most` narrow rows
    rows = features.join(known, "id").groupBy("id").agg(F.min("features").alias("features"), F.min("y").alias("y")).orderBy("id").select("features", "y").toPandas()
    if not len(rows):
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    return np.array(rows["features"].tolist(), float), rows["y"].to_numpy(float)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_TRAINING_ROWS) -> tuple[Forest, DataFrame]:
    """The forest, and the written table (id, features) of every row of docs."""
    named = docs.select(ticked(id_col).alias("id"), ticked(text_col).alias("text"))
    features = materialise(with_statistics(named, "text", "features").select("id", "features"), "statistics")
    return fit_forest(*training_rows(features, labels, id_col, label_col, most)), features


def scorer(forest: Forest):
    """A column function: array of statistics -> score of label 1."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(forest.score(np.array(s.tolist(), float).reshape(len(s), len(FEATURES))))

    return score


def keep_predicted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """The rows of docs with a score of 0.5 or more, columns unchanged.

    Rows are written once with their statistics; fitting reads the statistics alone, and the scores filter the written rows.
    """
    out, score = spare_name(docs, "features"), spare_name(docs, "score")
    measured = materialise(with_statistics(docs, text_col, out), "measured-rows")
    forest = fit_forest(*training_rows(measured.select(ticked(id_col).alias("id"), ticked(out).alias("features")), labels, id_col, label_col, most))
    return measured.withColumn(score, scorer(forest)(ticked(out))).where(ticked(score) >= 0.5).select(*[ticked(c) for c in docs.columns])


def op1_quality_model(spark, sf_dir: str) -> DataFrame:
    forest, features = fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = features.withColumn("score", scorer(forest)("features"))
    return scored.select(
        F.col("id").alias("doc_id"),
        F.coalesce(fold_of(F.col("id")) == HELD_OUT_FOLD, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )

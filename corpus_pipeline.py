"""Corpus preparation from raw documents to packed token sequences.

Five stages, each on all that its predecessor kept, each written as Parquet and read again: quality
rules, quality classifier, near-duplicate removal, personal data, packing. A stage starts by dropping the
scratch tables of the stages before it, whose results have been written since, so the disk holds the
intermediate tables of one stage at a time.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quire.llm._shared import drop_tables, materialise, table, written
from quire.llm.near_copies import keep_unlike
from quire.llm.packing import pack_documents
from quire.llm.pii import redact
from quire.llm.quality_model import keep_predicted
from quire.llm.quality_rules import keep_good


#: Scratch tables of finished stages, to be dropped by the next one.
_finished: list[str] = []


def _stage(step):
    """step, on a disk free of earlier stages' scratch tables; tables that docs itself still reads stay."""

    @wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _finished[:] = drop_tables(spark, _finished, docs)
        before = len(written)
        out = step(spark, docs, sf_dir)
        _finished.extend(written[before:])
        return out

    return run


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled rules keep."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more."""
    return keep_predicted(docs, table(spark, sf_dir, "labels"))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprint classes and bands, five-word similarity of 0.8 or more, verified."""
    return keep_unlike(docs)


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked in their texts."""
    return redact(docs)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed-length token sequences, with their ids."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: The classifier, fingerprints, spans and token ids are beyond SQL; tests hold each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_tables(spark, last, docs)
        last = [written[-1]]
    _finished[:] = drop_tables(spark, _finished, docs)
    return docs

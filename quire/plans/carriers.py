"""Relations with citations, mentions, blocks and replicas, derived from the plain tables.

The plain texts hold no markers, so the queries add them by fixed expressions, written alike in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.segment import split_sentences


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Sentences in SQL: (doc_id, ord, text); the abbreviation list and the cut are those of the operator.
SENTENCES_SQL = r"""
marked AS (
  SELECT doc_id, regexp_replace(trim(coalesce(text, ''), ' '), '(?i)(^|[^\p{L}\p{N}_])(Fig|Figs|Eq|Eqs|Ref|Refs|Vol|No|Nos|Dr|Mr|Mrs|Ms|Prof|vs|cf|al|e\.g|i\.e|et al|approx|ca|ed|eds|pp)\.', '\1\2' || chr(57344), 'g') AS t FROM documents
), pieces AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+([A-Z"''])', '\1' || chr(57345) || '\2', 'g'), chr(57345)),
         lambda p: regexp_replace(replace(p, chr(57344), '.'), '^\s+|\s+$', '', 'g')), lambda p: p <> '')[1:5000] AS ps FROM marked
), sentences AS (
  SELECT doc_id, unnest(range(0, len(ps))) AS ord, unnest(ps) AS text FROM pieces
)
"""

#: A citing sentence: two markers whose numbers follow from the ids.
CITING = "text || ' [' || (1 + doc_id % 7) || '-' || (3 + doc_id % 7) || ',' || (9 + ord % 5) || '] and <sup>' || (1 + ord % 30) || '</sup>'"
#: A mentioning sentence: two labels of figures or tables.
MENTIONING = "text || ' (see Fig. ' || (1 + ord % 4) || ' and Table S' || (1 + doc_id % 3) || ')'"


def citing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir).select("doc_id", "ord", F.expr(CITING).alias("text"))


def mentioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir).select("doc_id", "ord", F.expr(MENTIONING).alias("text"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as blocks: two columns for even ids, one for odd; 20 lines a page."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "text"))
    x0 = F.when((F.col("doc_id") % 2 == 0) & (F.col("n") % 2 == 1), 110.0).otherwise(10.0)
    x1 = F.when(F.col("doc_id") % 2 == 0, x0 + 70.0).otherwise(180.0)
    y = (F.col("n") % 20).cast("double") * 5.0
    return lines.select("doc_id", F.expr("n div 20").cast("int").alias("page"), F.col("n").alias("block_no"), x0.alias("x0"), y.alias("y0"), x1.alias("x1"), (y + 4.0).alias("y1"), "text", F.lit(200.0).alias("page_width"))


BLOCKS_SQL = """
lines AS (
  SELECT doc_id, unnest(range(0, len(ls))) AS n, unnest(ls) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), blocks AS (
  SELECT doc_id, (n // 20)::int AS page, n AS block_no, x0, (n % 20)::double * 5.0 AS y0, CASE WHEN doc_id % 2 = 0 THEN x0 + 70.0 ELSE 180.0 END AS x1, (n % 20)::double * 5.0 + 4.0 AS y1, text, 200.0 AS page_width
  FROM (SELECT *, CASE WHEN doc_id % 2 = 0 AND n % 2 = 1 THEN 110.0::double ELSE 10.0::double END AS x0 FROM lines)
)
"""

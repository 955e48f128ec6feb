"""Bibliographies, and links from sentences to their entries and figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.refs import caption_key, cite_numbers, doi, figure_mentions
from quire.functions.text import squeeze

# How a reference list starts, ends and numbers its entries.
HEADING = r"(?im)^[ \t]*(references|bibliography|literature cited)[ \t]*$"
END = r"(?im)^[ \t]*(appendix|supporting information|supplementary|acknowledg(?:e)?ments?)\b"
ENTRY = r"(?m)^[ \t]*(?:\[(\d+)\]|(\d+)[ \t]*[.)\]])[ \t]+"
SHORTEST, MOST = 8, 2000
_CUT, _SEP = "\ue001", "\ue002"


def reference_block(text: Column) -> Column:
    """What stands between the heading of the references and the next part; empty without a heading."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), HEADING, _CUT)
    after = F.when(F.instr(marked, _CUT) > 0, F.substr(marked, F.instr(marked, _CUT) + 1)).otherwise("")
    return F.split(F.regexp_replace(F.replace(after, F.lit(_CUT), F.lit("")), END, _CUT), _CUT)[0]


def bibliography(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, text, doi): numbered entries of each reference list; the first of a number wins."""
    entries = F.split(F.regexp_replace(reference_block(F.col(text_col)), ENTRY, _CUT + "$1$2" + _SEP), _CUT)
    rows = docs.select(id_col, F.posexplode(entries).alias("pos", "entry")).where(F.instr("entry", _SEP) > 0)
    parts = rows.select(id_col, "pos", F.substring_index("entry", _SEP, 1).try_cast("long").alias("n"), squeeze(F.substring_index("entry", _SEP, -1)).alias("text"))
    return normalize_references(parts, id_col, "pos", shortest=SHORTEST, most=MOST)


def normalize_references(rows: DataFrame, id_col: str, pos: str, shortest: int = 3, most: int = MOST, largest: int = 9999) -> DataFrame:
    """Rows (id, pos, n, text) with valid numbers and texts; first of each number.

    A DOI that is stored (a column `doi`) counts; where there is none it is read from the text.
    """
    stored = F.nullif(F.coalesce("doi", F.lit("")), F.lit("")) if "doi" in rows.columns else F.lit(None).cast("string")
    named = rows.withColumns({"n": F.col("n").try_cast("long"), "text": F.trim("text"), "doi": stored})
    valid = named.where(F.col("n").between(1, largest) & (F.length("text") >= shortest))
    first = valid.withColumn("_k", F.row_number().over(Window.partitionBy(id_col, "n").orderBy(pos))).where(F.col("_k") == 1)
    return first.select(id_col, "n", F.substring("text", 1, most).alias("text"), F.coalesce("doi", doi(F.col("text"))).alias("doi"))


def cite_hints(sentences: DataFrame, references: DataFrame, id_col: str, keys: list[str], text: str = "text") -> DataFrame:
    """(id, keys, place, n, reference, doi): entries that each sentence cites, in citation order."""
    cited = sentences.select(id_col, *keys, F.posexplode(cite_numbers(F.col(text))).alias("place", "n")).withColumn("n", F.col("n").cast("long"))
    return cited.join(references.select(id_col, "n", F.col("text").alias("reference"), "doi"), [id_col, "n"]).select(id_col, *keys, "place", "n", "reference", "doi")


def figure_hints(sentences: DataFrame, figures: DataFrame, id_col: str, keys: list[str], text: str = "text", ord_col: str = "ord", caption: str = "caption") -> DataFrame:
    """(id, keys, place, ref, figure): the first figure of each mentioned label; labels without one go."""
    known = figures.withColumn("key", caption_key(F.col(caption))).where("key is not null").groupBy(id_col, "key").agg(F.min(ord_col).alias("figure"))
    mentions = sentences.select(id_col, *keys, F.posexplode(figure_mentions(F.col(text))).alias("place", "m")).select(id_col, *keys, "place", F.col("m.label").alias("ref"), "m.key")
    return mentions.join(known, [id_col, "key"]).select(id_col, *keys, "place", "ref", "figure")

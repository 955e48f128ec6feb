"""Sentences, sections and extraction quality of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import alnum_count

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = "Fig|Figs|Eq|Eqs|Ref|Refs|Vol|No|Nos|Dr|Mr|Mrs|Ms|Prof|vs|cf|al|e\\.g|i\\.e|et al|approx|ca|ed|eds|pp"
MAX_SENTENCES = 5000
# Section ranks and spellings.
SECTION_RANK = {"title": 0, "abstract": 1, "introduction": 2, "methods": 3, "experimental": 3, "results": 4, "discussion": 5, "conclusion": 6, "body": 7}
SECTION_ALIAS = {
    "intro": "introduction", "introduction": "introduction", "method": "methods", "methods": "methods", "experimental": "experimental", "experiment": "experimental",
    "result": "results", "results": "results", "discuss": "discussion", "discussion": "discussion", "conclusions": "conclusion", "conclusion": "conclusion",
    "summary": "conclusion", "title": "title", "abstract": "abstract", "body": "body",
}
# What makes an extraction too thin to read.
SPARSE_TOTAL, EMPTY_PAGE, EMPTY_SHARE = 50, 15, 0.45
#: Private-use marks: a protected full stop, and a cut between sentences.
_STOP, _CUT = "\ue000", "\ue001"


def _marked(text: Column) -> Column:
    """text with a mark in place of each full stop that ends no sentence."""
    return F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), rf"(?i)(^|[^\p{{L}}\p{{N}}_])({ABBREVIATIONS})\.", "$1$2" + _STOP)


def _bare(piece: Column) -> Column:
    return F.regexp_replace(F.replace(piece, F.lit(_STOP), F.lit(".")), r"^\s+|\s+$", "")


def sentence_array(text: Column) -> Column:
    """Sentences of a text, trimmed, blanks dropped."""
    cut = F.regexp_replace(_marked(text), r"""([.!?])\s+([A-Z"'])""", "$1" + _CUT + "$2")
    return F.filter(F.transform(F.split(cut, _CUT), _bare), lambda p: p != "")


def sentence_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_SENTENCES) -> DataFrame:
    """(id, ord, text, start, end): sentences with their places in the trimmed text.

    Marks are as long as what they replace and the white space of a cut stays in front of its sentence, so a
    sentence starts where the lengths before it end. Only an empty text has a blank piece.
    """
    cut = F.regexp_replace(_marked(F.col(text_col)), r"""([.!?])(\s+[A-Z"'])""", "$1" + _CUT + "$2")
    rows = docs.select(id_col, F.slice(F.split(cut, _CUT), 1, limit).alias("_p"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    ends = F.aggregate(F.transform("_p", F.length), start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    rows = rows.select(id_col, F.posexplode(F.arrays_zip(F.col("_p").alias("p"), ends.alias("at"))).alias("ord", "s")).where(~F.col("s.p").rlike(r"^\s*$"))
    lead = F.length("s.p") - F.length(F.regexp_replace("s.p", r"^\s+", ""))
    rows = rows.select(id_col, "ord", _bare(F.col("s.p")).alias("text"), (F.col("s.at") + lead).alias("start"))
    return rows.select(id_col, "ord", "text", "start", (F.col("start") + F.length("text")).alias("end"))


def page_texts(pages: DataFrame, raw: DataFrame, page: list[str]) -> DataFrame:
    """(page, text): the ordered blocks of each page, the raw text where it has none."""
    from quire.functions.text import normalize_page

    return raw.join(pages.select(*page, F.col("text").alias("_o")), page, "left").select(*page, F.coalesce("_o", normalize_page(F.col("text"))).alias("text"))


def page_sample(pages: DataFrame, doc: str, page: str, text: str = "text", most: int = 80_000) -> DataFrame:
    """(doc, sample): all pages with their numbers, or, where they exceed `most`, whole pages from both ends."""
    body = F.trim(F.coalesce(F.col(text), F.lit("")))
    block = F.concat(F.lit("--- PAGE "), F.col(page).cast("string"), F.lit(" ---\n"), F.when(body == "", "(empty)").otherwise(body))
    by = Window.partitionBy(doc)
    rows = pages.select(doc, page, block.alias("_b")).withColumn("_n", F.length("_b") + 2)
    rows = rows.withColumn("_all", F.sum("_n").over(by) - 2).withColumn("_head", F.sum("_n").over(by.orderBy(page)) <= most * 4 // 5)
    rows = rows.withColumn("_used", F.coalesce(F.sum(F.when(F.col("_head"), F.col("_n"))).over(by), F.lit(0)))
    rows = rows.withColumn("_tail", ~F.col("_head") & (F.sum("_n").over(by.orderBy(F.desc(page))) <= most - F.col("_used") - 40))
    join = lambda flag: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(flag, F.struct(page, "_b")))), lambda x: x["_b"]), "\n\n")
    made = rows.groupBy(doc).agg(join(F.lit(True)).alias("_w"), F.max("_all").alias("_a"), join(F.col("_head")).alias("_h"), join(F.col("_tail")).alias("_t"))
    cut = F.concat("_h", F.when(F.col("_t") == "", "").otherwise("\n\n[...middle pages omitted...]\n\n"), "_t")
    return made.select(doc, F.when(F.col("_a") <= most, F.col("_w")).otherwise(cut).alias("sample"))


def split_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_SENTENCES) -> DataFrame:
    """(id, ord, sentence_id, text): one row per sentence; a document has at most `limit`, as the feature has it."""
    pieces = docs.select(F.col(id_col), F.posexplode(F.slice(sentence_array(F.col(text_col)), 1, limit)).alias("ord", "text"))
    return pieces.select(id_col, "ord", F.format_string("sent_%06d", "ord").alias("sentence_id"), "text")


def section_name(raw: Column) -> Column:
    """The known section a heading stands for; anything else is body."""
    names = F.create_map(*[F.lit(x) for pair in SECTION_ALIAS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(F.trim(F.coalesce(raw, F.lit(""))))), F.lit("body"))


def section_rank(section: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in SECTION_RANK.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, section), F.lit(SECTION_RANK["body"]))


def assemble(pieces: DataFrame, doc: str, arrival: list[str], text: str = "text", section: str = "section", limit: int = MAX_SENTENCES) -> DataFrame:
    """Pieces by section rank, then arrival; only the first title of a document; renumbered from 0."""
    by_doc = Window.partitionBy(doc)
    order = [section_rank(F.col(section)), *map(F.col, arrival)]
    titles = F.row_number().over(Window.partitionBy(doc, section).orderBy(*order))
    kept = pieces.withColumn("_title", titles).where((F.col(section) != "title") | (F.col("_title") == 1))
    placed = kept.withColumn("ord", F.row_number().over(by_doc.orderBy(*order)) - 1)
    return placed.where(F.col("ord") < limit).select(doc, "ord", F.format_string("sent_%06d", "ord").alias("sentence_id"), text, section)


def is_sentence(text: Column) -> Column:
    """False for blanks and for short runs of digits and marks."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    return (bare != "") & ~((F.length(bare) < 12) & bare.rlike(r"^[\d\s\-–—.,]+$"))


def quality_gate(pages: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """(doc, verdict, notes): full_vision where pages hold too little text, else null (a model decides)."""
    n = alnum_count(F.col(text))
    found = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("pages"), F.sum(n).alias("alnum"), F.count_if(n < EMPTY_PAGE).alias("empty"))
    sparse = F.col("alnum") < SPARSE_TOTAL
    thin = (F.col("pages") >= 2) & (F.col("empty") / F.col("pages") >= EMPTY_SHARE)
    return found.select(
        doc,
        F.when(sparse | thin, "full_vision").alias("verdict"),
        F.when(sparse, F.concat(F.lit("sparse_alnum:"), F.col("alnum"))).when(thin, F.concat(F.lit("empty_page_ratio:"), F.col("empty"), F.lit("/"), F.col("pages"))).alias("notes"),
    )


def merge_multicolumn(verdict: Column, bad: Column, multi: Column, pages: Column) -> Column:
    """Decision with the multi-column pages among the bad ones; text_ok turns into repair_pages."""
    inside = F.filter(multi, lambda p: (p >= 0) & (p < pages))
    return F.struct(
        F.when((F.size(inside) > 0) & (verdict == "text_ok"), "repair_pages").otherwise(verdict).alias("verdict"),
        F.when(F.size(inside) > 0, F.array_sort(F.array_union(bad, inside))).otherwise(bad).alias("bad_pages"),
    )


def digest_input(sentences: DataFrame, doc: str, section: str, ord_col: str, text: str, most: int = 40) -> DataFrame:
    """(doc, section, bullets): the first `most` non-blank sentences of each section as one bulleted text."""
    ranked = sentences.where(F.trim(text) != "").withColumn("_n", F.row_number().over(Window.partitionBy(doc, section).orderBy(ord_col)))
    first = ranked.where(F.col("_n") <= most).groupBy(doc, section).agg(F.sort_array(F.collect_list(F.struct("_n", text))).alias("_all"))
    return first.select(doc, section, F.array_join(F.transform("_all", lambda x: F.concat(F.lit("- "), x[text])), "\n").alias("bullets"))


def section_groups(sentences: DataFrame, doc: str, ord_col: str = "ord", section: str = "section") -> DataFrame:
    """(doc, section, first, sentences): sections in the order they first appear; null or blank is body."""
    name = F.when(F.trim(F.coalesce(F.col(section), F.lit(""))) == "", "body").otherwise(F.col(section))
    return sentences.groupBy(doc, name.alias(section)).agg(F.min(ord_col).alias("first"), F.count(F.lit(1)).alias("sentences"))


def missing_front_matter(sentences: DataFrame, docs: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """(doc, missing): no title, abstract or introduction found although the text's head names one."""
    found = sentences.groupBy(doc).agg(F.bool_or(F.col("section").isin("title", "abstract", "introduction")).alias("front"))
    named = F.substring(F.coalesce(text, F.lit("")), 1, 12_000).rlike(r"(?i)\b(Abstract|Introduction)\b")
    return docs.join(found, doc, "left").select(doc, (~F.coalesce("front", F.lit(False)) & named).alias("missing"))


def session_title(sentences: DataFrame, files: DataFrame, doc: str) -> DataFrame:
    """(doc, title): the first title sentence, else the file name without its extension."""
    titles = sentences.where("section = 'title'").groupBy(doc).agg(F.min_by("text", "ord").alias("t"))
    return files.join(titles, doc, "left").select(doc, F.coalesce("t", F.regexp_replace("filename", r"\.[^.]*$", "")).alias("title"))

"""Model answers: JSON in fences, broken JSON, marked blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCES = "struct<sentences:array<struct<text:string,section:string>>>"
#: One complete record of a sentence, with its keys in either order.
RECORD = r'(\{\s*"text"\s*:\s*"(?:\\.|[^"\\])*"\s*,\s*"section"\s*:\s*"[A-Za-z_]+"\s*\}|\{\s*"section"\s*:\s*"[A-Za-z_]+"\s*,\s*"text"\s*:\s*"(?:\\.|[^"\\])*"\s*\})'


def strip(text: Column) -> Column:
    """text without white space at its ends, line breaks included."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def unfenced(text: Column) -> Column:
    bare = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"^```(?:json)?\s*", "")
    return F.regexp_replace(bare, r"\s*```$", "")


def json_object(text: Column) -> Column:
    """The JSON text from the first brace to the last, fences being outside them; null without one."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def whole_sentences(text: Column) -> Column:
    """Complete sentence records of an answer that may be cut off."""
    hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RECORD), F.lit(1))
    rows = F.transform(hits, lambda h: F.from_json(h, "struct<text:string,section:string>"))
    clean = F.transform(rows, lambda r: F.struct(F.trim(r["text"]).alias("text"), r["section"].alias("section")))
    return F.filter(clean, lambda r: F.coalesce(r["text"], F.lit("")) != "")


def sentences_of(text: Column) -> Column:
    """Sentence records: of the JSON as a whole where it parses, else the complete ones."""
    parsed = F.from_json(json_object(text), SENTENCES)["sentences"]
    return F.coalesce(parsed, whole_sentences(text))


def digest_blocks(raw: Column) -> Column:
    """(en, ko) of an answer with EN: and KO: blocks; without marks all of it is ko."""
    text = F.coalesce(raw, F.lit(""))
    ko_at = r"(?is)\bKO\s*:\s*(.*)$"
    en = strip(F.regexp_extract(F.regexp_replace(text, r"(?is)\bKO\s*:.*$", ""), r"(?is)\bEN\s*:\s*(.*)$", 1))
    ko = strip(F.regexp_extract(text, ko_at, 1))
    return F.struct(en.alias("en"), F.when((en == "") & (ko == ""), strip(text)).otherwise(ko).alias("ko"))


def quality_answer(payload: Column, pages: Column) -> Column:
    """(verdict, bad_pages) of a model's JSON; unknown verdicts are text_ok, repairs need pages."""
    r = F.from_json(json_object(payload), "struct<verdict:string,bad_pages:array<int>>")
    bad = F.array_sort(F.array_distinct(F.filter(F.coalesce(r["bad_pages"], F.array().cast("array<int>")), lambda p: (p >= 0) & (p < pages))))
    known = F.when(r["verdict"].isin("text_ok", "repair_pages", "full_vision"), r["verdict"]).otherwise("text_ok")
    return F.struct(F.when((known == "repair_pages") & (F.size(bad) == 0), "text_ok").otherwise(known).alias("verdict"), bad.alias("bad_pages"))


def vision_pages(bad: Column, pages: Column, most: int = 40) -> Column:
    """Pages to read again: the bad ones first, then the others, `most` in all."""
    every = F.when(pages > 0, F.sequence(F.lit(0), pages - 1)).otherwise(F.array().cast("array<int>"))
    return F.slice(F.array_distinct(F.concat(F.array_intersect(bad, every), every)), 1, most)


SURVEY = "struct<title_guess:string,section_order:array<string>,section_notes:string,formulas:array<struct<raw:string,rich:string>>,symbols:array<struct<raw:string,rich:string,note:string>>>"


def survey_answer(payload: Column) -> Column:
    """(title_guess, section_order, section_notes, formulas, symbols) of a survey's JSON, within their bounds."""
    r = F.from_json(json_object(payload), SURVEY)
    cut = lambda c, n: F.substring(strip(F.coalesce(c, F.lit(""))), 1, n)
    names = F.transform(F.coalesce(r["section_order"], F.array().cast("array<string>")), lambda x: F.lower(strip(x)))
    formulas = F.slice(F.coalesce(r["formulas"], F.array().cast("array<struct<raw:string,rich:string>>")), 1, 40)
    kept = F.filter(F.transform(formulas, lambda f: F.struct(cut(f["raw"], 200).alias("raw"), cut(f["rich"], 400).alias("rich"))), lambda f: (f["raw"] != "") & (f["rich"] != ""))
    none = F.array().cast("array<struct<raw:string,rich:string,note:string>>")
    symbols = F.transform(F.slice(F.coalesce(r["symbols"], none), 1, 40), lambda s: F.struct(cut(s["raw"], 120).alias("raw"), cut(s["rich"], 200).alias("rich"), F.nullif(cut(s["note"], 120), F.lit("")).alias("note")))
    symbols = F.filter(symbols, lambda s: (s["raw"] != "") & (s["rich"] != ""))
    return F.struct(cut(r["title_guess"], 500).alias("title_guess"), F.slice(F.filter(names, lambda x: x != ""), 1, 20).alias("section_order"), cut(r["section_notes"], 2000).alias("section_notes"), kept.alias("formulas"), symbols.alias("symbols"))

"""Column functions on citations, identifiers, figure mentions and captions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import squeeze, strip_tags

# How citations, DOIs, figure mentions and captions are written.
DOI = r"(?i)\b(?:doi[:\s]*)?(10\.\d{4,9}/[-._;()/:A-Z0-9]+)\b"
CITE_BRACKET = r"\[(\d+(?:\s*[-–—,]\s*\d+)*(?:\s*,\s*\d+(?:\s*[-–—,]\s*\d+)*)*)\]"
CITE_SUP = r"(?i)<sup>\s*(\d{1,3})\s*</sup>"
FIGURE = r"(?i)\b((?:Figures?|Figs?|Scheme|Table)\.?\s*(S?\d+[a-z]?))\b"
CAPTION_LABEL = r"(?i)^((?:Fig(?:ure)?|Scheme|Table)\.?\s*S?\d+[a-z]?)(?=$|[\s.:;·–—\-])"
CAPTION_STRICT_FIGURE = r"(?i)^((?:Fig(?:ure)?|Scheme)\.?\s*S?\d+[a-z]?)\s*[.:;·–—\-]"
CAPTION_STRICT_TABLE = r"(?i)^(Table\.?\s*S?\d+[a-z]?)\s*[.:;·–—\-]"
BODY_VERB = (
    r"(?i)^(illustrates?|shows?|presents?|demonstrates?|depicts?|indicates?|describes?|summarizes?|compares?|reports?|displays?|represents?|"
    r"is\b|are\b|was\b|were\b|has\b|have\b|can\b|will\b|may\b|must\b)"
)
CAPTION_ORDER = r"(?i)^\s*(Fig(?:ure)?|Scheme|Table)\.?\s*(S?)(\d+)([a-z])?\b"
#: Ranges of citation numbers wider than this, or backwards, are misread text.
WIDEST_RANGE, LARGEST_NUMBER = 40, 9999


def doi(text: Column) -> Column:
    """The first DOI without trailing punctuation; null where there is none."""
    found = F.regexp_replace(F.regexp_extract(F.coalesce(text, F.lit("")), DOI, 1), r"[).,;]+$", "")
    return F.when(found != "", found)


def doi_url(value: Column) -> Column:
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit("https://doi.org/"), value))


def scholar_url(text: Column) -> Column:
    return F.concat(F.lit("https://scholar.google.com/scholar?q="), F.url_encode(F.coalesce(text, F.lit(""))))


def expand_numbers(token: Column) -> Column:
    """`1-3,5` as [1, 2, 3, 5], in order, without repeats and impossible parts."""
    ends = F.transform(F.split(token, ","), lambda part: F.transform(F.split(part, "[-–—]"), lambda x: x.try_cast("int")))

    def numbers(e):
        first, last = F.get(e, F.lit(0)), F.get(e, F.lit(1))
        span = F.when((F.size(e) == 2) & (last >= first) & (last - first <= WIDEST_RANGE), F.sequence(first, last))
        return F.when(F.size(e) == 1, e).otherwise(F.coalesce(span, F.array().cast("array<int>")))

    return F.array_distinct(F.filter(F.flatten(F.transform(ends, numbers)), lambda n: (n >= 1) & (n <= LARGEST_NUMBER)))


def cite_numbers(text: Column) -> Column:
    """Citation numbers of a sentence: those in brackets first, then superscripts, each once."""
    raw = F.coalesce(text, F.lit(""))
    brackets = F.flatten(F.transform(F.regexp_extract_all(strip_tags(raw), F.lit(CITE_BRACKET), F.lit(1)), expand_numbers))
    sups = F.transform(F.regexp_extract_all(raw, F.lit(CITE_SUP), F.lit(1)), lambda n: n.cast("int"))
    return F.array_distinct(F.concat(brackets, sups))


def figure_key(label: Column) -> Column:
    """`fig:2`, `scheme:1a`, `table:s1`; null where the label is none."""
    kind = F.lower(F.regexp_extract(label, r"(?i)\b(Fig|Scheme|Table)(?:ures?|s)?\.?\s*S?\d+[a-z]?\b", 1))
    number = F.lower(F.regexp_extract(label, FIGURE, 2))
    return F.when((kind != "") & (number != ""), F.concat_ws(":", kind, number))


def figure_mentions(text: Column) -> Column:
    """(key, label) of figures, schemes and tables that a text mentions, first of each key, in order."""
    labels = F.regexp_extract_all(strip_tags(text), F.lit(FIGURE), F.lit(1))
    keyed = F.transform(labels, lambda x: F.struct(F.lower(F.regexp_replace(x, r"(?i)^(Fig|Scheme|Table)[a-z]*\.?\s*", "$1:")).alias("key"), squeeze(x).alias("label")))
    return F.aggregate(
        keyed,
        F.array().cast("array<struct<key:string,label:string>>"),
        lambda seen, x: F.when(F.exists(seen, lambda y: y["key"] == x["key"]), seen).otherwise(F.concat(seen, F.array(x))),
    )


def figure_refs(text: Column) -> Column:
    """Labels of figures, schemes and tables that a text mentions, first of each key, in order."""
    return F.transform(figure_mentions(text), lambda x: x["label"])


def caption_key(caption: Column) -> Column:
    """Key of the label that leads a caption, or stands in its first 80 characters."""
    head = F.trim(strip_tags(caption))
    led = F.regexp_extract(head, r"(?i)^((?:Figures?|Figs?|Scheme|Table)\.?\s*S?\d+[a-z]?)\b", 1)
    return figure_key(F.when(led != "", led).otherwise(F.substring(head, 1, 80)))


def is_caption(line: Column, figures: bool = True, tables: bool = True) -> Column:
    """Whether a line is a caption of the wanted kind rather than running text that starts with a label."""
    raw = F.trim(F.coalesce(line, F.lit("")))
    label = F.regexp_extract(raw, CAPTION_LABEL, 1)
    is_table = F.lower(label).startswith("table")
    strict = F.lit(False)
    if figures:
        strict = strict | raw.rlike(CAPTION_STRICT_FIGURE)
    if tables:
        strict = strict | raw.rlike(CAPTION_STRICT_TABLE)
    wrong = (is_table if figures and not tables else F.lit(False)) | (~is_table if tables and not figures else F.lit(False))
    rest = F.regexp_replace(F.substr(raw, F.length(label) + 1), r"^[ \t.:;·–—\-]+", "")
    titled = rest.rlike(r"^[\p{Lu}\p{Nd}(\[]") | ~rest.rlike("^[A-Za-z]")
    return (label != "") & ~wrong & (strict | (rest == "") | (~rest.rlike(BODY_VERB) & titled))


def caption_order(caption: Column) -> Column:
    """Sort key: graphical abstract, figures, schemes, tables, others; supplementary numbers last in each kind."""
    raw = F.trim(F.coalesce(caption, F.lit("")))
    kind = F.lower(F.regexp_extract(raw, CAPTION_ORDER, 1))
    rank = F.when(kind.startswith("fig"), 0).when(kind == "scheme", 1).when(kind == "table", 2).when(F.lower(raw).startswith("graphical abstract"), -1).otherwise(3)
    number = F.when(kind != "", F.regexp_extract(raw, CAPTION_ORDER, 3)).when(rank == -1, "0").otherwise("1000000000")
    return F.struct(
        rank.alias("kind"),
        F.when(F.regexp_extract(raw, CAPTION_ORDER, 2) != "", 1).otherwise(0).alias("supplement"),
        number.cast("long").alias("number"),
        F.lower(F.regexp_extract(raw, CAPTION_ORDER, 4)).alias("letter"),
    )


def panel_letters(caption: Column) -> Column:
    """Panel letters of a compound caption: the first range, else single marks; fewer than two are none."""
    text = F.lower(F.coalesce(caption, F.lit("")))
    low, high = (F.regexp_extract(text, r"\(([a-z])\s*[-–—]\s*([a-z])\)", k) for k in (1, 2))
    ranged = F.when((low != "") & (low < high), F.transform(F.sequence(F.ascii(low), F.ascii(high)), lambda c: F.char(c)))
    marks = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\(([a-z])\)"), F.lit(1)))
    found = F.coalesce(ranged, marks)
    return F.when(F.size(found) >= 2, found).otherwise(F.array().cast("array<string>"))


def figure_label(caption: Column) -> Column:
    """The label that leads a figure caption, else `Fig.`."""
    found = F.regexp_extract(F.coalesce(caption, F.lit("")), r"(?i)^\s*((?:Fig(?:ure)?|Scheme)\.?\s*S?\d+)", 1)
    return F.when(found == "", "Fig.").otherwise(F.regexp_replace(F.trim(found), r"\s+", " "))


def panel_caption(label: Column, letter: Column, whole: Column, most: int = 120) -> Column:
    """Caption of one panel: its label and letter, then the whole caption without its label and panel marks."""
    bare = F.regexp_replace(label, r"\.+$", "")
    head = F.concat(bare, F.when(bare.rlike(r"\d$"), F.lit("")).otherwise(F.lit(" ")), F.lower(letter))
    edges = lambda c, chars: F.regexp_replace(c, rf"^[{chars}]+|[{chars}]+$", "")
    flat = F.trim(F.regexp_replace(F.coalesce(whole, F.lit("")), r"\s+", " "))
    rest = edges(F.regexp_replace(flat, r"(?i)^\s*(?:Fig(?:ure)?|Scheme)\.?\s*S?\d+", ""), r" .:—–\-")
    rest = F.regexp_replace(rest, r"(?i)\(\s*[a-h]\s*\)\s*[–\-−~～]\s*\(\s*[a-h]\s*\)|\(\s*[a-h]\s*[–\-−~～]\s*[a-h]\s*\)", "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"(?i)\(\s*[a-h]\s*\)", ""), r"\s+", " ")
    rest = F.substring(edges(rest, r" .,—–\-"), 1, most)
    return F.when(rest == "", F.substring(head, 1, most)).otherwise(F.concat(head, F.lit(" — "), rest))

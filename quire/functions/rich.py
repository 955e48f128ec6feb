"""Rich text: scientific signs, allowed markup, glossaries."""

from __future__ import annotations

import html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signs that stand for a degree; units a micro sign may precede; allowed tags.
DEGREE = "[◦∘˚º°]"
MICRO_UNITS = "m|A|V|W|g|L|l|mol|M|s|F|H|rad|bar"
ALLOWED = ("sub", "sup", "i", "em")
#: Ordered rewriting rules (pattern, replacement) for text without tags.
GLYPH_RULES = [
    ("­", ""),
    (DEGREE + r"\s*([CF])\b", "°$1"),
    (r"(?<=\d)\s*" + DEGREE + "(?=[A-Za-z])", "° "),
    (r"(?<=\d)\s*" + DEGREE, "°"),
    (r"(\d)\s*°\s*([CF])\b", "$1°$2"),
    (r"\bA\s*(?:˚|°|º)(?![\p{L}\p{N}_])", "Å"),
    (r"[μµ]\s*(" + MICRO_UNITS + r")\b", "µ$1"),
    (r"\+/-|\+/−|\+−", "±"),
    (r"(\d)\s*[x×]\s*(10)\b", "$1 × $2"),
]


def outside_tags(text: Column, change) -> Column:
    """change applied to every stretch of text between tags; tags stay as they are."""
    whole = F.coalesce(text, F.lit(""))
    plain = F.split(whole, "<[^>]+>")
    tags = F.regexp_extract_all(whole, F.lit("(<[^>]+>)"), F.lit(1))
    return F.array_join(F.zip_with(F.transform(plain, change), tags, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), "")


def _glyphs(piece: Column) -> Column:
    for pattern, new in GLYPH_RULES:
        piece = F.regexp_replace(piece, pattern, new)
    return piece


def normalize_glyphs(text: Column) -> Column:
    """Look-alikes of degrees, micro, plus-minus and times as the signs themselves, outside tags."""
    return outside_tags(text, _glyphs)


class _Allowed(HTMLParser):
    """Re-writes markup with the allowed tags alone, closed in order, everything else escaped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.open: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in ALLOWED:
            self.open.append(tag)
            self.parts.append(f"<{tag}>")

    def handle_endtag(self, tag):
        if self.open[-1:] == [tag]:
            self.open.pop()
            self.parts.append(f"</{tag}>")

    def handle_data(self, data):
        self.parts.append(html.escape(data, quote=False))

    @classmethod
    def of(cls, raw: str) -> tuple[str, str]:
        """(markup, the same without tags)."""
        p = cls()
        p.feed(raw)
        p.close()
        markup = "".join([*p.parts, *(f"</{t}>" for t in reversed(p.open))]).strip()
        return markup, "".join(x for x in p.parts if not x.startswith("<"))


def clean_markup(raw: str | None) -> str:
    """Allowed markup of a sentence; plain where tags outweigh the text."""
    raw = (raw or "").strip()
    if "<" not in raw:
        return html.escape(raw, quote=False)
    markup, plain = _Allowed.of(raw)
    if plain and len(markup) - len(plain) > max(80, 2 * len(plain)):
        return html.escape(plain, quote=False).strip()
    return markup


def sanitize(text: Column) -> Column:
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([clean_markup(t) for t in texts], dtype=object)

    return clean(text)


def rich_plain(text: Column) -> Column:
    @F.pandas_udf("string")
    def bare(texts: pd.Series) -> pd.Series:
        return pd.Series([_Allowed.of(t)[1].strip() if t and "<" in t else (t or "").strip() for t in texts], dtype=object)

    return bare(text)


def dash_forms(raw: Column) -> Column:
    """A formula with its other spellings of dashes and delta."""
    swaps = [("-", "−"), ("−", "-"), ("-", "–"), ("–", "-"), ("δ", "𝛿"), ("𝛿", "δ")]
    return F.array_distinct(F.array(raw, *[F.replace(raw, F.lit(a), F.lit(b)) for a, b in swaps]))


def apply_glossary(text: Column, formulas: Column) -> Column:
    """Text with each formula (array of raw, rich) in its rich form outside tags; longest spellings first.

    A formula whose rich form is there already is left alone.
    """
    known = F.filter(formulas, lambda f: (f["raw"] != "") & (f["rich"] != "") & (f["raw"] != f["rich"]))
    forms = F.flatten(F.transform(known, lambda f: F.transform(dash_forms(f["raw"]), lambda r: F.struct((-F.length(r)).alias("n"), r.alias("raw"), f["rich"].alias("rich")))))

    def put(done, f):
        return F.when(F.contains(done, f["rich"]), done).otherwise(outside_tags(done, lambda p: F.replace(p, f["raw"], f["rich"])))

    return F.aggregate(F.sort_array(forms), normalize_glyphs(text), put)


def with_glossary(df: DataFrame, text: str = "text", formulas: str = "formulas") -> DataFrame:
    """df with its formulas applied to text, and markup that is not allowed cleaned after that.

    The row counter keeps the two steps apart: the parser takes a column, no expression with lambdas.
    """
    applied = F.when(F.monotonically_increasing_id() >= 0, apply_glossary(F.col(text), F.col(formulas)))
    return df.withColumn(text, applied).withColumn(text, sanitize(F.col(text)))

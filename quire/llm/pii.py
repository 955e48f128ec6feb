"""Personal data by offset-preserving deobfuscation.

Base patterns find emails, IPv4 addresses, payment cards and phone numbers in the text as written. Then
small transducers rewrite disguises while keeping, for every character they emit, the span of source
characters it came from: look-alike letters and digits become ASCII, invisible characters vanish, spelled
digits become digits, and at/dot disguises become the signs themselves. The same patterns run on the
rewritten text, and each match is mapped back to source offsets. A mapped span is added when its source
differs from its normal form and no base span of its kind holds it; it may reach beyond a base span, as
where a look-alike letter cuts the head off an address.

Every rewriting looks at every text; what it may skip by follows from its own pattern alone, so whether a
disguise is found never depends on other text of the document.

Defined cases: null and empty texts have no spans; overlapping matches of different kinds all count;
repeated rows repeat; an empty table gives an empty result; further columns are ignored by `find_spans`
and kept by `redact`, which leaves null texts null.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._shared import bound_batches, spare_name, table, ticked

KINDS = ("email", "ip", "card", "phone")
#: The guard before an ip changes no match (a run of digits fails or holds as a whole); it keeps time linear.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: An email match is found from its sign outwards, so a long text without signs is passed over at once.
SIGN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _ascii_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _holds(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in s.split("."))
    if kind == "card":
        return 14 <= len(d := _ascii_digits(s)) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= len(_ascii_digits(s)) <= 15
    return True


def _emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of the email pattern, in time linear in the text."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = SIGN.match(text, at) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return found


def base_spans(text: str) -> list[Span]:
    """All base matches, by kind; leftmost non-overlapping per kind, failing ones dropped."""
    found = _emails(text) if "@" in text else []
    for kind in KINDS[1:]:
        if kind == "phone" and "+" not in text:
            continue
        found += [(kind, *m.span()) for m in PATTERNS[kind].finditer(text) if (kind != "card" or m.end() - m.start() >= 14) and _holds(kind, m.group())]
    return found


# --- Rewriting. A tape is the rewritten string with the source start and end of every character. ---

#: Fixed look-alikes of ASCII letters, digits and signs that compatibility decomposition does not give.
LOOK_ALIKES = {
    c: plain
    for plain, group in {
        "a": "аαɑ", "c": "сϲ", "d": "ԁ", "e": "еёε", "g": "ɡ", "h": "һ", "i": "іıι", "j": "јȷ", "k": "кκ", "l": "ӏℓ", "m": "м", "n": "пη", "o": "оοσ", "p": "рρ",
        "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υ", "v": "νѵ", "w": "ԝω", "x": "хχ", "y": "уγ",
        "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "G": "Ԍ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ",
        "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ", "3": "З",
        "-": "‐‑‒–—―−﹣－", ".": "․。．｡", "@": "＠﹫", "+": "＋﹢",
    }.items()
    for c in group
}
#: Characters that show nothing: zero-width marks, joiners, soft hyphen, byte order mark.
INVISIBLE = frozenset("\u00ad\u034f\u061c\u115f\u1160\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff\ufe0e\ufe0f\u20e3")
_plain: dict[str, str] = {}


def plain_char(c: str) -> str:
    """ASCII form of one character, "" if invisible, itself if it has none (accented letters stay)."""
    if c not in _plain:
        out = c
        if c in INVISIBLE:
            out = ""
        elif c in LOOK_ALIKES:
            out = LOOK_ALIKES[c]
        elif ord(c) > 127:
            digit, folded = unicodedata.digit(c, None), unicodedata.normalize("NFKC", c)
            if digit is not None:
                out = str(digit)
            elif folded.isascii() and len(folded) == 1 or unicodedata.category(c) == "Zs":
                out = folded if folded.isascii() else " "
            if c in "ªº²³¹":
                out = c
        _plain[c] = out
    return _plain[c]


#: Spelled digits in English, German, French and Spanish; fixed values.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Articles, ordinary words that mean 1 only in a run with other spelled digits.
ARTICLES = ("ein", "un", "une", "una")
_digit_word = "|".join(sorted(SPELLED, key=len, reverse=True))
SPELLED |= dict.fromkeys(ARTICLES, "1")
_word = "|".join(sorted(SPELLED, key=len, reverse=True))
DIGIT_WORD = re.compile(rf"(?<![^\W_])(?:{_digit_word})(?![^\W_])", re.IGNORECASE)
#: A run of at least four digits of which some are spelled, as in "five five five 0 one".
SPELLED_RUN = re.compile(
    rf"(?<![^\W_])(?:(?:double|triple)[\x20-])?(?:{_word}|[0-9])(?:[\x20.,()/-]{{1,3}}(?:(?:dot|point|punkt|punto|dash|minus|hyphen)[\x20-])?(?:(?:double|triple)[\x20-])?(?:{_word}|[0-9]+)){{3,}}(?![^\W_])",
    re.IGNORECASE,
)
SPELLED_ITEM = re.compile(rf"(double|triple)[\x20-]({_word}|[0-9])|({_word})|(dot|point|punkt|punto)|(dash|minus|hyphen)|([0-9]+)|([.()/-])|([\x20,]+)", re.IGNORECASE)
PLUS = re.compile(r"(?<![^\W_])plus[\x20-]+(?=[0-9])", re.IGNORECASE)

_at, _dot = r"at|arroba|arobase|ät|aet|klammeraffe|@", r"dot|punkt|point|punto|\."
#: Bracketed and entity forms stand for the sign wherever they touch a name.
BRACKET_AT = re.compile(rf"(?<=[A-Za-z0-9])[\x20]?(?:[\[({{<]{{1,2}}[\x20]?(?:{_at})[\x20]?[\])}}>]{{1,2}}|&#0*64;|&#x0*40;|&commat;)[\x20]?(?=[A-Za-z0-9])", re.IGNORECASE)
BRACKET_DOT = re.compile(rf"(?<=[A-Za-z0-9])[\x20]?(?:[\[({{<]{{1,2}}[\x20]?(?:{_dot})[\x20]?[\])}}>]{{1,2}}|&#0*46;|&#x0*2e;|&period;)[\x20]?(?=[A-Za-z0-9])", re.IGNORECASE)
#: Bare words stand for the signs only together: name at host dot name (or with the sign written apart).
BARE = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]+(?:(?:\.|[\x20](?:dot|punkt|punto)[\x20])[A-Za-z0-9_%+-]+){0,3}(?P<at>[\x20]+(?:at|arroba|arobase)[\x20]+|[\x20]*[-_]at[-_][\x20]*|[\x20]*@[\x20]*)"
    r"[A-Za-z0-9-]+(?:(?:[\x20]+(?:dot|punkt|punto)[\x20]+|[\x20]\.[\x20]|[-_]dot[-_]|\.)[A-Za-z0-9-]+)+",
    re.IGNORECASE,
)
DIGIT_DOT = re.compile(r"(?<=[0-9])[\x20]+(?:dot|punkt|punto|point)[\x20]+(?=[0-9])", re.IGNORECASE)
BARE_DOT = re.compile(r"[\x20]+(?:dot|punkt|punto)[\x20]+|[\x20]\.[\x20]|[-_]dot[-_]", re.IGNORECASE)
#: Characters that may need unmasking: outside ASCII, other than Latin letters and common marks.
ODD = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿœŒ’‘“”«»…¿¡]")
#: Part of every match of the bracketed and entity forms, and of BARE where it changes anything.
BRACKETED = re.compile(r"[\[({<]\x20?(?:at|dot|@|\.|arroba|arobase|punkt|point|punto|ät|aet|klammeraffe)\x20?[\])}>]|&#|&commat;|&period;", re.IGNORECASE)
APART = re.compile(r"[\x20]@|@[\x20]|[\x20_-](?:dot|punkt|punto)[\x20_-]|[\x20]\.[\x20]", re.IGNORECASE)


class Tape:
    """A string under rewriting: for each of its characters the source span [starts[i], ends[i])."""

    __slots__ = ("ends", "starts", "text")

    def __init__(self, text: str, starts=None, ends=None):
        self.text = text
        self.starts = starts if starts is not None else range(len(text))
        self.ends = ends if ends is not None else range(1, len(text) + 1)

    def edit(self, changes: list[tuple[int, int, str]]) -> Tape:
        """The tape with each [start, end) replaced; changes are in order and do not overlap."""
        if not changes:
            return self
        text, starts, ends, at = [], [], [], 0
        for a, b, new in changes:
            text.append(self.text[at:a])
            starts.extend(self.starts[at:a])
            ends.extend(self.ends[at:a])
            if new:
                text.append(new)
                starts.extend([self.starts[a]] * len(new))
                ends.extend([self.ends[b - 1]] * len(new))
            at = b
        text.append(self.text[at:])
        starts.extend(self.starts[at:])
        ends.extend(self.ends[at:])
        return Tape("".join(text), starts, ends)


def _unmask_characters(tape: Tape) -> Tape:
    return tape.edit([(m.start(), m.end(), p) for m in re.finditer("[^\x00-\x7f]", tape.text) if (p := plain_char(m.group())) != m.group()])


def _spelled_digits(tape: Tape) -> Tape:
    changes = []
    for run in SPELLED_RUN.finditer(tape.text):
        if not DIGIT_WORD.search(run.group()):
            continue
        items = list(SPELLED_ITEM.finditer(tape.text, run.start(), run.end()))
        for k, m in enumerate(items):
            times, repeated, word, dot, dash, _, _, gap = m.groups()
            if repeated:
                changes.append((*m.span(), SPELLED.get(repeated.lower(), repeated) * (2 if times.lower() == "double" else 3)))
            elif word:
                changes.append((*m.span(), SPELLED[word.lower()]))
            elif dot or dash:
                changes.append((*m.span(), "." if dot else "-"))
            elif gap and 0 < k < len(items) - 1:
                # A gap beside a spelled item closes up, so that digits, dots and dashes meet.
                beside = [items[k - 1], items[k + 1]]
                if any(x.group(2) or x.group(3) or x.group(4) or x.group(5) for x in beside):
                    changes.append((*m.span(), ""))
    tape = tape.edit(changes)
    return tape.edit([(*m.span(), "+") for m in PLUS.finditer(tape.text)])


def _signs(tape: Tape) -> Tape:
    if BRACKETED.search(tape.text):
        tape = tape.edit([(*m.span(), "@") for m in BRACKET_AT.finditer(tape.text)])
        tape = tape.edit([(*m.span(), ".") for m in BRACKET_DOT.finditer(tape.text)])
    tape = tape.edit([(*m.span(), ".") for m in DIGIT_DOT.finditer(tape.text)])
    if not APART.search(tape.text):
        return tape
    changes = []
    for m in BARE.finditer(tape.text):
        a, b = m.span("at")
        dots = [(*d.span(), ".") for d in BARE_DOT.finditer(tape.text, m.start(), m.end())]
        spelled_at = tape.text[a:b].strip() != "@"
        if b - a == 1:
            # Behind an address as written, "dot" and a dot apart belong to the sentence.
            dots = [d for d in dots if d[1] <= a or "." not in tape.text[b : d[0]]]
        after = [d for d in dots if d[0] >= b]
        # A bare "at" counts only with a disguised dot behind it; "a@b.c" as written needs no rewriting.
        if (spelled_at and after) or (not spelled_at and (b - a > 1 or dots)):
            changes += sorted([(a, b, "@"), *[d for d in dots if d[1] <= a or d[0] >= b]])
    return tape.edit(changes)


def disguised_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the rewritten text shows, as source offsets; none lies within a base span of its kind."""
    odd = ODD.search(text) is not None
    tape = _signs(_spelled_digits(_unmask_characters(Tape(text)) if odd else Tape(text)))
    if tape.text == text:
        return []
    # The base spans of one kind are in order and apart, so the last to start before a span is the only one to hold it.
    held = {kind: ([s for k, s, _ in base if k == kind], [e for k, _, e in base if k == kind]) for kind in KINDS}
    found = set()
    for kind, a, b in base_spans(tape.text):
        start, end = tape.starts[a], tape.ends[b - 1]
        at = bisect_right(held[kind][0], start) - 1
        if text[start:end] != tape.text[a:b] and (at < 0 or held[kind][1][at] < end):
            found.add((kind, start, end))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def render(spans: list[Span]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans of one text, in code points."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, disguised_spans(text, base)


def mask(text: str, spans: list[Span]) -> str:
    """text with every span replaced by its kind in brackets; overlapping spans merge under the first kind."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))):
        if s < at:
            if e > at:
                at = e
            continue
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added): the rendered spans of every text."""

    def run(batches):
        for b in batches:
            found = [scan(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([render(x) for x, _ in found], pa.string()), pa.array([render(x) for _, x in found], pa.string())], names=["id", "base", "added"])

    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(ticked(id_col).alias("id"), ticked(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, base string, added string")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with personal data masked in the text; length_col, where there is one, follows the new text."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else mask(t, [s for part in scan(t) for s in part]) for t in texts], dtype=object)

    bound_batches(docs.sparkSession)
    new = spare_name(docs, "masked")
    out = docs.withColumn(new, masked(ticked(text_col).cast("string")))
    replaced = {text_col: ticked(new)}
    if length_col in docs.columns and length_col != text_col:
        replaced[length_col] = F.length(ticked(new)).cast(docs.schema[length_col].dataType)
    return out.select(*[replaced.get(c, ticked(c)).alias(c) for c in docs.columns])


def op4_pii(spark, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    base = F.filter(F.split("base", ","), lambda x: x != "")
    both = F.concat(base, F.filter(F.split("added", ","), lambda x: x != ""))
    parts = F.transform(both, lambda x: F.struct(F.split(x, ":")[1].cast("long").alias("s"), F.array_position(F.array(*map(F.lit, KINDS)), F.split(x, ":")[0]).alias("k"), x.alias("x")))
    return found.select(
        F.col("id").alias("doc_id"),
        *[_count(base, kind) for kind in KINDS],
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(F.sort_array(parts), lambda p: p["x"]), ",").alias("spans"),
    )


def _count(spans, kind: str):
    return F.size(F.filter(spans, lambda x: F.startswith(x, F.lit(kind + ":")))).cast("long").alias(f"n_{kind}")

"""Literal cases of the column functions and sequential operators."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import records, refs, rich, speech, text
from quire.operators import chunk_plans, enrich, figures, practice
from quire.operators.segment import merge_multicolumn, sentence_array


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'int' if isinstance(v, int) else 'array<string>'}" for k, v in values.items()))
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize(("given", "count"), [("see Fig. 1 for details.", 1), ("The end. Next claim starts.", 2), ("Yes! \"No\" he said? Then e.g. This", 3), ("", 0), (None, 0), ("  \n ", 0)])
def test_sentences(spark, given, count):
    assert len(one(spark, sentence_array(F.col("t")), t=given)) == count


@pytest.mark.parametrize(
    ("given", "numbers"),
    [("Hello.[1] More.[2-3,5]", [1, 2, 3, 5]), ("x<sup>12</sup> y", [12]), ("[0] and [99999]", []), ("[5-3] [1-90]", []), ("<sup>0</sup>", [0]), ("[2, 1, 2–4]", [2, 1, 3, 4]), (None, [])],
)
def test_citations(spark, given, numbers):
    assert one(spark, refs.cite_numbers(F.col("t")), t=given) == numbers


@pytest.mark.parametrize(
    ("given", "labels"), [("Figure 1 and Scheme 1a", ["Figure 1", "Scheme 1a"]), ("Table S1 shows", ["Table S1"]), ("Fig. <b>2</b> and fig 2 again", ["Fig. 2"]), ("nothing", [])]
)
def test_mentions(spark, given, labels):
    assert one(spark, refs.figure_refs(F.col("t")), t=given) == labels


@pytest.mark.parametrize(("given", "key"), [("Fig. 2 — XRD pattern", "fig:2"), ("Table S1 Summary", "table:s1"), ("Other text", None)])
def test_caption_keys(spark, given, key):
    assert one(spark, refs.caption_key(F.col("t")), t=given) == key


@pytest.mark.parametrize(("given", "yes"), [("Fig. 1 Soft title", True), ("Figure 9 illustrates the case", False), ("Figure 3: anything", True), ("Table 1 Values", False), ("Fig. 2", True), ("Fig. 2 (a) part", True), ("", False)])
def test_captions(spark, given, yes):
    assert one(spark, refs.is_caption(F.col("t"), tables=False), t=given) is yes


def test_caption_order(spark):
    want = ["Graphical abstract", "Figure 1. a", "Fig. 1a b", "Fig. 1b c", "Fig. 2 d", "Fig. S1 e", "Scheme 1 f", "Table 1 g", "Other"]
    mixed = random.Random(1).sample(want, len(want))
    df = spark.createDataFrame([(c,) for c in mixed], "c string")
    assert [r.c for r in df.orderBy(refs.caption_order(F.col("c"))).collect()] == want


@pytest.mark.parametrize(("given", "letters"), [("(a) XRD (b) SEM", ["a", "b"]), ("(a–c) all", ["a", "b", "c"]), ("single (a)", []), ("none", [])])
def test_panels(spark, given, letters):
    assert one(spark, refs.panel_letters(F.col("t")), t=given) == letters


def test_secrets(spark):
    raw = "Authorization: Bearer abc.def== api_key=K1 password: p cookie: c1; session_token=zz"
    got = one(spark, text.redact_secrets(F.col("t")), t=raw)
    assert not any(s in got for s in ("abc", "K1", ": p ", "c1", "zz")) and got.count("REDACTED") >= 5
    assert one(spark, text.redact_secrets(F.col("t"), 5), t="abcdefgh") == "abcd…"


def test_pages_and_titles(spark):
    assert one(spark, text.normalize_page(F.col("t")), t=" exam-\nple one\nline  two\n\nnext ") == "example one line two\n\nnext"
    assert one(spark, text.title_key(F.col("t")), t="Title: Große—Straßen,  2!") == "grosse strassen 2"
    assert one(spark, text.comparable(F.col("t")), t="It’s <b>FINE</b>, ok!") == "it's fine ok"
    assert one(spark, text.invite_format(F.col("t")), t="tqg3 v12t") == "TQG3-V12T"


def test_rich_text():
    assert rich.clean_markup("a <b>b</b> <i>c & d") == "a b <i>c &amp; d</i>"
    assert rich.clean_markup(None) == "" and rich.clean_markup("x < y") == "x &lt; y"
    assert rich.clean_markup("<i></i>" * 40 + "x") == "x"


@pytest.mark.parametrize(
    ("given", "words"), [("1650 cm<sup>−1</sup>", "per centimeter"), ("A → B", "goes to"), ("Title: Ni in water", "nickel in water"), ("25 °C", "degrees Celsius"), ("&lt;i&gt;x&lt;/i&gt; ≤ 3", "less than or equal to"), ("750 W h / L", "watt hour per liter"), ("Body: 2 m^3", "cubic meter"), ("5 ug/mL", "microgram per milliliter"), ("1 mol/dm^3 Og", "mole per liter oganesson"), ("3 s^{-1}", "per second"), ("a<br/>b <b>1 Hz</b>", "a b 1 hertz")]
)
def test_speech(given, words):
    assert words in speech.say(given) and "Title" not in speech.say(given)


def test_number_words_agree(spark):
    values = ["10", "-10.5", "12", "+3", "0.1", "x", "NiO", "3−2", "1.2.3-4,5", "a long piece", ""]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", speech.number_words(F.col("v")).alias("w"))
    assert {r.v: r.w for r in df.collect()} == {v: speech.say_number(v) for v in values}


def test_answers(spark):
    cut = '{"sentences":[{"text":"a \\"q\\"","section":"body"},{"section":"title","text":"b"},{"text":"cu'
    assert [(s.text, s.section) for s in one(spark, records.sentences_of(F.col("t")), t=cut)] == [('a "q"', "body"), ("b", "title")]
    assert one(spark, records.digest_blocks(F.col("t")), t="EN: x\nKO: y\n") == ("x", "y")
    assert one(spark, records.quality_answer(F.col("t"), F.lit(3)), t='```json\n{"verdict":"repair_pages","bad_pages":[2,7,2]}\n```') == ("repair_pages", [2])
    merged = merge_multicolumn(F.lit("text_ok"), F.array(F.lit(1)), F.array(F.lit(0), F.lit(9)), F.lit(3))
    assert one(spark, merged, t="") == ("repair_pages", [0, 1])


def test_chunks():
    body = ("word " * 80 + "end. ") * 10
    pieces = enrich.chunks_of(body, 500)
    assert all(0 < len(p) <= 500 for p in pieces) and "".join(pieces).replace(" ", "") == body.replace(" ", "")
    assert pieces[0].endswith("end.") and enrich.chunks_of(None) == [] and enrich.chunks_of("x" * 1200, 500) == ["x" * 500, "x" * 500, "x" * 200]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_token_diff():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        steps = practice.align(a, b)
        assert [s[1] for s in steps if s[1] is not None] == a and [s[2] for s in steps if s[2] is not None] == b
        assert sum(s[0] == "equal" for s in steps) == lcs(a, b)
    assert practice.align(["x"], ["y"]) == [("replace", "x", "y")] and practice.align([], []) == []
    assert practice.align(["a", "b"], ["b"]) == [("delete", "a", None), ("equal", "b", "b")]
    assert practice.compare(None, []) == {"ok": False, "error": "empty", "diff": None} and practice.compare(["a"], None)["diff"] == [{"op": "delete", "expected": "a", "heard": None}]
    a, b = ([rng.choice("abcdefgh") for _ in range(3000)] for _ in range(2))
    assert sum(s[0] == "equal" for s in practice.align(a, b)) == lcs(a, b)


def test_practice_chunks(spark):
    grow = chunk_plans.growing_chunks(F.col("c"), F.lit("catalyst is a tool"))
    assert one(spark, grow, c=["catalyst", "catalyst is", "catalyst is a tool"]) == ["catalyst", "catalyst is", "catalyst is a tool"]
    assert one(spark, grow, c=["catalyst"]) == ["catalyst is a tool"]
    assert one(spark, grow, c=["is", "catalyst is a tool"]) is None


def test_greedy_captions(spark):
    captions = spark.createDataFrame([(0, 1, 10.0, 100.0, 60.0, 110.0), (0, 2, 10.0, 200.0, 60.0, 210.0)], "page int, caption_no int, x0 double, y0 double, x1 double, y1 double")
    images = spark.createDataFrame([(0, 1, 10.0, 40.0, 60.0, 95.0), (0, 2, 10.0, 115.0, 60.0, 190.0), (1, 3, 0.0, 0.0, 50.0, 50.0)], "page int, image_no int, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.caption_no, r.image_no, r["mode"]) for r in figures.assign(captions, images, ["page"]).collect()) == [(1, 1, 0), (2, 2, 0)]


def test_sources_and_sinks(spark, tmp_path):
    from quire.sources import readers, writers

    (tmp_path / "e.jsonl").write_text('{"id":"1","ts":5,"kind":"k"}\n\nnot json\n{"ts":3}\n')
    assert [r.id for r in readers.json_lines(spark, str(tmp_path / "e.jsonl")).collect()] == ["1"]
    assert one(spark, readers.source_kind(F.col("t")), t="A.PDF") == "pdf" and one(spark, readers.source_kind(F.col("t")), t="a.txt") is None
    png = spark.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\n"), None)], "b binary, m string")
    assert png.select(readers.image_mime(F.col("b"), F.col("m")).alias("v")).first().v == "image/png"
    assert bytes(png.select(readers.data_url_bytes(readers.data_url(F.col("b"), F.lit("image/png"))).alias("v")).first().v) == b"\x89PNG\r\n\x1a\n"
    assert one(spark, writers.object_name("p/", F.col("a"), F.col("b")), a="u1", b="x.png") == "p/u1/x.png"
    assert one(spark, writers.object_name("p/", F.col("a"), F.col("b")), a="u1", b="../x") is None
    old, new = spark.range(5), spark.range(5, 8)
    assert sorted(r.id for r in writers.append_capped(old, new, ["id"], 4).collect()) == [4, 5, 6, 7]

"""Queries on rich text, speech text, model answers, enrichment and figure geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import records, rich, speech, text
from quire.operators import chunk_plans, enrich, figures
from quire.plans.carriers import SENTENCES_SQL, sentences, table
from quire.plans.catalog_queries import _view

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_glyph = "p_name || ' at ' || p_size || ' ◦C and ' || p_size || '˚ with ' || p_size || ' μ m <sup>+/-</sup> +/-' || p_size || ' x 10 A ˚ ' || p_brand"


@query(r"""SELECT p_partkey, p_name || ' at ' || p_size || '°C and ' || p_size || '° with ' || p_size || ' µm <sup>±</sup> ±' || p_size || ' × 10 Å ' || p_brand AS clean FROM part""")
def glyphs(spark, d):
    return table(spark, d, "part").select("p_partkey", rich.normalize_glyphs(F.expr(_glyph)).alias("clean"))


_raw = "CASE p_partkey % 4 WHEN 0 THEN '<b>' || p_name || '</b> & <i>x<sub>2</sub>' WHEN 1 THEN p_name || ' < ' || p_size WHEN 2 THEN '<i>' || p_name || '</sub></i>' ELSE ' ' || p_name || ' ' END"


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' &amp; <i>x<sub>2</sub></i>' WHEN 1 THEN p_name || ' &lt; ' || p_size WHEN 2 THEN '<i>' || p_name || '</i>' ELSE p_name END AS markup FROM part""")
def sanitized_markup(spark, d):
    return table(spark, d, "part").select("p_partkey", rich.sanitize(F.expr(_raw)).alias("markup"))


@query("""SELECT p_partkey, p_brand || ' BaZr<sub>0.9</sub> with <i>k</i> and BaZr<sub>0.9</sub> <sub>H2O</sub>' AS applied FROM part""")
def glossary(spark, d):
    formulas = F.array(F.struct(F.lit("BaZr0.9").alias("raw"), F.lit("BaZr<sub>0.9</sub>").alias("rich")), F.struct(F.lit("").alias("raw"), F.lit("x").alias("rich")))
    return table(spark, d, "part").select("p_partkey", rich.apply_glossary(F.expr("p_brand || ' BaZr0.9 with <i>k</i> and BaZr0.9 <sub>H2O</sub>'"), formulas).alias("applied"))


_digit_sql = "array_to_string(list_transform(string_split(({})::varchar, ''), lambda c: CASE c " + " ".join(f"WHEN '{k}' THEN '{w}'" for k, w in enumerate(speech.DIGITS)) + " WHEN '.' THEN 'point' WHEN '-' THEN 'minus' WHEN '+' THEN 'plus' ELSE c END), ' ')"


@query(f"SELECT p_partkey, CASE WHEN p_size = 10 THEN 'ten' ELSE {_digit_sql.format('p_size')} END AS whole, 'minus ' || {_digit_sql.format('p_partkey % 10')} || ' point ' || {_digit_sql.format('p_size')} AS signed FROM part")
def number_words(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", speech.number_words(F.col("p_size").cast("string")).alias("whole"), speech.number_words(F.expr("'−' || (p_partkey % 10) || '.' || p_size")).alias("signed"))


#: What follows a part's name, and how it is read.
_sayings = [
    ("→ <sub>7</sub>°C<sup>−1</sup> ≤ Ni", "goes to seven degrees Celsius to the minus one less than or equal to nickel"),
    ("2800 W h L<sup>-1</sup>", "2800 watt hour per liter"), ("150 mAh g⁻¹", "150 milliampere hour per gram"), ("100 kJ mol<sup>−1</sup> at 300 K", "100 kilojoule per mole at 300 kelvin"),
    ("band at 800 cm-1 5 ppm", "band at 800 per centimeter 5 parts per million"), ("rated at 100 W and 3 mV", "rated at 100 watt and 3 millivolt"), ("2 cm² of 4 wt% BaZr0.9", "2 square centimeter of 4 weight percent barium zirconium 0.9"),
    ("H&lt;sub&gt;2&lt;/sub&gt;O at 1 atm", "hydrogen two oxygen at 1 atmosphere"), ("5 mA cm<sup>-2</sup> 60 rpm", "5 milliampere per square centimeter 60 revolutions per minute"),
    ("In2O3 as He said", "In two oxygen three as He said"), ("1 mol/L × 3 g/L ± 2 MPa", "1 mole per liter times 3 gram per liter plus or minus 2 megapascal"), ("10<sup>-3</sup> s⁻¹ 2 eV", "ten to the minus three per second 2 electron volt"),
]
_quoted = lambda k: ", ".join("'" + x[k].replace("'", "''") + "'" for x in _sayings)


@query(f"SELECT p_partkey, p_name || ' ' || ([{_quoted(1)}])[1 + p_partkey % {len(_sayings)}] AS spoken FROM part")
def spoken_text(spark, d):
    raw = F.concat(F.lit("Title: "), F.col("p_name"), F.lit(" "), F.get(F.array(*[F.lit(x[0]) for x in _sayings]), (F.col("p_partkey") % len(_sayings)).cast("int")))
    return table(spark, d, "part").select("p_partkey", speech.spoken(raw).alias("spoken"))


@query("SELECT event_id, substr(sha256('en-US-' || event_type || '|1.00|' || coalesce(props, '')), 1, 24) AS key, 'en-US' AS language FROM events")
def speech_keys(spark, d):
    voice = F.concat(F.lit("en-US-"), F.col("event_type"))
    return table(spark, d, "events").select("event_id", speech.speech_key(F.coalesce("props", F.lit("")), voice).alias("key"), speech.voice_language(voice).alias("language"))


_answer = """CASE event_id % 4 WHEN 0 THEN '```json' || chr(10) || '{"sentences":[{"text":"a ' || event_id || '","section":"body"},{"text":"b","section":"title"}]}' || chr(10) || '```'
 WHEN 1 THEN 'Here: {"sentences":[{"text":"a ' || event_id || '","section":"body"},{"section":"title","text":" b "},{"text":"cut'
 WHEN 2 THEN 'no json ' || event_id ELSE '{"sentences":[{"text":"a ' || event_id || '","section":"body"}]} trailing' END"""


@query("""SELECT event_id, CASE event_id % 4 WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS n, CASE WHEN event_id % 4 <> 2 THEN 'a ' || event_id END AS first_text, CASE WHEN event_id % 4 < 2 THEN 'title' END AS second_section FROM events""")
def answer_sentences(spark, d):
    found = table(spark, d, "events").select("event_id", records.sentences_of(F.expr(_answer)).alias("s"))
    return found.select("event_id", F.size("s").alias("n"), F.get("s", F.lit(0))["text"].alias("first_text"), F.get("s", F.lit(1))["section"].alias("second_section"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'e ' || event_id WHEN 1 THEN '' ELSE 'only' END AS en, CASE event_id % 3 WHEN 0 THEN 'k' WHEN 1 THEN 'plain ' || event_id ELSE '' END AS ko FROM events""")
def digest_blocks(spark, d):
    raw = F.expr("CASE event_id % 3 WHEN 0 THEN 'EN: e ' || event_id || chr(10) || 'KO: k ' WHEN 1 THEN ' plain ' || event_id ELSE 'en : only' END")
    block = records.digest_blocks(raw)
    return table(spark, d, "events").select("event_id", block["en"].alias("en"), block["ko"].alias("ko"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'repair_pages' WHEN 1 THEN 'text_ok' ELSE 'full_vision' END AS verdict, CASE WHEN event_id % 3 = 0 THEN [1, (event_id % 5)::int + 2] ELSE []::int[] END AS bad_pages,
 CASE WHEN event_id % 3 = 0 THEN [1, (event_id % 5)::int + 2, 0] ELSE [0, 1, 2] END AS seen FROM events""")
def quality_answers(spark, d):
    raw = F.expr("CASE event_id % 3 WHEN 0 THEN '{\"verdict\":\"repair_pages\",\"bad_pages\":[' || (event_id % 5 + 2) || ',1,1,99]}' WHEN 1 THEN '{\"verdict\":\"repair_pages\",\"bad_pages\":[-1]}' ELSE '{\"verdict\":\"full_vision\"}' END")
    answer = records.quality_answer(raw, F.lit(10))
    return table(spark, d, "events").select("event_id", answer["verdict"].alias("verdict"), answer["bad_pages"].alias("bad_pages"), records.vision_pages(answer["bad_pages"], F.lit(10), 3).alias("seen"))


@query("SELECT doc_id, CASE WHEN length(coalesce(text, '')) <= 120000 THEN coalesce(text, '') ELSE substr(text, 1, 96000) || chr(10) || chr(10) || '[...middle omitted...]' || chr(10) || chr(10) || right(text, 24000) END AS sample FROM documents")
def survey_sample(spark, d):
    return table(spark, d, "documents").select("doc_id", enrich.head_and_tail(F.coalesce("text", F.lit(""))).alias("sample"))


@query(r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS rest, NULL::varchar AS piece, true AS more FROM documents
  UNION ALL
  SELECT doc_id, CASE WHEN cut IS NULL THEN '' ELSE substr(rest, cut + 1) END, CASE WHEN cut IS NULL THEN rest ELSE left(rest, cut) END, cut IS NOT NULL FROM (
    SELECT doc_id, rest, CASE WHEN length(rest) <= 500 THEN NULL WHEN coalesce(at_, 0) <= 166 THEN 500 WHEN substr(rest, at_ + 1, 2) = chr(10) || chr(10) THEN at_ + 2 ELSE at_ + 1 END AS cut
    FROM (SELECT *, list_max(list_filter(range(0, 499), lambda i: substr(rest, i + 1, 2) IN (chr(10) || chr(10), '. ', '? '))) AS at_ FROM w WHERE more))
), p AS (SELECT doc_id, regexp_replace(piece, '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS piece FROM w WHERE piece IS NOT NULL)
SELECT doc_id, count(*) AS pieces, sum(length(piece))::bigint AS chars, max(length(piece))::bigint AS longest FROM p WHERE piece <> '' GROUP BY doc_id""")
def text_chunks(spark, d):
    pieces = table(spark, d, "documents").select("doc_id", F.explode(enrich.chunk_text(F.col("text"), 500)).alias("piece"))
    return pieces.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.length("piece")).cast("long").alias("chars"), F.max(F.length("piece")).cast("long").alias("longest"))


@query(f"""WITH {SENTENCES_SQL}, s AS (SELECT doc_id, CASE WHEN ord % 9 = 0 THEN 'title' WHEN ord % 2 = 0 THEN 'body' ELSE 'results' END AS section FROM sentences),
 u AS (SELECT doc_id, sum(n)::bigint AS units FROM (SELECT doc_id, section, 2 * count(*) + 1 AS n FROM s GROUP BY ALL) GROUP BY doc_id)
 SELECT doc_id, units + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS units FROM u""")
def work_units(spark, d):
    rows = sentences(spark, d).withColumn("section", F.expr("CASE WHEN ord % 9 = 0 THEN 'title' WHEN ord % 2 = 0 THEN 'body' ELSE 'results' END"))
    captions = table(spark, d, "documents").select("doc_id", F.expr("CASE WHEN doc_id % 2 = 0 THEN 'Fig. 1' ELSE ' <i></i> ' END").alias("caption"))
    return enrich.work_units(rows, captions)


@query(f"""WITH {SENTENCES_SQL}, s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND ord % 40 = 7 THEN '' ELSE 'k' END AS ko, CASE WHEN doc_id % 3 = 1 AND ord = 2 THEN 'draft' WHEN doc_id % 2 = 0 THEN 'polish' ELSE '' END AS stage FROM sentences)
 SELECT doc_id, bool_or(ko = '' OR (stage <> '' AND stage NOT IN ('polish', 'harmonize'))) OR greatest(avg((ko <> '' AND stage IN ('polish', 'harmonize'))::int), avg((ko <> '')::int)) < 0.05 AS needs FROM s GROUP BY doc_id""")
def needs_translation(spark, d):
    rows = sentences(spark, d).withColumn("text_ko", F.expr("CASE WHEN doc_id % 3 = 0 AND ord % 40 = 7 THEN '' ELSE 'k' END"))
    return enrich.needs_translation(rows.withColumn("text_ko_stage", F.expr("CASE WHEN doc_id % 3 = 1 AND ord = 2 THEN 'draft' WHEN doc_id % 2 = 0 THEN 'polish' ELSE '' END")))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'h' WHEN event_id % 3 = 0 THEN 'p' WHEN event_id % 5 = 0 THEN 'd' END AS best FROM events")
def enrichment_stages(spark, d):
    stages = [F.expr(f"CASE WHEN event_id % {k} = 0 THEN '{v}' ELSE ' ' END") for k, v in ((5, "d"), (3, "p"), (2, "h"))]
    return table(spark, d, "events").select("event_id", enrich.best_stage(*stages).alias("best"))


@query("""SELECT p_partkey, CASE WHEN n <= 1 THEN 1 WHEN n = 2 THEN CASE WHEN w >= h THEN 1 ELSE 2 END WHEN n = 3 THEN CASE WHEN w >= h * 1.15 THEN 1 ELSE 3 END WHEN n = 4 THEN 2 WHEN n IN (6, 8) THEN CASE WHEN w >= h THEN 2 ELSE n // 2 END WHEN w >= h OR w * 2 >= h * n THEN 1 ELSE n END::int AS rows,
 CASE WHEN n <= 1 THEN 1 WHEN n = 2 THEN CASE WHEN w >= h THEN 2 ELSE 1 END WHEN n = 3 THEN CASE WHEN w >= h * 1.15 THEN 3 ELSE 1 END WHEN n = 4 THEN 2 WHEN n IN (6, 8) THEN CASE WHEN w >= h THEN n // 2 ELSE 2 END WHEN w >= h OR w * 2 >= h * n THEN n ELSE 1 END::int AS cols
 FROM (SELECT p_partkey, (p_partkey % 10)::int AS n, p_size AS w, 25 AS h FROM part)""")
def panel_grids(spark, d):
    grid = figures.panel_grid(F.col("p_partkey") % 10, F.col("p_size"), F.lit(25))
    return table(spark, d, "part").select("p_partkey", grid["rows"].alias("rows"), grid["cols"].alias("cols"))


_boxes = "SELECT l_orderkey AS page, l_linenumber AS {no}, (l_partkey % 300) * 1.0D AS x0, (l_suppkey % 10) * 60.0D + {shift} AS y0, (l_partkey % 300) * 1.0D + 60 + l_quantity AS x1, (l_suppkey % 10) * 60.0D + {shift} + {tall} AS y1 FROM {{lineitem}} WHERE {where}"


_beside = "(least({a}x1, {b}x1) - greatest({a}x0, {b}x0) >= 0.12::double * greatest({b}x1 - {b}x0, 1.0) OR ({a}x0 + {a}x1) / 2 BETWEEN {b}x0 - 40 AND {b}x1 + 40)"


@query(f"""
WITH RECURSIVE c AS ({_boxes.format(no="caption_no", shift="50", tall="12", where="l_linenumber % 2 = 1").replace("{lineitem}", "lineitem").replace("0D", "0::double")}), i AS ({_boxes.format(no="image_no", shift="0", tall="45", where="l_linenumber % 2 = 0").replace("{lineitem}", "lineitem").replace("0D", "0::double")}),
m AS (SELECT c.page, c.caption_no, i.image_no, i.x0, i.y0, i.x1, i.y1, CASE WHEN c.y0 - i.y1 BETWEEN 0 AND 150 THEN 0 WHEN i.y0 - c.y1 BETWEEN 0 AND 120 THEN 1 END AS mode, CASE WHEN c.y0 - i.y1 BETWEEN 0 AND 150 THEN c.y0 - i.y1 ELSE i.y0 - c.y1 END AS gap
  FROM c JOIN i ON c.page = i.page AND ({_beside.format(a="c.", b="i.")} OR {_beside.format(a="i.", b="c.")})),
o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY caption_no, mode, gap, (x1 - x0) * (y1 - y0) DESC, image_no) AS k FROM m WHERE mode IS NOT NULL),
w AS (
  SELECT DISTINCT page, 0::bigint AS k, -1 AS caption_no, -1 AS image_no, -1 AS mode, false AS took, -1 AS served, []::struct(a double, b double, c double, d double)[] AS used FROM o
  UNION ALL
  SELECT page, k, caption_no, image_no, mode, took, CASE WHEN took THEN caption_no ELSE served END, CASE WHEN took THEN list_append(used, {{'a': x0, 'b': y0, 'c': x1, 'd': y1}}) ELSE used END FROM (
    SELECT o.*, w.served, w.used, o.caption_no <> w.served AND len(list_filter(w.used, lambda u: least(u.c, o.x1) > greatest(u.a, o.x0) AND least(u.d, o.y1) > greatest(u.b, o.y0)
      AND (least(u.c, o.x1) - greatest(u.a, o.x0)) * (least(u.d, o.y1) - greatest(u.b, o.y0)) > 0.55::double * least((u.c - u.a) * (u.d - u.b), (o.x1 - o.x0) * (o.y1 - o.y0)))) = 0 AS took FROM w JOIN o ON o.page = w.page AND o.k = w.k + 1)
)
SELECT page, caption_no, image_no, mode FROM w WHERE took""")
def caption_images(spark, d):
    """Odd lines of an order as captions, even lines as images, assigned page by page."""
    captions = _view(spark, d, _boxes.format(no="caption_no", shift="50", tall="12", where="l_linenumber % 2 = 1"), "lineitem")
    images = _view(spark, d, _boxes.format(no="image_no", shift="0", tall="45", where="l_linenumber % 2 = 0"), "lineitem")
    return figures.assign(captions, images, ["page"])


@query("""SELECT s_suppkey, least(CASE WHEN m <= 100 THEN 6.0 ELSE 84.0 END, x0) AS x0, greatest(y0 - 280, 0.0) AS y0, greatest(CASE WHEN m <= 100 THEN 116.0 ELSE 194.0 END, x1) AS x1, least(300.0, y0 + 14) AS y1
 FROM (SELECT *, (x0 + x1) / 2 AS m FROM (SELECT s_suppkey, (s_suppkey * 7 % 150)::double AS x0, (s_suppkey * 7 % 150)::double + 40 AS x1, (s_suppkey * 13 % 295)::double AS y0 FROM supplier))""")
def orphan_clips(spark, d):
    x0, y0 = F.expr("CAST(s_suppkey * 7 % 150 AS DOUBLE)"), F.expr("CAST(s_suppkey * 13 % 295 AS DOUBLE)")
    page = {k: F.lit(v) for k, v in {"x0": 0.0, "y0": 0.0, "x1": 200.0, "y1": 300.0}.items()}
    clip = figures.figure_clip(page, {"x0": x0, "y0": y0, "x1": x0 + 40, "y1": y0 + 10})
    return table(spark, d, "supplier").select("s_suppkey", *[clip[c].alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("""SELECT s_nationkey, s_suppkey, ord FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS ord, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) WHERE abs(ord - greatest(least(s_nationkey % 5, n - 1), 0)) <= 1""")
def figure_windows(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "supplier").select("s_nationkey", "s_suppkey").withColumn("ord", (F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1).cast("long"))
    cursors = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), (F.col("n_nationkey") % 5).alias("cursor"))
    return figures.figure_window(rows, cursors, "s_nationkey").select("s_nationkey", "s_suppkey", "ord")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN ['a', 'a b c'] WHEN 1 THEN ['a', 'a b c'] WHEN 2 THEN ['a b', 'a b c'] END AS chunks FROM events""")
def practice_chunks(spark, d):
    given = F.expr("CASE event_id % 4 WHEN 0 THEN array('a', 'a b') WHEN 1 THEN array('a', 'a', 'a b c') WHEN 2 THEN array('a b', 'a b c d') ELSE array('b', 'a b c') END")
    return table(spark, d, "events").select("event_id", given.alias("g")).select("event_id", chunk_plans.growing_chunks(F.col("g"), F.lit("a b c")).alias("chunks"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE lower(c_name) || '@x.org' END AS email, CASE WHEN c_custkey % 2 = 0 THEN 'AB12-' || upper(right('000' || (c_custkey % 97), 4)) ELSE 'Z' END AS code,
 regexp_replace(trim(c_name || ' / v1.pdf'), '[^\\p{L}\\p{N}_.\\-]+', '_', 'g') AS file FROM customer""")
def identifiers(spark, d):
    c = table(spark, d, "customer")
    mail = F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'no mail' ELSE '  ' || c_name || '@X.org ' END")
    code = F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'ab-12 ' || right('000' || (c_custkey % 97), 4) ELSE 'z' END")
    return c.select("c_custkey", text.email(F.regexp_replace(mail, "(?<=\\S) (?=\\S+@)", "")).alias("email"), text.invite_format(code).alias("code"), text.safe_filename(F.concat("c_name", F.lit(" / v1.pdf"))).alias("file"))

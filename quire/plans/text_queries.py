"""Queries on text, sentences, citations and captions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import refs, text
from quire.operators import segment
from quire.plans.carriers import CITING, MENTIONING, SENTENCES_SQL, citing, mentioning, sentences, table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {SENTENCES_SQL} SELECT lang, count(*) AS sentences, sum(length(s.text))::bigint AS chars FROM sentences s JOIN documents d USING (doc_id) GROUP BY lang")
def sentence_stats(spark, d):
    pieces = table(spark, d, "documents").select("lang", F.explode(F.slice(segment.sentence_array(F.col("text")), 1, segment.MAX_SENTENCES)).alias("s"))
    return pieces.groupBy("lang").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.length("s")).cast("long").alias("chars"))


@query(f"WITH {SENTENCES_SQL} SELECT doc_id, ord::int AS ord, format('sent_{{:06d}}', ord) AS sentence_id, text FROM sentences")
def sentence_split(spark, d):
    return sentences(spark, d)


@query(r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '(\n\n+)', chr(57344) || '\1' || chr(57344), 'g'),
       '(^|[^\n' || chr(57344) || '])\n($|[^\n' || chr(57344) || '])', '\1 \2', 'g'), '[ \t]+', ' ', 'g'), '^[\s' || chr(57344) || ']+|[\s' || chr(57344) || ']+$|' || chr(57344), '', 'g') AS t FROM documents
""")
def page_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_page(F.col("text"), once=True).alias("t"))


@query(r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(trim(coalesce(text, ''))), 'ß', 'ss'), '^title\s*:\s*', ''), '[^\p{L}\p{N}_\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS title_key
FROM documents""")
def title_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", text.title_key(F.col("text")).alias("title_key"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages")
def html_plain(spark, d):
    return table(spark, d, "pages").select("page_id", text.plain(F.col("html")).alias("plain"))


_secret = "coalesce(text, '') || ' Authorization: Bearer t' || doc_id || '== password=p' || doc_id || ' cookie: c' || doc_id || '; api_key : k' || doc_id || ' session_token=s' || doc_id"


@query(rf"""
SELECT doc_id, CASE WHEN length(t) > 2000 THEN substr(t, 1, 1999) || '…' ELSE t END AS redacted FROM (SELECT doc_id,
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_secret},
 '(?i)\b(bearer\s+)([A-Za-z0-9\-._~+/]+=*)', '\1REDACTED', 'g'), '(?i)(authorization\s*[:=]\s*)(\S+)', '\1REDACTED', 'g'), '(?i)(api[_-]?key\s*[:=]\s*)(\S+)', '\1REDACTED', 'g'),
 '(?i)(password\s*[:=]\s*)(\S+)', '\1REDACTED', 'g'), '(?i)(cookie\s*[:=]\s*)([^\s;]+)', '\1REDACTED', 'g'), '(?i)(session(_token)?\s*[:=]\s*)(\S+)', '\1REDACTED', 'g'), '(?i)(asr_session=)([^\s;]+)', '\1REDACTED', 'g') AS t
 FROM documents)""")
def redact_secrets(spark, d):
    return table(spark, d, "documents").select("doc_id", text.redact_secrets(F.expr(_secret)).alias("redacted"))


@query(r"""
SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(regexp_replace(replace(replace(lower(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g')), '’', ''''), '‘', ''''), '[^\p{L}\p{N}_\s'']+', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS tokens
FROM conversations""")
def speech_tokens(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, sum(length(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]', '', 'g')))::bigint AS alnum, sha256(coalesce(text, '')) AS sha FROM documents GROUP BY doc_id, text")
def text_digests(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", text.alnum_count(F.col("text")).alias("alnum"), text.digest(F.coalesce("text", F.lit(""))).alias("sha"))


_doi = "coalesce(text, '') || ' doi:10.' || (1000 + doc_id % 9000) || '/x.' || doc_id || ').'"


@query(rf"""SELECT doc_id, doi, 'https://doi.org/' || doi AS url FROM (SELECT doc_id, regexp_replace(regexp_extract({_doi}, '(?i)\b(?:doi[:\s]*)?(10\.\d{{4,9}}/[-._;()/:A-Z0-9]+)\b', 1), '[).,;]+$', '') AS doi FROM documents)""")
def doi_extract(spark, d):
    found = table(spark, d, "documents").select("doc_id", refs.doi(F.expr(_doi)).alias("doi"))
    return found.withColumn("url", refs.doi_url(F.col("doi")))


_cited = f"""
WITH {SENTENCES_SQL}, citing AS (SELECT doc_id, ord, {CITING} AS text FROM sentences), numbers AS (
  SELECT doc_id, ord, unnest([1 + doc_id % 7, 2 + doc_id % 7, 3 + doc_id % 7, 9 + ord % 5, 1 + ord % 30]) AS n, unnest([0, 1, 2, 3, 4]) AS place FROM citing
), distinct_numbers AS (
  SELECT doc_id, ord, n, min(place) AS place FROM numbers GROUP BY ALL
), cites AS (
  SELECT doc_id, ord, n::bigint AS n, row_number() OVER (PARTITION BY doc_id, ord ORDER BY place) - 1 AS place FROM distinct_numbers
)"""


@query(_cited + " SELECT doc_id, ord::int AS ord, list(n::int ORDER BY place) AS numbers FROM cites GROUP BY doc_id, ord")
def cite_numbers(spark, d):
    return citing(spark, d).select("doc_id", "ord", refs.cite_numbers(F.col("text")).alias("numbers"))


_listed = "'Intro' || chr(10) || 'References' || chr(10) || '[1] ' || p_name || ' one. doi:10.1000/a' || p_partkey || '.' || chr(10) || '2. ' || p_brand || '  second' || chr(10) || ' entry' || chr(10) || '2) repeated number' || chr(10) || '3) ' || p_type || ' third entry' || chr(10) || 'Appendix A' || chr(10) || '4. not any more'"


@query(r"""
SELECT p_partkey, n, text, doi FROM (
  SELECT p_partkey, 1::bigint AS n, trim(regexp_replace(p_name || ' one. doi:10.1000/a' || p_partkey || '.', '\s+', ' ', 'g')) AS text, '10.1000/a' || p_partkey AS doi FROM part
  UNION ALL SELECT p_partkey, 2, trim(regexp_replace(p_brand || ' second entry', '\s+', ' ', 'g')), NULL FROM part
  UNION ALL SELECT p_partkey, 3, trim(regexp_replace(p_type || ' third entry', '\s+', ' ', 'g')), NULL FROM part)""")
def bibliography(spark, d):
    from quire.operators.links import bibliography as parse

    return parse(table(spark, d, "part").select("p_partkey", F.expr(_listed).alias("text")), "p_partkey")


@query(_cited + """, refs AS (SELECT d.doc_id, n, reference FROM documents d JOIN (SELECT item_id % 3 AS list, 1 + item_id % 30 AS n, substr(trim(arg_max(text, item_id)), 1, 2000) AS reference FROM benchmark WHERE length(trim(text)) >= 3 GROUP BY ALL) b ON b.list = d.doc_id % 3)
 SELECT c.doc_id, ord::int AS ord, place::int AS place, c.n::bigint AS n, reference FROM cites c JOIN refs r ON c.doc_id = r.doc_id AND c.n = r.n""")
def cite_hints(spark, d):
    from quire.operators.links import cite_hints as link
    from quire.operators.links import normalize_references

    # All items are entries of three lists, with thirty numbers between them; of one number the latest item counts.
    items = table(spark, d, "benchmark").select((F.col("item_id") % 3).alias("list"), (-F.col("item_id")).alias("pos"), (1 + F.col("item_id") % 30).alias("n"), "text")
    lists = normalize_references(items, "list", "pos")
    references = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 3).alias("list")).join(lists, "list").drop("list")
    return link(citing(spark, d), references, "doc_id", ["ord"]).drop("doi")


_figures = "(CASE o WHEN 0 THEN 'Table S1 Summary' WHEN 1 THEN 'Figure 2. Pattern' WHEN 2 THEN 'Fig. 1: Map' ELSE 'fig 2 again' END)"


@query(f"""WITH {SENTENCES_SQL} SELECT doc_id, ord::int AS ord, place::int AS place, ref, figure::int AS figure FROM (
 SELECT doc_id, ord, 0 AS place, 'Fig. ' || (1 + ord % 4) AS ref, CASE ord % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 END AS figure FROM sentences
 UNION ALL SELECT doc_id, ord, 1, 'Table S' || (1 + doc_id % 3), CASE doc_id % 3 WHEN 0 THEN 0 END FROM sentences) WHERE figure IS NOT NULL""")
def figure_hints(spark, d):
    from quire.operators.links import figure_hints as link

    figures = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("o")).select("doc_id", F.col("o").alias("ord"), F.expr(_figures).alias("caption"))
    return link(mentioning(spark, d), figures, "doc_id", ["ord"])


_line = "(CASE p_size % 5 WHEN 0 THEN 'Fig. ' WHEN 1 THEN 'Figure ' WHEN 2 THEN 'Scheme ' WHEN 3 THEN 'Table S' ELSE 'Section ' END) || (p_partkey % 12) || (CASE WHEN p_partkey % 3 = 0 THEN '. ' WHEN p_partkey % 3 = 1 THEN ' ' ELSE ' shows ' END) || (CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END)"


@query(rf"""
WITH lines AS (SELECT p_partkey, p_size, {_line} AS line FROM part), parts AS (
  SELECT *, regexp_extract(line, '(?i)^((?:Fig(?:ure)?|Scheme|Table)\.?\s*S?\d+[a-z]?)(?:$|[\s.:;·–—\-])', 1) AS label FROM lines
), rest AS (
  SELECT *, regexp_replace(substr(line, length(label) + 1), '^[ \t.:;·–—\-]+', '') AS tail FROM parts
)
SELECT p_partkey, label <> '' AND (regexp_matches(line, '(?i)^((?:Fig(?:ure)?|Scheme|Table)\.?\s*S?\d+[a-z]?)\s*[.:;·–—\-]') OR tail = ''
  OR (NOT regexp_matches(tail, '(?i)^(illustrates?|shows?|presents?|demonstrates?|depicts?|indicates?|describes?|summarizes?|compares?|reports?|displays?|represents?|is\b|are\b|was\b|were\b|has\b|have\b|can\b|will\b|may\b|must\b)')
      AND (regexp_matches(tail, '^[\p{{Lu}}\p{{Nd}}(\[]') OR NOT regexp_matches(tail, '^[A-Za-z]')))) AS is_caption,
  CASE p_size % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS kind,
  CASE WHEN p_size % 5 = 4 THEN 1000000000 ELSE p_partkey % 12 END::bigint AS number
FROM rest""")
def caption_classify(spark, d):
    lines = table(spark, d, "part").select("p_partkey", F.expr(_line).alias("line"))
    order = refs.caption_order(F.col("line"))
    return lines.select("p_partkey", refs.is_caption(F.col("line")).alias("is_caption"), order["kind"].alias("kind"), order["number"].alias("number"))


_panels = "p_name || ' (' || chr(97 + p_size % 3) || '–' || chr(99 + p_size % 5) || ') (x) (' || chr(97 + p_size % 4) || ')'"


@query("""SELECT p_partkey, CASE WHEN p_size % 3 < 2 + p_size % 5 THEN list_transform(range(97 + p_size % 3, 100 + p_size % 5), lambda c: chr(c::int))
  ELSE list_distinct(['x', chr(97 + p_size % 4)]) END AS panels FROM part WHERE p_size % 3 < 2 + p_size % 5
 UNION ALL SELECT p_partkey, ['x', chr(97 + p_size % 4)] FROM part WHERE p_size % 3 >= 2 + p_size % 5""")
def panel_letters(spark, d):
    return table(spark, d, "part").select("p_partkey", refs.panel_letters(F.expr(_panels.replace("p_size % 3)", "CAST(p_size % 3 AS INT))"))).alias("panels"))


@query("""
WITH p AS (SELECT doc_id, unnest(range(0, greatest(ceil(length(coalesce(text, '')) / 400.0)::int, 1))) AS page, coalesce(text, '') AS text FROM documents),
 q AS (SELECT doc_id, length(regexp_replace(substr(text, page * 400 + 1, 400), '[^A-Za-z0-9]', '', 'g')) AS n FROM p),
 a AS (SELECT doc_id, count(*) AS pages, sum(n)::bigint AS alnum, count(*) FILTER (n < 15) AS thin FROM q GROUP BY doc_id)
SELECT doc_id, CASE WHEN alnum < 50 OR (pages >= 2 AND thin / pages >= 0.45) THEN 'full_vision' END AS verdict,
 CASE WHEN alnum < 50 THEN 'sparse_alnum:' || alnum WHEN pages >= 2 AND thin / pages >= 0.45 THEN 'empty_page_ratio:' || thin || '/' || pages END AS notes FROM a""")
def quality_gate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / 400.0).cast("int"), F.lit(1)) - 1)
    pages = docs.select("doc_id", F.explode(cuts).alias("page"), "text").select("doc_id", F.expr("substring(text, page * 400 + 1, 400)").alias("text"))
    return segment.quality_gate(pages, "doc_id")


_section = "(CASE (conv_id + turn) % 6 WHEN 0 THEN 'title' WHEN 1 THEN 'Results' WHEN 2 THEN 'intro' WHEN 3 THEN 'skip' WHEN 4 THEN 'methods' ELSE 'experiment' END)"
_assembled = f"""
WITH s AS (SELECT conv_id, turn, text, CASE (conv_id + turn) % 6 WHEN 0 THEN 'title' WHEN 1 THEN 'results' WHEN 2 THEN 'introduction' WHEN 3 THEN 'body' WHEN 4 THEN 'methods' ELSE 'experimental' END AS section FROM conversations),
 r AS (SELECT *, CASE section WHEN 'title' THEN 0 WHEN 'introduction' THEN 2 WHEN 'methods' THEN 3 WHEN 'experimental' THEN 3 WHEN 'results' THEN 4 ELSE 7 END AS rk, row_number() OVER (PARTITION BY conv_id, section ORDER BY turn) AS k FROM s),
 a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY rk, turn) - 1 AS ord FROM r WHERE section <> 'title' OR k = 1)"""


@query(_assembled + " SELECT conv_id, ord::int AS ord, format('sent_{:06d}', ord) AS sentence_id, text, section FROM a WHERE ord < 5000")
def section_assemble(spark, d):
    pieces = table(spark, d, "conversations").select("conv_id", "turn", "text", segment.section_name(F.expr(_section)).alias("section"))
    return segment.assemble(pieces, "conv_id", ["turn"])


@query(f"""WITH {SENTENCES_SQL}, r AS (SELECT doc_id, ord, text, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM sentences)
 SELECT doc_id, 'body' AS section, string_agg('- ' || text, chr(10) ORDER BY n) AS bullets FROM r WHERE n <= 40 GROUP BY doc_id""")
def digest_input(spark, d):
    return segment.digest_input(sentences(spark, d).withColumn("section", F.lit("body")), "doc_id", "section", "ord", "text")


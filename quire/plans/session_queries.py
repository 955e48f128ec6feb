"""Queries on display text, uploads, jobs, takes, revisions and voices."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import docx, sessions
from quire.plans.carriers import CITING, SENTENCES_SQL, citing, table
from quire.plans.catalog_queries import _view

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query(rf"""WITH {SENTENCES_SQL}, c AS (SELECT doc_id, ord, {CITING} AS text FROM sentences)
SELECT doc_id, ord::int AS ord, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<sup>\d+</sup>', '', 'g'), '\[\d+-\d+,\d+\]', '', 'g'), '\s+([.,;:!?)])', '\1', 'g'), '\s{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS shown FROM c""")
def display_sentences(spark, d):
    return citing(spark, d).select("doc_id", "ord", sessions.display_text(F.col("text")).alias("shown"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'https://doi.org/10.1000/x' || doc_id WHEN doc_id % 3 = 1 THEN 'https://doi.org/10.2000/y' ELSE 'https://scholar.google.com/scholar?q=Some+title+' || doc_id END AS url,
 CASE doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'lookup' ELSE 'search' END AS source FROM documents""")
def citation_targets(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.expr("CASE WHEN doc_id % 3 = 0 THEN 'Some title doi: 10.1000/x' || doc_id || '.' ELSE 'Some title ' || doc_id END").alias("t"), F.expr("CASE WHEN doc_id % 3 = 1 THEN '10.2000/y' END").alias("found"))
    got = sessions.resolve_citation(F.col("t"), F.col("found"))
    return docs.select("doc_id", got["url"].alias("url"), got["source"].alias("source"))


_parts = "SELECT l_orderkey AS upload_id, l_linenumber AS seq, (l_linenumber - 1 - CAST(l_quantity % 7 = 0 AS INT)) * 10 AS offset, CASE WHEN l_quantity % 5 = 0 THEN 0 WHEN l_quantity % 11 = 0 THEN 12 ELSE 10 END AS size, 25 AS total FROM {lineitem}"


@query("""
WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY seq, "offset", size) AS i FROM (SELECT DISTINCT * FROM (PARTS))),
w AS (
  SELECT upload_id, 0::bigint AS seq, 0::bigint AS off, 0 AS size, 0::bigint AS i, 0::bigint AS received, ''::varchar AS outcome FROM (SELECT DISTINCT upload_id FROM p)
  UNION ALL
  SELECT upload_id, seq, off, size, i, CASE WHEN outcome = 'ok' THEN received + size ELSE received END, outcome FROM (
    SELECT p.upload_id, p.seq::bigint AS seq, p."offset"::bigint AS off, p.size, p.i, w.received, CASE WHEN w.received >= 25 THEN 'upload_already_complete' WHEN p."offset" <> w.received THEN 'offset_mismatch' WHEN p.size <= 0 THEN 'empty_chunk' WHEN p.size > 10 THEN 'chunk_too_large'
      WHEN w.received + p.size > 25 THEN 'chunk_past_end' WHEN w.received + p.size < 25 AND p.size <> 10 THEN 'chunk_size_mismatch' ELSE 'ok' END AS outcome
    FROM w JOIN p ON p.upload_id = w.upload_id AND p.i = w.i + 1)
)
SELECT upload_id, outcome, count(*) AS n, max(received)::bigint AS received FROM w WHERE i > 0 GROUP BY ALL""".replace("PARTS", _parts.replace("{lineitem}", "lineitem").replace("AS offset", 'AS "offset"')))
def upload_chunks(spark, d):
    parts = _view(spark, d, _parts, "lineitem").groupBy("upload_id", "seq", "offset", "size", "total").count().select("upload_id", F.expr("seq * 1000000 + offset * 100 + size").alias("seq"), F.col("offset").cast("long").alias("offset"), F.col("size").cast("long").alias("size"), "total")
    done = sessions.append_chunks(parts, chunk=10)
    return done.groupBy("upload_id", "outcome").agg(F.count(F.lit(1)).alias("n"), F.max("received").alias("received"))


@query("""WITH p AS (SELECT user_id, event_id, sha256(string_agg(event_type, '') OVER (PARTITION BY user_id ORDER BY event_id)) AS prefix_sha256 FROM events) SELECT user_id, event_id, prefix_sha256 FROM p""")
def upload_prefixes(spark, d):
    return sessions.prefix_digests(table(spark, d, "events").select("user_id", "event_id", F.col("event_type").cast("binary").alias("data")), "user_id", "event_id")


_updates = "SELECT user_id AS job_id, event_id AS seq, CAST(event_id % 130 AS INT) - 10 AS percent, CASE event_id % 5 WHEN 4 THEN 'save' ELSE 'debone' END AS stage, CASE WHEN event_id % 17 = 0 THEN 'done' WHEN event_id % 13 = 0 THEN 'cancel' ELSE 'progress' END AS kind FROM {events}"


@query(f"""WITH u AS ({_updates.replace('{events}', 'events')}), d AS (SELECT *, coalesce(bool_or(kind = 'done') OVER b, false) AS done, coalesce(bool_or(kind = 'progress' AND stage = 'save') OVER b, false) AS late FROM u WINDOW b AS (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 s AS (SELECT *, coalesce(bool_or(kind = 'cancel' AND NOT late) OVER b, false) AS stopped FROM d WINDOW b AS (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 c AS (SELECT * FROM s WHERE NOT done AND NOT stopped)
 SELECT job_id, greatest(least(arg_max(percent, seq) FILTER (kind <> 'cancel'), 100), 0) AS percent, arg_max(stage, seq) FILTER (kind <> 'cancel') AS stage, max(seq) FILTER (kind <> 'cancel') AS seq, bool_or(kind = 'cancel' AND NOT late) AS cancelled FROM c GROUP BY job_id""".replace("greatest(least(arg_max(percent, seq) FILTER (kind <> 'cancel'), 100), 0)", "CASE WHEN max(seq) FILTER (kind <> 'cancel') IS NOT NULL THEN greatest(least(arg_max(percent, seq) FILTER (kind <> 'cancel'), 100), 0) END"))
def job_states(spark, d):
    return sessions.job_state(_view(spark, d, _updates, "events"))


_takes = "SELECT o_custkey AS sentence_id, 3 AS chunk_count, CAST(o_orderkey % 3 AS INT) AS chunk_index, o_orderkey AS seq, CASE WHEN o_orderstatus = 'P' THEN 'skipped' ELSE 'recorded' END AS status, CASE WHEN o_orderstatus <> 'P' THEN 'b' || o_orderkey END AS blob_key FROM {orders}"


@query(f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY sentence_id, chunk_index ORDER BY seq DESC) AS k FROM ({_takes.replace('{orders}', 'orders')})),
 f AS (SELECT sentence_id, count(*) = 3 AND bool_and(status = 'recorded') AS full_pass, list(blob_key ORDER BY chunk_index) AS blobs FROM t WHERE k = 1 GROUP BY sentence_id)
 SELECT c_custkey * 2 AS ord, sentence_id, blobs FROM f JOIN customer ON c_custkey = sentence_id WHERE full_pass""")
def listening(spark, d):
    takes = sessions.takes_of(_view(spark, d, _takes, "orders"))
    return sessions.listen_list(takes, table(spark, d, "customer").select(F.col("c_custkey").alias("sentence_id"), (F.col("c_custkey") * 2).alias("ord")))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN CASE WHEN x <= 0.8 THEN 'en-US' ELSE 'en-GB' END WHEN 1 THEN CASE WHEN x <= 0.4 THEN 'en-US' WHEN x <= 0.4::double + 0.3 THEN 'en-GB' ELSE 'en-AU' END ELSE 'en-US' END AS locale,
 CASE event_id % 3 WHEN 0 THEN CASE WHEN x <= 0.8 THEN 2 ELSE 1 END WHEN 1 THEN CASE WHEN x <= 0.4 THEN 2 WHEN x <= 0.4::double + 0.3 THEN 1 ELSE 2 END ELSE 2 END AS pool FROM (SELECT event_id, (event_id % 100) / 100.0::double AS x FROM events)""")
def voices(spark, d):
    mode = F.expr("CASE event_id % 3 WHEN 0 THEN 'random_normal' WHEN 1 THEN 'random_hard' ELSE 'fixed' END")
    locale = sessions.pick_locale(mode, (F.col("event_id") % 100) / F.lit(100.0))
    pool = sessions.voice_pool(F.array(*map(F.lit, ("en-US-A", "en-US-B", "en-GB-A"))), locale)
    return table(spark, d, "events").select("event_id", locale.alias("locale"), F.size(pool).alias("pool"))


@query("SELECT o_orderkey, floor(epoch(o_orderdate))::bigint - CASE WHEN o_orderkey % 3 = 2 THEN 7200 ELSE 0 END AS seconds FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 5 = 0")
def iso_times(spark, d):
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.expr("CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Z' ELSE '+02:00' END"))
    return table(spark, d, "orders").select("o_orderkey", sessions.iso_seconds(F.when(F.col("o_orderkey") % 5 == 0, "soon").otherwise(stamp)).alias("seconds"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'refresh' ELSE 'not_found' END WHEN c_nationkey > 0 THEN 'local' ELSE 'empty' END AS rule,
 CASE WHEN c_custkey % 4 = 0 THEN 'mode' WHEN c_custkey % 3 = 0 THEN 'empty' ELSE 'ok' END AS status, c_custkey % 5 <> 0 AS audio FROM customer""")
def open_and_call_rules(spark, d):
    c = table(spark, d, "customer")
    return c.select(
        "c_custkey",
        sessions.open_rule(F.expr("c_custkey % 2 = 0"), F.expr("c_custkey % 3 = 0"), F.col("c_nationkey")).alias("rule"),
        sessions.translation_status(F.expr("CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END"), F.expr("CASE WHEN c_custkey % 4 = 0 THEN 'odd' ELSE 'fast' END")).alias("status"),
        sessions.audio_allowed(F.expr("CASE WHEN c_custkey % 5 = 0 THEN 'video/mp4' ELSE ' Audio/WebM;codecs=opus' END")).alias("audio"),
    )


_blocks = """SELECT doc, pos, k, CASE WHEN k IN (5, 10) THEN 'table' ELSE 'text' END AS kind, CASE WHEN k IN (3, 7) THEN 'Fig. ' || (pos % 9) || '. ' || p WHEN k IN (6, 11) THEN 'Table ' || (pos % 9) || ' ' || p
 WHEN k IN (4, 8) THEN 'plain ' || p WHEN k IN (5, 10) THEN 'a | ' || p ELSE '' END AS text FROM (SELECT o_custkey AS doc, o_orderkey AS pos, o_orderpriority AS p, (o_orderkey * 7 + o_custkey) % 12 AS k FROM {orders})"""


@query(f"""
WITH RECURSIVE b AS (SELECT *, CASE WHEN k IN (0, 1, 3, 4, 11) THEN ['i' || pos] WHEN k = 2 THEN ['i' || pos, 'j' || pos] ELSE [] END AS imgs, row_number() OVER (PARTITION BY doc ORDER BY pos) AS i,
 text LIKE 'Fig%' AS fig, kind = 'text' AND text LIKE 'Table%' AS tab FROM ({_blocks.replace('{orders}', 'orders')})),
s AS (
  SELECT DISTINCT doc, 0::bigint AS i, []::varchar[] AS waiting, '' AS held, []::struct(kind varchar, image varchar, caption varchar, content varchar)[] AS done FROM b
  UNION ALL
  SELECT b.doc, b.i,
    CASE WHEN kind = 'table' OR (fig AND len(waiting) > 0) THEN [] WHEN len(imgs) > 0 AND NOT fig THEN list_concat(CASE WHEN text <> '' THEN [] ELSE waiting END, imgs) WHEN text <> '' THEN [] ELSE waiting END,
    CASE WHEN kind = 'table' THEN '' WHEN fig AND len(waiting) > 0 THEN held WHEN tab THEN text WHEN text <> '' AND len(imgs) = 0 THEN '' ELSE held END,
    CASE WHEN kind = 'table' AND held <> '' THEN list_append(done, {{'kind': 'table', 'image': NULL, 'caption': held, 'content': text}}) WHEN fig AND len(waiting) > 0 THEN list_concat(done, list_transform(waiting, lambda x: {{'kind': 'figure', 'image': x, 'caption': text, 'content': NULL}}))
         WHEN fig THEN list_concat(done, list_transform(imgs, lambda x: {{'kind': 'figure', 'image': x, 'caption': text, 'content': NULL}})) ELSE done END
  FROM s JOIN b ON b.doc = s.doc AND b.i = s.i + 1
), e AS (SELECT doc, arg_max(done, i) AS done FROM s GROUP BY doc)
SELECT doc, n::int AS n, done[n].kind AS kind, done[n].image AS image, done[n].caption AS caption, done[n].content AS content FROM (SELECT doc, done, unnest(range(1, len(done) + 1)) AS n FROM e) WHERE n <= 200""")
def docx_figures(spark, d):
    image = lambda x: F.concat(F.lit(x), F.col("pos").cast("string"))
    images = F.when(F.col("k").isin(0, 1, 3, 4, 11), F.array(image("i"))).when(F.col("k") == 2, F.array(image("i"), image("j")))
    return docx.docx_figures(_view(spark, d, _blocks, "orders").withColumn("images", images), "doc", "pos").drop("pos")

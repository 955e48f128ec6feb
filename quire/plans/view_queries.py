"""Queries on views, small stores, sentence places, composed caption rows, and operators without a family of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import refs, rich, text
from quire.operators import accounts, catalog, enrich, figures, jobs, layout, segment, sessions, views
from quire.plans.carriers import BLOCKS_SQL, blocks, table
from quire.plans.catalog_queries import _view

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT l_orderkey AS doc, 'sentence' AS kind, l_linenumber AS no, l_returnflag || l_linenumber AS text, '' AS image FROM lineitem WHERE l_returnflag <> 'R'
UNION ALL SELECT l_orderkey, 'figure', l_linenumber, 'Fig. ' || l_linenumber, coalesce(s_name, '') FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 2 = 0""")
def session_load(spark, d):
    items = table(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "doc", "l_linenumber": "no", "l_suppkey": "image_ref"})
    read = items.select("doc", "no", F.expr("CASE WHEN l_returnflag = 'R' THEN ' ' ELSE l_returnflag || no END").alias("text"))
    images = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("image_ref"), F.col("s_name").alias("image"))
    return views.session_rows(read, items.select("doc", "no", F.expr("'Fig. ' || no").alias("caption"), "image_ref"), images, "doc")


@query("SELECT p_partkey AS id, '' AS image, p_name AS caption, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS caption_ko FROM part")
def public_figures(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("image"), F.col("p_name").alias("caption"), F.expr("CASE WHEN p_size % 2 = 0 THEN p_type END").alias("caption_ko"))
    return views.public_figures(rows, include_images=False)


@query("""SELECT 'u' || o_orderkey AS upload_id, '' AS content_hash, o_orderpriority AS filename, o_orderkey AS size, 262144::bigint AS chunk_size, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE 0 END AS received_offset, '' AS prefix_sha256,
 coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 = 1 END, false) AS complete FROM orders""")
def public_uploads(spark, d):
    o = table(spark, d, "orders").select(F.expr("'u' || o_orderkey").alias("upload_id"), F.expr("cast(null as string)").alias("content_hash"), F.col("o_orderpriority").alias("filename"), F.col("o_orderkey").alias("size"), F.expr("cast(null as long)").alias("chunk_size"),
                                         F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END").alias("received_offset"), F.lit("").alias("prefix_sha256"), F.expr("CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 = 1 END").alias("complete"), F.col("o_custkey").alias("owner_uid"))
    return views.public_upload(o)


_status = "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'pending' WHEN 2 THEN 'allowed' WHEN 3 THEN 'byok' ELSE 'denied' END"


@query(f"""WITH c AS (SELECT c_custkey, coalesce({_status}, 'none') AS s, c_custkey % 7 <> 0 AS gate, c_custkey % 3 = 0 AS admin FROM customer)
SELECT c_custkey, CASE WHEN gate AND admin AND s = 'none' THEN 'allowed' ELSE s END AS status, CASE WHEN NOT gate THEN 'open' WHEN admin THEN 'admin' ELSE s END AS effective, NOT gate OR admin OR s IN ('allowed', 'byok') AS can_use_paid FROM c""")
def access_views(spark, d):
    c = table(spark, d, "customer")
    shown = views.public_access(F.expr(_status), F.col("c_custkey") % 7 != 0, F.col("c_custkey") % 3 == 0)
    return c.select("c_custkey", shown.alias("v")).select("c_custkey", "v.*")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'bad_uid' WHEN c_custkey % 4 = 3 THEN 'bad_decision' WHEN c_custkey % 5 = 0 THEN 'user_not_found' WHEN c_custkey % 4 = 0 THEN 'allowed' ELSE 'denied' END AS outcome FROM customer""")
def access_outcomes(spark, d):
    uid, word = F.expr("CASE WHEN c_custkey % 11 = 0 THEN 'a b' ELSE 'u:' || c_custkey END"), F.expr("element_at(array(' Approve', 'deny', 'REJECT ', 'maybe'), 1 + CAST(c_custkey % 4 AS INT))")
    return table(spark, d, "customer").select("c_custkey", views.decided(uid, word, F.col("c_custkey") % 5 != 0).alias("outcome"))


@query("SELECT c_custkey AS uid, CASE WHEN c_custkey % 2 = 0 THEN 'me@x.org' ELSE c_name END AS email, c_acctbal AS total FROM customer WHERE c_custkey IN (42, 43)")
def own_usage(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("uid"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END").alias("email"), F.col("c_acctbal").alias("total"))
    return views.own_usage(rows, "42", "me@x.org").unionByName(views.own_usage(rows, "43", "me@x.org"))


@query("""SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_id % 3 ELSE length(event_type) END::bigint AS model_in,
 CASE WHEN event_id % 3 = 1 AND event_id % 2 = 1 THEN 5 WHEN event_id % 3 = 2 THEN 7 ELSE length(coalesce(props, '')) END::bigint AS model_out FROM events""")
def model_usage(spark, d):
    e = table(spark, d, "events")
    out = F.expr("CASE WHEN event_id % 3 = 1 AND event_id % 2 = 1 THEN 5 WHEN event_id % 3 = 2 THEN 7 ELSE 0 END")
    used = views.model_usage(F.col("event_type"), F.col("props"), F.expr("event_id % 3"), out)
    return e.select("event_id", used["in"].alias("model_in"), used["out"].alias("model_out"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 8")
def session_registry(spark, d):
    return views.last_inserted(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], views.SESSIONS_KEPT)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
w AS (SELECT user_id, i, [event_id] AS held FROM e WHERE i = 1
 UNION ALL SELECT e.user_id, e.i, list_append(CASE WHEN len(held) >= 16 THEN held[9:] ELSE held END, e.event_id) FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT user_id, unnest(held) AS event_id FROM w QUALIFY w.i = max(w.i) OVER (PARTITION BY user_id)""")
def memo_entries(spark, d):
    return views.memo_left(table(spark, d, "events").select("user_id", "event_id"), "event_id", ["user_id"], 16)


@query("""WITH k AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events QUALIFY r <= 50),
b AS (SELECT *, sum(1 + length('{"user_id":' || user_id || ',"event_id":' || event_id || ',"event_type":"' || event_type || '"}')) OVER (PARTITION BY user_id) AS bytes, count(*) OVER (PARTITION BY user_id) AS n FROM k)
SELECT user_id, event_id, event_type FROM b WHERE bytes <= 2700 OR r <= ceil(n / 2)""")
def event_logs(spark, d):
    return views.event_log(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["event_id"], 50, 2700, ["user_id"])


@query("""WITH k AS (SELECT user_id AS uid, event_type AS action, max(event_id) AS pos FROM events WHERE event_type <> 'view' GROUP BY ALL), u AS (SELECT uid, max(pos) AS p FROM k GROUP BY uid),
 n AS (SELECT uid FROM u ORDER BY p DESC, uid LIMIT 20) SELECT uid, action, pos FROM k WHERE (SELECT count(*) FROM u) <= 40 OR uid IN (FROM n)""")
def stored_limits(spark, d):
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("uid"), F.col("event_type").alias("action")).agg(F.max("event_id").alias("pos"))
    return views.known_limits(rows, ["click", "error", "purchase", "signup"], 40, 20)


@query("SELECT user_id, coalesce(max(CASE WHEN event_type = 'click' THEN event_id END), 0) AS seen FROM events GROUP BY user_id")
def seen_marks(spark, d):
    return views.seen_mark(table(spark, d, "events").select("user_id", F.expr("CASE WHEN event_type = 'click' THEN event_id END").alias("ts")), ["user_id"])


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'old.pdf' WHEN p_size BETWEEN 1 AND 40 THEN CASE WHEN p_size % 3 = 0 THEN 'source.docx' ELSE 'source.pdf' END END AS source_file, p_size % 4 = 0 OR p_size BETWEEN 1 AND 40 AS has_source FROM part""")
def attached_sources(spark, d):
    p = table(spark, d, "part")
    entries = p.select(F.col("p_partkey").alias("id"), F.expr("CASE WHEN p_size % 4 = 0 THEN 'old.pdf' END").alias("source_file"))
    return views.attach_sources(entries, p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), F.expr("CASE WHEN p_size % 3 = 0 THEN 'DOCX' WHEN p_size % 3 = 1 THEN 'pdf' ELSE 'exe' END").alias("kind")), most=40)


@query("""SELECT p_partkey, '이어받을 지점 유지 · ' || CASE p_size % 4 WHEN 0 THEN '추출' WHEN 1 THEN '연습 구간' WHEN 2 THEN 'other' ELSE '처리' END || CASE WHEN p_size % 5 > 0 THEN ' ' || coalesce(CASE WHEN p_size % 2 = 0 THEN p_size END, 0) || '/' || (p_size % 5) ELSE '' END AS label,
 CASE p_size % 4 WHEN 0 THEN 5 WHEN 1 THEN 99 ELSE 1 END AS floor FROM part""")
def resume_labels(spark, d):
    stage = F.expr("element_at(array('extract', ' shadowing_chunks', 'other', ' '), 1 + p_size % 4)")
    return table(spark, d, "part").select("p_partkey", views.resume_label(stage, F.expr("CASE WHEN p_size % 2 = 0 THEN p_size END"), F.col("p_size") % 5).alias("label"), jobs.stage_floor(stage).alias("floor"))


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'no ' ELSE '%PDF' END || p_name AS content, length(p_name) + CASE WHEN p_size % 3 = 0 THEN 3 ELSE 4 END AS n FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'upload_incomplete' WHEN p_partkey % 5 = 0 THEN 'assemble_failed' WHEN p_partkey % 4 = 0 THEN 'content_hash_mismatch' WHEN NOT starts_with(content, '%PDF') THEN 'invalid_pdf' ELSE 'ok' END AS outcome FROM p""")
def upload_results(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr("CASE WHEN p_size % 3 = 0 THEN 'no ' ELSE '%PDF' END || p_name").alias("c"))
    size = F.length("c")
    content = F.when(F.col("p_partkey") % 5 == 0, F.lit(None)).otherwise(F.col("c")).cast("binary")
    want = F.when(F.col("p_partkey") % 4 == 0, F.lit("x")).otherwise(F.upper(F.sha2(F.col("c").cast("binary"), 256)))
    return p.select("p_partkey", views.upload_result(size, size - F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0), content, want).alias("outcome"))


@query(r"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))[:2000] AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN t = '' THEN 'empty_sentence' WHEN len(string_split(t, ' ')) <= 3 AND length(t) < 40 THEN 'ok' ELSE 'ask' END AS reason FROM t""")
def chunk_plans(spark, d):
    plan = views.single_chunk(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", plan["reason"].alias("reason"))


@query("""SELECT o_orderkey, 's' || o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS text, '' AS text_ko FROM orders WHERE o_orderkey % 3 > 0""")
def resume_payloads(spark, d):
    stored = F.expr("""concat('[{"id":" ', CASE WHEN o_orderkey % 3 > 0 THEN 's' || o_orderkey ELSE '' END, '"', CASE WHEN o_orderkey % 2 = 0 THEN ',"text":"' || o_orderpriority || '"' ELSE '' END, ',"start_char":3}]')""")
    return table(spark, d, "orders").select("o_orderkey", F.explode(views.resume_sentences(stored)).alias("s")).select("o_orderkey", "s.id", "s.text", "s.text_ko")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id + event_id % 7 > event_id + 3 THEN event_id + 93 ELSE event_id + event_id % 7 END AS lease_until,
 event_type <> 'purchase' AND (event_id % 4 = 0 OR event_id % 7 <= 3) AS reclaim FROM events""")
def lease_beats(spark, d):
    until, now = F.expr("CASE WHEN event_id % 4 > 0 THEN event_id + event_id % 7 END"), F.col("event_id") + 3
    e = table(spark, d, "events")
    return e.select("event_id", views.lease_after(until, now).alias("lease_until"), views.may_reclaim(F.col("event_type") == "purchase", F.lit(""), until, now).alias("reclaim"))


@query("SELECT l_orderkey, bool_or(l_returnflag <> 'R') AS usable FROM lineitem GROUP BY l_orderkey")
def usable_sessions(spark, d):
    return views.usable_session(table(spark, d, "lineitem").select("l_orderkey", F.expr("CASE WHEN l_returnflag = 'R' THEN ' ' ELSE 'x' END").alias("text")), "l_orderkey")


@query(r"""WITH r AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'staged' ELSE 'odd' END AS mode, trim(coalesce(text, '')) AS t FROM conversations), k AS (SELECT *, mode || ':' || sha256(t) AS key FROM r),
 c AS (SELECT key, min('a' || conv_id) AS answer FROM k WHERE conv_id % 2 = 0 GROUP BY key)
SELECT conv_id, turn, key, CASE WHEN mode = 'odd' THEN 'mode' WHEN t = '' THEN 'empty' WHEN length(t) > 4000 THEN 'too_long' WHEN answer IS NOT NULL THEN 'cached' ELSE 'ok' END AS status FROM k LEFT JOIN c USING (key)""")
def translation_cache(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.expr("CASE turn % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'staged' ELSE 'odd' END").alias("mode"), "text")
    none = spark.createDataFrame([], "key string, answer string")
    cache = views.cached_translations(rows, none).where("conv_id % 2 = 0").groupBy("key").agg(F.min(F.expr("'a' || conv_id")).alias("answer"))
    return views.cached_translations(rows, cache).select("conv_id", "turn", "key", "status")


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN 'body' ELSE 'results' END AS section, CASE WHEN l_returnflag = 'R' THEN '' ELSE 'd' || l_linenumber END AS digest FROM lineitem)
SELECT o_orderkey AS l_orderkey, o_orderpriority AS caption, digest FROM orders LEFT JOIN (SELECT l_orderkey, digest FROM g WHERE digest <> '' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY section <> 'body', l_linenumber) = 1) q ON q.l_orderkey = o_orderkey""")
def caption_digests(spark, d):
    g = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("ord"), F.expr("CASE WHEN l_linenumber = 2 THEN 'body' ELSE 'results' END").alias("section"), F.expr("CASE WHEN l_returnflag = 'R' THEN '' ELSE 'd' || l_linenumber END").alias("digest"))
    return views.caption_digest(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("caption")), g, "l_orderkey")


@query(r"""WITH m AS (
  SELECT doc_id, trim(coalesce(text, ''), ' ') AS t, regexp_replace(trim(coalesce(text, ''), ' '), '(?i)(^|[^\p{L}\p{N}_])(Fig|Figs|Eq|Eqs|Ref|Refs|Vol|No|Nos|Dr|Mr|Mrs|Ms|Prof|vs|cf|al|e\.g|i\.e|et al|approx|ca|ed|eds|pp)\.', '\1\2' || chr(57344), 'g') AS marked FROM documents
), p AS (
  SELECT doc_id, string_split(regexp_replace(marked, '([.!?])\s+([A-Z"''])', '\1' || chr(57345) || '\2', 'g'), chr(57345)) AS ps, list_transform(regexp_extract_all(marked, '[.!?](\s+)[A-Z"'']', 1), lambda g: length(g)) AS gaps FROM m
), q AS (
  SELECT doc_id, unnest(range(1, len(ps) + 1)) AS i, ps, gaps FROM p
), r AS (
  SELECT doc_id, i, replace(ps[i], chr(57344), '.') AS raw, list_sum(list_transform(ps[:i - 1], lambda x: length(x))) AS before, list_sum(gaps[:i - 1]) AS gap FROM q
), s AS (
  SELECT doc_id, i, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS text, coalesce(before, 0) + coalesce(gap, 0) + length(raw) - length(regexp_replace(raw, '^\s+', '')) AS start FROM r
)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::int AS ord, text, start::int AS start, (start + length(text))::int AS "end" FROM s WHERE text <> '' QUALIFY ord < 5000""")
def sentence_spans(spark, d):
    return segment.sentence_spans(table(spark, d, "documents"))


@query(r"""WITH t AS (SELECT page_id, coalesce(html, '') AS html FROM pages) SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'ordered' ELSE
 regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(html, '\n{2,}', chr(57344), 'g'), chr(10), ' '), chr(57344), chr(10) || chr(10)), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 'x^', '') END AS text FROM t""")
def page_texts(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), "-\n", "\n"), "\n{3,}", "\n\n").alias("text"))
    return segment.page_texts(pages.where("page_id % 2 = 0").select("page_id", F.lit("ordered").alias("text")), pages, ["page_id"])


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, '--- PAGE ' || l_linenumber || ' ---' || chr(10) || CASE WHEN l_returnflag = 'R' THEN '(empty)' ELSE l_returnflag || l_linestatus END AS b FROM lineitem)
SELECT l_orderkey, string_agg(b, chr(10) || chr(10) ORDER BY l_linenumber, b) AS sample FROM p GROUP BY l_orderkey""")
def page_samples(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("CASE WHEN l_returnflag = 'R' THEN ' ' ELSE l_returnflag || l_linestatus END").alias("text"))
    return segment.page_sample(rows, "l_orderkey", "l_linenumber")


@query("""SELECT p_partkey, 'Fig. ' || (p_size % 9) AS label, 'Fig. ' || (p_size % 9) || 'b — ' || p_name || ' one two' AS panel, CASE WHEN p_size % 2 = 0 THEN 'Fig.' ELSE 'Scheme S' || p_size END AS other FROM part""")
def panel_captions(spark, d):
    whole = F.expr("' Fig.  ' || (p_size % 9) || '. ' || p_name || ' (a-c) (a) one (b) two.'")
    label = refs.figure_label(whole)
    other = refs.figure_label(F.expr("CASE WHEN p_size % 2 = 0 THEN 'Table 1' ELSE ' Scheme   S' || p_size || 'b' END"))
    return table(spark, d, "part").select("p_partkey", label.alias("label"), refs.panel_caption(label, F.lit("B"), whole).alias("panel"), other.alias("other"))


_kinds = {"cache": ("A-_9", "A b"), "job": ("abcdef0123", "ABCDEF01"), "sentence": ("sent_000012", "sent_x"), "uid": ("a:b.c", "a..b"), "upload": ("upl_0a1b2c3d4e5f", "xyz")}


@query("SELECT p_partkey, " + ", ".join(f"p_size % 2 = 0 AS {k}_ok" for k in _kinds) + ", CASE WHEN p_size % 2 = 0 THEN 'A-_9' ELSE '' END AS safe FROM part")
def id_grammars(spark, d):
    pick = lambda a, b: F.when(F.col("p_size") % 2 == 0, a).otherwise(b)
    return table(spark, d, "part").select("p_partkey", *[accounts.valid_id(k, pick(*v)).alias(f"{k}_ok") for k, v in _kinds.items()], accounts.safe_cache_id(pick(*_kinds["cache"])).alias("safe"))


@query("""SELECT o_orderkey AS id, o_orderkey AS pos, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS created_at, o_orderstatus AS updated_at FROM orders ORDER BY coalesce(created_at, updated_at) DESC, pos DESC LIMIT 1000""")
def evicted_library(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("pos"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END").alias("created_at"), F.col("o_orderstatus").alias("updated_at"))
    return catalog.evict_oldest(o).withColumn("id", F.col("id").cast("long"))


@query("""WITH w AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE -s_suppkey END AS id, 't' || s_suppkey AS title_key, 'pdf' AS source FROM supplier WHERE s_suppkey % 3 = 0)
SELECT s_suppkey AS id, 't' || s_suppkey AS title_key, 'pdf' AS source FROM supplier WHERE s_suppkey IN (SELECT id FROM w) OR 't' || s_suppkey IN (SELECT title_key FROM w WHERE id < 0)""")
def deleted_entries(spark, d):
    have = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("'t' || s_suppkey").alias("title_key"), F.lit("pdf").alias("source"))
    return catalog.deleted_entries(have, have.where("id % 3 = 0").withColumn("id", F.expr("CASE WHEN id % 2 = 0 THEN id ELSE -id END")))


@query("""WITH l AS (SELECT s_suppkey AS id, s_suppkey AS pos FROM supplier WHERE s_suppkey % 4 > 0), n AS (SELECT s_suppkey AS id, -row_number() OVER (ORDER BY s_suppkey) AS pos FROM supplier WHERE s_suppkey % 5 = 0)
SELECT id, pos FROM n UNION ALL SELECT id, pos FROM l WHERE id % 5 > 0""")
def upsert_places(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("'t' || s_suppkey").alias("title_key"), F.lit("pdf").alias("source"), F.col("s_suppkey").alias("pos"))
    return catalog.upsert(rows.where("id % 4 > 0"), rows.where("id % 5 = 0"), "pos").select("id", "pos")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i, lag(l_returnflag, 1, 'N') OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS old FROM (SELECT l_orderkey, l_linenumber, l_partkey, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL))
SELECT l_orderkey, (2 + row_number() OVER (PARTITION BY l_orderkey ORDER BY i))::int AS rev, l_linenumber::bigint * 1000000 + l_partkey AS at, l_returnflag AS body FROM e WHERE l_returnflag <> old""")
def later_revisions(spark, d):
    # The order is by line, then part; with part keys of a million or more the number shown as `at` does not tell it.
    edits = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("at"), F.concat("l_returnflag", F.lit(" ")).alias("body")).groupBy("l_orderkey", "at").agg(F.max("body").alias("body"))
    last = edits.select("l_orderkey").distinct().select("l_orderkey", F.lit(2).alias("rev"), F.lit("N").alias("body"))
    return catalog.text_revisions(edits, ["l_orderkey"], "at", "body", last).withColumn("at", F.col("at.l_linenumber").cast("long") * 1000000 + F.col("at.l_partkey"))


_caps = "SELECT p_partkey AS page, n AS caption_no, 'table:' || (n % 3) AS caption_key, 10.0::double AS x0, 300.0 * n AS y0, 90.0::double AS x1, 300.0 * n + 10 AS y1 FROM part, (SELECT unnest([0, 1, 2, 3]) AS n)"


@query(f"""WITH c AS ({_caps}), t AS (SELECT * FROM c WHERE caption_no < 3 AND page % 4 <> caption_no)
SELECT c.page, c.caption_no, c.caption_key, t.caption_no AS image_no, 6.0::double AS clip_x0, CASE WHEN t.page IS NULL THEN greatest(0.0, c.y0 - 4) ELSE c.y0 END::double AS clip_y0, 120.0::double AS clip_x1, CASE WHEN t.page IS NULL THEN least(1300.0, c.y1 + 260) ELSE c.y1 + 60 END::double AS clip_y1
FROM c LEFT JOIN t ON c.page = t.page AND c.caption_no = t.caption_no WHERE c.caption_no < 3""")
def caption_tables(spark, d):
    numbers = table(spark, d, "part").select(F.col("p_partkey").alias("page"), F.explode(F.array(*map(F.lit, range(4)))).alias("caption_no"))
    caps = numbers.select("page", "caption_no", F.expr("'table:' || (caption_no % 3)").alias("caption_key"), F.lit(10.0).alias("x0"), F.expr("cast(300 * caption_no as double)").alias("y0"), F.lit(90.0).alias("x1"), F.expr("cast(300 * caption_no + 10 as double)").alias("y1"))
    tables = caps.where("caption_no < 3 and page % 4 <> caption_no").select("page", F.col("caption_no").alias("image_no"), "x0", (F.col("y0") + 20).alias("y0"), "x1", (F.col("y1") + 60).alias("y1"))
    pages = caps.select("page").distinct().select("page", F.lit(0.0).alias("px0"), F.lit(0.0).alias("py0"), F.lit(200.0).alias("px1"), F.lit(1300.0).alias("py1"))
    rows = figures.captioned_rows(caps, tables, pages, ["page"], tables=True)
    return rows.select("page", "caption_no", "caption_key", "image_no", *[F.col("clip")[b].alias("clip_" + b) for b in ("x0", "y0", "x1", "y1")])


# Operators that had no query of their own.


@query("SELECT p_partkey, regexp_replace(upper(p_name), '[^\\p{L}\\p{N}]', '', 'g') AS code, sha256(regexp_replace(upper(p_name), '[^\\p{L}\\p{N}]', '', 'g')) AS hash FROM part".replace("\\\\", "\\"))
def invite_hashes(spark, d):
    return table(spark, d, "part").select("p_partkey", text.invite_code(F.col("p_name")).alias("code"), text.invite_hash(F.col("p_name")).alias("hash"))


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, page, block_no FROM blocks WHERE length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) >= 2")
def usable_blocks(spark, d):
    return layout.usable_blocks(blocks(spark, d)).select("doc_id", "page", "block_no")


@query("SELECT l_orderkey, string_agg(CASE WHEN l_returnflag <> 'R' THEN l_returnflag END, chr(10) || chr(10) ORDER BY l_linenumber, l_returnflag) AS text FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_returnflag <> 'R')")
def joined_pages(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("CASE WHEN l_returnflag = 'R' THEN ' ' ELSE l_returnflag END").alias("text"))
    return layout.join_pages(rows, "l_orderkey", "l_linenumber").where("text <> ''")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 AND max(l_linestatus) OVER (PARTITION BY l_orderkey, l_linenumber) = 'O' THEN 'new' ELSE l_returnflag END AS text FROM lineitem")
def replaced_pages(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("text"), "l_linestatus")
    found = rows.where("l_linenumber = 2").select("l_orderkey", "l_linenumber", F.expr("CASE WHEN l_linestatus = 'O' THEN 'new' ELSE ' ' END").alias("text")).groupBy("l_orderkey", "l_linenumber").agg(F.max("text").alias("text"))
    return enrich.replace_pages(rows.drop("l_linestatus"), found, ["l_orderkey", "l_linenumber"])


@query("""WITH u AS (SELECT c_custkey % 100 AS uid, min(c_custkey) AS first FROM customer GROUP BY 1), l AS (SELECT s_suppkey % 40 AS provider_key, arg_min(s_nationkey * 5, s_suppkey) AS uid FROM supplier GROUP BY 1)
SELECT l.provider_key, l.uid, u.first FROM l JOIN u USING (uid)""")
def account_merge(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("replica"), (F.col("c_custkey") % 100).alias("uid"), F.col("c_custkey").alias("first"))
    people, links = accounts.merge_accounts(users, table(spark, d, "supplier").select(F.col("s_suppkey").alias("replica"), (F.col("s_suppkey") % 40).alias("provider_key"), (F.col("s_nationkey") * 5).cast("long").alias("uid")))
    return links.select("provider_key", "uid").join(people.select("uid", "first"), "uid")


@query("SELECT c_custkey AS uid, c_name AS email, c_nationkey AS invited_at FROM customer WHERE c_custkey % 3 = 0")
def pending_accounts(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("email"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'pending' ELSE 'allowed' END").alias("status"), F.col("c_nationkey").alias("invited_at"))
    return accounts.pending(rows).select("uid", "email", "invited_at")


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, l_returnflag AS body, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS k FROM lineitem)
SELECT l_orderkey, k::int AS rev, body FROM o""")
def voice_revisions(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_returnflag").alias("at"), F.col("l_returnflag").alias("body"))
    from pyspark.sql import Window

    placed = rows.withColumn("rev", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("at")))
    return sessions.append_voice(placed.where("rev <= 2").select("l_orderkey", "rev", "body"), placed.where("rev > 2").select("l_orderkey", "body", "at"), ["l_orderkey"], "at")


@query("SELECT o_custkey, o_orderpriority, list(o_orderkey ORDER BY o_orderkey)::varchar AS ids FROM orders GROUP BY ALL")
def section_ids(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("sentence_id"))
    return sessions.section_sentences(rows, "o_custkey", "o_orderpriority").withColumn("ids", F.concat(F.lit("["), F.array_join(F.transform("ids", lambda x: x.cast("string")), ", "), F.lit("]")))


@query("SELECT o_orderkey AS paper, 's' || o_custkey AS sid, 'text' AS kind, 1 AS rev, o_orderpriority AS body FROM orders WHERE o_orderstatus <> 'P'")
def migrated_notes(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("paper"), F.create_map(F.expr("'s' || o_custkey"), F.expr("CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE o_orderpriority END")).alias("texts"))
    return sessions.migrate_notes(rows)


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' THEN 'old' ELSE 'new' END AS checkpoint FROM orders""")
def stamped_checkpoints(spark, d):
    stage = F.expr("CASE WHEN o_orderpriority = '1-URGENT' THEN ' done' ELSE 'debone' END")
    return table(spark, d, "orders").select("o_orderkey", jobs.stamp(F.col("o_orderstatus") == "F", F.lit(None).cast("string"), stage, F.lit("new"), F.lit("old")).alias("checkpoint"))


@query("""SELECT p_partkey, CASE WHEN p_size <= 20 THEN '{"a":' || p_partkey || ',"b":"' || p_name || '"}' END AS stored FROM part""".replace("p_size <= 20", "length('{\"a\":' || p_partkey || ',\"b\":\"' || p_name || '\"}') <= 28"))
def capped_stores(spark, d):
    return table(spark, d, "part").select("p_partkey", sessions.within(F.struct(F.col("p_partkey").alias("a"), F.col("p_name").alias("b")), 28).alias("stored"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'x:' || p_name || '/' END AS kept FROM part")
def digest_maps(spark, d):
    entry = lambda en, ko: F.struct(en.alias("en"), ko.alias("ko"))
    none = F.lit(None).cast("string")
    raw = F.create_map(F.lit("x"), entry(F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" "))), none), F.lit("y"), entry(F.lit(" "), none))
    kept = F.transform(F.map_entries(sessions.digest_map(raw)), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["en"], F.lit("/"), e["value"]["ko"]))
    return table(spark, d, "part").select("p_partkey", F.get(kept, F.lit(0)).alias("kept"))


@query("SELECT user_id, list_sort(list_distinct(list(event_id % 50) FILTER (event_id % 50 >= 10)))[-5:]::varchar AS stamps FROM events GROUP BY user_id")
def merged_stamps(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.when(F.col("event_type") == "click", F.col("event_id") % 50)).alias("a"), F.collect_list(F.when(F.col("event_type") != "click", F.col("event_id") % 50)).alias("b"))
    merged = catalog.merge_stamps(F.col("a"), F.col("b"), F.lit(10), 5)
    return rows.select("user_id", F.concat(F.lit("["), F.array_join(F.transform(merged, lambda x: x.cast("string")), ", "), F.lit("]")).alias("stamps"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'a ' || p_name || ' b &amp; c' ELSE p_name END AS bare FROM part")
def rich_texts(spark, d):
    return table(spark, d, "part").select("p_partkey", rich.rich_plain(F.expr("CASE WHEN p_size % 3 = 0 THEN 'a <i>' || p_name || '</i> b &amp; c' ELSE p_name END")).alias("bare"))

"""Queries on replicas, catalogs, revisions, and page layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import digest, title_key
from quire.operators import catalog, layout
from quire.plans.carriers import BLOCKS_SQL, blocks, table

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_entry = "doc_id AS pos, 'p' || (doc_id % 80) AS id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'key ' || (doc_id % 40) END AS title_key, lang AS source"
_replicas = f"""
SELECT 0 AS replica, {_entry}, lpad(CAST(doc_id * 7 % 13 AS STRING), 4, '0') AS updated_at FROM documents
UNION ALL SELECT 1 AS replica, {_entry}, lpad(CAST(doc_id * 5 % 13 AS STRING), 4, '0') AS updated_at FROM documents"""


def _view(spark, d, sql: str, *names: str):
    """A query over input tables, without registering views by fixed names."""
    return spark.sql(sql, **{n: table(spark, d, n) for n in names})


@query(f"""
WITH e AS ({_replicas}), seen AS (SELECT *, min((replica * 1000000000 + pos)) OVER (PARTITION BY id) AS seen FROM e),
 one AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, replica DESC, pos DESC) AS k FROM seen),
 two AS (SELECT *, row_number() OVER (PARTITION BY title_key, source, CASE WHEN title_key = '' THEN id END ORDER BY updated_at DESC, seen DESC) AS j FROM one WHERE k = 1)
SELECT replica, pos, id, title_key, source, updated_at FROM two WHERE j = 1""")
def library_merge(spark, d):
    return catalog.merge_library(_view(spark, d, _replicas.replace("FROM documents", "FROM {documents}"), "documents"))


_invites = "SELECT r.replica, 'h' || (c_custkey % 60) AS hash, CASE (c_nationkey + r.replica) % 4 WHEN 0 THEN 'redeemed' WHEN 1 THEN 'revoked' WHEN 2 THEN 'expired' ELSE 'open' END AS status, c_custkey AS created_at, CASE WHEN c_nationkey % 2 = 0 THEN c_custkey + 5 END AS redeemed_at FROM {customer} CROSS JOIN (SELECT 0 AS replica UNION ALL SELECT 1) r"


@query(f"""SELECT replica, hash, status, created_at, redeemed_at FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY CASE status WHEN 'redeemed' THEN 4 WHEN 'revoked' THEN 3 WHEN 'expired' THEN 2 ELSE 1 END DESC,
 coalesce(redeemed_at, created_at) DESC, replica DESC) AS k FROM ({_invites.replace('{customer}', 'customer')})) WHERE k = 1""")
def invite_merge(spark, d):
    return catalog.merge_invites(_view(spark, d, _invites, "customer"))


@query("SELECT event_id, ts, event_type, user_id, props FROM events ORDER BY ts DESC LIMIT 500")
def event_merge(spark, d):
    one = table(spark, d, "events").select(F.col("event_id").alias("pos"), "ts", F.col("event_type").alias("type"), F.col("user_id").alias("uid"), F.col("props").alias("message"))
    both = one.withColumn("replica", F.lit(0)).unionByName(one.withColumn("replica", F.lit(1)))
    return catalog.merge_events(both).select(F.col("pos").alias("event_id"), "ts", F.col("type").alias("event_type"), F.col("uid").alias("user_id"), F.col("message").alias("props"))


_notes = """SELECT r.replica, event_id AS pos, user_id % 20 AS paper, event_type AS sid, CASE WHEN event_id % 2 = 0 THEN 'text' ELSE 'voice' END AS kind, event_id % 97 AS {at}, event_id % 5 AS rev,
 CASE WHEN event_id % 2 = 0 THEN 'b' || (event_id % 11) END AS body, CASE WHEN event_id % 2 = 1 THEN 'k' || (event_id % 11) END AS blob_key, CASE WHEN event_id % 2 = 1 THEN 'audio/mp4' END AS mime
 FROM {events} CROSS JOIN (SELECT 0 AS replica UNION ALL SELECT 1) r WHERE (event_id + r.replica) % 3 <> 0"""


@query(f"""WITH n AS ({_notes.replace('{events}', 'events').replace('{at}', '"at"')}), k AS (SELECT *, row_number() OVER (PARTITION BY paper, sid, kind, "at", body, blob_key, mime ORDER BY replica, pos) AS k FROM n)
 SELECT replica, pos, paper, sid, kind, "at", row_number() OVER (PARTITION BY paper, sid, kind ORDER BY "at", rev, replica, pos)::int AS rev, body, blob_key, mime FROM k WHERE k = 1""")
def notes_merge(spark, d):
    return catalog.merge_notes(_view(spark, d, _notes.replace("{at}", "at"), "events"))


@query("""WITH e AS (SELECT user_id, event_id, rtrim(CASE WHEN event_id % 3 = 0 THEN event_type || '  ' ELSE event_type END) AS body FROM events),
 c AS (SELECT *, lag(body) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM e)
 SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::int AS rev, event_id, body FROM c WHERE body IS DISTINCT FROM last""")
def text_revisions(spark, d):
    edits = table(spark, d, "events").select("user_id", "event_id", F.expr("CASE WHEN event_id % 3 = 0 THEN event_type || '  ' ELSE event_type END").alias("body"))
    return catalog.text_revisions(edits, ["user_id"], "event_id", "body")


@query("SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS body, max(o_orderkey) AS rev FROM orders GROUP BY o_custkey")
def latest_revision(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("rev"), F.col("o_orderpriority").alias("body"))
    return catalog.latest_revision(rows, ["o_custkey"], "body")


@query("SELECT sha256(coalesce(text, '')) AS sha, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def exact_copies(spark, d):
    return table(spark, d, "documents").groupBy(digest(F.coalesce("text", F.lit(""))).alias("sha")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))


_key_sql = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(trim({})), 'ß', 'ss'), '^title\s*:\s*', ''), '[^\p{{L}}\p{{N}}_\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""
WITH h AS (SELECT doc_id, lang AS source, {_key_sql.format("substr(coalesce(text, ''), 1, 14000)")} AS head FROM documents),
 c AS (SELECT doc_id AS pos, 'p' || doc_id AS id, lang AS source, {_key_sql.format("split_part(coalesce(text, ''), chr(10), 1)")} AS title_key FROM documents),
 m AS (SELECT h.doc_id, c.id, c.title_key, row_number() OVER (PARTITION BY h.doc_id ORDER BY length(c.title_key) DESC, c.pos) AS k
       FROM h JOIN c ON h.source = c.source AND length(c.title_key) >= 24 AND length(h.head) >= 24 AND contains(h.head, c.title_key))
SELECT doc_id, id, title_key FROM m WHERE k = 1""")
def title_match(spark, d):
    docs = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    heads = docs.select("doc_id", F.col("lang").alias("source"), title_key(F.substring("text", 1, catalog.HEAD_CHARS)).alias("head"))
    keys = docs.select(F.col("doc_id").alias("pos"), F.expr("'p' || doc_id").alias("id"), F.col("lang").alias("source"), title_key(F.split("text", "\n")[0]).alias("title_key"))
    return catalog.match_titles(heads, keys)


@query("""SELECT s_suppkey AS id, s_nationkey AS owner, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 2 = 0, CASE WHEN s_suppkey % 2 = 0 THEN -s_suppkey END, s_suppkey)::int AS place FROM supplier""")
def library_order(spark, d):
    papers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("owner"), F.col("s_suppkey").alias("server_pos"))
    order = papers.where("id % 2 = 0").select("owner", "id", (-F.col("id")).alias("pos"))
    return catalog.ordered_library(papers, order, "owner").select("id", "owner", "place")


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events) WHERE k <= 10")
def newest_events(spark, d):
    return catalog.newest(table(spark, d, "events").select("user_id", "event_id", "ts"), [F.desc("ts"), "event_id"], 10, ["user_id"])


@query("""SELECT 'p' || p_partkey AS id, p_name AS title_key, p_brand AS source, 1 AS version FROM part WHERE p_partkey % 10 <> 0 AND (p_name, p_brand) NOT IN (SELECT p_name, p_brand FROM part WHERE p_partkey % 10 = 0)
 UNION ALL SELECT 'p' || p_partkey, p_name, p_brand, 2 FROM part WHERE p_partkey % 10 = 0""")
def library_upsert(spark, d):
    parts = table(spark, d, "part").select(F.expr("'p' || p_partkey").alias("id"), F.col("p_name").alias("title_key"), F.col("p_brand").alias("source"), F.lit(1).alias("version"), "p_partkey")
    return catalog.upsert(parts.drop("p_partkey"), parts.where("p_partkey % 10 = 0").withColumn("version", F.lit(2)).drop("p_partkey"))


@query("SELECT l_orderkey, count(*) AS kept FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def delete_cascade(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return catalog.delete_cascade(table(spark, d, "lineitem"), gone, "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("kept"))


@query("SELECT c_custkey AS id, c_acctbal AS updated_at, c_acctbal + (c_custkey % 3) - 1 > c_acctbal AS stale FROM customer WHERE c_custkey % 4 <> 0")
def tenant_listing(spark, d):
    local = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("updated_at"))
    remote = local.where("id % 4 <> 0").select("id", F.expr("updated_at + (id % 3) - 1").alias("updated_at"))
    return catalog.tenant_listing(local, remote)


@query(rf"""
WITH {BLOCKS_SQL}, r AS (SELECT *, (x0 + x1) / 2 AS c, row_number() OVER (PARTITION BY doc_id, page ORDER BY (x0 + x1) / 2, block_no) AS k, count(*) OVER (PARTITION BY doc_id, page) AS n FROM blocks),
 s AS (SELECT *, c >= max(CASE WHEN k = n // 2 + 1 THEN c END) OVER (PARTITION BY doc_id, page) AS rt FROM r),
 p AS (SELECT doc_id, page, n >= 4 AND count(*) FILTER (rt) >= 2 AND count(*) FILTER (NOT rt) >= 2 AND avg(c) FILTER (rt) - avg(c) FILTER (NOT rt) >= 36 AS two,
   string_agg(text, chr(10) ORDER BY round(y0, 1), x0, block_no) FILTER (NOT rt) || chr(10) || chr(10) || string_agg(text, chr(10) ORDER BY round(y0, 1), x0, block_no) FILTER (rt) AS cols,
   string_agg(text, chr(10) ORDER BY y0, x0, block_no) AS flow FROM s GROUP BY doc_id, page, n),
 t AS (SELECT doc_id, page, coalesce(two, false) AS is_multicolumn, CASE WHEN two THEN cols ELSE flow END AS t FROM p)
SELECT doc_id, page, is_multicolumn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '([\p{{L}}\p{{N}}_])-\n([\p{{L}}\p{{N}}_])', '\1\2', 'g'), '(\n\n+)', chr(57344) || '\1' || chr(57344), 'g'),
       '(^|[^\n' || chr(57344) || '])\n($|[^\n' || chr(57344) || '])', '\1 \2', 'g'), '[ \t]+', ' ', 'g'), '^[\s' || chr(57344) || ']+|[\s' || chr(57344) || ']+$|' || chr(57344), '', 'g') AS text FROM t""")
def reading_order(spark, d):
    return layout.reading_order(blocks(spark, d), ["doc_id", "page"], once=True)


_words = "SELECT l_orderkey AS page, (l_linenumber * 40.0 + l_quantity) AS x0, (l_linenumber % 3) * 20.0 AS y0, (l_linenumber * 40.0 + l_quantity + 12 + round(l_discount * 100)) AS x1, (l_linenumber % 3) * 20.0 + 8 AS y1, l_returnflag || l_linenumber AS word FROM {lineitem}"


@query(f"""WITH w AS (SELECT *, round(y0 / 2)::bigint AS line FROM ({_words.replace('{lineitem}', 'lineitem')})),
 c AS (SELECT *, coalesce((x0 - lag(x1) OVER (PARTITION BY page, line ORDER BY x0, word, x1) > 14)::int, 0) AS cut FROM w),
 p AS (SELECT *, sum(cut) OVER (PARTITION BY page, line ORDER BY x0, word, x1 ROWS UNBOUNDED PRECEDING)::bigint AS part FROM c)
 SELECT page, line, part, min(x0) AS x0, min(y0)::double AS y0, max(x1) AS x1, max(y1)::double AS y1, string_agg(word, ' ' ORDER BY x0, word) AS text FROM p GROUP BY page, line, part""")
def caption_lines(spark, d):
    rows = _view(spark, d, _words, "lineitem")
    doubles = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    return layout.caption_lines(rows.select("page", *doubles, "word"), ["page"])


_found = "SELECT p_size AS doc, p_partkey % 9 AS page, p_retailprice AS y0, p_partkey * 1.0 AS x0, CASE p_partkey % 4 WHEN 0 THEN 'Fig. ' || (p_partkey % 7) || ' x' WHEN 1 THEN 'Table ' || (p_partkey % 5) WHEN 2 THEN 'Scheme S' || (p_partkey % 3) ELSE 'Plot of ' || p_name END AS caption FROM {part}"


@query(f"""WITH f AS ({_found.replace('{part}', 'part')}), k AS (SELECT doc, page, y0, x0, caption, p.kind AS kind, p.supp AS supp, p.num AS num, CASE WHEN p.kind = 3 THEN 'raw:' || lower(substr(caption, 1, 40)) ELSE (CASE p.kind WHEN 0 THEN 'fig:' WHEN 1 THEN 'scheme:s' ELSE 'table:' END) || p.num END AS key
  FROM (SELECT *, CASE WHEN caption LIKE 'Fig%' THEN {{'kind': 0, 'supp': 0, 'num': regexp_extract(caption, '([0-9]+)', 1)::bigint}} WHEN caption LIKE 'Scheme%' THEN {{'kind': 1, 'supp': 1, 'num': regexp_extract(caption, '([0-9]+)', 1)::bigint}}
    WHEN caption LIKE 'Table%' THEN {{'kind': 2, 'supp': 0, 'num': regexp_extract(caption, '([0-9]+)', 1)::bigint}} ELSE {{'kind': 3, 'supp': 0, 'num': 1000000000::bigint}} END AS p FROM f)),
 o AS (SELECT *, row_number() OVER (PARTITION BY doc, key ORDER BY kind, supp, num, page, y0, x0) AS n FROM k),
 q AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY kind, supp, num, page, y0, x0) - 1 AS ord FROM o WHERE n = 1)
 SELECT doc, ord::int AS ord, format('{{}}-{{:04d}}', CASE WHEN kind = 2 THEN 'tbl' ELSE 'fig' END, row_number() OVER (PARTITION BY doc, kind = 2 ORDER BY ord)) AS figure_id, caption FROM q WHERE ord < 200""")
def figure_assemble(spark, d):
    return layout.assemble_figures(_view(spark, d, _found, "part"), "doc")

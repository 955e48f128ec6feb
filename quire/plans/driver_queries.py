"""Queries on loops over outside answers: cleaning in rounds, chunk plans in slices, limits with their events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import accounts, chunk_plans, debone, figures, library, usage
from quire.plans.carriers import table
from quire.plans.catalog_queries import _view
from quire.sources.scratch import settled

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


#: Answers to a chunk by document, chunk and try: none, an error, no JSON, JSON cut off, and whole JSON. Some never come right.
_turn = "(doc * 7 + chunk * 3 + CASE WHEN try <= 2 + doc % 6 THEN 0 ELSE try END) % 8"
_name = "CASE (doc + chunk + try * 2) % 5 WHEN 0 THEN 'title' WHEN 1 THEN 'abstract' ELSE 'results' END"
_said = "'Say ' || doc || '.' || chunk || '.' || try || ' of H2O'"
_answer = f"""CASE h WHEN 2 THEN 'no records here' WHEN 4 THEN '{{"sentences": [{{"text": "' || {_said} || '", "section": "results"}}, {{"text": "lost' ELSE
 '{{"sentences": [{{"text": "' || {_said} || '", "section": "' || {_name} || '"}}, {{"text": "12, 3", "section": "body"}}]}}' END"""
_chunks = "SELECT o_custkey AS doc, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS chunk, o_orderpriority AS text FROM {orders}"
_raw = "SELECT c_custkey AS doc, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'Abstract of ' || c_name END AS text FROM {customer}"
_runs = f"""
c AS ({_chunks.replace('{orders}', 'orders')}), d AS ({_raw.replace('{customer}', 'customer')}), n AS (SELECT doc, count(*) AS n FROM c GROUP BY doc),
t AS (SELECT *, h >= 4 AS ok, CASE h WHEN 0 THEN 'timeout' WHEN 1 THEN 'timeout' WHEN 2 THEN 'bad_json' WHEN 3 THEN 'no_answer' END AS error FROM (SELECT *, {_turn} AS h FROM (SELECT doc, chunk, unnest(range(1, 10)) AS try FROM c))),
u AS (SELECT doc, chunk, min(try) FILTER (ok AND try <= 6) AS u FROM t GROUP BY ALL),
s1 AS (SELECT t.* FROM t JOIN u ON t.doc = u.doc AND t.chunk = u.chunk AND t.try = u.u),
lost AS (SELECT doc FROM d WHERE text LIKE 'Abstract%' AND doc IN (SELECT doc FROM s1) AND doc NOT IN (SELECT doc FROM s1 WHERE h > 4 AND {_name} <> 'results')),
f AS (SELECT u.doc, u.chunk, coalesce(u, 6) AS used, min(try) FILTER (ok AND try > coalesce(u, 6) AND try <= coalesce(u, 6) + 3) AS v FROM u JOIN lost USING (doc) JOIN n USING (doc) JOIN t ON t.doc = u.doc AND t.chunk = u.chunk
      WHERE u.chunk < greatest(1, (n + 1) // 2) GROUP BY ALL),
last AS (SELECT u.doc, u.chunk, coalesce(v, u) AS try FROM u LEFT JOIN f USING (doc, chunk)),
s AS (SELECT t.doc, t.chunk, {_said} AS text, CASE WHEN h = 4 THEN 'results' ELSE {_name} END AS section FROM t JOIN last USING (doc, chunk, try)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc, section ORDER BY chunk) AS nth FROM s),
p AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY CASE section WHEN 'title' THEN 0 WHEN 'abstract' THEN 1 ELSE 4 END, chunk) - 1 AS ord, CASE WHEN doc % 4 = 0 THEN replace(text, 'H2O', 'H<sub>2</sub>O') ELSE text END AS text, section FROM k WHERE section <> 'title' OR nth = 1)"""


def _debone(spark, d):
    chunks, docs = _view(spark, d, _chunks, "orders"), _view(spark, d, _raw, "customer")

    def ask(pending):
        turns = pending.withColumn("h", F.expr(_turn)).where("h <> 3")
        return turns.select("doc", "chunk", "try", F.when(F.col("h") > 1, F.expr(_answer)).alias("answer"), F.when(F.col("h") < 2, "timeout").alias("error"))

    formulas = docs.where("doc % 4 = 0").select("doc", F.array(F.struct(F.lit("H2O").alias("raw"), F.lit("H<sub>2</sub>O").alias("rich"))).alias("formulas"))
    return debone.debone(docs, chunks, ask, formulas)


@query(f"WITH {_runs} SELECT doc, ord::int AS ord, 'sent_' || lpad(ord::varchar, 6, '0') AS sentence_id, text, section FROM p")
def debone_sentences(spark, d):
    return _debone(spark, d)[0]


@query(f"""WITH {_runs},
e AS (SELECT t.doc, t.chunk, 1 AS pass, error FROM t JOIN u USING (doc, chunk) WHERE try = 3 AND (u IS NULL OR u > 3) UNION ALL SELECT t.doc, t.chunk, 2, error FROM t JOIN u USING (doc, chunk) WHERE try = 6 AND u IS NULL
      UNION ALL SELECT t.doc, t.chunk, 3, error FROM t JOIN f USING (doc, chunk) WHERE try = used + 3 AND v IS NULL),
w AS (SELECT doc, arg_max(error, pass * 1000 + chunk) AS error FROM e GROUP BY doc), g AS (SELECT u.doc, count(*) FILTER (u IS NULL) AS failed FROM u GROUP BY doc), q AS (SELECT doc, count(try) AS good FROM last GROUP BY doc),
m AS (SELECT doc, text LIKE 'Abstract%' AND doc NOT IN (SELECT doc FROM p WHERE section <> 'results') AS missing, doc IN (SELECT doc FROM p) AS ok FROM d)
SELECT doc, ok, CASE WHEN n IS NULL THEN 'empty_text' WHEN NOT ok THEN coalesce(error, 'no_sentences') ELSE nullif(concat_ws(';', CASE WHEN failed > 0 OR good < n THEN 'partial_debone:' || good || '/' || n || coalesce(':' || error, '') END, CASE WHEN missing THEN 'missing_front_matter' END), '') END AS warning,
 coalesce(good, 0) AS chunks_ok, coalesce(n, 0) AS chunks_total FROM m LEFT JOIN n USING (doc) LEFT JOIN g USING (doc) LEFT JOIN q USING (doc) LEFT JOIN w USING (doc)""")
def debone_outcomes(spark, d):
    return _debone(spark, d)[1]


_units = "SELECT o_custkey AS doc, o_orderkey AS ord, 's' || o_orderkey AS sentence_id, CASE o_orderkey % 5 WHEN 0 THEN 'short <b>one</b>' WHEN 1 THEN ' ' ELSE 'the order ' || o_orderpriority || ' was placed today' END AS text FROM {orders}"
_seconds = 6
_step = """
SELECT {s}.doc, u.i, CASE WHEN stop OR spent >= 6 THEN spent ELSE spent + seconds END AS spent, stop OR spent >= 6 OR u.reason <> 'ok' AS stop, CASE WHEN NOT stop AND spent < 6 AND u.reason <> 'ok' THEN u.reason END AS reason,
 CASE WHEN NOT stop AND spent < 6 AND u.reason = 'ok' THEN u.ord END AS built FROM {s} JOIN {u} u ON u.doc = {s}.doc AND u.i = {s}.i + 1"""


@query(f"""
WITH RECURSIVE v AS (SELECT doc, ord, CASE WHEN ord % 5 = 0 THEN 'ok' WHEN ord % 31 = 0 THEN 'model_unavailable' WHEN ord % 31 < 3 THEN 'bad_chunk_plan' ELSE 'ok' END AS reason, CASE WHEN ord % 5 = 0 THEN 0 ELSE 1 + ord % 3 END AS seconds
  FROM ({_units.replace('{orders}', 'orders')}) WHERE text <> ' '),
u1 AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ord) AS i FROM v),
a(doc, i, spent, stop, reason, built) AS (SELECT DISTINCT doc, 0::bigint, 0::bigint, false, NULL::varchar, NULL::bigint FROM u1 UNION ALL {_step.format(s='a', u='u1')}),
u2 AS (SELECT doc, ord, reason, seconds, row_number() OVER (PARTITION BY doc ORDER BY ord) AS i FROM v ANTI JOIN (SELECT built AS ord FROM a) USING (ord)),
b(doc, i, spent, stop, reason, built) AS (SELECT DISTINCT doc, 0::bigint, 0::bigint, false, NULL::varchar, NULL::bigint FROM u2 UNION ALL {_step.format(s='b', u='u2')}),
w AS (SELECT doc, count(*) AS work FROM v GROUP BY doc), x AS (SELECT doc, count(built) AS n, max(reason) AS reason FROM a GROUP BY doc), y AS (SELECT doc, count(built) AS n, max(reason) AS reason FROM b GROUP BY doc),
r AS (SELECT doc, 1 AS slice, coalesce(x.n, 0) AS done, coalesce(x.n, 0) AS new, x.reason, coalesce(work, 0) AS work FROM (SELECT DISTINCT o_custkey AS doc FROM orders) LEFT JOIN w USING (doc) LEFT JOIN x USING (doc)
 UNION ALL SELECT doc, 2, coalesce(x.n, 0) + coalesce(y.n, 0), coalesce(y.n, 0), y.reason, coalesce(work, 0) FROM (SELECT DISTINCT o_custkey AS doc FROM orders) LEFT JOIN w USING (doc) LEFT JOIN x USING (doc) LEFT JOIN y USING (doc))
SELECT doc, slice, CASE WHEN reason IS NOT NULL OR work = 0 THEN 'error' WHEN done >= work THEN 'ok' ELSE 'pending' END AS status, CASE WHEN reason IS NOT NULL THEN reason WHEN work = 0 THEN 'no_sentences' END AS error,
 done, greatest(work, done) AS total, (new + 4) // 5 AS flushes FROM r""")
def plan_slices(spark, d):
    """Two slices of every plan, the second from what the first stored."""
    rows = _view(spark, d, _units, "orders")
    answers = rows.select("doc", "sentence_id", F.expr("CASE ord % 31 WHEN 1 THEN 'not json' WHEN 2 THEN '[1, \"a\"]' ELSE '```json\n[\"the order\", \"' || text || '\"]\n```' END").alias("answer"), F.expr("CASE WHEN ord % 31 = 0 THEN 'timeout' END").alias("error"), F.expr("CAST(1 + ord % 3 AS DOUBLE)").alias("seconds"))
    units, docs = settled(chunk_plans.planned(rows, answers), "units"), rows.select("doc").distinct()
    stored = units.where("false").select("doc", "sentence_id", "text", "chunks")
    out = None
    for number in (1, 2):
        new, states = chunk_plans.plan_slice(units, stored, docs, _seconds)
        new = settled(new, "plan")
        flushes = new.groupBy("doc").agg((F.max("flush") + 1).alias("flushes"))
        part = states.join(flushes, "doc", "left").fillna(0, ["flushes"]).select("doc", F.lit(number).alias("slice"), "status", "error", "done", "total", "flushes")
        out = part if out is None else out.unionByName(part)
        stored = stored.unionByName(new.drop("flush"))
    return out


#: Small limits, so that the test tables reach them.
_limits = {"redeem": (3, 86_400, True), "link": (2, 43_200, False), "ingest": (5, 86_400, True)}
_calls = "SELECT CASE WHEN event_id % 9 = 0 THEN ' ' ELSE CAST(user_id AS STRING) END AS uid, CASE event_id % 4 WHEN 0 THEN 'redeem' WHEN 1 THEN 'link' WHEN 2 THEN 'ingest' ELSE 'other' END AS action, unix_timestamp(ts) AS at, event_id AS tie FROM {events}"
_inside = "list_filter(w.log, lambda x: CASE c.action WHEN 'link' THEN c.\"at\" - x < 43200 ELSE c.\"at\" - x <= 86400 END)"
_refused = f"len({_inside}) >= CASE c.action WHEN 'redeem' THEN 3 WHEN 'link' THEN 2 ELSE 5 END"


@query(f"""
WITH RECURSIVE k AS (SELECT trim(uid) AS uid, action, "at", tie FROM ({_calls.replace('{events}', 'events').replace('unix_timestamp(ts)', 'floor(epoch(ts))::bigint').replace('STRING', 'VARCHAR').replace('AS at', 'AS "at"')})),
c AS (SELECT *, row_number() OVER (PARTITION BY uid, action ORDER BY "at", tie) AS i FROM k WHERE uid <> '' AND action <> 'other'),
w AS (
  SELECT uid, action, "at", tie, i, 'ok' AS code, NULL::int AS attempts, ["at"] AS log FROM c WHERE i = 1
  UNION ALL
  SELECT c.uid, c.action, c."at", c.tie, c.i, CASE WHEN {_refused} THEN 'rate_limited' ELSE 'ok' END, CASE WHEN {_refused} THEN len({_inside})::int END, CASE WHEN {_refused} THEN {_inside} ELSE list_append({_inside}, c."at") END
  FROM w JOIN c ON c.uid = w.uid AND c.action = w.action AND c.i = w.i + 1
)
SELECT 'decision' AS what, uid, action, "at", tie, code, NULL::int AS attempts, NULL::int AS seconds FROM w
UNION ALL SELECT 'event', uid, action, "at", tie, action || '_rate_limited', attempts, CASE action WHEN 'link' THEN 43200 ELSE 86400 END FROM w WHERE code = 'rate_limited'
UNION ALL SELECT 'decision', uid, action, "at", tie, CASE WHEN uid = '' THEN 'auth_required' ELSE 'rate_limited' END, NULL, NULL FROM k WHERE uid = '' OR action = 'other'""")
def limits_with_events(spark, d):
    return usage.limited(_view(spark, d, _calls, "events"), _limits)


#: Four images and four figure captions a page, near enough to compete; some images overlap; one table and its caption.
_pics = "SELECT p_partkey AS page, k AS image_no, CAST(20 AS DOUBLE) AS x0, CAST(100 * k + (p_partkey * (k + 1)) % 37 AS DOUBLE) AS y0, CAST(180 AS DOUBLE) AS x1, CAST(100 * k + (p_partkey * (k + 1)) % 37 + 90 + (p_partkey * k) % 5 * 8 AS DOUBLE) AS y1 FROM {part}"
_heads = """SELECT p_partkey AS page, k AS caption_no, CASE WHEN k = 4 THEN 'table' ELSE 'figure' END AS kind, CASE WHEN k = 4 THEN 'table:1' ELSE 'fig:' || (k * (1 + p_partkey % 2) % 4) END AS caption_key, CAST(30 AS DOUBLE) AS x0, CAST(170 AS DOUBLE) AS x1,
 CAST(CASE WHEN k = 4 THEN 600 ELSE 100 * k + 60 + (p_partkey * (k + 2)) % 53 END AS DOUBLE) AS y0, CAST(CASE WHEN k = 4 THEN 610 ELSE 100 * k + 70 + (p_partkey * (k + 2)) % 53 END AS DOUBLE) AS y1 FROM {part}"""
_four = "part, (SELECT unnest([0, 1, 2, 3]) AS k)"


@query(f"""
WITH RECURSIVE i AS ({_pics.replace('{part}', _four)}), h AS ({_heads.replace('{part}', 'part, (SELECT unnest([0, 1, 2, 3, 4]) AS k)')}),
c AS (SELECT * FROM h WHERE kind = 'figure' QUALIFY row_number() OVER (PARTITION BY page, caption_key ORDER BY caption_no) = 1),
m AS (SELECT c.page, c.caption_no, i.image_no, i.y0, i.y1, CASE WHEN c.y0 - i.y1 BETWEEN 0 AND 150 THEN 0 WHEN i.y0 - c.y1 BETWEEN 0 AND 120 THEN 1 END AS mode, CASE WHEN c.y0 - i.y1 BETWEEN 0 AND 150 THEN c.y0 - i.y1 ELSE i.y0 - c.y1 END AS gap FROM c JOIN i USING (page)
 UNION ALL SELECT page, 99, image_no, y0, y1, 2, 0 FROM i WHERE (page + image_no) % 3 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY caption_no, mode, gap, 160 * (y1 - y0) DESC, image_no) AS k FROM m WHERE mode IS NOT NULL),
w AS (
  SELECT DISTINCT page, 0::bigint AS k, -1 AS caption_no, -1 AS image_no, false AS took, -1 AS served, []::struct(a double, b double)[] AS used FROM o
  UNION ALL
  SELECT page, k, caption_no, image_no, took, CASE WHEN took THEN caption_no ELSE served END, CASE WHEN took THEN list_append(used, {{'a': y0, 'b': y1}}) ELSE used END FROM (
    SELECT o.*, w.served, w.used, (o.caption_no = 99 OR o.caption_no <> w.served) AND len(list_filter(w.used, lambda u: least(u.b, o.y1) - greatest(u.a, o.y0) > 0.55 * least(u.b - u.a, o.y1 - o.y0))) = 0 AS took FROM w JOIN o ON o.page = w.page AND o.k = w.k + 1)
), t AS (SELECT page, caption_no, image_no FROM w WHERE took),
r AS (
  SELECT c.page, 'figure' AS kind, c.caption_no, c.caption_key, t.image_no, CASE WHEN t.page IS NULL THEN least(6.0, c.x0) ELSE 6.0 END AS x0, CASE WHEN t.page IS NULL THEN greatest(0, c.y0 - 280) ELSE least(c.y0, i.y0) END AS y0, CASE WHEN t.page IS NULL THEN greatest(c.x1, 116.0) ELSE 180.0 END AS x1,
    CASE WHEN t.page IS NULL THEN least(700, c.y1 + 4) ELSE greatest(c.y1, i.y1) END AS y1, least(c.y0, coalesce(i.y0, c.y0)) AS y, least(c.x0, coalesce(i.x0, c.x0)) AS x
  FROM c LEFT JOIN t ON t.page = c.page AND t.caption_no = c.caption_no LEFT JOIN i ON i.page = t.page AND i.image_no = t.image_no
  UNION ALL SELECT i.page, 'abstract', NULL, 'abstract', i.image_no, i.x0, i.y0, i.x1, least(700, i.y1 + 150), i.y0, i.x0 FROM t JOIN i ON i.page = t.page AND i.image_no = t.image_no WHERE t.caption_no = 99
  UNION ALL SELECT page, 'table', caption_no, caption_key, CASE WHEN page % 2 = 0 THEN 0 END, 6.0, CASE WHEN page % 2 = 0 THEN 600 ELSE 596 END, CASE WHEN page % 2 = 0 THEN 190.0 ELSE 170.0 END, CASE WHEN page % 2 = 0 THEN 690 ELSE 700 END, 600, CASE WHEN page % 2 = 0 THEN 10.0 ELSE 30.0 END FROM h WHERE kind = 'table'
)
SELECT page, (row_number() OVER (PARTITION BY page ORDER BY y, x, kind, caption_no NULLS FIRST, image_no NULLS FIRST))::int AS n, kind, caption_no, caption_key, image_no, x0::double AS clip_x0, y0::double AS clip_y0, x1::double AS clip_x1, y1::double AS clip_y1 FROM r""")
def figure_rows(spark, d):
    pages = table(spark, d, "part").select(F.col("p_partkey").alias("page"), *[F.lit(float(v)).alias("p" + b) for b, v in (("x0", 0), ("y0", 0), ("x1", 200), ("y1", 700))])
    numbers = lambda n: F.explode(F.array(*map(F.lit, range(n)))).alias("k")
    table(spark, d, "part").select("p_partkey", numbers(4)).createOrReplaceTempView("part_four")
    table(spark, d, "part").select("p_partkey", numbers(5)).createOrReplaceTempView("part_five")
    images, captions = spark.sql(_pics.replace("{part}", "part_four")), spark.sql(_heads.replace("{part}", "part_five"))
    tables = pages.where("page % 2 = 0").select("page", F.lit(0).alias("image_no"), F.lit(10.0).alias("x0"), F.lit(620.0).alias("y0"), F.lit(190.0).alias("x1"), F.lit(690.0).alias("y1"))
    rows = figures.figure_rows(captions, images, tables, images.where("(page + image_no) % 3 = 0"), pages, ["page"])
    return rows.select("page", "n", "kind", "caption_no", "caption_key", "image_no", *[F.col("clip")[b].alias("clip_" + b) for b in ("x0", "y0", "x1", "y1")])


_commands = """SELECT event_id AS seq, CASE CAST(floor(event_id / 7) AS INT) % 4 WHEN 2 THEN 'link' WHEN 3 THEN 'unlink' ELSE 'resolve' END AS op, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'g' || (user_id % 20) || 'u' || (event_id % 5) END AS uid,
 CASE event_id % 4 WHEN 0 THEN 'google' WHEN 1 THEN 'kakao' WHEN 2 THEN 'Email' ELSE CASE WHEN event_id % 3 = 0 THEN 'other' ELSE 'kakao' END END AS provider, 'G' || (user_id % 20) || 's' || (CAST(floor(event_id / 3) AS INT) % 6) AS subject, 'f' || event_id AS fresh FROM {events}"""


@query(f"""
WITH RECURSIVE k AS (SELECT seq, op, uid, lower(provider) AS p, CASE WHEN provider = 'Email' THEN lower(subject) ELSE subject END AS s, fresh, lower(split_part(subject, 's', 1)) AS g FROM ({_commands.replace('{events}', 'events')})),
c AS (SELECT *, p || ':' || s AS k, row_number() OVER (PARTITION BY g ORDER BY seq) AS i FROM k),
w AS (
  SELECT DISTINCT g, 0::bigint AS i, 0::bigint AS seq, '' AS code, ''::varchar AS account, []::struct(u varchar, p varchar, s varchar)[] AS users, []::struct(k varchar, u varchar)[] AS owners FROM c
  UNION ALL
  SELECT g, i, seq, code, account,
    CASE WHEN code = 'created' OR (code = 'ok' AND op = 'link') THEN list_append(list_filter(users, lambda x: x.u <> account OR x.p <> p), {{'u': account, 'p': p, 's': s}}) WHEN code = 'ok' AND op = 'unlink' THEN list_filter(users, lambda x: x.u <> uid OR x.p <> p) ELSE users END,
    CASE WHEN code = 'created' OR (code = 'ok' AND op = 'link') THEN list_append(list_filter(owners, lambda x: x.k <> k), {{'k': k, 'u': account}}) WHEN code = 'ok' AND op = 'unlink' THEN list_filter(owners, lambda x: x.k <> p || ':' || had OR x.u <> uid) ELSE owners END
  FROM (SELECT *, CASE WHEN bad THEN 'invalid' WHEN op = 'resolve' THEN CASE WHEN owner IS NOT NULL THEN 'ok' ELSE 'created' END WHEN NOT here THEN 'user_missing' WHEN op = 'link' THEN CASE WHEN coalesce(owner, uid) <> uid THEN 'conflict' ELSE 'ok' END
      WHEN had IS NULL THEN 'not_linked' WHEN ways <= 1 THEN 'last_provider' ELSE 'ok' END AS code,
      CASE WHEN bad THEN NULL WHEN op = 'resolve' THEN CASE WHEN owner IS NOT NULL THEN owner WHEN len(list_filter(users, lambda x: x.u = wanted)) > 0 THEN fresh ELSE wanted END WHEN NOT here THEN NULL WHEN op = 'link' THEN CASE WHEN coalesce(owner, uid) = uid THEN uid END
      WHEN had IS NOT NULL AND ways > 1 THEN uid END AS account FROM (
    SELECT c.*, w.users, w.owners, c.p = 'other' OR (op <> 'resolve' AND uid = '') AS bad, CASE WHEN uid <> '' THEN uid WHEN c.p = 'google' THEN c.s ELSE fresh END AS wanted, list_filter(w.owners, lambda x: x.k = c.k)[1].u AS owner,
      len(list_filter(w.users, lambda x: x.u = c.uid)) > 0 AS here, len(list_filter(w.users, lambda x: x.u = c.uid)) AS ways, list_filter(w.users, lambda x: x.u = c.uid AND x.p = c.p)[1].s AS had
    FROM w JOIN c ON c.g = w.g AND c.i = w.i + 1))
)
SELECT seq, code, account FROM w WHERE i > 0""")
def linked_accounts(spark, d):
    """Accounts of twenty groups that the operator has to find by itself."""
    return accounts.linked_accounts(_view(spark, d, _commands, "events"))


_tokens = "SELECT c_custkey AS n, CASE WHEN c_custkey % 5 = 0 THEN 'no address' ELSE lower(c_name) || '@x.org' END AS address, 100 + c_custkey % 50 AS exp, c_custkey % 7 = 0 AS used FROM {customer}"
_tries = "SELECT o_orderkey AS tie, o_orderkey % 160 AS at, CASE o_orderkey % 11 WHEN 0 THEN '  ' WHEN 1 THEN 'unknown' WHEN 2 THEN repeat('x', 201) ELSE 'tok-' || o_custkey END AS token FROM {orders}"


@query(f"""
WITH t AS ({_tokens.replace('{customer}', 'customer').replace("lower(c_name) || '@x.org'", "replace(lower(c_name), '#', '.') || '@x.org'")}), a AS ({_tries.replace('{orders}', 'orders').replace('AS at', 'AS "at"')}),
j AS (SELECT a.*, t.n, t.address, t.exp, t.used, NOT t.used AND (t.exp < a."at" OR t.n % 5 <> 0) AS spends FROM a LEFT JOIN t ON a.token = 'tok-' || t.n),
s AS (SELECT *, coalesce(bool_or(spends) OVER (PARTITION BY token ORDER BY "at", tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS spent FROM j)
SELECT token, "at", tie, CASE WHEN n IS NULL THEN 'bad_token' WHEN used OR spent THEN 'used' WHEN exp < "at" THEN 'expired' WHEN n % 5 = 0 THEN 'bad_token' ELSE 'ok' END AS code,
 CASE WHEN n IS NOT NULL AND NOT used AND NOT spent AND exp >= "at" AND n % 5 <> 0 THEN address END AS email FROM s""")
def token_redeems(spark, d):
    tokens = _view(spark, d, _tokens, "customer").select(F.sha2(F.concat(F.lit("tok-"), F.col("n").cast("string")).cast("binary"), 256).alias("hash"), F.replace("address", F.lit("#"), F.lit(".")).alias("email"), "exp", "used")
    return accounts.redeem_tokens(_view(spark, d, _tries, "orders"), tokens)


_shelf = "SELECT CASE WHEN p_partkey % 9 = 0 THEN 'short' ELSE 'A long title of paper number ' || (p_partkey % 120) END AS title, CASE p_partkey % 3 WHEN 0 THEN 'PDF' WHEN 1 THEN 'docx' ELSE 'odd' END AS source, p_partkey % 4 AS sentences, p_partkey AS figures FROM {part}"
_stock = "SELECT 'id' || s_suppkey AS id, s_suppkey AS pos, 'A long title of paper number ' || (s_suppkey % 150) AS title, 'a long title of paper number ' || (s_suppkey % 150) AS title_key, CASE WHEN s_suppkey % 2 = 0 THEN 'pdf' ELSE 'docx' END AS source, '2020-' || s_suppkey AS created_at, '2020' AS updated_at FROM {supplier}"


@query(f"""
WITH x AS ({_stock.replace('{supplier}', 'supplier')}), s AS (SELECT title, lower(title) AS title_key, CASE source WHEN 'docx' THEN 'docx' ELSE 'pdf' END AS source, sentences, figures FROM ({_shelf.replace('{part}', 'part')}) WHERE title <> 'short' AND sentences > 0),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY title_key, source ORDER BY sentences DESC, figures) = 1), k AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY title_key, source ORDER BY pos) = 1),
e AS (SELECT coalesce(k.id, substr(sha256(b.title_key || '|' || b.source || '|b7'), 1, 12)) AS id, b.title_key, b.source, coalesce(k.created_at, '2024') AS created_at, '2024' AS updated_at, b.sentences FROM b LEFT JOIN k USING (title_key, source)),
n AS (SELECT id, title_key, source, created_at, updated_at, sentences, -row_number() OVER (ORDER BY id) AS pos FROM e UNION ALL SELECT id, title_key, source, created_at, updated_at, NULL, pos FROM x WHERE id NOT IN (SELECT id FROM e) AND (title_key, source) NOT IN (SELECT (title_key, source) FROM e))
SELECT id, title_key, source, created_at, updated_at, sentences FROM n ORDER BY created_at DESC, pos DESC LIMIT 200""")
def session_saves(spark, d):
    index = _view(spark, d, _stock, "supplier").withColumns({"sentences": F.lit(None).cast("long"), "figures": F.lit(None).cast("long"), "content_hash": F.lit(None).cast("string")})
    entries = library.session_entries(_view(spark, d, _shelf, "part").withColumn("content_hash", F.lit("none")), index, "b7", F.lit("2024"))
    return library.index_after(index, entries, 200).select("id", "title_key", "source", "created_at", "updated_at", "sentences")


_files = "SELECT CAST(p AS STRING) AS id, CASE k WHEN 0 THEN 'session.json' WHEN 1 THEN 'source.pdf' WHEN 2 THEN 'figures/f1.png' WHEN 3 THEN 'figures/f2.png' WHEN 4 THEN '../evil' ELSE 'figures/..x' END AS name, k, p FROM {files}"
_both = {"l": ("(p + k) % 7 <> 0", "'d' || (p % 3)", "CASE WHEN k = 0 AND p % 13 = 0 THEN 6000000 WHEN k = 3 AND p % 5 = 0 THEN 9000000 ELSE 10 + k END"), "r": ("(p * 3 + k) % 5 <> 0", "CASE WHEN k % 2 = 0 THEN 'd' || (p % 3) ELSE 'e' || p END", "CASE WHEN k = 1 AND p % 6 = 0 THEN 0 ELSE 20 + k END")}
_side = lambda s: f"SELECT id, name, {_both[s][1]} AS digest, {_both[s][2]} AS bytes FROM f WHERE {_both[s][0]}"


@query(f"""
WITH f AS ({_files.replace('STRING', 'VARCHAR').replace('{files}', '(SELECT p_partkey AS p, unnest([0, 1, 2, 3, 4, 5]) AS k FROM part)')}), a AS ({_side('l')}), b AS ({_side('r')}),
l AS (SELECT *, name NOT LIKE '%..%' AND bytes BETWEEN 1 AND CASE name WHEN 'session.json' THEN 5000000 WHEN 'source.pdf' THEN 80000000 ELSE 8000000 END AS fit FROM a), r AS (SELECT *, name NOT LIKE '%..%' AND bytes BETWEEN 1 AND CASE name WHEN 'session.json' THEN 5000000 WHEN 'source.pdf' THEN 80000000 ELSE 8000000 END AS fit FROM b),
h AS (SELECT id, (SELECT count(*) FROM l WHERE l.id = p.id AND name = 'session.json' AND fit) AS hl, (SELECT count(*) FROM r WHERE r.id = p.id AND name = 'session.json' AND fit) AS hr FROM (SELECT p_partkey::varchar AS id FROM part) p),
w AS (SELECT * FROM (SELECT id, CASE WHEN hl > 0 AND (hr = 0 OR id::bigint % 4 = 3) THEN 'up' WHEN hr > 0 AND (hl = 0 OR id::bigint % 4 < 2) THEN 'down' END AS direction FROM h) WHERE direction IS NOT NULL),
j AS (SELECT w.id, w.direction, f.name, CASE direction WHEN 'up' THEN l.digest ELSE r.digest END AS g, CASE direction WHEN 'up' THEN coalesce(l.fit, false) ELSE coalesce(r.fit, false) END AS fit, CASE direction WHEN 'up' THEN r.digest ELSE l.digest END AS h, CASE direction WHEN 'up' THEN r.fit ELSE l.fit END AS hfit
 FROM w JOIN f USING (id) LEFT JOIN l ON l.id = w.id AND l.name = f.name LEFT JOIN r ON r.id = w.id AND r.name = f.name)
SELECT id, name, direction, CASE WHEN fit AND h IS NULL THEN 'copy' WHEN fit AND (g <> h OR NOT hfit) THEN 'replace' WHEN fit THEN 'keep' ELSE 'delete' END AS action, CASE WHEN fit THEN g END AS digest FROM j WHERE fit OR h IS NOT NULL""")
def bundle_sync(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("p"))
    parts.withColumn("k", F.explode(F.array(*map(F.lit, range(6))))).createOrReplaceTempView("bundle_files")
    spark.sql(_files.replace("{files}", "bundle_files")).createOrReplaceTempView("f")
    index = lambda e: parts.select(F.col("p").cast("string").alias("id"), F.expr(e).alias("updated_at"))
    local, remote = spark.sql(_side("l")), spark.sql(_side("r"))
    return library.sync_plan(local, remote, index("CAST(2020 + p % 4 AS STRING)"), index("'2022'"))

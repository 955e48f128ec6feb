"""Queries on single rules: cells, cleaned answers, boxes, short records, stored references and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import records, text
from quire.operators import accounts, figures, jobs, layout, library, links, segment, sessions
from quire.plans.carriers import table
from quire.plans.catalog_queries import _view
from quire.sources import readers

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT l_orderkey, string_agg(concat_ws(' | ', coalesce(CASE WHEN l_linenumber % 3 > 0 THEN l_returnflag END, ''), l_linenumber, l_linestatus), chr(10) ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS cells FROM lineitem GROUP BY l_orderkey""")
def table_cells(spark, d):
    cells = F.array(F.expr("CASE WHEN l_linenumber % 3 > 0 THEN l_returnflag || ' ' END"), F.concat(F.lit(" "), F.col("l_linenumber").cast("string")), F.col("l_linestatus"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", cells.alias("cells")))).alias("rows"))
    return rows.select("l_orderkey", readers.table_text(F.transform("rows", lambda r: r["cells"])).alias("cells"))


_said = "CASE c_custkey % 6 WHEN 0 THEN ' \"Korean: ' || c_name || '\" ' WHEN 1 THEN '「' || c_name || '」' WHEN 2 THEN 'Transcript:  ' || c_name || '  twice' WHEN 3 THEN 'TEXT: ' || c_name WHEN 4 THEN 'korean ' || c_name END"


@query(rf"""WITH b AS (SELECT c_custkey, regexp_replace(trim(coalesce({_said}, '')), '^[「」"'']+|[「」"'']+$', '', 'g') AS t FROM customer)
SELECT c_custkey, trim(regexp_replace(t, '(?i)^korean:', '')) AS translated, trim(regexp_replace(regexp_replace(t, '(?i)^(transcript|transcription|text):', ''), '\s+', ' ', 'g')) AS heard FROM b""")
def cleaned_answers(spark, d):
    said = F.expr(_said.replace("' \"", "' \\\"").replace("|| '\" '", "|| '\\\" '"))
    return table(spark, d, "customer").select("c_custkey", text.translation(said).alias("translated"), text.transcript(said).alias("heard"))


_sides = "(p_partkey % 10)::double AS ax, (p_size % 7)::double AS ay, 4.0 + p_partkey % 5 AS aw, 3.0 + p_size % 4 AS ah, (p_partkey % 8)::double AS bx, (p_size % 6)::double AS by_, 5.0 + p_partkey % 3 AS bw, 4.0 + p_size % 3 AS bh"


@query(f"""WITH b AS (SELECT p_partkey, {_sides} FROM part), o AS (SELECT *, greatest(least(ax + aw, bx + bw) - greatest(ax, bx), 0) * greatest(least(ay + ah, by_ + bh) - greatest(ay, by_), 0) AS shared, least(aw * ah, bw * bh) AS small FROM b)
SELECT p_partkey, round((shared / small)::double, 9) AS share, shared / small > 0.55 AS heavy FROM o""")
def box_overlaps(spark, d):
    box = lambda x, y, w, h: F.struct(F.expr(x).alias("x0"), F.expr(y).alias("y0"), F.expr(f"{x} + {w}").alias("x1"), F.expr(f"{y} + {h}").alias("y1"))
    a = box("CAST(p_partkey % 10 AS DOUBLE)", "CAST(p_size % 7 AS DOUBLE)", "4.0D + p_partkey % 5", "3.0D + p_size % 4")
    b = box("CAST(p_partkey % 8 AS DOUBLE)", "CAST(p_size % 6 AS DOUBLE)", "5.0D + p_partkey % 3", "4.0D + p_size % 3")
    return table(spark, d, "part").select("p_partkey", F.round(layout.overlap_share(a, b), 9).alias("share"), layout.heavily_overlap(a, b).alias("heavy"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), n AS (SELECT doc_id, line FROM l UNION ALL SELECT doc_id, repeat('1', (doc_id % 14)::int) || CASE doc_id % 3 WHEN 0 THEN ' – 2' WHEN 1 THEN ',.' ELSE ' x' END FROM documents)
SELECT doc_id, count(*) FILTER (trim(line) <> '' AND NOT (length(trim(line)) < 12 AND regexp_full_match(trim(line), '[\d\s\-–—.,]+'))) AS kept, count(*) AS n FROM n GROUP BY doc_id""")
def real_sentences(spark, d):
    docs = table(spark, d, "documents")
    lines = docs.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    short = docs.select("doc_id", F.expr("repeat('1', CAST(doc_id % 14 AS INT)) || CASE doc_id % 3 WHEN 0 THEN ' – 2' WHEN 1 THEN ',.' ELSE ' x' END").alias("line"))
    return lines.unionByName(short).groupBy("doc_id").agg(F.count_if(segment.is_sentence(F.col("line"))).alias("kept"), F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_orderkey END AS sentence, CASE WHEN o_orderkey % 4 = 1 THEN o_custkey + 1 ELSE 7 END AS figure,
 900 > coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END, o_custkey + 300) AS expired FROM orders""")
def patched_cursors(spark, d):
    """A cursor takes only the sides that a request gives; an invite expires by its own time or by its age."""
    o = table(spark, d, "orders")
    patched = lambda old, given: accounts.patch(old, F.expr(given))
    expired = jobs.invite_expired(F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END"), F.col("o_custkey"), F.lit(900), 300)
    return o.select("o_orderkey", patched(F.col("o_orderkey"), "CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END").alias("sentence"), patched(F.lit(7).cast("long"), "CASE WHEN o_orderkey % 4 = 1 THEN o_custkey + 1 END").alias("figure"), expired.alias("expired"))


_placed = "SELECT l_orderkey AS doc, l_suppkey % 4 AS xref, CAST(l_linenumber % 3 AS DOUBLE) AS x0, CAST(0 AS DOUBLE) AS y0, CAST(l_linenumber % 3 + 30 + l_quantity % 20 AS DOUBLE) AS x1, CAST(60 AS DOUBLE) AS y1, 1000 * (1 + l_suppkey % 4) AS bytes FROM {lineitem}"


@query(f"SELECT DISTINCT doc, xref, x0, x1 FROM ({_placed.replace('{lineitem}', 'lineitem')}) WHERE least(x1 - x0, y1 - y0) >= 40 AND bytes >= 2000")
def embedded_images(spark, d):
    return figures.embedded(_view(spark, d, _placed, "lineitem"), ["doc"]).select("doc", "xref", "x0", "x1")


_entries = "SELECT o_custkey AS doc, o_orderkey AS pos, CASE o_orderkey % 6 WHEN 0 THEN '0' WHEN 1 THEN 'x' ELSE CAST(1 + o_orderkey % 5 AS STRING) END AS n, CASE o_orderkey % 7 WHEN 0 THEN ' a ' WHEN 1 THEN 'Paper doi:10.1000/t' || o_orderkey || '.' ELSE ' Entry ' || o_orderpriority END AS text, CASE o_orderkey % 4 WHEN 0 THEN '10.9/' || o_custkey WHEN 1 THEN '' END AS doi FROM {orders}"


@query(f"""WITH e AS (SELECT doc, pos, try_cast(n AS bigint) AS n, trim(text) AS text, doi FROM ({_entries.replace('{orders}', 'orders').replace('STRING', 'VARCHAR')}))
SELECT doc, n, text, coalesce(nullif(doi, ''), CASE WHEN text LIKE 'Paper%' THEN regexp_extract(text, '10\\.1000/t[0-9]+') END) AS doi FROM e WHERE n BETWEEN 1 AND 9999 AND length(text) >= 3 QUALIFY row_number() OVER (PARTITION BY doc, n ORDER BY pos) = 1""")
def stored_references(spark, d):
    return links.normalize_references(_view(spark, d, _entries, "orders"), "doc", "pos")


@query("""WITH s AS (SELECT p_partkey, p_size, unnest(range(0, p_size)) AS k FROM part)
SELECT p_partkey, count(*) FILTER (k < 40 AND k % 5 > 0) AS symbols, count(*) FILTER (k < 40 AND k % 5 > 0 AND k % 2 = 0) AS noted, coalesce(max(length(p_partkey::varchar || repeat('s', k::int * 5))) FILTER (k < 40 AND k % 5 > 0), 0)::int AS raw_chars, least(coalesce(max(length(p_partkey::varchar || repeat('s', k::int * 5))) FILTER (k < 40 AND k % 5 > 0), 0), 120)::int AS kept_chars FROM s GROUP BY ALL""")
def survey_symbols(spark, d):
    # A few rows of part make many symbols: they are dealt out first. Each step that is read twice is a column of its own.
    dealt = table(spark, d, "part").where("p_size > 0").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    p = dealt.select("p_partkey", F.expr("transform(sequence(0, CAST(p_size AS INT) - 1), k -> concat(p_partkey, repeat('s', CAST(k * 5 AS INT))))").alias("raws"))
    item = "concat('{\"raw\":\"', r, '\",\"rich\":\"', CASE WHEN k % 5 > 0 THEN '<i>s</i>' ELSE ' ' END, '\"', CASE WHEN k % 2 = 0 THEN ',\"note\":\"n\"' ELSE '' END, '}')"
    answer = F.concat(F.lit('{"symbols":['), F.array_join(F.expr(f"transform(raws, (r, k) -> {item})"), ","), F.lit("]}"))
    found = p.select("p_partkey", "raws", records.survey_answer(answer)["symbols"].alias("found"))
    raw = F.transform(F.slice("raws", 1, 40), lambda x, k: F.when(k % 5 > 0, F.length(x)))
    kept = F.transform("found", lambda s: F.length(s["raw"]))
    noted = F.filter("found", lambda s: s["note"].isNotNull())
    return found.select("p_partkey", F.size("found").cast("long").alias("symbols"), F.size(noted).cast("long").alias("noted"), F.coalesce(F.array_max(raw), F.lit(0)).alias("raw_chars"), F.coalesce(F.array_max(kept), F.lit(0)).alias("kept_chars"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE CASE WHEN length('{"a":' || p_partkey || ',"b":"' || p_name || '"}') <= 30 THEN p_partkey END END AS a FROM part""")
def decoded_stores(spark, d):
    raw = F.expr("""CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '[1]' WHEN 2 THEN '{"a":' ELSE concat('{"a":', p_partkey, ',"b":"', p_name, '"}') END""").cast("binary")
    return table(spark, d, "part").select("p_partkey", sessions.read_store(raw, "a long, b string", 30)["a"].alias("a"))


@query("""SELECT CASE WHEN c_custkey % 7 = 0 THEN '../' || c_custkey ELSE 'paper' || lpad(c_custkey::varchar, 6, '0') END AS cache_id, 'fig-' || (c_custkey % 4) AS figure_id,
 CASE WHEN c_custkey % 7 > 0 AND c_custkey % 4 > 0 AND c_custkey % 5 > 0 AND c_custkey % 4 < 3 THEN 'data:image/png;base64,' || to_base64(encode(c_name)) END AS image FROM customer""")
def figure_images(spark, d):
    c = table(spark, d, "customer").withColumn("cache_id", F.expr("CASE WHEN c_custkey % 7 = 0 THEN concat('../', c_custkey) ELSE concat('paper', lpad(CAST(c_custkey AS STRING), 6, '0')) END"))
    every = c.withColumn("k", F.explode(F.array(*map(F.lit, range(1, 4))))).withColumn("figure_id", F.concat(F.lit("fig-"), F.col("k")))
    known = every.select("cache_id", "figure_id", F.expr("CASE WHEN k = 3 THEN 'figures/../x.png' ELSE concat('figures\\\\', figure_id, '.png') END").alias("file"))
    images = every.where("c_custkey % 5 > 0").select("cache_id", F.expr("concat('figures/', figure_id, '.png')").alias("file"), F.col("c_name").cast("binary").alias("content"), F.lit("image/png").alias("mime"))
    return library.figure_image(known, images, c.select("cache_id", F.concat(F.lit("fig-"), (F.col("c_custkey") % 4).cast("string")).alias("figure_id")))


@query("""WITH s AS (SELECT sha256('CODE' || lpad(s_suppkey::varchar, 6, '0')) AS hash, s_suppkey AS t FROM supplier), r AS (SELECT c_custkey AS t, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'CODE' || lpad((c_custkey % 80 + 5)::varchar, 6, '0') END AS code, CASE WHEN c_custkey % 2 = 0 THEN 'admin' ELSE 'a@x.org' END AS by_ FROM customer),
o AS (SELECT *, sha256(code) AS hash, CASE WHEN code = '' THEN 'mint_failed' WHEN sha256(code) IN (SELECT hash FROM s) OR row_number() OVER (PARTITION BY code ORDER BY t, by_) > 1 THEN 'mint_collision' ELSE 'ok' END AS outcome FROM r),
k AS (SELECT hash, t, t + 900 AS expires_at, by_, 1 AS late FROM o WHERE outcome = 'ok' UNION ALL SELECT hash, t, NULL, 'old', 0 FROM s)
SELECT 'request' AS what, code AS name, t AS "at", outcome AS state, NULL::bigint AS expires_at FROM o UNION ALL SELECT 'invite', hash, t, by_, expires_at FROM (SELECT * FROM k ORDER BY late DESC, t DESC, hash DESC LIMIT 60)""")
def minted_invites(spark, d):
    store = table(spark, d, "supplier").select(text.invite_hash(F.expr("concat('CODE', lpad(CAST(s_suppkey AS STRING), 6, '0'))")).alias("hash"), F.lit("open").alias("status"), F.col("s_suppkey").alias("created_at"), F.lit(None).cast("long").alias("expires_at"), F.lit("old").alias("created_by"), F.lit("").alias("note"))
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("at"), F.expr("CASE WHEN c_custkey % 9 = 0 THEN '' ELSE concat('code-', lpad(CAST(c_custkey % 80 + 5 AS STRING), 6, '0')) END").alias("code"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'admin' ELSE ' ' END").alias("admin_uid"), F.lit("a@x.org").alias("admin_email"), F.lit(None).cast("string").alias("note"))
    kept, outcomes = accounts.mint_invites(store, asked, 900, 60)
    made = kept.select(F.lit("invite").alias("what"), F.col("hash").alias("name"), F.col("created_at").alias("at"), F.col("created_by").alias("state"), "expires_at")
    return outcomes.select(F.lit("request").alias("what"), text.invite_code(F.col("code")).alias("name"), "at", F.col("outcome").alias("state"), F.lit(None).cast("long").alias("expires_at")).unionByName(made)


_below = "SELECT p_partkey AS page, k AS block, CAST(10 + k AS DOUBLE) AS x0, CAST(90 + k AS DOUBLE) AS x1, CAST(100 * k + (p_partkey * (k + 1)) % 70 AS DOUBLE) AS y0, CAST(100 * k + (p_partkey * (k + 1)) % 70 + 12 AS DOUBLE) AS y1, CASE WHEN (p_partkey + k) % 3 = 0 THEN 'Table ' || k || '. Rows' ELSE 'Figure ' || k || '. Drawing' END AS text FROM {part}"


@query(f"""WITH b AS ({_below.replace('{part}', 'part, (SELECT unnest([1, 2, 3, 4]) AS k)')}), i AS (SELECT p_partkey AS page, 20.0 AS x0, 80.0 AS x1, 40.0 AS y0, 120.0 + p_partkey % 60 AS y1 FROM part)
SELECT i.page, arg_min(b.text, b.y0) AS caption FROM i JOIN b ON i.page = b.page AND b.text LIKE 'Figure%' AND b.y0 BETWEEN i.y1 - 2 AND i.y1 + 150 GROUP BY i.page""")
def captions_below(spark, d):
    table(spark, d, "part").select("p_partkey", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("k")).createOrReplaceTempView("part_blocks")
    blocks = spark.sql(_below.replace("{part}", "part_blocks"))
    images = table(spark, d, "part").select(F.col("p_partkey").alias("page"), F.lit(1).alias("image"), F.lit(20.0).alias("x0"), F.lit(80.0).alias("x1"), F.lit(40.0).alias("y0"), F.expr("CAST(120 + p_partkey % 60 AS DOUBLE)").alias("y1"))
    return layout.nearest_caption(images, blocks, ["page"], "image", above=False).select("page", "caption")

"""Queries on invites, tokens, access, progress and error reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import accounts
from quire.plans.carriers import table
from quire.plans.catalog_queries import _view

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_report = "SELECT event_id AS ts, CASE WHEN event_id % 10 = 0 THEN ' ' ELSE event_type END AS kind, 'failed password: p' || event_id AS message, CASE WHEN event_id % 2 = 0 THEN props END AS stack, 'u' || user_id AS uid, CASE WHEN event_id % 3 = 0 THEN '../x' ELSE 'c' || event_id END AS cache_id FROM {events}"


@query(f"""SELECT ts, kind, message, stack, uid, cache_id, substr(sha256(ts || '|' || uid || '|' || kind || '|' || message), 1, 16) AS id FROM (
 SELECT ts, trim(kind) AS kind, 'failed password: REDACTED' AS message, coalesce(stack, '') AS stack, uid, CASE WHEN cache_id = '../x' THEN '' ELSE cache_id END AS cache_id FROM ({_report.replace('{events}', 'events')})) WHERE kind <> ''""")
def error_reports(spark, d):
    return accounts.error_events(_view(spark, d, _report, "events"))


_tokens = "SELECT r.replica, 't' || (o_custkey % 300) AS hash, (o_orderkey + r.replica) % 3 = 0 AS used, o_orderkey * 3600 + r.replica AS exp FROM {orders} CROSS JOIN (SELECT 0 AS replica UNION ALL SELECT 1) r"
_merged_tokens = f"SELECT replica, hash, used, exp FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY used DESC, exp DESC, replica DESC) AS k FROM ({_tokens.replace('{orders}', 'orders')})) WHERE k = 1"


@query(_merged_tokens)
def token_merge(spark, d):
    return accounts.merge_tokens(_view(spark, d, _tokens, "orders"))


@query(f"SELECT * FROM ({_merged_tokens}) WHERE 900000 - exp <= CASE WHEN used THEN 172800 ELSE 86400 END ORDER BY exp DESC, hash LIMIT 500")
def token_prune(spark, d):
    return accounts.prune_tokens(accounts.merge_tokens(_view(spark, d, _tokens, "orders")), F.lit(900_000))


_attempts = "SELECT user_id % 40 AS invite, event_id AS at, event_id AS tie, user_id % 7 AS uid, 100 + (user_id % 40) * 20 AS expires, user_id % 40 = 3 AS revoked FROM {events}"


@query(f"""WITH a AS ({_attempts.replace('{events}', 'events').replace(' AS at,', ' AS "at",')}), f AS (SELECT invite, arg_min(uid, "at") AS owner, min("at") AS won FROM a WHERE NOT revoked AND "at" <= expires GROUP BY invite)
 SELECT a.invite, a."at", a.tie, a.uid, a.expires, a.revoked, CASE WHEN won IS NOT NULL AND a."at" > won THEN CASE WHEN a.uid = owner THEN 'ok_again' ELSE 'used' END WHEN a.revoked THEN 'revoked' WHEN a."at" > a.expires THEN 'expired' ELSE 'ok' END AS code FROM a LEFT JOIN f ON a.invite = f.invite""")
def invite_redeem(spark, d):
    return accounts.redeem_outcomes(_view(spark, d, _attempts, "events"), ["invite"], "at", "tie")


@query("""SELECT c_custkey, c_custkey % 4 = 0 OR c_custkey % 5 = 0 OR c_nationkey % 3 = 1 AS paid, CASE c_nationkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'allowed' ELSE 'none' END AS status FROM customer""")
def access_decisions(spark, d):
    c = table(spark, d, "customer")
    status = F.expr("CASE c_nationkey % 3 WHEN 0 THEN ' Pending' WHEN 1 THEN 'ALLOWED' ELSE 'odd' END")
    admin = accounts.is_admin(F.expr("CASE WHEN c_custkey % 5 = 0 THEN 'A@x.org ' ELSE c_name END"), F.lit(" a@x.org,, b@x.org"))
    return c.select("c_custkey", accounts.may_use_paid(F.expr("c_custkey % 4 <> 0"), admin, status).alias("paid"), accounts.access_status(status).alias("status"))


@query("""SELECT 'h' || o_orderkey AS hash, o_orderkey AS created_at, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 50 ELSE o_orderkey + 900 END AS expires_at FROM orders
 WHERE o_orderstatus = 'O' AND 1000 <= CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 50 ELSE o_orderkey + 900 END""")
def open_invites(spark, d):
    rows = table(spark, d, "orders").select(F.expr("'h' || o_orderkey").alias("hash"), F.expr("CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'redeemed' END").alias("status"), F.col("o_orderkey").alias("created_at"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 50 END").alias("expires_at"))
    return accounts.open_invites(rows, F.lit(1000), 900)


@query("""SELECT c_custkey AS doc, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE c_nationkey + 100 END AS sentence_index, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END AS figure_index, c_custkey AS at_time,
 CASE WHEN (CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE c_nationkey + 100 END) >= 110 THEN 'sentence_range' WHEN (CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END) >= 2 THEN 'figure_range' ELSE 'ok' END AS reason FROM customer""")
def progress_restore(spark, d):
    c = table(spark, d, "customer")
    stored = c.select(F.expr("'cache' || c_custkey").alias("alias_key"), F.col("c_nationkey").alias("sentence_index"), F.lit(1).alias("figure_index"), F.col("c_custkey").alias("at")).where("at % 2 = 0")
    stored = stored.unionByName(c.select(F.expr("'hash' || c_custkey").alias("alias_key"), (F.col("c_nationkey") + 100).alias("sentence_index"), F.lit(2).alias("figure_index"), F.col("c_custkey").alias("at")))
    wanted = c.select(F.col("c_custkey").alias("doc"), F.expr("'cache' || c_custkey").alias("alias_key"), F.lit(0).alias("priority")).unionByName(c.select(F.col("c_custkey").alias("doc"), F.expr("'hash' || c_custkey").alias("alias_key"), F.lit(1).alias("priority")))
    found = accounts.progress_row(stored, wanted, "doc").withColumnRenamed("at", "at_time")
    return found.withColumn("reason", accounts.progress_reason(F.col("sentence_index"), F.col("figure_index"), F.lit(110), F.lit(2)))

"""Validity of stored records: leases, checkpoints, invites, cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Percent floors of stages; lifetimes.
STAGE_FLOOR = {"extract": 5, "cache": 10, "quality": 12, "vision": 20, "figures": 42, "debone": 48, "split": 70, "ready": 88, "translate": 90, "save": 98, "shadowing_chunks": 99}
TTL_HOURS, AHEAD_SECONDS, LEASE_SECONDS = 168, 300, 90


def lease_expired(until: Column, now: Column) -> Column:
    return until.isNull() | (until <= now)


def checkpoint_reason(row: dict[str, Column], now: Column, version: int, pipeline: str, content_hash: Column, ttl_hours: int = TTL_HOURS, enabled: Column | bool = True) -> Column:
    """The first reason that makes a checkpoint useless, or ok. row: v, pipeline_version, content_hash, updated_at (seconds), stage."""
    age = now - row["updated_at"]
    return (
        F.when(~F.lit(enabled), "disabled")
        .when(row["v"].isNull(), "missing")
        .when(row["v"] != version, "schema")
        .when(~row["pipeline_version"].eqNullSafe(F.lit(pipeline)), "pipeline")
        .when(~row["content_hash"].eqNullSafe(content_hash), "hash")
        .when(row["updated_at"].isNull() | (age > ttl_hours * 3600) | (age < -AHEAD_SECONDS), "ttl")
        .when(F.coalesce(F.trim(row["stage"]), F.lit("")) == "", "stage")
        .otherwise("ok")
    )


def invite_expired(expires: Column, created: Column, now: Column, ttl: int) -> Column:
    """Strictly past its expiry; older records have only their creation time."""
    return now > F.coalesce(expires, created + ttl)


def stage_floor(stage: Column) -> Column:
    floors = F.create_map(*[F.lit(x) for pair in STAGE_FLOOR.items() for x in pair])
    return F.coalesce(F.try_element_at(floors, F.trim(stage)), F.lit(1))


def clamp_cursor(index: Column, count: Column) -> Column:
    """An index inside 0..count-1; 0 where there is nothing."""
    return F.greatest(F.least(index, count - 1), F.lit(0))


def wrap_cursor(index: Column, step: Column, count: Column) -> Column:
    return F.when(count > 0, F.pmod(index + step, count)).otherwise(0)


def full_pass(slots: Column, wanted: Column) -> Column:
    """Whether the first `wanted` slots (structs of status and blob_key) are all recorded with a blob."""
    first = F.slice(slots, F.lit(1), F.greatest(wanted, F.lit(0)))
    return (wanted > 0) & (F.size(slots) >= wanted) & F.forall(first, lambda s: (s["status"] == "recorded") & (F.coalesce(s["blob_key"], F.lit("")) != ""))


def build_checkpoint(stage: Column, content_hash: Column, pipeline: Column, done: Column, total: Column, ref: Column, version: int = 2) -> Column:
    """A resume record without any text: short fields, a cursor within bounds, a plain file name or null."""
    short = lambda c, n: F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, n)
    bound = lambda c: F.greatest(F.least(F.coalesce(c, F.lit(0)), F.lit(1_000_000)), F.lit(0))
    name = short(ref, 80)
    plain = (name != "") & ~F.contains(name, F.lit("..")) & ~name.rlike(r"[/\\]")
    return F.struct(
        F.lit(version).alias("v"),
        short(pipeline, 32).alias("pipeline_version"),
        short(stage, 40).alias("stage"),
        F.lower(short(content_hash, 64)).alias("content_hash"),
        F.when(bound(total) > 0, F.struct(bound(done).alias("done"), bound(total).alias("total"))).alias("cursor"),
        F.when(plain, name).alias("payload_ref"),
    )


def stamp(job_done: Column, error: Column, stage: Column, new: Column, old: Column) -> Column:
    """The new checkpoint while a job runs, else the one it has."""
    running = ~F.coalesce(job_done, F.lit(False)) & (F.coalesce(error, F.lit("")) == "") & ~F.trim(F.coalesce(stage, F.lit(""))).isin("", "done", "error")
    return F.when(running, new).otherwise(old)


def claim_leases(requests: DataFrame, job: str, at: str, worker: str, seconds: int = LEASE_SECONDS) -> DataFrame:
    """Requests (job, at, worker) with `claimed`: a lease runs out `seconds` after it was taken.

    Each grant depends on the one before, so requests are replayed by job.
    """
    kinds = ", ".join(f"`{c}` {requests.schema[c].dataType.simpleString()}" for c in (job, at, worker))

    def run(batches):
        last, until = None, None
        for pdf in batches:
            won = []
            for j, now in zip(pdf[job], pdf[at]):
                if j != last:
                    last, until = j, None
                free = until is None or until <= now
                until = now + seconds if free else until
                won.append(free)
            yield pdf.assign(claimed=won)

    return requests.select(job, at, worker).repartition(job).sortWithinPartitions(job, at, worker).mapInPandas(run, kinds + ", claimed boolean")


def plan_status(sentences: DataFrame, built: DataFrame, doc: str, key: str) -> DataFrame:
    """(doc, todo, status): sentences without practice chunks, and whether a plan is ok, pending or in error."""
    plans = built.groupBy(doc).agg(F.count_if(F.col("failed")).alias("failed"))
    todo = sentences.join(built.where(~F.col("failed")).select(doc, key), [doc, key], "left_anti").groupBy(doc).agg(F.count(F.lit(1)).alias("todo"))
    every = sentences.select(doc).distinct().join(todo, doc, "left").join(plans, doc, "left").fillna(0, ["todo", "failed"])
    return every.select(doc, "todo", F.when(F.col("failed") > 0, "error").when(F.col("todo") > 0, "pending").otherwise("ok").alias("status"))


def limit_setting(raw: Column, default: int, least: int, most: int) -> Column:
    """A numeric setting held within bounds; anything else is the default."""
    value = F.trim(raw).try_cast("long")
    return F.when(value.isNull(), F.lit(default)).otherwise(F.greatest(F.least(value, F.lit(most)), F.lit(least)))


def public_job(done: Column, error: Column, percent: Column, stage: Column) -> Column:
    """What a caller may see of a job: no owner, no hashes."""
    state = F.when(F.coalesce(error, F.lit("")) != "", "error").when(F.coalesce(done, F.lit(False)), "done").otherwise("running")
    return F.struct(state.alias("state"), F.greatest(F.least(percent, F.lit(100)), F.lit(0)).alias("percent"), stage.alias("stage"))

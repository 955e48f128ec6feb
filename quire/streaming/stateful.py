"""Streaming forms of metering, admission and uploads, sharing their steps with the batch forms."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.chunk_plans import FLUSH
from quire.operators.sessions import CHUNK_BYTES, chunk_step
from quire.operators.usage import COUNTERS, LIMITED, LIMITS, admit, limit_step, totals


def metered(facts: DataFrame, by: str = "uid", counters: list[str] = COUNTERS) -> DataFrame:
    """Running sums of each user: the batch aggregation on a stream, for update or complete mode."""
    return totals(facts, by, counters)


def admitted(calls: DataFrame, key: str, at: str, most: int, seconds: int, inclusive: bool = True) -> DataFrame:
    """calls (key, at in whole seconds) of a stream with `admitted`; the state of a key is its log of stamps.

    Calls of one key are decided in time order within a micro-batch, and the state carries over. Only
    stamps inside the window are kept, so a key's state is bounded by `most`.
    """
    kinds = calls.select(key, at).schema

    def step(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches), ignore_index=True).sort_values(at, kind="stable")
        passed = []
        for t in rows[at]:
            ok, log = admit(log, int(t), most, seconds, inclusive)
            passed.append(ok)
        state.update(([int(t) for t in log],))
        yield rows[[key, at]].assign(admitted=passed)

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", admitted boolean"
    return calls.select(key, at).groupBy(key).applyInPandasWithState(step, columns, "log array<long>", "append", GroupStateTimeout.NoTimeout)


def contiguous_uploads(parts: DataFrame, key: str = "upload_id", offset: str = "offset", size: str = "size", total: str | None = None, limit: int = CHUNK_BYTES) -> DataFrame:
    """parts of a stream with the outcome of each, by the same step as the batch form.

    A part must start where its upload stands; the state is the received length. Within a micro-batch parts
    are taken by offset. Without a column `total` the end of an upload is open.
    """
    columns = f"`{key}` {parts.schema[key].dataType.simpleString()}, offset long, size long, outcome string, received long"
    whole = F.col(total).cast("long") if total else F.lit(None).cast("long")

    def step(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        received = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches), ignore_index=True).sort_values(offset, kind="stable")
        out = []
        for o, n, end in zip(rows[offset], rows[size], rows["_total"]):
            reason, received = chunk_step(received, int(o), int(n), None if pd.isna(end) else int(end), limit)
            out.append((who[0], int(o), int(n), reason, received))
        state.update((received,))
        yield pd.DataFrame(out, columns=[key, "offset", "size", "outcome", "received"])

    rows = parts.select(key, F.col(offset).cast("long").alias(offset), F.col(size).cast("long").alias(size), whole.alias("_total"))
    return rows.groupBy(key).applyInPandasWithState(step, columns, "received long", "append", GroupStateTimeout.NoTimeout)


def limited(calls: DataFrame, limits: dict[str, tuple[int, int, bool]] = LIMITS) -> DataFrame:
    """Decisions and events of a stream of calls (uid, action, at, tie), by the same step as the batch form.

    The state of a user and action is the log of admitted calls inside the window.
    """

    def step(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        uid, action = who
        log, out = list(state.get[0]) if state.exists else [], []
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["at", "tie"], kind="stable")
        for at, tie in zip(rows["at"], rows["tie"]):
            code, met, log = ("auth_required", None, log) if uid == "" else limit_step(log, action, int(at), limits)
            out.append(("decision", uid, action, at, tie, code, None, None))
            if met is not None:
                out.append(("event", uid, action, at, tie, f"{action}_rate_limited", met, limits[action][1]))
        state.update(([int(t) for t in log],))
        yield pd.DataFrame(out, columns=["what", "uid", "action", "at", "tie", "code", "attempts", "seconds"]).astype({"attempts": "Int32", "seconds": "Int32"})

    named = calls.select(F.trim(F.coalesce(F.col("uid").cast("string"), F.lit(""))).alias("uid"), F.coalesce("action", F.lit("")).alias("action"), F.col("at").cast("long").alias("at"), F.col("tie").cast("long").alias("tie"))
    return named.groupBy("uid", "action").applyInPandasWithState(step, LIMITED, "log array<long>", "append", GroupStateTimeout.NoTimeout)


def fan_out(tables: dict[str, str], column: str = "what") -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: rows of each value of `column` go to their own table, from one computation.

    A batch is written as a partition of its own number, so a batch that runs again replaces what it left.
    """

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for value, path in tables.items():
                held.where(F.col(column) == value).drop(column).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            held.unpersist()

    return write


#: Rows of `built_plans`: a built sentence with the save it belongs to, and the plan's state after each slice.
BUILT = "what string, doc string, slice int, flush int, sentence_id string, chunks array<string>, status string, error string, done int, total int"


def built_plans(units: DataFrame, seconds: float, pause_ms: int = 1) -> DataFrame:
    """Practice plans of a stream of planned sentences (doc, ord, sentence_id, chunks, reason, seconds), in slices.

    The state of a document is its queue of open sentences and what is built. A slice takes sentences in order
    until their time reaches `seconds` (one at least) and saves every five; what is left waits for the timer,
    `pause_ms` later, or for new sentences. A failure ends the slice with status error and is tried again after
    new input. A restarted query goes on from the state. With a processing-time timer a query never ends by itself.
    """

    def step(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = json.loads(state.get[0]) if state.exists else {"queue": [], "done": [], "slice": 0}
        if not state.hasTimedOut:
            rows = pd.concat(list(batches), ignore_index=True)
            # A sentence sent again replaces its open entry, and is ignored once it is built.
            fresh = {r.sentence_id: [int(r.ord), r.sentence_id, None if r.chunks is None else list(r.chunks), r.reason, float(r.seconds)] for r in rows.itertuples()}
            done = set(known["done"])
            kept = [u for u in known["queue"] if u[1] not in fresh]
            known["queue"] = sorted(kept + [u for k, u in fresh.items() if k not in done])
        spent, out, error, new = 0.0, [], None, 0
        known["slice"] += 1
        while known["queue"] and spent < seconds:
            _, name, chunks, reason, took = known["queue"][0]
            if reason != "ok":
                error = reason
                break
            known["queue"].pop(0)
            known["done"].append(name)
            out.append(("built", who[0], known["slice"], new // FLUSH, name, chunks, None, None, None, None))
            spent, new = spent + took, new + 1
        total = len(known["done"]) + len(known["queue"])
        status = "error" if error else "pending" if known["queue"] else "ok"
        out.append(("state", who[0], known["slice"], None, None, None, status, error, len(known["done"]), total))
        state.update((json.dumps(known),))
        if status == "pending":
            state.setTimeoutDuration(pause_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in BUILT.split(", ")]).astype({"flush": "Int32", "done": "Int32", "total": "Int32"})

    named = units.select(F.col("doc").cast("string").alias("doc"), F.col("ord").cast("long").alias("ord"), "sentence_id", "chunks", "reason", F.col("seconds").cast("double").alias("seconds"))
    return named.groupBy("doc").applyInPandasWithState(step, BUILT, "plan string", "append", GroupStateTimeout.ProcessingTimeTimeout)

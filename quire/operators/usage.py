"""Metering, cost estimates, and admission by a sliding log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Counters, and prices in USD per million characters or per GiB.
COUNTERS = ["model_in_chars", "model_out_chars", "speech_chars", "upload_bytes", "download_bytes", "model_calls", "speech_calls", "store_calls"]
PRICE = {"model_in": 0.30, "model_out": 2.50, "speech": 16.0, "upload": 0.08, "download": 0.12}
#: (most, seconds, whether a stamp exactly one window old still counts) of each limiter.
LIMITS = {"ingest": (12, 600, True), "upload": (600, 600, True), "build": (10, 600, True), "report": (30, 600, False), "redeem": (10, 900, True), "link": (5, 900, True)}


def totals(facts: DataFrame, by: str = "uid", counters: list[str] = COUNTERS) -> DataFrame:
    """Sums of the counters by user; negative amounts and nulls count as zero."""
    return facts.groupBy(by).agg(*[F.sum(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("long")).alias(c) for c in counters])


def cost(model_in: Column, model_out: Column, speech: Column, upload: Column, download: Column) -> dict[str, Column]:
    million, gib = 1_000_000.0, float(1 << 30)
    model = model_in / million * PRICE["model_in"] + model_out / million * PRICE["model_out"]
    spoken = speech / million * PRICE["speech"]
    moved = upload / gib * PRICE["upload"] + download / gib * PRICE["download"]
    return {"model_usd": F.round(model, 6), "speech_usd": F.round(spoken, 6), "store_usd": F.round(moved, 6), "total_usd": F.round(model + spoken + moved, 6)}


def with_cost(sums: DataFrame) -> DataFrame:
    parts = cost(*[F.col(c).cast("double") for c in ("model_in_chars", "model_out_chars", "speech_chars", "upload_bytes", "download_bytes")])
    return sums.select("*", *[c.alias(n) for n, c in parts.items()])


def usage_report(facts: DataFrame, accounts: DataFrame) -> DataFrame:
    """Sums and cost of every account and every metered user, and of all together (uid null, is_total)."""
    everyone = accounts.select("uid").join(totals(facts), "uid", "full_outer").fillna(0, COUNTERS)
    rolled = everyone.rollup("uid").agg(F.grouping("uid").cast("boolean").alias("is_total"), *[F.sum(c).alias(c) for c in COUNTERS])
    return with_cost(rolled)


def admit(stamps: list[float], now: float, most: int, seconds: int, inclusive: bool) -> tuple[bool, list[float]]:
    """One step of the log: whether a call at `now` passes, and the stamps kept; refused calls leave none."""
    kept = [t for t in stamps if (now - t <= seconds if inclusive else now - t < seconds)]
    if len(kept) >= most:
        return False, kept
    return True, [*kept, now]


def admission(calls: DataFrame, keys: list[str], at: str, tie: str, most: int, seconds: int, inclusive: bool = True) -> DataFrame:
    """calls (keys, at in whole seconds, tie) with `admitted`.

    A refused call is not recorded, so each decision depends on those before it and no window function
    gives it. Calls are dealt by key and sorted inside their partition; the log is replayed as a stream
    that holds the stamps of one key at a time, so a key with very many calls costs time, not memory.
    """
    columns = [*keys, at, tie]
    kinds = ", ".join(f"`{c}` {calls.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, log = None, []
        for pdf in batches:
            passed = []
            for row in zip(*[pdf[c] for c in [*keys, at]]):
                if row[:-1] != key:
                    key, log = row[:-1], []
                ok, log = admit(log, row[-1], most, seconds, inclusive)
                passed.append(ok)
            yield pdf.assign(admitted=passed)

    return calls.select(columns).repartition(*keys).sortWithinPartitions(*keys, at, tie).mapInPandas(run, kinds + ", admitted boolean")


#: Rows of `limited`: a decision of every call, and an event of every refusal by a full log.
LIMITED = "what string, uid string, action string, at long, tie long, code string, attempts int, seconds int"


def limit_step(log: list[float], action: str | None, now: int, limits: dict[str, tuple[int, int, bool]]) -> tuple[str, int | None, list[float]]:
    """The code of a call (ok or rate_limited), the stamps it met if they refused it, and the log it leaves."""
    most, seconds, inclusive = limits.get(action, (0, 0, True))
    if most <= 0 or seconds <= 0:
        return "rate_limited", None, log
    ok, log = admit(log, now, most, seconds, inclusive)
    return ("ok", None, log) if ok else ("rate_limited", len(log), log)


def limited(calls: DataFrame, limits: dict[str, tuple[int, int, bool]] = LIMITS) -> DataFrame:
    """Decisions and events of calls (uid, action, at in whole seconds, tie), in one pass, told apart by `what`.

    Every user has a log for each action, of the admitted calls alone. A blank user is auth_required, an unknown
    action rate_limited; neither reads a log. Calls are dealt by user and action and replayed in order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, log = None, []
        for pdf in batches:
            out = []
            for uid, action, at, tie in zip(pdf["uid"], pdf["action"], pdf["at"], pdf["tie"]):
                if (uid, action) != key:
                    key, log = (uid, action), []
                code, met, log = ("auth_required", None, log) if uid == "" else limit_step(log, action, at, limits)
                out.append(("decision", uid, action, at, tie, code, None, None))
                if met is not None:
                    out.append(("event", uid, action, at, tie, f"{action}_rate_limited", met, limits[action][1]))
            yield pd.DataFrame(out, columns=["what", "uid", "action", "at", "tie", "code", "attempts", "seconds"]).astype({"attempts": "Int32", "seconds": "Int32"})

    named = calls.select(F.trim(F.coalesce(F.col("uid").cast("string"), F.lit(""))).alias("uid"), F.coalesce("action", F.lit("")).alias("action"), F.col("at").cast("long").alias("at"), F.col("tie").cast("long").alias("tie"))
    return named.repartition("uid", "action").sortWithinPartitions("uid", "action", "at", "tie").mapInPandas(run, LIMITED)


def throttled(updates: DataFrame, keys: list[str], order: str, percent: str, stage: str, step: float = 1.0, always: str | None = None, zero_is_none: bool = True) -> DataFrame:
    """updates with `pushed`: the first, a new stage, or a gain of `step` percent since the last one pushed.

    `always` names a column that is true for updates that are pushed whatever came before: forced or terminal ones.
    With zero_is_none a last percent of 0 counts as none, so an update at 0 follows another.
    """
    columns = [*keys, order, percent, stage, *([always] if always else [])]
    kinds = ", ".join(f"`{c}` {updates.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for pdf in batches:
            out = []
            forced = pdf[always] if always else [False] * len(pdf)
            for row, force in zip(zip(*[pdf[c] for c in [*keys, percent, stage]]), forced):
                if row[:-2] != key:
                    key, last = row[:-2], None
                push = bool(force) or last is None or row[-1] != last[1] or row[-2] - (last[0] or (-1 if zero_is_none else 0)) >= step
                if push:
                    last = row[-2:]
                out.append(push)
            yield pdf.assign(pushed=out)

    return updates.select(columns).repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, kinds + ", pushed boolean")


def unseen(events: DataFrame, seen: Column) -> DataFrame:
    return events.agg(F.count_if(F.coalesce(F.col("ts"), F.lit(0)) > seen).alias("unseen"))

import time

import pandas as pd
from pyspark.sql import functions as F

from quire.operators import usage
from quire.operators.usage import admission, admit
from quire.streaming import stateful
from quire.streaming.stateful import admitted, contiguous_uploads, metered


def run(query_df, mode, name, tmp_path, spark):
    q = query_df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(90)
    return spark.table(name)


def files(spark, df, path, n):
    df.repartition(n).write.parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", n).parquet(str(path))


def test_metering_and_admission_match_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    facts = events.select(F.col("user_id").alias("uid"), F.floor("value").alias("model_in_chars"))
    got = run(metered(files(spark, facts, tmp_path / "facts", 3), counters=["model_in_chars"]), "complete", "metered", tmp_path, spark)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, metered(facts, counters=["model_in_chars"]).collect()))
    calls = events.select("user_id", F.unix_timestamp("ts").alias("t"), "event_id")
    stream = files(spark, calls, tmp_path / "calls", 2)
    got = run(admitted(stream, "user_id", "t", 2, 86_400), "append", "admitted", tmp_path, spark)
    want = admission(calls, ["user_id"], "t", "event_id", 2, 86_400).drop("event_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("user_id", "t", "admitted").collect()))


def test_uploads(spark, tmp_path):
    parts = spark.createDataFrame(pd.DataFrame({"upload_id": ["a"] * 4 + ["b"], "offset": [0, 10, 10, 20, 5], "size": [10, 10, 3, 0, 5]}))
    got = run(contiguous_uploads(files(spark, parts, tmp_path / "parts", 1)), "append", "uploads", tmp_path, spark)
    assert sorted((r.upload_id, r.offset, r.outcome) for r in got.collect()) == [("a", 0, "ok"), ("a", 10, "offset_mismatch"), ("a", 10, "ok"), ("a", 20, "empty_chunk"), ("b", 5, "offset_mismatch")]


def test_admission_steps():
    assert admit([0, 5], 10, 2, 10, True) == (False, [0, 5])
    assert admit([0, 5], 10, 2, 10, False) == (True, [5, 10])


def test_limits_fan_out_decisions_and_events(spark, tmp_path):
    limits = {"redeem": (2, 86_400, True), "link": (1, 43_200, False)}
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    calls = events.select(F.when(F.col("event_id") % 7 == 0, " ").otherwise(F.col("user_id").cast("string")).alias("uid"), F.when(F.col("event_id") % 3 == 0, "redeem").when(F.col("event_id") % 3 == 1, "link").alias("action"), F.unix_timestamp("ts").alias("at"), F.col("event_id").alias("tie"))
    want = usage.limited(calls, limits).collect()
    paths = {what: str(tmp_path / what) for what in ("decision", "event")}
    stream = files(spark, calls, tmp_path / "calls", 2)
    q = stateful.limited(stream, limits).writeStream.outputMode("append").foreachBatch(stateful.fan_out(paths)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    for what, path in paths.items():
        got = spark.read.parquet(path).drop("batch")
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r)[1:]) for r in want if r.what == what)
    codes = {(r.what, r.code) for r in want}
    assert codes == {("decision", "ok"), ("decision", "rate_limited"), ("decision", "auth_required"), ("event", "redeem_rate_limited"), ("event", "link_rate_limited")}
    # A batch that runs again leaves nothing twice.
    once = spark.createDataFrame([("event", 1)], "what string, n int")
    for _ in range(2):
        stateful.fan_out({"event": str(tmp_path / "again")})(once, 7)
    assert spark.read.parquet(str(tmp_path / "again")).count() == 1


def test_a_plan_resumes_from_its_state(spark, tmp_path):
    """A query that ends half-way leaves its state; the next goes on from it, by new input or by the timer alone."""
    kinds = "doc string, ord long, sentence_id string, chunks array<string>, reason string, seconds double"
    path, out = tmp_path / "units", tmp_path / "out"

    def send(rows, pause, until):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(path))
        stream = spark.readStream.schema(kinds).parquet(str(path))
        q = stateful.built_plans(stream, 7.0, pause).writeStream.outputMode("append").format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            for _ in range(300):
                time.sleep(0.2)
                rows = spark.read.schema(stateful.BUILT).parquet(str(out)).collect() if (out / "_spark_metadata").exists() else []
                states = {r.doc: (r.status, r.error, r.done, r.total) for r in sorted((r for r in rows if r.what == "state"), key=lambda r: r.slice)}
                if states == until:
                    break
        finally:
            q.stop()
        assert states == until
        return sorted((r.doc, r.slice, r.flush, r.sentence_id) for r in rows if r.what == "built")

    unit = lambda doc, k, reason="ok": (doc, k, f"{doc}{k:02}", ["x", "x y"] if reason == "ok" else None, reason, 1.0)
    first = [unit("a", k) for k in range(12)] + [unit("b", 0), unit("b", 1, "bad_chunk_plan"), unit("b", 2)]
    built = send(first, 3_600_000, {"a": ("pending", None, 7, 12), "b": ("error", "bad_chunk_plan", 1, 3)})
    assert [x[1:3] for x in built if x[0] == "a"] == [(1, 0)] * 5 + [(1, 1)] * 2
    again = [unit("a", 0), unit("b", 1), unit("b", 0)] + [unit("c", k) for k in range(20)]
    built = send(again, 1, {"a": ("ok", None, 12, 12), "b": ("ok", None, 3, 3), "c": ("ok", None, 20, 20)})
    assert [x[3] for x in built] == [f"a{k:02}" for k in range(12)] + ["b00", "b01", "b02"] + [f"c{k:02}" for k in range(20)]
    assert {x[1] for x in built if x[0] == "c"} == {1, 2, 3}

"""Practice plans: growing chunks of each sentence, built in slices of limited time that resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.records import unfenced
from quire.functions.text import plain

# Longest sentence, most sentences of a plan, new sentences after which a slice is saved, bounds of a slice in seconds.
LONGEST, MOST, FLUSH = 2000, 400, 5
LEAST_SECONDS, MOST_SECONDS = 0.01, 240.0


def growing_chunks(chunks: Column, full: Column) -> Column:
    """Chunks that each extend the one before and end in the full text; null where they do not.

    A last chunk that starts the full text, or is started by it, is replaced by it; otherwise the full text is
    added. Repeated chunks are dropped.
    """
    last = F.element_at(chunks, -1)
    near = F.startswith(full, last) | F.startswith(last, full)
    ended = F.concat(F.when(near, F.slice(chunks, F.lit(1), F.size(chunks) - 1)).otherwise(chunks), F.array(full))
    distinct = F.filter(ended, lambda c, i: (i == 0) | (c != F.get(ended, i - 1)))
    grows = F.forall(F.sequence(F.lit(1), F.size(distinct) - 1), lambda i: F.startswith(F.get(distinct, i), F.get(distinct, i - 1)))
    return F.when((F.size(chunks) > 0) & ((F.size(distinct) == 1) | grows), distinct)


def answer_chunks(answer: Column, full: Column) -> Column:
    """Growing chunks of a model's answer, a JSON array of texts, fenced or not; null where it is anything else."""
    items = F.from_json(unfenced(answer), "array<variant>")
    texts = F.transform(items, lambda v: plain(v.cast("string")))
    usable = F.forall(items, lambda v: F.schema_of_variant(v) == "STRING") & F.forall(texts, lambda t: t != "")
    return F.when(usable, growing_chunks(texts, full))


def planned(sentences: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc, ord, sentence_id, text, chunks, reason, seconds): the plan of each sentence that has text.

    sentences: (doc, ord, sentence_id, text); answers: (doc, sentence_id, answer, error, seconds). A sentence of
    at most three words and under 40 characters needs no answer and takes no time.
    """
    full = F.substring(plain(F.col("text")), 1, LONGEST)
    rows = sentences.select("doc", "ord", "sentence_id", full.alias("text")).where("text <> ''")
    short = (F.size(F.split("text", " ")) <= 3) & (F.length("text") < 40)
    asked = rows.join(answers, ["doc", "sentence_id"], "left").withColumn("short", short)
    chunks = F.when(F.col("short"), F.array("text")).when(F.col("error").isNull(), answer_chunks(F.col("answer"), F.col("text")))
    reason = F.when(F.col("short"), "ok").when(F.col("error").isNotNull() | (F.trim(F.coalesce("answer", F.lit(""))) == ""), "model_unavailable")
    asked = asked.withColumn("chunks", chunks).withColumn("reason", reason.when(F.col("chunks").isNull(), "bad_chunk_plan").otherwise("ok"))
    return asked.select("doc", "ord", "sentence_id", "text", "chunks", "reason", F.when(F.col("short"), 0.0).otherwise(F.coalesce("seconds", F.lit(0.0))).alias("seconds"))


def plan_slice(units: DataFrame, stored: DataFrame, docs: DataFrame, seconds: float) -> tuple[DataFrame, DataFrame]:
    """One slice of every plan: new rows (doc, sentence_id, text, chunks, flush) and states (doc, status, error, done, total).

    units: planned sentences; stored: rows of earlier slices, which are not built again; docs: (doc). A document's
    sentences are taken in order while the time of those before, in this slice, is below `seconds`; the first
    one always is. A failure ends the plan's slice with status error and leaves what was built. Rows of one
    `flush` are saved together, five at a time, so a crash loses four at most.
    """
    limit = min(max(seconds, LEAST_SECONDS), MOST_SECONDS)
    before = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    todo = units.join(stored.select("doc", "sentence_id"), ["doc", "sentence_id"], "left_anti")
    spent, failed = F.coalesce(F.sum("seconds").over(before), F.lit(0.0)), F.coalesce(F.max(F.col("reason") != "ok").over(before), F.lit(False))
    reached = todo.withColumn("reached", (spent < limit) & ~failed).where("reached")
    number = F.row_number().over(Window.partitionBy("doc").orderBy("ord"))
    new = reached.where("reason = 'ok'").withColumn("flush", F.floor((number - 1) / FLUSH).cast("int")).select("doc", "sentence_id", "text", "chunks", "flush")
    errors = reached.where("reason <> 'ok'").groupBy("doc").agg(F.first("reason").alias("failure"))
    count = lambda df, name: df.groupBy("doc").agg(F.count(F.lit(1)).alias(name))
    built = count(stored.select("doc").unionAll(new.select("doc")), "done")
    states = docs.select("doc").join(count(units, "work"), "doc", "left").join(built, "doc", "left").join(errors, "doc", "left").fillna(0, ["work", "done"])
    error = F.when(F.col("work") > MOST, "bad_sentences").when(F.col("failure").isNotNull(), F.col("failure")).when((F.col("work") == 0) & (F.col("done") == 0), "no_sentences")
    status = F.when(error.isNotNull(), "error").when((F.col("work") > 0) & (F.col("done") >= F.col("work")), "ok").otherwise("pending")
    states = states.select("doc", status.alias("status"), error.alias("error"), "done", F.greatest("work", "done").alias("total"))
    crowded = states.where("error = 'bad_sentences'").select("doc")
    return new.join(crowded, "doc", "left_anti"), states

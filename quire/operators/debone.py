"""Cleaning of raw texts by a model: chunks are asked in rounds until each is answered or given up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.records import json_object, sentences_of, unfenced, whole_sentences
from quire.functions.rich import rich_plain, sanitize, with_glossary
from quire.operators.segment import assemble, is_sentence, missing_front_matter, section_name
from quire.sources.scratch import settled

#: Calls of a chunk in one pass; passes over all chunks before the front of a document is asked once more.
TRIES, PASSES = 3, 2
NO_FORMULAS = "array<struct<raw:string,rich:string>>"


def answered(answer: Column) -> Column:
    """Whether an answer is usable: JSON as a whole or between its braces, or cut off behind a complete record."""
    whole = F.try_parse_json(unfenced(answer)).isNotNull() | F.try_parse_json(json_object(answer)).isNotNull()
    return F.coalesce((F.trim(answer) != "") & (whole | (F.size(whole_sentences(answer)) > 0)), F.lit(False))


def _pass(pending: DataFrame, ask: Callable[[DataFrame], DataFrame], number: int, tries: int, name: str) -> DataFrame:
    """(doc, chunk, pass, try, ok, error, answer) of one pass over pending (doc, chunk, try, text): failed chunks
    enter the next round with the next try, and every round is a table of its own."""
    done = None
    for k in range(tries):
        got = ask(pending).select("doc", "chunk", "try", "answer", "error")
        ok = F.col("error").isNull() & answered(F.col("answer"))
        error = F.coalesce("error", F.when(F.col("answer").isNull(), "no_answer").otherwise("bad_json"))
        made = pending.join(got, ["doc", "chunk", "try"], "left").withColumn("ok", F.coalesce(ok, F.lit(False)))
        made = settled(made.withColumn("error", F.when(~F.col("ok"), error)).withColumn("pass", F.lit(number)), f"{name}-{number}-{k}")
        done = made if done is None else done.unionByName(made)
        failed = made.where(~F.col("ok"))
        if k + 1 == tries or failed.isEmpty():
            break
        pending = failed.select("doc", "chunk", (F.col("try") + 1).cast("int").alias("try"), "text")
    return done


def _last(attempts: DataFrame) -> DataFrame:
    """(doc, chunk, try, ok, answer): the last usable attempt of each chunk, else its last one."""
    best = F.max_by(F.struct("try", "ok", "answer"), F.struct("ok", "try")).alias("x")
    return attempts.groupBy("doc", "chunk").agg(best, F.max("try").alias("used")).select("doc", "chunk", "used", "x.ok", "x.answer")


def _sentences(results: DataFrame, formulas: DataFrame | None) -> DataFrame:
    rows = results.where("ok").select("doc", "chunk", F.posexplode(sentences_of(F.col("answer"))).alias("pos", "s"))
    rows = rows.select("doc", "chunk", "pos", sanitize(F.col("s.text")).alias("text"), section_name(F.col("s.section")).alias("section"))
    placed = assemble(rows.where(is_sentence(rich_plain(F.col("text")))), "doc", ["chunk", "pos"])
    if formulas is None:
        return placed
    known = placed.join(formulas, "doc", "left").withColumn("formulas", F.coalesce("formulas", F.array().cast(NO_FORMULAS)))
    return with_glossary(known).drop("formulas")


def debone(docs: DataFrame, chunks: DataFrame, ask: Callable[[DataFrame], DataFrame], formulas: DataFrame | None = None, tries: int = TRIES) -> tuple[DataFrame, DataFrame]:
    """Sentences (doc, ord, sentence_id, text, section) and outcomes (doc, ok, warning, chunks_ok, chunks_total).

    docs: (doc, text); chunks: (doc, chunk from 0, text); formulas: (doc, formulas). ask gets (doc, chunk, try, text)
    and returns (doc, chunk, try, answer, error) for what it could answer. Two passes of up to `tries` calls; where
    then no title, abstract or introduction is found although the text's head names one, the first half of the
    chunks is asked once more, and new answers replace the old. The bound of calls is the loop's bound.
    """
    pending, attempts = chunks.select("doc", "chunk", F.lit(1).alias("try"), "text"), None
    for number in range(1, PASSES + 1):
        made = _pass(pending, ask, number, tries, "debone")
        attempts = made if attempts is None else attempts.unionByName(made)
        last = _last(attempts)
        pending = last.where(~F.col("ok")).join(chunks, ["doc", "chunk"]).select("doc", "chunk", (F.col("used") + 1).cast("int").alias("try"), "text")
    last = settled(last, "debone-last")
    gave_up = last.groupBy("doc").agg(F.count_if(~F.col("ok")).alias("failed"))
    first = settled(_sentences(last, formulas), "debone-sentences")
    total = chunks.groupBy("doc").agg(F.count(F.lit(1)).alias("chunks_total"))
    # Nothing to add where no sentence was found at all.
    found = first.select("doc").distinct()
    lost = missing_front_matter(first, docs.join(found, "doc", "left_semi"), "doc").where("missing").select("doc")
    again = last.join(lost, "doc", "left_semi").join(total, "doc").where(F.col("chunk") < F.greatest(F.lit(1), F.floor((F.col("chunks_total") + 1) / 2)))
    again = settled(again.join(chunks, ["doc", "chunk"]).select("doc", "chunk", (F.col("used") + 1).cast("int").alias("try"), "text"), "debone-front")
    if not again.isEmpty():
        attempts = attempts.unionByName(_pass(again, ask, PASSES + 1, tries, "debone"))
        last = settled(_last(attempts), "debone-last")
        renewed = _sentences(last, formulas).join(lost, "doc", "left_semi")
        first = settled(first.join(lost, "doc", "left_anti").unionByName(renewed), "debone-sentences")
    # A chunk's pass ends in an error when its last call failed.
    ends = attempts.groupBy("doc", "chunk", "pass").agg(F.max_by(F.struct("ok", "error"), "try").alias("x")).where(~F.col("x.ok"))
    errors = ends.groupBy("doc").agg(F.max_by("x.error", F.struct("pass", "chunk")).alias("error"))
    front = missing_front_matter(first, docs, "doc").select("doc", "missing")
    good = last.groupBy("doc").agg(F.count_if(F.col("ok")).alias("chunks_ok"))
    rows = docs.select("doc").join(total, "doc", "left").join(good, "doc", "left").join(gave_up, "doc", "left").join(errors, "doc", "left").join(front, "doc", "left")
    rows = rows.join(first.groupBy("doc").agg(F.count(F.lit(1)).alias("n")), "doc", "left").fillna(0, ["chunks_total", "chunks_ok", "failed", "n"])
    partly = F.concat(F.lit("partial_debone:"), F.col("chunks_ok"), F.lit("/"), F.col("chunks_total"), F.coalesce(F.concat(F.lit(":"), "error"), F.lit("")))
    parts = F.concat_ws(";", F.when((F.col("failed") > 0) | (F.col("chunks_ok") < F.col("chunks_total")), partly), F.when(F.col("missing"), "missing_front_matter"))
    warning = F.when(F.col("chunks_total") == 0, "empty_text").when(F.col("n") == 0, F.coalesce("error", F.lit("no_sentences"))).otherwise(F.nullif(parts, F.lit("")))
    return first, rows.select("doc", (F.col("n") > 0).alias("ok"), warning.alias("warning"), "chunks_ok", "chunks_total")

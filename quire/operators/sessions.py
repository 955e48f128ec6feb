"""Reading sessions: display text, uploads, jobs, takes, revisions, views, bounded stores."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.refs import CITE_BRACKET, CITE_SUP, doi, doi_url, expand_numbers, scholar_url

# Sizes of uploads and stores, stages that can no longer be cancelled, voices and their weights.
CHUNK_BYTES, STORE_BYTES = 256 << 10, 2 << 20
LATE_STAGES = ("ready", "translate", "save", "shadowing_chunks", "done")
LOCALE_WEIGHTS = {
    "random_normal": [("en-US", 0.8), ("en-GB", 0.2)],
    "random_hard": [("en-US", 0.4), ("en-GB", 0.3), ("en-AU", 0.3)],
    "random_very_hard": [("en-US", 0.2), ("en-GB", 0.2), ("en-AU", 0.25), ("en-IN", 0.35)],
}


def display_text(html: Column) -> Column:
    """A sentence without its valid citation marks; invalid ones stay, spaces before punctuation go."""
    raw = F.coalesce(html, F.lit(""))
    sups = F.regexp_extract_all(raw, F.lit(f"({CITE_SUP})"), F.lit(1))
    sup = lambda h: F.when(F.regexp_extract(h, r"(\d+)", 1).cast("int").between(1, 999), "").otherwise(h)
    no_sup = F.array_join(F.zip_with(F.split(raw, CITE_SUP), sups, lambda t, h: F.concat(t, F.coalesce(sup(h), F.lit("")))), "")
    marks = F.regexp_extract_all(no_sup, F.lit(f"({CITE_BRACKET})"), F.lit(1))
    mark = lambda h: F.when(F.size(expand_numbers(F.regexp_extract(h, CITE_BRACKET, 1))) > 0, "").otherwise(h)
    bare = F.array_join(F.zip_with(F.split(no_sup, CITE_BRACKET), marks, lambda t, h: F.concat(t, F.coalesce(mark(h), F.lit("")))), "")
    tight = F.regexp_replace(bare, r"\s+([.,;:!?)])", "$1")
    return F.regexp_replace(F.regexp_replace(tight, r"\s{2,}", " "), r"^\s+|\s+$", "")


def resolve_citation(text: Column, found: Column) -> Column:
    """(url, source): the DOI in the text, else one that a lookup found, else a scholar search."""
    own = doi(text)
    url = F.coalesce(doi_url(own), doi_url(found), scholar_url(text))
    return F.struct(url.alias("url"), F.when(own.isNotNull(), "text").when(found.isNotNull(), "lookup").otherwise("search").alias("source"))


def chunk_step(received: int, offset: int, size: int, total: int | None, chunk: int = CHUNK_BYTES, agrees: bool = True) -> tuple[str, int]:
    """Outcome of one part of an upload that stands at `received`, and where it stands then; without a total its end is open."""
    end, ends = received + size, total is not None
    reason = (
        "upload_already_complete" if ends and received >= total > 0
        else "offset_mismatch" if offset != received
        else "empty_chunk" if size <= 0
        else "chunk_too_large" if size > chunk
        else "chunk_past_end" if ends and end > total
        else "chunk_size_mismatch" if ends and end < total and size != chunk
        else "chunk_hash_mismatch" if not agrees
        else "ok"
    )
    return reason, end if reason == "ok" else received


def append_chunks(parts: DataFrame, key: str = "upload_id", order: str = "seq", chunk: int = CHUNK_BYTES) -> DataFrame:
    """Parts (key, order, offset, size, total) in order, each accepted or with the first reason against it.

    Where parts have `digest` and `stated`, a stated digest must equal the part's own, in any case.
    The state of an upload is its received length, so parts are replayed as a stream per upload.
    """
    columns = [key, order, "offset", "size", "total"]
    kinds = ", ".join(f"`{c}` {parts.schema[c].dataType.simpleString()}" for c in columns)
    stated = F.lower(F.trim(F.col("stated"))) if "stated" in parts.columns else F.lit("")
    agrees = F.coalesce((stated == "") | (stated == F.col("digest")), F.lit(True)) if "stated" in parts.columns else F.lit(True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, received = None, 0
        for pdf in batches:
            outcomes, reached = [], []
            for upload, offset, size, total, same in zip(pdf[key], pdf["offset"], pdf["size"], pdf["total"], pdf["_same"]):
                if upload != last:
                    last, received = upload, 0
                reason, received = chunk_step(received, offset, size, total, chunk, same)
                outcomes.append(reason)
                reached.append(received)
            yield pdf[columns].assign(outcome=outcomes, received=reached)

    return parts.select(*columns, agrees.alias("_same")).repartition(key).sortWithinPartitions(key, order).mapInPandas(run, kinds + ", outcome string, received long")


def prefix_digests(parts: DataFrame, key: str = "upload_id", offset: str = "offset", data: str = "data") -> DataFrame:
    """(key, offset, prefix_sha256): digest of everything up to the end of each part, in one pass per upload."""
    kind = parts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for pdf in batches:
            out = []
            for upload, blob in zip(pdf[key], pdf[data]):
                if upload != last:
                    last, state = upload, hashlib.sha256()
                state.update(blob)
                out.append(state.hexdigest())
            yield pdf[[key, offset]].assign(prefix_sha256=out)

    return parts.select(key, offset, data).repartition(key).sortWithinPartitions(key, offset).mapInPandas(run, f"`{key}` {kind}, `{offset}` {parts.schema[offset].dataType.simpleString()}, prefix_sha256 string")


def job_state(updates: DataFrame, job: str = "job_id", order: str = "seq") -> DataFrame:
    """(job, percent, stage, seq, cancelled): the last update that counts of each job.

    Updates (job, order, percent, stage, kind) after the first `done` are ignored; a `cancel` stops later
    progress unless the job's stage was already late.
    """
    by = Window.partitionBy(job).orderBy(order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    late = F.coalesce(F.max(F.when(F.col("kind") == "progress", F.col("stage").isin(*LATE_STAGES))).over(before), F.lit(False))
    marked = updates.withColumn("_done", F.coalesce(F.max(F.col("kind") == "done").over(before), F.lit(False)))
    marked = marked.withColumn("_stop", (F.col("kind") == "cancel") & ~late)
    marked = marked.withColumn("_stopped", F.coalesce(F.max("_stop").over(before), F.lit(False)))
    counted = marked.where(~F.col("_done") & ~F.col("_stopped"))
    last = counted.groupBy(job).agg(
        F.max_by(F.struct(F.greatest(F.least("percent", F.lit(100)), F.lit(0)).alias("percent"), "stage", F.col(order)), F.when(F.col("kind") != "cancel", F.col(order))).alias("s"),
        F.bool_or("_stop").alias("cancelled"),
    )
    return last.select(job, F.col("s")["percent"].alias("percent"), F.col("s")["stage"].alias("stage"), F.col("s")[order].alias(order), "cancelled")


def takes_of(events: DataFrame, sentence: str = "sentence_id", chunks: str = "chunk_count") -> DataFrame:
    """(sentence, slots, full_pass) from take events (sentence, chunk_count, chunk_index, seq, status, blob_key): the last of each slot."""
    last = events.groupBy(sentence, "chunk_index").agg(F.max_by(F.struct("status", "blob_key"), "seq").alias("s"), F.max(chunks).alias("_n"))
    made = last.groupBy(sentence).agg(F.map_from_entries(F.collect_list(F.struct("chunk_index", "s"))).alias("m"), F.max("_n").alias("n"), F.max("chunk_index").alias("top"))
    empty = F.struct(F.lit("empty").alias("status"), F.lit(None).cast("string").alias("blob_key"))
    slots = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.col("top"))), lambda i: F.coalesce(F.try_element_at("m", i), empty))
    from quire.operators.jobs import full_pass

    return made.select(sentence, slots.alias("slots"), "n").select(sentence, "slots", full_pass(F.col("slots"), F.col("n")).alias("full_pass"))


def listen_list(takes: DataFrame, wanted: DataFrame, sentence: str = "sentence_id") -> DataFrame:
    """(ord, sentence, blobs): fully recorded sentences in the wanted order, with the blobs of their slots."""
    full = takes.where("full_pass").select(sentence, F.transform("slots", lambda s: s["blob_key"]).alias("blobs"))
    return wanted.join(full, sentence).select("ord", sentence, "blobs")


def migrate_notes(notes: DataFrame) -> DataFrame:
    """Old notes (paper, map of sentence to text) as first revisions."""
    return notes.select("paper", F.explode("texts").alias("sid", "body")).where(F.trim("body") != "").select("paper", "sid", F.lit("text").alias("kind"), F.lit(1).alias("rev"), "body")


def append_voice(revisions: DataFrame, new: DataFrame, note: list[str], order: str) -> DataFrame:
    """Voice revisions with the new ones behind them, numbered on from the last."""
    last = revisions.groupBy(*note).agg(F.max("rev").alias("_last"))
    numbered = new.join(last, note, "left").withColumn("rev", F.row_number().over(Window.partitionBy(*note).orderBy(order)) + F.coalesce("_last", F.lit(0)))
    return revisions.unionByName(numbered.drop("_last").select(revisions.columns))


def section_sentences(sentences: DataFrame, doc: str, section: str) -> DataFrame:
    """(doc, section, ids): ids of each section in reading order."""
    found = sentences.groupBy(doc, section).agg(F.sort_array(F.collect_list(F.struct("ord", "sentence_id"))).alias("all"))
    return found.select(doc, section, F.transform("all", lambda s: s["sentence_id"]).alias("ids"))


def iso_seconds(stamp: Column) -> Column:
    """Seconds of an ISO time; times without a zone are UTC; null where it is none."""
    zoned = F.regexp_replace(F.trim(stamp), "Z$", "+00:00")
    fixed = F.when(zoned.rlike(r"[+-]\d{2}:\d{2}$"), zoned).otherwise(F.concat(zoned, F.lit("+00:00")))
    return F.unix_seconds(F.try_to_timestamp(fixed))


def pick_locale(mode: Column, draw: Column) -> Column:
    """The locale that a draw in [0, 1] falls to under a mode's weights."""
    out = F.when(F.lit(False), F.lit("en-US"))
    for name, weights in LOCALE_WEIGHTS.items():
        total = 0.0
        for locale, weight in weights:
            total += weight
            out = out.when((mode == name) & (draw <= total), locale)
        out = out.when(mode == name, weights[-1][0])
    return out.otherwise("en-US")


def voice_pool(voices: Column, locale: Column, default: str = "en-US-Neural2-C") -> Column:
    """Voices of a locale, else of en-US, else all of them."""
    of = lambda place: F.filter(voices, lambda v: F.startswith(v, F.concat(place, F.lit("-"))))
    return F.when(F.size(of(locale)) > 0, of(locale)).when(F.size(of(F.lit("en-US"))) > 0, of(F.lit("en-US"))).when(F.size(voices) > 0, voices).otherwise(F.array(F.lit(default)))


def audio_mime(mime: Column) -> Column:
    return F.trim(F.split(F.lower(F.trim(F.coalesce(mime, F.lit("")))), ";")[0])


def audio_allowed(mime: Column) -> Column:
    base = audio_mime(mime)
    return base.startswith("audio/") & (F.length(base) < 64)


def within(store: Column, most: int = STORE_BYTES) -> Column:
    """A store as JSON, null where it is larger than allowed."""
    text = F.to_json(store)
    return F.when(F.octet_length(text) <= most, text)


def read_store(raw: Column, schema: str, most: int = STORE_BYTES) -> Column:
    """A store from its bytes, null where they are empty, more than allowed, or no JSON object."""
    text = raw.cast("string")
    whole = F.is_valid_utf8(text) & F.try_parse_json(text).isNotNull() & F.startswith(F.trim(text), F.lit("{"))
    return F.when(F.octet_length(raw).between(1, most) & F.coalesce(whole, F.lit(False)), F.from_json(text, schema))


def digest_map(raw: Column) -> Column:
    """Section digests with missing sides blank and blank entries gone."""
    whole = F.transform_values(raw, lambda _, v: F.struct(F.trim(F.coalesce(v["en"], F.lit(""))).alias("en"), F.trim(F.coalesce(v["ko"], F.lit(""))).alias("ko")))
    return F.map_filter(whole, lambda _, v: (v["en"] != "") | (v["ko"] != ""))


def open_rule(remote_ready: Column, remote_has: Column, local_sentences: Column) -> Column:
    """What opening a paper does: refresh first where the remote is reachable, refuse empty sessions."""
    return F.when(remote_ready & remote_has, "refresh").when(remote_ready & ~remote_has, "not_found").when(local_sentences > 0, "local").otherwise("empty")


def translation_status(text: Column, mode: Column, most: int = 4000) -> Column:
    bare = F.trim(F.coalesce(text, F.lit("")))
    return F.when(~mode.isin("fast", "staged"), "mode").when(bare == "", "empty").when(F.length(bare) > most, "too_long").otherwise("ok")

"""What callers see of stored records, and small stores with a bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States that may use paid features; words of an admin's decision; bounds of stores and files.
PAID = ("allowed", "byok")
DECISIONS = {"allowed": ("allow", "allowed", "approve", "approved"), "denied": ("deny", "denied", "reject", "rejected")}
SESSIONS_KEPT, MEMO_KEPT, INVITES_KEPT, USERS_OVER, USERS_KEPT, EVENTS_KEPT = 8, 256, 2000, 5000, 4000, 2000
SOURCE_BYTES, EVENT_BYTES = 80 << 20, 4 << 20
RESUME_LABELS = {
    "extract": "추출", "cache": "보관본", "quality": "품질", "vision": "비전", "figures": "그림", "debone": "다듬기", "split": "문장 나누기", "ready": "읽기 준비",
    "translate": "번역", "save": "저장", "shadowing_chunks": "연습 구간",
}


def _blank(c) -> Column:
    return F.coalesce(c, F.lit(""))


def session_rows(sentences: DataFrame, figures: DataFrame, images: DataFrame, doc: str) -> DataFrame:
    """(doc, kind, no, text, image): sentences with a text, and all figures, whose caption stays where the image is missing.

    sentences has (doc, no, text), figures (doc, no, caption, image_ref), images (image_ref, image).
    """
    read = sentences.where(F.trim(_blank(F.col("text"))) != "").select(doc, F.lit("sentence").alias("kind"), "no", "text", F.lit("").alias("image"))
    shown = figures.join(images, "image_ref", "left").select(doc, F.lit("figure").alias("kind"), "no", F.col("caption").alias("text"), _blank(F.col("image")).alias("image"))
    return read.unionByName(shown)


def public_figures(figures: DataFrame, include_images: bool = True) -> DataFrame:
    """Figures as callers see them; without images their place is blank."""
    out = {"image": F.col("image") if include_images else F.lit(""), "caption_ko": _blank(F.col("caption_ko"))}
    return figures.select(*[out.get(c, F.col(c)).alias(c) for c in figures.columns])


def public_upload(rows: DataFrame, chunk: int = 256 << 10) -> DataFrame:
    """Uploads as their owner sees them: no owner, no digests of parts."""
    number = lambda c, d=0: F.coalesce(F.col(c).cast("long"), F.lit(d)).alias(c)
    text = lambda c: _blank(F.col(c)).alias(c)
    return rows.select(text("upload_id"), text("content_hash"), text("filename"), number("size"), number("chunk_size", chunk), number("received_offset"), text("prefix_sha256"), F.coalesce("complete", F.lit(False)).alias("complete"))


def public_access(status: Column, gate_on: Column, is_admin: Column) -> Column:
    """(status, effective, can_use_paid) of an account behind the access gate."""
    known = F.coalesce(status, F.lit("none"))
    open_, admin = ~gate_on, gate_on & is_admin
    shown = F.when(admin & (known == "none"), "allowed").otherwise(known)
    return F.struct(shown.alias("status"), F.when(open_, "open").when(admin, "admin").otherwise(known).alias("effective"), (open_ | admin | known.isin(*PAID)).alias("can_use_paid"))


def decided(uid: Column, decision: Column, known: Column) -> Column:
    """The new state of an account after an admin's decision, or the first reason against it."""
    word = F.lower(F.trim(_blank(decision)))
    out = F.when(~F.coalesce(F.trim(uid).rlike(r"^[A-Za-z0-9_\-:.]{1,128}$"), F.lit(False)), "bad_uid")
    out = out.when(~word.isin(*[w for words in DECISIONS.values() for w in words]), "bad_decision").when(~known, "user_not_found")
    return out.when(word.isin(*DECISIONS["allowed"]), "allowed").otherwise("denied")


def own_usage(usage: DataFrame, uid: str, email: str) -> DataFrame:
    """The caller's row of a usage report, a blank address filled in."""
    return usage.where(F.col("uid") == uid).withColumn("email", F.when(_blank(F.col("email")) == "", email).otherwise(F.col("email")))


def model_usage(prompt: Column, answer: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """(in, out) of a model call: its token counts if it has any, else characters; without output tokens, the answer's characters."""
    a, b = (F.coalesce(c, F.lit(0)).cast("long") for c in (tokens_in, tokens_out))
    counted = (a != 0) | (b != 0)
    chars = F.length(_blank(answer)).cast("long")
    return F.struct(F.when(counted, a).otherwise(F.length(_blank(prompt)).cast("long")).alias("in"), F.when(counted & (b != 0), b).otherwise(chars).alias("out"))


def last_inserted(rows: DataFrame, by: list[str], order: list, keep: int) -> DataFrame:
    """The `keep` rows inserted last of each group: sessions of a registry, minted invites."""
    if not by:  # a distributed top-k
        return rows.orderBy(*[F.desc(c) for c in order]).limit(keep)
    newest = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= keep).drop("_k")


def memo_left(puts: DataFrame, order: str, by: list[str], most: int = MEMO_KEPT) -> DataFrame:
    """Distinct keys that a memo of `most` entries holds after all puts, where a full memo drops its older half first."""
    half = most // 2
    rank = Window.partitionBy(*by).orderBy(order)
    numbered = puts.withColumn("_i", F.row_number().over(rank)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    # The memo is full at `most`, then after every further half.
    left = F.when(F.col("_n") <= most, F.col("_n")).otherwise(half + 1 + F.pmod(F.col("_n") - most - 1, F.lit(half)))
    return numbered.where(F.col("_i") > F.col("_n") - left).drop("_i", "_n")


def event_log(events: DataFrame, order: list[str], keep: int = EVENTS_KEPT, most: int = EVENT_BYTES, by: list[str] | None = None) -> DataFrame:
    """The newest `keep` events of each log; where their JSON lines exceed `most` bytes, the newer half of them."""
    by = by or []
    kept = last_inserted(events, by, order, keep)
    line = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in events.columns]))) + 1
    whole = Window.partitionBy(*by)
    sized = kept.withColumn("_bytes", F.sum(line).over(whole)).withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_k", F.row_number().over(whole.orderBy(*[F.desc(c) for c in order])))
    return sized.where((F.col("_bytes") <= most) | (F.col("_k") <= F.ceil(F.col("_n") / 2))).drop("_bytes", "_n", "_k")


def known_limits(rows: DataFrame, actions: list[str], over: int = USERS_OVER, keep: int = USERS_KEPT) -> DataFrame:
    """Stored stamps (uid, action, stamps, pos) of known actions; of more than `over` users the last `keep` inserted."""
    known = rows.where(F.col("action").isin(*actions))
    users = known.groupBy("uid").agg(F.max("pos").alias("_p"))
    # Too many users or not is one row; the newest are a distributed top-k.
    count = users.agg((F.count(F.lit(1)) > over).alias("_over"))
    newest = users.orderBy(F.desc("_p"), "uid").limit(keep).select("uid", F.lit(True).alias("_new"))
    marked = known.join(newest, "uid", "left").crossJoin(F.broadcast(count))
    return marked.where(~F.col("_over") | F.col("_new")).select(rows.columns)


def seen_mark(marks: DataFrame, by: list[str]) -> DataFrame:
    """(by, seen): how far each admin has read, 0 where never."""
    return marks.groupBy(*by).agg(F.coalesce(F.max("ts"), F.lit(0)).alias("seen"))


def attach_sources(entries: DataFrame, files: DataFrame, key: str = "id", most: int = SOURCE_BYTES) -> DataFrame:
    """entries with has_source and source_file: a file of allowed size is taken where there was none, a pdf before a docx."""
    name = lambda c: F.concat(F.lit("source."), F.when(F.lower(c).isin("pdf", "docx"), F.lower(c)).otherwise("pdf"))
    fit = files.where((F.col("size") > 0) & (F.col("size") <= most)).groupBy(key).agg(F.max(name(F.col("kind"))).alias("_f"))
    joined = entries.join(fit, key, "left")
    return joined.withColumn("source_file", F.coalesce("source_file", "_f")).withColumn("has_source", F.col("source_file").isNotNull()).drop("_f")


def resume_label(stage: Column, done: Column, total: Column) -> Column:
    """What a poll says about where a job goes on."""
    names = F.create_map(*[F.lit(x) for pair in RESUME_LABELS.items() for x in pair])
    bare = F.trim(_blank(stage))
    label = F.coalesce(F.try_element_at(names, bare), F.when(bare == "", "처리").otherwise(bare))
    place = F.when(F.coalesce(total, F.lit(0)) > 0, F.concat(F.lit(" "), F.coalesce(done, F.lit(0)).cast("string"), F.lit("/"), total.cast("string"))).otherwise("")
    return F.concat(F.lit("이어받을 지점 유지 · "), label, place)


def upload_result(size: Column, received: Column, content: Column, content_hash: Column) -> Column:
    """Whether an upload may be used: the first reason against it, or ok."""
    digest = F.sha2(content, 256)
    starts = F.coalesce(F.substring(content, 1, 4) == F.lit(b"%PDF"), F.lit(False))
    return (
        F.when(received != size, "upload_incomplete")
        .when(content.isNull() | (F.octet_length(content) != size), "assemble_failed")
        .when(digest != F.lower(_blank(content_hash)), "content_hash_mismatch")
        .when((size >= 5) & ~starts, "invalid_pdf")
        .otherwise("ok")
    )


def single_chunk(text: Column, most: int = 2000) -> Column:
    """(reason, chunks): a short sentence is one practice chunk, a blank one an error, any other waits for an answer."""
    full = F.substring(F.trim(F.regexp_replace(_blank(text), r"\s+", " ")), 1, most)
    short = (F.size(F.split(full, " ")) <= 3) & (F.length(full) < 40)
    return F.struct(F.when(full == "", "empty_sentence").when(short, "ok").otherwise("ask").alias("reason"), F.when((full != "") & short, F.array(full)).alias("chunks"))


def resume_sentences(payload: Column) -> Column:
    """Sentences of a stored JSON payload; entries without an id are dropped, missing texts are blank."""
    kind = "array<struct<id:string,text:string,section:string,start_char:int,end_char:int,text_ko:string,text_ko_stage:string>>"
    rows = F.coalesce(F.from_json(payload, kind), F.array().cast(kind))
    named = F.filter(rows, lambda s: F.trim(_blank(s["id"])) != "")
    blank = lambda s, c: _blank(s[c]).alias(c)
    return F.transform(named, lambda s: F.struct(F.trim(s["id"]).alias("id"), blank(s, "text"), s["section"].alias("section"), s["start_char"].alias("start_char"), s["end_char"].alias("end_char"), blank(s, "text_ko"), blank(s, "text_ko_stage")))


def lease_after(until: Column, beat: Column, seconds: int = 90) -> Column:
    """A lease's end after a heartbeat: `seconds` on while it holds, unchanged once it ran out."""
    return F.when(until.isNotNull() & (until > beat), beat + seconds).otherwise(until)


def may_reclaim(done: Column, error: Column, until: Column, now: Column) -> Column:
    """Whether another worker may take a job over: unfinished, and its lease is gone."""
    return ~F.coalesce(done, F.lit(False)) & (_blank(error) == "") & (until.isNull() | (until <= now))


def usable_session(sentences: DataFrame, doc: str) -> DataFrame:
    """(doc, usable): whether a stored session has a sentence with a text."""
    return sentences.groupBy(doc).agg(F.coalesce(F.bool_or(F.trim(_blank(F.col("text"))) != ""), F.lit(False)).alias("usable"))


def cached_translations(requests: DataFrame, cache: DataFrame, mode: str = "mode", text: str = "text") -> DataFrame:
    """requests with their key, status and cached answer: key is the mode's prefix and the text's digest."""
    from quire.operators.sessions import translation_status

    bare = F.trim(_blank(F.col(text)))
    keyed = requests.withColumn("key", F.concat(F.col(mode), F.lit(":"), F.sha2(bare.cast("binary"), 256))).withColumn("_s", translation_status(F.col(text), F.col(mode)))
    found = keyed.join(cache.select("key", F.col("answer")), "key", "left")
    return found.withColumn("status", F.when((F.col("_s") == "ok") & F.col("answer").isNotNull(), "cached").otherwise(F.col("_s"))).drop("_s")


def caption_digest(captions: DataFrame, digests: DataFrame, doc: str) -> DataFrame:
    """captions with the digest they are translated under: the body's, else the first section's by order."""
    order = F.struct((F.col("section") != "body").cast("int").alias("k"), "ord")
    chosen = digests.where(_blank(F.col("digest")) != "").groupBy(doc).agg(F.min_by("digest", order).alias("digest"))
    return captions.join(chosen, doc, "left")


def playback_rate(rate: Column) -> Column:
    """A speech rate held between 0.5 and 2.2; 1 where there is none."""
    return F.greatest(F.lit(0.5), F.least(F.lit(2.2), F.coalesce(F.nanvl(rate, F.lit(1.0)), F.lit(1.0))))

"""Catalogs kept in several replicas: merging, matching, retention, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.grams import anchored, sieve
from quire.sources.scratch import settled

# Status ranks of invites; lengths that make a title key usable; sizes of stores.
INVITE_RANK = {"redeemed": 4, "revoked": 3, "expired": 2, "open": 1}
LEAST_KEY, HEAD_CHARS = 24, 14_000
LIBRARY_CAP = 1000
#: Characters of an anchor within the first 24 of a key.
LEAD_GRAM = 12


def _first(df: DataFrame, by: list, order: list) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rank = 1").drop("_rank")


def merge_library(entries: DataFrame) -> DataFrame:
    """Entries (replica, pos, id, title_key, source, updated_at, ...) merged.

    The newest of each id wins, the later replica and position at ties; then the newest of each
    (title_key, source), where a blank key stays apart.
    """
    later = [F.desc("updated_at"), F.desc("replica"), F.desc("pos")]
    seen = entries.withColumn("_seen", F.min(F.struct("replica", "pos")).over(Window.partitionBy("id")))
    by_id = _first(seen, ["id"], later)
    alone = F.when(F.col("title_key") == "", F.col("id"))
    return _first(by_id.withColumn("_alone", alone), ["title_key", "source", "_alone"], [F.desc("updated_at"), F.desc("_seen")]).drop("_alone", "_seen")


def merge_invites(rows: DataFrame) -> DataFrame:
    """Rows (replica, hash, status, created_at, redeemed_at, ...): the strongest status of each hash, newest at ties."""
    ranks = F.create_map(*[F.lit(x) for pair in INVITE_RANK.items() for x in pair])
    rank = F.coalesce(F.try_element_at(ranks, F.col("status")), F.lit(0))
    return _first(rows, ["hash"], [rank.desc(), F.coalesce("redeemed_at", "created_at").desc_nulls_last(), F.desc("replica")])


def merge_events(rows: DataFrame, keep: int = 500) -> DataFrame:
    """Events (replica, pos, ts, type, uid, message) without repeats, the last `keep` of all by time."""
    distinct = _first(rows, ["ts", "type", "uid", "message"], ["replica", "pos"])
    return distinct.orderBy(F.desc("ts"), F.desc("replica"), F.desc("pos")).limit(keep)


def merge_stamps(a: Column, b: Column, cutoff: Column, keep: int = 40) -> Column:
    """Union of two stamp lists from cutoff on, sorted, the last `keep`."""
    union = F.array_sort(F.array_distinct(F.filter(F.concat(F.coalesce(a, F.array()), F.coalesce(b, F.array())), lambda t: t >= cutoff)))
    return F.slice(union, F.greatest(F.size(union) - keep + 1, F.lit(1)), keep)


def merge_notes(revisions: DataFrame) -> DataFrame:
    """Note revisions (replica, paper, sid, kind, pos, at, rev, body, blob_key, mime) merged and renumbered.

    Equal content at equal time is one revision; the rest is ordered by (at, rev).
    """
    content = F.when(F.col("kind") == "text", F.struct(F.col("body").alias("a"), F.lit("").alias("b"))).otherwise(F.struct(F.col("blob_key").alias("a"), F.col("mime").alias("b")))
    keyed = revisions.withColumn("_c", content)
    note = ["paper", "sid", "kind"]
    one = _first(keyed, [*note, "at", "_c"], ["replica", "pos"])
    order = Window.partitionBy(*note).orderBy("at", "rev", "replica", "pos")
    return one.withColumn("rev", F.row_number().over(order)).drop("_c")


def text_revisions(edits: DataFrame, note: list[str], at: str, body: str, last: DataFrame | None = None) -> DataFrame:
    """Edits that change the right-trimmed text, numbered on from the last (note, rev, body) of each note, else from 1."""
    order = Window.partitionBy(*note).orderBy(at)
    trimmed = edits.withColumn("_b", F.rtrim(body))
    known = last.select(*note, F.col("rev").alias("_rev"), F.rtrim(body).alias("_old")) if last is not None else None
    trimmed = trimmed.join(known, note, "left") if known is not None else trimmed.withColumn("_rev", F.lit(0)).withColumn("_old", F.lit(None).cast("string"))
    before = F.when(F.row_number().over(order) == 1, F.col("_old")).otherwise(F.lag("_b").over(order))
    changed = trimmed.withColumn("_last", before).where(~F.col("_b").eqNullSafe(F.col("_last")))
    return changed.withColumn("rev", F.row_number().over(order) + F.coalesce("_rev", F.lit(0))).select(*note, "rev", at, F.col("_b").alias(body))


def latest_revision(revisions: DataFrame, note: list[str], body: str) -> DataFrame:
    return revisions.groupBy(*note).agg(F.max_by(body, "rev").alias(body), F.max("rev").alias("rev"))


def tenant_listing(local: DataFrame, remote: DataFrame, key: str = "id") -> DataFrame:
    """Local entries that the tenant's remote index knows, as stale where the remote is newer."""
    known = remote.select(F.col(key), F.col("updated_at").alias("_remote"))
    return local.join(known, key).withColumn("stale", F.col("_remote") > F.col("updated_at")).drop("_remote")


def ordered_library(papers: DataFrame, order: DataFrame, owner: str, key: str = "id", server: str = "server_pos") -> DataFrame:
    """papers with place, per owner: those without a saved position first, in server order, then by saved position."""
    saved = papers.join(order.select(owner, key, "pos"), [owner, key], "left").withColumn("_known", F.col("pos").isNotNull())
    return saved.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy("_known", "pos", server))).drop("_known")


def match_titles(docs: DataFrame, catalog: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, id, title_key): for each head the longest catalog key it contains; the earliest entry at ties.

    docs has (doc, head, source), heads being title keys; catalog has (id, pos, title_key, source). A head that
    contains a key of at least 24 characters has the anchor of the key's first 24 among its own, one place in
    seven or so, with the same characters around it. So narrow rows meet by an equi-join on anchors, the 24
    characters are compared inside the join, and what is left is verified on the whole head. Heads and keys are
    written first, as they are read twice and making them is the dear part. Of equal keys only the earliest entry
    can be an answer. Places whose anchor no key has are sieved out where they are found: of all places, which are
    several times the text, few are shuffled.
    """
    heads = settled(docs.select(doc, "source", "head"), "heads")
    once = catalog.groupBy("source", "title_key").agg(F.min(F.struct("pos", "id")).alias("_e")).select("_e.id", "_e.pos", "source", "title_key")
    keys = settled(anchored(once.withColumn("lead", F.col("title_key")), "lead", LEAST_KEY, LEAD_GRAM, first=True), "keys")
    places = anchored(heads, "head", LEAST_KEY, LEAD_GRAM, among=sieve(keys.select("anchor"), keys.count()))
    keys = keys.select("id", "pos", "source", "title_key", "anchor", F.col("at").alias("before"), F.substring("title_key", 1, LEAST_KEY).alias("lead"), F.col("rest").alias("need"), F.col("marks").alias("wanted"))
    same = (F.col("at") >= F.col("before")) & (F.substr("near", F.col("at") - F.col("before") + 1, F.lit(LEAST_KEY)) == F.col("lead"))
    # Keys that run on differently, as those of near copies do, are told apart by a hash before they meet whole heads.
    same &= (F.col("need") <= F.col("rest")) & ((F.size("wanted") == 0) | (F.try_element_at("wanted", F.lit(-1)) == F.try_element_at("marks", F.size("wanted"))))
    # Rows of places are many times what the optimizer takes them for.
    candidates = places.hint("merge").join(keys, ["anchor", "source"]).where(same).select(doc, "id", "pos", "title_key").join(heads.select(doc, "head"), doc)
    found = candidates.where(F.contains("head", "title_key"))
    return _first(found, [doc], [F.desc(F.length("title_key")), "pos"]).select(doc, "id", "title_key")


def newest(rows: DataFrame, order: list, keep: int = LIBRARY_CAP, by: list[str] | None = None) -> DataFrame:
    """The `keep` first rows by order, of each group of `by` if given; without groups a distributed top-k."""
    if not by:
        return rows.orderBy(*order).limit(keep)
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= keep).drop("_rank")


def upsert(catalog: DataFrame, entry: DataFrame, pos: str | None = None) -> DataFrame:
    """catalog with entry's rows put in, replacing rows of the same id or the same (title_key, source).

    With `pos`, the column of places, new entries stand before all others: their places are negative.
    """
    kept = catalog.join(entry.select("id"), "id", "left_anti").join(entry.select("title_key", "source"), ["title_key", "source"], "left_anti")
    new = entry if pos is None else entry.withColumn(pos, -F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id")).cast(catalog.schema[pos].dataType))
    return new.select(catalog.columns).unionByName(kept.select(catalog.columns))


def deleted_entries(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entries that requests (id, title_key, source) name: by id, else by title key and source."""
    by_id = catalog.join(wanted.select("id"), "id", "left_semi")
    rest = wanted.join(catalog.select("id"), "id", "left_anti").select("title_key", "source")
    return by_id.unionByName(catalog.join(rest, ["title_key", "source"], "left_semi").select(catalog.columns)).distinct()


def delete_cascade(child: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return child.join(deleted.select(key), key, "left_anti")


def evict_oldest(entries: DataFrame, keep: int = LIBRARY_CAP, pos: str = "pos") -> DataFrame:
    """The `keep` entries made last, by creation else update time; at ties the later place stays."""
    made = F.coalesce("created_at", "updated_at", F.lit(""))
    return newest(entries.where(F.coalesce("id", F.lit("")) != ""), [made.desc(), F.desc(pos)], keep)


def publish(remote: DataFrame, local: DataFrame) -> DataFrame:
    """The remote index after an upload of local entries: both replicas merged, the remote first at ties."""
    return merge_library(remote.withColumn("replica", F.lit(0)).unionByName(local.withColumn("replica", F.lit(1))))


def cache_hit(pipeline: Column, current: str, source: Column, figures: Column) -> Column:
    """Whether a stored paper may be reused: same pipeline, and a docx must have figures."""
    return (pipeline == current) & ((source != "docx") | (figures > 0))


def library_list(entries: DataFrame, current: str) -> DataFrame:
    """Entries for a list, newest first, with `stale` where an older pipeline made them."""
    shown = entries.select("id", "title", "source", "updated_at", "sentences", "figures", (~F.col("pipeline_version").eqNullSafe(F.lit(current))).alias("stale"))
    return shown.orderBy(F.desc("updated_at"), "id")


def merge_stamp_stores(rows: DataFrame, key: str = "uid", keep: int = 40, users: int | None = 4000, over: int = 5000) -> DataFrame:
    """(uid, stamps) from rows (uid, t): distinct stamps in order, the last `keep`; of too many users the newest, or all if users is None."""
    newest = Window.partitionBy(key).orderBy(F.desc("t"))
    last = rows.select(key, "t").distinct().withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= keep)
    stores = last.groupBy(key).agg(F.array_sort(F.collect_list("t")).alias("stamps"))
    if users is None:
        return stores
    # One row more than allowed tells whether only the newest users stay; nothing beyond it is gathered.
    top = stores.orderBy(F.element_at("stamps", -1).desc(), key).limit(over + 1)
    place = F.row_number().over(Window.orderBy(F.element_at("stamps", -1).desc(), key))
    all_of = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = top.withColumn("_place", place).withColumn("_all", F.count(F.lit(1)).over(all_of))
    return kept.where((F.col("_all") <= over) | (F.col("_place") <= users)).drop("_place", "_all")

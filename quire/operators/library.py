"""The library on disk: sessions saved together with their index, and bundles of two stores brought in line."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import title_key
from quire.operators.catalog import LEAST_KEY, LIBRARY_CAP, evict_oldest, upsert
from quire.sources.readers import data_url

# Kinds of sources, and the sizes of files that a bundle may hold.
SOURCES = ("pdf", "docx")
MOST_BYTES = {"session": 5_000_000, "figure": 8_000_000, "source": 80_000_000}
INDEX = "id string, pos long, title string, title_key string, source string, created_at string, updated_at string, sentences long, figures long, content_hash string"


def session_entries(sessions: DataFrame, index: DataFrame, batch: Column | str, now: Column) -> DataFrame:
    """Index entries of sessions (title, source, content_hash, sentences, figures), the last two being counts.

    A session needs a title key of at least LEAST_KEY characters and a sentence. An entry of the same key and
    source keeps its id and creation time; a new id is drawn from the key, the source and the batch, so a batch
    that runs again names the same. Of several sessions of one key and source in a batch the one with most
    sentences counts, then the first by title.
    """
    kind = F.when(F.lower(F.col("source")).isin(*SOURCES), F.lower(F.col("source"))).otherwise("pdf")
    digest = F.lower(F.trim(F.coalesce("content_hash", F.lit(""))))
    named = sessions.select(F.trim("title").alias("title"), title_key(F.col("title")).alias("title_key"), kind.alias("source"), F.when(digest.rlike("^[a-f0-9]{64}$"), digest).alias("content_hash"), F.col("sentences").cast("long").alias("sentences"), F.col("figures").cast("long").alias("figures"))
    usable = named.where((F.length("title_key") >= LEAST_KEY) & (F.col("sentences") > 0))
    best = usable.groupBy("title_key", "source").agg(F.min_by(F.struct("title", "content_hash", "sentences", "figures"), F.struct((-F.col("sentences")).alias("n"), "title", F.coalesce("content_hash", F.lit("")).alias("h"), "figures")).alias("s"))
    known = index.groupBy("title_key", "source").agg(F.min_by(F.struct("id", F.coalesce("created_at", "updated_at").alias("made")), F.struct("pos", "id")).alias("k"))
    batch = F.lit(batch) if isinstance(batch, str) else batch
    fresh = F.substring(F.sha2(F.concat_ws("|", "title_key", "source", batch.cast("string")), 256), 1, 12)
    rows = best.join(known, ["title_key", "source"], "left")
    return rows.select(
        F.coalesce("k.id", fresh).alias("id"), F.lit(0).cast("long").alias("pos"), "s.title", "title_key", "source", F.coalesce("k.made", now).alias("created_at"), now.alias("updated_at"), "s.sentences", "s.figures", "s.content_hash",
    )


def index_after(index: DataFrame, entries: DataFrame, keep: int = LIBRARY_CAP) -> DataFrame:
    """The index once entries are put in front of it; only the `keep` made last stay."""
    return evict_oldest(upsert(index, entries, "pos"), keep)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def current_index(spark: SparkSession, root: str) -> DataFrame:
    """The index that the newest pointer names; without a pointer it is empty."""
    try:
        pointers = spark.read.schema("seq long, batch string").parquet(f"{root}/pointers/*")
    except AnalysisException:
        return spark.createDataFrame([], INDEX)
    last = pointers.orderBy(F.desc("seq"), F.desc("batch")).limit(1).collect()
    return spark.read.schema(INDEX).parquet(f"{root}/versions/{last[0].batch}/index")


def save_sessions(root: str, batch: str, seq: int, sessions: DataFrame, now: str, keep: int = LIBRARY_CAP) -> bool:
    """Save a batch of sessions (title, source, content_hash, sentences: array of (id, text, section), figures: count).

    Three writes, each whole or not there: the sentences and the new index into a folder of the batch's own,
    then the pointer. A run that ends before the pointer leaves the old index in force, and its folder is
    written anew by the next run; a batch whose pointer is there changes nothing, and False is returned.
    Batches are numbered by `seq`; the highest number is in force.
    """
    spark = sessions.sparkSession
    pointer, version = f"{root}/pointers/{batch}", f"{root}/versions/{batch}"
    if _exists(spark, f"{pointer}/_SUCCESS"):
        return False
    index = current_index(spark, root)
    counted = sessions.withColumn("body", F.col("sentences")).withColumn("sentences", F.size("body"))
    entries = session_entries(counted, index, batch, F.lit(now))
    bodies = counted.select(title_key(F.col("title")).alias("title_key"), F.when(F.lower("source").isin(*SOURCES), F.lower("source")).otherwise("pdf").alias("source"), F.trim("title").alias("title"), F.col("sentences").cast("long").alias("sentences"), "body")
    chosen = bodies.join(entries.select("id", "title_key", "source", "title", "sentences"), ["title_key", "source", "title", "sentences"]).dropDuplicates(["id"])
    chosen.select(F.col("id").alias("paper_id"), F.posexplode("body").alias("ord", "s")).select("paper_id", "ord", "s.*").write.mode("overwrite").parquet(f"{version}/sentences")
    index_after(index, entries, keep).select([c.split()[0] for c in INDEX.split(", ")]).write.mode("overwrite").parquet(f"{version}/index")
    spark.createDataFrame([(seq, batch)], "seq long, batch string").coalesce(1).write.mode("overwrite").parquet(pointer)
    return True


def safe_name(name: Column) -> Column:
    """Whether a file's name stays inside its bundle: session.json, source.pdf, source.docx or figures/<plain name>."""
    return F.coalesce(name.rlike(r"^(session\.json|source\.(pdf|docx)|figures/[A-Za-z0-9_][A-Za-z0-9_.\-]*)$") & ~F.contains(name, F.lit("..")), F.lit(False))


def figure_image(figures: DataFrame, images: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cache_id, figure_id, image): one data URL a request, null where the ids are none, the figure is unknown or has no image.

    figures: (cache_id, figure_id, file); images: (cache_id, file, content, mime). Only files named figures/... inside
    the paper's own folder are given out.
    """
    ids = F.coalesce(F.trim("cache_id").rlike("^[a-zA-Z0-9]{8,32}$") & F.trim("figure_id").rlike(r"^[A-Za-z0-9._\-]{1,64}$"), F.lit(False))
    asked = wanted.select("cache_id", "figure_id", F.when(ids, F.trim("cache_id")).alias("c"), F.when(ids, F.trim("figure_id")).alias("f")).distinct()
    path = F.replace(F.coalesce("file", F.lit("")), F.lit("\\"), F.lit("/"))
    confined = F.startswith(path, F.lit("figures/")) & ~F.array_contains(F.split(path, "/"), "..")
    # The first file of an id counts, confined or not.
    first = figures.groupBy(F.col("cache_id").alias("c"), F.col("figure_id").alias("f")).agg(F.min_by(F.when(confined, path), F.coalesce("file", F.lit(""))).alias("path"))
    held = images.groupBy(F.col("cache_id").alias("c"), F.col("file").alias("path")).agg(F.first(F.struct("content", "mime")).alias("i"))
    found = asked.join(first, ["c", "f"], "left").join(held, ["c", "path"], "left")
    return found.select("cache_id", "figure_id", F.when(F.col("i").isNotNull(), data_url(F.col("i.content"), F.col("i.mime"))).alias("image"))


def _room(name: Column) -> Column:
    return F.when(name == "session.json", MOST_BYTES["session"]).when(F.startswith(name, F.lit("figures/")), MOST_BYTES["figure"]).otherwise(MOST_BYTES["source"])


def sync_plan(local: DataFrame, remote: DataFrame, local_index: DataFrame, remote_index: DataFrame) -> DataFrame:
    """(id, name, direction, action, digest) that brings the bundles of two stores in line.

    Listings are (id, name, digest, bytes), indexes (id, updated_at). A bundle goes from the store with the newer
    update time to the other; of two that both have its session with one time, it is in line. A store without the
    session gives none. Only plain names within their sizes are copied, replaced where the digest differs or the other copy does not fit, or kept;
    what the giving store lacks or may not give is deleted.
    """
    fit = lambda df: safe_name(F.col("name")) & F.col("bytes").between(1, _room(F.col("name")))
    sides = (("l", local, local_index), ("r", remote, remote_index))
    listed = [df.select("id", "name", "digest", F.lit(p).alias("side"), fit(df).alias("fit"), F.lit(None).alias("at")).where("name IS NOT NULL") for p, df, _ in sides]
    stamped = [ix.select("id", F.lit(None).alias("name"), F.lit(None).alias("digest"), F.lit(p).alias("side"), F.lit(False).alias("fit"), F.col("updated_at").alias("at")) for p, _, ix in sides]
    rows = reduce(DataFrame.unionByName, listed + stamped).where("id IS NOT NULL").repartition("id")
    # One shuffle by bundle, no join: what a store lists or stamps is a column, and a bundle's update times and sessions are seen from each of its files.
    of = lambda p, value: F.max(F.when(F.col("side") == p, value))
    files = rows.groupBy("id", "name").agg(*[of(p, F.when(F.col("name").isNotNull(), F.struct("digest", "fit"))).alias(p) for p in "lr"], *[of(p, F.col("at")).alias(f"at_{p}") for p in "lr"])
    bundle = Window.partitionBy("id")
    has_l, has_r = (F.coalesce(F.max((F.col("name") == "session.json") & F.col(f"{p}.fit")).over(bundle), F.lit(False)) for p in "lr")
    l, r = (F.coalesce(F.max(f"at_{p}").over(bundle), F.lit("")) for p in "lr")
    seen = files.withColumns({"has_l": has_l, "has_r": has_r, "later_l": l > r, "later_r": r > l}).where("name IS NOT NULL AND (has_l OR has_r)")
    direction = F.when(~F.col("has_r") | (F.col("has_l") & F.col("later_l")), "up").when(~F.col("has_l") | F.col("later_r"), "down")
    files = seen.select("id", "name", "l", "r", direction.alias("direction")).where("direction IS NOT NULL")
    give, have = F.when(F.col("direction") == "up", F.col("l")).otherwise(F.col("r")), F.when(F.col("direction") == "up", F.col("r")).otherwise(F.col("l"))
    files = files.withColumn("give", give).withColumn("have", have)
    given = F.coalesce(F.col("give.fit"), F.lit(False))
    action = F.when(given & F.col("have").isNull(), "copy").when(given & (~F.col("give.digest").eqNullSafe(F.col("have.digest")) | ~F.col("have.fit")), "replace").when(given, "keep").when(F.col("have").isNotNull(), "delete")
    return files.select("id", "name", "direction", action.alias("action"), F.when(given, F.col("give.digest")).alias("digest")).where("action IS NOT NULL")


def listing_after(listing: DataFrame, plan: DataFrame, other: DataFrame, direction: str) -> DataFrame:
    """What a store lists once the plan's actions towards it are done; direction is up for the remote store."""
    towards = plan.where(F.col("direction") == direction)
    gone = towards.where("action IN ('replace', 'delete', 'copy')").select("id", "name")
    new = towards.where("action IN ('copy', 'replace')").select("id", "name").join(other, ["id", "name"])
    return listing.join(gone, ["id", "name"], "left_anti").unionByName(new.select(listing.columns))


def stamps_after(plan: DataFrame, index: DataFrame, other: DataFrame, direction: str) -> DataFrame:
    """Update times of a store once the plan is done: bundles it was given take the giver's."""
    given = plan.where(F.col("direction") == direction).select("id").distinct()
    return index.join(given, "id", "left_anti").select("id", "updated_at").unionByName(other.join(given, "id").select("id", "updated_at"))

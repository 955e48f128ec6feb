"""One document of each group of near copies: five-word shingles, SimHash classes, min-hash bands, exact verification.

The shingle set of a text is the set of XXH64 hashes of its five-word windows (a shorter text is one
shingle, a blank one has none). Two texts are near copies when the Jaccard similarity of their sets is at
least 0.8. Rows with equal sets collapse first. Candidates share a bucket. The first buckets are the
classes of op9's operator: SimHash fingerprints, here majorities over the hashes of the set, linked within 3
bits through correlated bit groups and joined to components, so two fingerprints within 3 bits always meet.
Fingerprints of texts at 0.8 differ in about 10 bits, which no affordable radius reaches; what they miss meets
in one of 20 bands of five min-hashes: a pair at 0.8 is missed by these with odds (1 - 0.8^5)^20, 0.04 %. Every
candidate is verified on the whole sets, so no row is dropped on a sketch alone.

Each bucket is first compared with its centre, the node whose bands are shared most (in a group of edited
copies the least edited one), so a large group of close copies costs its size. What the stars leave in different groups is bounded before it is compared. Only shingles that occur in
two groups can be shared by texts of different groups; call them a text's common ones, i of them in the
bucket's centre and e outside it. Two texts share at most min(i, i') + min(e, e'), and need 4/9 of their joint
size. A text that cannot reach that with its bucket's smallest text and largest e leaves the bucket; pairs
that cannot reach it are never formed; the others are verified. No bound is estimated, so no link is lost.
Buckets of many texts are dealt over tasks. Groups are the connected components of verified pairs.

Rows are told apart by a key of their own, never by their id. Whether a key is chosen travels as a bitmap
(one bit a row), so texts are never shuffled.

Defined cases: null and blank texts are one group; repeated and null ids are ordinary rows; of a group the
row with the smallest id stays (null last), of equal ids the first row; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm._shared import bound_batches, keep_keys, materialise, spare_name, ticked
from quire.llm.simhash import SEED, components, fingerprint_classes, majority

SHINGLE = 5
BANDS, ROWS = 20, 5
#: Rows of a bucket that one task compares with the whole bucket.
BUCKET_ROWS = 4096
#: Least similarity of near copies, as a fraction.
LEAST = (4, 5)
_FACTORS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word windows of one text: A-Z lower-cased, words as in SimHash."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    return np.unique(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64))


def band_values(hashes: np.ndarray) -> list[int]:
    """One signed long a band, from the least products of the hashes with fixed odd factors."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 512):
        np.minimum(low, (hashes[at : at + 512, None] * _FACTORS).min(0), out=low)
    found = [xxh64_intdigest(low[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(found, np.uint64).view(np.int64).tolist()


def _sketches(batches):
    from xxhash import xxh3_128_digest

    for b in batches:
        sets = [shingle_set(t) for t in b.column(2).to_pylist()]
        prints = np.fromiter(map(majority, sets), np.uint64, len(sets)).view(np.int64)
        columns = [pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints), pa.array([band_values(s) for s in sets], pa.list_(pa.int64()))]
        yield pa.record_batch([b.column(0), b.column(1), *columns], names=["key", "id", "digest", "n", "fp", "bands"])


def _sets(batches):
    for b in batches:
        found = [shingle_set(t).view(np.int64) for t in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "s"])


def _enough(shared: Column, of: Column) -> Column:
    return LEAST[1] * shared >= LEAST[0] * of


def _joint(shared: Column, sizes: Column) -> Column:
    """Whether sets of these summed sizes are near copies if they share so much: shared / (sizes - shared) >= LEAST."""
    return (LEAST[0] + LEAST[1]) * shared >= LEAST[0] * sizes


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the pairs whose sets are similar enough."""
    first, second = sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(first.hint("merge"), "a").join(second.hint("merge"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(_enough(common, F.size("sa") + F.size("sb") - common)).select("a", "b")


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with the root of each one's component."""
    found = materialise(components(links), "components")
    return nodes.join(found.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _of_many_groups(members: DataFrame, *more: Column) -> DataFrame:
    """The rows of buckets that hold several roots, with `more` aggregates of their bucket."""
    mixed = members.groupBy("v").agg(F.min("root").alias("low"), F.max("root").alias("high"), *more).where("low < high").drop("low", "high")
    return members.join(mixed.hint("merge"), "v")


def _common_parts(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(c, node, i, e): of each node's shingles that occur in several groups, how many are in centre c and how many are not."""
    nodes = members.select("node", "root").distinct()
    tokens = nodes.join(sets.hint("merge"), "node").select("node", "root", F.explode("s").alias("t"))
    common = tokens.groupBy("t").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("t")
    held = tokens.select("node", "t").join(common.hint("merge"), "t").groupBy("node").agg(F.collect_list("t").alias("own"))
    held = materialise(held, "common")
    centres = sets.select(F.col("node").alias("c"), "s")
    met = members.select("node", "c").distinct().join(held.hint("merge"), "node").join(centres.hint("merge"), "c")
    i = F.size(F.array_intersect("own", "s"))
    return met.select("c", "node", i.alias("i"), (F.size("own") - i).alias("e"))


def _pairs_left(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the pairs of nodes that share a bucket, are in different groups, and may be similar; members is (v, c, node, n, root)."""
    parts = materialise(_common_parts(members, sets), "parts")
    known = members.join(parts.hint("merge"), ["c", "node"])
    bounded = _of_many_groups(known, F.min("n").alias("least"), F.max("e").alias("most"))
    reach = F.col("i") + F.least("e", "most")
    able = bounded.where(_joint(reach, F.col("n") + F.col("least"))).select("v", "node", "n", "root", "i", "e")
    able = materialise(_of_many_groups(able, F.count(F.lit(1)).alias("of")), "able")
    splits = F.ceil(F.col("of") / BUCKET_ROWS).cast("int")
    named = lambda x, part: able.select("v", part.alias("part"), *[F.col(c).alias(c + x) for c in ("node", "n", "root", "i", "e")])
    one, two = named("a", F.pmod(F.xxhash64("node"), splits).cast("int")), named("b", F.explode(F.sequence(F.lit(0), splits - 1)))
    near = _joint(F.least("ia", "ib") + F.least("ea", "eb"), F.col("na") + F.col("nb")) & _enough(F.least("na", "nb"), F.greatest("na", "nb"))
    met = one.join(two.hint("merge"), ["v", "part"]).where((F.col("nodea") < F.col("nodeb")) & (F.col("roota") != F.col("rootb")) & near)
    return met.select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct()


def near_links(nodes: DataFrame, sets_of) -> DataFrame:
    """(a, b) verified near copies that connect every group; nodes is (node, n, fp, bands)."""
    some = nodes.where("n > 0")  # a text without shingles resembles no other
    classes = fingerprint_classes(some.select("node", "n", "fp")).select("node", "n", F.col("root").alias("v"))
    buckets = classes.unionByName(some.select("node", "n", F.explode("bands").alias("v")))
    sizes = buckets.groupBy("v").agg(F.count(F.lit(1)).alias("of")).where("of > 1")
    crowded = materialise(buckets.join(sizes.hint("merge"), "v"), "crowded")
    known = crowded.join(crowded.groupBy("node").agg(F.sum("of").alias("fame")).hint("merge"), "node")
    centre = known.groupBy("v").agg(F.min(F.struct((-F.col("fame")).alias("less"), "node", "n")).alias("c")).select("v", F.struct("c.node", "c.n").alias("c"))
    shared = materialise(crowded.select("v", "node", "n").join(centre.hint("merge"), "v").select("v", "node", "n", "c"), "buckets")
    sets = materialise(sets_of(shared.select("node").distinct()), "sets")
    star = shared.where("node <> c.node").select(F.col("c.node").alias("a"), F.col("node").alias("b"), F.col("c.n").alias("na"), F.col("n").alias("nb"))
    fits = _enough(F.least("na", "nb"), F.greatest("na", "nb"))
    links = materialise(verified(star.where(fits).select("a", "b").distinct(), sets), "star-links")
    open_ = materialise(_of_many_groups(_rooted(shared.select("v", F.col("c.node").alias("c"), "node", "n"), links)), "open")
    return links.unionByName(materialise(verified(_pairs_left(open_, sets), sets), "rest-links"))


def keep_unlike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies, columns unchanged."""
    bound_batches(docs.sparkSession)
    key = spare_name(docs, "row_key")
    keyed = materialise(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = keyed.select(ticked(key).alias("key"), ticked(id_col).alias("id"), ticked(text_col).cast("string").alias("text"))
    rows = narrow.mapInArrow(_sketches, f"key long, id {kind}, digest binary, n long, fp long, bands array<long>")
    head = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "key"))
    nodes = rows.groupBy("digest").agg(F.min("key").alias("node"), head.alias("head"), F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands"))
    nodes = materialise(nodes.drop("digest"), "nodes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        return keep_keys(narrow, "key", wanted.withColumnRenamed("node", "key")).select("key", "text").mapInArrow(_sets, "node long, s array<long>")

    links = near_links(nodes.select("node", "n", "fp", "bands"), sets_of)
    kept = _rooted(nodes.select("node", "head"), links).groupBy("root").agg(F.min("head").alias("head")).select(F.col("head.key").alias("key"))
    return keep_keys(keyed, key, kept).drop(key)

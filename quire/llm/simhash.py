"""SimHash near-duplicate classes by a generalised pigeonhole over correlated bit groups.

Fingerprints are majorities over the XXH64 hashes of three-word shingles. Equal fingerprints collapse
first, so copies never meet each other. The 64 bits are then grouped so that correlated bits share a
partition; each partition gets its own Hamming threshold, chosen by dynamic programming on candidate
counts that are measured over all fingerprints. Thresholds sum to `radius - partitions + 1`, so two
fingerprints within `radius` bits agree up to the threshold in at least one partition. Every fingerprint
is indexed by its exact partition values and probed with all values within the threshold; candidates are
verified on all 64 bits inside the join. Links feed a star-contraction component search whose state is
written to the shared scratch folder every round.

Defined cases: null or blank texts have fingerprint zero and link like any other; equal texts share one
fingerprint; a null id takes part as a text but never names a component while another id does; an empty
table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm._shared import bound_batches, keep_keys, materialise, spare_name, ticked

BITS = 64
SHINGLE = 3
SEED = 42


def fingerprint_of(text: str | None) -> int:
    """Unsigned 64-bit SimHash of one text: A-Z lower-cased, words, three-word shingles with repeats."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    return majority(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Unsigned 64-bit number of the bits that are set in over half the hashes."""
    set_in = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches):
    for b in batches:
        fps = np.fromiter(map(fingerprint_of, b.column(1).to_pylist()), np.uint64, b.num_rows)
        yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per row of docs; fp is the fingerprint as a signed long."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(ticked(id_col).alias("id"), ticked(text_col).cast("string").alias("text")).mapInArrow(
        _fingerprint_batches, f"id {kind}, fp long"
    )


def _pair_counts(batches):
    total = np.zeros((BITS, BITS))
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        for at in range(0, len(bits), 1 << 16):
            part = bits[at : at + (1 << 16)]
            total += part.T @ part
    i, j = np.triu_indices(BITS)
    yield pa.record_batch(
        [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j].astype(np.int64))], names=["i", "j", "n"]
    )


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and how often bits i and j are both set, over every row of fps (a 64 x 64 summary)."""
    counts = fps.select("fp").mapInArrow(_pair_counts, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((BITS, BITS))
    for r in counts:
        both[r.i, r.j] = both[r.j, r.i] = r.n
    return fps.count(), both


def group_bits(rows: int, both: np.ndarray, partitions: int) -> list[list[int]]:
    """Deal the bits into equal-width groups so that strongly correlated bits share one.

    Each group is seeded with the free bit of the largest total correlation and grown greedily by the
    free bit most correlated with the group.
    """
    p = np.diag(both) / max(rows, 1)
    sd = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    corr = np.abs(both / max(rows, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for k in range(partitions):
        width = BITS // partitions + (k < BITS % partitions)
        group = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < width:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def part_value(fp: Column, bits: list[int]) -> Column:
    """The bits of one group, gathered into a small number (bit k of the value is bits[k])."""
    out = None
    for k, b in enumerate(bits):
        one = F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1).cast("long")), k)
        out = one if out is None else out.bitwiseOR(one)
    return out


@dataclass(frozen=True)
class Plan:
    """groups[i] is probed within thresholds[i]; a threshold of -1 leaves the group out."""

    groups: list[list[int]]
    thresholds: list[int]
    cost: float


def allocate(groups: list[list[int]], equal_pairs: list[float], agree: np.ndarray, rows: int, radius: int) -> Plan:
    """Thresholds with the least estimated work, by dynamic programming.

    equal_pairs[i] is the measured number of ordered pairs with equal values in group i. Pairs within t
    bits are estimated from it by the odds that single bits disagree (elementary symmetric sums). Work is
    candidates plus probe rows.
    """
    budget, states = radius - len(groups) + 1, {0: (0.0, [])}
    for bits, pairs in zip(groups, equal_pairs, strict=True):
        odds = (1 - agree[bits]) / agree[bits]
        sums = np.zeros(radius + 1)
        sums[0] = 1.0
        for r in odds:
            sums[1:] = sums[1:] + r * sums[:-1]
        costs = {-1: 0.0}
        for t in range(radius + 1):
            probes = sum(comb(len(bits), k) for k in range(t + 1))
            costs[t] = pairs * float(sums[: t + 1].sum()) / 2 + rows * float(probes + 1)
        following: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in states.items():
            for t, c in costs.items():
                key, now = spent + t, cost + c
                if key not in following or now < following[key][0]:
                    following[key] = (now, [*chosen, t])
        states = following
    cost, chosen = states[budget]
    return Plan(groups, chosen, cost)


def plan_partitions(fps: DataFrame, radius: int = 3, choices: tuple[int, ...] = (2, 3, 4)) -> Plan:
    """The cheapest plan among some numbers of groups, from statistics of every distinct fingerprint."""
    rows, both = bit_statistics(fps)
    p = np.diag(both) / max(rows, 1)
    agree = np.clip(p * p + (1 - p) * (1 - p), 0.05, 1.0)
    groupings = {m: group_bits(rows, both, m) for m in choices if m <= radius + 1}
    values = [F.struct(F.lit(m * 100 + k).alias("g"), part_value(F.col("fp"), g).alias("v")) for m, gs in groupings.items() for k, g in enumerate(gs)]
    found = (
        fps.select(F.explode(F.array(*values)).alias("x"))
        .groupBy("x.g", "x.v")
        .count()
        .groupBy("g")
        .agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs"))
        .collect()
    )
    pairs = {r.g: r.pairs for r in found}
    plans = [allocate(gs, [pairs.get(m * 100 + k, 0.0) for k in range(m)], agree, rows, radius) for m, gs in groupings.items()]
    return min(plans, key=lambda x: x.cost)


def _probe_values(group: int, value: Column, masks: list[int]) -> Column:
    flips = F.array(*[F.lit(m).cast("long") for m in masks])
    return F.transform(flips, lambda m: F.struct(F.lit(group).alias("g"), value.bitwiseXOR(m).alias("v")))


def links(fps: DataFrame, plan: Plan, radius: int = 3) -> DataFrame:
    """(a, b): pairs of distinct fingerprints within radius bits, a < b; a pair may come twice."""
    indexed, probes = [], []
    for k, (bits, t) in enumerate(zip(plan.groups, plan.thresholds, strict=True)):
        if t < 0:
            continue
        value = part_value(F.col("fp"), bits)
        masks = [sum(1 << b for b in some) for n in range(t + 1) for some in combinations(range(len(bits)), n)]
        indexed.append(F.struct(F.lit(k).alias("g"), value.alias("v")))
        probes.append(_probe_values(k, value, masks))
    index = fps.select(F.col("fp").alias("b"), F.explode(F.array(*indexed)).alias("x")).select("b", "x.g", "x.v")
    probe = fps.select(F.col("fp").alias("a"), F.explode(F.concat(*probes)).alias("x")).select("a", "x.g", "x.v")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    i, p = index.alias("i"), probe.alias("p")
    return p.join(i, (F.col("p.g") == F.col("i.g")) & (F.col("p.v") == F.col("i.v")) & close).select("a", "b")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node reachable.

    Alternating large-star and small-star steps; each round's edges are written to the scratch folder.
    A node's smallest neighbour comes from a pre-aggregated minimum, then is joined back to its edges, so
    a centre with very many neighbours is split over tasks by the join.
    """
    now = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    last = None
    for _ in range(max_rounds):
        state = now.agg(F.count(F.lit(1)), *[F.sum(c.cast("decimal(38,0)")) for c in (F.col("a"), F.col("b"), F.xxhash64("a", "b"))]).first()
        if state == last or not state[0]:
            break
        last = state
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        now = materialise(
            small.select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(low.select(F.col("m").alias("x"), F.col("b").alias("y"))).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "links",
        )
    else:
        raise RuntimeError("component search did not settle")
    stars = now.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _rooted(distinct: DataFrame, radius: int) -> DataFrame:
    """distinct, one row per fingerprint, with the root fingerprint of each one's class."""
    plan = plan_partitions(distinct, radius)
    linked = materialise(components(links(distinct, plan, radius)), "components")
    return distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def fingerprint_classes(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """nodes, which has the fingerprint fp, with the root fingerprint of each one's class; equal fingerprints collapse first."""
    distinct = materialise(nodes.select("fp").distinct(), "distinct")
    return nodes.join(_rooted(distinct, radius).hint("merge"), "fp")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """(id, fp, component): one row per row of docs; component is the smallest id of its class."""
    rows = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialise(rows.groupBy("fp").agg(F.min("id").alias("least_id")), "distinct")
    named = _rooted(distinct, radius)
    least = named.groupBy("root").agg(F.min("least_id").alias("component"))
    # Only linked fingerprints differ from their own smallest id.
    classes = named.join(least, "root").select("fp", "component")
    return rows.join(classes, "fp", "left").select("id", "fp", "component")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """docs with one row of each class kept: of the rows with its smallest id (null last), the first.

    Rows are told apart by a key of their own, so ids may repeat or be null.
    """
    key = spare_name(docs, "row_key")
    keyed = materialise(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    prints = materialise(fingerprints(keyed, key, text_col).withColumnRenamed("id", "key"), "fingerprints")
    ids = keyed.select(ticked(key).alias("key"), ticked(id_col).alias("id"))
    head = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "key")).alias("head")
    distinct = materialise(prints.join(ids.hint("merge"), "key").groupBy("fp").agg(head), "distinct")
    kept = _rooted(distinct, radius).groupBy("root").agg(F.min("head").alias("head")).select(F.col("head.key").alias("key"))
    return keep_keys(keyed, key, kept).drop(key)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    from quire.llm._shared import table

    found = near_duplicate_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))

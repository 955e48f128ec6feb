"""Exact top-k by inner product over a pivot-distance index.

Vectors are quantised to integers. With M the largest norm, a vector gets one more coordinate,
sqrt(M^2 - |v|^2), and a query gets zero there; then all vectors have norm M and a larger inner product is
a smaller distance, so the triangle inequality bounds scores. Each vector is keyed by its nearest pivot
and its distance from it. Keys sorted by (pivot, distance) form annuli, stored as blocks of bounded rows.

A query first scores the annulus that its own distance falls into at its nearest pivot, which gives a k-th
best score. Around every pivot the sorted annuli are then expanded from the query's own distance outwards;
expansion stops at the first annulus whose bound, from | d(query, pivot) - d(vector, pivot) |, lies below
that score. What remains is scored block by block. Bounds are widened for rounding, so ties at the k-th
score are never lost.

Annuli are cut at quantiles of the distances around their pivot, so that each holds about RING_ROWS vectors
or, in a large table, a MOST_RINGS-th of all: a query is sent to every annulus that may serve it, so their number
bounds what is shuffled. The directory of annuli has at most MOST_RINGS + PIVOTS rows and is the only thing
broadcast. Queries are read in blocks; what is sent to an annulus is the queries of a
block that it may serve, and no others. Queries and vectors meet by a join on (pivot, ring, part): the blocks
of an annulus that many equal vectors fill are dealt over parts. Vectors are stored in the least of 2, 4 and 8
bytes a component that holds all of the table.

Defined cases: null vectors, and vectors with a null or non-finite component, take no part, nor do vectors
whose squared norm reaches 2^62 (a component of 2.1 million), as their scores might not fit a long; shorter vectors are padded with zeros; rows that share the query's id are not its candidates, and a repeated
query id is one query, by the vector of the smallest stored bytes; repeated candidates each count; fewer than k candidates give fewer ranks; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm._shared import materialise, table, ticked

SCALE = 1024
PIVOTS = 48
#: Rows from which pivots are chosen: those with the smallest digests of their ids.
PIVOT_SAMPLE = 2048
RINGS = 256
#: Annuli of a table, apart from one more a pivot.
MOST_RINGS = 256
#: Vectors an annulus should hold at least, and blocks of an annulus that one task scores at least.
RING_ROWS, PART_BLOCKS = 1024, 8
BLOCK_ROWS, QUERY_ROWS = 1024, 256
#: Vectors a partition of the index holds at most.
PARTITION_ROWS = 200_000
#: Scores are exact in doubles below this bound on a sum of products; beyond it integers are used.
EXACT = 2.0**52


def _matrix(column: pa.Array, width: int, item: int, items: pa.Array | None = None) -> np.ndarray:
    """Stored vectors as rows of `item` bytes a component; items: the bytes in which each is stored, if others."""
    out = np.zeros((len(column), width), f"<i{item}")
    sizes = items.to_pylist() if items is not None else [item] * len(column)
    for k, (raw, size) in enumerate(zip(column.to_pylist(), sizes, strict=True)):
        v = np.frombuffer(raw, f"<i{size}")
        out[k, : len(v)] = v
    return out


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _quantised(batches):
    for b in batches:
        lists = b.column(1)
        x = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))  # nulls are NaN
        length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.cumsum(length) - length
        known = lists.is_valid().to_numpy(zero_copy_only=False) & b.column(0).is_valid().to_numpy(zero_copy_only=False)
        for n in np.unique(length[known]):
            rows = np.flatnonzero(known & (length == n))
            m = x[start[rows][:, None] + np.arange(n)]
            with np.errstate(all="ignore"):
                norm = (m * m).sum(1)
            keep = np.isfinite(m).all(1) & (norm < 2.0**62)
            rows, m, norm = rows[keep], m[keep], norm[keep]
            far = np.maximum(m, -1 - m).max(1, initial=0)
            item = np.where(far < 2.0**15, 2, np.where(far < 2.0**31, 4, 8))
            for size in np.unique(item):
                at = item == size
                q = m[at].astype(f"<i{size}")
                yield pa.record_batch([b.column(0).take(pa.array(rows[at])), _bytes(q), pa.array(item[at].astype(np.int32)), pa.array(norm[at])], names=["vec_id", "v", "item", "norm"])


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to count rows of the sample, each farthest from those before it."""
    if not len(sample):
        return sample
    x = sample.astype(float)
    at, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(at) < min(count, len(x)) and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(1))
    return sample[at]


class Geometry:
    """Pivots and norms, and the distances of vectors and queries from every pivot."""

    def __init__(self, pivots: np.ndarray, largest: float):
        self.pivots, self.largest = pivots.astype(float), largest
        self.lift = np.sqrt(np.maximum(largest - (self.pivots**2).sum(1), 0))
        #: Widens every bound: distances carry rounding errors of a few units in the last place of M^2.
        self.slack = 1.0 + largest * 1e-9

    def of_vectors(self, v: np.ndarray) -> np.ndarray:
        x = v.astype(float)
        lift = np.sqrt(np.maximum(self.largest - (x * x).sum(1), 0))
        return np.sqrt(np.maximum(2 * self.largest - 2 * (x @ self.pivots.T + np.outer(lift, self.lift)), 0))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        x = q.astype(float)
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + self.largest - 2 * (x @ self.pivots.T), 0))

    def best_score(self, q: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Upper bound of the scores of vectors at least `gap` away; q's rows against gap's."""
        x = q.astype(float)
        return ((x * x).sum(1)[:, None] + self.largest - gap**2) / 2 + self.slack


def _keyed(shared, width: int, item: int):
    def run(batches):
        g: Geometry = shared.value
        for b in batches:
            m = _matrix(b.column(1), width, item, b.column(2))
            d = g.of_vectors(m)
            cell = d.argmin(1)
            dist = d[np.arange(len(d)), cell]
            yield pa.record_batch([b.column(0), _bytes(m), pa.array(cell.astype(np.int32)), pa.array(dist)], names=["vec_id", "v", "cell", "dist"])

    return run


def _blocks(rows: int):
    """Runs of equal (cell, ring) in the sorted input, cut into blocks of at most `rows`."""

    def run(batches):
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, []

        def out():
            nonlocal number
            part = pa.Table.from_batches(held).combine_chunks()
            d = part["dist"].to_numpy()
            made = pa.record_batch(
                [pa.array([number]), pa.array([part["cell"][0].as_py()], pa.int32()), pa.array([part["ring"][0].as_py()], pa.int32()), pa.array([d.min()]), pa.array([d.max()]),
                 pa.array([part["vec_id"].to_pylist()], pa.list_(pa.int64())), pa.array([b"".join(part["v"].to_pylist())])],
                names=["block", "cell", "ring", "least", "most", "ids", "vectors"],
            )
            number += 1
            held.clear()
            return made

        for b in batches:
            keys = np.stack([b.column(2).to_numpy(), b.column(3).to_numpy()], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                while s < e:
                    if held and ((held[-1].column(2)[0], held[-1].column(3)[0]) != (b.column(2)[s], b.column(3)[s]) or sum(map(len, held)) >= rows):
                        yield out()
                    n = min(e - s, rows - sum(map(len, held)))
                    held.append(b.slice(s, n))
                    s += n
        if held:
            yield out()

    return run


BLOCK = "block long, cell int, ring int, least double, most double, ids array<long>, vectors binary"


def _home(shared, width: int, item: int, rings: np.ndarray):
    """For every query the one annulus it starts with: rings has (cell, ring, least, most, parts) rows."""

    def run(batches):
        g: Geometry = shared.value
        for b in batches:
            for ids, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                q = np.frombuffer(raw, f"<i{item}").reshape(-1, width)
                d = g.of_queries(q)
                gap = np.maximum(0, np.maximum(d[:, rings[:, 0].astype(int)] - rings[:, 3], rings[:, 2] - d[:, rings[:, 0].astype(int)]))
                # The nearest pivot that holds vectors, then the ring nearest to the query's own distance.
                pick = (d[:, rings[:, 0].astype(int)] + gap).argmin(1)
                yield from _sent(((p, np.flatnonzero(pick == p)) for p in np.unique(pick)), rings, ids, q)

    return run


def _rest(shared, width: int, item: int, rings: np.ndarray):
    """For every query all other annuli that its k-th score does not rule out, nearest first."""

    def run(batches):
        g: Geometry = shared.value
        for b in batches:
            for ids, raw, best in zip(*(c.to_pylist() for c in b.columns), strict=True):
                q = np.frombuffer(raw, f"<i{item}").reshape(-1, width)
                known = np.full(len(q), -np.inf)
                for x in best or ():
                    known[x["at"]] = x["kth"]
                d, cells = g.of_queries(q), rings[:, 0].astype(int)
                gap = np.maximum(0, np.maximum(d[:, cells] - rings[:, 3], rings[:, 2] - d[:, cells]))
                home = (d[:, cells] + gap).argmin(1)
                open_ = g.best_score(q, gap) >= known[:, None]
                open_[np.arange(len(q)), home] = False
                yield from _sent(((p, np.flatnonzero(open_[:, p])) for p in np.argsort(gap.min(0), kind="stable")), rings, ids, q)

    return run


def _sent(chosen, rings: np.ndarray, ids: list[int], q: np.ndarray):
    """Batches of PAIRS: for each (ring, queries) the ids and vectors of those queries, once a part of the ring."""
    rows: list[tuple] = []
    for p, who in chosen:
        if len(who):
            some, vectors = [ids[k] for k in who], q[who].tobytes()
            rows += [(int(rings[p, 0]), int(rings[p, 1]), part, some, vectors) for part in range(int(rings[p, 4]))]
        if len(rows) >= 64:
            yield _pairs(rows)
            rows = []
    yield _pairs(rows)


def _pairs(rows):
    cols = list(zip(*rows)) or [()] * 5
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary())
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["cell", "ring", "part", "qids", "qs"])


PAIRS = "cell int, ring int, part int, qids array<long>, qs binary"


def _with_rings(keyed: DataFrame, ring_rows: int) -> DataFrame:
    """keyed with `ring`: the annulus of each row, by quantiles of dist within its cell, ring_rows or more in each (at most RINGS a cell)."""
    sizes = {r.cell: r["count"] for r in keyed.groupBy("cell").count().collect()}  # a row a pivot
    wanted = {c: min(RINGS, max(1, n // ring_rows)) for c, n in sizes.items()}
    cut = F.percentile_approx("dist", F.lit([k / RINGS for k in range(1, RINGS)]), F.lit(10_000))
    edges = {r.cell: [r.q[k * RINGS // wanted[r.cell] - 1] for k in range(1, wanted[r.cell])] for r in keyed.groupBy("cell").agg(cut.alias("q")).collect()}
    bounds = keyed.sparkSession.createDataFrame(sorted(edges.items()), "cell int, edges array<double>")
    ring = F.size(F.filter("edges", lambda e: e <= F.col("dist")))
    return keyed.join(F.broadcast(bounds), "cell").select("vec_id", "v", "cell", ring.alias("ring"), "dist")


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int):
    """The k best rows of every query: highest score, then smallest id."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    first = np.r_[True, query[1:] != query[:-1]] if len(query) else np.zeros(0, bool)
    at = np.arange(len(query))
    rank = at - np.maximum.accumulate(np.where(first, at, 0)) if len(query) else at
    keep = rank < k
    return query[keep], vec[keep], score[keep]


def _scored(width: int, item: int, k: int, exact: bool):
    kind = float if exact else np.int64

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3
        waiting, size = [held], 0
        for b in batches:
            for qids, qs, ids, vs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                q, v = (np.frombuffer(raw, f"<i{item}").reshape(-1, width).astype(kind) for raw in (qs, vs))
                qid, vid = np.array(qids, np.int64), np.array(ids, np.int64)
                s = (q @ v.T).astype(np.int64)
                own = qid[:, None] == vid[None, :]
                s[own] = np.iinfo(np.int64).min
                n = min(k, s.shape[1])
                kth = np.partition(s, s.shape[1] - n, 1)[:, s.shape[1] - n]
                i, j = np.nonzero((s >= kth[:, None]) & ~own)
                waiting.append(list(_best(qid[i], vid[j], s[i, j], k)))
                size += len(waiting[-1][0])
                if size > 200_000:
                    waiting = [list(_best(*map(np.concatenate, zip(*waiting)), k))]
                    size = len(waiting[0][0])
                    if size > 1_000_000:
                        yield pa.record_batch([pa.array(x) for x in waiting[0]], names=["query_id", "vec_id", "score"])
                        waiting, size = [held], 0
        yield pa.record_batch([pa.array(x) for x in _best(*map(np.concatenate, zip(*waiting)), k)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows for each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = vectors.select(ticked(id_col).cast("long").alias("vec_id"), ticked(vector_col).cast("array<double>").alias("e"))
    clean = materialise(rows.mapInArrow(_quantised, "vec_id long, v binary, item int, norm double"), "quantised")
    size = clean.agg(F.max("norm").alias("largest"), F.max(F.octet_length("v") / F.col("item")).alias("width"), F.max("item").alias("item"), F.count(F.lit(1)).alias("n")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if size.largest is None:
        return empty
    width, item, largest = max(int(size.width), 1), size.item, float(size.largest)
    # A digest keeps about twice the sample, whatever the table's size; the smallest digests of these are it.
    few = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 31)) < F.lit(int((1 << 31) * min(1.0, 2 * PIVOT_SAMPLE / size.n)))
    near = clean if size.n <= 4 * PIVOT_SAMPLE else clean.where(few)
    sample = near.orderBy(F.md5(F.col("vec_id").cast("string").cast("binary")), "vec_id", "v").limit(PIVOT_SAMPLE).select("v", "item").toArrow().combine_chunks()
    shared = spark.sparkContext.broadcast(Geometry(choose_pivots(_matrix(sample["v"], width, item, sample["item"]), pivots), largest))
    ring_rows = max(RING_ROWS, size.n // MOST_RINGS)
    keyed = _with_rings(materialise(clean.select("vec_id", "v", "item").mapInArrow(_keyed(shared, width, item), "vec_id long, v binary, cell int, dist double"), "keyed"), ring_rows)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size.n // PARTITION_ROWS))
    order = ["cell", "ring", "dist", "vec_id"]
    index = materialise(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_blocks(BLOCK_ROWS), BLOCK), "index")
    asked = keyed.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min(F.struct("v", "cell", "dist")).alias("x")).select("vec_id", "x.v", "x.cell", "x.dist")
    asked = asked.repartitionByRange(parts, "cell", "dist", "vec_id").sortWithinPartitions("cell", "dist", "vec_id")
    asked = asked.select("vec_id", "v", F.lit(0).alias("cell"), F.lit(0).alias("ring"), "dist")
    queries = materialise(asked.mapInArrow(_blocks(QUERY_ROWS), BLOCK).select(F.col("block").alias("qblock"), F.col("ids").alias("qids"), F.col("vectors").alias("qs")), "queries")
    dealt_over = F.ceil(F.count(F.lit(1)) / max(PART_BLOCKS, 2 * ring_rows // BLOCK_ROWS)).cast("int")
    directory = materialise(index.groupBy("cell", "ring").agg(F.min("least").alias("least"), F.max("most").alias("most"), dealt_over.alias("parts")), "directory")
    rings = np.array([tuple(r) for r in directory.orderBy("cell", "ring").collect()], float).reshape(-1, 5)
    dealt = index.join(F.broadcast(directory.select("cell", "ring", "parts")), ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int"))
    dealt = dealt.select("cell", "ring", "part", "ids", "vectors")

    def score(pairs: DataFrame) -> DataFrame:
        met = pairs.join(dealt, ["cell", "ring", "part"])
        return met.select("qids", "qs", "ids", "vectors").mapInArrow(_scored(width, item, k, largest * 2 < EXACT), "query_id long, vec_id long, score long")

    # A few query blocks make many rows: each is dealt out before it does.
    start = materialise(score(queries.repartition(parts, "qblock").select("qids", "qs").mapInArrow(_home(shared, width, item, rings), PAIRS)), "first")
    kth = start.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).where(F.size("s") >= k).select("query_id", F.get("s", F.lit(k - 1)).alias("kth"))
    members = queries.select("qblock", F.posexplode("qids").alias("at", "query_id"))
    bounds = members.join(kth, "query_id").groupBy("qblock").agg(F.collect_list(F.struct("at", "kth")).alias("best"))
    rest = score(queries.join(bounds, "qblock", "left").repartition(parts, "qblock").select("qids", "qs", "best").mapInArrow(_rest(shared, width, item, rings), PAIRS))
    ranked = start.unionByName(rest).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op6_pivot_search(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))

"""Audit of how filters act together: what each removes, at each place of every order.

A filter is a condition under which a row fails. One pass over the texts turns the filters into narrow
flags. The survivors of a set of filters do not depend on their order, so the permutation trie is walked
depth first with one persisted DataFrame of survivors for each unordered prefix (32 for five filters),
memoised: an edge (prefix, filter) is counted once, by removing rows from the survivors of its prefix, and
stands for all permutations that pass through it. A prefix's survivors are read from its parent's and
released when its edges are counted, so at most one path of the trie is held. Counts go to a written table
of (part, prefix, filter); permutations meet it by a join on narrow rows.

Only the digests that find equal texts are shuffled, never texts. The first row of each text is found by an
aggregation that combines before the shuffle, and joined back by (id, digest), which is spread evenly
however many copies a text has. Rows are counted per part with partial sums, so a hot part is no hot task.

Defined cases: a null text is empty; a null part is the empty string; a row of a null id is never a copy
and makes none; rows alike in id and text are no copies of each other; of several labels of one id any 1
counts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm._shared import count_chars, materialise, settled, table, ticked, words_of

MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 100, 80, 10, r"[#$%&*|]"


def text_flags(text: Column) -> dict[str, Column]:
    """Which of the filters A to D the text fails."""
    words = settled(words_of(text))
    n = F.size(words)
    return {
        "A": n < MIN_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < n * DISTINCT_PERCENT,
        "C": count_chars(text, "A-Z") * 100 > F.length(text) * CAPITAL_PERCENT,
        "D": text.rlike(SYMBOLS),
    }


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, A to E, good, toxic): one row per row of docs; A to E are true where the row fails."""
    text = F.coalesce(ticked(text_col).cast("string"), F.lit(""))
    read = docs.select(ticked(id_col).alias("id"), F.coalesce(ticked(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    narrow = materialise(read.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(k) for k, c in text_flags(F.col("text")).items()]), "flags")
    firsts = narrow.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(
        F.max((F.col("quality") == 1)).alias("good"), F.max((F.col("toxic") == 1)).alias("toxic")
    )
    either = lambda c: F.coalesce(F.col(c), F.lit(False))
    found = narrow.join(firsts, ["id", "digest"], "left").join(marks, "id", "left")
    return found.select("part", *"ABCD", (F.col("id").isNotNull() & ~either("first")).alias("E"), either("good").alias("good"), either("toxic").alias("toxic"))


def _counted(rows: DataFrame, prefix: str, filters: str) -> DataFrame:
    """(part, prefix, filter, removed, good, toxic): the edges that leave prefix, counted among its survivors."""
    left = [f for f in filters if f not in prefix]
    n = lambda *c: F.count_if(F.lit(True) if not c else c[0] if len(c) == 1 else c[0] & c[1])
    sums = [x.alias(f"{f}_{k}") for f in left for k, x in (("n", n(F.col(f))), ("g", n(F.col(f), F.col("good"))), ("t", n(F.col(f), F.col("toxic"))))]
    edges = F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), F.col(f"{f}_n").alias("removed"), F.col(f"{f}_g").alias("good"), F.col(f"{f}_t").alias("toxic")) for f in left]))
    return rows.groupBy("part").agg(n().alias("here"), *sums).select("part", "here", F.lit(prefix).alias("prefix"), edges.alias("x")).select("part", "here", "prefix", "x.*")


def count_edges(rows: DataFrame, filters: str) -> DataFrame:
    """(part, here, prefix, filter, removed, good, toxic) of every edge; `here`: rows of part before the filter.

    A part without survivors has no row at a prefix: its counts are zero.
    """
    seen: dict[str, DataFrame] = {}

    def walk(prefix: str, survivors: DataFrame) -> None:
        held = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            seen[prefix] = materialise(_counted(held, prefix, filters), "edges")
            for f in filters:
                child = "".join(sorted(prefix + f))
                if f not in prefix and child not in seen and len(child) < len(filters):
                    walk(child, held.where(~F.col(f)).drop(f))
        finally:
            held.unpersist()

    walk("", rows)
    out = None
    for edges in seen.values():
        out = edges if out is None else out.unionByName(edges)
    return out


def audit(rows: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """One row per part, order of all filters and step, with what its filter removes there."""
    edges = materialise(count_edges(rows, filters), "audit")
    orders = ["".join(p) for p in permutations(filters)]
    steps = [(o, k + 1, "".join(sorted(o[:k])), o[k]) for o in orders for k in range(len(filters))]
    plan = rows.sparkSession.createDataFrame(steps, "filter_order string, step int, prefix string, filter string")
    whole = edges.where("prefix = ''").select("part", "filter", F.col("removed").alias("fails"))
    alone = F.length("prefix") == len(filters) - 1
    unique = edges.where(alone).select("part", "filter", F.col("removed").alias("unique"))
    # All orders: one row for each part, filter and step of the plan, whether or not rows were left there.
    base = whole.join(unique, ["part", "filter"], "left").join(F.broadcast(plan), "filter")
    full = base.join(edges, ["part", "prefix", "filter"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    full = full.select(
        "part", "filter_order", "step", "filter", zero("removed").alias("removed"), (zero("here") - zero("removed")).alias("kept"),
        (zero("fails") - zero("removed")).alias("redundant"), zero("unique").alias("unique_fails"), zero("good").alias("good_lost"), zero("toxic").alias("toxic_lost"),
    )
    total = full.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return full.join(total, ["part", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    rows = flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit(materialise(rows, "audited"))

"""Merkle dataset manifest: a root over all rows, a proof for each, and what tampering does to it.

Each row is a leaf, sources are trees over their leaves in id order, and one tree over the sources' roots
gives the root. Nodes are joined in runs of `fanout` while more than one is left; the last run may be short.

Superblocks: a node's place is its index in its tree, a block is the index divided by fanout^levels. Blocks
of at most fanout^levels nodes go to applyInPandas, which collapses all their levels at once; the blocks'
roots are the next, much smaller, set of nodes, until each tree has one. Proofs are made on the way down: a
block's nodes get the siblings of their own levels, followed by the proof of their block. Sibling lists
exist only inside a block's task and in the rows of blocks; a leaf leaves with its digests.

No tree is ever ranked or gathered in one task: leaves are dealt by ranges of (tree, id) and numbered where
they lie, and an index is the rows of the tree's earlier ranges plus the place in its own. Only digests are
shuffled; texts stay in the scan. A hot source is many blocks.

Defined cases: a null field is `-`, apart from an empty one (`0:`); a null source is a tree of its own and
the first; null ids are the first leaves; rows of one id follow each other by their digest, and rows alike
in every hashed field by the order in which they are read; a null id is never tampered with; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm._shared import materialise, table, ticked

FANOUT = 3
#: Levels a block collapses: 3^6 = 729 nodes.
LEVELS = 6
PROVEN = "tree string, index long, count long, node binary, proof binary"
#: Ids pass Python as text, where a null does not turn its neighbours into floating point.
CHECKED = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest_of(parts) -> bytes:
    """sha256 of the parts' hex forms, concatenated."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def levels_of(n: int, fanout: int = FANOUT) -> int:
    """Levels until one of n nodes is left."""
    k = 0
    while n > 1:
        n, k = -(-n // fanout), k + 1
    return k


def collapse(nodes: list[bytes], levels: int, fanout: int = FANOUT) -> list[list[bytes]]:
    """The nodes and the `levels` levels above them, the last with the block's root alone."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest_of(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return out


def siblings(rows: list[list[bytes]], at: int, fanout: int = FANOUT) -> bytes:
    """The other nodes of the runs that lead from node `at` to the root, level by level, left to right."""
    out = []
    for level in rows[:-1]:
        first = at - at % fanout
        out += level[first:at] + level[at + 1 : first + fanout]
        at //= fanout
    return b"".join(out)


def folded(node: bytes, index: int, count: int, proof: bytes, at: int = 0, fanout: int = FANOUT) -> tuple[bytes, int]:
    """The root that node at `index` of `count` gives with its proof (from byte `at`), and where its siblings end."""
    while count > 1:
        own = index % fanout
        run = min(fanout, count - index + own)
        others = [proof[at + 32 * i : at + 32 * i + 32] for i in range(run - 1)]
        node = digest_of([*others[:own], node, *others[own:]])
        at += 32 * (run - 1)
        index, count = index // fanout, -(-count // fanout)
    return node, at


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes with `index`, from 0 in each tree by order, and `count`, the nodes of the tree; written once."""
    keys = ["tree", *order]
    near = nodes.withColumn("__read", F.monotonically_increasing_id())
    dealt = near.repartitionByRange(*keys, "__read").sortWithinPartitions(*keys, "__read").drop("__read").withColumn("__at", F.monotonically_increasing_id())
    dealt = materialise(dealt.withColumn("__range", F.shiftright("__at", 33)), "ranges")
    pieces = dealt.groupBy("tree", "__range").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("tree", "__range", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(tree).alias("count"))
    found = dealt.join(starts, ["tree", "__range"]).withColumn("index", F.col("__at") + F.col("__shift"))
    return materialise(found.drop("__at", "__range", "__shift"), "placed")


def _blocked(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"index div {fanout**levels}"))


def _roots(fanout: int, levels: int):
    def of(block: pd.DataFrame) -> pd.DataFrame:
        nodes = block.sort_values("index").node
        first = block.iloc[0]
        some = min(levels, levels_of(int(first["count"]), fanout))
        root = collapse([bytes(x) for x in nodes], some, fanout)[-1][0]
        return pd.DataFrame({"tree": [first.tree], "index": [first.block], "count": [-(-int(first["count"]) // fanout**some)], "node": [root]})

    return of


def reduced(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """nodes (tree, index, count, node) and the nodes after each reduction; in the last every tree has one."""
    out = [nodes.select("tree", "index", "count", "node")]
    while (out[-1].agg(F.max("count")).first()[0] or 0) > 1:
        blocks = _blocked(out[-1], fanout, levels).groupBy("tree", "block")
        out.append(materialise(blocks.applyInPandas(_roots(fanout, levels), "tree string, index long, count long, node binary"), "superblocks"))
    return out


def _proofs(fanout: int, levels: int, finish=None):
    """For cogrouped nodes of one block and the block's own row (proof): the nodes with their whole proofs."""

    def of(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("index", ignore_index=True)
        some = min(levels, levels_of(int(block["count"].iloc[0]), fanout)) if len(block) else 0
        rows = collapse([bytes(x) for x in block.node], some, fanout)
        upper = bytes(above.proof.iloc[0])
        proofs = [siblings(rows, at, fanout) + upper for at in range(len(block))]
        return finish(block, proofs, above) if finish else block.assign(proof=proofs)[["tree", "index", "count", "node", "proof"]]

    return of


def proven(steps: list[DataFrame], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(tree, index, count, node, proof) of the nodes in steps[0], by descent through the reductions."""
    above = steps[-1].withColumn("proof", F.lit(b""))
    for nodes in reversed(steps[:-1]):
        above = materialise(_descend(nodes, above, _proofs(fanout, levels), PROVEN, fanout, levels), "proofs")
    return above


def _descend(nodes: DataFrame, above: DataFrame, step, schema: str, fanout: int, levels: int) -> DataFrame:
    # Columns of their own: where every tree is one leaf, above stems from nodes.
    proofs = above.select(*[F.col(c).alias({"index": "block"}.get(c, c)) for c in above.columns])
    return _blocked(nodes, fanout, levels).groupBy("tree", "block").cogroup(proofs.groupBy("tree", "block")).applyInPandas(step, schema)


def field(value: Column) -> Column:
    """`-` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in fields]), 256))


def _checked(fanout: int):
    """Digests of the leaves of a block; above holds the block's proof, its tree's place and the root."""

    def of(block: pd.DataFrame, proofs: list[bytes], above: pd.DataFrame) -> pd.DataFrame:
        top = above.iloc[0]
        root, found = bytes(top.root), []
        for index, count, node, proof in zip(block["index"], block["count"], block.tampered, proofs, strict=True):
            now, at = folded(bytes(node), int(index), int(count), proof, fanout=fanout)
            found.append(folded(now, int(top.tree_index), int(top.tree_count), proof, at, fanout)[0])
        return pd.DataFrame({
            "id": block.id, "leaf": [bytes(x).hex() for x in block.node], "subroot": bytes(top.subroot).hex(), "root": root.hex(),
            "proof_sha256": [hashlib.sha256(p.hex().encode()).hexdigest() for p in proofs], "folded_root": [x.hex() for x in found], "verified": [x == root for x in found],
        })

    return of


def manifest(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of leaves (id, source, leaf, tampered).

    `tampered` is the leaf as it is found later: its root is folded from it and the original siblings.
    """
    kind = leaves.schema["id"].dataType.simpleString()
    tree = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit(""))
    rows = placed(leaves.select("id", tree.alias("tree"), F.col("leaf").alias("node"), "tampered"), ["id", "node"])
    rows = rows.withColumn("id", F.col("id").cast("string"))
    steps = reduced(rows, fanout, levels)
    subroots = steps[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "node")
    sources = placed(subroots, ["source"])
    tops = reduced(sources, fanout, levels)
    whole = proven(tops, fanout, levels).select("index", F.col("node").alias("subroot"), "proof")
    root = tops[-1].select(F.col("tree").alias("tree"), F.col("node").alias("root"))
    # The narrow table of sources takes the one root; each source's proof starts the descent to its leaves.
    named = sources.select(F.col("tree"), "source", "index", F.col("count").alias("tree_count")).join(whole, "index").join(root, "tree")
    about = materialise(named.select(F.col("source").alias("tree"), F.col("index").alias("tree_index"), "tree_count", "subroot", "root", "proof"), "sources")
    above = steps[-1].select("tree", "index", "count", "node").join(about.select("tree", "proof"), "tree")
    for nodes in reversed(steps[1:-1]):
        above = materialise(_descend(nodes, above, _proofs(fanout, levels), PROVEN, fanout, levels), "proofs")
    above = above.select("tree", "index", "proof").join(about.drop("proof"), "tree")
    found = _descend(rows, above, _proofs(fanout, levels, _checked(fanout)), CHECKED, fanout, levels)
    return found.withColumn("id", F.col("id").cast(kind))


def leaves_of(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text", tamper: Column | None = None) -> DataFrame:
    """(id, source, leaf, tampered): the digest of each row's fields, and of them with the line ends of the text
    deleted where `tamper` holds."""
    cut = F.regexp_replace(ticked(text_col).cast("string"), "\n", "")
    changed = F.lit(False) if tamper is None else F.coalesce(tamper & ticked(text_col).contains("\n"), F.lit(False))
    one = leaf([ticked(c) for c in fields])
    other = leaf([cut if c == text_col else ticked(c) for c in fields])
    found = docs.select(ticked(id_col).alias("id"), ticked(source_col).alias("source"), one.alias("leaf"), F.when(changed, other).alias("tampered"))
    return found.withColumn("tampered", F.coalesce("tampered", "leaf"))


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest(leaves_of(table(spark, sf_dir, "documents"), tamper=even)).withColumnRenamed("id", "doc_id")

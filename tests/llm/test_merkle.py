"""The manifest against a plain recursive tree, and its proofs against tampered rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, `index` int, block int, node string, `a.b` int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)])


def tree_of(nodes, fanout):
    """All levels, and for each node the siblings and its own place in every run above it."""
    levels, paths = [nodes], [[] for _ in nodes]
    while len(levels[-1]) > 1:
        below, step = levels[-1], fanout ** (len(levels) - 1)
        for k, path in enumerate(paths):
            at = k // step
            run = below[at - at % fanout : at - at % fanout + fanout]
            path.append((run[: at % fanout], run[at % fanout + 1 :]))
        levels.append([h(*below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return levels[-1][0], paths


def brute(rows, fanout=3):
    trees = defaultdict(list)
    for r in rows:
        trees[r[3]].append(r)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    subs, inner = [], []
    for s in names:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        sub, paths = tree_of([leaf(r, r[1]) for r in trees[s]], fanout)
        subs.append(sub)
        inner.append(paths)
    root, outer = tree_of(subs, fanout)
    out = []
    for s, sub, paths, up in zip(names, subs, inner, outer, strict=True):
        for r, path in zip(trees[s], paths, strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            now = leaf(r, r[1].replace("\n", "") if tampered else r[1])
            for before, after in path + up:
                now = h(*before, now, *after)
            proof = h(*[x for before, after in path + up for x in (*before, *after)])
            out.append((r[0], leaf(r, r[1]), sub, root, proof, now, now == root))
    return Counter(out)


def got(df):
    return Counter((r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def rows_of(n, sources):
    texts = ["one\ntwo", None, "", "\n", "plain", "ünï\nstraße 日本", "x" * 50_000 + "\ny"]
    return [(k, texts[k % 7], ["en", None, ""][k % 3], sources[k % len(sources)], k, "t", 1, 2, "n", 3) for k in range(n)]


def manifest_of(df, **kw):
    from quire.llm.merkle import leaves_of, manifest

    return manifest(leaves_of(df, tamper=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0), **kw)


@pytest.mark.parametrize(("n", "sources"), [(1, ["a"]), (3, ["a", None, ""]), (40, ["a"]), (120, ["a", "a", "a", None, "ü", "b", "+", "B"])])
def test_manifest(spark, n, sources):
    rows = rows_of(n, sources)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for levels in (1, 2, 6):
        assert got(manifest_of(df, levels=levels)) == brute(rows)


def test_awkward_ids(spark):
    rows = rows_of(30, ["a", "b", None])
    rows += [(None, "no id\n", None, "a", 1, *rows[0][5:]), (None, None, None, "a", None, *rows[0][5:]), rows[3], rows[3], (2**62 + 1, "large\n", "en", "b", 1, *rows[0][5:]), (-7, "below", "en", "b", 1, *rows[0][5:])]
    assert got(manifest_of(spark.createDataFrame(rows, DOCS).repartition(2), levels=2)) == brute(rows)


def test_many_small_sources_and_other_fanout(spark):
    rows = rows_of(100, [f"s{k}" for k in range(40)])
    df = spark.createDataFrame(rows, DOCS)
    assert got(manifest_of(df, fanout=2, levels=3)) == brute(rows, 2)


def test_empty(spark):
    assert manifest_of(spark.createDataFrame([], DOCS)).count() == 0


def test_registered_query(spark):
    from quire.llm.merkle import op11_merkle

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    df = op11_merkle(spark, "/root/testdata/sf0.001")
    assert df.columns[:7] == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got(df.withColumnRenamed("doc_id", "id")) == brute(rows)

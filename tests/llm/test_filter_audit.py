"""The audit against all orders walked row by row."""

import re
from collections import Counter
from itertools import permutations

from quire.llm.filter_audit import audit, count_edges, flagged

DOCS = "doc_id long, text string, lang string, part string, id string, `A` int, digest int, `first` string, good string, `a.b` int"
LABELS = "doc_id long, quality int, toxic int, id int, part string"


def brute(rows, labels):
    flags = []
    for r in rows:
        text = r[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        mine = [x for x in labels if x[0] is not None and x[0] == r[0]]
        flags.append((
            r[2] or "",
            {
                "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                "D": bool(re.search(r"[#$%&*|]", text)), "E": r[0] is not None and any(o[0] is not None and o[0] < r[0] and (o[1] or "") == text for o in rows),
            },
            any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine),
        ))
    out, shapley = {}, Counter()
    for part in {f[0] for f in flags}:
        here = [f for f in flags if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = here
            for step, c in enumerate(order, 1):
                gone = [f for f in left if f[1][c]]
                left = [f for f in left if not f[1][c]]
                fails = [f for f in here if f[1][c]]
                shapley[part, c] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(fails) - len(gone), sum(sum(f[1].values()) == 1 for f in fails), sum(f[2] for f in gone), sum(f[3] for f in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def rows_of():
    many = " ".join(f"w{k}" for k in range(120))
    texts = [None, "", many, many, many.upper(), many + " #", "a b " * 80, "A B " * 80 + "*", many + " é日本 \x1c\x85", "line\nline\x0bline", " \t\n", "z" * 40_000, many + " once", many]
    rows = [(k, t, ["en", None, "", "de"][k % 4], "p", "x", 1, 2, "f", "g", 3) for k, t in enumerate(texts * 3)]
    return [*rows, rows[5], (None, many, "en", *rows[0][3:]), (None, many, "en", *rows[0][3:]), (-4, "z" * 40_000, "fr", *rows[0][3:])]


LABELLED = [(k, k % 2, int(k % 5 == 0), 1, "p") for k in range(0, 30, 2)] + [(4, None, 1, 1, "p"), (6, 1, None, 1, "p"), (None, 1, 1, 1, "p"), (999, 1, 1, 1, "p")]


def found(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit(spark):
    docs = spark.createDataFrame(rows_of(), DOCS).repartition(3)
    got = found(audit(flagged(docs, spark.createDataFrame(LABELLED, LABELS))))
    assert got == brute(rows_of(), LABELLED)
    assert len(got) == 4 * 120 * 5


def test_each_unordered_prefix_is_counted_once(spark):
    rows = flagged(spark.createDataFrame(rows_of(), DOCS), spark.createDataFrame(LABELLED, LABELS))
    edges = count_edges(rows, "ABC").where("part = 'en'").collect()
    assert Counter(r.prefix for r in edges) == {"": 3, "A": 2, "B": 2, "C": 2, "AB": 1, "AC": 1, "BC": 1}
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_empty(spark):
    rows = flagged(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))
    assert audit(rows).count() == 0

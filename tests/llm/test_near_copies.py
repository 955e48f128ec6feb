"""The pipeline's near-duplicate stage against brute force."""

import numpy as np
import pytest

pytest.importorskip("xxhash")
pipeline = pytest.importorskip("corpus_pipeline")


def jaccard(a, b):
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def classes_of_similar(texts):
    """Smallest place of each group of texts that links of similarity 0.8 or more connect, by comparing all pairs."""
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(texts):
        for j in range(i):
            if jaccard(a, texts[j]) >= 0.8:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))]


def varied(words, n, rng):
    """words with n of them replaced, apart enough that each breaks five shingles."""
    out = list(words)
    for at in rng.choice(len(words) // 6, n, replace=False) * 6 + 5:
        out[at] = f"x{rng.integers(10**9)}"
    return out


def test_near_copies_against_brute_force(spark):
    rng = np.random.default_rng(7)
    texts = []
    for _ in range(30):
        base = [f"w{k}" for k in rng.integers(0, 5000, 300)]
        texts += [" ".join(x) for x in (base, varied(base, 3, rng), varied(base, 5, rng), varied(base, 9, rng), varied(base, 20, rng))]
    # A large group of close copies, the same words in another order, short and blank texts.
    base = [f"v{k}" for k in range(300)]
    texts += [" ".join(varied(base, 2, rng)) for _ in range(40)] + [" ".join(base[::-1]), "one two", "One  two", "one three"]
    want = set(classes_of_similar(texts))
    linked = len(texts) - len(want)
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(500, None, 1), (501, " \n", 1)], "doc_id long, text string, `a.b` int").repartition(3)
    kept = pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and linked > 60
    assert {r.doc_id for r in kept.collect()} == want | {500}


def test_equal_ids_and_no_ids(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 5000, 60)) for _ in range(4)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (4, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((r.doc_id or 0, r.text) for r in pipeline.near_duplicates(spark, docs, "").collect())
    assert got == sorted([(0, texts[0]), (0, texts[1]), (5, texts[2]), (4, texts[3])])


def test_groups_that_stars_leave_open(spark, monkeypatch):
    from quire.llm import near_copies

    monkeypatch.setattr(near_copies, "BUCKET_ROWS", 16)
    rng = np.random.default_rng(9)
    base, texts = [f"v{k}" for k in range(120)], []
    for k in range(110):
        out = list(base)
        for at in rng.choice(20, rng.integers(0, 7), replace=False) * 6 + 3:
            out[at] = f"x{rng.integers(3)}"  # few other words, so that variants share their changes
        texts.append(" ".join(out[: 120 - k % 9]))
    want = classes_of_similar(texts)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in pipeline.near_duplicates(spark, docs, "").collect()} == set(want) and 1 < len(set(want)) < 100

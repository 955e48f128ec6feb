"""What FINDINGS_r04 asked for: op6 stores vectors narrowly and bounds the annuli that a query is sent to."""

import numpy as np

from quire.llm import _shared, pivot_search


def test_vectors_are_stored_narrowly_and_annuli_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(pivot_search, "RING_ROWS", 2)
    monkeypatch.setattr(pivot_search, "MOST_RINGS", 10, raising=False)
    rng = np.random.default_rng(5)
    vecs = [(k, rng.normal(0, 0.3, 6).astype(np.float32).tolist()) for k in range(1200)]
    before = len(_shared.written)
    got = pivot_search.top_k(spark.createDataFrame(vecs, "vec_id long, embedding array<float>"), pivots=4).collect()
    made = {p.rsplit("/", 1)[1].split("-")[0]: spark.read.parquet(p) for p in _shared.written[before:]}
    assert made["directory"].count() <= 10 + 4
    assert {len(r.v) for r in made["keyed"].collect()} == {2 * 6}
    q = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in vecs}
    best = [(i, n + 1, j, -s) for i in q if i % 100 == 0 for n, (s, j) in enumerate(sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:10])]
    assert sorted(map(tuple, got)) == sorted(best)


def test_vectors_of_all_widths(spark):
    """Components that need 2, 4 and 8 bytes in one table, nulls and infinities among them."""
    vecs = [(k, [float(k % 7), -32.0 if k % 3 else 31.5, 5.0e4 * (k % 2), 2.0**21 * (1.0 - 2.0**-30) * (k % 5 == 0)][: 4 - k % 2]) for k in range(300)]
    odd = [(1000, [float("inf"), 0.0]), (1100, [None, 1.0]), (1200, None), (1300, []), (1400, [2.0**22])]
    q = {i: np.floor(1024 * np.array([*v, 0.0, 0.0, 0.0, 0.0][:4], np.float64)).astype(int) for i, v in [*vecs, (1300, [])]}
    got = pivot_search.top_k(spark.createDataFrame([*vecs, *odd], "vec_id long, embedding array<double>")).collect()
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(q[a], q[b]))
    best = [(i, n + 1, j, -s) for i in q if i % 100 == 0 for n, (s, j) in enumerate(sorted((-dot(i, j), j) for j in q if j != i)[:10])]
    assert sorted(map(tuple, got)) == sorted(best)

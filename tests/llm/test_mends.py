"""Cases that earlier versions left undefined."""

import numpy as np


def test_labels_of_absent_documents_do_not_use_up_the_bound(spark):
    from quire.llm.quality_model import FEATURES, training_rows

    features = spark.createDataFrame([(k, [float(k % 7)] * len(FEATURES)) for k in range(300)] + [(None, [0.0] * len(FEATURES))], "id long, features array<double>")
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(200)] + [(10**6 + k, 1) for k in range(20_000)] + [(None, 1)], "doc_id long, quality int")
    x, y = training_rows(features, labels, "doc_id", "quality", 150)
    assert 100 < len(x) == len(y) <= 150 and {0.0, 1.0} == set(y)


def test_a_repeated_query_is_one_vector(spark):
    """Of the vectors of a query's id the one of the smallest bytes asks; all of them stay candidates of others."""
    from quire.llm.pivot_search import top_k

    rng = np.random.default_rng(9)
    vecs = [(k, rng.normal(0, 0.3, 4).astype(np.float32).tolist()) for k in range(1, 60)]
    twice = [(100, [0.25, -0.5, 0.125, 1.0]), (100, [0.5, 0.5, -0.25, 0.0]), (100, [0.25, 0.5, 0.125, 1.0])]
    clean = [(i, np.floor(1024 * np.array(v, float)).astype("<i8")) for i, v in vecs + twice]
    x = min((v for i, v in clean if i == 100), key=lambda v: v.tobytes())
    best = sorted((-int(x @ y), i) for i, y in clean if i != 100)[:10]
    for order in (vecs + twice, twice[::-1] + vecs):
        df = spark.createDataFrame(order, "vec_id long, embedding array<float>").repartition(2)
        assert sorted(map(tuple, top_k(df).collect())) == [(100, n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_vectors_beyond_the_bound_take_no_part(spark):
    from quire.llm.pivot_search import top_k

    rows = [(100, [1.0, 2.0]), (1, [1e6, -1e6]), (2, [1e12, 0.0]), (3, [3e38, 0.0]), (4, [0.5, 0.5])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert [(r.vec_id, r.score) for r in got] == [(4, 1024 * 512 + 2048 * 512), (1, 1024 * 1_024_000_000 - 2048 * 1_024_000_000)]

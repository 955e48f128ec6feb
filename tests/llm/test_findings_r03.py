"""Findings of round 3: the near-duplicate stage goes through op9's fingerprints and their classes."""

import pytest

pytest.importorskip("xxhash")
pipeline = pytest.importorskip("corpus_pipeline")


def longer(k):
    """A text of 36 five-word shingles, and one with 9 more: similarity 36/45, so just 0.8."""
    words = [f"w{k}x{j}" for j in range(40)]
    return " ".join(words), " ".join(words + [f"w{k}y{j}" for j in range(9)])


@pytest.mark.parametrize("k", [185960, 20149272, 40085208, 50038273])
def test_pairs_that_only_fingerprints_link(spark, k):
    from quire.llm.near_copies import band_values, majority, shingle_set

    a, b = (shingle_set(t) for t in longer(k))
    assert not set(band_values(a)) & set(band_values(b)) and (majority(a) ^ majority(b)).bit_count() <= 3
    docs = spark.createDataFrame([(1, longer(k)[0]), (2, longer(k)[1]), (3, "quite another text of a few words")], "doc_id long, text string")
    assert {r.doc_id for r in pipeline.near_duplicates(spark, docs, "").collect()} == {1, 3}


def test_fingerprint_classes_are_verified(spark):
    from quire.llm.near_copies import _sets, near_links

    texts = [*longer(1), longer(1)[1] + " and then eight more words of its own"]  # 36, 45 and 53 shingles, each in the next
    rows = [(k, len(t.split()) - 4, 7 + 8 * (k == 2), []) for k, t in enumerate(texts)]
    nodes = spark.createDataFrame(rows, "node long, n long, fp long, bands array<long>")
    whole = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    links = near_links(nodes, lambda wanted: whole.join(wanted, "node").mapInArrow(_sets, "node long, s array<long>"))
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in links.collect()} == {(0, 1), (1, 2)}

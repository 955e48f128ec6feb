"""Every stage of the pipeline, on its predecessor's rows, against a brute-force version."""

import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_near_copies import classes_of_similar
from tests.llm.test_operators import counts_of, cutoffs_of, prose

public_tokenizers = pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    texts = [prose(k, 90) for k in range(160)] + [prose(k, 90).replace(" ", "** " if k < 230 else "!? ") for k in range(200, 290)]
    texts += [texts[3], texts[3] + " more", None, "", "short one", "a b c " * 60, prose(900, 80) + " mail me@x.org or ring +1 (555) 123-4567", prose(901, 80) + " bob at site dot com"]
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(k, int(k < 160 or k >= 250), 0) for k in range(len(texts)) if k % 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    from tokenizers import Tokenizer

    from quire.llm.pii import mask, scan
    from quire.llm.quality_model import fit_quality

    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "personal_data", "packing"]
    stages, docs = dict(pipeline.STAGES), spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}

    kept = stages["quality_rules"](spark, docs, folder)
    assert kept.columns == COLUMNS
    good = {i for i, r in rows.items() if (c := counts_of(r.text))[0] >= 50 and 100 * c[4] <= 50 * c[0]}
    known = {r.doc_id: bool(r.quality) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    full = {i: (*counts_of(rows[i].text), sum(bool(x.split()) for x in rows[i].text.split("\n")), len(re.findall("[A-Z]", rows[i].text))) for i in good}
    limits = cutoffs_of([(i, "en", known[i], full[i]) for i in good if i in known], 0.05, 0.05).get("en", [])
    ratios = {i: (c[2] / c[0], c[3] / c[5], c[4] / c[0], c[6] / c[1], c[1] / c[0]) for i, c in full.items()}
    good = {i for i in good if not any(ratios[i][r] > x for r, x in limits)}
    assert {r.doc_id for r in kept.collect()} == good and 200 < len(good) < 230 and limits

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    forest, features = fit_quality(kept, labels)
    scores = {r.id: forest.score(np.array([r.features]))[0] for r in features.collect()}
    clean = stages["quality_classifier"](spark, kept, folder)
    left = {r.doc_id for r in clean.collect()}
    assert clean.columns == COLUMNS and left == {i for i, s in scores.items() if s >= 0.5}
    assert len(left & set(range(160))) >= 158 and len(good & set(range(190, 250))) == 60 and len(left & set(range(190, 250))) <= 3

    unique = stages["near_duplicates"](spark, clean, folder)
    ids = sorted(left)
    classes = classes_of_similar([rows[i].text for i in ids])
    assert unique.columns == COLUMNS and {r.doc_id for r in unique.collect()} == {ids[c] for c in classes} and len(set(classes)) < len(ids)

    masked = stages["personal_data"](spark, unique, folder)
    assert masked.columns == COLUMNS
    for r in masked.collect():
        text = rows[r.doc_id].text
        assert r.text == mask(text, [s for part in scan(text) for s in part]) and r.n_chars == len(r.text)
    assert sum("[EMAIL]" in r.text for r in masked.collect()) == 2

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((r.doc_id, i) for r in masked.collect() for i in [*tok.encode(r.text, add_special_tokens=False).ids, 1])
    packed = stages["packing"](spark, masked, folder).collect()
    assert Counter((r.doc_id, int(i)) for r in packed for i in np.frombuffer(bytes(r.ids), "<u4")) == want
    whole = pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in whole) == Counter((r.doc_id, r.start, r.ids_crc32) for r in packed)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0

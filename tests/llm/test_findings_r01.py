"""Cases of the review's first round, each wrong before its mend."""

import pytest

pytest.importorskip("public_tokenizers")
from tests.llm.test_operators import prose  # noqa: E402


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("ring plus 49 151 23456789 ok", "phone", "plus 49 151 23456789"),
        ("host 192 point 168 point 1 point 20 up", "ip", "192 point 168 point 1 point 20"),
        ("ring +1 415 555 seven 234 ok", "phone", "+1 415 555 seven 234"),
        ("ring +1 five 5 5 1 2 3 4 5 6 seven ok", "phone", "+1 five 5 5 1 2 3 4 5 6 seven"),
        ("write bob at site . com now", "email", "bob at site . com"),
        ("tel plus trois trois un deux un quatre cinq six sept huit neuf ok", "phone", "plus trois trois un deux un quatre cinq six sept huit neuf"),
        ("tel plus vier neun ein zwei drei ein fünf sechs sieben acht ok", "phone", "plus vier neun ein zwei drei ein fünf sechs sieben acht"),
    ],
)
def test_disguises_alone(text, kind, span):
    from quire.llm.pii import scan

    for whole in (text, text + " ​"):
        base, added = scan(whole)
        assert base == [] and [(k, whole[s:e]) for k, s, e in added] == [(kind, span)]


def test_articles_are_words():
    from quire.llm.pii import scan

    for text in ("un 415 555 12 34 56 78", "+ un, une 2 3 4 5 6 7 8 9 0", "ein un une una ein un une una ein un"):
        assert scan(text) == ([], [])


def test_representatives_by_row(spark):
    from quire.llm.simhash import keep_representatives

    rows = [(None, prose(1, 60)), (None, prose(2, 60)), (None, prose(2, 60)), (5, prose(3, 60)), (5, prose(4, 60)), (4, prose(5, 60)), (6, prose(5, 60)), (6, prose(6, 60))]
    got = keep_representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(None, 1), (None, 2), (5, 3), (5, 4), (4, 5), (6, 6)]
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted((i or 0, prose(k, 60)) for i, k in want)


def test_cutoffs_of_the_own_stratum_only(spark):
    from quire.llm import quality_rules

    bad = lambda k: " ".join(w + "$$" for w in prose(k, 60).split())
    rows = [(k + base, prose(k, 60), lang) for base, lang in ((0, None), (10_000, "en")) for k in range(400)]
    rows += [(k + base, bad(k), lang) for base, lang in ((5000, None), (15_000, "en")) for k in range(40)]
    # Strata with few labels or none are certified nothing.
    rows += [(20_000, prose(1, 60), "fr"), (20_001, bad(1), "fr"), (30_000, bad(2), "es")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], int(r[0] % 10_000 < 5000)) for r in rows if r[0] != 30_000], "doc_id long, quality int")
    good = {*range(400), *range(10_000, 10_400), 20_000}
    assert {r.doc_id for r in quality_rules.keep_good(docs, labels).collect()} == good | {20_001, 30_000}

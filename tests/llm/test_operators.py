"""Each training-data operator against a brute-force version, on a table of awkward rows."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, `q_words` int, features string, score int, masked int, `a.b` int"
PROSE = "the quick brown fox jumps over the lazy dog while seven calm otters watch the slow river bend past an old mill"
WORDS = PROSE.split()


def prose(k, n):
    rng = np.random.default_rng(k)
    return " ".join(rng.choice(WORDS, n)) + "."


def awkward():
    texts = [None, "", " \n\t ", "one", "two words", prose(1, 60), prose(1, 60), prose(1, 60) + " x", prose(2, 5000), "a b c " * 40, "*** ### " * 40]
    texts += ["Ünï straße 日本語   é ﬁ 😀", "<|endoftext|> tail  <|endoftext|>", "it's I'LL don''t\r\nx\x0b\x1cy", "line one\nline one\n\nline two\nline one"]
    texts += [prose(k, 80) for k in range(10, 30)]
    rows = [(k, t, ["en", None, "fr"][k % 3], [None, "a", "a", "b"][k % 4], None if t is None else len(t), "x", 1, "f", 2, 3, 4) for k, t in enumerate(texts)]
    return [*rows, rows[5], (None, prose(3, 70), None, None, 1, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, int(k not in (9, 10, 3)), 0) for k in range(35)] + [(5, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")


def texts_of(rows):
    return [r[1] for r in rows]


def test_byte_bpe(docs, none):
    from tokenizers import Tokenizer

    from quire.llm import byte_bpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, path), path).collect()
    want = [(i, tok.encode(t or "", add_special_tokens=False).ids) for i, t in ((r[0], r[1]) for r in awkward())]
    exp = Counter((i, np.array(x, "<u4").tobytes(), tok.decode(x, skip_special_tokens=False)) for i, x in want)
    assert Counter((r.id, bytes(r.ids), r.decoded) for r in got) == exp
    one_pass = byte_bpe.encode_and_decode(docs, path, words=byte_bpe.word_table(docs, path, max_words=3)).collect()
    assert Counter((r.id, bytes(r.ids), r.decoded) for r in one_pass) == exp
    assert byte_bpe.encode_and_decode(none, path).count() == 0


def test_bytes_that_are_no_text(spark):
    from quire.llm import byte_bpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = byte_bpe.piece_table(path).to_pylist()
    bad = np.array([pieces.index(b"\xc3"), pieces.index(b"a")], "<u4").tobytes()
    df = spark.createDataFrame([(1, bytearray(bad)), (2, bytearray(b""))], "id long, ids binary")
    assert {r.id: r.decoded for r in byte_bpe.decode_documents(df, path).collect()} == {1: "�a", 2: ""}


def counts_of(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rule_counts(docs, none, labels):
    from quire.llm.quality_rules import judge, keep_good

    got = judge(docs, labels).collect()
    assert Counter((r.id, *tuple(r["counts"])[:5]) for r in got) == Counter((r[0], *counts_of(r[1])) for r in awkward())
    for r in got:
        c = r["counts"]
        assert r.base_failed == (c.n_words < 50 or 100 * c.n_repeat_words > 50 * c.n_words)
        assert not (r.kept and r.base_failed)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.id for r in got if r.kept)
    assert judge(none, labels).count() == 0 and keep_good(none, labels.limit(0)).count() == 0


def test_binomial_bound(spark):
    from math import comb

    from quire.llm.quality_rules import binomial_tail

    cases = [(n, k) for n in (1, 10, 400, 2000) for k in range(0, int(n * 0.01) + 1)]
    df = spark.createDataFrame(cases, "n long, k long").withColumn("p", binomial_tail(F.col("n"), F.col("k"), 0.01))
    for r in df.collect():
        assert r.p == pytest.approx(sum(comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1)), rel=1e-9)
    big = spark.createDataFrame([(5_000_000, 40_000)], "n long, k long").select(binomial_tail(F.col("n"), F.col("k"), 0.01).alias("p")).first()
    assert 0 <= big.p < 1e-300 or big.p == 0


KEY = "id long, stratum string, good boolean, counts struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,n_lines:long,n_capitals:long>"


def cutoffs_of(rows, risk, delta):
    """The certified cutoffs of every stratum, one labelled row at a time."""
    from math import comb

    from quire.llm.quality_rules import GRID, RULES

    per = lambda a, b: a / b if b else 0.0
    cases = [(s, good, [per(c[2], c[0]), per(c[3], c[5]), per(c[4], c[0]), per(c[6], c[1]), per(c[1], c[0])], hashlib.md5(str(i).encode()).hexdigest() < "8") for i, s, good, c in rows]
    found, strata = {}, {s for s, *_ in cases}
    for stratum in strata:
        mine = [c[1:] for c in cases if c[0] == stratum]
        ordered = []
        for k, rule in enumerate(RULES):
            tried = [(sum(ch and not g and v[k] > x for g, v, ch in mine), sum(ch and g and v[k] > x for g, v, ch in mine), x) for x in GRID[rule]]
            worth = [(caught - hit, x, hit) for caught, hit, x in tried if caught > hit]
            if worth:
                net, x, hit = max(worth)
                ordered.append((hit, -net, k, x))
        limits = []
        for _, _, k, x in sorted(ordered):
            more = [*limits, (k, x)]
            held = [v for g, v, ch in mine if g and not ch]
            n, wrong = len(held), sum(any(v[r] > c for r, c in more) for v in held)
            if not n or sum(comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(wrong + 1)) > delta / len(strata):
                break
            limits = more
        if limits:
            found[stratum] = limits
    return found


def test_calibration_against_brute_force(spark):
    from quire.llm.quality_rules import calibrate

    rng = np.random.default_rng(11)
    rows = []
    # 70 strata of which some are large; null strata come as the stratum of no name.
    for k, stratum in enumerate([*(f"s{j}" for j in range(66)), "", "x", "y", "z"]):
        for good in (True, False):
            for _ in range((900 if k % 7 == 0 else 30) // (1 if good else 6)):
                share = rng.random() * (0.02 if good and rng.random() < 0.99 else 1.2)
                rows.append((len(rows), stratum, good, (100, int(rng.integers(400, 1300)), int(100 * share), int(rng.integers(0, 3)), 0, 10, int(rng.integers(0, 60)))))
    got = {r.stratum: [tuple(x) for x in r.limits] for r in calibrate(spark.createDataFrame(rows, KEY), 0.05, 0.05).collect()}
    assert got == cutoffs_of(rows, 0.05, 0.05) and 3 <= len(got) < 70
    clean, junk = (100, 500, 0, 0, 0, 10, 10), (100, 500, 90, 0, 0, 10, 10)
    many = [*[("en", True, clean)] * 1200, *[("en", False, junk)] * 50, *[("fr", True, clean)] * 40, *[("fr", False, junk)] * 9]
    found = calibrate(spark.createDataFrame([(k, *r) for k, r in enumerate(many)], KEY)).collect()
    assert [(r.stratum, [tuple(x) for x in r.limits]) for r in found] == [("en", [(0, 0.5)])]


def test_certified_cutoffs_reject(spark):
    from quire.llm.quality_rules import keep_good

    rows = [(k, prose(k, 60), "en") for k in range(1200)] + [(5000 + k, " ".join(w + "$$" for w in prose(k, 60).split()), "en") for k in range(40)]
    rows += [(i + 10_000, t, "fr") for i, t, _ in rows] + [(30_000, rows[-1][1], "es")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], int(r[0] % 10_000 < 5000)) for r in rows if r[0] not in (5001, 30_000)], "doc_id long, quality int")
    # A stratum without labels rejects nothing beyond the base rule.
    assert {r.doc_id for r in keep_good(docs, labels).collect()} == {*range(1200), *range(10_000, 11_200), 30_000}


def test_classifier(spark, docs, none, labels):
    from quire.llm.quality_model import FEATURES, fit_quality, keep_predicted, scorer

    rows = [(k, prose(k, 60), 1) for k in range(300)] + [(1000 + k, prose(k, 60).replace(" ", "** "), 0) for k in range(150)]
    many = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    known = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    forest, features = fit_quality(many, known)
    got = {r.id: r.s for r in features.select("id", scorer(forest)("features").alias("s")).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]) > 0.98
    x = np.random.default_rng(0).random((50, len(FEATURES)))
    walked = []
    for row in x:
        m = forest.prior
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(row[f[k]] > t[k])
            m += leaf[k - len(f)]
        walked.append(m)
    assert np.allclose(forest.margin(x), walked)
    out = keep_predicted(docs, labels)
    assert out.columns == docs.columns and set(map(str, out.collect())) <= set(map(str, docs.collect()))
    assert keep_predicted(docs, labels.limit(0)).count() == docs.count()
    assert keep_predicted(none, labels).count() == 0


def statistics_of(text):
    """The statistics of one text, in the order of FEATURES."""
    text = text or ""
    w, lines = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, count = len(text), lambda chars: len(re.findall(f"[{chars}]", text))
    per = lambda a, b: a / b if b else 0.0
    return [
        np.log1p(n), np.log1p(len(w)), per(sum(map(len, w)), len(w)), per(count("#*$%&<>"), len(w)), per(count("!?"), len(w)), per(count("|"), len(w)), per(count("A-Z"), n), per(count("0-9"), n),
        per(count("."), len(w)), per(count(",;:"), len(w)), per(len(text.encode()) - n, n), np.log1p(len(lines)), per(len(w), len(lines)), per(len(lines) - len(set(lines)), len(lines)),
        per(len(set(w)), len(w)), per(sum(a == b for a, b in zip(w, w[1:])), len(w)),
    ]


def written(spark, folder, **tables):
    """A folder of tables as the queries read them."""
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_statistics_and_query(spark, docs, labels, tmp_path):
    from quire.llm.quality_model import fit_quality, op1_quality_model

    forest, features = fit_quality(docs, labels)
    got = Counter((r.id, tuple(round(x, 9) for x in r.features)) for r in features.collect())
    assert got == Counter((r[0], tuple(round(float(x), 9) for x in statistics_of(r[1]))) for r in awkward())
    found = op1_quality_model(spark, written(spark, tmp_path, documents=docs.select("doc_id", "text", "lang", "source", "n_chars"), labels=labels)).collect()
    assert len(found) == len(awkward())
    for r in found:
        score = min(forest.score(np.array([statistics_of(t)]))[0] for i, t in ((x[0], x[1]) for x in awkward()) if i == r.doc_id)
        assert r.score == pytest.approx(score) and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_training_sample(spark):
    from quire.llm.quality_model import fold_of, sampled_labels

    labels = spark.createDataFrame([(k % 5000, int(k % 3 > 0)) for k in range(6000)] + [(None, 1), (7, None)], "doc_id long, quality int")
    whole = {r.id for r in sampled_labels(labels, "doc_id", "quality", 10**6).collect()}
    assert whole == {k for k in range(5000) if zlib.crc32(str(k).encode()) % 3 != 1}
    some = [r.id for r in sampled_labels(labels, "doc_id", "quality", 1000).collect()]
    assert 990 <= len(set(some)) == len(some) <= 1000 and set(some) <= whole
    assert sampled_labels(labels, "doc_id", "quality", 0).count() == 0
    assert spark.range(1).select(fold_of(F.lit(5))).first()[0] == zlib.crc32(b"5") % 3


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_of(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (14 <= len(d) <= 19 and luhn) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_pii_base_against_patterns():
    from quire.llm.pii import base_spans

    rng = np.random.default_rng(5)
    for _ in range(3000):
        text = "".join(rng.choice(list("ab1234567890@@..+- ()x%"), rng.integers(1, 60)))
        assert sorted(base_spans(text)) == sorted(base_of(text)), text
    for text in ("1.2.3.4.5.6.7.8", "a@b@c.d@e.f", "4111 1111 1111 1111", "0001.2.3.255 256.1.1.1", "9" * 50_000, "@" * 50_000, "a" * 50_000 + "@", "1." * 20_000):
        assert sorted(base_spans(text)) == sorted(base_of(text) if len(text) < 1000 or "9" in text else base_spans(text))


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail john.doe at example dot com now", "email", "john.doe at example dot com"),
        ("x john [at] mail [dot] example.org y", "email", "john [at] mail [dot] example.org"),
        ("write jоhn@exаmple.com!", "email", "jоhn@exаmple.com"),
        ("ring plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
        ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("at 192[.]168[.]0[.]1 today", "ip", "192[.]168[.]0[.]1"),
        ("host 192 dot 168 dot 0 dot 1 up", "ip", "192 dot 168 dot 0 dot 1"),
        ("+4​9 (30) 123​456 78", "phone", "+4​9 (30) 123​456 78"),
    ],
)
def test_pii_disguises(text, kind, span):
    from quire.llm.pii import scan

    base, added = scan(text)
    assert base == [] and [(k, text[s:e]) for k, s, e in added] == [(kind, span)]


def test_pii_leaves_prose_alone(docs):
    from quire.llm.pii import mask, scan

    for text in ["looked at one two three four. five", "the one at the top dot it", "see me at noon. com is late", *filter(None, texts_of(awkward()))]:
        assert scan(text) == ([], [])
    assert mask("a b@c.d e", scan("a b@c.d e")[0]) == "a [EMAIL] e"


def test_disguises_that_overlap_base_spans():
    from quire.llm.pii import mask, scan

    for text, whole in [("ask jоhn.smith@ex.com now", "jоhn.smith@ex.com"), ("ask john dot smith@ex.com now", "john dot smith@ex.com"), ("ask bob@mail.ехample.com now", "bob@mail.ехample.com")]:
        base, added = scan(text)
        assert [(k, text[s:e]) for k, s, e in added] == [("email", whole)]
        assert mask(text, [*base, *added]) == "ask [EMAIL] now"
    # Behind an address as written, words and dots are prose.
    for text in ("mail a@b.com dot the i", "mail a@b.com . The end", "mail a@b.com . the end\u200b"):
        base, added = scan(text)
        assert [text[s:e] for _, s, e in base] == ["a@b.com"] and added == []


def test_disguises_do_not_hang_on_other_text():
    from quire.llm.pii import scan

    rng = np.random.default_rng(6)
    parts = ["one", "five", "zwei", "trois", "un", "7", "12", "+1", "plus", "dot", "point", ".", "-", "(555)", "415", "at", "@", "[at]", "bob", "site", "com", "&#64;", "jоe", "x.org", "a@b.c", "4111", "1111", "192", "168", "ten", "the"]
    for _ in range(4000):
        text = " ".join(rng.choice(parts, rng.integers(2, 14)))
        alone = scan(text)
        for other in (" ; ; zz [at] yy [dot] xx", " ; ; four four four four zz", " ; ; z\u200bz"):
            base, added = scan(text + other)
            within = lambda spans: [x for x in spans if x[2] <= len(text)]
            assert (within(base), within(added)) == alone, text


def test_pii_query(spark, tmp_path):
    from quire.llm.pii import KINDS, op4_pii, scan

    texts = ["x a@b.c 1.2.3.4", "jоhn.smith@ex.com 4111 1111 1111 1111 +1 (555) 123-4567", None, "", "ring plus one five five five one two three four five six seven", "p 10.0.0.1 q@r.st 10.0.0.1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in op4_pii(spark, written(spark, tmp_path, documents=docs)).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        base = sorted(base_of(text or ""), key=lambda x: (x[1], KINDS.index(x[0])))
        shown = ",".join(f"{n}:{s}:{e}" for n, s, e in base)
        assert [got[k][f"n_{n}"] for n in KINDS] == [sum(x[0] == n for x in base) for n in KINDS]
        assert got[k].base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        spans = sorted({*base, *scan(text)[1]}, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
        assert got[k].spans == ",".join(f"{n}:{s}:{e}" for n, s, e in spans)
    assert got[1].spans.startswith("email:0:17,email:2:17")


def test_pii_frames(spark, docs, none):
    from quire.llm.pii import find_spans, redact

    assert find_spans(none).count() == 0
    one = spark.createDataFrame([(1, "mail a@b.c", 10, 7), (2, None, 0, 7)], "doc_id long, text string, n_chars long, masked int")
    assert [tuple(r) for r in redact(one).orderBy("doc_id").collect()] == [(1, "mail [EMAIL]", 12, 7), (2, None, None, 7)]
    assert redact(docs).columns == docs.columns and redact(docs).count() == docs.count()
    assert {r.base for r in find_spans(docs).collect()} == {""}


def test_interleaving(spark, docs, none):
    from quire.llm.sharding import interleave

    got = interleave(docs, shards=5).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == docs.count() and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert Counter((r.id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in awkward())
    many = spark.createDataFrame([(k, "t", "hot" if k % 3 else f"s{k % 7}") for k in range(2000)], "doc_id long, text string, source string")
    mix = Counter((r.shard, r.source) for r in interleave(many).collect())
    total = Counter("hot" if k % 3 else f"s{k % 7}" for k in range(2000))
    # A run of equal length cuts each source within one row, and its ends lie within one row of the exact quantile.
    assert all(abs(mix[s, x] - total[x] / 24) < 2 for s in range(24) for x in total)
    assert interleave(none).count() == 0 and interleave(docs.limit(2)).count() == 2
    # Every source of one row, and rows without ids: fractions all tie.
    lone = spark.createDataFrame([(None if k % 2 else k, f"t{k}", f"s{k}") for k in range(600)], "doc_id long, text string, source string")
    slots = sorted((r.shard, r.slot) for r in interleave(lone, shards=7).collect())
    sizes = Counter(s for s, _ in slots)
    assert slots == [(s, k) for s in range(7) for k in range(sizes[s])] and set(sizes.values()) == {85, 86}


VECTORS = "vec_id long, embedding array<float>, label int, v int, cell string"


def test_top_k(spark):
    from quire.llm.pivot_search import top_k

    rng = np.random.default_rng(3)
    vecs = [(k, rng.normal(0, 0.3, 8).astype(np.float32).tolist()) for k in range(900)]
    hot = [0.5] * 8
    vecs += [(1000 + k, hot) for k in range(400)] + [(2000, None), (2100, [None] * 8), (2200, [float("nan")] * 8), (2300, [1.0, 2.0]), (100, vecs[100][1]), (7, vecs[7][1])]
    df = spark.createDataFrame([(i, v, 0, 1, "c") for i, v in vecs], VECTORS).repartition(3)
    clean = [(i, np.floor(1024 * np.array(np.array(v + [0.0] * (8 - len(v)), np.float32), float)).astype(int)) for i, v in vecs if v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for q, x in {i: x for i, x in clean if i % 100 == 0}.items():
        best = sorted((-int(x @ y), i) for i, y in clean if i != q)[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, top_k(df).collect())) == sorted(want)
    few = df.where("vec_id in (100, 5, 6)")
    assert top_k(few).count() == 2
    assert top_k(df.limit(0)).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    from quire.llm.packing import pack_documents

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = pack_documents(docs, path, size=64, open_windows=3, with_ids=True).collect()
    want = Counter()
    for r in awkward():
        want.update((r[0], i) for i in [*tok.encode(r[1] or "", add_special_tokens=False).ids, 1])
    got, sequences = Counter(), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        got.update((r.id, int(i)) for i in ids)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(want.values()) > 0.85 * 64 * len(sequences)
    long = sorted((r.start, r.length) for r in rows if r.id == 8)
    assert [s for s, _ in long] == list(np.cumsum([0, *[n for _, n in long[:-1]]]))
    assert pack_documents(none, path).count() == 0


def test_warc(spark, tmp_path):
    from quire.llm.warc import LoserTree, capture_index, write_archives

    rng = np.random.default_rng(0)
    for _ in range(50):
        runs = [sorted(rng.integers(0, 20, rng.integers(0, 9)).tolist()) for _ in range(rng.integers(0, 8))]
        assert list(LoserTree(runs)) == sorted(x for r in runs for x in r)
    body = ["<p>a</p>", None, "", "x\r\n\r\nWARC/1.1\r\ny", "ü" * 1000, "<p>a</p>", "<p>a</p>"]
    pages = [(k, f"http://h{k % 3}.example.com/p q{k}\r\n", b, 1) for k, b in enumerate(body)] + [(50, None, "z" * 300_000, 2), (0, "http://h0.example.com/again", "<p>a</p>", 3)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest int")
    write_archives(df, f"file://{tmp_path}/w")
    got = capture_index(spark, f"file://{tmp_path}/w").orderBy("part", "position").collect()
    first = {}
    for i, _, b, _ in pages:
        first[b or ""] = min(first.get(b or "", i), i)
    want = Counter((i, len((b or "").encode()), base64.b32encode(hashlib.sha1((b or "").encode()).digest()).decode(), None if first[b or ""] == i else first[b or ""]) for i, _, b, _ in pages)
    assert Counter((int(r.page), r.payload_bytes, r.payload_digest, int(r.refers_to) if r.refers_to else None) for r in got) == want
    assert all(r.intact for r in got) and [(r.key, r.stamp, r.page) for r in got] == sorted((r.key, r.stamp, r.page) for r in got)
    write_archives(df.limit(0), f"file://{tmp_path}/none")
    assert capture_index(spark, f"file://{tmp_path}/none").count() == 0


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s, 42) for s in ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_of(fps):
    """Smallest id of each connected class, by comparing all pairs."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash(docs, none):
    from quire.llm.simhash import keep_representatives, near_duplicate_classes

    rows = sorted(awkward(), key=lambda r: (r[0] is None, r[0]))
    fps = [slow_fingerprint(r[1]) for r in rows]
    got = near_duplicate_classes(docs).collect()
    assert Counter((r.id, r.fp % 2**64) for r in got) == Counter((r[0], f) for r, f in zip(rows, fps))
    want = Counter((r[0], rows[c][0]) for r, c in zip(rows, classes_of(fps)))
    assert Counter((r.id, r.component) for r in got) == want
    kept = keep_representatives(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({c: 1 for _, c in want})
    assert near_duplicate_classes(none).count() == 0 and keep_representatives(none).count() == 0


def test_simhash_chains(spark):
    from quire.llm.simhash import components, links, plan_partitions

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60)
    fps = sorted({int(b ^ f) for b in base for f in (0, 1, 3, 7, 15, 1 << 40, 7 << 50, 63)} | {int(np.bitwise_xor.reduce([1 << k for k in range(n)], initial=0)) for n in range(1, 40)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    plan = plan_partitions(df)
    assert sum(plan.thresholds) == 3 - len(plan.groups) + 1 and sorted(b for g in plan.groups for b in g) == list(range(64))
    found = links(df, plan)
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    assert {(r.a, r.b) for r in found.collect()} == want
    root = {r.node: r.root for r in components(found).collect()}
    least = {fps[i]: fps[c] for i, c in enumerate(classes_of(fps))}
    assert all(root.get(f, f) == least[f] for f in fps)


def test_preferences(spark):
    from quire.llm.chat_format import format_preferences

    rows = [(1, "chosen", 0, "user", "hi", 0), (1, "chosen", 1, "assistant", "yes", 0), (1, "rejected", 0, "user", "hi", 0), (1, "rejected", 1, "assistant", "nö", 0), (1, "rejected", 2, "user", None, 0)]
    rows += [(2, s, 0, None, "same", 0) for s in ("chosen", "rejected")] + [(3, "chosen", 0, "user", "only", 0)]
    df = spark.createDataFrame(rows, "pair_id long, side string, turn int, role string, text string, n int")
    got = {r.pair_id: r for r in format_preferences(df).collect()}
    one = got[1]
    assert one.prompt == "<|user|>\nhi<|end|>\n" and one.status == "paired"
    assert one.chosen == "<|assistant|>\nyes<|end|>\n" and one.rejected == "<|assistant|>\nnö<|end|>\n<|user|>\n<|end|>\n"
    start, end = map(int, one.rejected_mask.split(":"))
    assert one.rejected[start:end] == "nö<|end|>"
    assert got[2].status == "identical" and got[2].chosen == "" and got[3].status == "one_sided"
    assert format_preferences(df.limit(0)).count() == 0


def test_preference_query(spark, tmp_path):
    from quire.llm.chat_format import op10_preferences

    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "abcdef"), (1, 2, "user", "ok"), (None, 0, "assistant", "first"), (None, 1, "assistant", "xy"), (2, None, None, None), (3, 0, "assistant", ""), (3, 0, "assistant", "")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, a int")
    got = {r.conv_id: r for r in op10_preferences(spark, written(spark, tmp_path, conversations=turns)).collect()}
    assert set(got) == {1, None, 2, 3} and {k: r.status for k, r in got.items()} == {1: "paired", None: "paired", 2: "identical", 3: "identical"}
    assert got[1].chosen == "<|assistant|>\nabcdef<|end|>\n<|user|>\nok<|end|>\n" and got[1].rejected == "<|assistant|>\nabc<|end|>\n<|user|>\nok<|end|>\n"
    assert got[None].prompt == "<|assistant|>\nfirst<|end|>\n" and got[None].rejected == "<|assistant|>\nx<|end|>\n"


def test_scratch(spark):
    from quire.llm._shared import clear_scratch, materialise, scratch_root

    assert materialise(spark.range(3), "three").count() == 3
    folder = scratch_root(spark).removeprefix("file://") + "/quire"
    import os

    assert os.path.isdir(folder)
    clear_scratch(spark)
    assert not os.path.exists(folder)

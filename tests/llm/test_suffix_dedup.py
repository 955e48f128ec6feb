"""Suffix arrays against sorted suffixes, and removal of repeats against all strings of the corpus."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import suffix_array as sa
from quire.llm.suffix_dedup import LENGTH, repeated_spans, identified, without_repeats

DOCS = "doc_id long, text string, lang string, th long, doc int, start int, len int, a string, spans string, `a.b` int"


@pytest.mark.parametrize("alphabet", [2, 3, 1024])
def test_suffix_array(monkeypatch, alphabet):
    monkeypatch.setattr(sa, "MAX_ALPHABET", alphabet)
    rng = np.random.default_rng(alphabet)
    for trial in range(300):
        n, k = int(rng.integers(0, 70)), int(rng.integers(1, 5))
        t = rng.integers(1, k + 1, n) if trial % 3 else np.resize(rng.integers(1, k + 1, 3), n)
        t = np.append(t, 0).astype(np.uint8)
        got = sa.suffix_array(t, k + 1)
        assert list(got) == sorted(range(n + 1), key=lambda i: t[i:].tobytes())
        stop = (t == 1) if trial % 2 else np.zeros(n + 1, bool)
        stop[-1] = True
        room = np.minimum.accumulate(np.where(stop, np.arange(n + 1), n + 1)[::-1])[::-1] - np.arange(n + 1)
        prefixes = sa.permuted_prefixes(t, got, room)
        for r, i in enumerate(got):
            j, same = got[r - 1], 0
            while r and same < room[i] and max(i, j) + same <= n and t[i + same] == t[j + same]:
                same += 1
            assert prefixes[i] == same
        later = sa.later_repeats(got, prefixes, 3)
        seen, want = {}, []
        for i in range(n + 1):
            if room[i] >= 3:
                s = t[i : i + 3].tobytes()
                want += [i] if s in seen else []
                seen.setdefault(s, i)
        assert sorted(later) == want


def brute(rows, length=LENGTH):
    """Rows of one id in the order of their text's hash, as the operator has it, are compared by it alone."""
    seen, out = set(), []
    for i, text in rows:
        b = (text or "").encode()
        own, gone = set(), np.zeros(len(b), bool)
        for at in range(len(b) - length + 1):
            s = b[at : at + length]
            if s in seen or s in own:
                gone[at : at + length] = True
            own.add(s)
        seen |= own
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]])))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def prose(k, n, words=400):
    rng = np.random.default_rng(k)
    some = ["".join(rng.choice(list("abcdefghiklmnoprstu"), int(rng.integers(2, 9)))) for _ in range(words)]
    return " ".join(np.random.default_rng(k + 1).choice(some, n))


def awkward():
    passage, line, long = prose(1, 40), prose(2, 11)[:60], prose(3, 3000)
    texts = [None, "", "short", "x" * 99, "x" * 100, "x" * 350, "ab" * 300, passage, passage, passage[:100], passage[:99], "é日本😀" * 40, "tail " + "é日本😀" * 40]
    texts += [f"{prose(50 + k, 30)}\n{line}\n{prose(80 + k, 30)}" for k in range(12)]
    texts += [f"{prose(110 + k, 20)} {passage} {prose(130 + k, 20)}" for k in range(12)]
    texts += [long, long[:9000] + "!" + long[9001:], long[50:] + passage, long + long[400:900], "\x00\x01" * 90, " \n\t" * 60]
    base = prose(5, 200).split()
    texts += [" ".join(base[:k] + ["edit"] + base[k + 1 :]) for k in range(0, 200, 9)]
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, 4, "a", "s", 5) for i, t in rows], DOCS).repartition(5)


def got(df):
    return Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("how", [{}, {"max_contents": 3, "local_hot": 2}, {"gram": 20, "shard_bytes": 3000, "piece": 700}, {"gram": 100, "local_hot": 5}])
def test_removal(spark, how):
    rows = awkward()
    assert got(without_repeats(frame(spark, rows), **how)) == brute(rows)


def test_batches_that_end_anywhere(monkeypatch):
    """What is decided of sorted rows does not depend on where their batches end."""
    import pyarrow as pa

    from quire.llm import suffix_dedup as sd

    monkeypatch.setattr(sd, "_gathered", lambda batches: (pa.Table.from_batches([b]) for b in batches))
    rng = np.random.default_rng(4)
    for _ in range(60):
        real = [(int(a), int(d), int(doc), 0, int(doc) * 7, 120, None) for a, d, doc in rng.integers(0, 5, (25, 3))]
        apart = [(a + 100 + d, d, doc, th, start, n, a) for a, d, doc, th, start, n, _ in real[:3]]
        marks = [(r[6], None, 0, 0, 0, 0, r[6]) for r in apart]
        covers = [(int(a), None, 9, 9, 9, 9, None) for a in rng.integers(0, 6, 3)]
        rows = sorted(real + apart + marks + covers, key=lambda r: tuple(-1 if x is None else x for x in r[:5]))
        groups, forced = {}, {r[0] for r in marks}
        for r in real + apart:
            groups.setdefault(r[0], {}).setdefault(r[1], []).append(r)
        want = {(None, *r[2:6]) for r in covers}
        for a, contents in groups.items():
            for some in contents.values():
                first = min(some, key=lambda r: r[2:5])
                want |= {(None, *r[2:6]) for r in some if r[2:5] != first[2:5]}
                if len(contents) > 1 or a in forced or first[6] is not None:
                    want.add((a if first[6] is None else first[6], *first[2:6]))
        schema = pa.schema([(n, pa.int64() if n not in ("start", "len") else pa.int32()) for n in ("a", "d", "doc", "th", "start", "len", "home")])
        for size in (1, 2, 3, 7, len(rows)):
            parts = [rows[i : i + size] for i in range(0, len(rows), size)]
            batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema) for part in parts]
            found = {tuple(r.values()) for b in sd._decided_batches(iter(batches)) for r in b.to_pylist()}
            assert found == want


def test_other_order_ids_and_repeated_rows(spark):
    passage = prose(7, 60)
    rows = [(None, passage), (-5, passage), (3, "head " + passage), (2**40, passage + " tail")]
    plain = got(without_repeats(frame(spark, rows)))
    assert plain == brute(rows)
    twice = got(without_repeats(frame(spark, [*rows, *rows])))
    assert twice == Counter({k: 2 * n for k, n in plain.items()})


def test_rows_of_one_id(spark):
    """They are documents in a fixed order: a passage in all of them stays once."""
    passage = prose(8, 60)
    rows = [(1, passage + " " + prose(200 + k, 30)) for k in range(6)]
    df = frame(spark, rows)
    order = [r.text.decode() for r in identified(df, "doc_id", "text").orderBy("doc", "th").collect()]
    assert got(without_repeats(df)) == brute([(1, t) for t in order])


def test_kept_text_and_empty_table(spark):
    rows = awkward()
    kept = {r.id: r.kept for r in without_repeats(frame(spark, rows), with_text=True).collect()}
    assert kept[0] == "" and kept[7] == rows[7][1] and kept[8] == ""
    assert without_repeats(frame(spark, [])).count() == 0
    assert repeated_spans(identified(frame(spark, rows[:5]), "doc_id", "text")).count() == 0


def test_registered_query(spark):
    from quire.llm.suffix_dedup import op13_suffix_dedup

    sf = "/root/testdata/sf0.001"
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    df = op13_suffix_dedup(spark, sf)
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert got(df.withColumnRenamed("doc_id", "id")) == brute(rows)

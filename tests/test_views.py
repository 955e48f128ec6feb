"""Views, stores, composed rows and sentence places against literal cases or brute force."""

import random

from pyspark.sql import functions as F

from quire.functions import refs, text
from quire.operators import catalog, figures, segment, sessions, views


def one(spark, column, **row):
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'binary' if isinstance(v, bytes) else 'long' if isinstance(v, int) else 'string'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], kinds).select(column.alias("x")).first().x


def test_title_key_folds(spark):
    assert one(spark, text.title_key(F.col("t")), t="Ｔｉｔｌｅ: Ｎｉ—Ｆｅ Straße ﬁlm") == "ni fe strasse film"
    assert one(spark, text.title_key(F.col("t")), t=" TITLE : Über, Maß!") == "über mass"


def test_panel_captions(spark):
    assert one(spark, refs.panel_caption(refs.figure_label(F.col("t")), F.lit("A"), F.col("t")), t="Figure 2. (a–c) XRD (a) one") == "Figure 2a — XRD one"
    assert one(spark, refs.panel_caption(refs.figure_label(F.col("t")), F.lit("b"), F.col("t")), t="") == "Fig b"


def test_sentence_places(spark):
    given = "  See Fig. 1 now. The end.  The end. \n\"Quoted.\" No.  "
    rows = segment.sentence_spans(spark.createDataFrame([(1, given), (2, None)], "doc_id long, text string")).orderBy("ord").collect()
    bare = given.strip(" ")
    assert [bare[r.start : r.end] for r in rows] == [r.text for r in rows] and [r.start for r in rows] == sorted(r.start for r in rows) and len(rows) >= 4


def test_page_sample_keeps_both_ends(spark):
    pages = [(1, k, "x" * 30) for k in range(40)] + [(2, 0, " ")]
    got = {r.doc: r.sample for r in segment.page_sample(spark.createDataFrame(pages, "doc long, page int, text string"), "doc", "page", most=600).collect()}
    blocks = [f"--- PAGE {k} ---\n" + "x" * 30 for k in range(40)]
    head, size = [], 0
    for b in blocks:
        if size + len(b) + 2 > 480:
            break
        head.append(b)
        size += len(b) + 2
    tail, used = [], 0
    for b in reversed(blocks):
        if b in head or used + len(b) + 2 > 600 - size - 40:
            break
        tail.append(b)
        used += len(b) + 2
    assert got[1] == "\n\n".join(head) + "\n\n[...middle pages omitted...]\n\n" + "\n\n".join(reversed(tail)) and tail and head
    assert got[2] == "--- PAGE 0 ---\n(empty)"


def test_tables_are_taken_in_turn(spark):
    rng = random.Random(3)
    caps, tabs = [], []
    for page in range(30):
        for k in range(4):
            y = rng.randrange(0, 700)
            caps.append((page, k, f"table:{rng.randrange(3)}", 50.0, float(y), 250.0, float(y + 10)))
            x, y = rng.choice((40, 300)), rng.randrange(0, 700)
            tabs.append((page, k, float(x), float(y), float(x + rng.choice((20, 200))), float(y + rng.choice((20, 60, 120)))))
    cdf = spark.createDataFrame(caps, "page int, caption_no int, caption_key string, x0 double, y0 double, x1 double, y1 double")
    tdf = spark.createDataFrame(tabs, "page int, image_no int, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([(p, 0.0, 0.0, 600.0, 800.0) for p in range(30)], "page int, px0 double, py0 double, px1 double, py1 double")
    got = {(r.page, r.caption_no): r.image_no for r in figures.captioned_rows(cdf, tdf, pages, ["page"], tables=True).collect()}
    want = {}
    for page in range(30):
        used, keys = [], set()
        for _, no, key, x0, y0, x1, y1 in sorted(c for c in caps if c[0] == page):
            if key in keys:
                continue
            keys.add(key)
            best = None
            for _, t, a, b, c, d in (t for t in tabs if t[0] == page):
                over = any(max(0, min(c, u[2]) - max(a, u[0])) * max(0, min(d, u[3]) - max(b, u[1])) > 0.5 * min((c - a) * (d - b), (u[2] - u[0]) * (u[3] - u[1])) for u in used)
                aside = min(x1, c) - max(x0, a) >= 0.12 * max(c - a, 1) or a - 40 <= (x0 + x1) / 2 <= c + 40
                if c - a < 40 or d - b < 30 or over or not aside:
                    continue
                for mode, gap, most in ((0, b - y1, 120), (1, y0 - d, 150)):
                    if 0 <= gap <= most:
                        best = min(best or ((9,),), ((mode, gap, -(c - a) * (d - b), t), (a, b, c, d)))
            want[page, no] = best[0][3] if best else None
            if best:
                used.append(best[1])
    assert got == want and len(set(want.values())) > 3


def test_upload_steps():
    step = sessions.chunk_step
    assert step(0, 0, 10, 25, 10) == ("ok", 10) and step(0, 0, 10, 25, 10, False) == ("chunk_hash_mismatch", 0)
    assert step(25, 25, 1, 25, 10) == ("upload_already_complete", 25) and step(20, 20, 6, 25, 10) == ("chunk_past_end", 20) and step(10, 10, 5, 25, 10) == ("chunk_size_mismatch", 10)
    assert step(0, 0, 7, None, 10) == ("ok", 7) and step(0, 1, 7, None, 10)[0] == "offset_mismatch"


def test_parts_with_stated_digests(spark):
    rows = [("a", 1, 0, 10, 20, "aa", " AA"), ("a", 2, 10, 10, 20, "bb", "cc"), ("a", 3, 10, 10, 20, "bb", None)]
    got = sessions.append_chunks(spark.createDataFrame(rows, "upload_id string, seq long, offset long, size long, total long, digest string, stated string"), chunk=10)
    assert [(r.seq, r.outcome) for r in got.orderBy("seq").collect()] == [(1, "ok"), (2, "chunk_hash_mismatch"), (3, "ok")]


def test_playback_rate(spark):
    rates = [(0.1,), (3.0,), (None,), (float("nan"),), (1.3,)]
    assert [r.x for r in spark.createDataFrame(rates, "r double").select(views.playback_rate(F.col("r")).alias("x")).collect()] == [0.5, 2.2, 1.0, 1.0, 1.3]


def test_publish_merges_replicas(spark):
    kind = "pos int, id string, title_key string, source string, updated_at string"
    remote = spark.createDataFrame([(0, "a", "k", "pdf", "2"), (1, "b", "", "pdf", "1")], kind)
    local = spark.createDataFrame([(0, "a", "k", "pdf", "3"), (1, "c", "k", "pdf", "1")], kind)
    assert {(r.id, r.updated_at) for r in catalog.publish(remote, local).collect()} == {("a", "3"), ("b", "1")}


def test_short_keys_are_found_too(spark):
    heads = spark.createDataFrame([(1, "x " + "a" * 30 + " " + "b" * 30 + " y", "s"), (2, "the quick brown foxes jumped far", "s")], "doc_id long, head string, source string")
    keys = spark.createDataFrame([("p", 0, "a" * 28 + " " + "b" * 5, "s"), ("q", 1, "uick brown foxes jumped f", "s"), ("r", 2, "a" * 24, "t")], "id string, pos int, title_key string, source string")
    assert {(r.doc_id, r.id) for r in catalog.match_titles(heads, keys).collect()} == {(1, "p"), (2, "q")}
    lone = spark.createDataFrame([("l", 0, "a" * 26, "s")], "id string, pos int, title_key string, source string")
    assert {(r.doc_id, r.id) for r in catalog.match_titles(heads, lone).collect()} == {(1, "l")}


def test_stamp_stores_keep_the_newest_users(spark):
    rows = spark.createDataFrame([(f"u{k}", t) for k in range(6) for t in (k, k + 10, k)], "uid string, t long")
    got = lambda **kw: {r.uid: r.stamps for r in catalog.merge_stamp_stores(rows, **kw).collect()}
    assert got(users=2, over=5) == {"u5": [5, 15], "u4": [4, 14]}
    assert got(users=2, over=6, keep=1) == {f"u{k}": [k + 10] for k in range(6)}


def test_titles_inside_heads(spark):
    """Anchors find every key that a plain search finds, at any place and in any script."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "dé", "日本語", "x", "nanowire", "of", "the"]
    heads = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), rng.choice("ab")) for k in range(120)]
    keys = [(f"k{k}", k, h[(s := rng.randint(0, max(len(h) - 30, 0))) : s + rng.randint(20, 45)], rng.choice("ab")) for k, (_, h, _) in enumerate(heads)]
    keys += [("twin", 900, keys[0][2], keys[0][3]), ("long", 901, heads[3][1], heads[3][2])]
    want = {}
    for doc, head, source in heads:
        inside = [(-len(key), pos, i, key) for i, pos, key, s in keys if s == source and len(key) >= 24 and key in head]
        if inside:
            want[doc] = min(inside)[2:]
    docs = spark.createDataFrame(heads, "doc_id long, head string, source string")
    got = catalog.match_titles(docs, spark.createDataFrame(keys, "id string, pos long, title_key string, source string")).collect()
    assert {r.doc_id: (r.id, r.title_key) for r in got} == want and len(want) > 30


def test_places_of_a_long_text(spark):
    given = " ".join(f"Sentence number {k} says e.g. this." for k in range(60_000)) + "\n"
    rows = segment.sentence_spans(spark.createDataFrame([(1, given)], "doc_id long, text string")).orderBy("ord").collect()
    assert len(given) > 2_000_000 and len(rows) == 5000 and all(given[r.start : r.end] == r.text for r in rows)

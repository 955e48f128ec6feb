"""Sessions with their index, bundles of two stores, linked accounts, and answers in rounds, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import accounts, debone, docx, library

SESSION = "title string, source string, content_hash string, sentences array<struct<id:string,text:string,section:string>>, figures long"


def sessions(spark, *rows):
    body = lambda n: [(f"s{k}", f"text {k}", "body") for k in range(n)]
    return spark.createDataFrame([(title, source, None, body(n), 1) for title, source, n in rows], SESSION)


def index_of(spark, root):
    return {r.id: (r.title, r.source, r.created_at, r.updated_at, r.sentences) for r in library.current_index(spark, root).collect()}


def test_a_save_is_whole_or_not_there(spark, tmp_path, monkeypatch):
    root, long = str(tmp_path / "lib"), "A title that is long enough to count "
    assert index_of(spark, root) == {}
    first = sessions(spark, (long + "one", "pdf", 3), (long + "two", "docx", 2), ("short", "pdf", 4), (long + "none", "pdf", 0))
    assert library.save_sessions(root, "b1", 1, first, "2024-01-01")
    before = index_of(spark, root)
    assert sorted(before.values()) == [(long + "one", "pdf", "2024-01-01", "2024-01-01", 3), (long + "two", "docx", "2024-01-01", "2024-01-01", 2)]
    # The same batch again changes nothing, whatever it holds.
    assert not library.save_sessions(root, "b1", 1, sessions(spark, (long + "other", "pdf", 9)), "2025")
    assert index_of(spark, root) == before
    second = sessions(spark, (long + "ONE!", "odd", 5), (long + "three", "pdf", 1))
    with monkeypatch.context() as patch:
        patch.setattr(spark, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed before the pointer")))
        with pytest.raises(RuntimeError, match="killed"):
            library.save_sessions(root, "b2", 2, second, "2024-02-02")
    assert (tmp_path / "lib/versions/b2/index").exists() and index_of(spark, root) == before
    assert library.save_sessions(root, "b2", 2, second, "2024-02-02")
    after = index_of(spark, root)
    one = next(i for i, v in before.items() if v[0].endswith("one"))
    assert after[one] == (long + "ONE!", "pdf", "2024-01-01", "2024-02-02", 5) and len(after) == 3
    texts = spark.read.parquet(f"{root}/versions/b2/sentences").where(F.col("paper_id") == one).orderBy("ord").collect()
    assert [r.text for r in texts] == [f"text {k}" for k in range(5)]


def test_a_plan_that_is_done_has_nothing_left(spark):
    rng = random.Random(2)
    names = ["session.json", "source.pdf", "figures/a.png", "figures/b.png", "figures/../x", "notes.txt"]
    listing = lambda s: [(f"p{k}", n, rng.choice("ab"), rng.choice([0, 10, 10, 10, 9_000_000])) for k in range(30) for n in names if rng.random() < 0.7]
    kinds = "id string, name string, digest string, bytes long"
    local, remote = spark.createDataFrame(listing("l"), kinds).cache(), spark.createDataFrame(listing("r"), kinds).cache()
    stamps = lambda: spark.createDataFrame([(f"p{k}", rng.choice(["1", "2", "3"])) for k in range(30)], "id string, updated_at string").cache()
    at_l, at_r = stamps(), stamps()
    plan = library.sync_plan(local, remote, at_l, at_r).cache()
    assert {r.action for r in plan.collect()} == {"copy", "replace", "keep", "delete"}
    l2, r2 = library.listing_after(local, plan, remote, "down"), library.listing_after(remote, plan, local, "up")
    l_at, r_at = library.stamps_after(plan, at_l, at_r, "down"), library.stamps_after(plan, at_r, at_l, "up")
    assert library.sync_plan(l2, r2, l_at, r_at).count() == 0
    # Even a store that did not take over the times has nothing left to copy, replace or delete in that direction.
    again = {(r.id, r.name, r.direction): r.action for r in library.sync_plan(l2, r2, at_l, at_r).collect()}
    assert {again.get((r.id, r.name, r.direction), "keep") for r in plan.collect()} == {"keep"}
    assert not [r for r in plan.collect() if r.action in ("copy", "replace") and (".." in r.name or r.name == "notes.txt")]


def replay(commands):
    """All commands in one order, over all accounts."""
    users, owners, out = {}, {}, {}
    for seq, op, uid, provider, subject, fresh in sorted(commands):
        provider, subject = provider.strip().lower(), subject.strip()
        subject = subject.lower() if provider == "email" else subject
        key = (provider, subject)
        if provider not in ("google", "kakao", "email") or (op != "unlink" and not subject) or (op != "resolve" and not uid):
            out[seq] = ("invalid", None)
        elif op == "resolve" and owners.get(key) in users:
            out[seq] = ("ok", owners[key])
        elif op == "resolve":
            new = uid or (subject if provider == "google" else fresh)
            new = fresh if new in users else new
            users.setdefault(new, {})[provider] = subject
            owners[key] = new
            out[seq] = ("created", new)
        elif uid not in users:
            out[seq] = ("user_missing", None)
        elif op == "link" and owners.get(key, uid) != uid:
            out[seq] = ("conflict", None)
        elif op == "link":
            users[uid][provider] = subject
            owners[key] = uid
            out[seq] = ("ok", uid)
        elif provider not in users[uid]:
            out[seq] = ("not_linked", None)
        elif len(users[uid]) < 2:
            out[seq] = ("last_provider", None)
        else:
            gone = (provider, users[uid].pop(provider))
            if owners.get(gone) == uid:
                del owners[gone]
            out[seq] = ("ok", uid)
    return out


def test_linked_accounts(spark):
    rng = random.Random(7)
    commands = [(k, rng.choice(["resolve", "resolve", "link", "unlink"]), rng.choice(["", *[f"u{j}" for j in range(40)]]), rng.choice(["Google", "kakao", "email", "other"]), rng.choice(["", *[f"S{j}" for j in range(60)], *[f"u{j}" for j in range(5)]]), f"f{k}") for k in range(400)]
    # A chain of links joins commands that share nothing with each other.
    commands += [(1000 + k, "link" if k % 2 else "resolve", f"c{k // 2}", "kakao", f"w{(k + 1) // 2}", f"g{k}") for k in range(30)]
    df = spark.createDataFrame(commands, "seq long, op string, uid string, provider string, subject string, fresh string").repartition(5)
    got = {r.seq: (r.code, r.account) for r in accounts.linked_accounts(df).collect()}
    assert got == replay(commands)
    assert {c for c, _ in got.values()} == {"invalid", "ok", "created", "user_missing", "conflict", "not_linked", "last_provider"}
    groups = {r.seq: r.grp for r in accounts.command_groups(df.withColumn("provider", F.lower("provider"))).collect()}
    assert len({groups[1000 + k] for k in range(30)}) == 1
    assert accounts.linked_accounts(df.limit(0)).count() == 0


def test_debone_asks_only_what_failed(spark):
    docs = spark.createDataFrame([(1, "Abstract here"), (2, "plain"), (3, None)], "doc long, text string")
    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "doc long, chunk int, text string")
    asked = []

    def ask(pending):
        rows = pending.collect()
        asked.append(sorted((r.doc, r["try"], r.chunk) for r in rows))
        good = lambda name: '{"sentences":[{"text":"A <b>bold</b> claim %s","section":"%s"}]}' % (name, name)
        said = {(1, 0, 1): good("results"), (1, 1, 3): good("body"), (1, 0, 2): None, (1, 0, 3): good("abstract"), (2, 0, 1): "[]"}
        out = [(r.doc, r.chunk, r["try"], said.get((r.doc, r.chunk, r["try"])), None if (r.doc, r.chunk, r["try"]) in said else "down") for r in rows]
        return spark.createDataFrame(out, "doc long, chunk int, try int, answer string, error string")

    sentences, outcomes = debone.debone(docs, chunks, ask)
    assert [(r.text, r.section) for r in sentences.where("doc = 1").orderBy("ord").collect()] == [("A bold claim abstract", "abstract"), ("A bold claim body", "body")]
    assert asked == [[(1, 1, 0), (1, 1, 1), (2, 1, 0)], [(1, 2, 1)], [(1, 3, 1)], [], [(1, 2, 0)], [(1, 3, 0)]] or asked == [[(1, 1, 0), (1, 1, 1), (2, 1, 0)], [(1, 2, 1)], [(1, 3, 1)], [(1, 2, 0)], [(1, 3, 0)]]
    assert {r.doc: (r.ok, r.warning, r.chunks_ok, r.chunks_total) for r in outcomes.collect()} == {1: (True, None, 2, 2), 2: (False, "no_sentences", 1, 1), 3: (False, "empty_text", 0, 0)}


def test_docx_blocks(spark):
    kinds = "doc int, o int, kind string, text string, images array<string>, at int, n int"
    rows = [("text", "", ["a"]), ("text", None, ["b"]), ("text", " ", []), ("text", "Figure 1: two", ["own"]), ("table", "x", None), ("text", "", ["c"]), ("table", "y", None), ("text", "Fig. 2 late", []), ("text", "Scheme 3 mine", ["d", "e"]), ("text", "Table S1. cells", []), ("text", "", []), ("table", "1 | 2", None), ("table", "3", None), ("text", "TABLE 2", ["f"]), ("text", "words", ["g"]), ("table", " ", None)]
    df = spark.createDataFrame([(1, k, kind, text, images, 0, 0) for k, (kind, text, images) in enumerate(rows)], kinds)
    got = docx.docx_figures(df, "doc", "o").orderBy("n").collect()
    assert [(r.n, r.kind, r.o, r.image, r.caption, r.content) for r in got] == [
        (1, "figure", 0, "a", "Figure 1: two", None), (2, "figure", 1, "b", "Figure 1: two", None), (3, "figure", 8, "d", "Scheme 3 mine", None), (4, "figure", 8, "e", "Scheme 3 mine", None), (5, "table", 11, None, "Table S1. cells", "1 | 2"),
    ]
    assert docx.docx_figures(df, "doc", "o", most=2).count() == 2 and docx.docx_figures(df.limit(0), "doc", "o").count() == 0

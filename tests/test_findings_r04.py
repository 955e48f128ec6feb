"""What FINDINGS_r04 asked for, outside the training-data operators."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_survey_symbols_parses_an_answer_once_and_deals_rows_out(spark):
    plan = plan_of(entry.queries()["survey_symbols"](spark, SF))
    assert plan.count("from_json") == 1 and "get_json_object" not in plan and "RepartitionByExpression" in plan


@pytest.mark.parametrize("text, want", [(' \x0b\n```json\n{"a": "{x}"}\r\n``` ', '{"a": "{x}"}'), ("a { b\n} c } d", "{ b\n} c }"), ("} {", None), ("", None), (None, None)])
def test_json_object(spark, text, want):
    from quire.functions.records import json_object

    assert spark.createDataFrame([(text,)], "t string").select(json_object(F.col("t"))).first()[0] == want


def test_strip_takes_ascii_white_space_alone(spark):
    from quire.functions.records import strip

    assert spark.createDataFrame([(" \t\r\n\x0b\f a \n b  \f",), (" ",)], "t string").select(strip(F.col("t"))).collect() == [(("a \n b "),), ("",)]


def test_places_that_no_key_shares_are_sieved_out(spark):
    from quire.functions.grams import anchored, sieve

    head = " ".join(f"word{k * k % 997} of {k}" for k in range(400))
    key = head[1000:1200]
    keys = anchored(spark.createDataFrame([(1, key)], "id int, t string"), "t", 24, 12, first=True)
    heads = spark.createDataFrame([(7, head), (8, "another text without that passage, long enough for a window")], "doc int, t string")
    rows = anchored(heads, "t", 24, 12, among=sieve(keys.select("anchor"), 1)).collect()
    assert 1 <= sum(r.doc == 7 for r in rows) <= 3 and len(rows) <= 4
    want = keys.first()
    met = [r for r in rows if r.anchor == want.anchor]
    assert met and all(r.rest >= want.rest and r.marks[: len(want.marks)] == want.marks for r in met) and len(want.marks) == 1


def test_titles_of_near_copies(spark):
    """Long keys that run on differently, equal keys of several entries, and keys longer than what is left of a head."""
    from quire.operators.catalog import match_titles

    text = " ".join(f"w{k}" for k in range(600))
    keys = [(3, "c", text[:1500]), (2, "b", text[:1500]), (4, "d", text[:900] + " other words"), (5, "e", text[:90]), (6, "f", text + " and more"), (7, "g", text[:23])]
    catalog = spark.createDataFrame([(i, p, "en", k) for p, i, k in keys], "id string, pos int, source string, title_key string")
    docs = spark.createDataFrame([(1, "en", text), (2, "en", "x " + text[:1000]), (3, "de", text), (4, "en", text[:900] + " other words " + text[:90])], "doc_id int, source string, head string")
    assert sorted(map(tuple, match_titles(docs, catalog).collect())) == [(1, "b", text[:1500]), (2, "e", text[:90]), (4, "d", text[:900] + " other words")]


def test_bundle_sync_joins_nothing(spark):
    """The optimizer took sides of a bundle for small and broadcast them; now there is nothing to broadcast."""
    assert "Join" not in plan_of(entry.queries()["bundle_sync"](spark, SF))


@pytest.fixture(scope="module")
def given(tmp_path_factory):
    """A function that writes a table (of SQL) into a folder and returns the folder."""
    import duckdb

    def make(**tables):
        folder = tmp_path_factory.mktemp("given")
        for name, sql in tables.items():
            duckdb.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        return str(folder)

    return make


def same_as_sql(spark, name: str, folder: str) -> None:
    import glob
    import os

    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM read_parquet('{f}')")
    want = c.execute(entry.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    want = want.fetchall()
    got = [tuple(r[k] for k in columns) for r in entry.queries()[name](spark, folder).collect()]
    assert want and sorted(map(repr, got)) == sorted(map(repr, want))


def test_caption_images_are_one_answer_at_ties(spark):
    """Two images alike in all but their places: whichever comes first in the input, the same is taken."""
    from quire.operators.figures import assign

    captions = [(p, n, x, 200.0, x + 60, 212.0) for p in range(40) for n, x in ((1, 70.0), (2, 200.0))]
    images = [(p, 1, x, 100.0, x + 60.0, 180.0) for p in range(40) for x in (10.0, 130.0)]
    kinds = "page int, {} int, x0 double, y0 double, x1 double, y1 double"
    c = spark.createDataFrame(captions, kinds.format("caption_no"))
    for rows in (images, images[::-1]):
        taken = assign(c, spark.createDataFrame(rows, kinds.format("image_no")).coalesce(1), ["page"]).collect()
        assert sorted(map(tuple, taken)) == [(p, n, 1, 0) for p in range(40) for n in (1, 2)]


def test_later_revisions_with_part_keys_over_a_million(spark, given):
    rows = "SELECT i // 9 AS l_orderkey, (1 + i % 3)::int AS l_linenumber, (i * 700001) % 3000000 AS l_partkey, substr('NRA', 1 + (i * 7 % 3)::int, 1) AS l_returnflag FROM range(900) r(i)"
    same_as_sql(spark, "later_revisions", given(lineitem=rows))


_odd = ["a\nb\nc", "long line\nx\ny\nlast one", "1\n\n2\n3", "\nq\n", "x-\ny-\nz\nw", "ends\n", "\x0b kept \x0b", "a\nb", "two  "]
_odd = "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{t}')" for k, t in enumerate(_odd)) + ", (98, NULL), (99, '')) v(doc_id, text)"


@pytest.mark.parametrize("name", ["page_normalize", "reading_order"])
def test_lines_of_one_character(spark, given, name):
    same_as_sql(spark, name, given(documents=_odd.replace("INTEGER", "BIGINT")))


def test_stamp_stores_of_many_users(spark, given):
    same_as_sql(spark, "stamp_stores", given(events="SELECT i AS event_id, i % 5200 AS user_id FROM range(10000) r(i)"))


def test_write_throttle_after_zero(spark, given):
    rows = "SELECT i AS event_id, 1::bigint AS user_id, CASE WHEN i < 3 THEN 0.0 ELSE (i % 4) / 3.0 END AS value, 'view' AS event_type FROM range(20) r(i)"
    same_as_sql(spark, "write_throttle", given(events=rows))

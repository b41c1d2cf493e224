"""Every driver query with SQL equals its SQL on the smallest tables."""

import duckdb
import pytest

from veilscan.operators import query as q
from veilscan.operators import scan as s
from veilscan.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(str, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, small, name):
    assert _rows(QUERIES[name](spark, small).toPandas()) == _rows(duck.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() >= 0


def test_auth_tokens_are_those_of_the_sql(spark, tmp_path):
    h = "9233a8ecf7c5b09f"
    texts = [f'TOKEN = "{h.upper()}"', f'x token = "{h}" api_token = "{h}"', f'token = "{h}"', f'token = "{h}"', f'token: {h}', 'token = "0000000000000000"', f'token = "{h[1:]}"', None, ""]
    spark.createDataFrame([(min(i, 7), x) for i, x in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = _rows(QUERIES["doc_auth_tokens"](spark, str(tmp_path)).toPandas())
    assert got == _rows(con.execute(ORACLE_SQL["doc_auth_tokens"]).df()) and len(got) == 4


def test_scan_tasks_follow_the_rows(spark, tmp_path, monkeypatch):
    from veilscan.plans import corpus

    spark.range(2000).selectExpr("id as o_orderkey", "'2-HIGH' as o_orderpriority").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(s, "ROWS_A_TASK", 100, raising=False)
    for more in ({}, {"ordered": True}):
        tasks = [len(x) for x in corpus.sources(spark, str(tmp_path), **more).select("source_key").rdd.glom().collect()]
        assert len(tasks) == 20 and sum(tasks) == 2000 and max(tasks) <= 200
    assert [r.source_key for r in corpus.sources(spark, str(tmp_path), True).collect()] == list(range(2000))


def _entries(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    return s.scan(s.sources(rows, "k", "t", "k"))


def test_empty_table_and_nulls(spark):
    none = _entries(spark, []) if False else s.scan(s.sources(spark.createDataFrame([], "k long, t string"), "k", "t"))
    assert q.summary(none).first().scanned_sources == 0 and q.Query(none).is_empty() and not q.has_critical(none).first()[0]
    some = _entries(spark, [None, "", "password = hunter2hunter2"])
    assert [r.source_bytes for r in some.orderBy("source_key").collect()] == [0, 0, 25]
    assert q.Query(some).count() == 1 and q.Query(some).first().rule_id == "generic.password-field" and q.single_report(some) is None


def test_later_constraints_replace_earlier_ones(spark):
    e = _entries(spark, ["password = hunter2hunter2", "ghp_aB3dE5gH7jK9mN1pQ3sT5vW7"])
    assert q.Query(e).critical().min_severity("high").count() == 2
    assert q.Query(e).min_severity("high").critical().count() == 1
    assert [r.source_key for r in q.Query(e).sort("severity", True).collect()] == [1, 0]
    assert q.Query(e).last().source_key == 1


def test_windows_equal_kernel(spark):
    rows = spark.createDataFrame([(0, "db_password=hunter2hunter2 token: ghp_aB3dE5gH7jK9mN1pQ3sT5vW7 AB1Z-CD2Y-EF3X-GH4W"), (1, "password = AB1Z-CD2Y-EF3X-GH4W")], "k long, t string")
    src = s.sources(rows, "k", "t", "k")
    key = lambda r: (r.source_key, r.rule_id, r.start, r.end)
    found = s.findings(s.scan(src))
    assert sorted(map(key, s.resolve_exact_spans(s.accepted(src)).collect())) == sorted(map(key, found.collect()))
    assert [r.start for r in s.suppress_candidates(s.review_candidates(src), found).collect()] == [r.start for r in s.candidates(s.scan(src)).collect()]


def test_sql_table_function(spark):
    from veilscan.functions.checks import register

    register(spark)
    assert spark.sql("select rule_id, line from values ('password = hunter2hunter2') t(x), lateral veil_scan(x)").collect() == [("generic.password-field", 1)]


def test_files(spark, tmp_path):
    from veilscan.sources.files import read_key, text_files

    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfx\r\n")
    assert text_files(spark, str(tmp_path)).first().text == "﻿x\r\n"
    (tmp_path / "b.txt").write_bytes(b"\xff")
    with pytest.raises(Exception, match="invalid_utf8"):
        text_files(spark, str(tmp_path)).collect()
    (tmp_path / "k").write_bytes(b"x" * 31)
    with pytest.raises(ValueError, match="32"):
        read_key(str(tmp_path / "k"))

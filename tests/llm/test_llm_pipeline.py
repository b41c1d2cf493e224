"""The pipeline against a brute-force version of its stages, and the driver's registry."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm_operators import RANKS, PATTERN, brute_components

import corpus_pipeline
from veilscan.llm import bpe, mixing, quality_classifier, secrets
from veilscan.llm.queries import ORACLE_SQL, QUERIES, domains


def test_registry():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {re.match(r"op\d+", n)[0] for n in QUERIES} == {f"op{n}" for n in range(1, 11)} and set(QUERIES) | {"pipeline"} <= names
    assert set(entry.oracle_sql()) <= names and set(ORACLE_SQL) <= set(QUERIES) and corpus_pipeline.ORACLE_SQL is None
    assert public_tokenizers.PATTERN == PATTERN


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracles(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    got, want = QUERIES[name](spark, small).toPandas(), con.execute(ORACLE_SQL[name]).df()
    rows = lambda f: sorted(map(str, f[sorted(got.columns)].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_pipeline_equals_its_parts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    columns = docs.columns
    state = docs
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in state.collect()]
        after = spark.createDataFrame(stage(spark, state, small).collect(), stage(spark, state, small).schema)
        rows = [tuple(r) for r in after.select(columns).collect()] if name != corpus_pipeline.STAGES[-1][0] else after.collect()
        if name.startswith("quality"):
            model = quality_classifier.train(docs, labels)
            kept = {r.doc_id for r in quality_classifier.score(docs, model).where("predicted = 1").collect()}
            assert sorted(rows) == sorted(r for r in before if r[0] in kept) and 0 < len(rows) < len(before)
        elif name.startswith("n-gram"):
            roots, _ = brute_components([(r[0], r[1]) for r in before])
            assert sorted(rows) == sorted(r for r in before if roots[r[0]] == r[0]) and len(rows) < len(before)
        elif name.startswith("secret"):
            enc = bpe.BytePairEncoder(bpe.parse_ranks(bpe.read_ranks(RANKS)), PATTERN)
            masked = {r[0]: secrets.masked(r[1], secrets.all_spans(r[1], enc)[1]) for r in before}
            assert sorted(rows) == sorted((r[0], masked[r[0]], *r[2:4], len(masked[r[0]])) for r in before)
        elif name.startswith("mixing"):
            out, _ = mixing.mix(state, domains(labels), corpus_pipeline.SHARES, anchor="clean", margin=corpus_pipeline.KEEP_CLEAN)
            copies = {r.doc_id: r.copies for r in out.collect()}
            assert Counter(rows) == Counter({r: copies[r[0]] for r in before if copies[r[0]]})
            clean = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()} & {r[0] for r in before}
            assert len(clean & {r[0] for r in rows}) >= 0.85 * len(clean)
            # what the stage promises: clean tokens keep their mean rate, toxic ones their share, both in expectation
            got = out.collect()
            have, made = (sum((r.rate if k else 1) * r.tokens * r.posterior[0] for r in got) for k in (0, 1))
            toxic = sum(r.rate * r.tokens * r.posterior[1] for r in got)
            assert abs(made / have - corpus_pipeline.KEEP_CLEAN) < 1e-3 and abs(toxic / (made + toxic) - corpus_pipeline.SHARES["toxic"]) < 1e-3
        else:
            assert len(rows) == len(before)
            enc = bpe.BytePairEncoder(bpe.parse_ranks(bpe.read_ranks(RANKS)), PATTERN)
            texts = {r[0]: r[1] for r in before}
            for r in rows:
                assert r.token_ids == enc.encode(texts[r.doc_id]).tolist() and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
                assert r.ids_sha256 == hashlib.sha256(np.array(r.token_ids, "<u4").tobytes()).hexdigest()
        state = after


def test_stages_take_odd_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, t string, score int"
    rows = [(1, None, None, None, None, "x", 1), (2, "", "en", "s", 0, None, None), (None, "a b c d e f g", "en", "s", 3, "y", 2), (3, "word " * 5000, "en", "s", 1, "z", 3), (4, "plain words that say something here", "en", "s", 1, "z", 3), (4, "plain words that say something here", "en", "s", 1, "z", 3)]
    spark.createDataFrame([(4, 1, 0), (3, 0, 0), (2, None, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for data in (rows, []):
        for name, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(data, schema)
            out = stage(spark, docs, str(tmp_path))
            out.write.mode("overwrite").parquet(str(tmp_path / "out"))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
    same = "plain words that say something here and now"
    odd = [(8, same, "en", "s", 1, "z", 3), (8, "another text under the very same id", "en", "s", 1, "z", 3), (9, same, "en", "s", 1, "z", 3), (None, same, "en", "s", 1, "z", 3), (None, "a text without an id at all, here", "en", "s", 1, "z", 3)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(odd, schema), str(tmp_path))
    assert sorted(r.text for r in kept.collect()) == sorted({r[1] for r in odd})
    deduped = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, schema), str(tmp_path))
    assert deduped.where("doc_id = 4").count() == 1 and deduped.where(F.col("doc_id").isNull()).count() == 1

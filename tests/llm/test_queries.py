"""Registered queries on the smallest tables: SQL twins, contracts and the pipeline stage by stage."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from kpiforge.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key) == sorted(
        want.project(", ".join(cols)).fetchall(), key=key
    )


def test_shards_are_even(spark):
    got = queries.op6_sharding(spark, SF).toPandas()
    assert got.groupby("shard")["size"].sum().agg(["min", "max"]).diff().iloc[1] <= got["size"].max()


def test_scores_of_held_out_texts_beat_the_base(spark):
    rows = queries.op4_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r["score"] for r in rows) > 0.97 * sum(r["base_score"] for r in rows)
    assert sum(r["score"] > r["base_score"] for r in rows) > 0.8 * len(rows)


def test_toxicity_is_right_on_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = {r["doc_id"]: r["toxic"] for r in queries.op9_toxicity(spark, sf).collect()}
    assert sum(found[i] == bool(t) for i, t in labels.items()) >= 0.97 * len(labels)
    assert sum(found[i] for i, t in labels.items() if not t) <= 0.01 * len(labels)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0 and quality = 1").collect()}
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = at
        at = stage(spark, before, SF).cache()
        seen[name] = (before, at)
        if name != "packing":
            assert at.columns == docs.columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    kept = ids(seen["toxicity"][1])
    assert 2 * len(kept & toxic) < len(toxic) and len(clean - kept) <= 2
    assert ids(seen["line_dedup"][1]) == kept
    from kpiforge.llm import mixing, simhash

    before, after = seen["simhash_near_dedup"]
    groups = simhash.near_duplicates(before).collect()
    assert ids(after) == {r["component_id"] for r in groups}
    before, after = seen["mixing"]
    assert after.count() == sum(r["n"] for r in mixing.mix(before).selectExpr("mix.copies as n").collect())
    before, after = seen["packing"]
    assert after.agg({"length": "sum"}).first()[0] == sum(
        r["doc_tokens"] for r in after.where("start = 0").select("doc_tokens").collect()
    )
    assert after.where("start = 0").count() == before.count()
    assert corpus_pipeline.run(spark, SF).count() > 0

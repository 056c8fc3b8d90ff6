"""Clashing column names, repeated ids, stray vectors and the values that production runs with."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiforge.llm import common, line_dedup, mixing, neighbours, toxicity

SF = "/root/testdata/sf0.01"


def test_clashing_columns_pass_through(spark):
    rows = [(i, f"line {i}\nfooter", f"s{i % 2}", 7) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, x int")
    plain = docs.drop("x")
    odd = docs.select("doc_id", "text", "source", *[F.col("x").alias(c) for c in ("__host", "__of", "__source", "grade", "t", "__id", "of")])
    got = line_dedup.drop_boilerplate(odd)
    assert {r["__host"] for r in got.collect()} == {7}
    assert {r["text"] for r in got.collect()} == {f"line {i}" for i in range(12)}
    key = lambda r: r["doc_id"]
    mixed, want = (sorted(mixing.mix(d).collect(), key=key) for d in (odd, plain))
    assert [r["mix"] for r in mixed] == [r["mix"] for r in want] and {r["__of"] for r in mixed} == {7}
    assert sorted(mixing.emit(odd).columns) == sorted(odd.columns)
    grades = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, grade int")
    assert toxicity.train(odd, grades) == toxicity.train(plain, grades)


def test_hosts_of_two_pages_lose_their_footer(spark):
    rows = [(h * 10 + i, f"text {h} {i}\nfooter {h}", f"h{h}") for h in range(4) for i in range(2)]
    got = line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r["text"] for r in got.collect()} == {f"text {h} {i}" for h in range(4) for i in range(2)}
    one = line_dedup.drop_boilerplate(spark.createDataFrame(rows[::2], "doc_id long, text string, source string"))
    assert all("footer" in r["text"] for r in one.collect())


def test_heavy_rows_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 100)
    small = common.cut(spark.createDataFrame([(f"s{i}", "y" * 50) for i in range(4)], "k string, v string"))
    docs = spark.createDataFrame([(i, f"s{i % 5}") for i in range(20)], "i int, k string")
    joined = common.attach(docs, small, ["k"])
    assert sorted((r["i"], r["v"] is None) for r in joined.collect()) == [(i, i % 5 == 4) for i in range(20)]
    assert "__salt" in joined._jdf.queryExecution().optimizedPlan().toString()


def test_repeated_ids_train_once(spark):
    texts = [(i, "bad words here" if i % 2 else "calm words here") for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    grades = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, grade int")
    assert toxicity.train(docs.union(docs).union(docs), grades) == toxicity.train(docs, grades)


def test_vectors_of_every_length_are_searched(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(60)]
    stray = [(100, rng.standard_normal(9).tolist()), (140, rng.standard_normal(9).tolist()), (160, [1.0])]
    schema = "vec_id long, embedding array<double>"
    alone = set(map(tuple, neighbours.nearest(spark.createDataFrame(rows, schema)).collect()))
    both = set(map(tuple, neighbours.nearest(spark.createDataFrame(rows + stray, schema)).collect()))
    assert alone and alone < both
    assert {(r[0], r[2]) for r in both - alone} == {(100, 140), (140, 100)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")
def test_recall_on_the_embeddings(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = sorted((r["vec_id"], r["embedding"]) for r in table.select("vec_id", "embedding").collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    got = {}
    for r in neighbours.nearest(table, cell_rows=30, max_sample=200).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        near = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hit, total = hit + len(near & got[int(ids[i])]), total + len(near)
    assert hit / total >= 0.9


def test_toxicity_of_unseen_documents(spark):
    """Fitted on one half of sf0.1's labelled documents, judged on the other (measured: 0.63 of the toxic ones
    found, 0.003 of the others accused; with few labels, most of what a text could say has never been seen)."""
    large = "/root/testdata/sf0.1"
    if not os.path.isdir(large):
        pytest.skip("test tables are missing")
    docs = spark.read.parquet(f"{large}/documents.parquet").select("doc_id", "text")
    grades = toxicity.grades_of(spark.read.parquet(f"{large}/labels.parquet"))
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    model = toxicity.train(docs, grades.where(half == 0))
    unseen = toxicity.score(docs.join(grades.where(half == 1), "doc_id"), model).select("grade", "toxicity.toxic").collect()
    toxic, clean = ([r["toxic"] for r in unseen if (r["grade"] > 0) == bad] for bad in (True, False))
    assert sum(toxic) >= 0.55 * len(toxic) and sum(clean) <= 0.01 * len(clean)

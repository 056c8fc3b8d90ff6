"""Toxicity by cumulative-link ordinal regression.

Grades 0 < 1 < ... share one weight vector over sparse text features; ordered thresholds turn the
score into P(grade > j), and the sum of these is the expected severity. Features are the words of a
text and their first 4, 5 and 6 bytes, present or not.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import cut, fresh

#: The classifier is fitted on at most this many labelled rows (those whose hashed ids are smallest).
MAX_TRAIN = 20_000
#: Features kept: those that tell the grades apart best, in at least MIN_DOCS training texts.
MAX_FEATURES = 4096
MIN_DOCS = 3
BITS = 24
PREFIXES = (4, 5, 6)
EDGES = b".,;:!?()[]{}\"'<>|*#$%&"
#: A document is rejected if its probability of a grade above 0 reaches this.
REJECT = 0.5
MAX_MEMO = 1 << 17


def word_features(word: bytes) -> tuple[int, ...]:
    bare = word.strip(EDGES)
    keys = [bare] + [b"^" + bare[:n] for n in PREFIXES if len(bare) > n]
    return tuple(zlib.crc32(k) & ((1 << BITS) - 1) for k in keys) if bare else ()


def _features(text: bytes) -> list[int]:
    found: set[int] = set()
    for w in set(text.lower().split()):
        found.update(word_features(w))
    return sorted(found)


def fit(indptr: np.ndarray, index: np.ndarray, grade: np.ndarray, width: int, levels: int, l2=2e-4, steps=300):
    """(weights, thresholds) of the proportional-odds model over binary CSR rows, by Adam."""
    n = len(grade)
    row = np.repeat(np.arange(n), np.diff(indptr))
    above = np.array([(grade > j) for j in range(levels)], dtype=np.float64)
    share = np.clip(above.mean(axis=1), 1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    # thresholds are first[0] and then positive steps, exp(gap)
    p = np.concatenate([np.zeros(width), first[:1], np.log(np.maximum(np.diff(first), 0.1))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        w, cuts = p[:width], _cuts(p[width:])
        z = np.bincount(row, weights=w[index], minlength=n)
        q = 1 / (1 + np.exp(np.clip(cuts[:, None] - z[None, :], -30, 30)))  # P(grade > j)
        upper = np.vstack([np.ones(n), q])
        lower = np.vstack([q, np.zeros(n)])
        own = np.maximum((upper - lower)[grade, np.arange(n)], 1e-9)
        slope = lambda x: x * (1 - x)
        up, low = slope(upper)[grade, np.arange(n)], slope(lower)[grade, np.arange(n)]
        dz = -(up - low) / own / n
        gw = np.bincount(index, weights=dz[row], minlength=width) + l2 * w
        dcut = np.zeros(levels)
        for j in range(levels):
            dcut[j] = ((up * (grade == j + 1) - low * (grade == j)) / own).sum() / n
        gt = np.concatenate([[dcut.sum()], [dcut[j:].sum() * np.exp(p[width + j]) for j in range(1, levels)]])
        g = np.concatenate([gw, gt])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:width], _cuts(p[width:])


def _cuts(t: np.ndarray) -> np.ndarray:
    return t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))])


def train(docs: DataFrame, grades: DataFrame, id_col="doc_id", text_col="text", max_train=MAX_TRAIN, max_features=MAX_FEATURES):
    """Fits on the documents that ``grades`` (id, grade 0..K) covers; returns a dict that ``score`` takes.

    Rows with a null id or grade are left out, repeated ids count once, with their highest grade and
    smallest text, so at most ``max_train`` rows reach the driver. Ties between features go to the smaller hash. Columns of
    any other name play no part. Without two grades to learn from, all weights are 0.
    """
    known = grades.where(F.col(id_col).isNotNull() & F.col("grade").isNotNull()).groupBy(F.col(id_col).alias("of")).agg(F.max("grade").alias("grade"))
    chosen = known.orderBy(F.xxhash64("of", F.lit("train")), "of").limit(max_train)
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    texts = own.join(F.broadcast(chosen), F.col("id") == F.col("of")).groupBy("id").agg(F.max("grade").alias("grade"), F.min("t").alias("t")).drop("id")

    def run(batches):
        for b in batches:
            found = [_features(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), pa.array(found, pa.list_(pa.int32()))], names=["grade", "features"])

    rows = cut(texts.withColumn("grade", F.col("grade").cast("int")).mapInArrow(run, "grade int, features array<int>"))
    total = rows.groupBy((F.col("grade") > 0).alias("pos")).count().collect()
    n = {r["pos"]: r["count"] for r in total}
    levels = (rows.agg(F.max("grade")).first()[0] or 0)
    if len(n) < 2 or not levels:
        return {"index": {}, "weights": [], "cuts": [float("inf")] * max(levels, 1)}
    pos, neg = F.col("p") / n[True], (F.col("k") - F.col("p")) / n[False]
    gain = F.abs(pos - neg) / F.sqrt(F.col("k") / (n[True] + n[False]) * (1 - F.col("k") / (n[True] + n[False])) + 1e-9)
    best = rows.select("grade", F.explode("features").alias("f")).groupBy("f").agg(F.count("*").alias("k"), F.sum((F.col("grade") > 0).cast("int")).alias("p"))
    best = [r["f"] for r in best.where(F.col("k") >= MIN_DOCS).orderBy(gain.desc(), "f").limit(max_features).collect()]
    index = {f: i for i, f in enumerate(sorted(best))}

    def chosen_only(batches):
        for b in batches:
            kept = [[index[f] for f in fs if f in index] for fs in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.list_(pa.int32()))], names=["grade", "f"])

    part = rows.mapInArrow(chosen_only, "grade int, f array<int>").collect()
    part = sorted((r["grade"], sorted(r["f"])) for r in part)  # max_train rows of max_features ids at most
    indptr = np.concatenate([[0], np.cumsum([len(f) for _, f in part])])
    flat = np.array([f for _, fs in part for f in fs], dtype=np.int64)
    weights, cuts = fit(indptr, flat, np.array([g for g, _ in part]), len(index), levels)
    return {"index": index, "weights": weights.tolist(), "cuts": cuts.tolist()}


def score(docs: DataFrame, model: dict, text_col="text", reject=REJECT) -> DataFrame:
    """``docs`` and, as last column, a struct (``toxicity`` or a fresh name): severity, grade, toxic.

    ``severity`` is the expected grade, ``grade`` the number of thresholds passed with probability
    over 1/2, ``toxic`` whether P(grade > 0) reaches ``reject``. Null and empty texts have no features
    and get the intercepts' values; repeated rows score alike; an empty table gives no rows.
    """
    out = fresh(docs, "toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        m = shared.value
        weight, cuts, index, memo = m["weights"], np.array(m["cuts"]), m["index"], {}
        for batch in texts:
            z = []
            for t in batch:
                found = set()
                for w in set(t.lower().split()) if t else ():
                    f = memo.get(w)
                    if f is None:
                        if len(memo) >= MAX_MEMO:
                            memo.clear()
                        memo[w] = f = tuple(index[x] for x in word_features(w) if x in index)
                    if f:
                        found.update(f)
                z.append(sum(weight[i] for i in sorted(found)))
            q = 1 / (1 + np.exp(np.clip(cuts[None, :] - np.array(z)[:, None], -500, 500)))
            import pandas as pd

            yield pd.DataFrame({"severity": q.sum(axis=1), "grade": (q > 0.5).sum(axis=1).astype("int32"), "toxic": q[:, 0] >= reject})

    from collections.abc import Iterator

    import pandas as pd

    def typed(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return run(texts)

    typed.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    scored = F.pandas_udf(typed, "severity double, grade int, toxic boolean")
    return docs.withColumn(out, scored(F.col(text_col).cast("binary")))


def grades_of(labels: DataFrame, id_col="doc_id") -> DataFrame:
    """Severity grades from 0/1 labels: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    worst = F.when(F.coalesce("quality", F.lit(1)) == 0, 2).otherwise(1)
    return labels.select(id_col, F.when(F.col("toxic") == 1, worst).when(F.col("toxic") == 0, 0).alias("grade"))

"""Approximate nearest neighbours: stable projections, kd-trees and a chi-square stopping test.

Largest inner product becomes smallest distance by one more coordinate (sqrt(M - |x|^2), M the
largest squared length; 0 for queries). Gaussian projections to a few dimensions keep distances:
projected^2 / true^2 follows a chi-square distribution. The top of a kd-tree over the projections, fitted on
a bounded sample, deals all rows into cells; each cell's blocks have kd-trees of their own. A query
visits leaves by increasing projected distance and verifies their rows on the original vectors,
until a row as near as its k-th best would lie beyond the visited radius only with probability
``miss``. It starts in its own cell, whose result then tells which other blocks it must visit.
"""

from __future__ import annotations

from functools import reduce
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kpiforge.llm.common import cut

K = 20
EVERY = 20
DIMS = 12
MISS = 0.02
#: The top of the tree is fitted on at most this many rows (smallest hashed ids).
MAX_SAMPLE = 20_000
CELL_ROWS = 8192
LEAF = 64
SEED = 11


def chi_square(x: np.ndarray, dims: int) -> np.ndarray:
    """The chi-square distribution function for an even number of degrees of freedom."""
    half = np.minimum(x, 1e4) / 2
    return 1 - np.exp(-half) * sum(half**i / factorial(i) for i in range(dims // 2))


def split(points: np.ndarray, rows: int):
    """kd-tree by medians of the widest dimension: (node -> (dim, cut)), leaves as index arrays."""
    nodes, leaves, todo = {}, {}, [(1, np.arange(len(points)))]
    while todo:
        at, own = todo.pop()
        spread = np.ptp(points[own], axis=0) if len(own) else np.zeros(points.shape[1])
        if len(own) <= rows or not spread.max() > 0:
            leaves[at] = own
            continue
        d = int(spread.argmax())
        c = float(np.median(points[own, d]))
        right = points[own, d] > c
        if not right.any():
            c = float(np.nextafter(c, -np.inf))
            right = points[own, d] > c
        nodes[at] = (d, c)
        todo += [(2 * at, own[~right]), (2 * at + 1, own[right])]
    return nodes, leaves


def _descend(nodes: dict, points: np.ndarray) -> np.ndarray:
    at = np.ones(len(points), dtype=np.int64)
    while True:
        moved = False
        for node in np.unique(at):
            if int(node) in nodes:
                d, c = nodes[int(node)]
                here = at == node
                at[here] = 2 * node + (points[here, d] > c)
                moved = True
        if not moved:
            return at


class Projector:
    def __init__(self, dim: int, dims: int, most: float):
        self.matrix = np.random.default_rng(SEED).standard_normal((dim + 1, dims))
        self.most = most

    def rows(self, x: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))
        return x @ self.matrix[:-1] + extra[:, None] * self.matrix[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return q @ self.matrix[:-1]

    def squared(self, q: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Squared distance at which a row has the inner product ``best`` with a query."""
        return np.maximum((q * q).sum(axis=1) + self.most - 2 * best, 1e-12)


def search(ids, x, qids, q, bound, projector: Projector, k: int, miss: float, leaf: int = LEAF):
    """(query, id, score) of the candidates of one block: for each query the best 2k + 1 verified rows.

    ``bound`` is the k-th best inner product that the query has found elsewhere (-inf: none).
    """
    dims, keep = projector.matrix.shape[1], 2 * k + 1
    px, pq = projector.rows(x), projector.queries(q)
    leaves = list(split(px, leaf)[1].values())
    low = np.array([px[o].min(axis=0) for o in leaves])
    high = np.array([px[o].max(axis=0) for o in leaves])
    away = np.empty((len(q), len(leaves)))
    for i in range(0, len(q), 256):
        gap = np.maximum(np.maximum(low[None] - pq[i : i + 256, None], pq[i : i + 256, None] - high[None]), 0)
        away[i : i + 256] = (gap * gap).sum(axis=2)
    order = np.argsort(away, axis=1, kind="stable")
    best = np.full((len(q), keep), -np.inf)
    which = np.full((len(q), keep), -1, dtype=np.int64)
    active = np.arange(len(q))
    for r in range(len(leaves)):
        kth = np.maximum(best[active, k - 1], bound[active])
        radius = away[active, order[active, r]]
        ratio = radius / projector.squared(q[active], kth)
        done = (kth > -np.inf) & (chi_square(ratio, dims) >= 1 - miss)
        active = active[~done]
        if not len(active):
            break
        target = order[active, r]
        for at in np.unique(target):
            own, who = leaves[at], active[target == at]
            s = q[who] @ x[own].T
            s[ids[own][None, :] == qids[who][:, None]] = -np.inf
            joint = np.concatenate([best[who], s], axis=1)
            rows = np.concatenate([which[who], np.broadcast_to(own, s.shape)], axis=1)
            top = np.argsort(-joint, axis=1, kind="stable")[:, :keep]
            best[who], which[who] = np.take_along_axis(joint, top, 1), np.take_along_axis(rows, top, 1)
    at, col = np.nonzero((best > -np.inf) & (best >= bound[:, None] - 1e-6 * np.abs(bound[:, None])))
    found = which[at, col]
    exact = (x[found] * q[at]).sum(axis=1)
    return pd.DataFrame({"query_id": qids[at], "vec_id": ids[found], "score": exact})


def _valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def nearest(
    vectors: DataFrame, id_col="vec_id", vec_col="embedding", k=K, every=EVERY, dims=DIMS, miss=MISS,
    max_sample=MAX_SAMPLE, cell_rows=CELL_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows found with the largest inner products per query.

    Queries are the rows whose id is divisible by ``every``, candidates all rows of the same length but
    the query's own. Null ids, and vectors that are null, empty, zero or hold null or non-finite
    components, take no part. Each length is searched among its own kind, one search a length. Of rows with the same id one (the
    smallest vector) counts. Equal scores go to smaller ids; of equal vectors only the 2k + 1
    smallest ids are searched, as no other can be among the k best. Extra columns are left out; a table without
    vectors gives no rows.
    """
    rows = cut(_valid(vectors, id_col, vec_col))
    lengths = [r["dim"] for r in rows.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect()]
    found = [_nearest_of(rows.where(F.size("v") == d), d, k, every, dims, miss, max_sample, cell_rows) for d in lengths]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found)


def _nearest_of(rows: DataFrame, dim: int, k: int, every: int, dims: int, miss: float, max_sample: int, cell_rows: int) -> DataFrame:
    """``nearest`` among stored rows (id, v) of one length."""
    spark = rows.sparkSession
    facts = {"n": rows.count(), "dim": dim}
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    most = rows.agg(F.max(square)).first()[0]
    projector = Projector(facts["dim"], dims, most)

    sample = rows.orderBy(F.xxhash64("id", F.lit("tree")), "id").limit(max_sample).collect()
    points = projector.rows(np.array([r["v"] for r in sample]))
    cells = max(1, -(-facts["n"] // cell_rows))
    top = split(points, max(8, -(-len(points) // cells)))[0]

    @F.pandas_udf("long")
    def cell_of(v: pd.Series) -> pd.Series:
        return pd.Series(_descend(top, projector.rows(np.stack(v.to_numpy()))))

    @F.pandas_udf("long")
    def home_of(v: pd.Series) -> pd.Series:
        return pd.Series(_descend(top, projector.queries(np.stack(v.to_numpy()))))

    twins = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    indexed = cut(rows.withColumn("twin", twins).where(F.col("twin") <= 2 * k + 1).drop("twin").withColumn("cell", cell_of("v")))
    counts = indexed.groupBy("cell").count().collect()
    blocks = {r["cell"]: -(-r["count"] // cell_rows) for r in counts}
    block_rows = spark.createDataFrame(sorted(blocks.items()), "cell long, blocks int")
    indexed = cut(indexed.join(F.broadcast(block_rows), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).drop("blocks"))

    @F.pandas_udf("array<double>")
    def projected(v: pd.Series) -> pd.Series:
        return pd.Series(list(projector.rows(np.stack(v.to_numpy()))))

    corner = indexed.withColumn("p", projected("v")).groupBy("cell", "block").agg(
        *[f(F.get("p", F.lit(i))).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(dims)]
    )
    boxes = sorted(map(tuple, corner.collect()))  # one row per block
    keys = [b[:2] for b in boxes]
    low, high = np.array([b[2 : 2 + dims] for b in boxes]), np.array([b[2 + dims :] for b in boxes])

    def visit(probes: DataFrame) -> DataFrame:
        def run(key: tuple, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(asked):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            own = own.sort_values("x_id")
            return search(
                own["x_id"].to_numpy(), np.stack(own["x_v"].to_numpy()), asked["id"].to_numpy(),
                np.stack(asked["v"].to_numpy()), asked["bound"].to_numpy(), projector, k, miss,
            )

        # blocks of queries, so that no task holds all queries of a crowded cell
        groups = probes.groupBy("cell", "block").count().select(
            "cell", "block", F.ceil(F.col("count") / cell_rows).alias("groups")
        )
        groups = cut(groups)
        asked = probes.join(F.broadcast(groups), ["cell", "block"]).withColumn("group", F.pmod(F.xxhash64("id", F.lit(3)), "groups")).drop("groups")
        held = indexed.join(F.broadcast(groups), ["cell", "block"]).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).drop("groups")
        by = ["cell", "block", "group"]
        held = held.select(*[F.col(c).alias(f"x_{c}") for c in (*by, "id", "v")])
        return held.groupBy(*[f"x_{c}" for c in by]).cogroup(asked.groupBy(*by)).applyInPandas(run, "query_id long, vec_id long, score double")

    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    queries = rows.where(F.col("id") % every == 0)
    home = queries.withColumn("cell", home_of("v")).join(F.broadcast(block_rows), "cell", "left")
    nearest_cell = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)).cast("long") - 1))
    first = cut(visit(home.withColumn("block", nearest_cell).withColumn("bound", F.lit(float("-inf"))).drop("blocks")))
    kth = first.withColumn("rank", F.row_number().over(place)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    asked = home.select("id", "v", F.col("cell").alias("home")).join(kth, "id", "left")

    def others(batches):
        for b in batches:
            q = np.stack(b["v"].to_numpy())
            bound = b["bound"].fillna(float("-inf")).to_numpy()
            pq = projector.queries(q)
            out = []
            for i in range(len(b)):
                gap = np.maximum(np.maximum(low - pq[i], pq[i] - high), 0)
                ratio = (gap * gap).sum(axis=1) / projector.squared(q[i : i + 1], bound[i : i + 1])
                for j in np.flatnonzero((chi_square(ratio, dims) < 1 - miss) | (bound[i] == -np.inf)):
                    if keys[j][0] != b["home"].iat[i]:
                        out.append((b["id"].iat[i], b["v"].iat[i], bound[i], *keys[j]))
            yield pd.DataFrame(out, columns=["id", "v", "bound", "cell", "block"])

    probes = cut(asked.mapInPandas(others, "id long, v array<double>, bound double, cell long, block long"))
    found = first.union(visit(probes))
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

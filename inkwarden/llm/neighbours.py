"""Nearest neighbours by inner product with vantage-point trees per shard.

With one more component ``sqrt(M^2 - |x|^2)`` (0 for queries), where ``M`` is the largest norm, the largest inner
product is the smallest Euclidean distance, so the triangle inequality holds.  Rows fall into shards of bounded size
by a hash; a shard's tree splits its vectors at the median distance from a vantage point and keeps, for each leaf,
the range of distances from every vantage point above it.  A query meets all shards; in each it skips a leaf if the
leaf's lower bound times ``factor`` exceeds the distance of its k-th best so far.  Factor 1 is exact; a larger one
skips more.  Equal vectors of a shard are one point with several ids.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAF = 128
SLACK = 1e-9


def build(ids: np.ndarray, vectors: np.ndarray, limit: float, k: int, seed: int = 1) -> dict:
    """The tree of a shard: points leaf by leaf, vantage points, and each leaf's (vantage, low, high) path.

    Of each point only the ``k + 1`` smallest ids can be among k answers to a query that leaves out its own.
    """
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors = ids[order], vectors[order]
    new = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(axis=1)])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    points = vectors[first]
    kept = np.arange(len(ids)) - first[group] <= k
    extra = np.sqrt(np.maximum(0, limit * limit - np.einsum("ij,ij->i", points, points)))
    full = np.column_stack([points, extra])
    rng, vantages, leaves = np.random.default_rng(seed), [], []
    stack = [(np.arange(len(points)), [])]
    while stack:
        at, path = stack.pop()
        if len(at) <= LEAF:
            leaves.append((at, path))
            continue
        chosen = full[rng.choice(at)]
        away = np.sqrt(((full[at] - chosen) ** 2).sum(axis=1))
        near = np.argsort(away, kind="stable")
        vantages.append(chosen)
        for part in np.array_split(near, 2):
            stack.append((at[part], [*path, (len(vantages) - 1, away[part].min(), away[part].max())]))
    rank = np.empty(len(points), np.int64)
    rank[np.concatenate([at for at, _ in leaves])] = np.arange(len(points))
    by_point = np.argsort(rank[group[kept]], kind="stable")
    counts = np.bincount(rank[group[kept]], minlength=len(points))
    return {"points": points[np.argsort(rank)], "ids": ids[kept][by_point], "first": np.concatenate([[0], np.cumsum(counts)]),
            "leaves": np.concatenate([[0], np.cumsum([len(at) for at, _ in leaves])]), "paths": [p for _, p in leaves],
            "vantages": np.array(vantages).reshape(len(vantages), full.shape[1]), "limit": limit}


def bounds(tree: dict, queries: np.ndarray) -> np.ndarray:
    """Lower bounds (queries, leaves) of the distance to any point of a leaf."""
    vantages = tree["vantages"]
    out = np.zeros((len(queries), len(tree["paths"])))
    if len(vantages):
        square = (queries ** 2).sum(axis=1)[:, None] + (vantages ** 2).sum(axis=1) - 2 * queries @ vantages[:, :-1].T
        away = np.sqrt(np.maximum(0, square))
        for leaf, path in enumerate(tree["paths"]):
            for v, low, high in path:
                np.maximum(out[:, leaf], np.maximum(low - away[:, v], away[:, v] - high), out=out[:, leaf])
    return out


def search(tree: dict, own: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, ...]:
    """Positions of queries, ids and scores of each query's k best of a shard, best first; and the visited share.

    First the k-th best score of each query is found, leaves in the order of their mean bound; then all points
    that reach it are collected, scored once more one by one, and cut at k with ties to the smaller id.
    """
    leaves, points = tree["leaves"], tree["points"]
    square, low = (queries ** 2).sum(axis=1), bounds(tree, queries)
    scale = SLACK * (1 + tree["limit"] * np.sqrt(square))
    room = k + 1  # one may be the query itself
    best = np.full((len(queries), room), -np.inf)

    seen = np.zeros(low.shape, bool)

    def open_to(leaf: int, factor: float) -> np.ndarray:
        worst = best[:, 0]
        reach = np.sqrt(np.maximum(0, square + tree["limit"] ** 2 - 2 * np.maximum(worst, -1e300))) + 1e-7 * (1 + tree["limit"])
        return np.flatnonzero((low[:, leaf] * factor <= reach) | (worst == -np.inf))

    visited = 0
    for leaf in np.argsort(low.mean(axis=0), kind="stable"):
        at = open_to(leaf, factor)
        seen[at, leaf] = True
        if len(at):
            part = points[leaves[leaf]:leaves[leaf + 1]]
            visited += len(at) * len(part)
            times = np.minimum(room, np.diff(tree["first"][leaves[leaf]:leaves[leaf + 1] + 1]))
            scores = np.repeat(queries[at] @ part.T, times, axis=1)
            both = np.concatenate([best[at], scores], axis=1)
            best[at] = np.partition(both, both.shape[1] - room, axis=1)[:, both.shape[1] - room:]
            best[at, 0] = best[at].min(axis=1)
    whose, which = [], []
    floor = best.min(axis=1) - scale
    for leaf in range(len(tree["paths"])):
        at = open_to(leaf, 1.0)
        at = at[seen[at, leaf]]
        a, b = np.nonzero(queries[at] @ points[leaves[leaf]:leaves[leaf + 1]].T >= floor[at, None])
        whose.append(at[a])
        which.append(b + leaves[leaf])
    whose, which = np.concatenate(whose), np.concatenate(which)
    score = (queries[whose] * points[which]).sum(axis=1)
    many = np.diff(tree["first"])[which]
    spot = np.repeat(tree["first"][which], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    whose, score, found = np.repeat(whose, many), np.repeat(score, many), tree["ids"][spot]
    other = found != own[whose]
    whose, score, found = whose[other], score[other], found[other]
    order = np.lexsort((found, -score, whose))
    whose, score, found = whose[order], score[order], found[order]
    top = np.arange(len(whose)) - np.searchsorted(whose, whose) < k
    return whose[top], found[top], score[top], visited / max(1, len(queries) * len(points))


def usable(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, v, norm): vectors that take part, in double precision; null, zero or non-finite ones do not."""
    v = F.transform(vector, lambda x: x.cast("double"))
    kept = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return kept.where(finite).withColumn("norm", norm).where("norm > 0").withColumn("dim", F.size("v"))


def _tree(limit: float, k: int):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = build(pdf["vec_id"].to_numpy(np.int64), np.array(pdf["v"].tolist(), float), limit, k)
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "tree": [pickle.dumps(tree)]})

    return one


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "own": [pdf["vec_id"].to_numpy(np.int64).tobytes()],
                         "queries": [np.array(pdf["v"].tolist(), float).tobytes()]})


def _found(k: int, factor: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, raw, tree = (batch.column(c)[i].as_py() for c in range(3))
                own = np.frombuffer(own, np.int64)
                at, ids, scores, visited = search(pickle.loads(tree), own, np.frombuffer(raw).reshape(len(own), -1), k, factor)
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(ids), pa.array(scores),
                                                  pa.array(np.full(len(at), visited))],
                                                 ["query_id", "vec_id", "score", "visited"])

    return rows


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, *, factor: float = 1.0, shard_rows: int = 4096,
            block_rows: int = 512) -> DataFrame:
    """Each query's k nearest rows of the same dimension, its own vec_id left out: query_id, rank, vec_id, score, visited.

    ``shard_rows`` and ``block_rows`` are mean sizes, reached by hashing, so one tree or one block of queries fits a
    task whatever the table's size.  Every block meets every shard; what is joined are trees and blocks.  Repeated
    rows of one vec_id count once each as candidates; an empty table gives no rows.
    """
    data, asked = usable(rows), usable(queries)
    sizes = data.agg(F.count("*"), F.max("norm")).first()
    limit, shards = float(sizes[1] or 0.0), -(-sizes[0] // shard_rows) or 1
    blocks = -(-asked.count() // block_rows) or 1
    spread = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(n)).cast("int")
    trees = (data.select("dim", spread(shards, 1).alias("shard"), "vec_id", "v").groupBy("dim", "shard")
             .applyInPandas(_tree(limit, k), "dim int, shard int, tree binary"))
    posed = (asked.select("dim", spread(blocks, 2).alias("block"), "vec_id", "v").groupBy("dim", "block")
             .applyInPandas(_block, "dim int, own binary, queries binary")
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    met = posed.join(trees, ["dim", "shard"]).select("own", "queries", "tree")
    found = met.mapInArrow(_found(k, factor), "query_id bigint, vec_id bigint, score double, visited double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score", "visited"))


def op4_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20, exactly (factor 1)."""
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0)).select("query_id", "rank", "vec_id", "score")


OP4_SQL = """
WITH usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, list_inner_product(q.v, d.v) AS score
  FROM usable q JOIN usable d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v) WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20
"""

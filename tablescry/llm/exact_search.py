"""Exact top-k inner-product search with two cover trees at a time.

Vectors are grouped around pivots and split into chunks of bounded size; a task turns each
chunk of data, and each block of queries, into a cover tree: children are picked farthest
first, so each lies at least as far from the others as any point lies from its child, and
every node knows its covering radius. A block and a chunk are searched together: a pair of
nodes is dropped when even the best product its balls allow,

    <q, p> + |q| * radius(p) + |p| * radius(q) + radius(q) * radius(p),

is below the worst kth score of the queries under the query node. Blocks first meet a chunk
of their own pivot; the scores found there prune whole (block, chunk) pairs by their roots
before any vectors move, and the other pairs start from them.

Scores are exact whole numbers. Defined cases: rows without id, without vector, or with
null or non-finite components take no part; rows that repeat a vec_id count once, with the
smallest vector; shorter vectors count as filled up with zeros; equal vectors are separate
candidates; an empty table gives an empty result. Scores of 2**53 and more raise an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablescry.plans.derived import load
from tablescry.session import cut_lineage

SCALE = 256
K = 5
PIVOTS = 32
CHUNK_ROWS, BLOCK_ROWS = 4096, 1024
LEAF, CHILDREN = 48, 12
NODE_FIELDS = ("first", "end", "child", "children")
TREE_SCHEMA = "piece long, pivot int, n int, width int, ids binary, vectors binary, nodes binary, radii binary, norm double, radius double, center binary"


def build_tree(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and vectors in tree order, nodes (NODE_FIELDS) and radii. A node's center is its first vector."""
    order = np.arange(len(ids))
    nodes, radii = [[0, len(ids), -1, 0]], [0.0]
    at = 0
    while at < len(nodes):
        first, end = nodes[at][:2]
        own = order[first:end]
        near = np.linalg.norm(vectors[own] - vectors[own[0]], axis=1)
        radii[at] = float(near.max())
        if end - first > LEAF and radii[at] > 0:
            child, centers = np.zeros(len(own), int), [0]
            while len(centers) < CHILDREN and near.max() > radii[at] / 2:
                centers.append(int(near.argmax()))
                far = np.linalg.norm(vectors[own] - vectors[own[centers[-1]]], axis=1)
                child = np.where(far < near, len(centers) - 1, child)
                near = np.minimum(near, far)
            child[centers] = np.arange(len(centers))
            lead = np.ones(len(own), int)
            lead[centers] = 0
            sorting = np.lexsort((lead, child))
            order[first:end] = own[sorting]
            bounds = first + np.searchsorted(child[sorting], np.arange(len(centers) + 1))
            nodes[at][2:] = [len(nodes), len(centers)]
            nodes += [[int(s), int(e), -1, 0] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
            radii += [0.0] * len(centers)
        at += 1
    return ids[order], vectors[order], np.array(nodes), np.array(radii)


class Best:
    """The k best (score, id) of each query so far; better is a higher score, then a smaller id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries = queries
        self.scores = np.full((len(queries), k), -np.inf)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)

    def offer(self, first: int, end: int, scores: np.ndarray, ids: np.ndarray) -> None:
        own = self.queries[first:end, None] == ids[None, :]
        scores = np.where(own, -np.inf, scores)
        if not (scores >= self.scores[first:end, -1:]).any():
            return
        all_scores = np.concatenate([self.scores[first:end], scores], axis=1)
        all_ids = np.concatenate([self.ids[first:end], np.where(own, np.iinfo(np.int64).max, np.broadcast_to(ids, scores.shape))], axis=1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.scores.shape[1]]
        self.scores[first:end] = np.take_along_axis(all_scores, order, 1)
        self.ids[first:end] = np.take_along_axis(all_ids, order, 1)


def search(queries: tuple, data: tuple, best: Best, floor: np.ndarray) -> None:
    """Search two trees together, pairs of higher possible score first. floor: scores each query is known to reach k times."""
    _, q_vectors, q_nodes, q_radii = queries
    d_ids, d_vectors, d_nodes, d_radii = data
    q_norms, d_norms = (np.linalg.norm(v[n[:, 0]], axis=1) for v, n in ((q_vectors, q_nodes), (d_vectors, d_nodes)))

    def possible(q: int, some: np.ndarray) -> np.ndarray:
        product = d_vectors[d_nodes[some, 0]] @ q_vectors[q_nodes[q, 0]]
        bound = product + q_norms[q] * d_radii[some] + d_norms[some] * q_radii[q] + q_radii[q] * d_radii[some]
        return bound + 1e-6 * (1 + np.abs(bound))

    def worst(q: int) -> float:
        first, end = q_nodes[q, :2]
        return float(np.maximum(best.scores[first:end, -1], floor[first:end]).min())

    queue = [(-float(possible(0, np.array([0]))[0]), 0, 0)]
    while queue:
        bound, q, d = heapq.heappop(queue)
        if -bound < worst(q):
            continue
        (q_first, q_end, q_child, q_count), (d_first, d_end, d_child, d_count) = q_nodes[q].tolist(), d_nodes[d].tolist()
        if not q_count and not d_count:
            best.offer(q_first, q_end, q_vectors[q_first:q_end] @ d_vectors[d_first:d_end].T, d_ids[d_first:d_end])
            continue
        split_data = d_count and (not q_count or d_radii[d] >= q_radii[q])
        some = np.arange(d_child, d_child + d_count) if split_data else np.array([d])
        for one in (q,) if split_data else range(q_child, q_child + q_count):
            limit = worst(one)
            for b, node in zip(possible(one, some).tolist(), some.tolist(), strict=True):
                if b >= limit:
                    heapq.heappush(queue, (-b, one, node))


def _planted(table: pa.Table) -> pa.Table:
    """A chunk's rows (piece, pivot, id, v) as one row with its tree."""
    lists = table["v"].to_pylist()
    width = max(map(len, lists))
    vectors = np.zeros((len(lists), width))
    for i, v in enumerate(lists):
        vectors[i, : len(v)] = v
    ids, vectors, nodes, radii = build_tree(table["id"].to_numpy(), vectors)
    row = {
        "piece": table["piece"][0].as_py(), "pivot": table["pivot"][0].as_py(), "n": len(ids), "width": width, "ids": ids.astype("<i8").tobytes(),
        "vectors": vectors.tobytes(), "nodes": nodes.astype("<i8").tobytes(), "radii": radii.tobytes(),
        "norm": float(np.linalg.norm(vectors[0])), "radius": float(radii[0]), "center": vectors[0].tobytes(),
    }
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.float64(), pa.float64(), pa.binary()]
    return pa.table([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))


def _tree_of(row: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    vectors = np.frombuffer(row["vectors"]).reshape(row["n"], row["width"])
    return (
        np.frombuffer(row["ids"], "<i8"), np.pad(vectors, ((0, 0), (0, width - row["width"]))),
        np.frombuffer(row["nodes"], "<i8").reshape(-1, len(NODE_FIELDS)), np.frombuffer(row["radii"]),
    )


def _searcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                width = max(row["q"]["width"], row["d"]["width"])
                queries, data = _tree_of(row["q"], width), _tree_of(row["d"], width)
                if width and np.abs(queries[1]).max() * np.abs(data[1]).max() * width >= 2**53:
                    raise ValueError("scores of 2**53 and more are not exact")
                floor = np.full(len(queries[0]), -np.inf)
                if row["floors"]:
                    known = dict(row["floors"])
                    floor = np.array([known.get(i, -np.inf) for i in queries[0].tolist()])
                best = Best(queries[0], k)
                search(queries, data, best, floor)
                found = np.isfinite(best.scores)
                yield pa.record_batch({
                    "query_id": pa.array(np.repeat(queries[0], found.sum(axis=1)), pa.int64()),
                    "vec_id": pa.array(best.ids[found], pa.int64()), "score": pa.array(best.scores[found].astype(np.int64), pa.int64()),
                })

    return run


def _upper_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of roots that may hold a score worth finding: (block, chunk)."""
    for batch in batches:
        keep = []
        for r in batch.to_pylist():
            q, d = np.frombuffer(r["q_center"]), np.frombuffer(r["d_center"])
            n = min(len(q), len(d))
            bound = float(q[:n] @ d[:n]) + r["q_norm"] * r["d_radius"] + r["d_norm"] * r["q_radius"] + r["q_radius"] * r["d_radius"]
            keep.append(r["worst"] is None or bound + 1e-6 * (1 + abs(bound)) >= r["worst"])
        yield pa.record_batch([batch["block"], batch["chunk"]], names=["block", "chunk"]).filter(pa.array(keep, pa.bool_()))


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def quantised(table: DataFrame, vec_id: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, v) of the rows that take part, one for each id."""
    value = F.col(vector).cast("array<double>")
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col(vec_id).cast("long").alias("id"), value.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & sound)
    return rows.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def top_k(table: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each row of ``table`` whose id meets ``queries`` (a condition on ``id``)."""
    spark = table.sparkSession
    rows = cut_lineage(quantised(table, vec_id, vector))
    pivots = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            closest = []
            for v in batch["v"].to_pylist():
                gaps = [np.linalg.norm(np.pad(p, (0, max(0, len(v) - len(p)))) - np.pad(v, (0, max(0, len(p) - len(v))))) for p in map(np.asarray, pivots)]
                closest.append(int(np.argmin(gaps)))
            yield pa.record_batch([batch["id"], batch["v"], pa.array(closest, pa.int32())], names=["id", "v", "pivot"])

    placed = cut_lineage(rows.mapInArrow(nearest, "id long, v array<double>, pivot int"))

    def trees(some: DataFrame, most: int) -> DataFrame:
        sizes = some.groupBy("pivot").agg(F.ceil(F.count("*") / most).alias("pieces"))  # a row for each pivot
        salted = some.join(sizes, "pivot").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")) * PIVOTS + F.col("pivot"))
        return cut_lineage(salted.select("piece", "pivot", "id", "v").groupBy("piece").applyInArrow(_planted, TREE_SCHEMA))

    chunks, blocks = trees(placed, CHUNK_ROWS), trees(placed.where(queries), BLOCK_ROWS)
    d = chunks.select(F.col("piece").alias("chunk"), F.struct("n", "width", "ids", "vectors", "nodes", "radii").alias("d"))
    q = blocks.select(F.col("piece").alias("block"), F.struct("n", "width", "ids", "vectors", "nodes", "radii").alias("q"))

    def searched(pairs: DataFrame) -> DataFrame:
        return cut_lineage(pairs.join(q, "block").join(d, "chunk").select("q", "d", "floors").mapInArrow(_searcher(k), "query_id long, vec_id long, score long"))

    own = blocks.select(F.col("piece").alias("block"), "pivot").join(chunks.groupBy("pivot").agg(F.min("piece").alias("chunk")), "pivot")
    seeds = searched(own.select("block", "chunk", F.lit(None).cast("array<struct<_1:bigint,_2:double>>").alias("floors")))
    reached = seeds.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    ids = placed.where(queries).select("id", "pivot")
    sizes = ids.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("pieces"))
    in_block = ids.join(sizes, "pivot").select(F.col("id").alias("query_id"), (F.pmod(F.xxhash64("id"), F.col("pieces")) * PIVOTS + F.col("pivot")).alias("block"))
    floors = in_block.join(reached, "query_id", "left").groupBy("block").agg(  # BLOCK_ROWS at most
        F.when(F.count("least") == F.count("*"), F.min("least")).cast("double").alias("worst"),
        F.collect_list(F.when(F.col("least").isNotNull(), F.struct(F.col("query_id").alias("_1"), F.col("least").cast("double").alias("_2")))).alias("floors"),
    )
    q_roots = blocks.select(F.col("piece").alias("block"), F.col("norm").alias("q_norm"), F.col("radius").alias("q_radius"), F.col("center").alias("q_center"))
    d_roots = chunks.select(F.col("piece").alias("chunk"), F.col("norm").alias("d_norm"), F.col("radius").alias("d_radius"), F.col("center").alias("d_center"))
    roots = q_roots.join(floors.select("block", "worst"), "block").crossJoin(d_roots)  # blocks of the query set against chunks: roots only
    left = roots.mapInArrow(_upper_bounds, "block long, chunk long").join(own.select("block", "chunk"), ["block", "chunk"], "left_anti")
    rest = searched(left.join(floors.select("block", "floors"), "block"))
    return _top(seeds.union(rest), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(load(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

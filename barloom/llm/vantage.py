"""Approximate nearest neighbours by vantage-point trees, one a shard, with relaxed triangle-inequality pruning.

Index: rows are dealt to shards of about ``SHARD_BYTES`` by a hash of their id. In a shard every node has a vantage point (of
``TRIED`` drawn ones that with the widest spread of distances); the rest is halved at the median distance to it, and each half
keeps its least and largest distance. Every row is indexed; the index is a written table of one row a shard.

Search: queries come in blocks of ``BLOCK_BYTES``, read one after the other from a written table and broadcast. A task takes its shards in
turn and keeps, for each query of the block, the k nearest so far. In a tree every query goes to its nearest leaf first; then from the root, and a half is
skipped if ``factor`` times its lower bound (by the triangle inequality) exceeds the distance of the k-th nearest so far. With factor
one the result is exact; larger factors skip more. Then the k nearest of all tasks are taken, at most k rows a query and task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import cut_lineage, shared_folder

from .common import matrix, vectors

K = 10
FACTOR = 4.0
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
LEAF, TRIED = 64, 8
#: Elements of one difference array.
CHUNK = 1 << 21

FOUND = "query_id bigint, vec_id bigint, score double"


def _plain(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows in double precision."""
    d = v.astype(float) - q
    return np.sqrt((d * d).sum(-1))


def _grow(v: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows, nodes (start, stop, left, right; left -1: leaf) and bounds (least and largest, left and right)."""
    order, nodes, bounds = np.arange(len(v)), [], []
    stack = [(0, len(v), -1, 0)]
    while stack:
        start, stop, parent, side = stack.pop()
        here = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = here
        nodes.append([start, stop, -1, -1])
        bounds.append([0.0] * 4)
        if stop - start <= LEAF:
            continue
        mine = order[start:stop]
        tried = rng.choice(len(mine), TRIED, replace=False)
        sample = v[mine[rng.choice(len(mine), min(len(mine), 8 * TRIED), replace=False)]]
        best = tried[int(np.argmax([_plain(sample, v[mine[t]]).std() for t in tried]))]
        mine[[0, best]] = mine[[best, 0]]
        d = _plain(v[mine[1:]], v[mine[0]])
        by = np.lexsort((mine[1:], d))
        mine[1:], d = mine[1:][by], d[by]
        half = len(d) // 2
        bounds[here] = [d[0], d[half - 1], d[half], d[-1]]
        stack += [(start + 1 + half, stop, here, 1), (start + 1, start + 1 + half, here, 0)]
    return order, np.array(nodes, np.int64), np.array(bounds, float)


class Nearest:
    """The k nearest so far of a block of queries."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, factor: float):
        self.ids, self.q, self.k, self.factor = ids, q, k, factor
        self.norm = (q * q).sum(1)
        self.score, self.found = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        self.compared = 0

    def offer(self, who: np.ndarray, v: np.ndarray, ids: np.ndarray) -> None:
        """Rows v for the queries ``who``. A product tells which can be near enough; their distances are then taken plainly."""
        self.compared += len(who) * len(v)
        step = max(1, CHUNK // max(v.size, 1))
        norm = (v * v).sum(1)
        for a in range(0, len(who), step):
            w = who[a:a + step]
            last = self.score[w, -1]
            scale = self.norm[w][:, None] + norm
            rough = scale - 2 * (self.q[w] @ v.T)
            near = rough <= (last * last)[:, None] + 1e-9 * scale
            near &= ids != self.ids[w][:, None]
            row = np.flatnonzero(near.any(1))
            if not len(row):
                continue
            near, w = near[row], w[row]
            r, c = np.nonzero(near)
            d = np.full(near.shape, np.inf)
            d[r, c] = _plain(v[c], self.q[w[r]])
            score = np.concatenate((self.score[w], d), 1)
            found = np.concatenate((self.found[w], np.where(near, ids, np.iinfo(np.int64).max)), 1)
            best = np.lexsort((found, score), axis=1)[:, :self.k]
            self.score[w], self.found[w] = np.take_along_axis(score, best, 1), np.take_along_axis(found, best, 1)

    def _bounds(self, node: int, who: np.ndarray, v: np.ndarray, nodes: np.ndarray, bounds: np.ndarray):
        """Lower bounds of the distances to the two halves of a node."""
        d, b = _plain(self.q[who], v[nodes[node, 0]]), bounds[node]
        return np.maximum(np.maximum(d - b[1], b[0] - d), 0), np.maximum(np.maximum(d - b[3], b[2] - d), 0)

    def search(self, v: np.ndarray, ids: np.ndarray, nodes: np.ndarray, bounds: np.ndarray) -> None:
        """All queries down one tree: first each to its nearest leaf, then to every other place that is not skipped."""
        home, stack = np.zeros(len(self.q), np.int64), [(0, np.arange(len(self.q)))]
        while stack:
            node, who = stack.pop()
            start, stop, left, right = nodes[node].tolist()
            if left < 0:
                home[who] = node
                self.offer(who, v[start:stop], ids[start:stop])
                continue
            at_left, at_right = self._bounds(node, who, v, nodes, bounds)
            first = at_left <= at_right
            stack += [(child, w) for child, w in ((right, who[~first]), (left, who[first])) if len(w)]
        stack = [(0, np.arange(len(self.q)), np.zeros(len(self.q)))]
        while stack:
            node, who, least = stack.pop()
            near = least * self.factor <= self.score[who, -1] * (1 + 1e-12)
            who, least = who[near], least[near]
            if not len(who):
                continue
            start, stop, left, right = nodes[node].tolist()
            if left < 0:
                self.offer(who[home[who] != node], v[start:stop], ids[start:stop])
                continue
            at_left, at_right = self._bounds(node, who, v, nodes, bounds)
            self.offer(who, v[start:start + 1], ids[start:start + 1])
            stack += [(right, who, np.maximum(least, at_right)), (left, who, np.maximum(least, at_left))]


def index(rows: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row a shard: its tree, ids and vectors, written to the shared folder.

    Takes no part: a null vec_id, a vector that is null, empty, all zero or holds null or non-finite entries, or that has another
    length than most. Of rows with one vec_id the least vector counts.
    """
    found = vectors(rows).where("vec_id IS NOT NULL AND exists(v, c -> c <> 0)").groupBy("vec_id").agg(F.min("v").alias("v"))
    kind = np.float32 if "float" in dict(found.dtypes)["v"] else np.float64
    found = cut_lineage(found)
    n, dim = found.agg(F.count("*"), F.max(F.size("v"))).first()
    shards = max(1, -(-n * (dim or 1) * 8 // shard_bytes))

    def build(keys: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids = group.column("vec_id").to_numpy()
        by = np.argsort(ids)
        v = matrix(group.column("v").chunk(0), dim)[by]
        order, nodes, bounds = _grow(v.astype(float), np.random.default_rng(0))
        return pa.table({"shard": [keys[0].as_py()], "ids": [ids[by][order].tobytes()], "vectors": [v[order].astype(kind).tobytes()],
                         "nodes": [nodes.tobytes()], "bounds": [bounds.tobytes()], "dim": pa.array([dim], pa.int32())})

    return cut_lineage(found.groupBy(F.expr(f"pmod(xxhash64(vec_id), {shards})").alias("shard")).applyInArrow(
        build, "shard bigint, ids binary, vectors binary, nodes binary, bounds binary, dim int"))


def _blocks(queries: DataFrame, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of at most ``rows`` queries at a time."""
    ids, vecs = [], []
    for q in queries.toLocalIterator():
        ids.append(q.vec_id)
        vecs.append(q.v)
        if len(ids) == rows:
            yield np.array(ids, np.int64), np.array(vecs, float)
            ids, vecs = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(vecs, float)


def search(trees: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every query (vec_id, embedding), ties to the smaller vec_id.

    The rows of a query's own vec_id are no candidates. Queries take part by the rules of ``index``; if fewer than k candidates
    are found, all are returned. A distance whose square overflows a double is not found. Columns besides vec_id and embedding are left out. An empty table gives an empty result.
    """
    spark = trees.sparkSession
    single = "float" in dict(queries.dtypes).get("embedding", "")
    kind = np.float32 if single else np.float64
    asked = vectors(queries).where("vec_id IS NOT NULL AND exists(v, c -> c <> 0)").groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = cut_lineage(asked)
    dim = trees.agg(F.max("dim")).first()[0] or 1
    asked = asked.where(F.size("v") == dim)
    path = f"{shared_folder(spark)}/nearest-{uuid.uuid4().hex}"
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    spark.createDataFrame([], schema).write.parquet(path)
    for ids, q in _blocks(asked, max(1, block_bytes // (8 * dim))):
        sent = spark.sparkContext.broadcast((ids, q))

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, state = sent.value[0], None
            for batch in batches:
                for t in batch.to_pylist():
                    state = state or Nearest(*sent.value, k, factor)
                    v = np.frombuffer(t["vectors"], kind).reshape(-1, t["dim"]).astype(float)
                    state.search(v, np.frombuffer(t["ids"], np.int64), np.frombuffer(t["nodes"], np.int64).reshape(-1, 4),
                                 np.frombuffer(t["bounds"], float).reshape(-1, 4))
            if state is not None:
                row, place = np.nonzero(np.isfinite(state.score))
                yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(state.found[row, place]), pa.array(state.score[row, place])],
                                                 ["query_id", "vec_id", "score"])

        best = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        trees.select("ids", "vectors", "nodes", "bounds", "dim").mapInArrow(work, FOUND).withColumn("rank", best).where(
            F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        sent.unpersist()
    return spark.read.schema(schema).parquet(path)

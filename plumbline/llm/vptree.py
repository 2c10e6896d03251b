"""Nearest neighbours by vantage-point trees.

Vectors are scaled to length one, so the order by cosine is the order by Euclidean distance, a metric. Rows are dealt by hash to shards
of about ``SHARD_ROWS``; each shard gets a vantage-point tree, made once and kept as a binary row. A block of at most ``QUERY_BLOCK`` queries
meets every tree: all queries of the block walk it together, each into its nearer half first, and leave a half out when
``factor * gap > reach``, gap being the triangle-inequality bound of the half and reach the distance of the k-th vector
found so far. Factor 1 is exact search; larger factors leave out more. Found pairs are scored again on the original vectors.

Equal vectors of a shard are one tree entry with their k + 1 smallest ids, which is all that k nearest with ties to the smaller id (and
without the query itself) can need. Vectors of different lengths do not meet.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, neither as query nor as
candidate; rows with a null id likewise; repeated rows (same id, same vector) are one; different vectors of one id are separate candidates, and separate
queries with k neighbours each; a query leaves out all rows with its id; an empty table has no rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_batches, durable

K = 5
FACTOR = 1.3
SHARD_ROWS = 8192
QUERY_BLOCK = 1024
LEAF = 64
EPS = 1e-6  # room for rounding in distances of unit vectors (float64): sqrt turns 1e-13 into 3e-7


def usable(vector: Column) -> Column:
    x = F.transform(vector, lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(x, lambda c: c != 0), F.lit(False))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows of ``a`` and rows of ``b``; the same number for the same two vectors wherever they stand."""
    dot = (a * b).sum(axis=1)
    return dot / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


class Tree:
    """Arrays in tree order; a node is (first, last, vantage, inner node, outer node, bounds of both halves)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, seed: int = 1):
        order = np.lexsort((ids,))
        ids, x = ids[order], np.ascontiguousarray(x[order])
        seen, group = np.unique(x.view([("", x.dtype)] * x.shape[1]).ravel(), return_inverse=True)
        by = np.argsort(group, kind="stable")
        start = np.searchsorted(group[by], np.arange(len(seen) + 1))
        self.x = x[by[start[:-1]]].astype(np.float64)
        self.ids = [np.unique(ids[by[a: b]])[: k + 1] for a, b in zip(start[:-1], start[1:])]
        # The id of an entry that has no other: such an entry is nothing to a query of that id.
        self.one = np.array([len(i) == 1 for i in self.ids], bool)
        self.first = np.array([i[0] for i in self.ids], np.int64)
        self.unit = self.x / np.sqrt((self.x * self.x).sum(axis=1))[:, None]
        self.perm = np.arange(len(self.x))
        self.nodes: list[tuple] = []
        self.random = np.random.default_rng(seed)
        self.grow(0, len(self.x))
        del self.random

    def grow(self, first: int, last: int) -> int:
        me = len(self.nodes)
        self.nodes.append(None)
        if last - first <= LEAF:
            self.nodes[me] = (first, last, -1, -1, -1, None)
            return me
        rows = self.perm[first:last]
        vantage = int(self.random.choice(rows))
        d = np.sqrt(np.maximum(0, 2 - 2 * self.unit[rows] @ self.unit[vantage]))
        half = len(rows) // 2
        part = np.argpartition(d, half)
        self.perm[first:last], d = rows[part], d[part]
        bounds = (d[:half].min(), d[:half].max(), d[half:].min(), d[half:].max())
        inner = self.grow(first, first + half)
        outer = self.grow(first + half, last)
        self.nodes[me] = (first, last, vantage, inner, outer, bounds)
        return me

    def search(self, q: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Entries within reach of each unit vector of ``q``, with at least k + 1 different vectors of other ids than ``own``, or all of them."""
        n = len(q)
        best = np.full((n, k + 1), np.inf)  # distances of the nearest k + 1 entries of other ids so far
        found: list[list[np.ndarray]] = [[] for _ in range(n)]

        def leaf(first: int, last: int, who: np.ndarray) -> None:
            rows = self.perm[first:last]
            d = np.sqrt(np.maximum(0, 2 - 2 * q[who] @ self.unit[rows].T))
            d[self.one[rows][None, :] & (self.first[rows][None, :] == own[who][:, None])] = np.inf
            both = np.sort(np.concatenate([best[who], d], axis=1), axis=1)
            best[who] = both[:, : k + 1]
            near = d <= best[who][:, -1:] + EPS
            for r, w in enumerate(who.tolist()):
                hit = rows[near[r]]
                if len(hit):
                    found[w].append(hit)

        def visit(node: int, who: np.ndarray) -> None:
            first, last, vantage, inner, outer, bounds = self.nodes[node]
            if vantage < 0:
                leaf(first, last, who)
                return
            d = np.sqrt(np.maximum(0, 2 - 2 * q[who] @ self.unit[vantage]))
            low_in, high_in, low_out, high_out = bounds
            gap_in, gap_out = np.maximum(np.maximum(low_in - d, d - high_in), 0), np.maximum(np.maximum(low_out - d, d - high_out), 0)
            inside = d <= (high_in + low_out) / 2
            for side, near_node, far_node, gap in ((inside, inner, outer, gap_out), (~inside, outer, inner, gap_in)):
                if side.any():
                    visit(near_node, who[side])
                    far = factor * (gap[side] - EPS) <= best[who[side], -1] + EPS
                    if far.any():
                        visit(far_node, who[side][far])

        if len(self.x):
            visit(0, np.arange(n))
        return [np.concatenate(f) if f else np.zeros(0, np.int64) for f in found], best


def _build(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(v, np.float64) for v in pdf.vector])
        return pd.DataFrame({"shard": pdf.shard[:1], "dims": pdf.dims[:1], "tree": [pickle.dumps(Tree(pdf.id.to_numpy(), x, k), protocol=5)]})

    return run


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"block": pdf.block[:1], "dims": pdf.dims[:1], "ids": [pdf.id.to_numpy().tobytes()], "turns": [pdf.turn.to_numpy().tobytes()], "vectors": [b"".join(pdf.vector)]})


def _search(k: int, factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree: Tree = pickle.loads(row["tree"])
                ids, turns = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["turns"], np.int64)
                x = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
                unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
                found, best = tree.search(unit, ids, k, factor)
                out: dict[str, list] = {"query_id": [], "vec_id": [], "score": [], "turn": []}
                for i, entries in enumerate(found):
                    entries = np.unique(entries)
                    entries = entries[np.sqrt(np.maximum(0, 2 - 2 * tree.unit[entries] @ unit[i])) <= best[i, -1] + 2 * EPS]
                    score = cosines(tree.x[entries], np.broadcast_to(x[i], (len(entries), x.shape[1])))
                    pairs = [(-s, v) for e, s in zip(entries.tolist(), score.tolist()) for v in tree.ids[e].tolist() if v != ids[i]]
                    for s, v in sorted(pairs)[:k]:
                        for c, value in zip(out, (int(ids[i]), v, -s, int(turns[i]))):
                            out[c].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out["query_id"], pa.int64()), pa.array(out["vec_id"], pa.int64()), pa.array(out["score"], pa.float64()),
                                                  pa.array(out["turn"], pa.int64())], names=["query_id", "vec_id", "score", "turn"])

    return run


def vectors_of(table: DataFrame, key: str, vector: str) -> DataFrame:
    """id, dims and the vector as bytes of doubles, of the rows that take part; repeated rows once."""
    rows = table.filter(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda c: c.cast("double")).alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            n = v.value_lengths().to_numpy()
            flat, end = np.ascontiguousarray(v.flatten().to_numpy(zero_copy_only=False)) + 0.0, np.cumsum(n)  # no negative zeros
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "dims": pa.array(n.astype(np.int32)), "vector": pa.array([flat[e - c: e].tobytes() for e, c in zip(end, n)], pa.binary())})

    return rows.mapInArrow(pack, "id long, dims int, vector binary").dropDuplicates(["id", "vector"])


def build_index(table: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard with its tree: shard, dims, tree. Keep it as a table and search it any number of times, for up to ``k`` neighbours."""
    packed = durable(vectors_of(table, key, vector))
    shards = max(1, math.ceil(packed.count() / shard_rows))
    dealt = packed.withColumn("shard", F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).cast("int"))
    return durable(dealt.groupBy("dims", "shard").applyInPandas(_build(k), "shard int, dims int, tree binary"))


def nearest(index: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, factor: float = FACTOR,
            block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found for each query; the row of a query's own id is left out."""
    arrow_batches(queries.sparkSession, 4)  # rows are whole trees with query blocks
    packed = durable(vectors_of(queries, key, vector))
    blocks = max(1, math.ceil(packed.count() / block))
    asked = (packed.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int")).withColumn("turn", F.xxhash64("vector"))
             .groupBy("dims", "block").applyInPandas(_block, "block int, dims int, ids binary, turns binary, vectors binary"))
    # Every block meets the trees of its dims: shards x blocks rows, which is the work of a search of all shards.
    shards = index.select("dims", "shard")
    tasks = asked.join(shards, "dims").repartition(*["dims", "shard", "block"]).join(index, ["dims", "shard"])
    found = tasks.select("tree", "ids", "turns", "vectors").mapInArrow(_search(k, factor), "query_id long, vec_id long, score double, turn long")
    order = Window.partitionBy("query_id", "turn").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

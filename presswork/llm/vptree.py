"""Nearest neighbours by inner product with vantage-point trees, one for each shard.

A coordinate added to every stored vector brings all of a shard to one length, and queries get zero there, so that the
order of inner products is the order of Euclidean distances and the triangle inequality may prune. A node is pruned
for a query where ``factor`` times its least possible distance exceeds the distance of the query's k-th best;
factor one gives exact search, larger ones prune more. Searches run for many queries at once, node by node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAF = 64
#: Bytes of a shard's vectors as doubles, about (its tree takes three times as much), and vectors that are worth a shard.
SHARD_BYTES, SHARD_ROWS = 128 << 20, 4096
#: Rounding that a bound may have.
SLACK = 1e-9


class VpTree:
    """A tree over vectors. ``nodes``: vantage, bounds of the distances on both sides, and the two children; a child
    is a node, or a leaf as -1 - its place in ``leaves`` (slices of ``order``)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        squares = (vectors * vectors).sum(axis=1)
        self.square = float(squares.max()) if len(ids) else 0.0
        self.full = np.hstack([vectors, np.sqrt(np.maximum(self.square - squares, 0))[:, None]])
        self.order = np.arange(len(ids))
        self.nodes: list[tuple] = []
        self.leaves: list[tuple[int, int]] = []
        self.root = self._build()

    def _build(self) -> int:
        """Splits by rank at the median, so equal vectors split too."""
        root, todo = -1, [(0, len(self.ids), -1, 0)]
        while todo:
            low, high, parent, side = todo.pop()
            if high - low <= LEAF:
                self.leaves.append((low, high))
                place = -len(self.leaves)
            else:
                part = self.order[low:high]
                pick = self.full[part]
                centre = int(part[np.argmax(((pick - pick.mean(axis=0)) ** 2).sum(axis=1))])
                distance = np.sqrt(((pick - self.full[centre]) ** 2).sum(axis=1))
                rank = np.argsort(distance, kind="stable")
                self.order[low:high], distance = part[rank], distance[rank]
                half = (high - low) // 2
                place = len(self.nodes)
                self.nodes.append([centre, distance[0], distance[half - 1], distance[half], distance[-1], 0, 0])
                todo += [(low, low + half, place, 5), (low + half, high, place, 6)]
            if parent < 0:
                root = place
            else:
                self.nodes[parent][side] = place
        return root

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of each query's k best, best first; -inf where there are fewer."""
        n = len(queries)
        self.best, self.found = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        squares = (queries * queries).sum(axis=1)
        seen = np.full(n, -1)

        def distance(score: np.ndarray, rows: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(squares[rows] + self.square - 2 * score, 0))

        def visit(leaf: int, rows: np.ndarray) -> None:
            low, high = self.leaves[leaf]
            members = self.order[low:high]
            score = queries[rows] @ self.vectors[members].T
            margin = SLACK * (1 + np.abs(score))
            better = ((score + margin >= self.best[rows, -1:]).any(axis=1)).nonzero()[0]
            for start in range(0, len(better), 256):
                some = rows[better[start : start + 256]]
                # Sums of products in one order give equal vectors equal scores.
                exact = (queries[some][:, None, :] * self.vectors[members][None, :, :]).sum(axis=2)
                exact[query_ids[some][:, None] == self.ids[members][None, :]] = -np.inf
                scores = np.hstack([self.best[some], exact])
                names = np.hstack([self.found[some], np.broadcast_to(self.ids[members], exact.shape)])
                names[np.isneginf(scores)] = np.iinfo(np.int64).max
                top = np.lexsort((names, -scores), axis=1)[:, :k]
                self.best[some], self.found[some] = np.take_along_axis(scores, top, 1), np.take_along_axis(names, top, 1)

        # First the leaf where each query would stand, for a good bound; then all others that may hold better ones.
        todo = [(self.root, np.arange(n))]
        while todo:
            place, rows = todo.pop()
            if not len(rows):
                continue
            if place < 0:
                seen[rows] = -1 - place
                visit(-1 - place, rows)
                continue
            centre, _, inner, outer, _, near, far = self.nodes[place]
            left = distance(queries[rows] @ self.vectors[centre], rows) <= (inner + outer) / 2
            todo += [(near, rows[left]), (far, rows[~left])]
        todo = [(self.root, np.arange(n))]
        while todo:
            place, rows = todo.pop()
            if place < 0:
                rows = rows[seen[rows] != -1 - place]
                if len(rows):
                    visit(-1 - place, rows)
                continue
            centre, low, inner, outer, high, near, far = self.nodes[place]
            at = distance(queries[rows] @ self.vectors[centre], rows)
            worst = self.best[rows, -1]
            reach = np.where(np.isneginf(worst), np.inf, distance(worst, rows)) * (1 + SLACK) + SLACK
            for child, least, most in ((far, outer, high), (near, low, inner)):
                bound = factor * np.maximum(least - at, at - most)
                if len(left := rows[bound <= reach]):
                    todo.append((child, left))
        return self.best, self.found


def usable(vector: str) -> str:
    """SQL: a vector with a finite, non-null component each and not all zero."""
    return f"size({vector}) > 0 and not exists({vector}, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists({vector}, x -> x <> 0)"


def nearest(index: DataFrame, queries: DataFrame, k: int, factor: float, shards: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: of each query the k largest inner products with vectors of its length.

    Vectors that are null, empty or zero, or hold null or non-finite components, and those without an id take no part. A
    row with the query's id is no candidate. Of queries with one id, the least vector is answered; a repeated candidate counts each time
    it is stored. Ties go to the smaller id; a query without candidates gets no rows; no rows give no rows. The
    queries are dealt to every shard and stream past its tree, so a task holds one shard.
    """

    def valid(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
        return rows.where(f"id is not null and {usable('vector')}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tree = None, [], None
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            shard, dim, query, ids = (columns[n].to_numpy(zero_copy_only=False) for n in ("shard", "dim", "query", "id"))
            values, offsets = columns["vector"].flatten().to_numpy(), columns["vector"].offsets.to_numpy()
            offsets = offsets - offsets[0]
            edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(dim) != 0) | (np.diff(query) != 0)) + 1
            for low, high in zip([0, *edges], [*edges, len(ids)]):
                if (here := (dim[low], shard[low])) != key:
                    key, held, tree = here, [], None
                rows = values[offsets[low] : offsets[high]].reshape(high - low, -1)
                if not query[low]:
                    held.append((ids[low:high], rows))
                    continue
                if not held:
                    continue
                tree = tree or VpTree(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]))
                for start in range(low, high, 1024):
                    stop = min(high, start + 1024)
                    best, found = tree.search(ids[start:stop], rows[start - low : stop - low], k, factor)
                    some = ~np.isneginf(best)
                    names = np.broadcast_to(ids[start:stop, None], best.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(found[some]), pa.array(best[some])], ["query_id", "vec_id", "score"])

    stored = valid(index).select("*", F.lit(0).alias("query"), F.expr(f"cast(pmod(xxhash64(id), {shards}) as int)").alias("shard"))
    asked = valid(queries).groupBy("id").agg(F.min("vector").alias("vector")).select("*", F.lit(1).alias("query"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    rows = stored.unionByName(asked).withColumn("dim", F.size("vector"))
    dealt = rows.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "query", "id")
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def shards_for(index: DataFrame, vector: str = "embedding") -> int:
    """As few shards as fit a task, since every query goes to each; of a small table, one for each core."""
    n, components = index.agg(F.count("*"), F.sum(F.size(vector).cast("long"))).first()
    fitting = -(-8 * max(0, components or 0) // SHARD_BYTES)
    return max(1, fitting, min(index.sparkSession.sparkContext.defaultParallelism, n // SHARD_ROWS))

"""Approximate nearest neighbours along shifted Hilbert curves.

Each curve projects the vectors on a few random directions, shifts them, and orders them
along a Hilbert curve through the projected cells. Spark range-partitions the vectors by
(curve, position, id); a vector's rank along each curve follows from the partitions'
sizes. A query's window on a curve is all within ``window`` ranks; it is dealt to the
blocks of ranks that it touches, neighbouring blocks answer for their part, and the parts
of all curves merge and are ranked by the exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fan_out, released
from .embedding_dedup import as_matrix, usable

#: Ranks in a block, and most queries that one task compares with a block.
BLOCK, QUERIES = 2048, 1024


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of points with integer coordinates of ``bits``
    bits; bits * dimensions is at most 62."""
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    for level in range(bits - 1, 0, -1):
        q = np.int64(1) << level
        low = q - 1
        for d in range(dims):
            high = (x[:, d] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    turn = np.zeros(len(x), dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        q = np.int64(1) << level
        turn ^= np.where((x[:, -1] & q) != 0, q - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[:, d] >> level & 1)
    return key


class Curves:
    """The orderings: directions and shifts are fixed by the seed, scales by the vectors'
    mean and covariance."""

    def __init__(self, mean: np.ndarray, covariance: np.ndarray, curves: int, dims: int, bits: int, seed: int):
        self.bits, self.mean = bits, mean
        rng = np.random.default_rng(seed)
        n = len(mean)
        self.maps = []
        for _ in range(curves):
            q = np.linalg.qr(rng.normal(size=(n, n)))[0][:, : min(dims, n)]
            spread = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", q, covariance, q), 1e-24))
            self.maps.append((q / (6 * spread), rng.uniform(-0.15, 0.15, size=q.shape[1])))

    def keys(self, x: np.ndarray, curve: int) -> np.ndarray:
        directions, shift = self.maps[curve]
        y = np.floor(((x - self.mean) @ directions + 0.5 + shift) * (1 << self.bits))
        return hilbert(np.clip(y, 0, (1 << self.bits) - 1), self.bits)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of [1, x] [1, x]^T over a partition, an entry a row."""
    total = None
    for batch in batches:
        if batch.num_rows:
            x = as_matrix(batch.column(0))
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["k", "v"])


def _placed(curves: Curves):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                x = as_matrix(some.column("embedding"))
                for c in range(len(curves.maps)):
                    place = [pa.array(np.full(len(x), c, dtype=np.int32)), pa.array(curves.keys(x, c))]
                    yield pa.RecordBatch.from_arrays([*place, *some.columns], ["curve", "place", *some.schema.names])

    return run


def _ranked(offsets: dict[int, dict[int, int]], window: int, sizes: int, chunks: int):
    """Rows of a partition, in order along its curves, to block rows: each vector in its
    own block, and each query in all blocks that its window touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_rank = dict(offsets.get(TaskContext.get().partitionId(), {}))
        for batch in batches:
            if not batch.num_rows:
                continue
            curve = batch.column("curve").to_numpy()
            rank = np.empty(len(curve), dtype=np.int64)
            for c in np.unique(curve):
                mine = np.flatnonzero(curve == c)
                rank[mine] = next_rank[int(c)] + np.arange(len(mine))
                next_rank[int(c)] += len(mine)
            asks = np.flatnonzero(batch.column("asks").to_numpy(zero_copy_only=False))
            first = np.maximum(0, rank[asks] - window) // BLOCK
            last = np.minimum(sizes - 1, rank[asks] + window) // BLOCK
            n = last - first + 1
            who = np.repeat(asks, n)
            block = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            own = np.arange(len(curve))
            chunk = np.concatenate([np.repeat(np.arange(chunks), len(own)), rank[who] % chunks])
            rows = np.concatenate([*[own] * chunks, who])
            blocks = np.concatenate([*[rank // BLOCK] * chunks, block])
            query = np.concatenate([np.zeros(len(own) * chunks, dtype=bool), np.ones(len(who), dtype=bool)])
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array((curve[rows].astype(np.int64) << 40 | blocks) * chunks + chunk), pa.array(query), pa.array(rank[rows]), batch.column("node").take(take), batch.column("embedding").take(take)],
                ["cell", "query", "rank", "node", "embedding"],
            )

    return run


def _answers(window: int, k: int):
    """Each query's ``k`` nearest of a block's vectors in its window, itself included."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        query = table.column("query").to_numpy(zero_copy_only=False)
        rank, node = table.column("rank").to_numpy(), table.column("node").to_numpy()
        x = as_matrix(table.column("embedding").combine_chunks())
        q, v = np.flatnonzero(query), np.flatnonzero(~query)
        asked, found, score = [], [], []
        norms = (x[v] * x[v]).sum(axis=1)
        for at in range(0, len(q) if len(v) else 0, 256):
            some = q[at : at + 256]
            d = norms[None, :] - 2 * (x[some] @ x[v].T)  # less the query's own norm
            d[np.abs(rank[some][:, None] - rank[v][None, :]) > window] = np.inf
            near = np.argpartition(d, min(2 * k, len(v)) - 1, axis=1)[:, : 2 * k]
            for row, columns in zip(some, near):
                exact = np.sqrt(((x[v[columns]] - x[row]) ** 2).sum(axis=1))
                exact[np.abs(rank[row] - rank[v[columns]]) > window] = np.inf
                best = np.lexsort((node[v[columns]], exact))[:k]
                best = best[np.isfinite(exact[best])]
                asked += [node[row]] * len(best)
                found += node[v[columns[best]]].tolist()
                score += exact[best].tolist()
        return pa.table({"asked": pa.array(asked, pa.int64()), "found": pa.array(found, pa.int64()), "score": pa.array(score, pa.float64())})

    return run


def nearest(
    vectors: DataFrame, queries: str = "vec_id % 100 = 0", k: int = 10, curves: int = 16, dims: int = 8, bits: int = 4,
    share: float = 0.04, least_window: int = 1024, seed: int = 2,
) -> DataFrame:
    """The ``k`` nearest found of every row of ``vectors`` (vec_id, embedding) that meets
    the condition ``queries``: query_id, rank (int, from 1), vec_id, score (Euclidean
    distance in double precision), nearest first, ties to the smaller vec_id.

    A window reaches ``least_window`` ranks or the ``share`` of all ranks to either side,
    whichever is more. Vectors null, empty, zero or with a null or non-finite component, or
    of another length than most: take no part. Null vec_id: takes no part. Rows with a
    query's own vec_id are no candidates for it. Equal vectors (told by a 64-bit hash) are
    one entry of the index and come out by their smallest ids. Repeated rows: one. Empty table, or a lone vector:
    no rows. Other columns: ignored."""
    # Single precision stays so; all else is held in double, as the score is of the original.
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    slim = slim.filter(F.col("vec_id").isNotNull() & usable())
    lengths = slim.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], empty)
    slim = slim.filter(F.size("embedding") == lengths["n"]).withColumn("node", F.xxhash64("embedding"))
    # Equal vectors: the k + 1 smallest ids are enough to answer any query among them. Each
    # task keeps so many for each vector and salt before the next brings them together.
    ids = slim.groupBy("node", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(F.first("embedding").alias("embedding"), F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"), F.max(F.expr(queries)).alias("asks"))
    nodes = ids.groupBy("node").agg(F.first("embedding").alias("embedding"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"), F.max("asks").alias("asks"))
    nodes = cut(nodes)
    n = nodes.count()
    sums = nodes.select("embedding").mapInArrow(released(_moments), "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
    m = np.array([r.v for r in sums]).reshape(lengths["n"] + 1, -1)
    mean = m[0, 1:] / n
    order = Curves(mean, m[1:, 1:] / n - np.outer(mean, mean), curves, dims, bits, seed)
    window = max(least_window, int(np.ceil(share * n)))
    placed = nodes.select("node", "asks", "embedding").mapInArrow(released(_placed(order)), f"curve int, place long, node long, asks boolean, embedding {kind}")
    # Cut: partitions and their order are the same for the sizes and for the ranks.
    parts = cut(placed.repartitionByRange(fan_out(vectors.sparkSession), "curve", "place", "node").sortWithinPartitions("curve", "place", "node"))
    sizes = parts.groupBy(F.spark_partition_id().alias("part"), "curve").count().collect()  # one row a partition and curve in it
    offsets: dict[int, dict[int, int]] = {}
    seen = [0] * curves
    for part, curve, count in sorted((r["part"], r["curve"], r["count"]) for r in sizes):
        offsets.setdefault(part, {})[curve] = seen[curve]
        seen[curve] += count
    asking = nodes.filter("asks").count()
    chunks = max(1, -(-asking * min(n, 2 * window + BLOCK) // max(1, n) // QUERIES))
    cells = parts.mapInArrow(released(_ranked(offsets, window, n, chunks)), f"cell long, query boolean, rank long, node long, embedding {kind}")
    found = cells.groupBy("cell").applyInArrow(_answers(window, k + 1), "asked long, found long, score double").distinct()
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("asked").orderBy("score", "found"))).filter(F.col("r") <= 4 * (k + 1))
    named = top.join(nodes.select(F.col("node").alias("found"), F.explode("ids").alias("vec_id")), "found")
    best = Window.partitionBy("asked").orderBy("score", "vec_id")
    lists = named.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    lists = cut(lists.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("list")))
    asks = slim.filter(F.expr(queries)).select(F.col("vec_id").alias("query_id"), "node").distinct()
    own = F.slice(F.filter("list", lambda e: e["vec_id"] != F.col("query_id")), 1, k)
    rows = asks.join(lists, F.col("node") == F.col("asked")).select("query_id", F.posexplode(own).alias("at", "e"))
    return rows.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))

"""Near-duplicate embeddings by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its
hash is the signed axis it comes nearest to, and the second nearest axis is its probe. A
bucket joins ``hashes`` such axes; in each of ``tables`` tables a vector lies in the bucket
of its nearest axes and is looked for in those of every mix of first and second axes.
Two vectors at cosine 0.9 meet in a table with probability of about 0.4, so 20 tables miss
fewer than one such pair in ten thousand, and closer pairs far fewer.

Bucket members carry an id only; vectors join the few that meet another. Cosines are then
computed in blocks, in double precision. A pair counts in the first bucket in which it
meets, so links are counted without listing them, and a block passes on a spanning forest
of its links for the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import arranged, dealt
from .common import cut, released
from .components import components
from .simhash import forest, grouped

CELL = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


class CrossPolytope:
    """Bucket codes of unit vectors; a fixed function of its parameters and the length."""

    def __init__(self, tables: int, hashes: int, seed: int):
        self.tables, self.hashes, self.seed = tables, hashes, seed
        self.mixes = np.array(list(product((0, 1), repeat=hashes)))

    def codes(self, x: np.ndarray, table: int) -> np.ndarray:
        """(rows, probes): bucket codes of a table, the first of which is the row's own."""
        wide = 1 << max(1, x.shape[1] - 1).bit_length()
        padded = np.zeros((len(x), wide))
        padded[:, : x.shape[1]] = x
        signs = np.random.default_rng([self.seed, table, wide]).choice([-1.0, 1.0], size=(self.hashes, 3, wide))
        code = np.zeros((len(x), len(self.mixes)), dtype=np.int64)
        rows = np.arange(len(x))
        for k in range(self.hashes):
            y = padded
            for r in range(3):
                y = hadamard(y * signs[k, r])
            size, axes = np.abs(y), []
            for _ in range(2):
                at = size.argmax(axis=1)
                axes.append(2 * at + (y[rows, at] > 0))
                size[rows, at] = -1
            code = code * (2 * wide) + np.stack(axes, axis=1)[:, self.mixes[:, k]]
        return (code * self.tables + table) * 4099 + x.shape[1]


def as_matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vectors."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield rows, as_matrix(column.take(pa.array(rows)))


def _members(hasher: CrossPolytope):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            for rows, x in by_length(batch.column("embedding")):
                x = unit(x)
                for at in range(0, len(rows), 2048):
                    some = nodes[rows[at : at + 2048]]
                    for t in range(hasher.tables):
                        code = hasher.codes(x[at : at + 2048], t)
                        own = np.zeros(code.shape, dtype=bool)
                        own[:, 0] = True
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(code.ravel()), pa.array(np.repeat(some, code.shape[1])), pa.array(own.ravel())], ["bucket", "member", "own"]
                        )

    return run


def _first_meetings(hasher: CrossPolytope, x: np.ndarray, i: np.ndarray, j: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Which pairs (i, j), found in ``bucket``, meet in no earlier one: of a pair's buckets
    that of the lowest table counts, and of two in a table that of the lower code."""
    first, open_ = np.zeros(len(i), dtype=bool), np.arange(len(i))
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    for t in range(hasher.tables):
        if not len(open_):
            break
        code = hasher.codes(x[used], t)
        p, q = a[open_], b[open_]
        big = np.iinfo(np.int64).max
        meets = np.minimum(
            np.where((code[q] == code[p, :1]).any(axis=1), code[p, 0], big), np.where((code[p] == code[q, :1]).any(axis=1), code[q, 0], big)
        )
        first[open_] = meets == bucket[open_]
        open_ = open_[meets == big]
    return first


def _linked(hasher: CrossPolytope, least: float):
    def block(group: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bucket, own, lots, a, b = (group[c] for c in ("bucket", "own", "lot", "lot_a", "lot_b"))
        first = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        size = np.diff(np.append(first, len(bucket)))
        last, here = np.repeat(first + size, size), np.flatnonzero(np.repeat(size <= 8, size))
        pairs = []
        for shift in range(1, 8):
            here = here[here + shift < last[here]]
            near = (x[here] * x[here + shift]).sum(axis=1) >= least
            pairs.append((here[near], here[near] + shift))
        for f, n in zip(first[size > 8], size[size > 8]):
            for at in range(f, f + n, 512):
                p, q = np.nonzero(x[at : min(at + 512, f + n)] @ x[f : f + n].T >= least)
                p, q = p + at, q + f
                pairs.append((p[p < q], q[p < q]))
        i, j = (np.concatenate(v) for v in zip(*pairs))
        new = (own[i] | own[j]) & ((a[i] == b[i]) | (lots[i] != lots[j])) & (group["member"][i] != group["member"][j])
        return i[new], j[new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped_vectors(batches):
            for numbers, x in by_length(rows.pop("embedding")):
                group, x = {k: v[numbers] for k, v in rows.items()}, unit(x)
                i, j = block(group, x)
                out_a, out_b, kind = [], [], []
                for at in range(0, len(i), 200_000):
                    p, q = i[at : at + 200_000], j[at : at + 200_000]
                    found = _first_meetings(hasher, x, p, q, group["bucket"][p])
                    p, q = p[found], q[found]
                    names, local = np.unique(group["member"], return_inverse=True)
                    links = np.zeros(len(names), dtype=np.int64)
                    np.add.at(links, local[p], group["copies"][q])
                    np.add.at(links, local[q], group["copies"][p])
                    some = np.flatnonzero(links)
                    tree = np.array(forest(local[p], local[q], len(names)), dtype=np.int64).reshape(-1, 2)
                    out_a += [names[some], names[tree[:, 0]]]
                    out_b += [links[some], names[tree[:, 1]]]
                    kind += [np.zeros(len(some), dtype=bool), np.ones(len(tree), dtype=bool)]
                if out_a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (kind, out_a, out_b)], ["link", "a", "b"])

    return run


def grouped_vectors(batches: Iterator[pa.RecordBatch], most: int = 20_000) -> Iterator[dict]:
    """As ``grouped``, with the vectors left as an Arrow column."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def flat(bs: list[pa.RecordBatch]) -> dict:
        table = pa.Table.from_batches(bs).combine_chunks()
        return {n: table.column(n).to_numpy() for n in table.column_names if n != "embedding"} | {"embedding": table.column("embedding").combine_chunks()}

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        ids = batch.column("cell").to_numpy()
        cut_at = int(np.searchsorted(ids, ids[-1], side="left"))
        if cut_at == 0 and (len(held) == 1 or held[-2].column("cell")[-1].as_py() == ids[0]):
            continue
        out = [*held[:-1], batch.slice(0, cut_at)]
        held = [batch.slice(cut_at)]
        rows = held[0].num_rows
        yield flat(out)
    if held:
        yield flat(held)


def usable(column: str = "embedding") -> "F.Column":
    """Whether a vector has a direction: not null, not empty, not all zero, and every
    component a finite number."""
    finite = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(F.col(column).isNotNull() & finite & F.exists(column, lambda v: v != 0), F.lit(False))


def near_vectors(vectors: DataFrame, least: float = 0.9, tables: int = 20, hashes: int = 3, seed: int = 20) -> DataFrame:
    """One row for each row of ``vectors`` (vec_id, embedding): vec_id, n_links (other
    vectors with a cosine of at least ``least``), component_id (smallest vec_id reachable by
    links, itself included), kept (vec_id = component_id).

    Vectors null, empty, zero or with a null or non-finite component: no links, their own
    component. Vectors of different lengths: never linked. Null vec_id: takes part, names a
    component only if it has no other. Repeated rows and equal vectors: linked with each
    other, hashed and compared once. Empty table: no rows. Other columns: ignored. Vectors
    are told apart by a 64-bit hash of their components. ``hashes`` should grow with the
    table so that (2 * length) ** hashes stays above its rows."""
    hasher = CrossPolytope(tables, hashes, seed)
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    slim = slim.withColumn("node", F.when(usable(), F.xxhash64("embedding")))
    nodes = cut(slim.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")))
    members = nodes.select("node", "embedding").mapInArrow(released(_members(hasher)), "bucket long, member long, own boolean")
    cells = dealt(members, CELL, own="own").join(nodes.select(F.col("node").alias("member"), "copies", "embedding"), "member")
    cells = arranged(cells.select("cell", "bucket", "member", "own", "lot", "lot_a", "lot_b", "copies", "embedding"))
    found = cut(cells.mapInArrow(released(_linked(hasher, least)), "link boolean, a long, b long"))
    links = found.filter("not link").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    roots = components(found.filter("link").select("a", "b"))
    own = nodes.drop("embedding").join(roots, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_of = own.groupBy("root").agg(F.min("least").alias("component"))
    named = own.join(least_of, "root").select("node", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = slim.drop("embedding").join(cut(named), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )

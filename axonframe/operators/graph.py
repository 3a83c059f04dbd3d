"""Graph metrics per frame. Both orientations of an edge are rows; what has a relational
form is joins and sums, and what needs a whole frame runs on one frame's Arrow group."""

from __future__ import annotations

from collections import deque
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import nz, sdiv
from ..sources.checks import check_edges, check_values


def both_sides(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, unfolded in place: the edges are read once, and what
    computes them stays alike in every use, so that its exchange is shared."""
    ends = [F.struct(F.col(x).alias("src"), F.col(y).alias("dst")) for x, y in (("src", "dst"), ("dst", "src"))]
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    both = edges.withColumn("_ends", F.explode(F.array(*ends)))
    return both.select(*[F.col(c) if c in rest else F.col(f"_ends.{c}").alias(c) for c in edges.columns])


def strength(sides: DataFrame, frame: list[str]) -> DataFrame:
    return sides.groupBy(*frame, F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def clustering(sides: DataFrame, frame: list[str]) -> DataFrame:
    """Binary local clustering; fewer than two neighbours: 0. A triangle is found once, at
    the smallest of its nodes, and then counted at all three."""
    s = sides.select(*frame, "src", "dst")
    up = s.filter("src < dst")
    wedge = up.withColumnsRenamed({"src": "low", "dst": "a"}).join(up.withColumnsRenamed({"src": "low", "dst": "b"}), [*frame, "low"]).filter("a < b")
    closed = wedge.join(up.withColumnsRenamed({"src": "a", "dst": "b"}), [*frame, "a", "b"], "left_semi")
    tri = closed.select(*frame, F.explode(F.array("low", "a", "b")).alias("node")).groupBy(*frame, "node").agg(F.count("*").alias("tri"))
    k = s.groupBy(*frame, F.col("src").alias("node")).agg(F.count("*").alias("k"))
    return k.join(tri, [*frame, "node"], "left").select(*frame, "node", nz(sdiv(2 * F.coalesce("tri", F.lit(0)), F.col("k") * (F.col("k") - 1))).alias("clustering"))


def _successive(sides: DataFrame, by: list[str], lag: int) -> DataFrame:
    """Per (by, frame, node): sums of squares here and ``lag`` frames later, of products, and
    counts of the union and intersection of neighbours."""
    a = sides.select(*by, "t_idx", F.col("src").alias("node"), "dst", F.col("weight").alias("x"))
    b = sides.select(*by, (F.col("t_idx") - lag).alias("t_idx"), F.col("src").alias("node"), "dst", F.col("weight").alias("y"))
    j = a.join(b, [*by, "t_idx", "node", "dst"], "full")
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    both = (F.col("x").isNotNull() & F.col("y").isNotNull()).cast("long")
    return j.groupBy(*by, "t_idx", "node").agg(
        F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy"), F.count("x").alias("nx"), F.count("y").alias("ny"), F.sum(both).alias("inter"), F.count("*").alias("either")
    )


def cosine_frames(sides: DataFrame, by: list[str], lag: int = 1) -> DataFrame:
    s = _successive(sides, by, lag).filter("nx > 0 and ny > 0")
    return s.select(*by, "t_idx", "node", sdiv("xy", F.sqrt(F.col("xx") * F.col("yy"))).alias("cosine"))


def jaccard_frames(sides: DataFrame, by: list[str], lag: int = 1) -> DataFrame:
    s = _successive(sides, by, lag).filter("nx > 0 and ny > 0")
    return s.select(*by, "t_idx", "node", sdiv("inter", "either").alias("jaccard"))


def temporal_correlation(sides: DataFrame, by: list[str], lag: int, frames: int) -> DataFrame:
    """Topological overlap of successive binary frames, averaged over frames - 1."""
    s = _successive(sides, by, lag).filter("nx > 0 and ny > 0")
    return s.groupBy(*by, "node").agg((F.sum(sdiv("inter", F.sqrt(F.col("nx") * F.col("ny")))) / F.lit(float(frames - 1))).alias("c"))


def modularity(edges: DataFrame, frame: list[str], community) -> DataFrame:
    """Q of a given partition: ``community`` maps a node column to its community."""
    both = both_sides(edges).withColumn("c", community("src")).withColumn("d", community("dst"))
    total = edges.groupBy(*frame).agg(F.sum("weight").alias("m"))
    per = both.groupBy(*frame, "c").agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("c") == F.col("d"), F.col("weight")).otherwise(0.0)).alias("inside"))
    j = per.join(total, frame)
    two_m = 2 * F.col("m")
    return j.groupBy(*frame).agg(F.sum(sdiv("inside", two_m) - F.pow(sdiv("k", two_m), 2)).alias("q"))


def participation(sides: DataFrame, frame: list[str], community) -> DataFrame:
    k = sides.withColumn("c", community("dst")).groupBy(*frame, F.col("src").alias("node"), "c").agg(F.sum("weight").alias("k"))
    return k.groupBy(*frame, "node").agg((1 - sdiv(F.sum(F.col("k") * F.col("k")), F.pow(F.sum("k"), 2))).alias("participation"))


def allegiance(membership: DataFrame, frame: list[str], by: list[str]) -> DataFrame:
    """Share of frames in which two nodes have one community; ``membership``: frame, node,
    community."""
    frames = membership.select(*frame).distinct().groupBy(*by).agg(F.count("*").alias("frames"))
    a = membership.select(*frame, "community", F.col("node").alias("src"))
    b = membership.select(*frame, "community", F.col("node").alias("dst"))
    n = a.join(b, [*frame, "community"]).filter("src < dst").groupBy(*by, "src", "dst").agg(F.count("*").alias("n"))
    return n.join(frames, by).select(*by, "src", "dst", sdiv("n", "frames").alias("allegiance"))


class Frame:
    """One frame's graph: neighbour lists over numbered nodes."""

    def __init__(self, src: list[str], dst: list[str], weight: np.ndarray):
        self.nodes = sorted({*src, *dst})
        number = {v: i for i, v in enumerate(self.nodes)}
        self.w = np.zeros((len(self.nodes), len(self.nodes)))
        for a, b, w in zip(src, dst, weight):
            self.w[number[a], number[b]] = self.w[number[b], number[a]] = w
        self.near = [np.flatnonzero(r).tolist() for r in self.w]

    def hops(self, start: int, inside: set[int] | None = None) -> dict[int, int]:
        seen, queue = {start: 0}, deque([start])
        while queue:
            v = queue.popleft()
            for u in self.near[v]:
                if u not in seen and (inside is None or u in inside):
                    seen[u] = seen[v] + 1
                    queue.append(u)
        return seen

    def coreness(self) -> list[float]:
        left, core, k = {v: len(n) for v, n in enumerate(self.near)}, [0.0] * len(self.near), 0
        while left:
            v = min(left, key=lambda x: (left[x], x))
            k = max(k, left.pop(v))
            core[v] = float(k)
            for u in self.near[v]:
                if u in left:
                    left[u] -= 1
        return core

    def betweenness(self) -> list[float]:
        """Each unordered pair counted twice."""
        out = np.zeros(len(self.near))
        for s in range(len(self.near)):
            seen, paths, order = {s: 0}, {s: 1.0}, []
            queue = deque([s])
            while queue:
                v = queue.popleft()
                order.append(v)
                for u in self.near[v]:
                    if u not in seen:
                        seen[u], paths[u] = seen[v] + 1, 0.0
                        queue.append(u)
                    if seen[u] == seen[v] + 1:
                        paths[u] += paths[v]
            load = dict.fromkeys(order, 0.0)
            for v in reversed(order):
                for u in self.near[v]:
                    if seen[u] == seen[v] + 1:
                        load[v] += paths[v] / paths[u] * (1 + load[u])
                if v != s:
                    out[v] += load[v]
        return out.tolist()

    def efficiency(self) -> list[float]:
        """Mean inverse distance among a node's neighbours, in the graph that they span."""
        out = []
        for n in self.near:
            k, inside = len(n), set(n)
            out.append(sum(1 / d for v in n for u, d in self.hops(v, inside).items() if u != v) / (k * (k - 1)) if k > 1 else 0.0)
        return out

    def closeness(self) -> list[float]:
        return [float(sum(self.hops(v).values())) for v in range(len(self.near))]

    def louvain(self, rounds: int = 20) -> list[float]:
        """Communities by greedy modularity moves and aggregation, in the order of nodes."""
        w, group = self.w.copy(), np.arange(len(self.nodes))
        while True:
            k, m2, label = w.sum(axis=1), w.sum(), np.arange(len(w))
            if m2 == 0:
                break
            for _ in range(rounds):
                moved = False
                for v in range(len(w)):
                    links = np.bincount(label, weights=w[v] * (np.arange(len(w)) != v), minlength=len(w))
                    mass = np.bincount(label, weights=k * (np.arange(len(w)) != v), minlength=len(w))
                    gain = links - k[v] * mass / m2
                    best = int(gain.argmax())
                    if gain[best] > gain[label[v]] + 1e-12:
                        label[v], moved = best, True
                if not moved:
                    break
            names, label = np.unique(label, return_inverse=True)
            if len(names) == len(w):
                break
            join = np.eye(len(names))[label]
            w, group = join.T @ w @ join, label[group]
        return np.unique(group, return_inverse=True)[1].astype(float).tolist()


METRICS = ("coreness", "betweenness", "efficiency", "closeness", "louvain")


def frame_metric(edges: DataFrame, frame: list[str], metric: str) -> DataFrame:
    """(frame, node, ``metric``) by a whole-frame kernel; a frame's nodes are the recording's
    channels, so a group is bounded however many frames there are."""
    check_values([metric], METRICS, "metric")
    types = dict(check_edges(edges, frame, weighted=True).dtypes)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        g = Frame(table.column("src").to_pylist(), table.column("dst").to_pylist(), table.column("weight").to_numpy())
        values = getattr(g, metric)()
        out = {c: pa.array([k.as_py()] * len(values), table.schema.field(c).type) for c, k in zip(frame, key)}
        return pa.table(out | {"node": pa.array(g.nodes, pa.string()), metric: pa.array(values, pa.float64())})

    schema = ", ".join([f"{c} {types[c]}" for c in frame] + [f"node string, {metric} double"])
    return edges.select(*frame, "src", "dst", "weight").groupBy(*frame).applyInArrow(run, schema)


def rewired(edges: DataFrame, frame: list[str], swaps: int, seed: int) -> DataFrame:
    """Degree-preserving random swaps of edge ends within each frame."""
    types = dict(edges.dtypes)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("src").to_pylist(), table.column("dst").to_pylist(), table.column("weight").to_pylist()))
        rng = np.random.default_rng([seed, crc32(repr([k.as_py() for k in key]).encode())])
        e = [list(r[:2]) for r in rows]
        have = {frozenset(x) for x in e}
        for _ in range(swaps * len(e) if len(e) > 1 else 0):
            i, j = rng.choice(len(e), 2, replace=False)
            (a, b), (c, d) = e[i], e[j]
            if rng.random() < 0.5:
                c, d = d, c
            new = frozenset((a, d)), frozenset((c, b))
            if len({a, b, c, d}) == 4 and not (set(new) & have):
                have -= {frozenset((a, b)), frozenset((c, d))}
                have |= set(new)
                e[i], e[j] = [a, d], [c, b]
        src, dst = zip(*(sorted(x) for x in e))
        out = {c: pa.array([k.as_py()] * len(e), table.schema.field(c).type) for c, k in zip(frame, key)}
        return pa.table(out | {"src": pa.array(src), "dst": pa.array(dst), "weight": pa.array([r[2] for r in rows])})

    schema = ", ".join([f"{c} {types[c]}" for c in frame] + ["src string, dst string, weight double"])
    return edges.select(*frame, "src", "dst", "weight").groupBy(*frame).applyInArrow(run, schema)

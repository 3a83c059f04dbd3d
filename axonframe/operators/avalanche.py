"""Avalanches: components of the graph that links active nodes within a frame and to the
next frame, and what is computed from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import sdiv
from .runs import runs


def supra_edges(active: DataFrame, by: list[str], last: int, strict: bool = False) -> DataFrame:
    """(by, a_node, a_t, b_node, b_t): nodes active together at t are linked at t and to each
    other's next frame, and every active node to its own next frame; frames before ``last``.
    ``strict`` also asks the next frame's node to be active."""
    on = active.filter("active = 1")
    x = on.filter(F.col("t_idx") < last).select(*by, F.col("node").alias("a_node"), F.col("t_idx").alias("a_t"))
    y = on.select(*by, F.col("node").alias("b_node"), F.col("t_idx").alias("a_t"))
    pair = x.join(y, [*by, "a_t"])
    same = pair.filter("a_node < b_node").select(*by, "a_node", "a_t", "b_node", F.col("a_t").alias("b_t"))
    if not strict:
        onward = pair.select(*by, "a_node", "a_t", "b_node", (F.col("a_t") + 1).alias("b_t"))
    else:
        z = on.select(*by, F.col("node").alias("b_node"), F.col("t_idx").alias("b_t"))
        onward = x.withColumn("b_t", F.col("a_t") + 1).join(z, [*by, "b_t"]).select(*by, "a_node", "a_t", "b_node", "b_t")
    return same.unionByName(onward)


def _component_kernel(by: list[str], schema: pa.Schema):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        cols = [table.column(c).to_numpy() for c in ("a_t", "a_node", "b_t", "b_node")]
        ends = np.concatenate([np.stack(cols[:2], 1), np.stack(cols[2:], 1)])
        names, at = np.unique(ends, axis=0, return_inverse=True)  # sorted by (t, node)
        at = at.ravel()
        n = len(cols[0])
        label = np.arange(len(names))
        i, j = at[:n], at[n:]
        while True:
            low = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, label[i], low)
            np.minimum.at(new, label[j], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        out = {c: pa.array([k.as_py()] * len(names), schema.field(c).type) for c, k in zip(by, key)}
        out |= {"node": pa.array(names[:, 1]), "t_idx": pa.array(names[:, 0]), "av_t": pa.array(names[label, 0]), "av_node": pa.array(names[label, 1])}
        return pa.table(out)

    return run


def avalanches(edges: DataFrame, by: list[str]) -> DataFrame:
    """Members (by, node, t_idx) with their component's earliest (av_t, av_node). A frame
    graph belongs to one trial, whose size is fixed by the recording, so each is one Arrow
    group; trials are what scales."""
    types = dict(edges.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in by] + ["node long, t_idx long, av_t long, av_node long"])
    arrow = pa.schema([(c, pa.string() if types[c] == "string" else pa.int64()) for c in by])
    return edges.select(*by, "a_t", "a_node", "b_t", "b_node").groupBy(*by).applyInArrow(_component_kernel(by, arrow), schema)


def across_areas(members: DataFrame, by: list[str], area, more_than: int = 1) -> DataFrame:
    """Members of avalanches that touch more than so many distinct areas."""
    m = members.withColumn("area", area)
    key = [*by, "av_t", "av_node"]
    wide = m.groupBy(*key).agg(F.count_distinct("area").alias("areas")).filter(F.col("areas") > more_than).drop("areas")
    return m.join(wide, key, "left_semi")


def coavalanche(members: DataFrame, by: list[str], unit: list[str]) -> DataFrame:
    """T: share of avalanches with both areas; P: share in which src comes strictly first.
    Avalanches are units of ``by``."""
    key = [*by, *unit, "av_t", "av_node"]
    first = members.groupBy(*key, "area").agg(F.min("t_idx").alias("t0"))
    total = first.select(*key).distinct().groupBy(*by).agg(F.count("*").alias("total"))
    a = first.select(*key, F.col("area").alias("src"), F.col("t0").alias("ta"))
    b = first.select(*key, F.col("area").alias("dst"), F.col("t0").alias("tb"))
    n = a.join(b, key).filter("src <> dst").groupBy(*by, "src", "dst").agg(F.count("*").alias("n"), F.sum((F.col("ta") < F.col("tb")).cast("long")).alias("first"))
    return n.join(total, by).select(*by, "src", "dst", (F.col("n") / F.col("total")).alias("t"), (F.col("first") / F.col("total")).alias("p"))


def sizes(members: DataFrame, key: list[str]) -> DataFrame:
    """Size, duration (last - first + 1) and branching: mean ratio of successive occupied
    frames' counts."""
    frames = members.groupBy(*key, "t_idx").agg(F.count("*").alias("n"))
    frames = frames.withColumn("ratio", F.lead("n").over(Window.partitionBy(*key).orderBy("t_idx")) / F.col("n"))
    return frames.groupBy(*key).agg(F.sum("n").alias("size"), (F.max("t_idx") - F.min("t_idx") + 1).alias("duration"), F.avg("ratio").alias("branching"))


def population_runs(active: DataFrame, by: list[str], q: float) -> DataFrame:
    """Runs of frames whose number of active nodes reaches the q-th quantile of its series."""
    rho = active.groupBy(*by, "t_idx").agg(F.sum("active").alias("rho"))
    thr = rho.groupBy(*by).agg(F.percentile("rho", F.lit(q)).alias("q"))
    state = rho.join(thr, by).withColumn("active", ((F.col("rho") >= F.col("q")) & (F.col("rho") > 0)).cast("long"))
    return runs(state, by)


def graphlets(active: DataFrame, by: list[str], q: float) -> DataFrame:
    """Mean outer product of activity within each run of high population activity."""
    r = population_runs(active, by, q).withColumn("t_idx", F.explode(F.sequence("start", F.col("end") - 1)))
    on = active.filter("active = 1").join(r, [*by, "t_idx"])
    a = on.select(*by, "t_idx", "start", "len", F.col("node").alias("src"))
    b = on.select(*by, "t_idx", F.col("node").alias("dst"))
    return a.join(b, [*by, "t_idx"]).filter("src < dst").groupBy(*by, "start", "len", "src", "dst").agg(F.count("*").alias("n")).withColumn("k", sdiv("n", "len"))


def transitions(active: DataFrame, by: list[str], q: float, longer_than: int) -> DataFrame:
    """Probability that dst is active in the frame after src, within long enough runs."""
    r = population_runs(active, by, q).filter(F.col("len") > longer_than)
    r = r.withColumn("t_idx", F.explode(F.sequence("start", F.col("end") - 1)))
    on = active.filter("active = 1").join(r.select(*by, "start", "end", "t_idx"), [*by, "t_idx"]).select(*by, "start", "end", "t_idx", "node")
    a = on.filter("t_idx < end - 1").select(*by, "start", F.col("t_idx").alias("t"), F.col("node").alias("src"))
    b = on.select(*by, "start", (F.col("t_idx") - 1).alias("t"), F.col("node").alias("dst"))
    hits = a.join(b, [*by, "start", "t"]).groupBy("src", "dst").agg(F.count("*").alias("n"))
    base = a.groupBy("src").agg(F.count("*").alias("m"))
    return hits.join(base, "src").select("src", "dst", sdiv("n", "m").alias("p"))



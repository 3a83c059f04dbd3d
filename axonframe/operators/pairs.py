"""Operators on pairs of nodes: an equi-join on the frame with an order between the two,
so that Catalyst plans a hash or merge join and never a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import nz, sdiv
from .aggregate import safe_corr


def pair_up(df: DataFrame, frame: list[str], value: str = "value", node: str = "node") -> DataFrame:
    """(frame, src, dst, x, y) for src < dst."""
    a = df.select(*frame, F.col(node).alias("src"), F.col(value).alias("x"))
    b = df.select(*frame, F.col(node).alias("dst"), F.col(value).alias("y"))
    return a.join(b, frame).filter("src < dst")


def products(df: DataFrame, frame: list[str], value: str = "value") -> DataFrame:
    """Edge signal x * y of every pair in every frame."""
    return pair_up(df, frame, value).withColumn("value", F.col("x") * F.col("y")).drop("x", "y")


def pearson(df: DataFrame, frame: list[str], by: list[str], value: str = "value") -> DataFrame:
    return pair_up(df, frame, value).groupBy(*by, "src", "dst").agg(safe_corr("x", "y").alias("r"))


def co_activity(active: DataFrame, frame: list[str], by: list[str], observations: int) -> DataFrame:
    """Share of the frames in which both nodes are active, the diagonal included; only
    active rows are joined."""
    a = active.filter("active = 1").select(*frame, F.col("node").alias("src"))
    b = active.filter("active = 1").select(*frame, F.col("node").alias("dst"))
    return a.join(b, frame).filter("src <= dst").groupBy(*by, "src", "dst").agg((F.count("*") / F.lit(float(observations))).alias("k"))


def degree(edges: DataFrame, by: list[str], value: str = "value", area_of=None, same_once: bool = False) -> DataFrame:
    """Sum of edge values at each area; edges within an area are left out, or count once."""
    area = area_of or (lambda c: F.col(c))
    e = edges.withColumn("_a", area("src")).withColumn("_b", area("dst"))
    ends = F.array_distinct(F.array("_a", "_b")) if same_once else F.array("_a", "_b")
    e = e if same_once else e.filter("_a <> _b")
    return e.withColumn("area", F.explode(ends)).groupBy(*by, "area").agg(F.sum(value).alias("degree"))


def meta_connectivity(edges: DataFrame, frame: list[str], by: list[str]) -> DataFrame:
    """Correlation of every two edge signals over the frames; undefined is 0. Each pair of
    edges once (edge_a <= edge_b, by src then dst)."""
    e = edges.withColumn("edge", F.concat_ws("~", "src", "dst"))
    a = e.select(*frame, F.col("edge").alias("edge_a"), F.col("value").alias("x"))
    b = e.select(*frame, F.col("edge").alias("edge_b"), F.col("value").alias("y"))
    return a.join(b, frame).filter("edge_a <= edge_b").groupBy(*by, "edge_a", "edge_b").agg(safe_corr("x", "y").alias("mc"))


def entanglement(meta: DataFrame, by: list[str]) -> DataFrame:
    """Row sums of the symmetric meta-connectivity, the diagonal once."""
    both = meta.select(*by, F.explode(F.array_distinct(F.array("edge_a", "edge_b"))).alias("edge"), "mc")
    return both.groupBy(*by, "edge").agg(F.sum("mc").alias("entanglement"))


def trimer_strength(meta: DataFrame, by: list[str]) -> DataFrame:
    """Sum of meta-connectivity over pairs of different edges that share a node, per node."""
    ends = lambda c: F.split(c, "~")
    shared = F.array_intersect(ends("edge_a"), ends("edge_b"))
    return meta.filter("edge_a < edge_b").withColumn("node", F.explode(shared)).groupBy(*by, "node").agg(F.sum("mc").alias("strength"))


def nonlinear_index(diffs: DataFrame, edge_diffs: DataFrame, frame: list[str], by: list[str]) -> DataFrame:
    """Share of frames in which both nodes and their edge rise together plus that in which
    they fall together."""
    x = diffs.select(*frame, F.col("node").alias("src"), F.col("diff").alias("x"))
    y = diffs.select(*frame, F.col("node").alias("dst"), F.col("diff").alias("y"))
    up = (F.col("x") > 0) & (F.col("y") > 0) & (F.col("diff") > 0)
    down = (F.col("x") < 0) & (F.col("y") < 0) & (F.col("diff") < 0)
    j = edge_diffs.join(x, [*frame, "src"]).join(y, [*frame, "dst"])
    return j.groupBy(*by, "src", "dst").agg((F.avg(up.cast("double")) + F.avg(down.cast("double"))).alias("nli"))


def significance_floor(df: DataFrame, thr: DataFrame, on: list[str], signed: bool = False) -> DataFrame:
    """Excess over the threshold, at least 0; signed: values as large as the threshold stay."""
    j = df.join(thr, on)
    keep = F.when(F.abs("value") >= F.abs("thr"), F.col("value")).otherwise(0.0) if signed else F.greatest(F.col("value") - F.col("thr"), F.lit(0.0))
    return j.withColumn("value", keep).drop("thr")


def overlap(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Hamming distance and overlap over the smaller count of two binary series."""
    both = F.sum((F.col("x") * F.col("y")).cast("double"))
    return pairs.groupBy(*by, "src", "dst").agg(F.avg((F.col("x") != F.col("y")).cast("double")).alias("hamming"), nz(sdiv(both, F.least(F.sum("x"), F.sum("y")))).alias("overlap"))

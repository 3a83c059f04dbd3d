"""Tables and their lifts onto the tensor model (node, freq, trial, t_idx, value).

Events: node = user_id mod 10, freq = event type, trial = day, t_idx = hour; a dense grid
with zeros. Commerce: node = supplier's nation in its region, freq = return flag, trial =
month, t_idx = day; sparse. Brands: edges between brands that meet in an order; frames are
months. Each lift aggregates right after the scan, so what moves is the grid, not the rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGIN = "2024-01-01"
#: Stages of an events trial: first hour of each.
STAGES = {"baseline": 0, "cue": 6, "delay": 12, "match": 18}
#: Epochs overlap: an hour may lie in two.
EPOCHS = {"P": (0, 5), "S": (5, 9), "D1": (9, 13), "D2": (12, 17), "Dm": (15, 20)}


def stage_of(t="t_idx") -> "F.Column":
    out = F.lit("baseline")
    for name, first in STAGES.items():
        out = F.when(F.col(t) >= first, F.lit(name)).otherwise(out)
    return out


class Tables:
    """The tables of a folder and the lifts over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def cells(self) -> DataFrame:
        e = self.table("events").select(
            (F.col("user_id") % 10).cast("long").alias("node"), F.col("event_type").alias("freq"),
            F.datediff(F.to_date("ts"), F.lit(ORIGIN)).cast("long").alias("trial"), F.hour("ts").cast("long").alias("t_idx"), "value",
        )
        return e.groupBy("node", "freq", "trial", "t_idx").agg(F.round(F.sum("value"), 4).alias("value"))

    @cached_property
    def sig(self) -> DataFrame:
        """Dense events signal. Its axes are small by construction (10 nodes, 24 hours) or
        grow with types and days alone: one narrow scan gathers them, combined before the
        shuffle, and they unfold to the grid without a product of tables, dealt out by
        series, as the window operators want it."""
        named = self.cells.agg(*[F.collect_set(c).alias(c) for c in ("node", "freq", "trial")])
        grid = named.select(F.explode("node").alias("node"), "freq", "trial").select("node", F.explode("freq").alias("freq"), "trial")
        grid = grid.select("node", "freq", F.explode("trial").alias("trial")).repartition("node", "freq", "trial").select("*", F.explode(F.sequence(F.lit(0), F.lit(23)).cast("array<bigint>")).alias("t_idx"))
        return grid.join(self.cells, ["node", "freq", "trial", "t_idx"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))

    @cached_property
    def trials(self) -> DataFrame:
        """Trial dimension of the events lift."""
        t = self.cells.select("trial").distinct()
        return t.select("trial", (F.col("trial") % 5 + 1).alias("stim"), (F.col("trial") % 2 + 1).alias("trial_type"), (F.col("trial") % 3 > 0).cast("long").alias("response"), (F.lit(18) + F.col("trial") % 4).alias("t_match"))

    @cached_property
    def act(self) -> DataFrame:
        """Events signal binarised at each (node, freq)'s 90th percentile."""
        from ..operators.aggregate import binarise, quantile

        return binarise(self.sig, quantile(self.sig, ["node", "freq"], 0.9), ["node", "freq"])

    @cached_property
    def com(self) -> DataFrame:
        s = self.table("supplier").join(F.broadcast(self.table("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
        s = s.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("node"), F.col("n_regionkey").cast("long").alias("region"))
        line = self.table("lineitem").select(
            "l_suppkey", F.col("l_returnflag").alias("freq"), ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("long").alias("trial"),
            (F.dayofmonth("l_shipdate") - 1).cast("long").alias("t_idx"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"),
        )
        by = ["freq", "trial", "t_idx"]
        part = line.groupBy("l_suppkey", *by).agg(F.sum("v").alias("v"))
        return part.join(s, "l_suppkey").groupBy("node", "region", *by).agg(F.round(F.sum("v"), 4).alias("value"))

    @cached_property
    def edge(self) -> DataFrame:
        """Brand graph: weight = orders in which the two brands meet, by flag, year, month."""
        orders = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.year("o_orderdate") - 1995).cast("long").alias("trial"), (F.month("o_orderdate") - 1).cast("long").alias("t_idx"))
        line = self.table("lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("freq"))
        ob = line.join(self.table("part").select("p_partkey", F.col("p_brand").alias("brand")), "p_partkey").join(orders, "l_orderkey")
        ob = ob.select("l_orderkey", "freq", "trial", "t_idx", "brand").distinct()
        sets = ob.groupBy("l_orderkey", "freq", "trial", "t_idx").agg(F.array_sort(F.collect_list("brand")).alias("b"))  # one order's brands
        pairs = sets.select("freq", "trial", "t_idx", F.posexplode("b").alias("i", "src"), "b")
        pairs = pairs.select("freq", "trial", "t_idx", "src", F.explode(F.slice("b", F.col("i") + 2, F.greatest(F.size("b"), F.lit(1)))).alias("dst"))
        return pairs.groupBy("freq", "trial", "t_idx", "src", "dst").agg(F.count("*").cast("double").alias("weight"))

    @cached_property
    def frames(self) -> DataFrame:
        """Binary-graph frames: edges of weight 2 or more, by flag and month."""
        return self.edge.filter("weight >= 2")

    @cached_property
    def sides(self) -> DataFrame:
        """Both orientations of the frames."""
        from ..operators.graph import both_sides

        return both_sides(self.frames)


#: The same lifts in SQL, by name; a query takes those it mentions.
SQL = {
    "cells": "SELECT CAST(user_id % 10 AS BIGINT) AS node, event_type AS freq, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS trial, CAST(hour(ts) AS BIGINT) AS t_idx, round(sum(value), 4) AS value FROM events GROUP BY 1, 2, 3, 4",
    "sig": "SELECT n.node, f.freq, d.trial, h.t_idx, coalesce(c.value, 0.0) AS value FROM (SELECT DISTINCT node FROM cells) n CROSS JOIN (SELECT DISTINCT freq FROM cells) f CROSS JOIN (SELECT DISTINCT trial FROM cells) d CROSS JOIN (SELECT CAST(unnest(range(24)) AS BIGINT) AS t_idx) h LEFT JOIN cells c ON c.node = n.node AND c.freq = f.freq AND c.trial = d.trial AND c.t_idx = h.t_idx",
    "trials": "SELECT DISTINCT trial, trial % 5 + 1 AS stim, trial % 2 + 1 AS trial_type, CAST(trial % 3 > 0 AS BIGINT) AS response, 18 + trial % 4 AS t_match FROM cells",
    "staged": "SELECT *, CASE WHEN t_idx >= 18 THEN 'match' WHEN t_idx >= 12 THEN 'delay' WHEN t_idx >= 6 THEN 'cue' ELSE 'baseline' END AS stage FROM sig",
    "epochs": "SELECT * FROM (VALUES ('P', 0, 5), ('S', 5, 9), ('D1', 9, 13), ('D2', 12, 17), ('Dm', 15, 20)) AS e(epoch, t0, t1)",
    "thr": "SELECT node, freq, quantile_cont(value, 0.9) AS thr FROM sig GROUP BY 1, 2",
    "act": "SELECT s.node, s.freq, s.trial, s.t_idx, s.value, CAST(s.value >= t.thr AND s.value > 0 AS BIGINT) AS active FROM sig s JOIN thr t ON s.node = t.node AND s.freq = t.freq",
    "com": "SELECT CAST(s_nationkey AS BIGINT) AS node, CAST(n_regionkey AS BIGINT) AS region, l_returnflag AS freq, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS BIGINT) AS trial, CAST(day(l_shipdate) - 1 AS BIGINT) AS t_idx, round(sum(l_extendedprice * (1 - l_discount)), 4) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3, 4, 5",
    "ob": "SELECT DISTINCT l_orderkey AS ok, l_returnflag AS freq, CAST(year(o_orderdate) - 1995 AS BIGINT) AS trial, CAST(month(o_orderdate) - 1 AS BIGINT) AS t_idx, p_brand AS brand FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey",
    "edge": "SELECT a.freq, a.trial, a.t_idx, a.brand AS src, b.brand AS dst, CAST(count(*) AS DOUBLE) AS weight FROM ob a JOIN ob b ON a.ok = b.ok AND a.freq = b.freq AND a.trial = b.trial AND a.t_idx = b.t_idx AND a.brand < b.brand GROUP BY 1, 2, 3, 4, 5",
    "frames": "SELECT * FROM edge WHERE weight >= 2",
    "sides": "SELECT freq, trial, t_idx, src, dst, weight FROM frames UNION ALL SELECT freq, trial, t_idx, dst AS src, src AS dst, weight FROM frames",
}

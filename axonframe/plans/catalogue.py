"""Queries on stage masks, derived signals, ordering, labels and generated ground truth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import spectral as P
from ..operators import timewin as W
from ..sources.checks import check_values
from ..sources.lifts import Tables
from .networks import Z
from .registry import query

#: Last hour of the early delay.
EARLY = 15


@query("stage_mask_by_trial", "J11 A15", "trial:long stage:string n:long first:long last:long mean:double",
       """SELECT trial, CASE WHEN t_idx < 6 THEN 'baseline' WHEN t_idx < 12 THEN 'cue' WHEN t_idx < 15 THEN 'early delay' WHEN t_idx < t_match THEN 'late delay' ELSE 'match' END AS stage,
       count(*) AS n, min(t_idx) AS "first", max(t_idx) AS "last", avg(value) AS mean FROM sig JOIN trials USING (trial) GROUP BY 1, 2""")  # fmt: skip
def _(t: Tables):
    """Stages by each trial's own onsets: the trial dimension joins by key, so that no range
    join is needed."""
    at = F.col("t_idx")
    stage = F.when(at < 6, "baseline").when(at < 12, "cue").when(at < EARLY, "early delay").when(at < F.col("t_match"), "late delay").otherwise("match")
    j = t.sig.join(F.broadcast(t.trials), "trial").withColumn("stage", stage)
    return j.groupBy("trial", "stage").agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"), F.avg("value").alias("mean"))


@query("degree_stream", "IO11", "node:long freq:string trial:long t_idx:long degree:double",
       f"""WITH {Z}, s AS (SELECT freq, trial, t_idx, sum(z) AS total FROM z WHERE t_idx % 4 = 0 GROUP BY 1, 2, 3)
       SELECT node, freq, trial, t_idx, z * (total - z) AS degree FROM z JOIN s USING (freq, trial, t_idx) WHERE z IS NOT NULL""")  # fmt: skip
def _(t: Tables):
    """Sum of a node's envelope products with all others at every fourth sample: its own
    value times what the frame's total leaves, so that no pairs are formed."""
    s = W.zscore(t.sig).filter("t_idx % 4 = 0 and z is not null")
    rest = F.sum("z").over(Window.partitionBy("freq", "trial", "t_idx")) - F.col("z")
    return s.withColumn("degree", F.col("z") * rest)


@query("burst_probability", "IO13 B25", "node:long freq:string t_idx:long p:double", "SELECT node, freq, t_idx, avg(active) AS p FROM act GROUP BY 1, 2, 3")
def _(t: Tables):
    return t.act.groupBy("node", "freq", "t_idx").agg(F.avg("active").alias("p"))


@query("burst_probability_by_stimulus", "IO13", "node:long freq:string stim:long t_idx:long p:double",
       "SELECT node, freq, stim, t_idx, avg(active) AS p FROM act JOIN trials USING (trial) GROUP BY 1, 2, 3, 4")
def _(t: Tables):
    return t.act.join(F.broadcast(t.trials), "trial").groupBy("node", "freq", "stim", "t_idx").agg(F.avg("active").alias("p"))


@query("order_by_region", "S1 W18", "region:long node:long total:double place:long rank_in_region:long",
       """WITH n AS (SELECT region, node, round(sum(value), 2) AS total FROM com GROUP BY 1, 2)
       SELECT *, row_number() OVER (ORDER BY region, node) AS place, rank() OVER (PARTITION BY region ORDER BY total DESC) AS rank_in_region FROM n""")  # fmt: skip
def _(t: Tables):
    """Nodes' places when ordered by region. The ordering runs over one row a node."""
    n = t.com.groupBy("region", "node").agg(F.round(F.sum("value"), 2).alias("total"))  # totals of 2e8 hold no more places
    by_total = Window.partitionBy("region").orderBy(F.desc("total"))
    return n.withColumn("place", F.row_number().over(Window.orderBy("region", "node"))).withColumn("rank_in_region", F.rank().over(by_total))


@query("selectors_joined", "U4 F2", "node:long freq:string n:long mean:double",
       "SELECT node, freq, count(*) AS n, avg(value) AS mean FROM sig JOIN trials USING (trial) WHERE (trial_type = 1 AND response = 1) OR stim IN (2, 4) GROUP BY 1, 2")
def _(t: Tables):
    stimuli = [2, 4]
    check_values(stimuli, range(1, 6), "stim")
    keep = ((F.col("trial_type") == 1) & (F.col("response") == 1)) | F.col("stim").isin(stimuli)
    return t.sig.join(F.broadcast(t.trials.filter(keep)), "trial").groupBy("node", "freq").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


@query("activity_rollup", "A29", "node:long freq:string level:long total:double n:long",
       "SELECT node, freq, GROUPING_ID(node, freq) AS level, sum(value) AS total, count(*) AS n FROM cells GROUP BY ROLLUP (node, freq)")
def _(t: Tables):
    return t.cells.rollup("node", "freq").agg(F.grouping_id().alias("level"), F.sum("value").alias("total"), F.count("*").alias("n"))


@query("label_prefix", "C4", "prefix:string n:long price:double", "SELECT split_part(p_brand, '#', 2)[1:1] AS prefix, count(*) AS n, avg(p_retailprice) AS price FROM part GROUP BY 1")
def _(t: Tables):
    prefix = F.substring(F.split_part("p_brand", F.lit("#"), F.lit(2)), 1, 1)
    return t.table("part").groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("price"))


@query("event_properties", "C24", "event_type:string k:long n:long last_day:string",
       "SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events GROUP BY 1, 2")
def _(t: Tables):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.table("events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"))


@query("flattened_neighbours", "C23", "freq:string trial:long node:string n:long different:long",
       "SELECT freq, trial, src AS node, count(*) AS n, count(DISTINCT dst) AS different FROM sides GROUP BY 1, 2, 3")
def _(t: Tables):
    """A node's neighbours, listed a frame and then flattened over a trial's frames; each
    list is bounded by the number of nodes, and there is one a frame."""
    lists = t.sides.groupBy("freq", "trial", "t_idx", F.col("src").alias("node")).agg(F.collect_list("dst").alias("near"))
    flat = lists.groupBy("freq", "trial", "node").agg(F.flatten(F.collect_list("near")).alias("near"))
    return flat.withColumn("n", F.size("near")).withColumn("different", F.size(F.array_distinct("near")))


@query("coupled_pair", "K33 K6", "window:long freq:double coherence:double")
def _(t: Tables):
    """Ground truth: a driven pair whose coupling ends half way; mean coherence of each half
    over 32 generated trials. A trial's seed is its number, so tasks may run again."""
    n, fs = 512, 128.0

    def generate(batches):
        for pdf in batches:
            for trial in pdf["id"]:
                x = P.autoregressive_pair(n, fs, 0.6, n / fs / 2, int(trial))
                half = np.split(x, 2, axis=1)
                yield pd.DataFrame({"trial": trial, "window": [0, 0, 1, 1], "node": [0, 1, 0, 1], "signal": [half[w][c] for w in (0, 1) for c in (0, 1)]})

    signals = t.spark.range(32).mapInPandas(generate, "trial long, window long, node long, signal array<double>")
    tf = P.time_frequency(signals, ["trial", "window", "node"], fs, [20.0, 28.0])
    return P.coherence(tf, ["trial", "window", "freq"], "node").groupBy("window", "freq").agg(F.avg("coherence").alias("coherence"))

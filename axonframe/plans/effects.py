"""Effects and filters: subcortical nodes and meta-edges, masked statistics, modulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resample as R
from ..operators import stats as T
from ..sources.lifts import Tables
from .networks import _KS, _TWO, _groups
from .registry import query

DROP = ["Brand#11", "Brand#55"]
_DROP = "('Brand#11', 'Brand#55')"
_PAIRS = "u AS (SELECT DISTINCT freq, src, dst FROM edge), m AS (SELECT a.freq, a.src AS a1, a.dst AS a2, b.src AS b1, b.dst AS b2 FROM u a JOIN u b ON a.freq = b.freq AND (a.src, a.dst) < (b.src, b.dst))"


def _meta_edges(t: Tables):
    """Pairs of different edges of a network."""
    e = t.edge.select("freq", "src", "dst").distinct()
    a = e.select("freq", F.col("src").alias("a1"), F.col("dst").alias("a2"))
    b = e.select("freq", F.col("src").alias("b1"), F.col("dst").alias("b2"))
    return a.join(b, "freq").filter(F.struct("a1", "a2") < F.struct("b1", "b2"))


@query("meta_edges_disjoint", "F16", "freq:string a1:string a2:string n:long",
       f"WITH {_PAIRS} SELECT freq, a1, a2, count(*) AS n FROM m WHERE a1 <> b1 AND a1 <> b2 AND a2 <> b1 AND a2 <> b2 GROUP BY 1, 2, 3")
def _(t: Tables):
    m = _meta_edges(t).filter("a1 <> b1 and a1 <> b2 and a2 <> b1 and a2 <> b2")
    return m.groupBy("freq", "a1", "a2").agg(F.count("*").alias("n"))


@query("drop_subset_nodes", "F18", "freq:string node:string total:double",
       f"SELECT freq, src AS node, sum(weight) AS total FROM sides WHERE src NOT IN {_DROP} GROUP BY 1, 2")
def _(t: Tables):
    return t.sides.filter(~F.col("src").isin(DROP)).groupBy("freq", F.col("src").alias("node")).agg(F.sum("weight").alias("total"))


@query("drop_subset_meta_edges", "F19", "freq:string a1:string a2:string n:long",
       f"WITH {_PAIRS} SELECT freq, a1, a2, count(*) AS n FROM m WHERE a1 NOT IN {_DROP} AND a2 NOT IN {_DROP} AND b1 NOT IN {_DROP} AND b2 NOT IN {_DROP} GROUP BY 1, 2, 3")
def _(t: Tables):
    m = _meta_edges(t)
    for c in ("a1", "a2", "b1", "b2"):
        m = m.filter(~F.col(c).isin(DROP))
    return m.groupBy("freq", "a1", "a2").agg(F.count("*").alias("n"))


@query("drop_subset_channels", "F20", "freq:string channel:string total:double",
       f"SELECT freq, channel, sum(weight) AS total FROM (SELECT freq, src || ' ' || t_idx AS channel, weight FROM sides) WHERE split_part(channel, ' ', 1) NOT IN {_DROP} GROUP BY 1, 2")
def _(t: Tables):
    c = t.sides.select("freq", F.concat_ws(" ", "src", "t_idx").alias("channel"), "weight")
    return c.filter(~F.split("channel", " ")[0].isin(DROP)).groupBy("freq", "channel").agg(F.sum("weight").alias("total"))


@query("any_in_subset", "F21", "freq:string hit:long n:long",
       f"SELECT freq, CAST(len(list_filter([src, dst], lambda x: x IN {_DROP})) > 0 AS BIGINT) AS hit, count(*) AS n FROM edge GROUP BY 1, 2")
def _(t: Tables):
    hit = F.exists(F.array("src", "dst"), lambda x: x.isin(DROP)).cast("long")
    return t.edge.groupBy("freq", hit.alias("hit")).agg(F.count("*").alias("n"))


@query("masked_effects", "I19", "node:long freq:string effect:double",
       f"""WITH tw AS ({_TWO}), {_KS}, m AS (SELECT node, freq, avg(value) FILTER (WHERE g = 0) AS m0, avg(value) FILTER (WHERE g = 1) AS m1, var_samp(value) FILTER (WHERE g = 0) AS v0, var_samp(value) FILTER (WHERE g = 1) AS v1, count(*) FILTER (WHERE g = 0) AS n0, count(*) FILTER (WHERE g = 1) AS n1 FROM tw GROUP BY 1, 2)
       SELECT node, freq, CASE WHEN p <= 0.05 THEN (m1 - m0) / nullif(sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1)), 0) ELSE 0 END AS effect FROM m JOIN kp USING (node, freq)""")  # fmt: skip
def _(t: Tables):
    """t where its p is significant, else 0."""
    by = ["node", "freq"]
    both = T.t_statistic(_groups(t), by, "g").join(T.ks_statistic(_groups(t), by, "g"), by)
    return both.withColumn("effect", F.when(F.col("p") <= 0.05, F.col("t")).otherwise(F.lit(0.0)))


def _ks_by(keys: str) -> str:
    """The KS tables with ``keys`` for node and freq."""
    return _KS.replace("SELECT node, freq,", f"SELECT {keys},").replace("PARTITION BY node, freq", f"PARTITION BY {keys}").replace("GROUP BY 1, 2", f"GROUP BY {keys}")


@query("effects_by_stage", "I20", "freq:string stage:string n:long",
       f"WITH tw AS (SELECT node, freq, stage, value, CAST(trial % 2 = 1 AS BIGINT) AS g FROM staged), {_ks_by('node, freq, stage')} SELECT freq, stage, count(*) FILTER (WHERE p <= 0.05) AS n FROM kp GROUP BY 1, 2")
def _(t: Tables):
    """Number of nodes with a significant difference, by band and stage."""
    stage = F.when(F.col("t_idx") >= 18, "match").when(F.col("t_idx") >= 12, "delay").when(F.col("t_idx") >= 6, "cue").otherwise("baseline")
    p = T.ks_statistic(_groups(t).withColumn("stage", stage), ["node", "freq", "stage"], "g")
    return p.groupBy("freq", "stage").agg(F.sum((F.col("p") <= 0.05).cast("long")).alias("n"))


@query("stimulus_pair_index", "I21", "node:long freq:string psi:double",
       f"""WITH s AS (SELECT node, freq, value, stim FROM sig JOIN trials USING (trial)), x AS (SELECT DISTINCT stim FROM trials), pr AS (SELECT a.stim AS a, b.stim AS b FROM x a JOIN x b ON a.stim < b.stim),
       tw AS (SELECT node, freq, a AS sa, b AS sb, value, CAST(stim = b AS BIGINT) AS g FROM s JOIN pr ON stim = a OR stim = b), {_ks_by('node, freq, sa, sb')} SELECT node, freq, 100 * avg(CAST(p < 0.01 AS DOUBLE)) AS psi FROM kp GROUP BY 1, 2""")  # fmt: skip
def _(t: Tables):
    """Share (%) of the pairs of stimuli that a node tells apart."""
    stims = t.trials.select("stim").distinct()
    pairs = stims.alias("a").join(stims.alias("b"), F.col("a.stim") < F.col("b.stim")).select(F.col("a.stim").alias("sa"), F.col("b.stim").alias("sb"))
    # A sample goes to the pairs that its stimulus is in: a join on the stimulus.
    of = pairs.select(F.col("sa").alias("stim"), "sa", "sb", F.lit(0).cast("long").alias("g")).unionByName(pairs.select(F.col("sb").alias("stim"), "sa", "sb", F.lit(1).cast("long").alias("g")))
    s = t.sig.join(F.broadcast(t.trials.select("trial", "stim")), "trial").join(F.broadcast(of), "stim")
    p = T.ks_statistic(s, ["node", "freq", "sa", "sb"], "g")
    return p.groupBy("node", "freq").agg((100 * F.avg((F.col("p") < 0.01).cast("double"))).alias("psi"))


@query("rate_modulation_index", "B26", "node:long freq:string rmi:double")
def _(t: Tables):
    """Share of times and stimuli at which the median of a stimulus' bootstrapped rates lies
    outside the 5 to 95 % band of those of all trials."""
    by = ["node", "freq", "t_idx"]
    band = R.percentile_interval(R.bootstrap_means(t.act, by, "trial", 100, 21, value="active"), by, 0.9).drop("mid")
    of = t.act.join(F.broadcast(t.trials.select("trial", "stim")), "trial")
    rate = R.percentile_interval(R.bootstrap_means(of, [*by, "stim"], "trial", 100, 22, value="active"), [*by, "stim"]).select(*by, "stim", "mid")
    out = (F.col("mid") > F.col("high")) | (F.col("mid") < F.col("low"))
    return rate.join(band, by).groupBy("node", "freq").agg(F.avg(out.cast("double")).alias("rmi"))

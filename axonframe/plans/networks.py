"""Queries on pairs, avalanches, graphs and information."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregate as A
from ..operators import avalanche as V
from ..operators import graph as G
from ..operators import info as I
from ..operators import pairs as P
from ..operators import stats as T
from ..operators import timewin as W
from ..sources.lifts import Tables, stage_of
from .registry import query

FRAME = ["freq", "trial", "t_idx"]
Z = "z AS (SELECT node, freq, trial, t_idx, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z FROM sig WINDOW w AS (PARTITION BY node, freq, trial))"


def corr_sql(x: str, y: str) -> str:
    """Pearson's r from averages, 0 where undefined."""
    vx, vy = f"(avg({x} * {x}) - avg({x}) * avg({x}))", f"(avg({y} * {y}) - avg({y}) * avg({y}))"
    return f"CASE WHEN {vx} > 1e-12 AND {vy} > 1e-12 THEN (avg({x} * {y}) - avg({x}) * avg({y})) / sqrt(greatest({vx}, 0) * greatest({vy}, 0)) ELSE 0 END"


@query("pairwise_pearson", "A19 A20 J2", "freq:string src:long dst:long r:double",
       f"SELECT a.freq, a.node AS src, b.node AS dst, {corr_sql('a.value', 'b.value')} AS r FROM sig a JOIN sig b ON a.freq = b.freq AND a.trial = b.trial AND a.t_idx = b.t_idx AND a.node < b.node GROUP BY 1, 2, 3")
def _(t: Tables):
    return P.pearson(t.sig, FRAME, ["freq"])


@query("power_envelope_correlation", "K8 K9 K10 W9 C19", "freq:string trial:long src:long dst:long pec:double",
       f"WITH {Z} SELECT a.freq, a.trial, a.node AS src, b.node AS dst, avg(a.z * b.z) AS pec FROM z a JOIN z b ON a.freq = b.freq AND a.trial = b.trial AND a.t_idx = b.t_idx AND a.node < b.node GROUP BY 1, 2, 3, 4")
def _(t: Tables):
    return P.products(W.zscore(t.sig), FRAME, "z").groupBy("freq", "trial", "src", "dst").agg(F.avg("value").alias("pec"))


@query("windowed_product_mean", "W9 A14", "freq:string trial:long src:long dst:long win:long fc:double",
       "SELECT a.freq, a.trial, a.node AS src, b.node AS dst, a.t_idx // 6 AS win, avg(a.value * b.value) AS fc FROM sig a JOIN sig b ON a.freq = b.freq AND a.trial = b.trial AND a.t_idx = b.t_idx AND a.node < b.node GROUP BY 1, 2, 3, 4, 5")
def _(t: Tables):
    return P.products(t.sig, FRAME).groupBy("freq", "trial", "src", "dst", F.floor(F.col("t_idx") / 6).alias("win")).agg(F.avg("value").alias("fc"))


@query("degree_excl", "K11 F14 F15", "trial:long freq:string area:string degree:double",
       """SELECT trial, freq, area, sum(weight) AS degree FROM (SELECT trial, freq, left(src, 7) AS area, weight FROM frames WHERE left(src, 7) <> left(dst, 7) UNION ALL SELECT trial, freq, left(dst, 7), weight FROM frames WHERE left(src, 7) <> left(dst, 7)) GROUP BY 1, 2, 3""")  # fmt: skip
def _(t: Tables):
    return P.degree(t.frames, ["trial", "freq"], "weight", lambda c: F.left(c, F.lit(7)))


@query("degree_incl", "K12 K39 A31", "trial:long freq:string area:string degree:double",
       """SELECT trial, freq, area, sum(weight) AS degree FROM (SELECT trial, freq, left(src, 7) AS area, weight FROM frames UNION ALL SELECT trial, freq, left(dst, 7), weight FROM frames WHERE left(src, 7) <> left(dst, 7)) GROUP BY 1, 2, 3""")  # fmt: skip
def _(t: Tables):
    return P.degree(t.frames, ["trial", "freq"], "weight", lambda c: F.left(c, F.lit(7)), same_once=True)


@query("region_block_mean", "A27", "freq:string same:long mean:double",
       """WITH r AS (SELECT freq, left(src, 7) AS a, left(dst, 7) AS b, avg(weight) AS m FROM edge GROUP BY 1, 2, 3) SELECT freq, CAST(a = b AS BIGINT) AS same, avg(m) AS mean FROM r GROUP BY 1, 2""")  # fmt: skip
def _(t: Tables):
    block = t.edge.groupBy("freq", F.left("src", F.lit(7)).alias("a"), F.left("dst", F.lit(7)).alias("b")).agg(F.avg("weight").alias("m"))
    return block.groupBy("freq", (F.col("a") == F.col("b")).cast("long").alias("same")).agg(F.avg("m").alias("mean"))


@query("drop_subset_edges", "F17", "freq:string n:long total:double",
       "SELECT freq, count(*) AS n, sum(weight) AS total FROM edge WHERE src NOT IN ('Brand#11', 'Brand#55') AND dst NOT IN ('Brand#11', 'Brand#55') GROUP BY 1")
def _(t: Tables):
    drop = ["Brand#11", "Brand#55"]
    return t.edge.filter(~F.col("src").isin(drop) & ~F.col("dst").isin(drop)).groupBy("freq").agg(F.count("*").alias("n"), F.sum("weight").alias("total"))


@query("stream_to_matrix", "K13 D7 F24 F25 F26 F28", "freq:string trial:long t_idx:long src:string dst:string weight:double", "SELECT * FROM sides")
def _(t: Tables):
    return t.sides


@query("significance_floor", "K29 K30", "freq:string src:string dst:string n:long excess:double",
       """WITH q AS (SELECT freq, quantile_cont(weight, 0.95) AS thr FROM edge GROUP BY 1) SELECT freq, src, dst, count(*) AS n, sum(greatest(weight - thr, 0)) AS excess FROM edge JOIN q USING (freq) GROUP BY 1, 2, 3""")  # fmt: skip
def _(t: Tables):
    thr = A.quantile(t.edge, ["freq"], 0.95, value="weight")
    return P.significance_floor(t.edge.withColumn("value", F.col("weight")), thr, ["freq"]).groupBy("freq", "src", "dst").agg(F.count("*").alias("n"), F.sum("value").alias("excess"))


_META = f"""d AS (SELECT a.freq, a.trial, a.t_idx, a.node || '~' || b.node AS e, a.value * b.value AS v FROM sig a JOIN sig b ON a.freq = b.freq AND a.trial = b.trial AND a.t_idx = b.t_idx AND a.node < b.node),
       mc AS (SELECT a.freq, a.e AS edge_a, b.e AS edge_b, {corr_sql('a.v', 'b.v')} AS mc FROM d a JOIN d b ON a.freq = b.freq AND a.trial = b.trial AND a.t_idx = b.t_idx AND a.e <= b.e GROUP BY 1, 2, 3)"""


def _meta(t: Tables):
    return P.meta_connectivity(P.products(t.sig, FRAME), FRAME, ["freq"])


@query("meta_connectivity", "K14 K15 J13 D13", "freq:string edge_a:string edge_b:string mc:double", f"WITH {_META} SELECT * FROM mc")
def _(t: Tables):
    return _meta(t)


@query("entanglement", "K16", "freq:string edge:string entanglement:double",
       f"WITH {_META} SELECT freq, edge, sum(mc) AS entanglement FROM (SELECT freq, edge_a AS edge, mc FROM mc UNION ALL SELECT freq, edge_b, mc FROM mc WHERE edge_a <> edge_b) GROUP BY 1, 2")
def _(t: Tables):
    return P.entanglement(_meta(t), ["freq"])


@query("trimer_strength", "K17 K18 K19", "freq:string node:long strength:double",
       f"""WITH {_META}, n AS (SELECT DISTINCT CAST(node AS VARCHAR) AS node FROM sig) SELECT freq, CAST(node AS BIGINT) AS node, sum(mc) AS strength FROM mc JOIN n ON node IN (split_part(edge_a, '~', 1), split_part(edge_a, '~', 2)) AND node IN (split_part(edge_b, '~', 1), split_part(edge_b, '~', 2)) WHERE edge_a < edge_b GROUP BY 1, 2""")
def _(t: Tables):
    return P.trimer_strength(_meta(t), ["freq"])


@query("meta_connectivity_all_nodes", "K14 K15 J13 D13", "freq:string edge_a:string edge_b:string mc:double")
def _(t: Tables):
    return _meta(t)


@query("entanglement_all_nodes", "K16", "freq:string edge:string entanglement:double")
def _(t: Tables):
    return P.entanglement(_meta(t), ["freq"])


@query("trimer_strength_all_nodes", "K17 K18 K19", "freq:string node:long strength:double")
def _(t: Tables):
    return P.trimer_strength(_meta(t), ["freq"])


_DIFF = "d AS (SELECT * FROM (SELECT node, freq, trial, t_idx, value - lag(value) OVER (PARTITION BY node, freq, trial ORDER BY t_idx) AS diff FROM sig) WHERE diff IS NOT NULL)"


@query("nonlinear_index", "K20 K22 J1 J3", "freq:string src:long dst:long nli:double",
       f"""WITH {_DIFF}, p AS (SELECT a.freq, a.trial, a.t_idx, a.node AS src, b.node AS dst, a.value * b.value AS v FROM sig a JOIN sig b ON a.freq = b.freq AND a.trial = b.trial AND a.t_idx = b.t_idx AND a.node < b.node),
       e AS (SELECT * FROM (SELECT *, v - lag(v) OVER (PARTITION BY freq, trial, src, dst ORDER BY t_idx) AS g FROM p) WHERE g IS NOT NULL)
       SELECT e.freq, e.src, e.dst, avg(CAST(x.diff > 0 AND y.diff > 0 AND g > 0 AS DOUBLE)) + avg(CAST(x.diff < 0 AND y.diff < 0 AND g < 0 AS DOUBLE)) AS nli FROM e JOIN d x ON x.freq = e.freq AND x.trial = e.trial AND x.t_idx = e.t_idx AND x.node = src JOIN d y ON y.freq = e.freq AND y.trial = e.trial AND y.t_idx = e.t_idx AND y.node = dst GROUP BY 1, 2, 3""")  # fmt: skip
def _(t: Tables):
    edges = W.difference(P.products(t.sig, FRAME), ["freq", "trial", "src", "dst"])
    return P.nonlinear_index(W.difference(t.sig), edges.drop("value"), FRAME, ["freq"])


@query("nonlinear_index_thresholded", "K21 A23", "freq:string src:long dst:long share:double given_src:double",
       "SELECT a.freq, a.node AS src, b.node AS dst, avg(CAST(a.active = 1 AND b.active = 1 AS DOUBLE)) AS share, sum(a.active * b.active) / nullif(sum(a.active), 0) AS given_src FROM act a JOIN act b ON a.freq = b.freq AND a.trial = b.trial AND a.t_idx = b.t_idx AND a.node < b.node GROUP BY 1, 2, 3")
def _(t: Tables):
    p = P.pair_up(t.act, FRAME, "active")
    both = F.col("x") * F.col("y")
    return p.groupBy("freq", "src", "dst").agg(F.avg(both.cast("double")).alias("share"), S.sdiv(F.sum(both), F.sum("x")).alias("given_src"))


@query("co_crackle", "B9 B10 B11 D12", "freq:string src:long dst:long k:double",
       "SELECT a.freq, a.node AS src, b.node AS dst, count(*) / 720.0 AS k FROM act a JOIN act b ON a.freq = b.freq AND a.trial = b.trial AND a.t_idx = b.t_idx AND a.node <= b.node WHERE a.active = 1 AND b.active = 1 GROUP BY 1, 2, 3")
def _(t: Tables):
    return P.co_activity(t.act, FRAME, ["freq"], 720)


@query("co_crackle_strength", "B20 IO12", "freq:string node:long strength:double",
       """WITH k AS (SELECT a.freq, a.node AS src, b.node AS dst, count(*) / 720.0 AS k FROM act a JOIN act b ON a.freq = b.freq AND a.trial = b.trial AND a.t_idx = b.t_idx AND a.node <> b.node WHERE a.active = 1 AND b.active = 1 GROUP BY 1, 2, 3) SELECT freq, src AS node, sum(k) AS strength FROM k GROUP BY 1, 2""")  # fmt: skip
def _(t: Tables):
    k = P.co_activity(t.act, FRAME, ["freq"], 720).filter("src <> dst")
    return k.withColumn("node", F.explode(F.array("src", "dst"))).groupBy("freq", "node").agg(F.sum("k").alias("strength"))


@query("hamming_overlap", "C20 C25", "freq:string src:long dst:long hamming:double overlap:double",
       "SELECT a.freq, a.node AS src, b.node AS dst, avg(CAST(a.active <> b.active AS DOUBLE)) AS hamming, coalesce(sum(a.active * b.active) / nullif(least(sum(a.active), sum(b.active)), 0), 0) AS overlap FROM act a JOIN act b ON a.freq = b.freq AND a.trial = b.trial AND a.t_idx = b.t_idx AND a.node < b.node GROUP BY 1, 2, 3")
def _(t: Tables):
    return P.overlap(P.pair_up(t.act, FRAME, "active"), ["freq"])


@query("ghost_code", "K28", "freq:string code:double n:long",
       "SELECT a.freq, c * (a.active + b.active) + c - (1 - c) * CAST(a.active + b.active = 2 AS BIGINT) AS code, count(*) AS n FROM (SELECT *, CAST(value > 60 AS BIGINT) AS c FROM act) a JOIN act b ON a.freq = b.freq AND a.trial = b.trial AND a.t_idx = b.t_idx AND a.node < b.node GROUP BY 1, 2")
def _(t: Tables):
    a = t.act.select(*FRAME, F.col("node").alias("src"), F.col("active").alias("x"), (F.col("value") > 60).cast("long").alias("c"))
    b = t.act.select(*FRAME, F.col("node").alias("dst"), F.col("active").alias("y"))
    s = F.col("x") + F.col("y")
    code = F.col("c") * s + F.col("c") - (1 - F.col("c")) * (s == 2).cast("long")
    return a.join(b, FRAME).filter("src < dst").groupBy("freq", code.alias("code")).agg(F.count("*").alias("n"))


# Avalanches

_SUPRA = """su AS (SELECT a.freq, a.trial, a.node AS a_node, a.t_idx AS a_t, b.node AS b_node, a.t_idx AS b_t FROM act a JOIN act b ON a.freq = b.freq AND a.trial = b.trial AND a.t_idx = b.t_idx AND a.node < b.node WHERE a.active = 1 AND b.active = 1 AND a.t_idx < 23
       UNION ALL SELECT a.freq, a.trial, a.node, a.t_idx, b.node, a.t_idx + 1 FROM act a JOIN act b ON a.freq = b.freq AND a.trial = b.trial AND a.t_idx = b.t_idx WHERE a.active = 1 AND b.active = 1 AND a.t_idx < 23)"""
_AVAL = f"""WITH RECURSIVE {_SUPRA},
       un AS (SELECT freq, trial, a_t * 100 + a_node AS u, b_t * 100 + b_node AS v FROM su UNION SELECT freq, trial, b_t * 100 + b_node, a_t * 100 + a_node FROM su),
       reach AS (SELECT DISTINCT freq, trial, u AS v, u AS root FROM un UNION SELECT n.freq, n.trial, n.v, r.root FROM reach r JOIN un n ON n.freq = r.freq AND n.trial = r.trial AND n.u = r.v WHERE r.root < n.v),
       av AS (SELECT freq, trial, v % 100 AS node, v // 100 AS t_idx, min(root) % 100 AS av_node, min(root) // 100 AS av_t FROM reach GROUP BY freq, trial, v)"""
BY = ["freq", "trial"]


def _avalanches(t: Tables):
    return V.avalanches(V.supra_edges(t.act, BY, 23), BY)


@query("supra_edges", "B12 J12 J14", "freq:string trial:long a_node:long a_t:long b_node:long b_t:long", f"WITH {_SUPRA} SELECT * FROM su")
def _(t: Tables):
    return V.supra_edges(t.act, BY, 23)


@query("supra_edges_strict", "B12", "freq:string n:long",
       "SELECT freq, count(*) AS n FROM (SELECT a.freq FROM act a JOIN act b ON a.freq = b.freq AND a.trial = b.trial AND a.t_idx = b.t_idx AND a.node < b.node WHERE a.active = 1 AND b.active = 1 AND a.t_idx < 23 UNION ALL SELECT a.freq FROM act a JOIN act b ON a.freq = b.freq AND a.trial = b.trial AND b.t_idx = a.t_idx + 1 WHERE a.active = 1 AND b.active = 1) GROUP BY 1")
def _(t: Tables):
    return V.supra_edges(t.act, BY, 23, strict=True).groupBy("freq").agg(F.count("*").alias("n"))


@query("avalanches", "B13 B14 D11 IO18", "freq:string trial:long node:long t_idx:long av_t:long av_node:long", f"{_AVAL} SELECT * FROM av")
def _(t: Tables):
    return _avalanches(t)


@query("avalanche_areas", "B15 F29", "freq:string trial:long av_t:long av_node:long areas:long n:long",
       f"{_AVAL} SELECT freq, trial, av_t, av_node, count(DISTINCT node % 5) AS areas, count(*) AS n FROM av GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT node % 5) > 1")
def _(t: Tables):
    kept = V.across_areas(_avalanches(t), BY, F.col("node") % 5)
    return kept.groupBy(*BY, "av_t", "av_node").agg(F.count_distinct("area").alias("areas"), F.count("*").alias("n"))


@query("coavalanche", "B16 B18", "freq:string src:long dst:long t:double p:double",
       f"""{_AVAL}, f AS (SELECT freq, trial, av_t, av_node, node, min(t_idx) AS t0 FROM av GROUP BY 1, 2, 3, 4, 5), tot AS (SELECT freq, count(*) AS total FROM (SELECT DISTINCT freq, trial, av_t, av_node FROM f) GROUP BY 1)
       SELECT a.freq, a.node AS src, b.node AS dst, count(*) / any_value(total) AS t, sum(CAST(a.t0 < b.t0 AS BIGINT)) / any_value(total) AS p FROM f a JOIN f b ON a.freq = b.freq AND a.trial = b.trial AND a.av_t = b.av_t AND a.av_node = b.av_node AND a.node <> b.node JOIN tot ON tot.freq = a.freq GROUP BY 1, 2, 3""")  # fmt: skip
def _(t: Tables):
    return V.coavalanche(_avalanches(t).withColumn("area", F.col("node")), ["freq"], ["trial"])


@query("coavalanche_per_trial", "B17", "freq:string trial:long src:long dst:long t:double p:double",
       f"""{_AVAL}, f AS (SELECT freq, trial, av_t, av_node, node, min(t_idx) AS t0 FROM av GROUP BY 1, 2, 3, 4, 5), tot AS (SELECT freq, trial, count(*) AS total FROM (SELECT DISTINCT freq, trial, av_t, av_node FROM f) GROUP BY 1, 2)
       SELECT a.freq, a.trial, a.node AS src, b.node AS dst, count(*) / any_value(total) AS t, sum(CAST(a.t0 < b.t0 AS BIGINT)) / any_value(total) AS p FROM f a JOIN f b ON a.freq = b.freq AND a.trial = b.trial AND a.av_t = b.av_t AND a.av_node = b.av_node AND a.node <> b.node JOIN tot ON tot.freq = a.freq AND tot.trial = a.trial GROUP BY 1, 2, 3, 4""")  # fmt: skip
def _(t: Tables):
    return V.coavalanche(_avalanches(t).withColumn("area", F.col("node")), BY, [])


_SIZES = f"""{_AVAL}, fr AS (SELECT freq, trial, av_t, av_node, t_idx, count(*) AS n FROM av GROUP BY 1, 2, 3, 4, 5), ra AS (SELECT *, lead(n) OVER (PARTITION BY freq, trial, av_t, av_node ORDER BY t_idx) / n AS ratio FROM fr),
       sz AS (SELECT freq, trial, av_t, av_node, sum(n) AS size, max(t_idx) - min(t_idx) + 1 AS duration, avg(ratio) AS branching FROM ra GROUP BY 1, 2, 3, 4)"""


def _sizes(t: Tables):
    return V.sizes(_avalanches(t), [*BY, "av_t", "av_node"])


@query("avalanche_sizes", "B21", "freq:string trial:long av_t:long av_node:long size:long duration:long branching:double", f"{_SIZES} SELECT * FROM sz")
def _(t: Tables):
    return _sizes(t)


@query("criticality_slopes", "B22", "freq:string slope:double intercept:double",
       f"{_SIZES}, h AS (SELECT freq, ln(size) AS x, ln(count(*)) AS y FROM sz GROUP BY freq, size) SELECT freq, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM h GROUP BY 1")
def _(t: Tables):
    h = _sizes(t).groupBy("freq", "size").agg(F.count("*").alias("n")).select("freq", F.ln("size").alias("x"), F.ln("n").alias("y"))
    return A.fitted_line(h, ["freq"], "y", "x")


@query("size_duration_spearman", "B22", "freq:string rho:double",
       f"{_SIZES}, k AS (SELECT freq, rank() OVER (PARTITION BY freq ORDER BY size) + (count(*) OVER (PARTITION BY freq, size) - 1) / 2.0 AS a, rank() OVER (PARTITION BY freq ORDER BY duration) + (count(*) OVER (PARTITION BY freq, duration) - 1) / 2.0 AS b FROM sz) SELECT freq, {corr_sql('a', 'b')} AS rho FROM k GROUP BY 1")
def _(t: Tables):
    return T.spearman(_sizes(t), ["freq"], "size", "duration")


_POP = """rho AS (SELECT freq, trial, t_idx, sum(active) AS rho FROM act GROUP BY 1, 2, 3), qq AS (SELECT freq, trial, quantile_cont(rho, 0.7) AS q FROM rho GROUP BY 1, 2),
       hi AS (SELECT rho.freq, rho.trial, rho.t_idx, rho.t_idx - row_number() OVER (PARTITION BY rho.freq, rho.trial ORDER BY rho.t_idx) AS i FROM rho JOIN qq ON rho.freq = qq.freq AND rho.trial = qq.trial WHERE rho >= q AND rho > 0),
       ru AS (SELECT freq, trial, i, min(t_idx) AS s, max(t_idx) + 1 AS e, count(*) AS len FROM hi GROUP BY 1, 2, 3)"""


@query("population_runs", "W14", "freq:string trial:long start:long end:long len:long", f'WITH {_POP} SELECT freq, trial, s AS "start", e AS "end", len FROM ru')
def _(t: Tables):
    return V.population_runs(t.act, BY, 0.7)


@query("graphlets", "B23", "freq:string trial:long start:long src:long dst:long k:double",
       f"""WITH {_POP} SELECT a.freq, a.trial, s AS "start", a.node AS src, b.node AS dst, count(*) / any_value(CAST(len AS DOUBLE)) AS k FROM ru JOIN act a ON a.freq = ru.freq AND a.trial = ru.trial AND a.t_idx >= s AND a.t_idx < e JOIN act b ON b.freq = a.freq AND b.trial = a.trial AND b.t_idx = a.t_idx AND a.node < b.node WHERE a.active = 1 AND b.active = 1 GROUP BY 1, 2, 3, 4, 5""")
def _(t: Tables):
    return V.graphlets(t.act, BY, 0.7)


@query("transition_prob", "B24", "src:long dst:long p:double",
       f"""WITH {_POP}, m AS (SELECT ru.freq, ru.trial, s, e, a.t_idx AS t, a.node FROM ru JOIN act a ON a.freq = ru.freq AND a.trial = ru.trial AND a.t_idx >= s AND a.t_idx < e WHERE a.active = 1 AND len > 2), b AS (SELECT node AS src, count(*) AS n FROM m WHERE t < e - 1 GROUP BY 1)
       SELECT x.node AS src, y.node AS dst, count(*) / any_value(CAST(b.n AS DOUBLE)) AS p FROM m x JOIN m y ON x.freq = y.freq AND x.trial = y.trial AND x.s = y.s AND y.t = x.t + 1 JOIN b ON b.src = x.node WHERE x.t < x.e - 1 GROUP BY 1, 2""")  # fmt: skip
def _(t: Tables):
    return V.transitions(t.act, BY, 0.7, 2)


@query("module_region_specificity", "B27", "freq:string module:long specificity:double",
       """WITH c AS (SELECT freq, region % 2 AS module, node AS r, count(*) AS n FROM com GROUP BY 1, 2, 3), s AS (SELECT freq, module, n / sum(n) OVER (PARTITION BY freq, module) AS p, count(*) OVER (PARTITION BY freq, module) AS k FROM c)
       SELECT freq, module, 1 + sum(p * ln(p)) / ln(any_value(CAST(k AS DOUBLE))) AS specificity FROM s GROUP BY 1, 2""")  # fmt: skip
def _(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("freq", "module")
    c = t.com.groupBy("freq", (F.col("region") % 2).alias("module"), "node").agg(F.count("*").alias("n"))
    s = c.withColumn("p", F.col("n") / F.sum("n").over(w)).withColumn("k", F.count("*").over(w).cast("double"))
    return s.groupBy("freq", "module").agg((1 + S.sdiv(F.sum(F.col("p") * F.ln("p")), F.ln(F.first("k")))).alias("specificity"))


# Graphs

GF = "freq:string trial:long t_idx:long"


@query("strength", "G1", f"{GF} node:string degree:long strength:double", "SELECT freq, trial, t_idx, src AS node, count(*) AS degree, sum(weight) AS strength FROM sides GROUP BY 1, 2, 3, 4")
def _(t: Tables):
    return G.strength(t.sides, FRAME)


@query("clustering", "G2", f"{GF} node:string clustering:double",
       """WITH k AS (SELECT freq, trial, t_idx, src AS node, count(*) AS k FROM sides GROUP BY 1, 2, 3, 4),
       tri AS (SELECT a.freq, a.trial, a.t_idx, a.src AS node, count(*) AS tri FROM sides a JOIN sides b ON a.freq = b.freq AND a.trial = b.trial AND a.t_idx = b.t_idx AND a.src = b.src AND a.dst < b.dst JOIN sides c ON c.freq = a.freq AND c.trial = a.trial AND c.t_idx = a.t_idx AND c.src = a.dst AND c.dst = b.dst GROUP BY 1, 2, 3, 4)
       SELECT k.freq, k.trial, k.t_idx, k.node, coalesce(2.0 * coalesce(tri, 0) / nullif(k * (k - 1), 0), 0) AS clustering FROM k LEFT JOIN tri ON k.freq = tri.freq AND k.trial = tri.trial AND k.t_idx = tri.t_idx AND k.node = tri.node""")  # fmt: skip
def _(t: Tables):
    return G.clustering(t.sides, FRAME)


_SUCC = """x AS (SELECT a.freq, a.trial, a.t_idx, a.src AS node, sum(a.weight * b.weight) AS xy, count(*) AS inter FROM sides a JOIN sides b ON a.freq = b.freq AND a.trial = b.trial AND b.t_idx = a.t_idx + 1 AND a.src = b.src AND a.dst = b.dst GROUP BY 1, 2, 3, 4),
       o AS (SELECT freq, trial, t_idx, src AS node, sum(weight * weight) AS w2, count(*) AS k FROM sides GROUP BY 1, 2, 3, 4),
       j AS (SELECT a.freq, a.trial, a.t_idx, a.node, coalesce(xy, 0) AS xy, coalesce(inter, 0) AS inter, a.w2 AS xx, b.w2 AS yy, a.k AS nx, b.k AS ny FROM o a JOIN o b ON a.freq = b.freq AND a.trial = b.trial AND b.t_idx = a.t_idx + 1 AND a.node = b.node LEFT JOIN x ON x.freq = a.freq AND x.trial = a.trial AND x.t_idx = a.t_idx AND x.node = a.node)"""


@query("cosine_frames", "G14", f"{GF} node:string cosine:double", f"WITH {_SUCC} SELECT freq, trial, t_idx, node, xy / sqrt(xx * yy) AS cosine FROM j")
def _(t: Tables):
    return G.cosine_frames(t.sides, BY)


@query("jaccard_frames", "G15", f"{GF} node:string jaccard:double", f"WITH {_SUCC} SELECT freq, trial, t_idx, node, inter / CAST(nx + ny - inter AS DOUBLE) AS jaccard FROM j")
def _(t: Tables):
    return G.jaccard_frames(t.sides, BY)


@query("temporal_correlation", "G13", "freq:string trial:long node:string c:double", f"WITH {_SUCC} SELECT freq, trial, node, sum(inter / sqrt(CAST(nx * ny AS DOUBLE))) / 11.0 AS c FROM j GROUP BY 1, 2, 3")
def _(t: Tables):
    return G.temporal_correlation(t.sides, BY, 1, 12)


_COM = "CAST(substr({c}, 7, 1) AS BIGINT)"


def community(c):
    return F.substring(F.col(c) if isinstance(c, str) else c, 7, 1).cast("long")


@query("modularity_given", "G7", f"{GF} q:double",
       f"""WITH m AS (SELECT freq, trial, t_idx, sum(weight) AS m FROM frames GROUP BY 1, 2, 3), k AS (SELECT freq, trial, t_idx, {_COM.format(c='src')} AS c, sum(weight) AS k, sum(CASE WHEN {_COM.format(c='src')} = {_COM.format(c='dst')} THEN weight ELSE 0 END) AS inside FROM sides GROUP BY 1, 2, 3, 4)
       SELECT freq, trial, t_idx, sum(inside / (2 * m) - (k / (2 * m)) * (k / (2 * m))) AS q FROM k JOIN m USING (freq, trial, t_idx) GROUP BY 1, 2, 3""")  # fmt: skip
def _(t: Tables):
    return G.modularity(t.frames, FRAME, community)


@query("participation", "G12", f"{GF} node:string participation:double",
       f"WITH k AS (SELECT freq, trial, t_idx, src AS node, {_COM.format(c='dst')} AS c, sum(weight) AS k FROM sides GROUP BY 1, 2, 3, 4, 5) SELECT freq, trial, t_idx, node, 1 - sum(k * k) / (sum(k) * sum(k)) AS participation FROM k GROUP BY 1, 2, 3, 4")
def _(t: Tables):
    return G.participation(t.sides, FRAME, community)


_MEM = "SELECT node, freq, trial, t_idx, active AS community FROM act"


@query("allegiance_given", "G8 G10 G18", "freq:string src:long dst:long allegiance:double",
       f"WITH m AS ({_MEM}), f AS (SELECT freq, count(*) AS frames FROM (SELECT DISTINCT freq, trial, t_idx FROM m) GROUP BY 1) SELECT a.freq, a.node AS src, b.node AS dst, count(*) / any_value(CAST(frames AS DOUBLE)) AS allegiance FROM m a JOIN m b ON a.freq = b.freq AND a.trial = b.trial AND a.t_idx = b.t_idx AND a.community = b.community AND a.node < b.node JOIN f ON f.freq = a.freq GROUP BY 1, 2, 3")
def _(t: Tables):
    return G.allegiance(t.act.withColumn("community", F.col("active")), FRAME, ["freq"])


@query("allegiance_windowed", "G9", "freq:string win:long src:long dst:long allegiance:double",
       f"WITH m AS (SELECT *, t_idx // 6 AS win FROM ({_MEM})), f AS (SELECT freq, win, count(*) AS frames FROM (SELECT DISTINCT freq, trial, t_idx, win FROM m) GROUP BY 1, 2) SELECT a.freq, a.win, a.node AS src, b.node AS dst, count(*) / any_value(CAST(frames AS DOUBLE)) AS allegiance FROM m a JOIN m b ON a.freq = b.freq AND a.trial = b.trial AND a.t_idx = b.t_idx AND a.community = b.community AND a.node < b.node JOIN f ON f.freq = a.freq AND f.win = a.win GROUP BY 1, 2, 3, 4")
def _(t: Tables):
    m = t.act.withColumn("community", F.col("active")).withColumn("win", F.floor(F.col("t_idx") / 6))
    return G.allegiance(m, [*FRAME, "win"], ["freq", "win"])


_HOPS = """WITH RECURSIVE s AS (SELECT freq, trial, t_idx, src, dst FROM sides), v AS (SELECT DISTINCT freq, trial, t_idx, src AS node FROM s),
       hop AS (SELECT freq, trial, t_idx, node AS a, node AS b, 0 AS d FROM v UNION SELECT h.freq, h.trial, h.t_idx, h.a, s.dst, h.d + 1 FROM hop h JOIN s ON s.freq = h.freq AND s.trial = h.trial AND s.t_idx = h.t_idx AND s.src = h.b WHERE h.d < 24),
       near AS (SELECT freq, trial, t_idx, a, b, min(d) AS d FROM hop GROUP BY 1, 2, 3, 4, 5)"""


@query("shortest_path_sums", "G4", f"{GF} node:string closeness:double", f"{_HOPS} SELECT freq, trial, t_idx, a AS node, sum(d) AS closeness FROM near GROUP BY 1, 2, 3, 4")
def _(t: Tables):
    return G.frame_metric(t.frames, FRAME, "closeness")


for _metric, _ids in (("coreness", "G3 B19"), ("closeness", "G4"), ("betweenness", "G6"), ("efficiency", "G5"), ("louvain", "G7 G16")):

    def _plan(t: Tables, metric=_metric):
        return G.frame_metric(t.frames, FRAME, metric)

    query(f"graph_{_metric}", _ids, f"{GF} node:string {_metric}:double")(_plan)


# Information

@query("entropy", "I1 I2", "node:long freq:string h:double",
       "SELECT node, freq, -(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) - (CASE WHEN p < 1 THEN (1 - p) * log2(1 - p) ELSE 0 END) AS h FROM (SELECT node, freq, avg(active) AS p FROM act GROUP BY 1, 2)")
def _(t: Tables):
    return I.entropy(t.act, ["node", "freq"])


def _mi_sql(pairs: str, by: str) -> str:
    h = lambda p: f"-(CASE WHEN ({p}) > 0 THEN ({p}) * log2({p}) ELSE 0 END)"
    return (
        f"pr AS ({pairs}), pp AS (SELECT {by}, avg(CAST(x = 1 AND y = 1 AS DOUBLE)) AS p11, avg(CAST(x = 1 AND y = 0 AS DOUBLE)) AS p10, avg(CAST(x = 0 AND y = 1 AS DOUBLE)) AS p01, avg(CAST(x = 0 AND y = 0 AS DOUBLE)) AS p00 FROM pr GROUP BY {by}), "
        f"hh AS (SELECT {by}, {h('p11 + p10')} {h('p01 + p00')} AS hx, {h('p11 + p01')} {h('p10 + p00')} AS hy, {h('p11')} {h('p10')} {h('p01')} {h('p00')} AS hxy FROM pp), mi AS (SELECT *, hx + hy - hxy AS mi FROM hh)"
    )


_PAIRS = "SELECT a.freq, a.node AS src, b.node AS dst, a.active AS x, b.active AS y FROM act a JOIN act b ON a.freq = b.freq AND a.trial = b.trial AND a.t_idx = b.t_idx AND a.node < b.node"


@query("mi_pairs", "I3 I4", "freq:string src:long dst:long hx:double hy:double hxy:double mi:double", f"WITH {_mi_sql(_PAIRS, 'freq, src, dst')} SELECT * FROM mi")
def _(t: Tables):
    return I.mutual_information(P.pair_up(t.act, FRAME, "active"), ["freq", "src", "dst"])


_LAGGED = "SELECT a.freq, a.node AS src, b.node AS dst, l.lag, a.active AS x, b.active AS y FROM act b CROSS JOIN (SELECT CAST(unnest(range(-2, 3)) AS BIGINT) AS lag) l JOIN act a ON a.freq = b.freq AND a.trial = b.trial AND a.t_idx = b.t_idx + l.lag AND a.node < b.node"


@query("lagged_mi", "I5 W11", "freq:string src:long dst:long lag:long mi:double", f"WITH {_mi_sql(_LAGGED, 'freq, src, dst, lag')} SELECT freq, src, dst, lag, mi FROM mi")
def _(t: Tables):
    return I.mutual_information(I.lagged_pairs(t.act, ["freq", "trial"], [-2, -1, 0, 1, 2]), ["freq", "src", "dst", "lag"])


@query("best_lag_mi", "I6 S4", "freq:string src:long dst:long mi:double lag:long",
       f"WITH {_mi_sql(_LAGGED, 'freq, src, dst, lag')} SELECT freq, src, dst, round(mi, 9) AS mi, lag FROM mi QUALIFY row_number() OVER (PARTITION BY freq, src, dst ORDER BY round(mi, 9) DESC, lag) = 1")
def _(t: Tables):
    mi = I.mutual_information(I.lagged_pairs(t.act, ["freq", "trial"], [-2, -1, 0, 1, 2]), ["freq", "src", "dst", "lag"])
    return I.best_lag(mi, ["freq", "src", "dst"])


_NMI = "SELECT node, sum(n / m * log2(n * m / (nx * ny))) AS mi FROM (SELECT node, active, stim, CAST(count(*) AS DOUBLE) AS n, sum(CAST(count(*) AS DOUBLE)) OVER (PARTITION BY node, active) AS nx, sum(CAST(count(*) AS DOUBLE)) OVER (PARTITION BY node, stim) AS ny, sum(CAST(count(*) AS DOUBLE)) OVER (PARTITION BY node) AS m FROM act JOIN trials USING (trial) GROUP BY 1, 2, 3) GROUP BY 1"


@query("stimulus_mi", "I7 I9", "node:long mi:double", _NMI)
def _(t: Tables):
    return I.discrete_information(t.act.join(F.broadcast(t.trials), "trial"), ["node"], "active", "stim")


@query("pid", "I12", "src:long dst:long redundancy:double unique_s:double unique_t:double synergy:double",
       f"""WITH nm AS ({_NMI}), c AS (SELECT a.node AS src, b.node AS dst, a.active * 2 + b.active AS xy, stim, CAST(count(*) AS DOUBLE) AS n FROM act a JOIN act b ON a.freq = b.freq AND a.trial = b.trial AND a.t_idx = b.t_idx AND a.node < b.node JOIN trials ON trials.trial = a.trial GROUP BY 1, 2, 3, 4),
       w AS (SELECT *, sum(n) OVER (PARTITION BY src, dst, xy) AS nx, sum(n) OVER (PARTITION BY src, dst, stim) AS ny, sum(n) OVER (PARTITION BY src, dst) AS m FROM c), pm AS (SELECT src, dst, sum(n / m * log2(n * m / (nx * ny))) AS mi FROM w GROUP BY 1, 2)
       SELECT src, dst, least(s.mi, d.mi) AS redundancy, s.mi - least(s.mi, d.mi) AS unique_s, d.mi - least(s.mi, d.mi) AS unique_t, pm.mi - s.mi - d.mi + least(s.mi, d.mi) AS synergy FROM pm JOIN nm s ON s.node = src JOIN nm d ON d.node = dst""")  # fmt: skip
def _(t: Tables):
    stim = F.broadcast(t.trials.select("trial", "stim"))
    nodes = I.discrete_information(t.act.join(stim, "trial"), ["node"], "active", "stim")
    pairs = P.pair_up(t.act, FRAME, "active").withColumn("xy", F.col("x") * 2 + F.col("y")).join(stim, "trial")
    return I.partial_information(nodes, I.discrete_information(pairs, ["src", "dst"], "xy", "stim"))


@query("delayed_mi", "I11", "freq:string src:long dst:long mi:double",
       f"WITH r AS (SELECT a.freq, a.node AS src, b.node AS dst, {corr_sql('a.value', 'b.value')} AS r FROM sig a JOIN sig b ON a.freq = b.freq AND a.trial = b.trial AND a.t_idx = (b.t_idx + 2) % 24 AND a.node < b.node GROUP BY 1, 2, 3) SELECT freq, src, dst, -0.5 * ln(1 - r * r) AS mi FROM r")
def _(t: Tables):
    a = t.sig.select(*FRAME, F.col("node").alias("src"), F.col("value").alias("x"))
    b = W.rolled(t.sig, 2, 24).select(*FRAME, F.col("node").alias("dst"), F.col("value").alias("y"))
    r = a.join(b, FRAME).filter("src < dst").groupBy("freq", "src", "dst").agg(A.safe_corr("x", "y").alias("r"))
    return r.withColumn("mi", -0.5 * F.ln(1 - F.col("r") * F.col("r")))


# Statistics

_TWO = "SELECT node, freq, value, CAST(trial % 2 = 1 AS BIGINT) AS g FROM sig"


def _groups(t: Tables):
    return t.sig.withColumn("g", (F.col("trial") % 2 == 1).cast("long"))


_KS = """c AS (SELECT node, freq, value, sum(CAST(g = 0 AS DOUBLE)) OVER w AS a, sum(CAST(g = 1 AS DOUBLE)) OVER w AS b, sum(CAST(g = 0 AS DOUBLE)) OVER (PARTITION BY node, freq) AS n0, sum(CAST(g = 1 AS DOUBLE)) OVER (PARTITION BY node, freq) AS n1 FROM tw WINDOW w AS (PARTITION BY node, freq ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
       ks AS (SELECT node, freq, max(abs(a / n0 - b / n1)) AS d, any_value(sqrt(n0 * n1 / (n0 + n1))) AS s FROM c GROUP BY 1, 2),
       kp AS (SELECT node, freq, d, least(1.0, greatest(0.0, (SELECT sum(2.0 * (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * s * d * s * d)) FROM (SELECT unnest(range(1, 9)) AS k)))) AS p FROM ks)"""


@query("ks_statistic", "I13", "node:long freq:string d:double p:double", f"WITH tw AS ({_TWO}), {_KS} SELECT * FROM kp")
def _(t: Tables):
    return T.ks_statistic(_groups(t), ["node", "freq"], "g")


@query("significant_share", "I15 C6", "freq:string n:long share:double mark:string",
       f"WITH tw AS ({_TWO}), {_KS} SELECT freq, count(*) AS n, avg(CAST(p <= 0.05 AS DOUBLE)) AS share, CASE WHEN min(p) <= 1e-4 THEN '****' WHEN min(p) <= 1e-3 THEN '***' WHEN min(p) <= 0.01 THEN '**' WHEN min(p) <= 0.05 THEN '*' ELSE 'ns' END AS mark FROM kp GROUP BY 1 HAVING count(*) >= 10")
def _(t: Tables):
    p = T.ks_statistic(_groups(t), ["node", "freq"], "g").groupBy("freq").agg(F.count("*").alias("n"), F.avg((F.col("p") <= 0.05).cast("double")).alias("share"), F.min("p").alias("p"))
    return p.filter("n >= 10").withColumn("mark", S.stars("p"))


@query("t_statistic", "I14", "node:long freq:string t:double",
       f"""WITH tw AS ({_TWO}), m AS (SELECT node, freq, avg(value) FILTER (WHERE g = 0) AS m0, avg(value) FILTER (WHERE g = 1) AS m1, var_samp(value) FILTER (WHERE g = 0) AS v0, var_samp(value) FILTER (WHERE g = 1) AS v1, count(*) FILTER (WHERE g = 0) AS n0, count(*) FILTER (WHERE g = 1) AS n1 FROM tw GROUP BY 1, 2)
       SELECT node, freq, (m1 - m0) / nullif(sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1)), 0) AS t FROM m""")  # fmt: skip
def _(t: Tables):
    return T.t_statistic(_groups(t), ["node", "freq"], "g")


@query("mann_whitney", "I16", "node:long freq:string u:double z:double",
       f"""WITH tw AS ({_TWO}), r AS (SELECT *, rank() OVER (PARTITION BY node, freq ORDER BY value) + (count(*) OVER (PARTITION BY node, freq, value) - 1) / 2.0 AS r FROM tw),
       s AS (SELECT node, freq, sum(r) FILTER (WHERE g = 1) AS r1, CAST(count(*) FILTER (WHERE g = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE g = 0) AS DOUBLE) AS n0 FROM r GROUP BY 1, 2)
       SELECT node, freq, r1 - n1 * (n1 + 1) / 2 AS u, (r1 - n1 * (n1 + 1) / 2 - n1 * n0 / 2) / nullif(sqrt(n1 * n0 * (n1 + n0 + 1) / 12), 0) AS z FROM s""")  # fmt: skip
def _(t: Tables):
    return T.mann_whitney(_groups(t), ["node", "freq"], "g")


@query("fdr_bh", "I9", "node:long freq:string p:double q:double",
       f"""WITH tw AS ({_TWO}), {_KS}, f AS (SELECT node, freq, p, row_number() OVER (PARTITION BY freq ORDER BY p) AS r, count(*) OVER (PARTITION BY freq) AS n FROM kp)
       SELECT node, freq, p, least(1.0, min(p * n / r) OVER (PARTITION BY freq ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM f""")  # fmt: skip
def _(t: Tables):
    return T.fdr(T.ks_statistic(_groups(t), ["node", "freq"], "g"), ["freq"])


@query("difference_of_mi", "I10", "node:long diff:double",
       """WITH c AS (SELECT node, response, active, stim, CAST(count(*) AS DOUBLE) AS n FROM act JOIN trials USING (trial) GROUP BY 1, 2, 3, 4), w AS (SELECT *, sum(n) OVER (PARTITION BY node, response, active) AS nx, sum(n) OVER (PARTITION BY node, response, stim) AS ny, sum(n) OVER (PARTITION BY node, response) AS m FROM c),
       i AS (SELECT node, response, sum(n / m * log2(n * m / (nx * ny))) AS mi FROM w GROUP BY 1, 2) SELECT a.node, a.mi - b.mi AS diff FROM i a JOIN i b ON a.node = b.node AND a.response = 1 AND b.response = 0""")  # fmt: skip
def _(t: Tables):
    mi = I.discrete_information(t.act.join(F.broadcast(t.trials), "trial"), ["node", "response"], "active", "stim")
    a, b = mi.filter("response = 1").select("node", F.col("mi").alias("a")), mi.filter("response = 0").select("node", F.col("mi").alias("b"))
    return a.join(b, "node").select("node", (F.col("a") - F.col("b")).alias("diff"))


@query("rate_by_stimulus", "B25", "node:long stage:string stim:long rate:double",
       "SELECT a.node, s.stage, stim, avg(CAST(active AS DOUBLE)) AS rate FROM act a JOIN staged s USING (node, freq, trial, t_idx) JOIN trials USING (trial) GROUP BY 1, 2, 3")
def _(t: Tables):
    return t.act.join(F.broadcast(t.trials), "trial").groupBy("node", stage_of().alias("stage"), "stim").agg(F.avg(F.col("active").cast("double")).alias("rate"))

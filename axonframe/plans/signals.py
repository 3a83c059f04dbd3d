"""Queries on signals: selection, reductions, thresholds, time windows, runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregate as A
from ..operators import runs as R
from ..operators import timewin as W
from ..sources.lifts import EPOCHS, Tables, stage_of
from .registry import query

K = "node:long freq:string"
KT = f"{K} trial:long t_idx:long"


@query("active_share_by_stage", "IO8 A5 J4 B1 A12", f"{K} stage:string share:double",
       "SELECT a.node, a.freq, s.stage, avg(a.active) AS share FROM act a JOIN staged s USING (node, freq, trial, t_idx) GROUP BY 1, 2, 3")
def _(t: Tables):
    return t.act.groupBy("node", "freq", stage_of().alias("stage")).agg(F.avg(F.col("active").cast("double")).alias("share"))


@query("threshold_absolute", "A5 B1", "node:long freq:string thr:double", "SELECT node, freq, quantile_cont(value, 0.9) AS thr FROM com GROUP BY 1, 2")
def _(t: Tables):
    return A.quantile(t.com, ["node", "freq"], 0.9)


@query("threshold_relative", "B1", f"{K} trial:long thr:double n:long",
       "WITH q AS (SELECT node, freq, trial, quantile_cont(value, 0.75) AS thr FROM sig GROUP BY 1, 2, 3) SELECT node, freq, trial, min(thr) AS thr, sum(CAST(value >= thr AND value > 0 AS BIGINT)) AS n FROM sig JOIN q USING (node, freq, trial) GROUP BY 1, 2, 3")
def _(t: Tables):
    by = ["node", "freq", "trial"]
    thr = A.quantile(t.sig, by, 0.75)
    return A.binarise(t.sig, thr, by).groupBy(*by).agg(F.sum("active").alias("n")).join(thr, by)


@query("threshold_mquantile", "A6 B2", f"{K} thr:double",
       """WITH r AS (SELECT node, freq, value, row_number() OVER (PARTITION BY node, freq ORDER BY value) AS k, count(*) OVER (PARTITION BY node, freq) AS n FROM sig),
       p AS (SELECT *, n * 0.9 + 0.4 + 0.2 * 0.9 AS a, floor(greatest(1.0, least(n * 0.9 + 0.4 + 0.2 * 0.9, n - 1.0))) AS low FROM r)
       SELECT node, freq, sum(CASE WHEN k = low THEN (1 - greatest(0.0, least(a - low, 1.0))) * value WHEN k = low + 1 THEN greatest(0.0, least(a - low, 1.0)) * value END) AS thr FROM p GROUP BY 1, 2""")  # fmt: skip
def _(t: Tables):
    return A.mquantile(t.sig, ["node", "freq"], 0.9)


@query("threshold_per_band", "A7", "freq:string thr:double", "SELECT freq, quantile_cont(value, 0.95) AS thr FROM sig GROUP BY 1")
def _(t: Tables):
    return A.quantile(t.sig, ["freq"], 0.95)


@query("axis_reductions", "A1 A2 A3 A4 A28", f"{K} mean:double std:double total:double hi:double lo:double med:double",
       "SELECT node, freq, avg(value) AS mean, stddev_pop(value) AS std, sum(value) AS total, max(value) AS hi, min(value) AS lo, median(value) AS med FROM sig GROUP BY 1, 2")
def _(t: Tables):
    return A.reduce(t.sig, ["node", "freq"], mean=("mean", "value"), std=("std", "value"), total=("sum", "value"), hi=("max", "value"), lo=("min", "value"), med=("median", "value"))


@query("integrate_time", "A4", f"{K} trial:long area:double",
       "WITH l AS (SELECT node, freq, trial, (value + lead(value) OVER (PARTITION BY node, freq, trial ORDER BY t_idx)) / 2 AS s FROM sig) SELECT node, freq, trial, sum(s) AS area FROM l GROUP BY 1, 2, 3")
def _(t: Tables):
    l = t.sig.withColumn("s", (F.col("value") + F.lead("value").over(W.over(W.SERIES))) / 2)
    return l.groupBy(*W.SERIES).agg(F.sum("s").alias("area"))


@query("area_mean", "A8 A30 J5", "region:long freq:string mean:double n:long", "SELECT region, freq, avg(value) AS mean, count(*) AS n FROM com GROUP BY 1, 2")
def _(t: Tables):
    return t.com.groupBy("region", "freq").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


@query("mean_of_means", "A9 A32", "region:long freq:string mean:double",
       "SELECT region, freq, avg(m) AS mean FROM (SELECT region, node, freq, avg(value) AS m FROM com GROUP BY 1, 2, 3) GROUP BY 1, 2")
def _(t: Tables):
    return A.mean_of_means(t.com, ["region", "node", "freq"], ["region", "freq"])


@query("stage_mean", "A10 D8", f"{K} trial:long stage:string mean:double", "SELECT node, freq, trial, stage, avg(value) AS mean FROM staged GROUP BY 1, 2, 3, 4")
def _(t: Tables):
    return t.sig.groupBy("node", "freq", "trial", stage_of().alias("stage")).agg(F.avg("value").alias("mean"))


@query("stage_statistics", "A11", f"{K} stage:string p95:double cv:double",
       "SELECT node, freq, stage, quantile_cont(value, 0.95) AS p95, stddev_pop(value) / nullif(avg(value), 0) AS cv FROM staged GROUP BY 1, 2, 3")
def _(t: Tables):
    return t.sig.groupBy("node", "freq", stage_of().alias("stage")).agg(F.percentile("value", F.lit(0.95)).alias("p95"), S.sdiv(F.stddev_pop("value"), F.avg("value")).alias("cv"))


@query("epoch_mean_overlap", "A12", f"{K} epoch:string mean:double",
       "SELECT node, freq, epoch, avg(value) AS mean FROM sig JOIN epochs ON t_idx BETWEEN t0 AND t1 GROUP BY 1, 2, 3")
def _(t: Tables):
    return A.epoch_average(t.sig, EPOCHS, ["node", "freq"])


@query("adaptive_epoch_mean", "A13 F22", f"{K} mean:double n:long",
       "SELECT node, freq, avg(value) AS mean, count(*) AS n FROM sig JOIN trials USING (trial) WHERE t_idx BETWEEN t_match - 4 AND t_match GROUP BY 1, 2")
def _(t: Tables):
    j = t.sig.join(F.broadcast(t.trials), "trial").filter(F.col("t_idx").between(F.col("t_match") - 4, F.col("t_match")))
    return j.groupBy("node", "freq").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


@query("delay_bin_mean", "A14", f"{K} bin:long t_idx:long mean:double",
       "SELECT node, freq, CASE WHEN t_match < 20 THEN 0 ELSE 1 END AS bin, t_idx, avg(value) AS mean FROM sig JOIN trials USING (trial) GROUP BY 1, 2, 3, 4")
def _(t: Tables):
    j = t.sig.join(F.broadcast(t.trials), "trial").withColumn("bin", F.when(F.col("t_match") < 20, 0).otherwise(1))
    return j.groupBy("node", "freq", "bin", "t_idx").agg(F.avg("value").alias("mean"))


@query("stage_samples", "A15 A16", "stage:string trial:long n:long", "SELECT stage, trial, count(DISTINCT t_idx) AS n FROM staged GROUP BY 1, 2")
def _(t: Tables):
    return t.sig.select("trial", "t_idx").distinct().groupBy(stage_of().alias("stage"), "trial").agg(F.count("*").alias("n"))


@query("hist_density", "A17", "freq:string bin:long n:long density:double",
       """WITH e AS (SELECT freq, min(value) AS lo, max(value) AS hi, count(*) AS total FROM com GROUP BY 1)
       SELECT freq, least(floor((value - lo) / ((hi - lo) / 20)), 19) AS bin, count(*) AS n, count(*) / (any_value(total) * any_value((hi - lo) / 20)) AS density FROM com JOIN e USING (freq) GROUP BY 1, 2""")  # fmt: skip
def _(t: Tables):
    return A.histogram(t.com, ["freq"], 20)


@query("binned_conditional_mean", "A18", "freq:string bin:long mean:double n:long",
       "SELECT freq, floor(value / 25) AS bin, avg(t_idx) AS mean, count(*) AS n FROM sig WHERE value > 0 GROUP BY 1, 2")
def _(t: Tables):
    return t.sig.filter("value > 0").groupBy("freq", F.floor(F.col("value") / 25).alias("bin")).agg(F.avg("t_idx").alias("mean"), F.count("*").alias("n"))


@query("custom_zero_moments", "A21", f"{K} mean:double std:double",
       "SELECT node, freq, coalesce(avg(CASE WHEN value > 100 THEN value END), 0) AS mean, coalesce(stddev_pop(CASE WHEN value > 100 THEN value END), 0) AS std FROM sig GROUP BY 1, 2")
def _(t: Tables):
    x = F.when(F.col("value") > 100, F.col("value"))
    return t.sig.groupBy("node", "freq").agg(S.nz(F.avg(x)).alias("mean"), S.nz(F.stddev_pop(x)).alias("std"))


@query("exceedance", "A22", "freq:string thr:double share:double",
       "SELECT freq, g.thr, avg(CAST(value > g.thr AS DOUBLE)) AS share FROM com CROSS JOIN (SELECT CAST(unnest([1000.0, 10000.0, 50000.0, 100000.0]) AS DOUBLE) AS thr) g GROUP BY 1, 2")
def _(t: Tables):
    return A.exceedance(t.com, ["freq"], [1e3, 1e4, 5e4, 1e5])


@query("tpr_fpr_fdr", "A24", "node:long tpr:double fpr:double fdr:double",
       """WITH r AS (SELECT node, active AS truth, CAST(value > 40 AS BIGINT) AS found FROM act)
       SELECT node, coalesce(sum(truth * found) / nullif(sum(truth), 0), 0) AS tpr, coalesce(sum((1 - truth) * found) / nullif(sum(1 - truth), 0), 0) AS fpr, coalesce(sum((1 - truth) * found) / nullif(sum(found), 0), 0) AS fdr FROM r GROUP BY 1""")  # fmt: skip
def _(t: Tables):
    return A.detection_rates(t.act.withColumn("found", (F.col("value") > 40).cast("long")), ["node"], "active", "found")


@query("peak_counts", "K24 A10 A25", "freq:string node:long n:long",
       "WITH l AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM sig WINDOW w AS (PARTITION BY node, freq, trial ORDER BY t_idx)) SELECT freq, node, count(*) AS n FROM l WHERE value > a AND value > b GROUP BY 1, 2")
def _(t: Tables):
    return W.local_peaks(t.sig, W.SERIES, "t_idx").groupBy("freq", "node").agg(F.count("*").alias("n"))


@query("band_maximum", "A26 K25", "node:long band:string hi:double",
       "SELECT node, b.band, max(value) AS hi FROM sig JOIN (VALUES ('early', 0, 7), ('mid', 8, 15), ('late', 16, 23)) AS b(band, lo, up) ON t_idx BETWEEN lo AND up GROUP BY 1, 2")
def _(t: Tables):
    band = F.when(F.col("t_idx") <= 7, "early").when(F.col("t_idx") <= 15, "mid").otherwise("late")
    return t.sig.groupBy("node", band.alias("band")).agg(F.max("value").alias("hi"))


@query("trial_filter", "F1 F3 F4 J8 J9", f"{K} trial:long total:double",
       "SELECT node, freq, trial, sum(value) AS total FROM sig WHERE trial IN (SELECT trial FROM trials WHERE trial_type IN (1) AND response IN (1)) GROUP BY 1, 2, 3")
def _(t: Tables):
    keep = t.trials.filter(F.col("trial_type").isin(1) & F.col("response").isin(1))
    return t.sig.join(F.broadcast(keep), "trial", "left_semi").groupBy("node", "freq", "trial").agg(F.sum("value").alias("total"))


@query("event_aligned_crop", "IO6 C17 F9 F11", f"{K} trial:long rel:double value:double",
       "SELECT node, freq, trial, (t_idx - t_match) / 1000.0 AS rel, value FROM sig JOIN trials USING (trial) WHERE t_idx >= t_match - 3 AND t_idx < t_match + 2")
def _(t: Tables):
    j = t.sig.join(F.broadcast(t.trials), "trial").filter((F.col("t_idx") >= F.col("t_match") - 3) & (F.col("t_idx") < F.col("t_match") + 2))
    return j.withColumn("rel", (F.col("t_idx") - F.col("t_match")) / 1000.0)


@query("spike_raster", "IO7", "node:long trial:long t_idx:long", "SELECT DISTINCT node, trial, t_idx FROM cells WHERE freq = 'error' AND t_idx BETWEEN 2 AND 20")
def _(t: Tables):
    return t.cells.filter((F.col("freq") == "error") & F.col("t_idx").between(2, 20)).select("node", "trial", "t_idx").distinct()


@query("channel_filter", "F6 F7 F8 J10", f"{K} n:long", "SELECT node, freq, count(*) AS n FROM cells WHERE node % 3 = 0 AND node NOT IN (SELECT DISTINCT node FROM cells WHERE value > 900) GROUP BY 1, 2")
def _(t: Tables):
    loud = t.cells.filter("value > 900").select("node").distinct()
    return t.cells.filter("node % 3 = 0").join(loud, "node", "left_anti").groupBy("node", "freq").agg(F.count("*").alias("n"))


@query("edge_trim", "F12", KT + " value:double",
       "SELECT node, freq, trial, t_idx, value FROM (SELECT *, max(t_idx) OVER (PARTITION BY node, freq, trial) AS last FROM cells) WHERE t_idx >= 2 AND t_idx <= last - 2")
def _(t: Tables):
    from pyspark.sql import Window

    return t.cells.withColumn("last", F.max("t_idx").over(Window.partitionBy(*W.SERIES))).filter("t_idx >= 2 and t_idx <= last - 2")


@query("decimated_slice", "F10 F13 F27 IO9", KT + " value:double", "SELECT * FROM sig WHERE freq = 'click' AND t_idx BETWEEN 4 AND 20 AND t_idx % 4 = 0")
def _(t: Tables):
    return t.sig.filter((F.col("freq") == "click") & F.col("t_idx").between(4, 20) & (F.col("t_idx") % 4 == 0))


@query("min_support_mean", "F23", "node:long trial:long n:long mean:double", "SELECT node, trial, count(*) AS n, avg(value) AS mean FROM com GROUP BY 1, 2 HAVING count(*) >= 10")
def _(t: Tables):
    return A.min_support(t.com, ["node", "trial"], 10)


@query("concat_sessions", "U1 U2 IO23 IO24", "session:string freq:string n:long mean:double",
       "SELECT 'a' AS session, freq, count(*) AS n, avg(value) AS mean FROM sig GROUP BY freq UNION ALL SELECT 'b', freq, count(*), avg(value) FROM com GROUP BY freq")
def _(t: Tables):
    both = t.sig.withColumn("session", F.lit("a")).unionByName(t.com.withColumn("session", F.lit("b")), allowMissingColumns=True)
    return both.groupBy("session", "freq").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


@query("endpoint_union", "U3", "node:string", "SELECT src AS node FROM frames UNION SELECT dst FROM frames")
def _(t: Tables):
    return t.frames.select(F.col("src").alias("node")).union(t.frames.select("dst")).distinct()


@query("intersect_except", "U5", "node:long trial:long", "SELECT node, trial FROM cells WHERE value > 100 INTERSECT SELECT node, trial FROM cells WHERE freq = 'view' EXCEPT SELECT node, trial FROM cells WHERE t_idx = 0")
def _(t: Tables):
    c = t.cells.select("node", "trial", "value", "freq", "t_idx")
    k = ["node", "trial"]
    return c.filter("value > 100").select(*k).intersect(c.filter("freq = 'view'").select(*k)).subtract(c.filter("t_idx = 0").select(*k))


@query("top_channels", "S8 S2", "node:long total:double k:long",
       "SELECT * FROM (SELECT node, round(sum(value), 2) AS total, row_number() OVER (ORDER BY round(sum(value), 2) DESC, node) AS k FROM com GROUP BY node) WHERE k <= 5")
def _(t: Tables):
    totals = t.com.groupBy("node").agg(F.round(F.sum("value"), 2).alias("total"))
    from pyspark.sql import Window

    top = totals.orderBy(F.desc("total"), "node").limit(5)  # a top-k report
    return top.withColumn("k", F.row_number().over(Window.orderBy(F.desc("total"), "node")))


@query("dictionary_encode", "J6 ML4", "name:string code:long", "SELECT name, dense_rank() OVER (ORDER BY name) - 1 AS code FROM (SELECT DISTINCT p_brand AS name FROM part)")
def _(t: Tables):
    from pyspark.sql import Window

    return t.table("part").select(F.col("p_brand").alias("name")).distinct().withColumn("code", F.dense_rank().over(Window.orderBy("name")) - 1)


@query("pair_labels", "S3 C1 C2 C3 C5", "label:string first:string second:string lower_label:string n:long",
       "SELECT CASE WHEN lower(a) <= lower(b) THEN a || '-' || b ELSE b || '-' || a END AS label, CASE WHEN lower(a) <= lower(b) THEN a ELSE b END AS first, CASE WHEN lower(a) <= lower(b) THEN b ELSE a END AS second, lower(replace(a, ' ', '/')) AS lower_label, count(*) AS n FROM (SELECT p_type AS a, p_brand AS b FROM part) GROUP BY 1, 2, 3, 4")
def _(t: Tables):
    p = t.table("part").select(F.col("p_type").alias("a"), F.col("p_brand").alias("b"))
    first, second = S.ordered_pair("a", "b")
    return p.groupBy(S.pair_label(first, second).alias("label"), first.alias("first"), second.alias("second"), F.lower(F.translate("a", " ", "/")).alias("lower_label")).agg(F.count("*").alias("n"))


@query("scalar_functions", "C7 C8 C9 C10 C11 C12 C13 C14 C15", f"{K} clip:double lg:double rect:double hv:long code:long bias:double dist:double cube:double",
       """SELECT node, freq, greatest(value - 50, 0) AS clip, CASE WHEN value > 0 THEN log2(value) ELSE 0 END AS lg, greatest(50 - value, 0) AS rect, CAST(value - 50 > 0 AS BIGINT) AS hv,
       CASE WHEN value - 50 >= 20 THEN 1 WHEN value - 50 <= -20 THEN 2 ELSE 0 END AS code, 1.0 / (1.0 + 2.0 * t_idx * value / 7.0) AS bias, sqrt((node - t_idx) * (node - t_idx) + (trial - 3) * (trial - 3)) AS dist, cbrt(value) AS cube FROM cells""")  # fmt: skip
def _(t: Tables):
    v = F.col("value")
    return t.cells.select(
        "node", "freq", S.rectified(v - 50).alias("clip"), S.log2z(v).alias("lg"), S.rectified_neg(v - 50).alias("rect"), S.heaviside(v, 50.0).alias("hv"), S.sign_code(v - 50, 20.0).alias("code"),
        S.smoothing_bias("t_idx", "value", F.lit(7.0)).alias("bias"), S.distance("node", "trial", "t_idx", F.lit(3)).alias("dist"), F.cbrt(v).alias("cube"),
    )


@query("predicates", "C21 G17", "node:long binary:long quiet:long odd:long",
       "SELECT node, CAST(bool_and(active IN (0, 1)) AS BIGINT) AS binary, CAST(sum(active) = 0 AS BIGINT) AS quiet, any_value(node % 2) AS odd FROM act GROUP BY 1")
def _(t: Tables):
    return t.act.groupBy("node").agg(F.bool_and(F.col("active").isin(0, 1)).cast("long").alias("binary"), (F.sum("active") == 0).cast("long").alias("quiet"), F.first(F.col("node") % 2).alias("odd"))


@query("nulls_to_zero", "C18 J7", f"{K} trial:long x:double",
       "SELECT s.node, s.freq, s.trial, coalesce(c.value, 0) AS x FROM (SELECT DISTINCT node, freq, trial FROM sig) s LEFT JOIN (SELECT * FROM cells WHERE t_idx = 3) c USING (node, freq, trial)")
def _(t: Tables):
    return t.sig.select("node", "freq", "trial").distinct().join(t.cells.filter("t_idx = 3"), ["node", "freq", "trial"], "left").withColumn("x", S.nz("value"))


@query("zscore_time", "W1", KT + " z:double",
       "SELECT node, freq, trial, t_idx, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z FROM sig WINDOW w AS (PARTITION BY node, freq, trial)")
def _(t: Tables):
    return W.zscore(t.sig)


@query("zscore_guarded", "W2", "node:long freq:string trial:long t_idx:long z:double",
       "SELECT node, freq, trial, t_idx, coalesce((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 0) AS z FROM cells WINDOW w AS (PARTITION BY node, freq, trial)")
def _(t: Tables):
    return W.zscore(t.cells, empty=0.0)


@query("diff_time", "W3", KT + " diff:double",
       "SELECT * FROM (SELECT node, freq, trial, t_idx, value - lag(value) OVER (PARTITION BY node, freq, trial ORDER BY t_idx) AS diff FROM sig) WHERE diff IS NOT NULL")
def _(t: Tables):
    return W.difference(t.sig)


@query("inter_contact_times", "W4 W5", f"{K} ict:long n:long",
       "SELECT node, freq, ict, count(*) AS n FROM (SELECT node, freq, t_idx - lag(t_idx) OVER (PARTITION BY node, freq, trial ORDER BY t_idx) AS ict FROM act WHERE active = 1) WHERE ict IS NOT NULL GROUP BY 1, 2, 3")
def _(t: Tables):
    return W.inter_contact_times(t.act).groupBy("node", "freq", "ict").agg(F.count("*").alias("n"))


@query("downsample_any", "W6", f"{K} trial:long win:long any:long",
       'SELECT node, freq, trial, t_idx // 4 AS win, CAST(sum(active) > 0 AS BIGINT) AS "any" FROM act GROUP BY 1, 2, 3, 4')
def _(t: Tables):
    return W.downsample_any(t.act, 4)


@query("sliding_windows", "W7", f"{K} win:long mean:double",
       "SELECT node, freq, w.win, avg(value) AS mean FROM sig JOIN (SELECT unnest(range(10)) AS win) w ON t_idx BETWEEN w.win * 2 AND w.win * 2 + 5 WHERE w.win * 2 + 6 <= 24 GROUP BY 1, 2, 3")
def _(t: Tables):
    return W.windowed(t.sig, 6, 2, ["node", "freq"], 24)


@query("sliding_rms", "W8", KT + " rms:double",
       "SELECT node, freq, trial, t_idx, sqrt(avg(value * value) OVER (PARTITION BY node, freq, trial ORDER BY t_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS rms FROM sig")
def _(t: Tables):
    return W.sliding_rms(t.sig, 2, 2)


@query("smooth_moving_average", "W10 K5 K35", KT + " smooth:double",
       "SELECT node, freq, trial, t_idx, sum(value) OVER (PARTITION BY node, freq, trial ORDER BY t_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS smooth FROM sig")
def _(t: Tables):
    return W.smoothed(t.sig, 5)


_HANNING = W.kernel_weights(5)


@query("smooth_hanning", "K4 K5 K35", KT + " smooth:double",
       "SELECT node, freq, trial, t_idx, " + " + ".join(f"{w!r} * coalesce(lead(value, {k - 2}) OVER w, 0)" for k, w in enumerate(_HANNING)) + " AS smooth FROM sig WINDOW w AS (PARTITION BY node, freq, trial ORDER BY t_idx)")
def _(t: Tables):
    return W.weighted(t.sig, _HANNING)


@query("session_catalogue", "IO5 IO20 IO14 D1 F5", "trial:long stim:long trial_type:long response:long k:long",
       "SELECT trial, stim, trial_type, response, row_number() OVER (PARTITION BY trial_type ORDER BY trial) - 1 AS k FROM trials")
def _(t: Tables):
    from pyspark.sql import Window

    return t.trials.withColumn("k", F.row_number().over(Window.partitionBy("trial_type").orderBy("trial")) - 1)


@query("channel_labels", "IO10 C3 IO21", "label:string n:long",
       "SELECT n_name || ' (' || s_suppkey || ')' AS label, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1")
def _(t: Tables):
    counts = t.table("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    s = t.table("supplier").join(F.broadcast(t.table("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return counts.join(s, "s_suppkey").select(F.format_string("%s (%d)", "n_name", "s_suppkey").alias("label"), "n")


@query("circular_shift", "W11 W12", KT + " value:double", "SELECT node, freq, trial, (t_idx + 5) % 24 AS t_idx, value FROM sig")
def _(t: Tables):
    return W.rolled(t.sig, 5, 24)


@query("event_triggered_average", "W16", "node:long offset:long mean:double n:long",
       """WITH e AS (SELECT node, freq, trial, t_idx AS at FROM act WHERE active = 1), o AS (SELECT CAST(unnest(range(-3, 3)) AS BIGINT) AS "offset")
       SELECT e.node, o."offset", sum(coalesce(s.value, 0)) / count(*) AS mean, count(*) AS n FROM e CROSS JOIN o LEFT JOIN sig s ON s.node = e.node AND s.freq = e.freq AND s.trial = e.trial AND s.t_idx = e.at + o."offset" GROUP BY 1, 2""")  # fmt: skip
def _(t: Tables):
    return W.triggered_average(t.sig, t.act.filter("active = 1"), 3, W.SERIES, ["node"])


@query("run_triggered_average", "W17", "node:long offset:long mean:double n:long",
       """WITH r AS (SELECT node, freq, trial, min(t_idx) AS s, max(t_idx) AS e FROM (SELECT *, t_idx - row_number() OVER (PARTITION BY node, freq, trial ORDER BY t_idx) AS i FROM act WHERE active = 1) GROUP BY node, freq, trial, i),
       e AS (SELECT node, freq, trial, (s + e + 1) // 2 AS at FROM r), o AS (SELECT CAST(unnest(range(-2, 2)) AS BIGINT) AS "offset")
       SELECT e.node, o."offset", sum(coalesce(s.value, 0)) / count(*) AS mean, count(*) AS n FROM e CROSS JOIN o LEFT JOIN sig s ON s.node = e.node AND s.freq = e.freq AND s.trial = e.trial AND s.t_idx = e.at + o."offset" GROUP BY 1, 2""")  # fmt: skip
def _(t: Tables):
    mid = R.runs(t.act, W.SERIES).withColumn("t_idx", F.floor((F.col("start") + F.col("end")) / 2))
    return W.triggered_average(t.sig, mid, 2, W.SERIES, ["node"])


_RUNS = "SELECT node, freq, trial, min(t_idx) AS \"start\", max(t_idx) + 1 AS \"end\", count(*) AS len FROM (SELECT *, t_idx - row_number() OVER (PARTITION BY node, freq, trial ORDER BY t_idx) AS i FROM act WHERE active = {v}) GROUP BY node, freq, trial, i"


@query("runs_ones", "W13 B3 B4", f"{K} trial:long start:long end:long len:long", _RUNS.format(v=1))
def _(t: Tables):
    return R.runs(t.act, W.SERIES)


@query("runs_zeros", "W13 B3 B4", f"{K} trial:long start:long end:long len:long", _RUNS.format(v=0))
def _(t: Tables):
    return R.runs(t.act, W.SERIES, value=0)


@query("masked_runs", "B5 B6", f"{K} trial:long start:long end:long len:long",
       """WITH m AS (SELECT *, row_number() OVER (PARTITION BY node, freq, trial ORDER BY t_idx) AS j FROM act WHERE t_idx < 6 OR t_idx >= 12)
       SELECT node, freq, trial, min(j) AS "start", max(j) + 1 AS "end", count(*) AS len FROM (SELECT *, j - row_number() OVER (PARTITION BY node, freq, trial ORDER BY j) AS i FROM m WHERE active = 1) GROUP BY node, freq, trial, i""")  # fmt: skip
def _(t: Tables):
    return R.masked_runs(t.act, "t_idx < 6 or t_idx >= 12", W.SERIES)


@query("masked_runs_drop_edges", "B5", f"{K} trial:long start:long end:long len:long",
       """WITH l AS (SELECT *, lag(active) OVER w AS before, lead(active) OVER w AS after FROM act WINDOW w AS (PARTITION BY node, freq, trial ORDER BY t_idx)),
       m AS (SELECT *, row_number() OVER (PARTITION BY node, freq, trial ORDER BY t_idx) AS j FROM l WHERE t_idx BETWEEN 6 AND 17),
       r AS (SELECT node, freq, trial, min(j) AS "start", max(j) + 1 AS "end", count(*) AS len, bool_or(j = 1 AND before = 1) AS cut_a, bool_or(j = 12 AND after = 1) AS cut_b FROM (SELECT *, j - row_number() OVER (PARTITION BY node, freq, trial ORDER BY j) AS i FROM m WHERE active = 1) GROUP BY node, freq, trial, i)
       SELECT node, freq, trial, "start", "end", len FROM r WHERE NOT coalesce(cut_a, false) AND NOT coalesce(cut_b, false)""")  # fmt: skip
def _(t: Tables):
    return R.masked_runs(t.act, "t_idx between 6 and 17", W.SERIES, drop_edges=True)


@query("burst_stats", "B7 B8 D18", f"{K} mu:double sd:double share:double burstiness:double",
       f"SELECT node, freq, avg(len) AS mu, stddev_pop(len) AS sd, sum(len) / 720.0 AS share, (stddev_pop(len) - avg(len)) / nullif(stddev_pop(len) + avg(len), 0) AS burstiness FROM ({_RUNS.format(v=1)}) GROUP BY 1, 2")
def _(t: Tables):
    return R.burst_stats(R.runs(t.act, W.SERIES), ["node", "freq"], 720)



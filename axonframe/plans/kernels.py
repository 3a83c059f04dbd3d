"""Queries on numeric kernels, resampling, models, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gaussian as N
from ..operators import graph as G
from ..operators import models as M
from ..operators import resample as R
from ..operators import spectral as P
from ..operators import timewin as W
from ..sources.lifts import Tables
from .registry import query

FS, FREQS = 64.0, [4.0, 8.0, 12.0, 16.0]


def _stored_signals(t: Tables):
    """Embeddings as 64-sample signals: node within label groups of ten."""
    e = t.table("embeddings")
    return e.select(F.floor(F.col("vec_id") / 10).cast("long").alias("trial"), (F.col("vec_id") % 10).cast("long").alias("node"), F.col("embedding").alias("signal"))


def _signals(t: Tables):
    return _stored_signals(t).withColumn("signal", F.col("signal").cast("array<double>"))


@query("signal_energy", "K3", "trial:long node:long energy:double", "SELECT vec_id // 10 AS trial, vec_id % 10 AS node, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS energy FROM embeddings")
def _(t: Tables):
    return _signals(t).withColumn("energy", F.aggregate("signal", F.lit(0.0), lambda a, x: a + x * x))


@query("morlet_power", "K1 K31", "trial:long node:long freq:double power:double")
def _(t: Tables):
    tf = P.time_frequency(_signals(t), ["trial", "node"], FS, FREQS)
    return P.power(tf).groupBy("trial", "node", "freq").agg(F.avg("value").alias("power"))


@query("hilbert_power", "K2 K3", "trial:long node:long freq:double power:double")
def _(t: Tables):
    tf = P.time_frequency(_signals(t), ["trial", "node"], FS, FREQS, mode="hilbert")
    return P.power(tf).groupBy("trial", "node", "freq").agg(F.avg("value").alias("power"))


@query("multitaper_psd", "K23", "trial:long node:long k:long psd:double")
def _(t: Tables):
    return P.periodogram(_signals(t), ["trial", "node"], FS, tapers=4)


@query("spectral_peaks", "K24 K27", "trial:long k:long n:long")
def _(t: Tables):
    psd = P.periodogram(_signals(t), ["trial", "node"], FS).withColumnRenamed("psd", "value")
    return W.local_peaks(psd, ["trial", "node"], "k").groupBy("trial", "k").agg(F.count("*").alias("n"))


@query("coherence", "K6 K32", "trial:long freq:double src:long dst:long coherence:double")
def _(t: Tables):
    return P.coherence(P.time_frequency(_signals(t), ["trial", "node"], FS, FREQS), ["trial", "freq"], "node")


@query("trial_coherence", "K38", "freq:double t_idx:long src:long dst:long coherence:double")
def _(t: Tables):
    return P.coherence(P.time_frequency(_signals(t), ["trial", "node"], FS, FREQS), ["trial", "freq"], "node", by=["freq", "t_idx"])


@query("cross_frequency", "K26", "trial:long node:long fa:double fb:double r:double plv:double")
def _(t: Tables):
    return P.cross_frequency(P.time_frequency(_signals(t), ["trial", "node"], FS, FREQS), ["trial", "node"])


@query("coherence_surrogates", "R10", "freq:double src:long dst:long threshold:double")
def _(t: Tables):
    """The 95th percentile, over seeds and trials, of the coherence of signals whose phases
    are drawn for each one alone."""
    return P.surrogate_coherence_quantile(_stored_signals(t), ["trial", "node"], FS, FREQS, 5, 0.95)


@query("plv", "K7 W15 C16", "trial:long freq:double src:long dst:long plv:double")
def _(t: Tables):
    return P.phase_locking(P.time_frequency(_signals(t), ["trial", "node"], FS, FREQS), ["trial", "freq"], "node")


@query("granger_causality", "K36", "trial:long src:long dst:long gc:double")
def _(t: Tables):
    return N.granger(_signals(t), "trial", 2)


@query("phase_randomised_power", "R3", "trial:long node:long k:long psd:double")
def _(t: Tables):
    return P.periodogram(P.phase_randomised(_signals(t), ["trial", "node"], 7), ["trial", "node"], FS)


@query("gaussian_copula_mi", "I7", "node:long freq:string mi:double")
def _(t: Tables):
    g = N.copula_normal(t.sig.filter("value > 0"), ["node", "freq"])
    return N.gaussian_information(g.join(F.broadcast(t.trials), "trial"), ["node", "freq"], "stim")


@query("gaussian_conditional_mi", "I8", "freq:string cmi:double")
def _(t: Tables):
    return N.conditional_information(t.sig.withColumn("z", F.col("t_idx").cast("double")).join(F.broadcast(t.trials), "trial"), ["freq"], "value", "z", "stim")


@query("permutation_mi", "I9", "node:long mi:double p:double")
def _(t: Tables):
    from ..operators.info import discrete_information

    d = t.act.join(F.broadcast(t.trials.select("trial", "stim")), "trial")
    return N.permutation_test(d, ["node"], "trial", "stim", lambda f, by: discrete_information(f, by, "active", "stim"), 50, 3)


@query("bootstrap_mean", "R1 I18 J15 D17", "node:long freq:string low:double mid:double high:double")
def _(t: Tables):
    return R.percentile_interval(R.bootstrap_means(t.sig, ["node", "freq"], "trial", 100, 1), ["node", "freq"])


@query("bootstrap_pearson", "I17", "node:long low:double high:double")
def _(t: Tables):
    from ..operators.aggregate import safe_corr

    x = t.sig.groupBy("node", "trial").agg(F.sum("value").alias("x"), F.sum(F.col("value") * F.col("t_idx")).alias("y"))
    drawn = R.bootstrap_rows(x, ["node"], "trial", 100, 2)
    return R.percentile_interval(drawn.groupBy("node", "boot").agg(safe_corr("x", "y").alias("mean")), ["node"])


@query("trial_swap_totals", "R2", "node:long freq:string total:double", "SELECT node, freq, sum(value) AS total FROM sig GROUP BY 1, 2")
def _(t: Tables):
    """The surrogate keeps each series' values; only their trials change."""
    return R.trial_swap(t.sig, ["node", "freq"], seed=4).groupBy("node", "freq").agg(F.sum("value").alias("total"))


@query("time_shuffle_totals", "R4 R6", "node:long freq:string trial:long total:double hi:double", "SELECT node, freq, trial, sum(value) AS total, max(value) AS hi FROM sig GROUP BY 1, 2, 3")
def _(t: Tables):
    return R.permuted(t.sig, ["node", "freq", "trial"], "t_idx", seed=6).groupBy("node", "freq", "trial").agg(F.sum("value").alias("total"), F.max("value").alias("hi"))


@query("frame_shuffle_counts", "R7", "freq:string t_idx:long n:long", "SELECT freq, t_idx, count(*) AS n FROM sig GROUP BY 1, 2")
def _(t: Tables):
    return R.trial_swap(t.sig, ["freq"], seed=8).groupBy("freq", "t_idx").agg(F.count("*").alias("n"))


@query("resampled_observations", "R5 B8", "node:long freq:string n:long", "SELECT node, freq, count(*) AS n FROM sig GROUP BY 1, 2")
def _(t: Tables):
    s = t.sig.withColumn("obs", F.col("trial") * 24 + F.col("t_idx"))
    return R.resampled_observations(s, ["node", "freq"], "obs", 9).groupBy("node", "freq").agg(F.count("*").alias("n"))


@query("kplet_shuffle_weights", "R9 S5", "freq:string trial:long t_idx:long weight:double n:long", "SELECT freq, trial, t_idx, weight, count(*) AS n FROM edge GROUP BY 1, 2, 3, 4")
def _(t: Tables):
    """The shuffle keeps every frame's multiset of weights."""
    s = R.kplet_shuffle(t.edge, ["freq", "trial", "t_idx"], 10, 11)
    return s.groupBy("freq", "trial", "t_idx", "weight").agg(F.count("*").alias("n"))


@query("rewired_degrees", "R8", "freq:string trial:long t_idx:long node:string degree:long", "SELECT freq, trial, t_idx, src AS node, count(*) AS degree FROM sides GROUP BY 1, 2, 3, 4")
def _(t: Tables):
    """Rewiring keeps every node's degree."""
    frame = ["freq", "trial", "t_idx"]
    return G.strength(G.both_sides(G.rewired(t.frames, frame, 2, 12)), frame)


@query("forest_decoding", "ML1 ML5", "fold:long accuracy:double")
def _(t: Tables):
    return M.forest_scores(t.table("embeddings"), "vec_id", "embedding", "label", folds=3, trees=5)


@query("cluster_silhouette", "ML2", "k:long silhouette:double")
def _(t: Tables):
    return M.cluster_sweep(t.table("embeddings"), "embedding", [2, 4])


@query("svm_decoding", "ML6", "accuracy:double")
def _(t: Tables):
    return M.linear_svm_score(t.table("embeddings").withColumn("odd", F.col("label") % 2), "vec_id", "embedding", "odd")


@query("tf_factors", "K34", "trial:long node:long component:long freq:double weight:double")
def _(t: Tables):
    tf = P.power(P.time_frequency(_signals(t), ["trial", "node"], FS, FREQS))
    return P.time_frequency_factors(tf, ["trial", "node"], 2)

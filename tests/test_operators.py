"""Micro fixtures with hand-made results, nulls and degenerate inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonframe.functions import scalars as S
from axonframe.operators import aggregate as A
from axonframe.operators import avalanche as V
from axonframe.operators import gaussian as N
from axonframe.operators import graph as G
from axonframe.operators import info as I
from axonframe.operators import pairs as P
from axonframe.operators import resample as R
from axonframe.operators import runs as U
from axonframe.operators import spectral as X
from axonframe.operators import stats as T
from axonframe.operators import timewin as W

TRAIN = [0, 1, 1, 0, 0, 1, 0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 1, 1, 1]


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame([(0, i, v) for i, v in enumerate(TRAIN)], "node long, t_idx long, active int")


def lengths(df):
    return sorted((r.start, r.end, r.len) for r in df.collect())


def test_runs(train):
    assert lengths(U.runs(train, ["node"])) == [(1, 3, 2), (5, 6, 1), (9, 17, 8), (20, 23, 3)]
    assert [n for _, _, n in lengths(U.runs(train, ["node"], value=0))] == [1, 2, 3, 3]


def test_masked_runs(train):
    first, second = F.col("t_idx") <= 11, F.col("t_idx") > 11
    sizes = lambda m, **k: [n for _, _, n in lengths(U.masked_runs(train, m, ["node"], **k))]
    assert sizes(first) == [2, 1, 3] and sizes(first, drop_edges=True) == [2, 1]
    assert sizes(second) == [5, 3] and sizes(second, drop_edges=True) == [3]


def test_burst_stats(train):
    r = U.burst_stats(U.runs(train, ["node"]), ["node"], 23).first()
    sd = math.sqrt(7.25)
    assert (r.mu, r.share) == (3.5, 14 / 23) and math.isclose(r.sd, sd) and math.isclose(r.burstiness, (sd - 3.5) / (sd + 3.5))


@pytest.mark.parametrize("x, y, want", [([0, 1, 0, 1], [0, 1, 0, 1], (1, 1, 1, 1)), ([0, 1, 0, 1], [0, 0, 1, 1], (1, 1, 2, 0)), ([1, 1, 1, 1], [0, 1, 0, 1], (0, 1, 1, 0))])
def test_binary_information(spark, x, y, want):
    r = I.mutual_information(spark.createDataFrame([(0, a, b) for a, b in zip(x, y)], "k int, x int, y int"), ["k"]).first()
    assert np.allclose((r.hx, r.hy, r.hxy, r.mi), want)


@pytest.fixture(scope="module")
def triangle(spark):
    return spark.createDataFrame([(0, "a", "b", 1.0), (0, "a", "c", 1.0), (0, "b", "c", 1.0), (0, "c", "d", 1.0)], "f long, src string, dst string, weight double")


def by_node(df, column):
    return {r.node: r[column] for r in df.collect()}


def test_triangle_with_pendant(triangle):
    sides = G.both_sides(triangle)
    assert by_node(G.strength(sides, ["f"]), "degree") == {"a": 2, "b": 2, "c": 3, "d": 1}
    assert np.allclose(sorted(by_node(G.clustering(sides, ["f"]), "clustering").items(), key=lambda x: x[0])[2][1], 1 / 3)
    assert by_node(G.frame_metric(triangle, ["f"], "coreness"), "coreness") == {"a": 2, "b": 2, "c": 2, "d": 1}
    assert by_node(G.frame_metric(triangle, ["f"], "betweenness"), "betweenness") == {"a": 0, "b": 0, "c": 4, "d": 0}
    assert by_node(G.frame_metric(triangle, ["f"], "efficiency"), "efficiency") == pytest.approx({"a": 1, "b": 1, "c": 1 / 3, "d": 0})
    assert by_node(G.frame_metric(triangle, ["f"], "closeness"), "closeness") == {"a": 4, "b": 4, "c": 3, "d": 5}
    with pytest.raises(ValueError):
        G.frame_metric(triangle, ["f"], "nothing")


def test_louvain_finds_cliques(spark):
    edges = [(0, f"{g}{i}", f"{g}{j}", 1.0) for g in "xy" for i in range(5) for j in range(i)] + [(0, "x0", "y0", 1.0)]
    df = spark.createDataFrame(edges, "f long, src string, dst string, weight double")
    group = by_node(G.frame_metric(df, ["f"], "louvain"), "louvain")
    assert len({group[f"x{i}"] for i in range(5)}) == 1 == len({group[f"y{i}"] for i in range(5)}) and group["x0"] != group["y0"]
    q = G.modularity(df, ["f"], lambda c: F.substring(c, 1, 1)).first().q
    assert math.isclose(q, 2 * (10 / 21 - (21 / 42) ** 2))


def raster(spark, active):
    return spark.createDataFrame([(0, n, t, 1) for n, t in active], "k long, node long, t_idx long, active int")


def test_supra_graph(spark):
    act = raster(spark, [(0, 0), (1, 0), (2, 2)])
    members = V.avalanches(V.supra_edges(act, ["k"], 2), ["k"]).collect()
    assert {(r.node, r.t_idx, r.av_node, r.av_t) for r in members} == {(0, 0, 0, 0), (1, 0, 0, 0), (0, 1, 0, 0), (1, 1, 0, 0)}
    strict = V.avalanches(V.supra_edges(act, ["k"], 2, strict=True), ["k"]).collect()
    assert {(r.node, r.t_idx) for r in strict} == {(0, 0), (1, 0)}


def test_coavalanche(spark):
    rows = [(0, 0, "A", 0), (0, 0, "B", 1), (0, 9, "B", 3), (0, 9, "C", 3), (0, 9, "A", 5)]
    m = spark.createDataFrame(rows, "k long, av_t long, area string, t_idx long").withColumn("av_node", F.lit(0))
    got = {(r.src, r.dst): (r.t, r.p) for r in V.coavalanche(m, ["k"], []).collect()}
    assert got == {("A", "B"): (1, 0.5), ("B", "A"): (1, 0.5), ("A", "C"): (0.5, 0), ("C", "A"): (0.5, 0.5), ("B", "C"): (0.5, 0), ("C", "B"): (0.5, 0)}


def test_branching(spark):
    rows = [(0, n, t) for t, k in ((2, 1), (3, 2), (5, 4)) for n in range(k)]
    r = V.sizes(spark.createDataFrame(rows, "k long, node long, t_idx long"), ["k"]).first()
    assert (r["size"], r.duration, r.branching) == (7, 4, 2.0)


def test_pair_order(spark):
    rows = spark.createDataFrame([("V1", "a3"), ("a46d", "a8")], "a string, b string")
    assert [tuple(r) for r in rows.select(*S.ordered_pair("a", "b")).collect()] == [("a3", "V1"), ("a46d", "a8")]


def test_mquantile_formula(spark):
    x = sorted([3.0, 1.0, 4.0, 1.5, 9.0, 2.6, 5.0])
    n, p = len(x), 0.9
    at = n * p + 0.4 + 0.2 * p
    k = int(min(max(at, 1), n - 1))
    g = min(max(at - k, 0), 1)
    r = A.mquantile(spark.createDataFrame([(0, v) for v in x], "k int, value double"), ["k"], p).first()
    assert math.isclose(r.thr, (1 - g) * x[k - 1] + g * x[k])


def test_degenerate_series(spark):
    flat = spark.createDataFrame([(0, "f", 0, t, 2.0) for t in range(4)] + [(1, "f", 0, t, float(t)) for t in range(4)], "node long, freq string, trial long, t_idx long, value double")
    z = W.zscore(flat).filter("node = 0").collect()
    assert all(r.z is None for r in z) and all(r.z == 0 for r in W.zscore(flat, empty=0.0).filter("node = 0").collect())
    assert P.pearson(flat, ["freq", "trial", "t_idx"], ["freq"]).first().r == 0
    assert A.histogram(flat.filter("node = 0"), ["node"], 5).first().n == 4
    assert U.runs(flat.withColumn("active", F.lit(0)), ["node"]).count() == 0


def test_nulls_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "x double")
    assert [r[0] for r in df.select(S.nz("x")).collect()] == [1.0, 0.0, 0.0]
    assert df.select(F.avg(S.clean("x"))).first()[0] == 1.0
    assert df.limit(1).select(S.sdiv(F.lit(1), F.lit(0))).first()[0] is None
    assert [r[0] for r in spark.createDataFrame([(p,) for p in (1e-5, 1e-3, 0.01, 0.05, 0.2)], "p double").select(S.stars("p")).collect()] == ["****", "***", "**", "*", "ns"]


def test_min_support_border(spark):
    df = spark.createDataFrame([("nine", 1.0)] * 9 + [("ten", 1.0)] * 10, "roi string, value double")
    assert [r.roi for r in A.min_support(df, ["roi"], 10).collect()] == ["ten"]


def test_epochs_overlap(spark):
    df = spark.createDataFrame([(0, t, float(t)) for t in range(6)], "node long, t_idx long, value double")
    got = {r.epoch: r["mean"] for r in A.epoch_average(df, {"a": (0, 3), "b": (2, 5)}, ["node"]).collect()}
    assert got == {"a": 1.5, "b": 3.5}


def test_statistics(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=40), rng.normal(0.8, 1, size=30)
    df = spark.createDataFrame([(0, 0, float(v)) for v in a] + [(0, 1, float(v)) for v in b], "k long, g long, value double")
    grid = np.sort(np.concatenate([a, b]))
    d = np.abs(np.searchsorted(np.sort(a), grid, "right") / 40 - np.searchsorted(np.sort(b), grid, "right") / 30).max()
    assert math.isclose(T.ks_statistic(df, ["k"], "g").first().d, d)
    pooled = (39 * a.var(ddof=1) + 29 * b.var(ddof=1)) / 68
    assert math.isclose(T.t_statistic(df, ["k"], "g").first().t, (b.mean() - a.mean()) / math.sqrt(pooled * (1 / 40 + 1 / 30)))
    assert T.mann_whitney(df, ["k"], "g").first().u == sum((y > a).sum() for y in b)
    q = sorted((r.p, r.q) for r in T.fdr(spark.createDataFrame([(0, p) for p in (0.01, 0.02, 0.03, 0.5)], "k long, p double"), ["k"]).collect())
    assert np.allclose([x for _, x in q], [0.04, 0.04, 0.04, 0.5])


def test_normal_quantile(spark):
    from statistics import NormalDist

    p = [0.001, 0.02, 0.3, 0.5, 0.9, 0.99, 0.9999]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in p], "p double").select(N.normal_quantile("p")).collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(v) for v in p], atol=1e-7)


def test_coherence_follows_coupling(spark):
    on = [X.autoregressive_pair(1000, 200.0, 0.9, 1e9, s) for s in range(6)]
    off = [X.autoregressive_pair(1000, 200.0, 0.0, 0.0, 100 + s) for s in range(6)]
    rows = [(k * 10 + s, n, x[n].tolist()) for k, group in enumerate((on, off)) for s, x in enumerate(group) for n in (0, 1)]
    df = spark.createDataFrame(rows, "trial long, node long, signal array<double>")
    tf = X.time_frequency(df, ["trial", "node"], 200.0, [35.0], cycles=6)
    coh = X.coherence(tf, ["trial", "freq"], "node").groupBy((F.col("trial") < 10).alias("on")).agg(F.avg("coherence").alias("c"))
    got = {r.on: r.c for r in coh.collect()}
    assert got[True] > got[False] + 0.1
    plv = X.phase_locking(tf, ["trial", "freq"], "node").collect()
    assert all(0 <= r.plv <= 1 for r in plv)
    gc = {(r.trial, r.src, r.dst): r.gc for r in N.granger(df, "trial", 2).collect()}
    assert all(gc[k, 1, 0] > 5 * gc[k, 0, 1] for k in range(6))


def test_phase_surrogates_keep_spectra(spark):
    x = np.random.default_rng(1).normal(size=(3, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, signal array<double>")
    y = {r.node: np.array(r.signal) for r in X.phase_randomised(df, ["node"], 5).collect()}
    for i, v in enumerate(x):
        assert np.allclose(np.abs(np.fft.rfft(v)), np.abs(np.fft.rfft(y[i]))) and not np.allclose(v, y[i])


def test_resampling_keeps_its_invariants(spark, triangle):
    df = spark.createDataFrame([(n, tr, t, float(n * 100 + tr * 10 + t)) for n in range(3) for tr in range(6) for t in range(4)], "node long, trial long, t_idx long, value double")
    swapped = R.trial_swap(df, ["node"], seed=1)
    by_trial = lambda d: sorted(tuple(sorted(r.v)) for r in d.groupBy("node", "trial").agg(F.collect_list("value").alias("v")).collect())
    assert by_trial(swapped) == by_trial(df) and swapped.exceptAll(df.select(swapped.columns)).count() > 0
    boots = R.bootstrap_means(df, ["node"], "trial", 200, 3)
    mid = {r.node: (r.low, r.mid, r.high) for r in R.percentile_interval(boots, ["node"]).collect()}
    assert all(lo < n * 100 + 26.5 < hi for n, (lo, _, hi) in mid.items())
    more = [(0, f"v{i}", f"v{j}", float(i + j)) for i in range(8) for j in range(i) if (i + j) % 3]
    g = triangle.sparkSession.createDataFrame(more, "f long, src string, dst string, weight double")
    assert by_node(G.strength(G.both_sides(G.rewired(g, ["f"], 5, 1)), ["f"]), "degree") == by_node(G.strength(G.both_sides(g), ["f"]), "degree")


def test_triggered_average_counts_missing_as_zero(spark):
    s = spark.createDataFrame([(0, t, 1.0) for t in range(4)], "k long, t_idx long, value double")
    e = spark.createDataFrame([(0, 0), (0, 3)], "k long, t_idx long")
    got = {r.offset: r["mean"] for r in W.triggered_average(s, e, 2, ["k"], ["k"]).collect()}
    assert got == {-2: 0.5, -1: 0.5, 0: 1.0, 1: 0.5}


def test_bootstrap_draws_whole_resamples(spark):
    units = spark.createDataFrame([("a", k, float(k)) for k in range(20)] + [("b", 0, 1.0)], "node string, trial long, x double")
    rows = R.bootstrap_rows(units, ["node"], "trial", 50, 1).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault((r.node, r.boot), []).append(r.x)
    assert len(sizes) == 100 and all(len(v) == (20 if k[0] == "a" else 1) for k, v in sizes.items())
    assert any(len(set(v)) < 20 for k, v in sizes.items() if k[0] == "a")
    assert sum(map(sum, (v for k, v in sizes.items() if k[0] == "a"))) / 1000 == pytest.approx(9.5, abs=1)


def test_generated_coupling_shows(spark, small):
    from axonframe.plans import REGISTRY

    c = {(r.window, r.freq): r.coherence for r in REGISTRY["coupled_pair"](spark, small).collect()}
    assert all(c[0, f] > c[1, f] for f in (20.0, 28.0))

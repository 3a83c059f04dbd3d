"""Surrogates move what they say and nothing else; spectra and scans against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonframe.operators import resample as R
from axonframe.operators import spectral as P
from axonframe.sources.files import read_sessions


@pytest.fixture(scope="module")
def signals(spark):
    rng = np.random.default_rng(5)
    rows = [(t, n, rng.normal(size=32).tolist()) for t in range(6) for n in range(3)]
    return rows, spark.createDataFrame(rows, "trial long, node long, signal array<double>").repartition(4)


def test_phases_are_drawn_for_each_trial(signals):
    rows, df = signals
    got = {(r.trial, r.node): np.fft.rfft(r.signal) for r in P.phase_randomised(df, ["trial", "node"], 7).collect()}
    own = {(t, n): np.fft.rfft(s) for t, n, s in rows}
    turn = {k: np.angle(got[k][1:-1] / own[k][1:-1]) for k in own}
    for (t, n), f in got.items():
        assert np.allclose(abs(f), abs(own[t, n])) and np.allclose(turn[t, n], turn[t, 0]) and np.allclose(f[[0, -1]], own[t, n][[0, -1]])
        assert np.abs(turn[t, n]).max() > 0.1
    assert all(not np.allclose(turn[a, 0], turn[b, 0]) for a in range(6) for b in range(a))


def test_multitaper_against_numpy(signals):
    rows, df = signals
    tapers = P.sine_tapers(32, 4)
    assert np.allclose(tapers @ tapers.T, np.eye(4))
    got = {(r.trial, r.node, r.k): r.psd for r in P.periodogram(df, ["trial", "node"], 200.0, tapers=4).collect()}
    for t, n, s in rows:
        x = np.array(s) - np.mean(s)
        want = sum(np.abs(np.fft.rfft(x * w)) ** 2 for w in tapers) / 4 / 200.0
        want[1:-1] *= 2
        assert np.allclose([got[t, n, k] for k in range(17)], want)


@pytest.fixture(scope="module")
def series(spark):
    rows = [(n, t, k, float(100 * n + 10 * t + k) + 0.5) for n in range(3) for t in range(8) for k in range(6)]
    return rows, spark.createDataFrame(rows, "node long, trial long, t_idx long, value double").repartition(5)


def test_trial_swap_moves_whole_trials(series):
    rows, df = series
    got = {(r.node, r.trial, r.t_idx): r.value for r in R.trial_swap(df, ["node"], seed=4).collect()}
    was = {(n, t, k): v for n, t, k, v in rows}
    assert sorted(got) == sorted(was) and got != was
    moves = set()
    for n in range(3):
        to = {t: {int(got[n, t, k] - 100 * n - k) // 10 for k in range(6)} for t in range(8)}
        assert all(len(s) == 1 for s in to.values()) and sorted(min(s) for s in to.values()) == list(range(8))
        moves.add(tuple(min(to[t]) for t in range(8)))
    assert len(moves) > 1  # each series for itself


def test_permuted_times_move_within_their_trial(series):
    rows, df = series
    got = {(r.node, r.trial, r.t_idx): r.value for r in R.permuted(df, ["node", "trial"], "t_idx", seed=6).collect()}
    moved = 0
    for n in range(3):
        for t in range(8):
            now, was = [got[n, t, k] for k in range(6)], [100.0 * n + 10 * t + k + 0.5 for k in range(6)]
            assert sorted(now) == was
            moved += now != was
    assert moved >= 20


def test_resampled_observations_are_draws_with_replacement(series):
    rows, df = series
    got = R.resampled_observations(df.withColumn("obs", F.col("trial") * 6 + F.col("t_idx")), ["node"], "obs", 9).collect()
    for n in range(3):
        drawn = [r.value for r in got if r.node == n]
        assert len(drawn) == 48 and set(drawn) <= {v for m, _, _, v in rows if m == n} and len(set(drawn)) < 48


def test_kplet_shuffle_keeps_neighbouring_weights_together(spark):
    edges = [(f, f"a{i}", f"b{i}", float(i)) for f in range(4) for i in range(30)]
    df = spark.createDataFrame(edges, "t_idx long, src string, dst string, weight double")
    got = {(r.t_idx, r.src): r.weight for r in R.kplet_shuffle(df, ["t_idx"], 10, 11).collect()}
    was = {(f, s): w for f, s, _, w in edges}
    assert got.keys() == was.keys() and sum(got[k] != was[k] for k in was) > 60 and all(got[k] // 10 == was[k] // 10 for k in was)
    assert all(sorted(v for (f, _), v in got.items() if f == g) == [float(i) for i in range(30)] for g in range(4))


def test_sessions_that_are_not_there_are_skipped(spark, tmp_path):
    for k in (1, 3):
        spark.range(k).selectExpr("id", f"{k} AS session").write.parquet(str(tmp_path / f"s{k}"))
    paths = [str(tmp_path / f"s{k}") for k in (1, 2, 3)]
    assert read_sessions(spark, paths).count() == 4
    assert read_sessions(spark, paths[1:2], "id long, session int").count() == 0
    with pytest.raises(FileNotFoundError):
        read_sessions(spark, paths[1:2])


def test_trial_coherence_and_cross_frequency_against_numpy(spark, signals):
    rows, df = signals
    tf = P.time_frequency(df, ["trial", "node"], 200.0, [20.0, 45.0]).cache()
    z = {(r.trial, r.node, r.freq, r.t_idx): complex(r.re, r.im) for r in tf.collect()}
    freqs, times = sorted({k[2] for k in z}), sorted({k[3] for k in z})
    got = {(r.freq, r.t_idx, r.src, r.dst): r.coherence for r in P.coherence(tf, ["trial", "freq"], "node", by=["freq", "t_idx"]).collect()}
    assert len(got) == len(freqs) * len(times) * 3
    for (f, t, a, b), c in got.items():
        x, y = (np.array([z[k, n, f, t] for k in range(6)]) for n in (a, b))
        assert c == pytest.approx(abs((x * y.conj()).mean()) ** 2 / ((abs(x) ** 2).mean() * (abs(y) ** 2).mean()))
    for r in P.cross_frequency(tf, ["trial", "node"]).collect():
        x, y = (np.array([z[r.trial, r.node, f, t] for t in times]) for f in (r.fa, r.fb))
        assert r.r == pytest.approx(np.corrcoef(abs(x), abs(y))[0, 1]) and r.plv == pytest.approx(abs(np.exp(1j * (np.angle(x) - np.angle(y))).mean()))


def test_rate_modulation_index_tells_stimuli_apart(spark):
    from axonframe.plans import REGISTRY

    class Fixture:
        act = spark.createDataFrame([(n, "f", t, k, int(n == 1 and t % 2 == 0)) for n in (0, 1) for t in range(40) for k in range(3)], "node long, freq string, trial long, t_idx long, active long")
        trials = spark.createDataFrame([(t, t % 2) for t in range(40)], "trial long, stim long")

    got = {r.node: r.rmi for r in REGISTRY["rate_modulation_index"].plan(Fixture).collect()}
    assert got == {0: 0.0, 1: 1.0}


def test_surrogate_thresholds_whole_and_without_rows_of_samples(spark):
    from axonframe.plans import REGISTRY
    from axonframe.plans.kernels import FREQS, FS, _signals

    rng = np.random.default_rng(8)
    rows = [(v, rng.normal(size=64).astype("f4").tolist()) for v in range(-5, 63) if v not in (17, 44)]
    rows += [(12, rng.normal(size=64).tolist()), (70, [0.0] * 64), (71, [1.0] * 64), (79, [0.0] * 64), (None, [1.0] * 64)]
    rows += [(v, rows[8][1]) for v in range(80, 90)]  # copies
    schema = "vec_id long, embedding array<float>"
    keys = ["trial", "node"]

    class Fixture:
        embeddings = spark.createDataFrame(rows, schema).repartition(3)
        table = staticmethod(lambda name: Fixture.embeddings)

    def found(df):
        return {(r.freq, r.src, r.dst): r.threshold for r in df.collect()}

    def plain(signals, seeds, share):
        some = None
        for seed in range(seeds):
            drawn = P.phase_randomised(signals, keys, seed, trial=keys)
            c = P.coherence(P.time_frequency(drawn, keys, FS, FREQS), ["trial", "freq"], "node")
            some = c if some is None else some.unionByName(c)
        return found(some.groupBy("freq", "src", "dst").agg(F.percentile("coherence", F.lit(share)).alias("threshold")))

    want = plain(_signals(Fixture), 5, 0.95)
    Fixture.embeddings = Fixture.embeddings.union(spark.createDataFrame([(5, None)], schema))  # takes no part
    df = REGISTRY["coherence_surrogates"].plan(Fixture)
    assert found(df) == pytest.approx(want, abs=1e-9) and len(want) > 180
    # Every sample of every pair and seed was a row that moved before.
    assert "t_idx" not in df._jdf.queryExecution().executedPlan().toString()
    # Undefined and NaN coherences, and all alike.
    odd = [(t, n, [0.0] * 16 if n == 2 else [float("nan")] * 16 if n == 3 and t < 4 else [1.0] + [0.0] * 15) for t in range(5) for n in range(4)]
    odd = spark.createDataFrame(odd, "trial long, node long, signal array<double>")
    got, want = found(P.surrogate_coherence_quantile(odd, keys, FS, FREQS, 2, 0.5)), plain(odd, 2, 0.5)
    assert got.keys() == want.keys() and len(got) == 24
    for k, v in want.items():
        assert v is got[k] is None or got[k] == pytest.approx(v, abs=1e-9, nan_ok=True)
    assert None in want.values() and any(v is not None and np.isnan(v) for v in want.values())
    assert found(P.surrogate_coherence_quantile(odd.limit(0), keys, FS, FREQS, 2, 0.5)) == {}

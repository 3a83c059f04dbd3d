"""Spectral kernels on whole signals (array<double>), in Arrow batches of numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import sdiv
from .aggregate import safe_corr


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column.to_pylist()]) if len(column) else np.zeros((0, 1))


def morlet(x: np.ndarray, fs: float, freqs: np.ndarray, cycles: float) -> np.ndarray:
    """(signals, freqs, samples) complex coefficients of unit-energy Morlet wavelets."""
    n = x.shape[1]
    size = 2 * n
    spectrum, w = np.fft.fft(x, size), np.fft.fftfreq(size, 1 / fs)
    out = []
    for f in freqs:
        width = f / cycles
        kernel = np.where(w > 0, np.exp(-0.5 * ((w - f) / width) ** 2), 0) * 2
        out.append(np.fft.ifft(spectrum * kernel)[:, :n])
    return np.stack(out, axis=1)


def analytic(x: np.ndarray, fs: float, low: float, high: float) -> np.ndarray:
    """Analytic signal of a band, by masking the spectrum."""
    w = np.fft.fftfreq(x.shape[1], 1 / fs)
    mask = np.where((w >= low) & (w <= high), np.where(w > 0, 2.0, 1.0), 0.0)
    return np.fft.ifft(np.fft.fft(x) * mask)


def _long(kernel, freqs: list[float], columns: list[str]):
    """Signals to rows (keys, freq, t_idx, re, im)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                c = kernel(_matrix(some.column("signal")))
                n, nf, nt = c.shape
                take = pa.array(np.repeat(np.arange(n), nf * nt))
                keys = [some.column(k).take(take) for k in columns]
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(np.tile(np.repeat(np.array(freqs, dtype=float), nt), n)), pa.array(np.tile(np.arange(nt), n * nf)), pa.array(c.real.ravel()), pa.array(c.imag.ravel())],
                    [*columns, "freq", "t_idx", "re", "im"],
                )

    return run


def time_frequency(signals: DataFrame, keys: list[str], fs: float, freqs: list[float], mode: str = "morlet", cycles: float = 5.0, bandwidth: float = 4.0) -> DataFrame:
    """``signals`` (keys, signal array) to (keys, freq, t_idx, re, im)."""
    f = np.array(freqs, dtype=float)
    if mode == "morlet":
        kernel = lambda x: morlet(x, fs, f, cycles)
    elif mode == "hilbert":
        kernel = lambda x: np.stack([analytic(x, fs, max(0.0, v - bandwidth), v + bandwidth) for v in f], axis=1)
    else:
        raise ValueError(mode)
    types = dict(signals.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["freq double, t_idx long, re double, im double"])
    return signals.select(*keys, "signal").mapInArrow(_long(kernel, freqs, keys), schema)


def power(tf: DataFrame) -> DataFrame:
    return tf.withColumn("value", F.col("re") * F.col("re") + F.col("im") * F.col("im"))


def sine_tapers(n: int, many: int) -> np.ndarray:
    """The first orthonormal sine tapers of n samples."""
    return np.sqrt(2 / (n + 1)) * np.sin(np.pi * np.outer(np.arange(1, many + 1), np.arange(1, n + 1)) / (n + 1))


def periodogram(signals: DataFrame, keys: list[str], fs: float, tapers: int | None = None) -> DataFrame:
    """Power spectral density of demeaned signals: (keys, k, freq, psd); Hann-tapered, or
    the mean over so many sine ``tapers``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("signal"))
            n = x.shape[1]
            shapes = sine_tapers(n, tapers) if tapers else np.hanning(n + 2)[None, 1:-1]
            p = np.mean([np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * s)) ** 2 / (fs * (s**2).sum()) for s in shapes], axis=0)
            p[:, 1 : (n + 1) // 2] *= 2
            m = p.shape[1]
            take = pa.array(np.repeat(np.arange(len(x)), m))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).take(take) for k in keys], pa.array(np.tile(np.arange(m), len(x))), pa.array(np.tile(np.arange(m) * fs / n, len(x))), pa.array(p.ravel())], [*keys, "k", "freq", "psd"]
            )

    types = dict(signals.dtypes)
    return signals.select(*keys, "signal").mapInArrow(run, ", ".join([f"{k} {types[k]}" for k in keys] + ["k long, freq double, psd double"]))


def _tf_pairs(tf: DataFrame, frame: list[str], node: str) -> DataFrame:
    a = tf.select(*frame, "t_idx", F.col(node).alias("src"), F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = tf.select(*frame, "t_idx", F.col(node).alias("dst"), F.col("re").alias("br"), F.col("im").alias("bi"))
    return a.join(b, [*frame, "t_idx"]).filter("src < dst")


def coherence(tf: DataFrame, frame: list[str], node: str, by: list[str] | None = None) -> DataFrame:
    """|S(xy)|^2 / (S(xx) S(yy)), S averaged over the frame's samples, or over all that
    agree in ``by`` (such as frequency and time: the trials)."""
    p = _tf_pairs(tf, frame, node)
    re, im = F.avg(F.col("ar") * F.col("br") + F.col("ai") * F.col("bi")), F.avg(F.col("ai") * F.col("br") - F.col("ar") * F.col("bi"))
    sx, sy = F.avg(F.col("ar") * F.col("ar") + F.col("ai") * F.col("ai")), F.avg(F.col("br") * F.col("br") + F.col("bi") * F.col("bi"))
    return p.groupBy(*(by or frame), "src", "dst").agg(sdiv(re * re + im * im, sx * sy).alias("coherence"))


def cross_frequency(tf: DataFrame, frame: list[str], freq: str = "freq") -> DataFrame:
    """(frame, fa, fb, r, plv): correlation of amplitudes and locking of phases of a
    signal's own frequencies fa < fb over its samples."""
    a = tf.select(*frame, "t_idx", F.col(freq).alias("fa"), F.hypot("re", "im").alias("x"), F.atan2("im", "re").alias("p"))
    b = tf.select(*frame, "t_idx", F.col(freq).alias("fb"), F.hypot("re", "im").alias("y"), F.atan2("im", "re").alias("q"))
    both = a.join(b, [*frame, "t_idx"]).filter("fa < fb").withColumn("d", F.col("p") - F.col("q"))
    locked = F.sqrt(F.pow(F.avg(F.cos("d")), 2) + F.pow(F.avg(F.sin("d")), 2))
    return both.groupBy(*frame, "fa", "fb").agg(safe_corr("x", "y").alias("r"), locked.alias("plv"))


def phase_locking(tf: DataFrame, frame: list[str], node: str) -> DataFrame:
    """|mean exp(i (phase_x - phase_y))|."""
    p = _tf_pairs(tf, frame, node).withColumn("d", F.atan2("ai", "ar") - F.atan2("bi", "br"))
    return p.groupBy(*frame, "src", "dst").agg(F.sqrt(F.pow(F.avg(F.cos("d")), 2) + F.pow(F.avg(F.sin("d")), 2)).alias("plv"))


def _names(batch: pa.RecordBatch, columns: list[str]) -> list[str]:
    return ["\x1f".join(map(str, row)) for row in zip(*(batch.column(k).to_pylist() for k in columns))]


def _turned(x: np.ndarray, names: list[str], seed: int) -> np.ndarray:
    """The signals ``x`` with random phases, one set for each name."""
    n = x.shape[1]
    drawn = {name: np.random.default_rng([seed, n, *name.encode()]).random(n // 2 + 1) for name in set(names)}
    turn = np.exp(2j * np.pi * np.array([drawn[name] for name in names]).reshape(len(names), n // 2 + 1))
    turn[:, 0] = 1
    if n % 2 == 0:
        turn[:, -1] = 1
    return np.fft.irfft(np.fft.rfft(x) * turn, n)


def phase_randomised(signals: DataFrame, keys: list[str], seed: int, trial: list[str] | None = None) -> DataFrame:
    """Surrogates with each signal's amplitudes and random phases, one set for all signals
    of a ``trial`` (columns of ``keys``; the first if none are named), so that spectra and
    the cross-spectra within a trial stay."""
    trial = trial or keys[:1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("signal"))
            y = _turned(x, _names(batch, trial), seed)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(list(y), pa.list_(pa.float64()))], [*keys, "signal"])

    types = dict(signals.dtypes)
    return signals.select(*keys, "signal").mapInArrow(run, ", ".join([f"{k} {types[k]}" for k in keys] + ["signal array<double>"]))


#: Coherences lie in so many bins between 0 and 1; bytes of coefficients held at a time; and
#: how far apart two computations of one coherence may be.
BINS, HELD, SLACK = 256, 1 << 24, 1e-9


def _whole_trials(batches: Iterator[pa.RecordBatch], trial: str) -> Iterator[pa.RecordBatch]:
    """Batches sorted by ``trial``, cut where a trial ends."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = batch.column(trial).to_numpy(zero_copy_only=False)
        at = int(np.searchsorted(t, t[-1]))  # the last trial may go on
        if at or (rest and rest[-1].column(trial)[0].as_py() != t[0]):
            yield pa.concat_batches([*rest, batch.slice(0, at)])
            rest = []
        rest.append(batch.slice(at))
    if rest:
        yield pa.concat_batches(rest)


def _surrogate_coherences(batches: Iterator[pa.RecordBatch], keys: list[str], fs: float, freqs: np.ndarray, seeds: int, cycles: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, src, dst, freq, coherence) of some whole trials and one seed at a time: places
    of both nodes and of the frequency, and NaN or, for an undefined quotient, -1."""
    for batch in _whole_trials(batches, keys[0]):
        trials = batch.column(keys[0]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], trials[1:] != trials[:-1]]))
        wide = len(np.unique(batch.column(keys[1]).to_numpy(zero_copy_only=False)))
        flat = batch.column("signal").flatten().to_numpy(zero_copy_only=False).astype(float)
        if len(flat) % batch.num_rows or len(batch.column("signal").value_lengths().unique()) > 1:
            raise ValueError("signals must have one length")
        x = flat.reshape(batch.num_rows, -1)
        step = max(1, HELD // (16 * len(freqs) * wide * max(1, x.shape[1])))
        for first in range(0, len(starts), step):
            a, b = starts[first], starts[first + step] if first + step < len(starts) else len(x)
            names, own = _names(batch.slice(a, b - a), keys), trials[a:b]
            t = np.cumsum(np.concatenate([[False], own[1:] != own[:-1]]))
            nodes, at = np.unique(batch.column(keys[1]).to_numpy(zero_copy_only=False)[a:b], return_inverse=True)
            many = np.zeros((t[-1] + 1, len(nodes)))
            np.add.at(many, (t, at), 1)
            # Pairs of nodes that meet in a trial.
            i, j = np.triu_indices(len(nodes), 1)
            where, pair = np.nonzero((many[:, i] > 0) & (many[:, j] > 0))
            i, j = i[pair], j[pair]
            if not len(i):
                continue
            for seed in range(seeds):
                c = morlet(_turned(x[a:b], names, seed), fs, freqs, cycles)
                z = np.zeros((*many.shape, *c.shape[1:]), dtype=complex)
                p = np.zeros((*many.shape, len(freqs)))
                power = np.mean(c.real**2 + c.imag**2, axis=2)
                if many.max() > 1:  # rows of one trial and node count alike
                    np.add.at(z, (t, at), c / many[t, at][:, None, None])
                    np.add.at(p, (t, at), power / many[t, at][:, None])
                else:
                    z[t, at], p[t, at] = c, power
                z = z.transpose(0, 2, 1, 3)
                s = z @ z.conj().transpose(0, 1, 3, 2) / x.shape[1]
                num, den = np.abs(s[where, :, i, j]) ** 2, p[where, i] * p[where, j]
                with np.errstate(all="ignore"):
                    found = np.where(den == 0, -1.0, num / den)
                yield nodes, np.repeat(i, len(freqs)), np.repeat(j, len(freqs)), np.tile(np.arange(len(freqs)), len(i)), found.ravel()


def surrogate_coherence_quantile(signals: DataFrame, keys: list[str], fs: float, freqs: list[float], seeds: int, share: float, cycles: float = 5.0) -> DataFrame:
    """(freq, src, dst, threshold): the exact quantile ``share``, interpolated, over ``keys[0]``
    (trials) and seeds, of the coherence of nodes ``keys[1]`` whose phases are drawn for each
    signal alone. The same as ``coherence`` of ``phase_randomised`` signals and a percentile.

    Coherences are many times the signals: they are worked out trial by trial twice and never
    moved. First they are counted in bins; then those in the bins of the ranks sought, with
    the number below, are sorted. What is collected is one row for each frequency and pair
    of nodes. Null keys or signals take no part; undefined coherences are left out, and a
    pair without any has a null threshold; NaN ranks last, as in percentiles."""
    trial, node = keys
    f, types = np.array(freqs, dtype=float), dict(signals.dtypes)
    dealt = signals.select(*keys, "signal").dropna().repartition(trial).sortWithinPartitions(*keys)
    pair = f"src {types[node]}, dst {types[node]}"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, i, j, k, c in _surrogate_coherences(batches, keys, fs, f, seeds, cycles):
            b = np.where(c < 0, -1, np.where(np.isnan(c), BINS - 1, np.minimum(c * BINS, BINS - 1))).astype(int)
            code, n = np.unique(((i * len(nodes) + j) * len(f) + k) * (BINS + 1) + b + 1, return_counts=True)
            code, b = np.divmod(code, BINS + 1)
            code, k = np.divmod(code, len(f))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (nodes[code // len(nodes)], nodes[code % len(nodes)], k, b - 1, n)], ["src", "dst", "k", "bin", "n"])

    bins = dealt.mapInArrow(counted, f"{pair}, k long, bin long, n long").groupBy("src", "dst", "k", "bin").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("src", "dst", "k")
    defined = F.when(F.col("bin") >= 0, F.col("n"))
    bins = bins.withColumn("total", F.sum(defined).over(own)).withColumn("upto", F.sum(defined).over(own.orderBy("bin")))
    rank = (F.col("total") - 1) * F.lit(share)
    of = [F.min(F.when(F.col("upto") > edge(rank), F.col("bin"))) for edge in (F.floor, F.ceil)]
    sought = bins.groupBy("src", "dst", "k").agg(F.max("total").alias("total"), of[0].alias("low"), of[1].alias("high")).collect()
    # Bounds of what is kept: a little wider, as two computations may differ in the last place.
    bounds = {(r.src, r.dst, r.k): (g, r.low / BINS - SLACK, np.inf if r.high == BINS - 1 else (r.high + 1) / BINS + SLACK) for g, r in enumerate(sought) if r.total}

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, i, j, k, c in _surrogate_coherences(batches, keys, fs, f, seeds, cycles):
            code, at = np.unique((i * len(nodes) + j) * len(f) + k, return_inverse=True)
            names = nodes.tolist()
            none = (-1, np.inf, np.inf)
            g, low, high = (np.array(v) for v in zip(*(bounds.get((names[q // len(f) // len(names)], names[q // len(f) % len(names)], q % len(f)), none) for q in code.tolist())))
            below = np.bincount(at[(c >= 0) & (c < low[at])], minlength=len(code))
            take = (g[at] >= 0) & ((c >= low[at]) & (c >= 0) & (c <= high[at]) | np.isnan(c) & np.isinf(high[at]))
            some = np.flatnonzero(below)
            # Those below as one, with their number: nothing comes before them.
            value = np.concatenate([np.full(len(some), -1.0), c[take]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([g[some], g[at[take]]])), pa.array(value), pa.array(np.concatenate([below[some], np.ones(take.sum(), dtype=int)]))], ["g", "value", "n"])

    spark = signals.sparkSession
    groups = spark.createDataFrame([(g, float(f[r.k]), r.src, r.dst, r.total) for g, r in enumerate(sought)], f"g long, freq double, {pair}, total long")
    values = dealt.mapInArrow(kept, "g long, value double, n long").groupBy("g", "value").agg(F.sum("n").alias("n"))
    values = values.withColumn("upto", F.sum("n").over(Window.partitionBy("g").orderBy("value"))).join(F.broadcast(groups), "g")
    low, high = (F.min(F.when(F.col("upto") > edge(rank), F.col("value"))) for edge in (F.floor, F.ceil))
    ends = values.groupBy("g").agg(low.alias("low"), high.alias("high"), F.first(rank).alias("rank"))
    between = (F.ceil("rank") - F.col("rank")) * F.col("low") + (F.col("rank") - F.floor("rank")) * F.col("high")
    ends = ends.select(F.col("g").alias("h"), F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between).alias("threshold"))
    return groups.join(ends, F.col("g") == F.col("h"), "left").select("freq", "src", "dst", "threshold")


def autoregressive_pair(n: int, fs: float, coupling: float, until: float, seed: int) -> np.ndarray:
    """Two AR(2) channels, the first driven by the second while t <= until: ground truth."""
    rng = np.random.default_rng(seed)
    x = np.zeros((2, n))
    e = rng.normal(size=(2, n))
    for t in range(2, n):
        x[:, t] = 0.55 * x[:, t - 1] - 0.8 * x[:, t - 2] + e[:, t]
        x[0, t] += (coupling if t / fs <= until else 0.0) * x[1, t - 1]
    return x


def factorised(x: np.ndarray, k: int, rounds: int = 200, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative factors (w, h) of x by multiplicative updates."""
    rng = np.random.default_rng(seed)
    w, h = rng.random((x.shape[0], k)) + 0.1, rng.random((k, x.shape[1])) + 0.1
    for _ in range(rounds):
        h *= (w.T @ x) / (w.T @ w @ h + 1e-12)
        w *= (x @ h.T) / (w @ h @ h.T + 1e-12)
    return w, h


def time_frequency_factors(maps: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Time-frequency maps (keys, freq, t_idx, value) to (keys, component, freq, weight): one
    map is one Arrow group, bounded by the recording's axes."""
    types = dict(maps.dtypes)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        freq, t = (table.column(c).to_numpy() for c in ("freq", "t_idx"))
        names, i = np.unique(freq, return_inverse=True)
        x = np.zeros((len(names), len(np.unique(t))))
        x[i, np.unique(t, return_inverse=True)[1]] = table.column("value").to_numpy()
        w, _ = factorised(x, k)
        n = w.size
        out = {c: pa.array([v.as_py()] * n, table.schema.field(c).type) for c, v in zip(keys, key)}
        return pa.table(out | {"component": pa.array(np.tile(np.arange(k), len(names))), "freq": pa.array(np.repeat(names, k)), "weight": pa.array(w.ravel())})

    schema = ", ".join([f"{c} {types[c]}" for c in keys] + ["component long, freq double, weight double"])
    return maps.select(*keys, "freq", "t_idx", "value").groupBy(*keys).applyInArrow(run, schema)

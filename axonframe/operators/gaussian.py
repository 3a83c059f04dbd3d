"""Gaussian-copula information and permutation tests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fraction
from .stats import mean_ranks


def normal_quantile(p) -> "F.Column":
    """Inverse normal distribution by a rational approximation (error below 1.2e-9)."""
    # Coefficients of the rational approximation.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
    p = F.col(p) if isinstance(p, str) else p

    def poly(coefficients, x, last=None):
        out = F.lit(coefficients[0])
        for k in coefficients[1:]:
            out = out * x + k
        return out if last is None else out * x + last

    q, r = p - 0.5, (p - 0.5) * (p - 0.5)
    middle = poly(a, r) * q / poly(b, r, 1.0)
    tail = lambda t: poly(c, t) / poly(d, t, 1.0)
    low, high = F.sqrt(-2 * F.ln(p)), F.sqrt(-2 * F.ln(1 - p))
    return F.when(p < 0.02425, tail(low)).when(p > 1 - 0.02425, -tail(high)).otherwise(middle)


def copula_normal(df: DataFrame, by: list[str], value: str = "value", name: str = "g") -> DataFrame:
    """Values to standard normal scores of their ranks."""
    w = Window.partitionBy(*by)
    r = mean_ranks(df.withColumn("_n", F.count("*").over(w)), by, value, "_r")
    return r.withColumn(name, normal_quantile(F.col("_r") / (F.col("_n") + 1))).drop("_r", "_n")


def gaussian_information(df: DataFrame, by: list[str], label: str, value: str = "g") -> DataFrame:
    """MI (bits) of a continuous and a discrete variable from group variances."""
    per = df.groupBy(*by, label).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    var = F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(1e-12))
    tot = per.groupBy(*by).agg(F.sum("n").alias("N"), F.sum("s").alias("S"), F.sum("q").alias("Q"), F.sum(F.col("n") * F.log2(var)).alias("inner"))
    whole = F.greatest(F.col("Q") / F.col("N") - F.pow(F.col("S") / F.col("N"), 2), F.lit(1e-12))
    return tot.select(*by, (0.5 * (F.log2(whole) - F.col("inner") / F.col("N"))).alias("mi"))


def conditional_information(df: DataFrame, by: list[str], x: str, z: str, label: str) -> DataFrame:
    """MI of x and a discrete label given z, all Gaussian within labels: half the log ratio
    of residual variances of x on z, over all and within labels."""

    def residual(keys: list[str], name: str) -> DataFrame:
        m = df.groupBy(*keys).agg(F.count("*").alias("n"), F.var_pop(x).alias("vx"), F.var_pop(z).alias("vz"), F.covar_pop(x, z).alias("c"))
        return m.select(*keys, "n", F.log2(F.greatest(F.col("vx") - F.try_divide(F.col("c") * F.col("c"), F.col("vz")), F.lit(1e-12))).alias(name))

    inner = residual([*by, label], "h").groupBy(*by).agg((F.sum(F.col("n") * F.col("h")) / F.sum("n")).alias("inner"))
    return residual(by, "whole").join(inner, by).select(*by, (0.5 * (F.col("whole") - F.col("inner"))).alias("cmi"))


def permutation_test(df: DataFrame, by: list[str], unit: str, label: str, statistic, n_perm: int, seed: int) -> DataFrame:
    """p = (1 + permutations at least as large) / (1 + n): labels are permuted over units on
    the small unit table, once for each permutation, and joined. ``statistic`` maps (frame,
    keys) to a frame with those keys and ``mi``."""
    units = df.select(unit, label).distinct()
    perms = units.crossJoin(units.sparkSession.range(n_perm).select(F.col("id").alias("perm")))
    a = perms.withColumn("_a", F.row_number().over(Window.partitionBy("perm").orderBy(unit)))
    b = perms.withColumn("_a", F.row_number().over(Window.partitionBy("perm").orderBy(fraction(F.lit(seed), "perm", unit), unit))).select("perm", "_a", F.col(label).alias("_l"))
    shuffled = a.join(b, ["perm", "_a"]).select("perm", unit, F.col("_l").alias(label))
    null = statistic(df.drop(label).join(F.broadcast(shuffled), unit), [*by, "perm"]).withColumnRenamed("mi", "null")
    real = statistic(df, by)
    return null.join(real, by).groupBy(*by).agg(F.first("mi").alias("mi"), ((F.sum((F.col("null") >= F.col("mi")).cast("long")) + 1) / (F.count("*") + 1)).alias("p"))


def granger(signals: DataFrame, key: str, order: int) -> DataFrame:
    """Log ratio of residual variances of src -> dst for every ordered pair of a group's
    signals (rows: key, node, signal)."""

    def run(k: tuple, table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        x = np.stack([np.asarray(v, dtype=float) for v in table.column("signal").to_pylist()])
        x = x - x.mean(axis=1, keepdims=True)
        n = x.shape[1]
        past = [np.stack([s[order - j - 1 : n - j - 1] for j in range(order)], 1) for s in x]
        rows = []
        for j, dst in enumerate(nodes):
            y = x[j, order:]
            own = y - past[j] @ np.linalg.lstsq(past[j], y, rcond=None)[0]
            for i, src in enumerate(nodes):
                if i != j:
                    both = np.concatenate([past[j], past[i]], 1)
                    full = y - both @ np.linalg.lstsq(both, y, rcond=None)[0]
                    rows.append((src, dst, float(np.log(max(own.var(), 1e-300) / max(full.var(), 1e-300)))))
        out = {key: pa.array([k[0].as_py()] * len(rows), table.schema.field(key).type)}
        return pa.table(out | {"src": pa.array([r[0] for r in rows], pa.int64()), "dst": pa.array([r[1] for r in rows], pa.int64()), "gc": pa.array([r[2] for r in rows], pa.float64())})

    kind = dict(signals.dtypes)[key]
    return signals.select(key, "node", "signal").groupBy(key).applyInArrow(run, f"{key} {kind}, src long, dst long, gc double")

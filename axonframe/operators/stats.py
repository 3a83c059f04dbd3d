"""Test statistics as grouped windows; p-values where they have a closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import sdiv


def ks_statistic(df: DataFrame, by: list[str], group: str, value: str = "value") -> DataFrame:
    """Largest gap of the two groups' (0/1) empirical distributions, and the asymptotic
    two-sided p."""
    w = Window.partitionBy(*by).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    n = lambda g: F.sum((F.col(group) == g).cast("double"))
    c = df.withColumn("_a", n(0).over(w)).withColumn("_b", n(1).over(w))
    tot = df.groupBy(*by).agg(n(0).alias("n0"), n(1).alias("n1"))
    d = c.join(tot, by).groupBy(*by).agg(F.max(F.abs(sdiv("_a", "n0") - sdiv("_b", "n1"))).alias("d"), F.first("n0").alias("n0"), F.first("n1").alias("n1"))
    lam = F.sqrt(F.col("n0") * F.col("n1") / (F.col("n0") + F.col("n1"))) * F.col("d")
    series = sum((2.0 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 9)), F.lit(0.0))
    return d.select(*by, "d", F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)).alias("p"))


def t_statistic(df: DataFrame, by: list[str], group: str, value: str = "value") -> DataFrame:
    """Student's t of group 1 over group 0, equal variances."""
    f = lambda fn, g: fn(F.when(F.col(group) == g, F.col(value)))
    s = df.groupBy(*by).agg(*[f(fn, g).alias(f"{k}{g}") for g in (0, 1) for k, fn in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    pooled = sdiv((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1"), F.col("n0") + F.col("n1") - 2)
    return s.select(*by, sdiv(F.col("m1") - F.col("m0"), F.sqrt(pooled * (sdiv(F.lit(1.0), "n0") + sdiv(F.lit(1.0), "n1")))).alias("t"))


def mean_ranks(df: DataFrame, by: list[str], value: str = "value", name: str = "rank") -> DataFrame:
    """Average ranks: ties share the mean of their places."""
    w = Window.partitionBy(*by)
    return df.withColumn(name, F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0)


def mann_whitney(df: DataFrame, by: list[str], group: str, value: str = "value") -> DataFrame:
    """U of group 1, and z by the normal approximation without tie correction."""
    r = mean_ranks(df, by, value).groupBy(*by).agg(
        F.sum(F.when(F.col(group) == 1, F.col("rank"))).alias("r1"), F.sum((F.col(group) == 1).cast("double")).alias("n1"), F.sum((F.col(group) == 0).cast("double")).alias("n0")
    )
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    mu, sd = F.col("n1") * F.col("n0") / 2, F.sqrt(F.col("n1") * F.col("n0") * (F.col("n1") + F.col("n0") + 1) / 12)
    return r.select(*by, u.alias("u"), sdiv(u - mu, sd).alias("z"))


def fdr(df: DataFrame, by: list[str], p: str = "p") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values: p * n / rank, made monotone from the largest."""
    w = Window.partitionBy(*by)
    q = df.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(p)))
    q = q.withColumn("_q", F.col(p) * F.col("_n") / F.col("_r"))
    return q.withColumn("q", F.least(F.lit(1.0), F.min("_q").over(w.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)))).drop("_n", "_r", "_q")


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    from .aggregate import safe_corr

    r = mean_ranks(mean_ranks(df, by, x, "_rx"), by, y, "_ry")
    return r.groupBy(*by).agg(safe_corr("_rx", "_ry").alias("rho"))

"""Reductions: quantiles, thresholds, stage and epoch averages, histograms, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import sdiv


def reduce(df: DataFrame, by: list[str], **how) -> DataFrame:
    """Named reductions of ``value``: mean, std (population), sum, max, min, median, n."""
    fn = {"mean": F.avg, "std": F.stddev_pop, "sum": F.sum, "max": F.max, "min": F.min, "median": F.median, "n": F.count}
    return df.groupBy(*by).agg(*[fn[f](c).alias(out) for out, (f, c) in how.items()])


def quantile(df: DataFrame, by: list[str], q: float, name: str = "thr", value: str = "value") -> DataFrame:
    """Linear-interpolation quantile over all that ``by`` leaves."""
    return df.groupBy(*by).agg(F.percentile(value, F.lit(q)).alias(name))


def mquantile(df: DataFrame, by: list[str], q: float, value: str = "value", alpha: float = 0.4, beta: float = 0.4) -> DataFrame:
    """Quantile with plotting positions (alpha, beta): order statistics k and k + 1 around
    n * q + m, m = alpha + q * (1 - alpha - beta)."""
    w = Window.partitionBy(*by)
    r = df.filter(F.col(value).isNotNull()).withColumn("_k", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count("*").over(w))
    at = F.col("_n") * q + (alpha + q * (1 - alpha - beta))
    low = F.floor(F.greatest(F.lit(1.0), F.least(at, F.col("_n") - F.lit(1.0))))
    r = r.withColumn("_low", low).withColumn("_g", F.greatest(F.lit(0.0), F.least(at - F.col("_low"), F.lit(1.0))))
    part = F.when(F.col("_k") == F.col("_low"), (1 - F.col("_g")) * F.col(value)).when(F.col("_k") == F.col("_low") + 1, F.col("_g") * F.col(value))
    return r.groupBy(*by).agg(F.sum(part).alias("thr"))


def binarise(df: DataFrame, thresholds: DataFrame, on: list[str], strict: bool = False) -> DataFrame:
    """Adds ``active``: value at (or, strict, above) its threshold, and positive."""
    hit = F.col("value") > F.col("thr") if strict else F.col("value") >= F.col("thr")
    return df.join(thresholds, on).withColumn("active", (hit & (F.col("value") > 0)).cast("long")).drop("thr")


def epoch_average(df: DataFrame, epochs: dict[str, tuple[int, int]], by: list[str], t: str = "t_idx") -> DataFrame:
    """Means over epochs [t0, t1] that may overlap: a sample counts in each it lies in."""
    names = F.array(*[F.when(F.col(t).between(a, b), F.lit(n)) for n, (a, b) in epochs.items()])
    return df.withColumn("epoch", F.explode(F.array_compact(names))).groupBy(*by, "epoch").agg(F.avg("value").alias("mean"))


def mean_of_means(df: DataFrame, inner: list[str], outer: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*inner).agg(F.avg(value).alias("m")).groupBy(*outer).agg(F.avg("m").alias("mean"))


def min_support(df: DataFrame, by: list[str], least: int) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).filter(F.col("n") >= least)


def histogram(df: DataFrame, by: list[str], bins: int, value: str = "value") -> DataFrame:
    """Equal-width bins between a group's extremes, the last one closed; density sums to 1
    over the width."""
    ends = df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("total"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.least(F.floor(sdiv(F.col(value) - F.col("lo"), width)), F.lit(bins - 1))
    return (
        df.join(ends, by).withColumn("bin", F.coalesce(b, F.lit(0))).groupBy(*by, "bin")
        .agg(F.count("*").alias("n"), sdiv(F.count("*"), F.first("total") * F.first(width)).alias("density"))
    )


def exceedance(df: DataFrame, by: list[str], grid: list[float]) -> DataFrame:
    """Share of samples above each threshold of a grid."""
    return df.groupBy(*by).agg(*[F.avg((F.col("value") > g).cast("double")).alias(f"_{i}") for i, g in enumerate(grid)]).select(
        *by, F.explode(F.array(*[F.struct(F.lit(float(g)).alias("thr"), F.col(f"_{i}").alias("share")) for i, g in enumerate(grid)])).alias("e")
    ).select(*by, "e.thr", "e.share")


def detection_rates(df: DataFrame, by: list[str], truth: str, found: str) -> DataFrame:
    """True-positive, false-positive and false-discovery rates; undefined ones are 0."""
    n = lambda c: F.sum(c.cast("long"))
    t, f = F.col(truth) == 1, F.col(found) == 1
    return df.groupBy(*by).agg(
        F.coalesce(sdiv(n(t & f), n(t)), F.lit(0.0)).alias("tpr"), F.coalesce(sdiv(n(~t & f), n(~t)), F.lit(0.0)).alias("fpr"), F.coalesce(sdiv(n(~t & f), n(f)), F.lit(0.0)).alias("fdr")
    )


def fitted_line(df: DataFrame, by: list[str], y, x) -> DataFrame:
    """Least-squares slope and intercept."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def safe_corr(x: str, y: str) -> "F.Column":
    """Pearson correlation as an aggregate; undefined is 0."""
    ax, ay = F.avg(x), F.avg(y)
    cov = F.avg(F.col(x) * F.col(y)) - ax * ay
    vx, vy = F.avg(F.col(x) * F.col(x)) - ax * ax, F.avg(F.col(y) * F.col(y)) - ay * ay
    return F.coalesce(F.when((vx > 1e-12) & (vy > 1e-12), sdiv(cov, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))))), F.lit(0.0))

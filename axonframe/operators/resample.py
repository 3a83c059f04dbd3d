"""Bootstraps and surrogates. Randomness is a hash of seed and keys, so that results do not
depend on partitions or on tasks that run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fraction


def bootstrap_rows(units: DataFrame, by: list[str], unit: str, n_boot: int, seed: int) -> DataFrame:
    """``n_boot`` resamples, with replacement, of each group's rows (one a unit): they are
    numbered per group, every (boot, draw) picks a number, and picks join by key. Adds
    ``boot``; as many rows a resample as the group has."""
    numbered = units.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(unit)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    draws = numbered.select(*by, "_k", "_n").withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    draws = draws.select(*by, "boot", F.floor(fraction(F.lit(seed), *by, "boot", "_k") * F.col("_n")).cast("int").alias("_k"))
    return draws.join(numbered.drop("_n"), [*by, "_k"]).drop("_k")


def bootstrap_means(df: DataFrame, by: list[str], unit: str, n_boot: int, seed: int, value: str = "value") -> DataFrame:
    """Means of ``n_boot`` resamples of units with replacement; a unit moves as its sum and
    count."""
    units = df.groupBy(*by, unit).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    drawn = bootstrap_rows(units, by, unit, n_boot, seed)
    return drawn.groupBy(*by, "boot").agg(F.try_divide(F.sum("_s"), F.sum("_c")).alias("mean"))


def percentile_interval(boots: DataFrame, by: list[str], level: float = 0.95) -> DataFrame:
    q = (1 - level) / 2
    return boots.groupBy(*by).agg(F.percentile("mean", F.lit(q)).alias("low"), F.percentile("mean", F.lit(0.5)).alias("mid"), F.percentile("mean", F.lit(1 - q)).alias("high"))


def permuted(df: DataFrame, within: list[str], label: str, *tie, seed: int = 0) -> DataFrame:
    """``label`` values permuted over the rows of each group ``within``: row numbers by hash
    meet row numbers by value."""
    a = Window.partitionBy(*within).orderBy(label, *tie)
    b = Window.partitionBy(*within).orderBy(fraction(F.lit(seed), *within, label, *tie), label, *tie)
    numbered = df.withColumn("_a", F.row_number().over(a)).withColumn("_b", F.row_number().over(b))
    to = numbered.select(*within, F.col("_a").alias("_b"), F.col(label).alias("_new"))
    return numbered.join(to, [*within, "_b"]).drop("_a", "_b", label).withColumnRenamed("_new", label)


def trial_swap(df: DataFrame, series: list[str], trial: str = "trial", seed: int = 0) -> DataFrame:
    """Trials permuted independently for each series: the permutation is made on the small
    (series, trial) table and joined."""
    keys = df.select(*series, trial).distinct().withColumn("_old", F.col(trial))
    swap = permuted(keys, series, trial, "_old", seed=seed)
    return df.withColumnRenamed(trial, "_old").join(swap, [*series, "_old"]).drop("_old")


def resampled_observations(df: DataFrame, series: list[str], t: str, seed: int) -> DataFrame:
    """Observations of each series drawn with replacement."""
    n = df.withColumn("_k", F.row_number().over(Window.partitionBy(*series).orderBy(t)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*series)))
    pick = n.select(*series, t, F.floor(fraction(F.lit(seed), *series, "_k") * F.col("_n")).cast("int").alias("_k"))
    return pick.join(n.drop("_n", t), [*series, "_k"]).drop("_k")


def kplet_shuffle(edges: DataFrame, frame: list[str], k: int, seed: int) -> DataFrame:
    """Weights shuffled within runs of k edges of neighbouring weight."""
    e = edges.withColumn("_k", F.floor((F.row_number().over(Window.partitionBy(*frame).orderBy("weight", "src", "dst")) - 1) / k))
    return permuted(e, [*frame, "_k"], "weight", "src", "dst", seed=seed).drop("_k")

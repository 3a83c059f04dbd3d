"""Operators along the time axis, as windows within a series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import sdiv

SERIES = ["node", "freq", "trial"]


def over(by: list[str], t: str = "t_idx"):
    return Window.partitionBy(*by).orderBy(t)


def zscore(df: DataFrame, by: list[str] = SERIES, value: str = "value", name: str = "z", empty: float | None = None) -> DataFrame:
    """(x - mean) / population deviation over the series; null, or ``empty``, where that is 0."""
    w = Window.partitionBy(*by)
    z = sdiv(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w))
    return df.withColumn(name, z if empty is None else F.coalesce(z, F.lit(empty)))


def difference(df: DataFrame, by: list[str] = SERIES, value: str = "value", name: str = "diff") -> DataFrame:
    return df.withColumn(name, F.col(value) - F.lag(value).over(over(by))).filter(F.col(name).isNotNull())


def inter_contact_times(active: DataFrame, by: list[str] = SERIES, t: str = "t_idx") -> DataFrame:
    """Time since the series' last active sample."""
    return active.filter("active = 1").withColumn("ict", F.col(t) - F.lag(t).over(over(by, t))).filter("ict is not null")


def downsample_any(active: DataFrame, length: int, least: int = 0, by: list[str] = SERIES, t: str = "t_idx") -> DataFrame:
    """Tumbling windows: 1 where more than ``least`` samples are active."""
    return active.groupBy(*by, F.floor(F.col(t) / length).alias("win")).agg((F.sum("active") > least).cast("long").alias("any"))


def sliding(df: DataFrame, before: int, after: int, how, by: list[str] = SERIES, value: str = "value", name: str = "out") -> DataFrame:
    """``how`` (a function of a column) over rows from ``before`` to ``after`` around each."""
    return df.withColumn(name, how(F.col(value)).over(over(by).rowsBetween(-before, after)))


def sliding_rms(df: DataFrame, before: int, after: int, **k) -> DataFrame:
    w = over(k.get("by", SERIES)).rowsBetween(-before, after)
    return df.withColumn("rms", F.sqrt(F.avg(F.col("value") * F.col("value")).over(w)))


def smoothed(df: DataFrame, width: int, by: list[str] = SERIES, value: str = "value") -> DataFrame:
    """Moving average of ``width`` samples, zeros beyond the ends."""
    half = width // 2
    return df.withColumn("smooth", F.sum(value).over(over(by).rowsBetween(-half, width - 1 - half)) / width)


def rolled(df: DataFrame, shift: int, length: int, t: str = "t_idx") -> DataFrame:
    """Circular shift along an axis of ``length`` samples: a relabelling, no shuffle."""
    return df.withColumn(t, F.pmod(F.col(t) + shift, F.lit(length)))


def windowed(df: DataFrame, length: int, step: int, by: list[str], last: int, t: str = "t_idx") -> DataFrame:
    """Sliding windows of ``length`` every ``step``, whole ones only; means."""
    first = F.greatest(F.lit(0), F.ceil((F.col(t) - length + 1) / step)).cast("long")
    until = F.least(F.floor(F.col(t) / step), F.lit((last - length) // step)).cast("long")
    w = df.withColumn("first", first).withColumn("until", until).filter("first <= until")
    return w.withColumn("win", F.explode(F.sequence("first", "until"))).groupBy(*by, "win").agg(F.avg("value").alias("mean"))


def triggered_average(df: DataFrame, events: DataFrame, reach: int, series: list[str], by: list[str], t: str = "t_idx") -> DataFrame:
    """Mean of ``value`` at offsets -reach..reach-1 around the events (series, t); samples
    that a snippet lacks count as zero. Events fan out to their offsets before an equi-join."""
    e = events.select(*series, F.col(t).alias("at")).withColumn("offset", F.explode(F.sequence(F.lit(-reach), F.lit(reach - 1)))).withColumn(t, F.col("at") + F.col("offset"))
    hit = e.join(df, [*series, t], "left")
    return hit.groupBy(*by, "offset").agg((F.sum(F.coalesce("value", F.lit(0.0))) / F.count("*")).alias("mean"), F.count("*").alias("n"))


def local_peaks(df: DataFrame, by: list[str], axis: str, value: str = "value") -> DataFrame:
    w = over(by, axis)
    return df.withColumn("_l", F.lag(value).over(w)).withColumn("_r", F.lead(value).over(w)).filter((F.col(value) > F.col("_l")) & (F.col(value) > F.col("_r"))).drop("_l", "_r")


def kernel_weights(samples: int, kind: str = "hanning") -> list[float]:
    """Smoothing weights that sum to 1: square or hanning."""
    if kind == "square":
        w = [1.0] * samples
    elif kind == "hanning":
        w = [0.5 - 0.5 * math.cos(2 * math.pi * (k + 1) / (samples + 1)) for k in range(samples)]
    else:
        raise ValueError(kind)
    return [v / sum(w) for v in w]


def weighted(df: DataFrame, weights: list[float], by: list[str] = SERIES, value: str = "value", name: str = "smooth") -> DataFrame:
    """Centred weighted sum of neighbouring samples, zeros beyond the ends."""
    w, half, total = over(by), len(weights) // 2, F.lit(0.0)
    for k, weight in enumerate(weights):
        total = total + weight * F.coalesce(F.lead(value, k - half).over(w), F.lit(0.0))
    return df.withColumn(name, total)

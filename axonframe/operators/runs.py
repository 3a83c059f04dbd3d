"""Runs of a binary series (gaps and islands) and burst statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import sdiv


def runs(df: DataFrame, by: list[str], t: str = "t_idx", state: str = "active", value: int = 1) -> DataFrame:
    """Maximal runs [start, end) of ``value`` over consecutive t: a sample's t less its
    number among the samples in that state is constant within a run."""
    island = F.col(t) - F.row_number().over(Window.partitionBy(*by).orderBy(t))
    hit = df.filter(F.col(state) == value).withColumn("island", island)
    return hit.groupBy(*by, "island").agg(F.min(t).alias("start"), (F.max(t) + 1).alias("end"), F.count("*").alias("len")).drop("island")


def masked_runs(df: DataFrame, mask, by: list[str], t: str = "t_idx", state: str = "active", value: int = 1, drop_edges: bool = False) -> DataFrame:
    """Runs after compressing the series to ``mask``: runs merge over its holes. With
    ``drop_edges`` the first and last run go if the state goes on beyond the mask's border."""
    w = Window.partitionBy(*by).orderBy(t)
    near = df.withColumn("_before", F.lag(state).over(w)).withColumn("_after", F.lead(state).over(w)).filter(mask)
    inner = near.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    out = runs(inner.withColumn("_t", F.col(t)).withColumn(t, F.col("_i").cast("long")), by, t, state, value)
    if drop_edges:
        borders = inner.groupBy(*by).agg(
            F.max(F.when((F.col("_i") == 1) & (F.col(state) == value) & (F.col("_before") == value), 1)).alias("_first"),
            F.max(F.when((F.col("_i") == F.col("_n")) & (F.col(state) == value) & (F.col("_after") == value), 1)).alias("_last"), F.max("_n").alias("_n"),
        )
        out = out.join(borders, by).filter(~((F.col("start") == 1) & F.col("_first").isNotNull()) & ~((F.col("end") == F.col("_n") + 1) & F.col("_last").isNotNull()))
    return out.select(*by, "start", "end", "len")


def burst_stats(found: DataFrame, by: list[str], samples: int, dt: float = 1.0) -> DataFrame:
    """Mean, deviation (population), share of the samples, and burstiness of run lengths."""
    x = F.col("len") * dt
    mu, sd = F.avg(x), F.stddev_pop(x)
    return found.groupBy(*by).agg(mu.alias("mu"), sd.alias("sd"), (F.sum(x) / (samples * dt)).alias("share"), sdiv(sd - mu, sd + mu).alias("burstiness"))

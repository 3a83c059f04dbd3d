"""Information of binary series, in bits, from conditional counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import log2z


def _h(*shares) -> "F.Column":
    total = F.lit(0.0)
    for p in shares:
        total = total - p * log2z(p)
    return total


def entropy(active: DataFrame, by: list[str]) -> DataFrame:
    p = F.avg(F.col("active").cast("double"))
    return active.groupBy(*by).agg(p.alias("_p")).select(*by, _h(F.col("_p"), 1 - F.col("_p")).alias("h"))


def mutual_information(pairs: DataFrame, by: list[str]) -> DataFrame:
    """``pairs`` (by, x, y in 0/1) to hx, hy, hxy and mi = hx + hy - hxy."""
    share = lambda c, n: F.avg(c.cast("double")).alias(n)
    x, y = F.col("x") == 1, F.col("y") == 1
    p = pairs.groupBy(*by).agg(share(x & y, "p11"), share(x & ~y, "p10"), share(~x & y, "p01"), share(~x & ~y, "p00"))
    hx = _h(F.col("p11") + F.col("p10"), F.col("p01") + F.col("p00"))
    hy = _h(F.col("p11") + F.col("p01"), F.col("p10") + F.col("p00"))
    hxy = _h(*[F.col(c) for c in ("p11", "p10", "p01", "p00")])
    return p.select(*by, hx.alias("hx"), hy.alias("hy"), hxy.alias("hxy"), (hx + hy - hxy).alias("mi"))


def lagged_pairs(active: DataFrame, frame: list[str], lags: list[int], t: str = "t_idx") -> DataFrame:
    """(frame, src, dst, lag, x, y) with x at t + lag and y at t, for src < dst. Each row fans
    out to its few lags, then joins by key."""
    a = active.select(*frame, F.col("node").alias("src"), F.col("active").alias("x"), F.explode(F.array(*map(F.lit, lags))).alias("lag"), F.col(t).alias("_t"))
    a = a.withColumn("_t", F.col("_t") - F.col("lag"))
    b = active.select(*frame, F.col("node").alias("dst"), F.col("active").alias("y"), F.col(t).alias("_t"))
    return a.join(b, [*frame, "_t"]).filter("src < dst").drop("_t")


def best_lag(mi: DataFrame, by: list[str], digits: int = 9) -> DataFrame:
    """Largest information over the lags; of equal ones the smallest lag."""
    best = F.max(F.struct(F.round("mi", digits).alias("mi"), (-F.col("lag")).alias("_l")))
    return mi.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.mi").alias("mi"), (-F.col("b._l")).alias("lag"))


def partial_information(node_mi: DataFrame, pair_mi: DataFrame) -> DataFrame:
    """Redundancy min(MI_s, MI_t), uniques, and synergy of each pair about the target."""
    a, b = node_mi.select(F.col("node").alias("src"), F.col("mi").alias("mi_s")), node_mi.select(F.col("node").alias("dst"), F.col("mi").alias("mi_t"))
    j = pair_mi.join(F.broadcast(a), "src").join(F.broadcast(b), "dst")
    r = F.least("mi_s", "mi_t")
    return j.select("src", "dst", r.alias("redundancy"), (F.col("mi_s") - r).alias("unique_s"), (F.col("mi_t") - r).alias("unique_t"), (F.col("mi") - F.col("mi_s") - F.col("mi_t") + r).alias("synergy"))


def discrete_information(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """MI of two discrete columns."""
    n = df.groupBy(*by, x, y).agg(F.count("*").cast("double").alias("n"))
    nx = n.groupBy(*by, x).agg(F.sum("n").alias("nx"))
    ny = n.groupBy(*by, y).agg(F.sum("n").alias("ny"))
    total = n.groupBy(*by).agg(F.sum("n").alias("m"))
    j = n.join(nx, [*by, x]).join(ny, [*by, y]).join(total, by)
    return j.groupBy(*by).agg(F.sum(F.col("n") / F.col("m") * F.log2(F.col("n") * F.col("m") / (F.col("nx") * F.col("ny")))).alias("mi"))

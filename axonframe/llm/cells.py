"""Comparing the members of hash buckets with each other, whatever a bucket's size.

A bucket of n members is dealt into k = ceil(n / width) lots by a hash of the member, and
every unordered pair of lots becomes one cell, so no task ever holds more than
2 * width members of one bucket and a bucket that holds a third of all rows is shared out
over the whole cluster. Each pair of members meets in exactly one cell of their bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fan_out, session_of


#: Tables of at most so many hot buckets are broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 100_000


def dealt(members: DataFrame, width: int, own: str | None = None) -> DataFrame:
    """``members`` (bucket: long, member: long, ...) to the same rows dealt into cells:
    adds ``cell`` (long), ``lot``, ``lot_a`` and ``lot_b`` (int). Within a cell with
    lot_a < lot_b only pairs across the two lots are new; with lot_a = lot_b all are.

    With ``own``, a boolean column, buckets without a pair that has an own member go; this
    pays where what the rows are joined with later is wide."""
    members = cut(members)
    owned = F.max(own if own else F.lit(True)).alias("owned")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("count"), owned)
    sizes = sizes.filter("count > 1 and owned") if own else sizes.filter(F.col("count") > width)
    # Cut, so that a join by shuffle has two plain exchanges and a hot bucket can be split.
    sizes = cut(sizes.select("bucket", F.ceil(F.col("count") / width).cast("int").alias("lots")))
    if not own and sizes.count() <= BROADCAST_ROWS:
        sizes = F.broadcast(sizes)
    rows = members.join(sizes, "bucket", "inner" if own else "left").withColumn("lots", F.coalesce("lots", F.lit(1)))
    lot = F.pmod(F.xxhash64("member", F.lit(7)), F.col("lots")).cast("int")
    other = rows.select("*", lot.alias("lot"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("other"))
    low, high = F.least("lot", "other"), F.greatest("lot", "other")
    return other.select(*members.columns, "lot", low.alias("lot_a"), high.alias("lot_b"), F.xxhash64("bucket", low, high).alias("cell"))


def arranged(cells: DataFrame) -> DataFrame:
    """Each cell's rows together: partitioned and sorted by cell."""
    return cells.repartition(fan_out(session_of(cells)), "cell").sortWithinPartitions("cell", "bucket", "lot_a", "lot_b", "member")

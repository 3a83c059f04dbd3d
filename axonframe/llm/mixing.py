"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Sources share a total by weight; a target stops at ``most`` times its source's size and
what it leaves is shared again by weight until none is above: the targets are
min(most * size, level * weight) at the one level where they sum to the total, found from
running sums over the sources in the order of size per weight.

Within a source every document expects target / size copies. Their prefix sums, shifted
by one random offset, cross an integer once for each copy. Documents stand in the order
of their size, so copies are spread evenly over short and long ones and the words taken
come near the target. The order is dealt into cells of about the square root of all rows;
a running sum over the cells and a row number within each give a document's place, so no
source, however hot, is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh

#: Source tables of at most so many rows are broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 100_000


def words(text: str = "text") -> "F.Column":
    """Number of words between ASCII blanks; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _fraction(*parts) -> "F.Column":
    """A fixed random number in [0, 1) from the parts' text."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size) with target, for sources in code-point order, null
    last, with ``weights`` repeating. One row for each source; a few small windows."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "k")
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = (
        sizes.withColumn("k", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") - 1) % len(weights) + 1).cast("double"))
        .withColumn("most", F.lit(most) * F.col("source_size"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("total", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    )
    # The first source whose own bound lies above the level left for it and the rest.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "k", "level"))).over(everything)["level"]
    return ranked.withColumn("at", level).select("source", "source_size", F.least("most", F.col("at") * F.col("weight")).alias("target"))


def sample(
    docs: DataFrame, size: str, source: str = "source", doc_id: str = "doc_id", stats: DataFrame | None = None, seed: int = 10,
    weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, added: tuple[str, ...] = ("source_size", "target", "copies"),
) -> DataFrame:
    """``docs`` with source_size (long), target (double) and copies (long, at most
    ``most``) of its row, called as ``added`` says. ``stats``, if given, holds the rows' doc_id, source and size
    alone and is read instead of ``docs`` for all sums.

    Null source: a source of its own, the last. Null doc_id: sampled like any other. Null
    or negative size: 0. Repeated rows and ties in size: each row for itself, told apart by
    doc_id and then by all plain columns; rows alike in all are interchangeable. A source
    of no words: target 0, no copies. Empty table: no rows. Columns called like the added
    ones are replaced. Reruns agree: all randomness is a hash of seed, source and doc_id."""
    key, none, band, part, parts, place, rate, shift, total, goal = fresh(docs, "source", "no_source", "band", "part", "parts", "place", "rate", "shift", "size", "target")

    def keyed(df: DataFrame) -> DataFrame:
        n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
        spread = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")
        return df.withColumns({
            key: F.coalesce(F.col(source).cast("string"), F.lit("")), none: F.col(source).isNull(),
            total: n, band: F.floor(F.lit(8.0) * F.sqrt(F.sqrt(n.cast("double")))).cast("int"), part: spread,
        })

    narrow = keyed(stats if stats is not None else docs)
    bands = cut(narrow.groupBy(key, none, band).agg(F.sum(total).alias("n_words"), F.count("*").alias("n_rows")))
    sources = bands.groupBy(key, none).agg(F.sum("n_words").alias("source_size"))
    named = sources.withColumn("source", F.when(~F.col(none), F.col(key)))
    share_of = targets(named.select("source", "source_size"), weights, share, most)
    share_of = cut(share_of.select(F.coalesce("source", F.lit("")).alias(key), F.col("source").isNull().alias(none), "source_size", "target"))
    n_rows = bands.agg(F.sum("n_rows")).first()[0] or 0
    wide = max(1.0, float(n_rows)) ** 0.5
    # (source, band) to its number of cells and what its sampling needs.
    plan = bands.join(share_of, [key, none]).select(
        key, none, band, F.ceil(F.col("n_rows") / F.lit(wide)).cast("long").alias(parts), F.col("source_size").alias(total), F.col("target").alias(goal),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias(rate),
        _fraction(F.lit(str(seed)), F.lit("offset"), F.when(F.col(none), F.lit("null")).otherwise(F.concat(F.lit("="), key))).alias(shift),
    )
    plan = cut(plan)
    small = F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan

    def in_cells(df: DataFrame) -> DataFrame:
        return df.drop(total).join(small, [key, none, band]).withColumn(part, F.col(part) % F.col(parts))

    cells = in_cells(narrow).groupBy(key, none, band, part).count()
    earlier = Window.partitionBy(key, none).orderBy(band, part).rowsBetween(Window.unboundedPreceding, -1)
    cells = cut(cells.withColumn(place, F.coalesce(F.sum("count").over(earlier), F.lit(0))).select(key, none, band, part, place))
    plain = [c for c, t in docs.dtypes if not t.startswith(("map", "variant")) and c not in (doc_id, size)]
    order = Window.partitionBy(key, none, band, part).orderBy(F.col(size), F.col(doc_id), *[F.col(f"`{c}`") for c in plain])
    ready = in_cells(keyed(docs)).join(cells, [key, none, band, part])
    at = F.col(place) + F.row_number().over(order)
    crossed = F.floor(F.col(shift) + F.col(rate) * at) - F.floor(F.col(shift) + F.col(rate) * (at - 1))
    (number,) = fresh(ready, "copies")
    out = ready.withColumn(number, F.least(crossed, F.lit(int(most))).cast("long"))
    own = [c for c in docs.columns if c.lower() not in [a.lower() for a in added]]
    return out.select(*[F.col(f"`{c}`") for c in own], F.col(total).cast("long").alias(added[0]), F.col(goal).alias(added[1]), F.col(number).alias(added[2]))


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with every row repeated as often as the mix
    takes it; all columns stay. Sizes are words of the whole texts; see ``sample``."""
    (size,) = fresh(docs, "words")
    sized = docs.withColumn(size, words())
    stats = cut(sized.select("doc_id", "source", size))
    added = tuple(fresh(sized, "source_size", "target", "copies"))
    taken = sample(sized, size, stats=stats, added=added, **parameters).filter(F.col(added[2]) > 0)
    # explode only repeats rows: the window before it has placed every document once.
    (copy,) = fresh(taken, "copy")
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(added[2]).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed_sizes(docs: DataFrame, **parameters) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken (words
    the mix takes of it, repeats counted)."""
    narrow = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words().alias("size")))
    out = sample(narrow, "size", **parameters)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))

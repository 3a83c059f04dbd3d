"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``; a folder of our own is set only where
    that is unset and everything runs on one machine, as in local tests.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if configured is None and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="axonframe-"))
    return configured or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage, so that lost executors
    cost only their running tasks and both readers of a result see the same rows."""
    shared_dir(session_of(df))
    return df.checkpoint(eager=True)


def fan_out(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has (case ignored), so that helper
    columns never clash with a caller's own."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(row_text) -> str:
    """Null texts count as empty."""
    return row_text if row_text is not None else ""


#: What workers keep from one partition to the next, by module: how to let go of it.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(module: str, clear: Callable[[], None]) -> None:
    """Says that ``module`` keeps something in its workers, and how to let go of it."""
    _KEPT[module] = clear


def give_back() -> None:
    """Gives memory that is free back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def released(run):
    """``run`` (a function over Arrow batches) that gives its memory back to the system after
    each batch, before the next is read beside the last, and when a partition ends: workers
    live on, and share their executor's memory with the next. What other operators keep in
    the worker goes when it begins."""

    def handed(batches):
        for batch in batches:
            yield batch
            give_back()

    def wrapped(batches):
        for module, clear in _KEPT.items():
            if module != run.__module__:
                clear()
        try:
            yield from run(handed(batches))
        finally:
            import gc

            gc.collect()
            give_back()

    return wrapped


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, seed: int, agg=F.min) -> DataFrame:
    """(doc_id, label, text) of at most ``rows`` labelled documents, one row a doc_id, in
    the order of a hash of doc_id. Labels or ids null: left out. A document with several
    labels has their ``agg``; of several texts the one whose hash is least."""
    some = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    some = some.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(agg(F.col(label).cast("int")).alias("label"))
    some = some.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unsigned_hex(column) -> "F.Column":
    """16 lower-case hexadecimal digits of a long read as unsigned."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))

"""From raw documents to packed training sequences.

Five stages, each over all that its predecessor kept: reject documents of low quality,
keep one of each group of near copies, cut repeated lines, mix the sources to their target
weights, and pack what is left into sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from axonframe.llm.common import cut, read
from axonframe.llm.mixing import mix
from axonframe.llm.packing import pack
from axonframe.llm.quality import keep_good
from axonframe.llm.queries import vocabulary
from axonframe.llm.near_copies import keep_one
from axonframe.llm.substring import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, read(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_copies),
    ("substring dedup", repeats),
    ("mixing sources to target weights", mixture),
    ("packing", packed),
]

#: A trained classifier, fingerprints and a tokenizer have no SQL form; the tests hold
#: run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of ``sf_dir``'s documents. Between stages the rows are
    materialised in the shared folder, so that each stage reads what the last one kept."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs

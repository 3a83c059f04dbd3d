"""Near copies by five-word shingles against brute force."""

import random

import corpus_pipeline
from axonframe.llm import near_copies, simhash

from .test_duplicates import classes


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked(a, b):
    x, y = shingles(a), shingles(b)
    near = bool(x) and len(x & y) >= 0.8 * len(x | y)
    return near or (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() <= 4


def corpus():
    rng = random.Random(11)
    out = []
    for _ in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 9, 60, 150, 400]))]
        for _ in range(rng.randint(1, 4)):
            near = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 40)):
                near[rng.randrange(len(near))] = f"x{rng.randrange(3000)}"
            out.append(" ".join(near))
    return out + ["", None, "  \n", "Solo", "solo"]


def test_stage_keeps_one_of_each_class(spark):
    texts = corpus()
    far = [1 for i, a in enumerate(texts) for b in texts[:i] if shingles(a) and len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b)) and (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 4]
    assert len(far) >= 10  # those that SimHash alone leaves
    want = sorted(set(classes(texts, linked)))
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, node string").repartition(3)
    got = corpus_pipeline.near_copies(spark, df, "")
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == want
    assert corpus_pipeline.near_copies(spark, df.limit(0), "").count() == 0


def test_shingle_sets_are_the_definition():
    texts = ["a b c d e f", "", "A b", "a b", "a b c d e f a b c d e f", "ñ " * 12]
    who, _ = near_copies.shingle_sets(list(map(near_copies.plain, texts)))
    assert [int((who == k).sum()) for k in range(len(texts))] == [len(shingles(t)) for t in texts]


def test_buckets_of_texts_that_are_not_similar(spark):
    """Texts that share half of their shingles meet in buckets, and most have no partner."""
    rng = random.Random(3)
    common = [f"c{k}" for k in range(200)]
    texts = [" ".join(common + [f"w{i}x{k}" for k in range(rng.choice([20, 60, 90, 120]))]) for i in range(60)]
    texts += [" ".join(f"u{i}x{k}" for k in range(80)) for i in range(40)]
    want = sorted(set(classes(texts, linked)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    assert len(want) < len(texts) and sorted(r.doc_id for r in near_copies.keep_one(df).collect()) == want

from collections import Counter, defaultdict

import corpus_pipeline
from axonframe.llm.common import read

from .test_duplicates import WORD, classes, left_over, naive_passages
from .test_near_copies import linked
from .test_tokens import check_pieces


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Words to take of each source, by filling up until none is above its bound."""
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sorted(sizes))}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in sizes if s not in full]
        each = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if each[s] > most * sizes[s]}
        if not over:
            return each | {s: most * sizes[s] for s in full}
        full |= over


def test_stages_against_brute_force(spark, small):
    docs = read(spark, small, "documents")
    labels = {r.doc_id: r.quality for r in read(spark, small, "labels").collect()}
    stages, texts, source = [], {}, {r.doc_id: r.source for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, small).cache()
        stages.append(docs.collect())
        assert len(stages) == 5 or docs.columns == before.columns
    everything = {r.doc_id: r.text for r in read(spark, small, "documents").collect()}

    # Quality: texts as they were; of the labelled documents, the bad ones go.
    good = {r.doc_id: r.text for r in stages[0]}
    assert len(good) == len(stages[0]) and all(everything[d] == t for d, t in good.items())
    right = [(d in good) == bool(q) for d, q in labels.items()]
    assert sum(right) >= 0.9 * len(right)

    # Near copies: the smallest doc_id of each class of linked texts.
    ids = sorted(good)
    want = {ids[k] for k in classes([good[d] for d in ids], linked)}
    texts = {r.doc_id: r.text for r in stages[1]}
    assert set(texts) == want and all(good[d] == t for d, t in texts.items())

    # Passages: only what stands earlier too goes, and nearly all of it does.
    repeated = defaultdict(set)
    for d, k in naive_passages(list(texts.items()), 50):
        repeated[d].add(k)
    left, gone, there = {r.doc_id: r.text for r in stages[2]}, 0, 0
    for d, text in texts.items():
        if d not in repeated:
            assert left[d] == text
            continue
        assert WORD.findall(text) != (words := WORD.findall(left.get(d, "")))
        assert len(words) >= len(WORD.findall(left_over(text, repeated[d])))
        gone, there = gone + len(WORD.findall(text)) - len(words), there + len(repeated[d])
    assert gone >= 0.9 * there

    # Mixture: whole rows, at most twice, near each source's target.
    copies = Counter(r.doc_id for r in stages[3])
    assert all(left[r.doc_id] == r.text for r in stages[3]) and max(copies.values()) <= 2
    sizes, taken, longest = Counter(), Counter(), Counter()
    for d, text in left.items():
        n = len(WORD.findall(text))
        sizes[source[d]] += n
        taken[source[d]] += n * copies[d]
        longest[source[d]] = max(longest[source[d]], n)
    for s, goal in targets(sizes).items():
        assert abs(taken[s] - goal) <= 2 * longest[s]

    # Packing: every id of every copy once, sequences full or a power of two.
    whole, all_ids = check_pieces(stages[4], [(r.doc_id, r.text) for r in stages[3]], 2048)
    assert sum(len(ids) for _, _, ids in whole) == sum(len(ids) for _, ids in all_ids)


def test_run_is_the_stages(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    assert rows and all(r.length == len(r.ids) for r in rows)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "substring dedup", "mixing sources to target weights", "packing"]

"""Severity of toxicity by cumulative-link ordinal regression.

Features are words and word beginnings whose presence goes with the toxic label far beyond
chance in a bounded labelled sample. Labels are graded: 0 for documents that are not
toxic; toxic ones 1 to 3 by the thirds of how much of such features they hold. The model
P(grade > k) = logistic(w.x - b_k) shares w across the ordered thresholds b_1 < b_2 < b_3;
x holds log counts of the features and the text's length. A document's expected severity
is the sum of the three probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, labelled, released, text_of
from .merges import Memo

#: Bounds: labelled rows fitted on, words whose features a worker keeps.
SAMPLE_ROWS, MOST_WORDS = 12_000, 200_000
#: A feature stands in so many toxic documents of the sample at least.
LEAST_SEEN = 5
GRADES = 3
_STEM = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    """A blank-separated word's features: its runs of letters in lower case, whole and, for
    longer ones, their first four to seven letters."""
    out = []
    for w in _STEM.findall(word.lower()):
        out.append(w)
        out += [f"{w[:n]}*" for n in range(4, 8) if len(w) > n]
    return out


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen[y].update({f for w in set(text_of(text).split()) for f in features_of(w)})
        names = list({**seen[0], **seen[1]})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([s[f] for f in names], pa.int64()) for s in seen)], ["feature", "clean", "toxic"])


class Reader:
    """Counts of the chosen features in texts."""

    def __init__(self, chosen: list[str]):
        self.number = {f: k for k, f in enumerate(chosen)}
        self.memo = Memo(self._words, MOST_WORDS)

    def _words(self, words: list[str]) -> list[tuple[int, ...]]:
        number = self.number
        return [tuple(number[f] for f in features_of(w) if f in number) for w in words]

    def __call__(self, texts: list[str]) -> tuple[list[Counter], list[int]]:
        split = [t.split() for t in texts]
        self.memo.fill(set().union(*split))
        get = self.memo.__getitem__
        return [Counter(k for found in map(get, words) if found for k in found) for words in split], list(map(len, split))


class Ordinal:
    """A fitted cumulative-link model."""

    def __init__(self, chosen: list[str], weight: list[float], counts: list[dict[int, int]], lengths: list[int], toxic: np.ndarray, ridge: float = 3e-5, rounds: int = 800):
        self.chosen = chosen
        self.mean_length = float(np.mean(np.log1p(lengths)))
        x = self.design(counts, lengths)
        grade = np.zeros(len(toxic), dtype=int)
        held = x[toxic == 1, :-1] @ np.array(weight)
        grade[toxic == 1] = 1 + np.searchsorted(np.quantile(held, [1 / 3, 2 / 3]), held, side="right")
        # Thresholds are a first one and positive steps, so their order holds throughout.
        w, b = np.zeros(x.shape[1]), np.array([2.0, 0.0, 0.0])
        m, v = np.zeros(len(w) + GRADES), np.zeros(len(w) + GRADES)
        for t in range(1, rounds + 1):
            steps = np.concatenate([b[:1], np.exp(b[1:])])
            s = x @ w
            p = _between(s, np.cumsum(steps))
            # Gradient of the grades' log likelihood in the score and in each threshold.
            g_s, g_b = _slopes(s, np.cumsum(steps), grade, p)
            grad_w = -(x.T @ g_s) / len(x) + ridge * w
            back = np.cumsum(g_b.mean(axis=0)[::-1])[::-1]
            grad_b = -np.concatenate([back[:1], back[1:] * steps[1:]])
            g = np.concatenate([grad_w, grad_b])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
            w, b = w - move[: len(w)], b - move[len(w) :]
        self.w, self.b = w, np.cumsum(np.concatenate([b[:1], np.exp(b[1:])]))

    def design(self, counts: list[dict[int, int]], lengths: list[int]) -> np.ndarray:
        x = np.zeros((len(counts), len(self.chosen) + 1))
        for i, c in enumerate(counts):
            for k, n in c.items():
                x[i, k] = np.log2(1 + n)
        x[:, -1] = np.log1p(lengths) - self.mean_length
        return x

    def exceed(self, counts: list[dict[int, int]], lengths: list[int]) -> np.ndarray:
        """P(grade > k) for k = 0, 1, 2."""
        x = np.array([sum(self.w[k] * np.log2(1 + n) for k, n in c.items()) for c in counts]) + self.w[-1] * (np.log1p(lengths) - self.mean_length)
        return 1 / (1 + np.exp(np.clip(self.b[None, :] - x[:, None], -60, 60)))


def _between(s: np.ndarray, b: np.ndarray) -> np.ndarray:
    """P(grade = k)."""
    up = 1 / (1 + np.exp(np.clip(b[None, :] - s[:, None], -60, 60)))
    up = np.concatenate([np.ones((len(s), 1)), up, np.zeros((len(s), 1))], axis=1)
    return np.maximum(up[:, :-1] - up[:, 1:], 1e-12)


def _slopes(s: np.ndarray, b: np.ndarray, grade: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up = 1 / (1 + np.exp(np.clip(b[None, :] - s[:, None], -60, 60)))
    d = np.concatenate([np.zeros((len(s), 1)), up * (1 - up), np.zeros((len(s), 1))], axis=1)
    rows = np.arange(len(s))
    own = p[rows, grade]
    low, high = d[rows, grade] / own, d[rows, grade + 1] / own
    slopes_b = np.zeros((len(s), len(b)))
    has = grade > 0
    slopes_b[rows[has], grade[has] - 1] -= low[has]
    has = grade < len(b)
    slopes_b[rows[has], grade[has]] += high[has]
    return low - high, slopes_b


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 5) -> Ordinal | None:
    """The model, from at most ``sample_rows`` labelled documents (labels: doc_id, toxic
    0/1), whatever partitions they lie in; None if they are of one kind only. Labels null:
    left out."""
    sample = cut(labelled(docs, labels, "toxic", sample_rows, seed, F.max).select(F.col("label").alias("toxic"), "text", "doc_id"))
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return None
    total, share = n[0] + n[1], n[1] / (n[0] + n[1])
    seen = sample.mapInArrow(released(_seen), "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    both = F.col("clean") + F.col("toxic")
    z = (F.col("toxic") - both * share) / F.sqrt(both * (1 - both / F.lit(total + 1.0)) * (share * (1 - share)))
    chosen = seen.filter((F.col("toxic") >= LEAST_SEEN) & (F.col("toxic") > F.col("clean") * 0.3)).withColumn("z", z).filter("z > 6").orderBy(F.desc("z"), "feature")
    chosen = chosen.select("feature", "z").collect()
    names = [r.feature for r in chosen]
    if not names:
        return None
    rows = sample.mapInArrow(released(_counted(names)), "toxic int, doc_id long, n long, feature array<int>, count array<int>").collect()
    rows.sort(key=lambda r: r.doc_id)  # sums in one order, whatever the partitions
    return Ordinal(names, [r.z for r in chosen], [dict(zip(r.feature, r["count"])) for r in rows], [r.n for r in rows], np.array([r.toxic for r in rows]))


def _counted(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(names)
        for batch in batches:
            counts, lengths = reader(list(map(text_of, batch.column(1).to_pylist())))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(lengths, pa.int64()), pa.array([list(c) for c in counts], ints), pa.array([list(c.values()) for c in counts], ints)],
                ["toxic", "doc_id", "n", "feature", "count"],
            )

    return run


def _scored(model: Ordinal | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.chosen if model else [])
        for batch in batches:
            texts, out = batch.column(1), []
            for at in range(0, len(texts), 256):
                counts, lengths = reader(list(map(text_of, texts.slice(at, 256).to_pylist())))
                out.append(model.exceed(counts, lengths) * (np.array(lengths) > 0)[:, None] if model else np.zeros((len(counts), GRADES)))
            p = np.concatenate(out) if out else np.zeros((0, GRADES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p.sum(axis=1)), pa.array(p[:, 0].copy()), pa.array(p[:, 0] >= threshold)], ["doc_id", "severity", "p_toxic", "toxic"]
            )

    return run


def severity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, severity (expected grade, 0
    to 3), p_toxic (probability of a grade above 0), toxic (p_toxic >= ``threshold``).

    Null or blank text: 0. Null doc_id: kept as null. Repeated rows: one row each. No
    labels, or of one kind: 0 for all. Very long texts: read whole. Empty table: no rows.
    Other columns: ignored."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(released(_scored(fit(docs, labels, sample_rows), threshold)), "doc_id long, severity double, p_toxic double, toxic boolean")

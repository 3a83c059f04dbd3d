"""Document quality by hierarchical empirical Bayes.

A logistic classifier of the text's form gives each document its evidence: the log
likelihood ratio of good against bad. Documents live on sites: a host, and a path in it.
Grouped sums of the classifier's probabilities give every host and path a share of good
documents, shrunk where rows are few: paths towards their host, hosts towards the global
share, with strengths found from the spread between sites (moments). A document's quality
adds its evidence to the log odds of its path without the document itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, labelled, released, text_of

#: Most labelled rows that the classifier is fitted on, in the order of a hash of their id.
SAMPLE_ROWS = 20_000
#: Site tables of at most so many rows are broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 100_000

_KIND = np.full(256, 7, dtype=np.uint8)
for _k, _signs in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", b"!", b"|", b" \t\n\r\v\f")):
    _KIND[list(_signs)] = _k
_KIND[list(range(97, 123))] = 6
_KIND[128:] = 6
FEATURES = 11


def features(text: str) -> list[float]:
    """Shares of character kinds, repetition of words and lines, and length."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    words = text.split()
    n, m = max(1, len(raw)), max(1, len(words))
    upper, digit, marks, cries, pipes, _, _, signs = np.bincount(_KIND[raw], minlength=8).tolist()
    lines = text.split("\n")
    same = sum(a == b for a, b in zip(words, words[1:]))
    # Distinct words, against those that a text of this length usually has.
    distinct = len(set(words)) / m ** 0.95
    most = Counter(words).most_common(1)[0][1] / m if words else 0.0
    return [
        upper / n, digit / n, marks / m, min(1.0, cries / m), min(1.0, pipes / m), min(1.0, signs / m), same / m, distinct,
        most if m > 20 else 0.0, 1 - len(set(lines)) / len(lines), abs(np.log((n + 1) / m / 6.0)),
    ]


class Logistic:
    """Ridge logistic regression by Newton's method; features standardised and clipped."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 3.0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = self._z(x)
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[0] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-z @ w))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.w = w
        self.base = np.log(y.mean() / (1 - y.mean()))

    def _z(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.ones((len(x), 1)), z], axis=1)

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of good: the log odds without the sample's own share."""
        return np.clip(self._z(x) @ self.w - self.base, -30, 30)


def _described(text_at: int, keep: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at)
            x = [features(text_of(t)) for at in range(0, len(texts), 256) for t in texts.slice(at, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(x, pa.list_(pa.float64()))], [*(batch.schema.names[i] for i in keep), "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 1) -> Logistic | None:
    """The classifier, from at most ``sample_rows`` labelled documents (labels: doc_id,
    quality 0/1); None if they are of one kind only. Labels null: left out."""
    sample = labelled(docs, labels, "quality", sample_rows, seed)
    rows = sample.mapInArrow(released(_described(2, [0, 1])), "doc_id long, label int, x array<double>").collect()
    rows.sort(key=lambda r: r.doc_id)  # sums in one order, whatever the partitions
    y = np.array([r.label for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return None
    return Logistic(np.array([r.x for r in rows]), y)


def _evidence(model: Logistic | None, text_at: int, name: str, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(text_at), []
            for at in range(0, len(texts), 256):
                some = list(map(text_of, texts.slice(at, 256).to_pylist()))
                if model is None:
                    out.append(np.zeros(len(some)))
                    continue
                e = model.evidence(np.array([features(t) for t in some]).reshape(len(some), FEATURES))
                out.append(np.where([bool(t.strip()) for t in some], e, 0.0))
            columns = list(zip(batch.schema.names, batch.columns))
            if not keep_text:
                columns.pop(text_at)
            yield pa.RecordBatch.from_arrays([*(c for _, c in columns), pa.array(np.concatenate(out) if out else [], pa.float64())], [*(n for n, _ in columns), name])

    return run


def with_evidence(docs: DataFrame, model: Logistic | None, name: str, keep_text: bool = True) -> DataFrame:
    at = docs.columns.index("text")
    kept = [f for i, f in enumerate(docs.schema.fields) if keep_text or i != at]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{name}` double"])
    return docs.mapInArrow(released(_evidence(model, at, name, keep_text)), schema)


def _strength(sites: DataFrame, parent: str) -> float:
    """Prior strength of sites around their parents' shares: the beta prior's size whose
    spread is that between the sites beyond chance."""
    share = F.col("good") / F.col("n")
    chance = F.col(parent) * (1 - F.col(parent)) / F.col("n")
    row = sites.agg(
        F.sum(F.col("n") * (F.pow(share - F.col(parent), 2) - chance)).alias("spread"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col(parent) * (1 - F.col(parent))).alias("inner")
    ).first()
    if not row["n"]:
        return 10.0
    between = row["spread"] / row["n"]
    return float(np.clip(row["inner"] / row["n"] / between - 1 if between > 0 else 1e4, 10.0, 1e4))


def posteriors(scored: DataFrame) -> DataFrame:
    """``scored`` (host, path, p) to one row for each (host, path): its n, good, the host's
    and the path's posterior shares, and the prior weight that a path starts from."""
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n"), F.sum("good")).first()
    share = (total[1] + 1.0) / (total[0] + 2.0) if total[0] else 0.5
    hosts = hosts.withColumn("global", F.lit(share))
    k = _strength(hosts, "global")
    hosts = cut(hosts.select(F.col("host").alias("h"), ((F.lit(k * share) + F.col("good")) / (F.lit(k) + F.col("n"))).alias("host_posterior")))
    paths = cut(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h"))
    k = _strength(paths, "host_posterior")
    return paths.withColumn("strength", F.lit(k)).withColumn("path_posterior", (F.col("strength") * F.col("host_posterior") + F.col("good")) / (F.col("strength") + F.col("n")))


def _log_odds(p) -> "F.Column":
    bounded = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(bounded / (1 - bounded))


def _sited(docs: DataFrame, host: str, path: str) -> tuple:
    return F.col(host).cast("string"), F.col(path).cast("string")


def _judged(scored: DataFrame, sites: DataFrame, evidence: str, host, path) -> DataFrame:
    """Adds p, host_posterior, path_posterior and quality to rows with their evidence."""
    sites = cut(sites)
    table = F.broadcast(sites) if sites.count() <= BROADCAST_ROWS else sites
    table = table.select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.col("n").alias("__n"), F.col("good").alias("__good"), F.col("strength").alias("__k"), "host_posterior", "path_posterior")
    p = F.lit(1.0) / (1 + F.exp(-(F.col(evidence))))
    # The path's share without this document, so that none is its own witness.
    others = (F.col("__k") * F.col("host_posterior") + F.greatest(F.col("__good") - p, F.lit(0.0))) / (F.col("__k") + F.col("__n") - 1)
    odds = F.col(evidence) + _log_odds(others)
    joined = scored.join(table, host.eqNullSafe(F.col("__h")) & path.eqNullSafe(F.col("__p")))
    return joined.withColumn("p_document", p).withColumn("quality", F.lit(1.0) / (1 + F.exp(-odds))).drop("__h", "__p", "__n", "__good", "__k")


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, ``host``, ``path``): doc_id,
    p_document (classifier alone, at even odds), host_posterior, path_posterior, quality,
    keep (quality >= ``threshold``).

    Null or blank text: no evidence, so its site's share. Null host or path: a site of its
    own. Null doc_id: kept as null. Repeated rows: one row each. No labels, or of one kind:
    no evidence at all. Very long texts: read whole. Empty table: no rows. Other columns:
    ignored."""
    h, p = _sited(docs, host, path)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), h.alias("host"), p.alias("path"), F.col("text").cast("string").alias("text"))
    scored = cut(with_evidence(slim, fit(docs, labels, sample_rows), "evidence", keep_text=False))
    sites = posteriors(scored.select("host", "path", (F.lit(1.0) / (1 + F.exp(-F.col("evidence")))).alias("p")))
    out = _judged(scored, sites, "evidence", F.col("host"), F.col("path"))
    return out.select("doc_id", "p_document", "host_posterior", "path_posterior", "quality", (F.col("quality") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without the documents that ``judge`` rejects; all columns stay. Evidence is
    worked out twice, which is cheaper than keeping every text beside it."""
    model = fit(docs, labels, sample_rows)
    evidence, h, p = fresh(docs, "evidence", "host", "path")
    hc, pc = _sited(docs, host, path)
    slim = docs.select(hc.alias("host"), pc.alias("path"), F.col("text").cast("string").alias("text"))
    scored = with_evidence(slim, model, "evidence", keep_text=False)
    sites = posteriors(scored.select("host", "path", (F.lit(1.0) / (1 + F.exp(-F.col("evidence")))).alias("p")))
    rows = with_evidence(docs, model, evidence).withColumns({h: hc, p: pc})
    # Rows carry the caller's columns under numbered names until they are judged.
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(evidence).alias("__e"), F.col(h).alias("__host"), F.col(p).alias("__path"))
    good = _judged(packed, sites, "__e", F.col("__host"), F.col("__path")).filter(F.col("quality") >= threshold)
    return good.select("__row.*")

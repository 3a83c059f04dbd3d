"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or
more, besides those that SimHash links.

Candidates are texts that share one of 40 bands of six minhashes: at a similarity of 0.8
two texts miss each other with a probability of 5e-6, above it with less. Every candidate
pair is verified by the exact similarity of the whole sets, unless links found before
already join its two texts. To find most links with few pairs, each
bucket's members are first held against one leader. What is then not yet one class is
compared all with all, but by sketches: pairs whose 240 minhashes agree in fewer places
than ``at_least`` less 5.8 standard deviations (0.65 for 0.8), which similar texts' do with
a probability under 1e-7, are left; whole shingle sets decide on the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .cells import arranged, dealt
from .common import cut, fresh, released, text_of
from .components import components
from .licenses import _POWERS, _mixed, shingles_of
from .simhash import _one_row_each, fingerprint, grouped, links_of

SIMILAR, BANDS, ROWS = 0.8, 40, 6
_FACTORS = _mixed(np.arange(BANDS * ROWS, dtype=np.uint64), 200) | np.uint64(1)
#: Members of a bucket that are compared at a time.
CELL = 512
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 20


def plain(text: str | None) -> bytes:
    """A text's words as SimHash takes them, one blank between."""
    return b" ".join(text_of(text).encode("utf-8", "surrogatepass").lower().split())


def shingle_sets(plains: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of the texts' distinct shingles, in order. Fewer than five words:
    one shingle of all; no word: none."""
    raw = b"\n".join(plains)
    b = np.frombuffer(raw, dtype=np.uint8)
    inside = np.concatenate([[False], (b != 32) & (b != 10), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = _POWERS.upto(len(b) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])])
        words = _mixed((sums[end] - sums[start]) * down[start], 1)
    begins = np.cumsum([0] + [len(p) + 1 for p in plains])[:-1]
    owner = np.searchsorted(begins, start, side="right") - 1
    count = np.bincount(owner, minlength=len(plains))
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < 5))
    who, out = [short], [np.array([shingles_of(words[first[t] : first[t] + count[t]])[0] for t in short], dtype=np.uint64)]
    if len(words) >= 5:
        whole = owner[:-4] == owner[4:]
        who.append(owner[:-4][whole])
        out.append(shingles_of(words)[whole])
    w, s = np.concatenate(who), np.concatenate(out)
    order = np.lexsort((s, w))
    w, s = w[order], s[order]
    new = np.ones(len(w), dtype=bool)
    new[1:] = (w[1:] != w[:-1]) | (s[1:] != s[:-1])
    return w[new], s[new]


def bands_of(who: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts with a shingle, their band keys)."""
    if not len(who):
        return who, np.empty((0, BANDS), dtype=np.uint64)
    first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
    keys = np.empty((len(first), BANDS), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(len(first), band, dtype=np.uint64)
            for f in _FACTORS[band * ROWS : (band + 1) * ROWS]:
                key = _mixed(key ^ np.minimum.reduceat(shingles * f, first), 3)
            keys[:, band] = key
    return who[first], keys


def _chunks(texts: pa.Array) -> Iterator[list[str | None]]:
    for at in range(0, len(texts), 256):
        held, size = [], 0
        for t in texts.slice(at, 256).to_pylist():
            held.append(t)
            size += len(text_of(t))
            if size >= CHUNK:
                yield held
                held, size = [], 0
        if held:
            yield held


def _signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, nodes, sizes, bands = [], [], [], []
        for texts in _chunks(batch.column(1)):
            plains = list(map(plain, texts))
            prints += map(fingerprint, texts)
            nodes += map(xxh64_intdigest, plains)
            who, shingles = shingle_sets(plains)
            sizes += np.bincount(who, minlength=len(plains)).tolist()
            own: list = [[] for _ in plains]
            for t, k in zip(*bands_of(who, shingles)):
                own[t] = k.view(np.int64)
            bands += own
        longs = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), longs(prints), longs(nodes), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "digest", "fp", "node", "n", "bands"],
        )


def _similar(at_least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                a, b, x, y = (batch.column(k).slice(at, 64).to_pylist() for k in range(4))
                texts = dict(zip(a + b, x + y))
                sets = {u: shingle_sets([plain(t)])[1] for u, t in texts.items()}
                keep = []
                for k, (p, q) in enumerate(zip(a, b)):
                    both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                    if both >= at_least * (len(sets[p]) + len(sets[q]) - both) - 1e-9:
                        keep.append(k)
                yield pa.RecordBatch.from_arrays([pa.array([c[k] for k in keep], pa.int64()) for c in (a, b)], ["a", "b"])

    return run


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) to (member, sketch): two bytes of each minhash. All texts have words."""
    for batch in batches:
        at = 0
        for texts in _chunks(batch.column(1)):
            who, shingles = shingle_sets(list(map(plain, texts)))
            first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            with np.errstate(over="ignore"):
                least = np.stack([np.minimum.reduceat(shingles * f, first) for f in _FACTORS], axis=1)
            short = (_mixed(least, 4) >> np.uint64(48)).astype("<u2")
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([r.tobytes() for r in short], pa.binary())], ["member", "sketch"])
            at += len(texts)


def _pairs_within(group: dict[str, np.ndarray], at_least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) in whole cells' rows of members of different classes whose sketches
    agree in so many places as similar texts' do."""
    few = at_least - 5.8 * (at_least * (1 - at_least) / len(_FACTORS)) ** 0.5
    bucket, lots, a, b, root, n = (group[c] for c in ("bucket", "lot", "lot_a", "lot_b", "root", "n"))
    sketch = np.frombuffer(b"".join(group["sketch"]), dtype="<u2").reshape(len(bucket), -1)
    first = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    for f, till in zip(first, np.append(first[1:], len(bucket))):
        x = y = np.arange(f, till)
        if a[f] != b[f]:
            x, y = x[lots[x] == a[f]], y[lots[y] == b[f]]
        for k in range(0, len(x), 16):
            p = x[k : k + 16]
            near = (root[p, None] != root[y]) & (np.minimum(n[p, None], n[y]) >= at_least * np.maximum(n[p, None], n[y]) - 1e-9)
            i, j = np.nonzero(near & ((a[f] != b[f]) | (p[:, None] < y)))
            alike = (sketch[p[i]] == sketch[y[j]]).mean(axis=1) >= few
            yield p[i[alike]], y[j[alike]]


#: Rows of cells, and what of them the exact comparison needs.
CELLS = "cell long, bucket long, member long, lot int, lot_a int, lot_b int, root long, n long, sketch binary"


def _promising(at_least: float):
    """The rows of cells that have a promising partner in their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, most=4 * CELL):
            keep = np.zeros(len(group["cell"]), dtype=bool)
            for i, j in _pairs_within(group, at_least):
                keep[i] = keep[j] = True
            yield pa.RecordBatch.from_arrays([pa.array(v[keep], pa.binary() if n == "sketch" else None) for n, v in group.items()], list(group))

    return run


def _linked(at_least: float):
    """Rows of cells with texts to the similar pairs (a, b) of different classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, most=CELL):
            sets: dict[int, np.ndarray] = {}

            def set_of(row: int) -> np.ndarray:
                if (own := sets.get(member := int(group["member"][row]))) is None:
                    own = sets[member] = shingle_sets([plain(group["text"][row])])[1]
                return own

            done, found = set(), []
            for i, j in _pairs_within(group, at_least):
                for p, q in zip(i.tolist(), j.tolist()):
                    pair = tuple(sorted((int(group["member"][p]), int(group["member"][q]))))
                    if pair in done:
                        continue
                    done.add(pair)
                    x, y = set_of(p), set_of(q)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both >= at_least * (len(x) + len(y) - both) - 1e-9:
                        found.append(pair)
            columns = zip(*found) if found else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    return run


def _shared(nodes: DataFrame) -> DataFrame:
    """(bucket, node, n, degree) of the buckets with several members; of those with the
    same members, one. A node's degree is the number of members that its buckets hold."""
    members = cut(nodes.select("node", "n", F.explode("bands").alias("bucket")))
    sets = members.groupBy("bucket").agg(F.count("*").alias("c"), *[F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (0, 1)])
    some = sets.filter("c > 1").groupBy("c", "x0", "x1").agg(F.min("bucket").alias("bucket")).select("bucket", "c")
    shared = cut(members.join(some.hint("merge"), "bucket"))
    degree = shared.groupBy("node").agg(F.sum("c").alias("degree"))
    return cut(shared.drop("c").join(degree.hint("merge"), "node"))


def _found(pairs: DataFrame, texts: DataFrame, at_least: float) -> DataFrame:
    """The pairs (a, b) of similar texts; ``texts``: node, text."""
    text = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(text("a").hint("merge"), "a").join(text("b").hint("merge"), "b").select("a", "b", "text_a", "text_b")
    return cut(both.mapInArrow(released(_similar(at_least)), "a long, b long"))


def similar_classes(nodes: DataFrame, slim: DataFrame, links: DataFrame, at_least: float = SIMILAR) -> DataFrame:
    """(node, root) of the nodes joined by ``links`` (a, b) or similarity; nodes that
    neither joins with another may be absent. ``nodes``: node, n, digest, bands; ``slim``:
    digest, text."""
    members = _shared(nodes)
    wanted = nodes.select("node", "digest").join(members.select("node").distinct().hint("merge"), "node")
    texts = cut(slim.select("digest", "text").join(wanted.hint("merge"), "digest").groupBy("node").agg(F.min("text").alias("text")))
    close = F.least("n", "n_b") >= at_least * F.greatest("n", "n_b") - 1e-9
    pair = (F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b"))
    # Each bucket against its leader: the text that most others share buckets with, such as
    # the one that they are copies of, joins most of what belongs together.
    lead = members.groupBy("bucket").agg(F.max_by(F.struct("node", "n"), F.struct("degree", "node")).alias("l"))
    lead = lead.select("bucket", F.col("l.node").alias("node_b"), F.col("l.n").alias("n_b"))
    stars = members.join(lead.hint("merge"), "bucket").filter(close & (F.col("node") != F.col("node_b"))).select(*pair).distinct()
    label = cut(components(links.unionByName(_found(stars, texts, at_least))))
    # What a bucket holds of several classes is compared by sketches within cells, so that
    # no pair is listed that is not promising.
    m = members.join(label.hint("merge"), "node", "left").select("bucket", F.col("node").alias("member"), "n", F.coalesce("root", "node").alias("root"))
    mixed = m.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("bucket")
    m = cut(m.join(mixed.hint("merge"), "bucket"))
    sketched = texts.join(m.select(F.col("member").alias("node")).distinct().hint("merge"), "node").select("node", "text").mapInArrow(released(_sketches), "member long, sketch binary")
    cells = arranged(dealt(m.join(sketched.hint("merge"), "member"), CELL)).select(*[c.split()[0] for c in CELLS.split(", ")])
    promising = cut(cells.mapInArrow(released(_promising(at_least)), CELLS))
    held = arranged(promising.join(texts.select(F.col("node").alias("member"), "text").hint("merge"), "member"))
    columns = [*[c.split()[0] for c in CELLS.split(", ")], "text"]
    found = cut(held.select(*columns).mapInArrow(released(_linked(at_least)), "a long, b long").distinct())
    if found.isEmpty():
        return label
    # The classes that the new pairs join: their links are few.
    named = label.unionByName(m.select(F.col("member").alias("node"), "root")).distinct()
    of = lambda c: named.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    joined = found.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    new = components(joined).select(F.col("node").alias("root"), F.col("root").alias("new"))
    return cut(named.join(new.hint("merge"), "root", "left").select("node", F.coalesce("new", "root").alias("root")))


def keep_one(docs: DataFrame, at_least: float = SIMILAR, max_bits: int = 4) -> DataFrame:
    """``docs`` with one row of each class of near copies: texts linked by a Jaccard
    similarity of their five-word shingles of ``at_least`` or by fingerprints at most
    ``max_bits`` apart. It is that of the class's smallest doc_id; of rows that share it,
    the one whose text hashes lowest. All columns stay.

    Null or empty text: alike. Null doc_id: stays only where a class has no other. Texts of
    fewer than five words: similar if they are the same words. Very long texts: read whole.
    Empty table: no rows."""
    own, least, order = fresh(docs, "doc", "component", "order")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("digest"))
    signs = cut(slim.mapInArrow(released(_signs), "doc_id long, digest long, fp long, node long, n long, bands array<long>"))
    nodes = cut(signs.groupBy("node").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("first"), F.min("n").alias("n"), F.min("digest").alias("digest"), F.first("bands").alias("bands")))
    prints = cut(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("c")))
    of = lambda c: prints.select(F.col("fp").alias(c), F.col("least").alias(f"node_{c}")).hint("merge")
    near = cut(links_of(prints, max_bits)).join(of("a"), "a").join(of("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    same = nodes.select("node", "fp").join(prints.filter("c > 1").select("fp", "least").hint("merge"), "fp").select(F.col("node").alias("a"), F.col("least").alias("b"))
    label = similar_classes(nodes, slim, near.unionByName(same), at_least)
    named = cut(nodes.join(label.hint("merge"), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    named = named.join(named.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("node", "root", "component_id")
    chosen = (
        signs.select("doc_id", "digest", "node").join(named, "node")
        .filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root", F.col("doc_id").alias(least)).agg(F.min("digest").alias(order))
        .drop("root")
    )
    return _one_row_each(docs, chosen, own, least, order)

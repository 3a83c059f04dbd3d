"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint's 64 bits are three segments of 22, 21 and 21 bits, each padded to the 23
of the perfect Golay code. At most four differing bits leave, by pigeonhole, either a
segment without an error or at least two segments with one error each. The first case is
found by a segment's exact key; for the second, a segment is decoded to the index of its
nearest codeword, and words at distance three from it, which one error may carry into a
neighbouring sphere, also to the five codewords at distance four. One error changes a
word's parity, so it is enough that the odd words carry the several keys: the nearest
codeword of the even word is always among them. Keys of two segments stand together.
Candidates are verified by counting differing bits, in cells that bound every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .cells import arranged, dealt
from .common import cut, fan_out, fresh, released, session_of, text_of, unsigned_hex
from .components import components

SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Generator of the perfect binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
CELL = 2048


def fingerprint(text: str | None, words_in_shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the whole text: ASCII letters lower-cased, words between ASCII
    blanks, shingles with repeats hashed by XXH64; a bit is set in over half the hashes.
    Fewer words than a shingle: one shingle of all. No word: 0."""
    words = text_of(text).encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_in_shingle:
        return xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - words_in_shingle + 1
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 100_000):
        s, e = starts[at : min(n, at + 100_000)].tolist(), ends[at + words_in_shingle - 1 :][: min(n - at, 100_000)].tolist()
        hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(s, e)], dtype=">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def _fingerprints(k: int, seed: int, text_at: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(text_at), []
            for at in range(0, len(texts), 256):
                out += [fingerprint(t, k, seed) for t in texts.slice(at, 256).to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns) if i != text_at]
            names = [n for i, n in enumerate(batch.schema.names) if i != text_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.array(out, dtype=np.uint64).view(np.int64))], [*names, name])

    return run


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """(syndromes of all 23-bit words' parts, error patterns by syndrome): patterns[s] has
    the error of at most three bits first, then the five of four bits if it has three;
    missing ones repeat the first."""

    def remainder(word: int) -> int:
        for b in range(22, 10, -1):
            if word >> b & 1:
                word ^= GENERATOR << (b - 11)
        return word

    single = np.array([remainder(1 << b) for b in range(23)], dtype=np.int64)
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= int(single[b])
            if weight < 4 or found[s][0].bit_count() == 3:
                found[s].append(sum(1 << b for b in bits))
    return single, np.array([(p + p[:1] * 6)[:6] for p in found], dtype=np.int64)


def codewords(words: np.ndarray) -> np.ndarray:
    """Indices (the 12 message bits) of the codewords near each 23-bit word, six columns:
    the nearest alone for even words and for odd words in the heart of a sphere, with
    repeats filling up; else the nearest and its five neighbours within distance four."""
    single, patterns = golay()
    syndrome = np.zeros(len(words), dtype=np.int64)
    for b in range(23):
        syndrome ^= np.where(words >> b & 1, single[b], 0)
    errors = patterns[syndrome]
    even = np.bitwise_count(words) % 2 == 0
    errors = np.where(even[:, None], errors[:, :1], errors)
    return (words[:, None] ^ errors) >> 11


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, key) for all its bucket keys, each once."""
    parts = [(prints >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    near = [codewords(p) for p in parts]
    at = np.arange(len(prints))
    who, out = [], []
    for k, p in enumerate(parts):
        who.append(at)
        out.append(np.int64(k) << 40 | p)
    for k, (a, b) in enumerate(combinations(range(3), 2)):
        pair = (near[a][:, :, None] << 12 | near[b][:, None, :]).reshape(len(prints), 36)
        who.append(np.repeat(at, 36))
        out.append((np.int64(3 + k) << 40 | pair).ravel())
    w, o = np.concatenate(who), np.concatenate(out)
    both = np.unique(np.stack([w, o], axis=1), axis=0) if len(w) else np.empty((0, 2), dtype=np.int64)
    return both[:, 0], both[:, 1]


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(prints), 4096):
            some = prints[at : at + 4096]
            who, key = keys(some.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(some[who])], ["bucket", "member"])


def linked_within(a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with a[i], b[j] at most ``bits`` apart; a block of a at a time."""
    out = []
    for at in range(0, len(a), 512):
        i, j = np.nonzero(np.bitwise_count(a[at : at + 512, None] ^ b[None, :]) <= bits)
        out.append((i + at, j))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of links among 0..n-1: at most n - 1 links with the same
    components, each from a vertex to its component's smallest."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        new = new[new[label]]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return list(zip(label[moved].tolist(), moved.tolist()))


def _verified(bits: int):
    def cell(lots: np.ndarray, prints: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        x = prints.view(np.uint64)
        if a == b:
            i, j = linked_within(x, x, bits)
            i, j = i[i < j], j[i < j]
        else:
            left, right = np.flatnonzero(lots == a), np.flatnonzero(lots == b)
            i, j = linked_within(x[left], x[right], bits)
            i, j = left[i], right[j]
        links = forest(i, j, len(x)) if len(i) else []
        return prints[[p for p, _ in links]], prints[[q for _, q in links]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches):
            bucket, prints, lots, a, b = (group[c] for c in ("bucket", "member", "lot", "lot_a", "lot_b"))
            first = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            size = np.diff(np.append(first, len(bucket)))
            out_a, out_b = [], []
            # Most buckets are small: shift by one, two, ... places to compare all at once.
            small = np.repeat(size <= 16, size)
            last = np.repeat(first + size, size)
            x = prints.view(np.uint64)
            here = np.flatnonzero(small)
            for shift in range(1, 16):
                here = here[here + shift < last[here]]
                if not len(here):
                    break
                near = np.bitwise_count(x[here] ^ x[here + shift]) <= bits
                near &= (a[here] == b[here]) | (lots[here] != lots[here + shift])
                out_a.append(prints[here[near]])
                out_b.append(prints[here[near] + shift])
            for f, n in zip(first[size > 16], size[size > 16]):
                p, q = cell(lots[f : f + n], prints[f : f + n], a[f], b[f])
                out_a.append(p)
                out_b.append(q)
            p, q = (np.concatenate(o) if o else np.empty(0, dtype=np.int64) for o in (out_a, out_b))
            once = np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1])], ["a", "b"])

    return run


def grouped(batches: Iterator[pa.RecordBatch], key: str = "cell", most: int = 200_000) -> Iterator[dict[str, np.ndarray]]:
    """Rows sorted by ``key``, some ``most`` at a time, whole groups only."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def flat(bs: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        table = pa.Table.from_batches(bs)
        return {n: table.column(n).to_numpy() for n in table.column_names}

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        ids = batch.column(key).to_numpy(zero_copy_only=False)
        cut_at = int(np.searchsorted(ids, ids[-1], side="left"))
        if cut_at == 0 and (len(held) == 1 or held[-2].column(key)[-1].as_py() == ids[0]):
            continue  # one group goes on
        out = [*held[:-1], batch.slice(0, cut_at)]
        held = [batch.slice(cut_at)]
        rows = held[0].num_rows
        yield flat(out)
    if held:
        yield flat(held)


def fingerprinted(docs: DataFrame, name: str, words_in_shingle: int = 4, seed: int = 42, text: str = "text") -> DataFrame:
    """``docs`` with the fingerprint (long, the bits as they are) in place of its text."""
    fields = [f for f in docs.schema.fields if f.name != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{name}` long"])
    return docs.mapInArrow(released(_fingerprints(words_in_shingle, seed, docs.columns.index(text), name)), schema)


def links_of(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints ``prints`` (fp) at most ``max_bits`` (4 or
    fewer) bits apart; a pair may come more than once."""
    if max_bits > 4:
        raise ValueError("the segments' keys are complete for at most 4 differing bits")
    # Each fingerprint has some 26 keys: deal them out before that.
    spread = prints.select("fp").repartition(fan_out(session_of(prints)), "fp")
    members = spread.mapInArrow(released(_bucketed), "bucket long, member long")
    return arranged(dealt(members, CELL)).select("cell", "bucket", "member", "lot", "lot_a", "lot_b").mapInArrow(released(_verified(max_bits)), "a long, b long")


def classes(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """``prints`` (doc_id, fp) to (fp, root, component_id): for each distinct fingerprint
    its class (the smallest linked fingerprint) and the smallest doc_id among the documents whose fingerprints it reaches by links of at most
    ``max_bits`` (4 or fewer) differing bits. Only distinct fingerprints are compared, so
    a group of copies is one of them, whatever its size."""
    least = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links_of(least, max_bits))
    # Few fingerprints have links; the others are their own class.
    linked = least.join(roots.withColumnRenamed("node", "fp"), "fp")
    own = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(own, "root").select("fp", "root", "component_id")
    alone = F.col("root").isNull()
    return cut(
        least.join(named, "fp", "left").select(
            "fp", F.coalesce("root", "fp").alias("root"), F.when(alone, F.col("least")).otherwise(F.col("component_id")).alias("component_id")
        )
    )


def near_duplicates(docs: DataFrame, max_bits: int = 4, words_in_shingle: int = 4, seed: int = 42) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, fingerprint (16 lower-case
    hexadecimal digits), component_id, kept (doc_id = component_id).

    Null or empty text: fingerprint zero, linked like any other. Null doc_id: takes part,
    never names a class that has another; component_id is null if it has none. Repeated
    rows: one row each, in one class. Very long texts: read whole. Empty table: no rows.
    Other columns: ignored."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = cut(fingerprinted(slim, "fp", words_in_shingle, seed))
    found = prints.join(classes(prints, max_bits), "fp")
    return found.select("doc_id", unsigned_hex("fp").alias("fingerprint"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, max_bits: int = 4, words_in_shingle: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: that of the class's smallest
    doc_id; of rows that share it, the one whose text hashes lowest. All columns stay."""
    own, least, order = fresh(docs, "doc", "component", "order")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("digest"))
    prints = cut(fingerprinted(slim, "fp", words_in_shingle, seed))
    chosen = (
        prints.join(classes(prints, max_bits), "fp")
        .filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root", F.col("doc_id").alias(least)).agg(F.min("digest").alias(order))
        .drop("root")
    )
    return _one_row_each(docs, chosen, own, least, order)


def _one_row_each(docs: DataFrame, chosen: DataFrame, own: str, least: str, order: str) -> DataFrame:
    from pyspark.sql import Window

    (number,) = fresh(docs, "number")
    keyed = docs.withColumn(own, F.col("doc_id").cast("long"))
    kept = keyed.join(chosen, keyed[own].eqNullSafe(chosen[least]) & (F.xxhash64(keyed["text"]) == chosen[order]))
    # Rows alike in doc_id and text: one of them, told by the rest of the row.
    same = Window.partitionBy(own, order).orderBy(*[c for c, t in docs.dtypes if not t.startswith(("map", "variant"))])
    return kept.withColumn(number, F.row_number().over(same)).filter(F.col(number) == 1).select(*docs.columns)

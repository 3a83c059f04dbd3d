"""Repeated passages by line and paragraph hashing.

A text's units end at words whose hash is the least among their neighbours, and the words
at which a line or a sentence ends are given lower hashes than others. So a unit is mostly
some whole lines or sentences, long ones are cut where the text itself says so, and a
passage is cut alike wherever it stands, in the middle of another line too. Neighbouring
units of at least ``PARAGRAPH`` words together are a paragraph; one starts at every unit.
Words are normalised (Unicode compatibility, case folded), paragraphs hashed and their
digests grouped globally: the earliest occurrence, by document and place, is the one that
the others are held against.

Paragraphs that lie side by side here and there are one match, and each match is extended
word by word to both sides as far as the earlier place goes on alike. What has fewer than
``LEAST_WORDS`` words then, such as a common line, stays. The rest is a removed span with
its offsets in the original text. Each removed word stands at an earlier place too, so
following these places ends at one that stays.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import cut, fresh, keeps, released, text_of
from .licenses import _POWERS, _mixed

#: Passages of fewer words are never removed; a paragraph has at least so many words.
LEAST_WORDS, PARAGRAPH = 50, 8
#: A word ends a unit if its hash is the least of so many words to either side.
RADIUS = 6
#: Hashes of words that end a line or a sentence lose so many of their highest bits.
LINE, SENTENCE = 6, 4
#: Words that end a sentence end with one of these, closing marks aside.
STOPS, CLOSERS = tuple(".!?…。！？।؟"), "\"'”’»)]}"
#: Characters of text that are hashed at a time, and words that a worker keeps with their hash.
CHUNK, MOST_WORDS = 1 << 20, 120_000
#: Bits of a block of a sieve, and most blocks: at most 8 MB go to each executor.
BLOCK, MOST_BLOCKS = 1 << 16, 1 << 10

#: Scripts written without blanks: each of their characters is a word.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_BLANK = np.array([chr(c).isspace() for c in range(0x3001)])


def normal(word: str) -> str:
    return (word if word.isascii() else unicodedata.normalize("NFKC", word)).casefold()


class Hashes(dict):
    """Words to their hashes, which are odd where the word ends a sentence."""

    def __missing__(self, word: str) -> int:
        plain = normal(word)
        ends = plain.rstrip(CLOSERS).endswith(STOPS)
        found = xxh3_64_intdigest(plain.encode("utf-8", "surrogatepass")) & ~1 | ends
        if len(self) < MOST_WORDS:
            self[word] = found
        return found


_HASHES = Hashes()
keeps(__name__, _HASHES.clear)


class Words:
    """The words of some texts, one after another: start and end (characters of the joined
    texts), hash, and by how much their rank is less as a line or sentence ends there. ``first`` are the texts'
    first words, with their total at the end; ``begin`` the texts' first characters."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        inside = ~_BLANK[np.minimum(chars, len(_BLANK) - 1)]
        inside[chars >= len(_BLANK)] = True
        alone = np.zeros(len(chars), dtype=bool)
        if len(chars) and chars.max() >= _UNSPACED[0][0]:
            for low, high in _UNSPACED:
                alone |= (chars >= low) & (chars <= high)
            alone &= inside
        edge = np.ones(len(chars) + 1, dtype=bool)  # a word may start or have ended here
        edge[1:-1] = ~inside[1:] | ~inside[:-1] | alone[1:] | alone[:-1]
        self.start = np.flatnonzero(inside & edge[:-1])
        self.end = np.flatnonzero(inside & edge[1:]) + 1
        words = [joined[a:b] for a, b in zip(self.start.tolist(), self.end.tolist())] if alone.any() else joined.split()
        self.hash = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
        self.begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, self.begin)
        lines = np.flatnonzero(chars == 10)
        # Words after which a line, or all, ends: the last ones before each line end.
        last = np.searchsorted(self.start, lines) - 1
        self.stop = (self.hash & np.uint64(1)).astype(np.uint64) * np.uint64(SENTENCE)
        self.stop[last[last >= 0]] = LINE

    def units(self) -> np.ndarray:
        """First words of the units, with the number of words at the end."""
        n = len(self.hash)
        if not n:
            return np.zeros(1, dtype=np.int64)
        before = np.concatenate([[np.uint64(0)], self.hash[:-1]])
        before[self.first[self.first < n]] = 0
        with np.errstate(over="ignore"):
            rank = _mixed(self.hash ^ _mixed(before, 5), 6) | np.uint64(1)
        rank >>= self.stop
        rank[self.first[self.first > 0] - 1] = 0  # a text's last word
        around = np.zeros(RADIUS, dtype=np.uint64)
        padded = np.concatenate([around, rank, around])
        before, after = padded[:n].copy(), padded[RADIUS + 1 : RADIUS + 1 + n].copy()
        for k in range(1, RADIUS):
            np.minimum(before, padded[k : k + n], out=before)
            np.minimum(after, padded[RADIUS + 1 + k : RADIUS + 1 + k + n], out=after)
        return np.concatenate([[0], np.flatnonzero((rank < before) & (rank <= after) | (rank == 0)) + 1])

    def digests(self, at: np.ndarray, till: np.ndarray) -> np.ndarray:
        """Hashes of the words from ``at`` up to ``till``. They are held to 64 bits, as what
        they let meet is compared word by word outside the paragraph."""
        up, down = _POWERS.upto(len(self.hash) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum((self.hash | np.uint64(1)) * up[: len(self.hash)])])
            return _mixed((sums[till] - sums[at]) * down[at], 13).view(np.int64)

    def paragraphs(self, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, word after the last) of the paragraphs of the texts that
        have ``least_words`` words."""
        bounds = self.units()
        at = bounds[:-1]
        text = np.searchsorted(self.first, at, side="right") - 1
        place = np.searchsorted(bounds, at + PARAGRAPH)
        till = bounds[np.minimum(place, len(bounds) - 1)]
        own = np.diff(self.first)[text] >= least_words
        keep = own & (place < len(bounds)) & (till <= self.first[np.minimum(text + 1, len(self.first) - 1)])
        return text[keep], at[keep], till[keep]


def chunks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) of some ``CHUNK`` characters; null is empty."""
    for at in range(0, len(texts), 512):
        held, size, first = [], 0, at
        for t in texts.slice(at, 512).to_pylist():
            held.append(text_of(t))
            size += len(held[-1])
            if size >= CHUNK:
                yield first, held
                first, held, size = first + len(held), [], 0
        if held:
            yield first, held


def _paragraphs(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for first, texts in chunks(batch.column(2)):
                words = Words(texts)
                text, at, till = words.paragraphs(least_words)
                take = pa.array(text + first)
                columns = [ids.take(take), keys.take(take), *(pa.array(x.astype(np.int32)) for x in (at - words.first[text], till - at)), pa.array(words.digests(at, till))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "doc_key", "at", "n", "digest"])

    return run


def _context(reach: int):
    """(doc_id, doc_key, text, [word]) to the words before and after each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                around = Around(text_of(batch.column(2)[k].as_py()), reach)
                places = batch.column(3)[k].values.to_pylist()
                n = pa.array([k] * len(places))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(n), batch.column(1).take(n), pa.array(places, pa.int32()), pa.array(map(around.before, places), pa.binary()), pa.array(map(around.after, places), pa.binary())],
                    ["doc_id", "doc_key", "place", "before", "after"],
                )

    return run


class Around:
    """The ``reach`` words before (backwards) and after places of a text, four bytes of
    hash each."""

    def __init__(self, text: str, reach: int):
        self.words = Words([text])
        short = (self.words.hash >> np.uint64(32)).astype("<u4")
        self.reach, self.onward, self.backward = 4 * reach, short.tobytes(), short[::-1].tobytes()

    def before(self, place: int) -> bytes:
        at = len(self.backward) - 4 * place
        return self.backward[at : at + self.reach]

    def after(self, place: int) -> bytes:
        return self.onward[4 * place : 4 * place + self.reach]


def alike(a: bytes, b: bytes) -> int:
    """Number of first words that agree."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // 4
    return int(np.flatnonzero(np.frombuffer(a[:n], "<u4") != np.frombuffer(b[:n], "<u4"))[0])


def spans(text: str, matches: list[dict], least_words: int) -> list[tuple[int, int, int, int | None, int]]:
    """(start, end, words, kept_doc_id, kept_word) of what goes from ``text``; a match has
    at, till (words), shift, before, after (the earlier place's words) and kept."""
    around = Around(text, least_words)
    found = []
    for m in matches:
        at = m["at"] - alike(around.before(m["at"]), m["before"])
        till = m["till"] + alike(around.after(m["till"]), m["after"])
        if till - at >= least_words:
            found.append((at, till, till - at, m["kept"], at - m["shift"]))
    found.sort(key=lambda x: x[:2])
    out: list[list] = []
    for f in found:
        if out and f[0] <= out[-1][1]:
            if f[1] > out[-1][1]:
                best = f if f[2] > out[-1][2] else out[-1]
                out[-1] = [out[-1][0], f[1], *best[2:]]
        else:
            out.append(list(f))
    starts = np.append(around.words.start, len(text))
    return [(int(starts[a]), int(starts[b]), b - a, kept, word) for a, b, _, kept, word in out]


MATCH = "struct<at:int,till:int,shift:int,kept:long,before:binary,after:binary>"


def _identified(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("doc_key"), text.alias("text"))


def _long_enough(docs: DataFrame, least_words: int) -> DataFrame:
    """Texts that have room for so many words; Thai or Chinese ones need no blanks."""
    return _identified(docs).filter(F.length("text") >= least_words)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, bit) to one row a block, with its bits as bytes."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        block, bit = (c.to_numpy() for c in batch.columns)
        order = np.argsort(block, kind="stable")
        names, first = np.unique(block[order], return_index=True)
        for b, bits in zip(names.tolist(), np.split(bit[order], first[1:])):
            np.bitwise_or.at(held.setdefault(b, np.zeros(BLOCK // 8, dtype=np.uint8)), bits >> 3, (1 << (bits & 7)).astype(np.uint8))
    for b, bits in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([bits.tobytes()], pa.binary())], ["block", "bits"])


def sieved(slim: DataFrame, asked: DataFrame, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """The documents of ``slim`` that may be among ``asked`` (a_id, a_key; checkpointed), so
    that others' texts need not move to be joined. Each asked one has a bit, of 16 or more
    for each up to ``most_blocks`` blocks; beyond these more of the others come through, and
    none that is asked ever goes."""
    blocks = 1
    many = asked.count()
    while blocks < most_blocks and blocks * BLOCK < 16 * many:
        blocks *= 2
    place = lambda *key: F.pmod(F.xxhash64(*key, F.lit(0)), F.lit(blocks * BLOCK))
    at = asked.select(place("a_id", "a_key").alias("place")).select(F.floor(F.col("place") / BLOCK).alias("block"), (F.col("place") % BLOCK).alias("bit"))
    table = at.repartition("block").mapInArrow(_blocks, "block long, bits binary").withColumnRenamed("block", "its_block")
    own = slim.withColumn("place", place("doc_id", "doc_key"))
    there = own.join(F.broadcast(table), F.floor(F.col("place") / BLOCK) == F.col("its_block"))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("place") % BLOCK / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return there.filter(F.floor(byte / F.pow(F.lit(2), F.col("place") % 8)) % 2 == 1).select(*slim.columns)


def matches(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, doc_key, found): for each document of ``docs`` its matches with earlier
    places, not yet extended, with ``least_words`` words of the earlier place around them."""
    slim = _long_enough(docs, least_words)
    # Read again rather than kept: hashing twice is cheaper than writing every digest.
    rows = slim.mapInArrow(released(_paragraphs(least_words)), "doc_id long, doc_key long, at int, n int, digest long")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc_key", "at")
    # Cut, so that the join has two plain exchanges and a hot digest's rows can be split.
    first = cut(rows.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c"))
    met = rows.join(first, "digest").filter(place != F.col("first"))
    other = ["kept", "kept_key", "shift"]
    met = met.select("doc_id", "doc_key", "at", (F.col("at") + F.col("n")).alias("till"), F.col("first.doc_id").alias("kept"), F.col("first.doc_key").alias("kept_key"), (F.col("at") - F.col("first.at")).alias("shift"))
    row = ["doc_id", "doc_key", *other]
    series = Window.partitionBy(*row).orderBy("at", "till")
    reached = F.max("till").over(series.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce((F.col("at") > F.col("reached")).cast("int"), F.lit(1))
    runs = met.withColumn("reached", reached).withColumn("begins", begins).withColumn("run", F.sum("begins").over(series.rowsBetween(Window.unboundedPreceding, 0)))
    runs = cut(runs.groupBy(*row, "run").agg(F.min("at").alias("at"), F.max("till").alias("till")).drop("run"))
    # The words around both ends of each match, once for each earlier place.
    ends = F.array(F.col("at") - F.col("shift"), F.col("till") - F.col("shift"))
    asked = runs.select("kept", "kept_key", F.explode(ends).alias("place")).distinct()
    asked = asked.groupBy(F.col("kept").alias("doc_id"), F.col("kept_key").alias("doc_key")).agg(F.collect_list("place").alias("places"))
    asked = cut(asked.select(F.col("doc_id").alias("a_id"), F.col("doc_key").alias("a_key"), "places"))
    held = sieved(slim, asked).join(asked, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("doc_key") == F.col("a_key"))).select("doc_id", "doc_key", "text", "places")
    around = held.mapInArrow(released(_context(least_words)), "doc_id long, doc_key long, place int, before binary, after binary")
    around = around.groupBy("doc_id", "doc_key", "place").agg(F.first("before").alias("before"), F.first("after").alias("after"))
    around = cut(around)

    for side, at, column in (("a", "at", "before"), ("b", "till", "after")):
        there = around.select(F.col("doc_id").alias(f"{side}_id"), F.col("doc_key").alias(f"{side}_key"), F.col("place").alias(f"{side}_place"), column)
        same = runs["kept"].eqNullSafe(there[f"{side}_id"]) & (runs["kept_key"] == there[f"{side}_key"]) & (runs[at] - runs["shift"] == there[f"{side}_place"])
        runs = runs.join(there, same).drop(f"{side}_id", f"{side}_key", f"{side}_place")
    found = F.struct("at", "till", "shift", "kept", "before", "after").cast(MATCH)
    return cut(runs.groupBy("doc_id", "doc_key").agg(F.collect_list(found).alias("found")))


def _spans(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "end", "n_words", "kept_doc_id", "kept_word", "doc_key"]
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                doc, key, text, found = (c[k].as_py() for c in batch.columns)
                rows += [(doc, *s, key) for s in spans(text_of(text), found, least_words)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(names))], names)

    return run


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row for each passage of ``docs`` (doc_id, text) that goes: doc_id, start, end
    (characters of the original text, the blanks up to the next word included), n_words,
    kept_doc_id, kept_word (the document and the number of words before it, where its
    longest match stands earlier), and doc_key (a hash of the whole text).

    A passage is a run of ``least_words`` words or more that stands at an earlier place
    with a whole paragraph in it. What repeats after ``RADIUS`` words or fewer, such as one
    word over and over, is no passage of itself but one unit. Null or empty texts: no passages. Null doc_id: last in
    rank. Rows alike in doc_id and text are one document: their passages stay or go
    together, and each row has its own. Ties: doc_id, then the text's hash, then the word.
    Very long texts: read whole. Empty table: no rows. Other columns: ignored."""
    slim, found = _long_enough(docs, least_words), matches(docs, least_words)
    found = found.withColumnsRenamed({"doc_id": "a_id", "doc_key": "a_key"})
    held = sieved(slim, found).join(found, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("doc_key") == F.col("a_key"))).select("doc_id", "doc_key", "text", "found")
    return held.mapInArrow(released(_spans(least_words)), "doc_id long, start long, end long, n_words long, kept_doc_id long, kept_word long, doc_key long")


def _cut_out(text_at: int, chars_at: int | None, found_at: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                out, cuts, keep = [], [], []
                for text, found in zip(some.column(text_at).to_pylist(), some.column(found_at).to_pylist()):
                    gone = spans(text_of(text), found, least_words) if found else []
                    if gone:
                        parts, done = [], 0
                        for start, end, *_ in gone:
                            parts.append(text[done:start])
                            done = end
                        text = "".join([*parts, text[done:]])
                    out.append(text)
                    cuts.append(bool(gone))
                    keep.append(not gone or bool(text.strip()))
                columns = [c for i, c in enumerate(some.columns) if i != found_at]
                columns[text_at] = pa.array(out, some.schema.field(text_at).type)
                if chars_at is not None:
                    old = some.column(chars_at).to_pylist()
                    columns[chars_at] = pa.array([len(t) if c else o for t, c, o in zip(out, cuts, old)], some.schema.field(chars_at).type)
                names = [n for i, n in enumerate(some.schema.names) if i != found_at]
                yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    return run


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, chars: str = "n_chars") -> DataFrame:
    """``docs`` with repeated passages cut out of their texts; all columns stay, and
    ``chars``, if there is an integer column of that name, follows the text. Documents of
    which nothing but blanks is left go. See ``repeated_passages`` for nulls, ties and
    repeats."""
    own, key, found = fresh(docs, "doc", "key", "found")
    there = matches(docs, least_words).select(F.col("doc_id").alias(f"{own}_"), F.col("doc_key").alias(f"{key}_"), F.col("found").alias(found))
    keyed = docs.withColumns({own: F.col("doc_id").cast("long"), key: F.xxhash64(F.col("text").cast("string"))})
    joined = keyed.join(there, (keyed[key] == there[f"{key}_"]) & keyed[own].eqNullSafe(there[f"{own}_"]), "left")
    out = joined.select(*[keyed[f"`{c}`"] for c in docs.columns], found)
    text_at = docs.columns.index("text")
    at = docs.columns.index(chars) if chars in docs.columns and dict(docs.dtypes)[chars] in ("int", "bigint") else None
    return out.mapInArrow(released(_cut_out(text_at, at, len(docs.columns), least_words)), docs.schema)

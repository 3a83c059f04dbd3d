"""Token counts by a compiled finite-state tokenizer.

Byte-pair merging is compiled to a deterministic transducer whose transitions are annotated
with the tokens that they emit (``merges``), and stands below the splitting automaton of the
byte-level pattern; a state of the whole is the splitter's with the transducer's. Counts
only ever add up emissions; those of whole pieces are kept, as they start from one state.

A chunk of text is a map of states to states and counts. A blank that follows a non-blank
always starts a new piece, whatever came before: from there on the map is the same for all
states, so a map is what stands before that place, a count, and the state at the end. Maps
compose associatively and are combined by a prefix scan in log-many rounds; a whole text's
count is its map at the start state.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keeps, released, text_of
from .merges import Memo, MergeTransducer

#: Bound on the pieces that a worker keeps with their counts, and the chunk's characters.
MOST_PIECES, CHUNK = 120_000, 1 << 16

#: Character classes of the splitting automaton.
LETTER, NUMBER, SPACE, BLANK, QUOTE, OTHER = range(6)


@lru_cache(maxsize=1 << 16)
def kind(c: str) -> int:
    if c == " ":
        return SPACE
    if c == "'":
        return QUOTE
    import regex

    return LETTER if regex.match(r"\p{L}", c) else NUMBER if regex.match(r"\p{N}", c) else BLANK if regex.match(r"\s", c) else OTHER


def split(text: str) -> list[str]:
    """Pieces of a byte-level pattern: contractions; letters, numbers or other signs with
    one space before them; runs of blanks, the last of which is left to what follows."""
    out, i, n = [], 0, len(text)
    kinds = [kind(c) for c in text]
    while i < n:
        if kinds[i] == QUOTE:
            if text[i + 1 : i + 2] in ("s", "t", "m", "d") and i + 1 < n:
                out.append(text[i : i + 2])
                i += 2
                continue
            if text[i + 1 : i + 3] in ("re", "ve", "ll"):
                out.append(text[i : i + 3])
                i += 3
                continue
        j = i + 1 if kinds[i] == SPACE and i + 1 < n and kinds[i + 1] not in (SPACE, BLANK) else i
        k = kinds[j]
        e = j + 1
        if k in (SPACE, BLANK):
            while e < n and kinds[e] in (SPACE, BLANK):
                e += 1
            if e < n and e - j > 1:
                e -= 1
        else:
            same = (OTHER, QUOTE) if k in (OTHER, QUOTE) else (k,)
            while e < n and kinds[e] in same:
                e += 1
        out.append(text[i:e])
        i = e
    return out


def pieces_of(part: str) -> list[str]:
    """Pieces of a part that a synchronising blank preceded. Letters, letters with one
    closing mark, and two parts with one line end between them are split without looking
    at each character."""
    if part.isalpha():
        return [" " + part]
    if part[-1] in ".,;:!?" and part[:-1].isalpha():
        return [" " + part[:-1], part[-1]]
    a, line_end, b = part.partition("\n")
    if line_end and a and b and not a[-1].isspace() and not b[0].isspace():
        return pieces_of(a) + ["\n"] + ([b] if b.isalpha() else split(b))
    return split(" " + part)


#: A blank that follows a non-blank starts a piece whatever came before it.
SYNC = re.compile(r"(?<=\S) ")
BLANKS = re.compile(r"\s ")
SHORT, LONG, BEGUN = ("'s", "'t", "'m", "'d"), ("'re", "'ve", "'ll"), ("'r", "'v", "'l")

#: What the whole machine remembers: the kind of the piece it is in (None: at a border),
#: the merge transducer's state there, and characters of which it is not yet decided where
#: they belong (the last blank of a run, the beginning of a contraction).
State = tuple[int | None, bytes, str]


class Counter:
    """Counts tokens of whole texts with one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.machine = MergeTransducer(spec["model"]["vocab"], spec["model"]["merges"])
        self.fresh = self.machine.meaning[0]
        self.start: State = (None, self.fresh, "")
        self.synchronised: State = (BLANK, self.fresh, " ")
        self.pieces = Memo(lambda new: self.machine.count_many([p.encode() for p in new]).tolist(), MOST_PIECES)
        self.segments = Memo(self._segments, MOST_PIECES)

    def _segments(self, parts: list[str]) -> list[int]:
        """Counts of parts that a synchronising blank preceded."""
        split_ = list(map(pieces_of, parts))
        self.pieces.fill(set(chain.from_iterable(split_)))
        count = self.pieces.__getitem__
        return [sum(map(count, p)) for p in split_]

    def run(self, state: State, text: str) -> tuple[State, int]:
        """The machine's state after ``text`` from ``state``, and the tokens emitted."""
        (k, m, pending), total, i, n = state, 0, 0, len(text)
        feed = lambda m, s: self.machine.advance(m, s.encode())
        while i < n:
            c = text[i]
            q = kind(c)
            if k is None:
                k, m = (BLANK if q == SPACE else q), self.fresh
                if k in (BLANK, QUOTE):
                    pending, i = c, i + 1
            elif k == BLANK and q in (SPACE, BLANK):
                m, x = feed(m, pending)
                total, pending, i = total + x, c, i + 1
            elif k == BLANK:  # a run's last blank goes with what follows if it is a space
                m, x = feed(self.fresh, pending)
                k = None if pending != " " else OTHER if q == QUOTE else q
                total, pending = total + x, ""
            elif k == QUOTE:
                if pending + c in SHORT + LONG:
                    total += feed(self.fresh, pending + c)[1]
                    k, pending, i = None, "", i + 1
                elif pending + c in BEGUN:
                    pending, i = pending + c, i + 1
                else:  # no contraction: a mark, and maybe a letter after it
                    m, x = feed(self.fresh, "'")
                    k, total = OTHER, total + x
                    if len(pending) > 1:
                        m, x = feed(self.fresh, pending[1:])
                        k, total = LETTER, total + x
                    pending = ""
            elif q == k or k == OTHER and q == QUOTE:
                e = i + 1
                while e < n and ((q := kind(text[e])) == k or k == OTHER and q == QUOTE):
                    e += 1
                m, x = feed(m, text[i:e])
                total, i = total + x, e
            else:
                k = None
        return (k, m if k is not None else self.fresh, pending), total

    def finish(self, state: State) -> int:
        """Tokens that are emitted where a text ends, or a synchronising blank follows."""
        k, m, pending = state
        if k == BLANK:
            return self.machine.advance(m, pending.encode())[1]
        return sum(self.machine.advance(self.fresh, p.encode())[1] for p in (pending[:1], pending[1:]) if p) if k == QUOTE else 0

    def chunk_parts(self, chunk: str) -> list[str]:
        """The chunk at its synchronising places: the head, then what each place's blank
        precedes. The place before a chunk's first character is never taken for one, as
        what stands before it is not known here."""
        parts = SYNC.split(chunk) if BLANKS.search(chunk) else chunk.split(" ")
        if parts[0] == "" and len(parts) > 1:  # a leading blank belongs to the head
            parts[:2] = [" " + parts[1]]
        return parts

    def chunk_map(self, parts: list[str]) -> tuple[str, int, State | None]:
        """A chunk's map of states to states and counts, as (head, count, exit): the state
        it is entered in matters up to its first synchronising place, so for the head only;
        from there on it counts ``count`` and ends in ``exit``. Without such a place (exit
        None) the head is all."""
        if len(parts) == 1:
            return parts[0], 0, None
        end, n = self.run(self.synchronised, parts[-1])
        return parts[0], sum(map(self.segments.__getitem__, parts[1:-1])) + n, end

    def compose(self, a: tuple[str, int, State | None], b: tuple[str, int, State | None]) -> tuple[str, int, State | None]:
        """The map of two neighbouring chunks. A place where they meet may synchronise, but
        need not be told: the state that the first ends in is enough."""
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        state, n = self.run(a[2], b[0])
        return (a[0], a[1] + n, state) if b[2] is None else (a[0], a[1] + n + self.finish(state) + b[1], b[2])

    def total(self, whole: tuple[str, int, State | None]) -> int:
        """A text's tokens: its map at the start state."""
        state, n = self.run(self.start, whole[0])
        return n + self.finish(state) + (whole[1] + self.finish(whole[2]) if whole[2] is not None else 0)

    def plain(self, texts: list[str]) -> list[int]:
        """Counts of texts without special strings."""
        chunked = [[self.chunk_parts(t[i : i + CHUNK]) for i in range(0, max(1, len(t)), CHUNK)] for t in texts]
        self.segments.fill({p for chunks in chunked for parts in chunks for p in parts[1:-1]})
        # Texts of one chunk: both ends are whole pieces, whose counts are kept.
        ends = {t: (split(c[0][0]) if c[0][0] else [], pieces_of(c[0][-1]) if c[0][-1] else [" "]) for t, c in enumerate(chunked) if len(c) == 1 and len(c[0]) > 1}
        ends |= {t: (split(c[0][0]) if c[0][0] else [], []) for t, c in enumerate(chunked) if len(c) == 1 and len(c[0]) == 1}
        self.pieces.fill({p for both in ends.values() for p in chain(*both)})
        count, out = self.pieces.__getitem__, []
        for t, chunks in enumerate(chunked):
            if (end := ends.get(t)) is not None:
                out.append(sum(map(count, chain(*end))) + sum(map(self.segments.__getitem__, chunks[0][1:-1])))
                continue
            maps = [self.chunk_map(parts) for parts in chunks]
            while len(maps) > 1:  # the scan: neighbours compose, in log-many rounds
                maps = [self.compose(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
            out.append(self.total(maps[0]))
        return out

    def __call__(self, texts: list[str]) -> list[int]:
        if self.special_pattern is None:
            return self.plain(texts)
        cut = [self.special_pattern.split(t) if any(s in t for s in self.special) else [t] for t in texts]
        counts = iter(self.plain([p for parts in cut for p in parts]))
        return [len(parts) - 1 + sum(next(counts) for _ in parts) for parts in cut]


_COUNTERS: dict[str, Counter] = {}
keeps(__name__, _COUNTERS.clear)


def counter_of(path: str) -> Counter:
    """One compiled machine for each worker and vocabulary."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter_of(path)
        for batch in batches:
            texts = batch.column(1)
            sizes, tokens = [], []
            for at in range(0, len(texts), 256):
                some = list(map(text_of, texts.slice(at, 256).to_pylist()))
                sizes += [len(t) if t.isascii() else len(t.encode()) for t in some]
                tokens += count(some)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


COUNTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_bytes (UTF-8), n_tokens,
    over_limit (n_tokens > ``limit``), for a byte-level vocabulary file.

    Null text: empty, 0 tokens. Null doc_id: kept as null. Repeated rows: one row each.
    Very long texts: any length, in chunks. Special strings inside texts: one token each,
    as the library does by default. Empty table: no rows. Other columns: ignored. It is one
    map over the scan: no shuffle."""
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return docs.select(*columns).mapInArrow(released(_counted(vocabulary)), COUNTS).withColumn("over_limit", F.col("n_tokens") > limit)

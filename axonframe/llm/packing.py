"""Packing documents into fixed windows: minimum bin slack.

A document is its token ids and one closing id. Documents longer than a window are cut
into full windows and a rest; the rests of a block are packed by minimum bin slack: the
longest rest opens a window, and a bitset dynamic programme over the block's multiset of
remaining lengths (one machine integer holds all reachable sums; counts are split
binarily) finds the multiset of lengths that fills the window closest to its capacity;
its counts are read back and those pieces leave the block. Pieces of windows that stay
short wait for the next block; once they hold more than half a block they are cut to fill
windows. What the last windows of a partition hold is cut into sequences whose lengths are
powers of two, which need no padding.

Everything happens where the rows are read: no shuffle, and memory is bounded by the
block (``block_tokens``) whatever the size of a partition or of a document.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keeps, released
from .merges import Memo, MergeTransducer

#: Words of Latin-1 letters, then ASCII signs other than digits and the quote.
LETTERS_AND_SIGNS = r"([A-Za-zÀ-ÖØ-öø-ÿ]{1,%d})([!-&(-/:-@\[-`{-~]*)"

#: Bound on the strings that a worker keeps with the library's ids; words of more letters
#: than the second are left to the library.
MOST_WORDS, LONGEST = 20_000, 20_000
#: A word on each line: its letters and signs, or all of it.
LINES = re.compile(f"(?m)^(?:{LETTERS_AND_SIGNS % LONGEST}|(.+))$")
#: Bytes of text that are taken apart at once; longer texts are cut at blanks.
BLOCK = 1 << 20


def _bytes(pattern: str) -> np.ndarray:
    """Which ASCII bytes ``pattern`` matches, by byte."""
    return np.array([b < 128 and bool(re.match(pattern, chr(b))) for b in range(256)])


BLANK, UPPER, LETTER, SIGN = map(_bytes, (r"[ \t-\r]", "[A-Z]", "[A-Za-z]", r"[!-&(-/:-@\[-`{-~]"))


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of segments, one segment after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _distinct(data: np.ndarray, sizes: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """Distinct strings among those of ``sizes`` in ``data``, and which of them each one is."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def _opened(strings: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of strings without nulls, and where each begins and the last ends."""
    _, ends, data = strings.buffers()
    at = np.frombuffer(ends, np.int64, len(strings) + 1, 8 * strings.offset) if len(strings) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), at


class WordIds:
    """Token ids of whole texts, by blank-separated word.

    The tokenizer drops white space before it merges, so a text's ids are its words' ids
    one after another, kept as two-byte numbers. A block's texts are taken apart as bytes,
    at the six ASCII blanks, and each distinct word is encoded once. Words of Latin letters
    go through the compiled merges; all others go to the tokenizers library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("ids must fit in two bytes")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.special = spec["model"], [t["content"] for t in spec["added_tokens"]]
        self.machine = MergeTransducer(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        if any(LINES.fullmatch(t)[1] for t in self.special):
            raise ValueError("a special string looks like a word with its closing signs")
        self.mark_end = bool(model["end_of_word_suffix"])
        self.memo = Memo(self._library, MOST_WORDS)

    def _library(self, words: list[bytes]) -> list[np.ndarray]:
        return [np.asarray(self.library.encode(w.decode(), add_special_tokens=False).ids, dtype="<u2") for w in words]

    def _words(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, side by side, and the number of each."""
        raw, at = _opened(words)
        starts, sizes = at[:-1], np.diff(at)
        letter, low = LETTER[raw], raw + (UPPER[raw] << 5).astype(np.uint8)
        lead = np.flatnonzero(raw[:-1] == 0xC3)  # À to ÿ but for two signs; capitals end before ß
        lead = lead[(raw[lead + 1] >= 0x80) & (raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
        letter[lead] = letter[lead + 1] = True
        low[lead + 1] += np.where(raw[lead + 1] < 0x9F, np.uint8(32), np.uint8(0))
        again = np.concatenate([[False], letter[1:] > letter[:-1]])  # letters after something else
        again[starts] = False
        letters, signs, broken = (np.add.reduceat(x.astype(np.int64), starts) for x in (letter, SIGN[raw], again))
        plain = (letters > 0) & (letters + signs == sizes) & (broken == 0)
        for i in np.flatnonzero(plain & (letters > 100)):
            plain[i] = LINES.fullmatch(words[i].as_py().decode())[1] is not None
        bases, base = _distinct(low[_places(starts[plain], letters[plain])], letters[plain])
        # No letters before them can change the ids of ASCII signs without a quote.
        marks, mark = _distinct(raw[_places((starts + letters)[plain], signs[plain])], signs[plain])
        data, ends = _opened(bases)
        tokens, counts = self.machine.encode_many(data[ends[0] : ends[-1]], np.diff(ends), mark_end=self.mark_end)
        others = [*marks.to_pylist(), *words.filter(pa.array(~plain)).to_pylist(), b""]
        self.memo.fill(set(others))
        found = list(map(self.memo.__getitem__, others))
        tokens = np.concatenate([tokens.astype("<u2"), *found])
        counts = np.concatenate([counts, np.fromiter(map(len, found), np.int64, len(found))])
        # A word is its base and its mark, or one of the others and nothing.
        parts = np.full((len(words), 2), len(counts) - 1)
        parts[plain, 0], parts[plain, 1] = base, len(bases) + mark
        parts[~plain, 0] = np.arange(len(bases) + len(marks), len(counts) - 1)
        return tokens[_places((np.cumsum(counts) - counts)[parts.ravel()], counts[parts.ravel()])], counts[parts].sum(axis=1)

    def _block(self, data: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Ids of the texts of ``data`` that begin and end at ``at``."""
        solid = ~BLANK[data]
        first = np.concatenate([[False], solid])[:-1] < solid
        begins = at[:-1][at[:-1] < len(data)]
        first[begins] = solid[begins]
        words = np.searchsorted(np.flatnonzero(first), at)
        if not words[-1]:
            return [b""] * (len(at) - 1)
        kept = data[solid]
        distinct, which = _distinct(kept, np.diff(np.flatnonzero(first[solid]), append=len(kept)))
        tokens, counts = self._words(distinct)
        starts, counts = (np.cumsum(counts) - counts)[which], counts[which]
        ids = tokens[_places(starts, counts)].tobytes()
        cuts = (2 * np.concatenate([[0], np.cumsum(counts)])[words]).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def each(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text (null: empty), in turn."""
        data, at = _opened(texts.cast(pa.large_binary()).fill_null(b""))
        i = 0
        while i + 1 < len(at):
            j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, side="right")) - 1)
            if at[j] - at[i] <= BLOCK:
                yield from self._block(data[at[i] : at[j]], at[i : j + 1] - at[i])
            else:
                yield b"".join(self._block(part, np.array([0, len(part)]))[0] for part in self._cut(data[at[i] : at[j]]))
            i = j

    def _cut(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """A long text in parts that end with a blank, of BLOCK bytes unless a word is longer."""
        at = 0
        while at < len(data):
            end, step = len(data), BLOCK
            while at + step < len(data):
                if len(blanks := np.flatnonzero(BLANK[data[at : at + step]])):
                    end = at + int(blanks[-1]) + 1
                    break
                step *= 2
            yield data[at:end]
            at = end

    def __call__(self, texts: list[str]) -> list[bytes]:
        return list(self.each(pa.array(texts, pa.large_string())))


_WORDS: dict[str, WordIds] = {}
keeps(__name__, _WORDS.clear)


def words_of(path: str) -> WordIds:
    """One memo for each worker and vocabulary."""
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def least_slack(counts: np.ndarray | list[int], capacity: int, first: int) -> list[int]:
    """Lengths (``first`` included) from the multiset ``counts`` (index: length) whose sum
    is at most ``capacity`` and as near to it as any such choice comes.

    Bit s of a stage's integer is set when the lengths so far can sum to s. Lengths are
    taken from the longest, each with its count split into 1, 2, 4, ... copies, and the
    search ends with the first stage that reaches the capacity itself."""
    room = capacity - first
    if room == 0:
        return [first]
    mask, reach, stages = (1 << (room + 1)) - 1, 1, []
    for length in range(room, 0, -1):
        left = min(int(counts[length]) - (length == first), room // length)
        part = 1
        while left > 0:
            take = min(part, left)
            stages.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left -= take
            part *= 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    sum_, chosen = reach.bit_length() - 1, [first]
    for before, length, take in reversed(stages):
        if not before >> sum_ & 1:
            chosen += [length] * take
            sum_ -= length * take
    return chosen


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of ``lengths`` (each 1..capacity) in windows, by minimum bin slack."""
    counts, at = [0] * (capacity + 1), [[] for _ in range(capacity + 1)]
    for i, n in enumerate(lengths):
        counts[n] += 1
        at[n].append(i)
    windows = []
    for longest in range(capacity, 0, -1):
        while counts[longest]:
            window = []
            for n in least_slack(counts, capacity, longest):
                counts[n] -= 1
                window.append(at[n].pop())
            windows.append(window)
    return windows


def powers(n: int) -> list[int]:
    """n as descending powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


#: doc: index of the document in its block; start, length: the piece; sequence, offset: its place.
Piece = tuple[int, int, int, int, int]


def pack_block(sizes: list[int], capacity: int, last: bool, most: int | None = None) -> tuple[list[Piece], list[Piece], int]:
    """Pack whole documents of ``sizes`` tokens: (pieces placed, pieces left over, number
    of sequences). The left over pieces are those of windows that minimum bin slack could
    not fill. Where they hold more than ``most`` tokens (none: any number is fine) they are
    cut so as to fill windows, and less than one window is left over; with ``last`` that is
    cut into sequences of power-of-two lengths too."""
    pieces: list[Piece] = []
    rests, sequence = [], 0
    for d, n in enumerate(sizes):
        full = n // capacity
        for k in range(full):
            pieces.append((d, k * capacity, capacity, sequence, 0))
            sequence += 1
        if n > full * capacity:
            rests.append((d, full * capacity, n - full * capacity))
    over: list[tuple[int, int, int]] = []
    for window in pack_lengths([r[2] for r in rests], capacity):
        if sum(rests[i][2] for i in window) == capacity:
            offset = 0
            for i in window:
                pieces.append((*rests[i], sequence, offset))
                offset += rests[i][2]
            sequence += 1
        else:
            over += [rests[i] for i in window]
    total = sum(n for _, _, n in over)
    if not last and (most is None or total <= most):
        return pieces, [(d, s, n, -1, -1) for d, s, n in over], sequence
    rooms = iter([capacity] * (total // capacity) + (powers(total % capacity) if last else []))
    room, used, rest = next(rooms, 0), 0, []
    for d, s, n in over:
        while n and room:
            k = min(n, room - used)
            pieces.append((d, s, k, sequence, used))
            s, n, used = s + k, n - k, used + k
            if used == room:
                room, used, sequence = next(rooms, 0), 0, sequence + 1
        if n:
            rest.append((d, s, n, -1, -1))
    return pieces, rest, sequence


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
    ]
)


def _packed(path: str, closing: int, capacity: int, block_tokens: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = words_of(path)
        end = np.asarray([closing], dtype="<u2").tobytes()
        base = TaskContext.get().partitionId() << 36
        # What is not placed yet: (doc_id, ids, document's tokens, start of these ids in it).
        held: list[tuple[int | None, bytes, int, int]] = []
        tokens, done = 0, 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal held, tokens, done
            placed, over, n = pack_block([len(h[1]) // 2 for h in held], capacity, last, max(capacity, block_tokens // 2))
            rows: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            ids_out = []
            for d, s, k, q, o in placed:
                doc, ids, total, begin = held[d]
                ids32 = np.frombuffer(ids, dtype="<u2", count=k, offset=2 * s).astype("<u4")
                for name, v in zip(rows, (doc, begin + s, k, crc32(ids32), total, base + done + q, o)):
                    rows[name].append(v)
                ids_out.append(ids32.astype(np.int32) if with_ids else None)
            held = [(held[d][0], held[d][1][2 * s : 2 * (s + k)], held[d][2], held[d][3] + s) for d, s, k, _, _ in over]
            tokens, done = sum(len(h[1]) // 2 for h in held), done + n
            return pa.RecordBatch.from_arrays(
                [pa.array(v, pa.int64()) for v in rows.values()] + [pa.array(ids_out, pa.list_(pa.int32()))], [*rows, "ids"]
            )

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encode.each(batch.column(1))):
                held.append((doc, ids + end, len(ids) // 2 + 1, 0))
                tokens += len(ids) // 2 + 1
                if tokens > block_tokens:
                    yield flush(False)
        yield flush(True)

    return run


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = 2048, closing_id: int = 1, block_tokens: int = 1_000_000, with_ids: bool = True
) -> DataFrame:
    """Pack ``docs`` (doc_id, text; other columns are ignored) into sequences of at most
    ``capacity`` tokens: one row for each piece with doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset and, ``with_ids``, the piece's ids (else null).

    Null text: empty, so the closing id alone. Null doc_id: packed like any other, null in
    the result. Repeated rows: each is packed for itself. Documents longer than a window:
    cut at multiples of the window. Empty table: no rows. Extra columns: ignored, whatever
    their names. A sequence is shorter than ``capacity`` only at the end of a partition,
    and then has a power of two tokens. ``sequence_id`` holds the input partition above
    bit 36, so a task that runs again gives the same numbers."""
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("capacity must be a power of two")
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return docs.select(*columns).mapInArrow(released(_packed(vocabulary, closing_id, capacity, block_tokens, with_ids)), PIECES)

"""Byte-pair merging compiled to a deterministic finite-state transducer.

The last token of a prefix's encoding is the one token that ends there and may follow the
last token before it, so merging is a finite-state function. A state is the set of places
from which a token may still run: (vocabulary-trie node, last token there, tokens counted
since). A transition on a symbol is annotated with the change of the number of tokens, so
the tokens of a text are counted by adding up what its transitions emit. The last token of
a state's prefix stands with the state, so encodings are read back from the end. States are
determinised as texts need them and kept while there is room; as a state is what it means,
a table that is full starts anew with the states that are in use.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np

#: Symbols are bytes; where a vocabulary marks word ends, a word's last byte is 256 more.
END = 256
#: Odd multiplier that spreads keys over a hash table.
_SPREAD = 0x9E3779B97F4A7C15


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: letter to byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Memo(dict):
    """A bounded memo for blocks of keys: ``fill`` computes the new keys of a block at once
    and keeps them while there is room; the rest lives until the next block."""

    def __init__(self, compute: Callable[[list], list], most: int):
        super().__init__()
        self.compute, self.most, self.block = compute, most, {}

    def fill(self, keys: set) -> None:
        new = [k for k in keys if k not in self]
        found = dict(zip(new, self.compute(new))) if new else {}
        if len(self) + len(found) <= self.most:
            self.update(found)
            self.block = {}
        else:
            self.block = found

    def __missing__(self, key):
        return self.block[key]


class MergeTransducer:
    """Encodings of symbol sequences, as merging by rank defines them.

    The vocabulary must number its tokens in the order of their merges, single symbols
    first, as byte-level vocabularies do."""

    MOST_STATES = 160_000

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str = ""):
        letters = byte_letters()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.pair = {(vocabulary[a], vocabulary[b]): vocabulary[a.removesuffix(suffix) + b] for a, b in pairs}
        self.parts = {t: ab for ab, t in self.pair.items()}
        if any(t <= max(ab) for t, ab in self.parts.items()):
            raise ValueError("tokens must be numbered in the order of their merges")
        self.known: dict[int, bool] = {}
        self.child: dict[int, int] = {}
        self.open, self.token = [False], [-1]
        self.length = np.ones(max(vocabulary.values()) + 1, dtype=np.int32)
        sound: set[int] = set()
        for s, t in sorted(vocabulary.items(), key=lambda x: x[1]):
            stem = s.removesuffix(suffix) if suffix else s
            if not stem or any(c not in letters for c in stem):
                continue
            if t in self.parts:
                a, b = self.parts[t]
                if not (a in sound and b in sound and self._apart(a, b, t)):
                    continue
            sound.add(t)
            symbols = [letters[c] for c in stem]
            if len(stem) < len(s):
                symbols[-1] += END
            node = 0
            for x in symbols:
                self.open[node] = True
                if (to := self.child.get(node << 9 | x)) is None:
                    to = self.child[node << 9 | x] = len(self.token)
                    self.open.append(False)
                    self.token.append(-1)
                node = to
            self.token[node], self.length[t] = t, len(symbols)
        self.reset()

    def reset(self) -> None:
        #: A place is one number: trie node, last token + 1, tokens counted since + 512.
        start = array("q", [512]).tobytes()
        self.number, self.meaning = {start: 0}, [start]
        #: Last token of a state's prefix.
        self.last = np.full(self.MOST_STATES + 1, -1, dtype=np.int32)
        #: Transitions taken one at a time: state and symbol to (next state, tokens emitted).
        self.steps: dict[int, tuple[int, int]] = {}
        self._resize(16)

    def state_of(self, meaning: bytes) -> int:
        if (state := self.number.get(meaning)) is None:
            state = self.number[meaning] = len(self.meaning)
            self.meaning.append(meaning)
        return state

    def _resize(self, bits: int) -> None:
        """Transitions as a hash table of 2^bits places, probed in order: state and symbol to
        the next state and the tokens emitted. It follows the number of transitions, not of
        states times symbols."""
        there = self.keys >= 0 if hasattr(self, "keys") and len(self.meaning) > 1 else None
        old = (self.keys[there], self.next[there], self.emit[there]) if there is not None else None
        self.bits, self.used = bits, 0
        self.keys, self.next, self.emit = (np.full(1 << bits, -1, dtype=t) for t in (np.int64, np.int32, np.int16))
        if old is not None:
            for row in zip(*(v.tolist() for v in old)):
                self._put(*row)

    def _put(self, key: int, to: int, emitted: int) -> None:
        place = (key * _SPREAD & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while self.keys[place] >= 0:
            place = place + 1 & (1 << self.bits) - 1
        self.keys[place], self.next[place], self.emit[place] = key, to, emitted
        self.used += 1
        if self.used * 5 > 2 << self.bits:
            self._resize(self.bits + 1)

    def _get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, -1 where there is no transition yet, and the tokens emitted."""
        place = (keys.astype(np.uint64) * np.uint64(_SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[place]
        out, emitted = self.next[place], self.emit[place]
        seek = np.flatnonzero((there != keys) & (there >= 0))
        while len(seek):
            place[seek] = place[seek] + 1 & (1 << self.bits) - 1
            there = self.keys[place[seek]]
            out[seek], emitted[seek] = self.next[place[seek]], self.emit[place[seek]]
            seek = seek[(there != keys[seek]) & (there >= 0)]
        return out, emitted

    def _apart(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge across the border of a|b comes before ``limit``. Merges are
        undone from the last: what met at the border in each span of time is a pair, which
        must not merge before one of its two was taken up; of equal ranks the left is first."""
        pair, parts = self.pair, self.parts
        while True:
            if pair.get((a, b), limit) < limit:
                return False
            if a > b:
                if a not in parts:
                    return True
                limit, a = a, parts[a][1]
            else:
                if b not in parts:
                    return True
                limit, b = b + 1, parts[b][0]

    def fits(self, last: int, token: int) -> bool:
        """Whether ``token`` may follow ``last`` (-1: the start) in an encoding."""
        if last < 0:
            return True
        key = last << 20 | token
        if (found := self.known.get(key)) is None:
            if len(self.known) > 150_000:
                self.known.clear()
            found = self.known[key] = self._apart(last, token, 1 << 60)
        return found

    def compile(self, state: int, symbol: int) -> tuple[int, int]:
        """The state after ``state`` on ``symbol`` and the tokens emitted on the way."""
        here, ends, change, child = [], -1, 0, self.child
        for place in array("q", self.meaning[state]):
            if (to := child.get(place >> 30 << 9 | symbol)) is None:
                continue
            if ends < 0 and (token := self.token[to]) >= 0 and self.fits((place >> 10 & 0xFFFFF) - 1, token):
                ends, change = token, (place & 1023) - 511
            if self.open[to]:
                here.append(to << 30 | place & 0x3FFFFFFF)
        here = [p - change for p in here]
        here.append((ends + 1) << 10 | 512)
        meaning = array("q", here).tobytes()
        if (to := self.number.get(meaning)) is None:
            to = self.number[meaning] = len(self.meaning)
            self.meaning.append(meaning)
            self.last[to] = ends
        self._put(state << 9 | symbol, to, change)
        return to, change

    def advance(self, meaning: bytes, symbols: bytes) -> tuple[bytes, int]:
        """The state (as what it means) after ``symbols`` from one, and the tokens emitted."""
        state, count, steps = self.state_of(meaning), 0, self.steps
        for x in symbols:
            if (step := steps.get(state << 9 | x)) is None:
                if len(self.meaning) >= self.MOST_STATES:
                    kept = self.meaning[state]
                    self.reset()
                    state, steps = self.state_of(kept), self.steps
                step = steps[state << 9 | x] = self.compile(state, x)
            state = step[0]
            count += step[1]
        return self.meaning[state], count

    def count_many(self, words: list[bytes]) -> np.ndarray:
        """Number of tokens of each word: all words take a step together and add up what
        it emits. Words are taken by length, so memory follows the text."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        counts = np.zeros(len(words), dtype=np.int64)
        order = np.argsort(sizes, kind="stable")
        ranked = sizes[order]
        at = int(np.searchsorted(ranked, 1))
        while at < len(order):
            till = min(at + 50_000, int(np.searchsorted(ranked, max(16, 2 * ranked[at]), side="right")))
            chosen = order[at:till]
            longest = int(sizes[chosen[-1]])
            if longest > 4096:  # few and long: one at a time
                for i in chosen:
                    counts[i] = self.advance(self.meaning[0], words[i])[1]
            else:
                block = np.frombuffer(b"".join([words[i].ljust(longest, b"\0") for i in chosen]), dtype=np.uint8).reshape(-1, longest)
                counts[chosen] = self._count_block(block, sizes[chosen])
            at = till
        return counts

    def _count_block(self, block: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        rows = len(block)
        live, state, count = np.arange(rows), np.zeros(rows, dtype=np.int32), np.zeros(rows, dtype=np.int64)
        for k in range(block.shape[1]):
            if sizes[live[0]] <= k:  # rows are sorted by size: the front ones are done
                gone = int(np.searchsorted(sizes, k, side="right"))
                if gone == rows:
                    break
                live, state = np.arange(gone, rows), state[gone - rows :]
            symbols = block[live, k]
            to, emitted = self._get(state.astype(np.int64) << 9 | symbols)
            if (new := np.flatnonzero(to < 0)).size:
                pairs, back = np.unique(state[new].astype(np.int64) << 9 | symbols[new], return_inverse=True)
                if len(self.meaning) + len(pairs) > self.MOST_STATES:  # start anew with the states in use
                    used, back = np.unique(state, return_inverse=True)
                    kept = [self.meaning[s] for s in used.tolist()]
                    self.reset()
                    state = np.array([self.state_of(m) for m in kept], dtype=np.int32)[back]
                    to = np.full(len(state), -1, dtype=np.int32)
                    new = np.arange(len(state))
                    pairs, back = np.unique(state.astype(np.int64) << 9 | symbols, return_inverse=True)
                made = np.array([self.compile(int(p >> 9), int(p & 511)) for p in pairs])
                to[new], emitted[new] = made[back, 0], made[back, 1]
            state = to
            count[live] += emitted
        return count

    def encode_many(self, data: np.ndarray, sizes: np.ndarray, mark_end: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Encodings of the words of ``sizes`` bytes that stand one after another in ``data``,
        side by side: (tokens, number of tokens of each word).
        All words take a step of the transducer together; encodings are then read back
        from the ends together, so a word may have fewer symbols than states are kept.
        Words are taken by length, so memory follows the text."""
        begin = np.cumsum(sizes) - sizes
        counts = np.zeros(len(sizes), dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        order = np.argsort(sizes, kind="stable")
        ranked = sizes[order]
        at = int(np.searchsorted(ranked, 1))
        while at < len(order):
            till = min(at + 50_000, int(np.searchsorted(ranked, max(16, 2 * ranked[at]), side="right")))
            chosen = order[at:till]
            longest = int(sizes[chosen[-1]])
            n = sizes[chosen]
            block = np.zeros((len(chosen), longest), dtype=np.int16)
            own = np.repeat(begin[chosen] - np.cumsum(n) + n, n) + np.arange(n.sum())
            block[np.arange(longest) < n[:, None]] = data[own]
            if mark_end:
                block[np.arange(len(n)), n - 1] += END
            tokens, count = self._encode_block(block, n)
            counts[chosen] = count
            parts.append((chosen, tokens, count))
            at = till
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), dtype=np.int32)
        for chosen, tokens, count in parts:  # tokens stand right-aligned in their rows
            wide = tokens.shape[1]
            keep = np.arange(wide) >= wide - count[:, None]
            place = starts[chosen][:, None] + np.arange(wide) - (wide - count[:, None])
            out[place[keep]] = tokens[keep]
        return out, counts

    def _encode_block(self, block: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, longest = block.shape
        if len(self.meaning) + 4096 > self.MOST_STATES:
            self.reset()
        live, state = np.arange(rows), np.zeros(rows, dtype=np.int32)
        ends = np.zeros((rows, longest), dtype=np.int32)
        for k in range(longest):
            if sizes[live[0]] <= k:  # rows are sorted by size: the front ones are done
                gone = int(np.searchsorted(sizes, k, side="right"))
                if gone == rows:
                    break
                live, state = np.arange(gone, rows), state[gone - rows :]
            symbols = block[live, k]
            to, _ = self._get(state.astype(np.int64) << 9 | symbols)
            if (new := to < 0).any():
                pairs, back = np.unique(state[new].astype(np.int64) << 9 | symbols[new], return_inverse=True)
                if len(self.meaning) + len(pairs) > self.MOST_STATES:  # too many at once: smaller blocks
                    if rows == 1:
                        raise MemoryError("one word needs more states than are kept")
                    self.reset()
                    half = rows // 2
                    a, b = (self._encode_block(block[x], sizes[x]) for x in (slice(0, half), slice(half, rows)))
                    wide = max(a[0].shape[1], b[0].shape[1])
                    pad = lambda t: np.concatenate([np.zeros((len(t), wide - t.shape[1]), dtype=np.int32), t], axis=1)
                    return np.concatenate([pad(a[0]), pad(b[0])]), np.concatenate([a[1], b[1]])
                made = np.fromiter((self.compile(int(p >> 9), int(p & 511))[0] for p in pairs), dtype=np.int32, count=len(pairs))
                to[new] = made[back]
            state = to
            ends[live, k] = self.last[state]
        length, taken = self.length, []
        live, at, count = np.arange(rows), sizes.copy(), np.zeros(rows, dtype=np.int64)
        while len(live):
            token = ends[live, at - 1]
            taken.append((live, token))
            count[live] += 1
            at = at - length[token]
            live, at = live[at > 0], at[at > 0]
        tokens = np.zeros((rows, len(taken)), dtype=np.int32)
        for k, (who, token) in enumerate(taken):
            tokens[who, len(taken) - 1 - k] = token
        return tokens, count

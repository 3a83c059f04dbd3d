import random
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

from axonframe.llm import packing, token_count
from axonframe.llm.queries import vocabulary

ALPHABET = "ab  \n\t'strevlmdQ12²é日本!.,|-  \x1c　ⅧΣİ́<"


def noise(n, longest, special, seed):
    rng = random.Random(seed)
    for _ in range(n):
        s = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest)))
        yield s[:5] + special + s[5:] if rng.random() < 0.1 else s


def plain(path, text):
    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("chunk", [1, 3, 7, 1 << 16])
def test_counts_are_the_librarys(monkeypatch, chunk):
    monkeypatch.setattr(token_count, "CHUNK", chunk)
    path = vocabulary("byte_bpe_50k.json")
    library, count = Tokenizer.from_file(path), token_count.counter_of(path)
    texts = list(noise(3000, 40, "<|endoftext|>", chunk)) + ["", " ", "x" * 500, "word " * 300, "\n" * 50 + "a"]
    assert count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_word_ids_are_the_librarys():
    path = vocabulary("word_bpe_49k.json")
    library, words = Tokenizer.from_file(path), packing.words_of(path)
    texts = list(noise(3000, 40, "<|endoftext|>", 1)) + ["", "Grüße, naïve œuvre!", "it's we'll I'M"]
    assert [np.frombuffer(b, "<u2").tolist() for b in words(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_state_table_starts_anew_when_full(monkeypatch):
    from axonframe.llm.merges import MergeTransducer

    monkeypatch.setattr(MergeTransducer, "MOST_STATES", 6000)
    path = vocabulary("byte_bpe_50k.json")
    library, count = Tokenizer.from_file(path), token_count.Counter(path)
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("aeiourstln") for _ in range(rng.randint(1, 12))) for _ in range(200)) for _ in range(20)]
    assert count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_least_slack_is_the_best_fit():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.randint(5, 40)
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = [lengths.count(n) for n in range(capacity + 1)]
        chosen = packing.least_slack(counts, capacity, lengths[0])
        rest = lengths[1:]
        best = max(lengths[0] + sum(c) for k in range(len(rest) + 1) for c in combinations(rest, k) if lengths[0] + sum(c) <= capacity)
        assert sum(chosen) == best and chosen[0] == lengths[0]
        assert all(chosen.count(n) <= counts[n] for n in chosen)


def check_pieces(rows, docs, capacity):
    """Every id in exactly one piece; sequences gapless; full or a power of two."""
    path = vocabulary("word_bpe_49k.json")
    want = sorted((d if d is not None else -1, plain(path, t or "") + [1]) for d, t in docs)
    by_sequence, got = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
        got.setdefault((r.doc_id if r.doc_id is not None else -1, r.doc_tokens), []).append((r.start, r.ids))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == capacity or at & (at - 1) == 0 and at < capacity
    whole = sorted((d, n, sum((ids for _, ids in sorted(p, key=lambda x: x[0])), [])) for (d, n), p in got.items())
    return whole, want


def test_pack_round_trip(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["the", "cat's", "Straße", "x1", "日本"]) for _ in range(rng.randint(0, 300)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "long " * 5000), (None, "no id")]
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in docs], "doc_id long, text string, sequence_id int, start string").repartition(3)
    rows = packing.pack(df, vocabulary("word_bpe_49k.json"), capacity=64, block_tokens=900).collect()
    whole, want = check_pieces(rows, docs, 64)
    assert [(d, ids) for d, _, ids in whole] == sorted(want)
    assert all(n == len(ids) for _, n, ids in whole)


def test_pack_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c")] * 5, "doc_id long, text string").coalesce(1)
    rows = packing.pack(df, vocabulary("word_bpe_49k.json"), capacity=8).collect()
    assert sum(r.length for r in rows) == 20 and {r.doc_tokens for r in rows} == {4}
    assert packing.pack(df.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_count_tokens_edges(spark):
    df = spark.createDataFrame([(1, None, 2), (None, "é", 3), (2, "a " * 3000, 4), (2, "a " * 3000, 4)], "doc_id long, text string, n_tokens int")
    path = vocabulary("byte_bpe_50k.json")
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(df, path).collect()}
    long = len(plain(path, "a " * 3000))
    assert got == {(1, 0, 0, False), (None, 2, len(plain(path, "é")), False), (2, 6000, long, True)}
    assert token_count.count_tokens(df, path).count() == 4 and token_count.count_tokens(df.limit(0), path).count() == 0


@pytest.mark.parametrize("sizes", [[1500] * 10_000, [1100] * 9_000, [700, 1500, 900] * 3_000])
def test_rests_that_fit_no_window_do_not_pile_up(sizes):
    capacity, block = 2048, 100_000
    held, longest, placed, sequences = [], 0, 0, 0
    for at in range(0, len(sizes), 100):
        held += sizes[at : at + 100]
        longest = max(longest, sum(held))
        if sum(held) > block:
            pieces, over, n = packing.pack_block(held, capacity, False, block // 2)
            rows = {}
            for _, _, length, q, o in pieces:
                rows.setdefault(q, []).append((o, length))
            assert all(sum(length for _, length in r) == capacity for r in rows.values()) and len(rows) == n
            placed, sequences, held = placed + sum(p[2] for p in pieces), sequences + n, [p[2] for p in over]
            assert sum(held) <= block // 2
    assert longest <= block + 100 * max(sizes) + block // 2 and placed + sum(held) == sum(sizes) and placed == sequences * capacity


def test_very_long_words_and_runs(monkeypatch):
    from axonframe.llm.merges import MergeTransducer

    path = vocabulary("byte_bpe_50k.json")
    library, count = Tokenizer.from_file(path), token_count.counter_of(path)
    rng = random.Random(9)
    texts = ["".join(rng.choice("etaoinshr") for _ in range(1_000_000)), "z" * 600_000, "ab" * 200_000 + " end", " " * 70_000 + "x", "\n" * 65_536 + "'re" * 50_000, "é" * 100_000]
    assert count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    monkeypatch.setattr(MergeTransducer, "MOST_STATES", 5000)
    small = token_count.Counter(path)
    texts = ["".join(rng.choice("etaoinshr") for _ in range(n)) for n in (40_000, 3000, 3000, 2900, 17)]
    assert small(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_chunk_maps_compose_in_any_order():
    path = vocabulary("byte_bpe_50k.json")
    library, count = Tokenizer.from_file(path), token_count.counter_of(path)
    rng = random.Random(4)
    for text in noise(300, 60, "'ll", 8):
        cuts = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(1, 6)))
        chunks = [count.chunk_parts(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)])]
        count.segments.fill({p for parts in chunks for p in parts[1:-1]})
        maps = list(map(count.chunk_map, chunks))
        while len(maps) > 1:
            k = rng.randrange(len(maps) - 1)
            maps[k : k + 2] = [count.compose(maps[k], maps[k + 1])]
        assert count.total(maps[0]) == len(library.encode(text, add_special_tokens=False).ids)


def test_words_too_long_to_compile_have_the_librarys_ids(monkeypatch):
    monkeypatch.setattr(packing, "LINES", __import__("re").compile(f"(?m)^(?:{packing.LETTERS_AND_SIGNS % 50}|(.+))$"))
    path = vocabulary("word_bpe_49k.json")
    text = "short " + "abcde" * 30 + "! " + "é" * 70
    assert np.frombuffer(packing.WordIds(path)([text])[0], "<u2").tolist() == plain(path, text)


@pytest.mark.parametrize("block", [1, 7, 40, 4 << 20])
def test_blocks_of_bytes_have_the_librarys_ids(monkeypatch, block):
    """Odd blanks, all letters of Latin-1, signs beside them; texts longer than a block."""
    monkeypatch.setattr(packing, "BLOCK", block, raising=False)
    path = vocabulary("word_bpe_49k.json")
    library, words = Tokenizer.from_file(path), packing.words_of(path)
    rng = random.Random(block)
    odd = [*" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0  　́×÷µª", *map(chr, range(0xC0, 0x100)), *"aZ.,'%1_`~Ã日ſK", "<|endoftext|>", "<|ENDOFTEXT|>"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["", "  ", "a", "é", "", "Ãé! " * 40]
    assert [np.frombuffer(b, "<u2").tolist() for b in words(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_of_letters_are_not_kept():
    """Distinct words of letters are encoded anew in each block, together: a worker keeps
    states of the merges and the library's few strings, whatever the number of words."""
    words = packing.WordIds(vocabulary("word_bpe_49k.json"))
    rng = random.Random(11)
    words([" ".join("".join(rng.choice("aeiourstlnÉ") for _ in range(rng.randint(1, 12))) + "," for _ in range(500)) for _ in range(10)])
    assert len(words.memo) < 10


def test_bound_on_letters_holds(monkeypatch):
    path = vocabulary("word_bpe_49k.json")
    words, seen = packing.WordIds(path), []
    compiled = words.machine.encode_many
    monkeypatch.setattr(words.machine, "encode_many", lambda data, sizes, **k: seen.extend(sizes.tolist()) or compiled(data, sizes, **k))
    text = "a" * packing.LONGEST + " " + "é" * packing.LONGEST + ", " + "b" * (packing.LONGEST + 1) + " c"
    assert np.frombuffer(words([text])[0], "<u2").tolist() == plain(path, text)
    assert sorted(seen) == [1, packing.LONGEST, 2 * packing.LONGEST]


def test_memory_is_given_back_between_batches(monkeypatch):
    from axonframe.llm import common

    seen = []
    monkeypatch.setattr(common, "give_back", lambda: seen.append("given back"), raising=False)

    def run(batches):
        for b in batches:
            seen.append(b)
            yield b

    assert list(common.released(run)(iter([1, 2]))) == [1, 2]
    assert seen == [1, "given back", 2, "given back", "given back"]

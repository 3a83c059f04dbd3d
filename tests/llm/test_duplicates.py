import random

import numpy as np
import pytest
import xxhash

from axonframe.llm import ann, components, embedding_dedup, simhash, substring


def naive_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, linked):
    """Smallest reachable id for ids 0..n-1, by brute force."""
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i in range(len(values)):
            for j in range(len(values)):
                if label[j] < label[i] and linked(values[i], values[j]):
                    label[i], changed = label[j], True
    return label


def test_fingerprint_is_the_definition():
    for text in ["", None, "One two", "one TWO three", "a b c d", "a b c d e f g " * 9, "ÀB c d e\x0bf\x1fg h"]:
        assert simhash.fingerprint(text) == naive_print(text)


def test_golay_spheres_are_perfect():
    words = np.random.default_rng(0).integers(0, 1 << 23, 3000)
    single, patterns = simhash.golay()
    assert len({tuple(p) for p in patterns.tolist()}) == 2048
    nearest = patterns[:, 0]
    assert np.bincount(np.bitwise_count(nearest)).tolist() == [1, 23, 253, 1771]
    near = simhash.codewords(words)
    assert near.shape == (3000, 6)


def test_keys_meet_within_four_bits():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 4000).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 4000).astype(np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, len(a)).astype(np.uint64)
    (wa, ka), (wb, kb) = simhash.keys(a), simhash.keys(b)
    met = {i for i, k in zip(wa.tolist(), ka.tolist())} and {i for i, _ in set(zip(wa.tolist(), ka.tolist())) & set(zip(wb.tolist(), kb.tolist()))}
    assert len(met) == len(a)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = ["w%d" % i for i in range(400)]
    out = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 12, 150, 400]))]
        for _ in range(rng.randint(1, 4)):
            near = list(base)
            for _ in range(rng.randint(0, 2)):
                near[rng.randrange(len(near))] = rng.choice(words)
            out.append(" ".join(near))
    return out + ["", None, "  \n", "Solo", "solo"]


def test_near_duplicates_against_brute_force(spark, texts):
    prints = [naive_print(t) for t in texts]
    want = classes(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    df = spark.createDataFrame([(i, t, 0, "c") for i, t in enumerate(texts)], "doc_id long, text string, fp int, bucket string").repartition(3)
    rows = simhash.near_duplicates(df).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id, r.kept) for r in rows} == {(i, f"{p:016x}", w, i == w) for i, (p, w) in enumerate(zip(prints, want))}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (9, "q r s t u v"), (None, "z"), (9, "other words here now")], "doc_id long, text string")
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == 6 and [r.component_id for r in rows if r.doc_id is None and r.fingerprint == f"{naive_print('a b c d e'):016x}"] == [7]
    kept = sorted((str(r.doc_id), r.text) for r in simhash.keep_one(df).collect())
    assert kept == [("7", "a b c d e"), ("9", "other words here now"), ("9", "q r s t u v"), ("None", "z")]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 == simhash.keep_one(df.limit(0)).count()


def test_large_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 5)
    base = 0x0123456789ABCDEF
    prints = [base] + [base ^ (1 << a) ^ (1 << b) for a in range(0, 40, 3) for b in range(41, 60, 4)]
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "doc_id long, fp long")
    assert {r.component_id for r in simhash.classes(df).collect()} == {0}


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(300, 300)] + [tuple(rng.sample(range(200, 260), 2)) for _ in range(40)]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for v in near:
        seen, todo = {v}, [v]
        while todo:
            for u in near[todo.pop()] - seen:
                seen.add(u)
                todo.append(u)
        if len(seen) > 1:
            want[v] = min(seen)
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(seed, n, dims=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    for i in range(0, n // 2, 2):
        x[i + 1] = x[i] + rng.normal(size=dims) * rng.choice([0.05, 0.3])
    x[n - 1] = x[n - 2]
    return x.astype(np.float32)


BAD = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [float("inf")] + [1.0] * 15), (904, []), (905, [1.0, 2.0])]


def test_near_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 16)
    x = vectors(4, 240)
    x[150:190] = x[149] * 3 + np.random.default_rng(1).normal(size=(40, 16)).astype(np.float32) * 0.02
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + BAD
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, node int").repartition(4)
    u = x.astype(float)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    want = classes(list(range(len(x))), lambda i, j: s[i, j])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df).collect()}
    assert {i: got[i] for i in range(len(x))} == {i: (int(s[i].sum()), want[i], want[i] == i) for i in range(len(x))}
    assert all(got[i] == (0, i, True) for i, _ in BAD) and len(got) == len(rows)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_hadamard():
    h = np.array([[1.0]])
    for _ in range(3):
        h = np.block([[h, h], [h, -h]])
    x = np.random.default_rng(0).normal(size=(5, 8))
    assert np.allclose(embedding_dedup.hadamard(x), x @ h)


def test_hilbert_is_a_curve():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = ann.hilbert(grid, bits)
        order = grid[np.argsort(key)]
        assert sorted(key) == list(range(len(grid))) and (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_nearest_recall_and_exact_scores(spark):
    x = np.random.default_rng(8).normal(size=(3000, 32)).astype(np.float32)
    x[5:30] = x[4]
    rows = [(i * 5, v.tolist()) for i, v in enumerate(x)] + [(100_000 + i, v) for i, v in BAD]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, asks int").repartition(4)
    got = ann.nearest(df, least_window=64, share=0.05).collect()
    ids, y = np.arange(len(x)) * 5, x.astype(float)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((y - y[i]) ** 2).sum(1))
        best = [j for j in np.lexsort((ids, d)) if j != i][:10]
        mine = sorted(found[ids[i]])
        assert [r for r, _, _ in mine] == list(range(1, 11)) and all(s == d[v // 5] for _, v, s in mine)
        assert [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & {int(ids[j]) for j in best})
    assert len(found) == 150 and hits >= 0.9 * 1500


def test_nearest_edges(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [0.0, 1.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df).collect()]
    assert sorted(got) == [(0, 1, 7, 0.0), (0, 2, 8, 2**0.5)]
    assert ann.nearest(df.limit(0)).count() == 0 and ann.nearest(df.filter("vec_id = 8")).count() == 0


WORD = __import__("re").compile(r"\S+")


def naive_passages(docs, least):
    """(document, index) of every word in a run of ``least`` words that stands earlier too."""
    seen, out = set(), set()
    for d, text in sorted(docs, key=lambda x: (x[0] is None, x[0])):
        w = [substring.normal(x) for x in WORD.findall(text or "")]
        for i in range(len(w) - least + 1):
            key = tuple(w[i : i + least])
            if key in seen:
                out |= {(d, k) for k in range(i, i + least)}
            seen.add(key)
    return out


def left_over(text, gone):
    """``text`` without the words numbered in ``gone`` and the blanks after them."""
    places = [m.start() for m in WORD.finditer(text)] + [len(text)]
    keep = [text[: places[0]]] + [text[a:b] for k, (a, b) in enumerate(zip(places, places[1:])) if k not in gone]
    return "".join(keep)


def passages(seed):
    """Documents with passages planted within lines, at their borders and across them."""
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(30_000)] + ["Größe", "ﬁve", "e\u0301t"]

    def prose(n):
        out = []
        for k in range(n):
            word = rng.choice(words)
            out.append(word.capitalize() + rng.choice([".", "!", ".\n"]) if rng.random() < 0.12 else word)
        return " ".join(out)

    shared = [prose(n) for n in (51, 52, 55, 60, 75, 120, 200, 300)]
    common = ["All of these lines stand in many of the documents.", prose(30)]
    docs = []
    for i in range(120):
        parts = [prose(rng.randint(0, 120))]
        if rng.random() < 0.5:
            parts += [rng.choice(shared).upper() if rng.random() < 0.2 else rng.choice(shared), prose(rng.randint(0, 60))]
        if rng.random() < 0.6:
            parts.append("\n" + rng.choice(common) + "\n")
        docs.append((i, " ".join(parts)))
    return docs + [(200, docs[3][1]), (201, None), (202, ""), (203, "short text"), (None, docs[5][1])]


def test_repeated_passages_against_brute_force(spark):
    for seed in (4, 5):
        docs = passages(seed)
        df = spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id long, text string, start string, place int").repartition(3)
        want, got = naive_passages(docs, 50), set()
        texts = dict(docs)
        rows = substring.repeated_passages(df).collect()
        for r in rows:
            text, kept = texts[r.doc_id] or "", texts[r.kept_doc_id]
            inside = [k for k, m in enumerate(WORD.finditer(text)) if r.start <= m.start() and m.end() <= r.end]
            assert len(inside) >= r.n_words >= 50 and not {(r.doc_id, k) for k in inside} & got
            got |= {(r.doc_id, k) for k in inside}
            plain = lambda t: " ".join(substring.normal(x) for x in t.split())
            assert " ".join(plain(kept).split()[r.kept_word :][:50]) in plain(text[r.start : r.end])
        assert want and got == want
        left = {r.doc_id: r.text for r in substring.without_repeats(df).collect()}
        for i, text in docs:
            gone = {k for d, k in want if d == i}
            cut = left_over(text, gone) if gone else text
            assert (left[i] == cut) if not gone or cut.strip() else i not in left


def test_common_lines_stay(spark):
    line = "This line of thirteen words in all stands in each of the documents."
    docs = [(i, " ".join(f"d{i}w{k}" for k in range(80)) + "\n" + line + "\n" + " ".join(f"e{i}w{k}" for k in range(80))) for i in range(30)]
    assert substring.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).count() == 0


def test_what_only_repeats_itself_is_one_unit(spark):
    body = " ".join(f"b{k}" for k in range(30))
    docs = [(i, f"Here starts text {i} {body} " + "buy it now " * 60 + f"{body} and here it ends {i}") for i in range(4)] + [(9, "word " * 5000)]
    want, got = naive_passages(docs[:4], 50), set()
    for r in substring.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got |= {(r.doc_id, k) for k, m in enumerate(WORD.finditer(docs[r.doc_id][1])) if r.start <= m.start() and m.end() <= r.end}
    assert got == {(d, k) for d, k in want if d > 0}


def test_words_and_units_do_not_depend_on_neighbours():
    texts = [t or "" for _, t in passages(6)] + ["日本語の文。これは二つ目です。", " \u3000 a\u2003b\x1fc", "\n\n", "end"]
    together = substring.Words(texts)
    text, at, till = together.paragraphs(1)
    all_ = list(zip(text.tolist(), (at - together.first[text]).tolist(), together.digests(at, till).tolist()))
    one = []
    for k, t in enumerate(texts):
        w = substring.Words([t])
        assert [t[a:b] for a, b in zip(w.start, w.end)] == [x for part in t.split() for x in (list(part) if "日" in part and "の" in part or "。" in part else [part])] or "日" in t
        _, at, till = w.paragraphs(1)
        one += [(k, a, h) for a, h in zip(at.tolist(), w.digests(at, till).tolist())]
    assert all_ == one and len(one) > 500


def test_repeated_passages_edges(spark):
    line = " ".join(f"word{k}" for k in range(60))
    df = spark.createDataFrame([(3, line, 27), (3, line, 27), (None, line, 27), (5, None, 0), (6, "Before it " + line + " more", 32)], "doc_id long, text string, n_chars int")
    assert {(r.doc_id, r.start, r.kept_doc_id, r.kept_word) for r in substring.repeated_passages(df).collect()} == {(None, 0, 3, 0), (6, 10, 3, 0)}
    rows = sorted((str(r.doc_id), str(r.text), r.n_chars) for r in substring.without_repeats(df).collect())
    assert rows == [("3", line, 27), ("3", line, 27), ("5", "None", 0), ("6", "Before it more", 14)]
    assert substring.repeated_passages(df.limit(0)).count() == 0 == substring.without_repeats(df.limit(0)).count()


def test_only_texts_that_may_match_move(spark):
    docs = spark.createDataFrame([(i if i % 7 else None, f"text {i}") for i in range(3000)] + [(5, "text 5")], "doc_id long, text string")
    slim = substring._identified(docs).repartition(3)
    some = slim.filter("text like '%11%' or text = 'text 5'").select(slim["doc_id"].alias("a_id"), slim["doc_key"].alias("a_key")).localCheckpoint()
    want = {(r.doc_id, r.text) for r in docs.filter("text like '%11%' or text = 'text 5'").collect()}
    assert any(d is None for d, _ in want)
    for blocks in (1, 4):
        got = substring.sieved(slim, some, blocks)
        assert got.columns == slim.columns
        rows = [(r.doc_id, r.text) for r in got.collect()]
        assert want <= set(rows) and rows.count((5, "text 5")) == 2 and len(rows) < len(want) + 60
    assert substring.sieved(slim, some.limit(0).localCheckpoint()).count() == 0
    many = slim.select(slim["doc_id"].alias("a_id"), slim["doc_key"].alias("a_key")).localCheckpoint()
    assert substring.sieved(slim, many, 4).count() == 3001
    # Every text moved to be joined with what was found before.
    passage = " ".join(f"word{i}" for i in range(60))
    df = substring.repeated_passages(spark.createDataFrame([(1, passage), (2, "a " + passage)], "doc_id long, text string"))
    assert "its_block" in df._jdf.queryExecution().executedPlan().toString() and df.count() == 1


def test_nearest_scores_are_of_the_original_doubles(spark):
    x = [(i, [1.0 + i * 1e-9, 2.0, 1e-60 if i == 3 else 0.5]) for i in range(0, 12)] + [(50, [1e-60, 0.0, 0.0])]
    got = {(r.query_id, r.vec_id): r.score for r in ann.nearest(spark.createDataFrame(x, "vec_id long, embedding array<double>"), queries="vec_id = 0").collect()}
    vectors = dict(x)
    assert got[(0, 1)] == 1.0000000010000000 - 1.0 and (0, 50) not in got or len(got) == 10
    assert all(s == float(np.sqrt(((np.array(vectors[v]) - np.array(vectors[q])) ** 2).sum())) for (q, v), s in got.items())

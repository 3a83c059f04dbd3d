import math
import random

import numpy as np
import pytest

from axonframe.llm import licenses, mixing, quality, toxicity

ALPHA = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]


def prose(rng, n):
    return "\n".join(" ".join(rng.choice(ALPHA) + str(rng.randint(0, 40)).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(9)) + "." for _ in range(n))


def junk(rng):
    words = prose(rng, 3).split()
    return rng.choice([" | ".join(words), " ".join(w.upper() + "!!" for w in words), " ".join(w + "$$$" for w in words), " ".join([words[0]] * 60)])


@pytest.fixture(scope="module")
def rated():
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(600):
        good = rng.random() < (0.3 if i % 4 == 0 else 0.9)
        docs.append((i, prose(rng, rng.randint(1, 8)) if good else junk(rng), "xx", "bad.example" if i % 4 == 0 else f"host{i % 3}"))
        labels.append((i, int(good), 0))
    return docs, labels


def test_quality_on_held_out_documents(spark, rated):
    docs, labels = rated
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, lang string, source string, quality double").repartition(3)
    some = spark.createDataFrame(labels[:300], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.judge(df, some).collect()}
    right = sum(rows[i].keep == bool(q) for i, q, _ in labels[300:])
    assert right >= 0.97 * 300
    hosts = {d[3]: rows[d[0]].host_posterior for d in docs}
    assert hosts["bad.example"] < min(v for k, v in hosts.items() if k != "bad.example")
    kept = quality.keep_good(df, some)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.keep}


def test_small_sites_shrink(spark):
    rows = [("big", "p", 0.9)] * 500 + [("poor", "p", 0.1)] * 500 + [("tiny", "p", 0.1)]
    got = {r.host: r.path_posterior for r in quality.posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    assert got["big"] > 0.85 and got["poor"] < 0.15 and got["poor"] < got["tiny"] < 0.5 + 0.1


def test_quality_edges(spark, rated):
    docs, labels = rated
    df = spark.createDataFrame([(None, None, None, None), (1, "", "a", None), (1, "", "a", None), (2, docs[1][1] * 30, None, "h")], "doc_id long, text string, lang string, source string")
    some = spark.createDataFrame(labels[:200] + [(None, 1, None), (3, None, 1)], "doc_id long, quality int, toxic int")
    full = df.unionByName(spark.createDataFrame(docs[:200], "doc_id long, text string, lang string, source string"))
    assert quality.judge(full, some).count() == 204 and quality.keep_good(full, some).filter("doc_id is null").count() == 1
    assert quality.judge(df, some.limit(0)).filter("keep").count() == 4
    assert quality.judge(full.limit(0), some).count() == 0 == quality.keep_good(full.limit(0), some).count()


@pytest.fixture(scope="module")
def insults():
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(600):
        words, bad = prose(rng, rng.randint(2, 9)).split(), i % 5 == 0
        for _ in range(rng.randint(1, 12) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "Nitwit.", "numskull,"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_toxicity_on_held_out_documents(spark, insults):
    docs, labels = insults
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r for r in toxicity.severity(df, spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int")).collect()}
    assert sum(rows[i].toxic == bool(t) for i, _, t in labels[400:]) >= 0.97 * 200
    hits = {i: sum(t.count(w) for w in ("blockhead", "Nitwit", "numskull")) for i, t in docs}
    mean = lambda lo, hi: np.mean([rows[i].severity for i, h in hits.items() if lo <= h < hi])
    assert mean(0, 1) < 0.3 < mean(1, 4) < mean(4, 8) < mean(8, 13) <= 3


def test_cumulative_link_gradient():
    rng = np.random.default_rng(0)
    s, b, grade = rng.normal(size=9) * 2, np.array([-1.0, 0.5, 2.0]), rng.integers(0, 4, 9)
    own = lambda s, b: np.log(toxicity._between(s, b)[np.arange(9), grade])
    g_s, g_b = toxicity._slopes(s, b, grade, toxicity._between(s, b))
    e = 1e-6
    assert np.allclose(g_s, (own(s + e, b) - own(s - e, b)) / (2 * e), atol=1e-5)
    for k in range(3):
        d = np.zeros(3)
        d[k] = e
        assert np.allclose(g_b[:, k], (own(s, b + d) - own(s, b - d)) / (2 * e), atol=1e-5)


def test_toxicity_edges(spark, insults):
    docs, labels = insults
    df = spark.createDataFrame([(None, "blockhead " * 5000), (1, None), (1, None), (2, " \n")], "doc_id long, text string")
    some = spark.createDataFrame(labels[:300] + [(5, None, None)], "doc_id long, quality int, toxic int")
    full = df.unionByName(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = toxicity.severity(full, some).collect()
    assert len(rows) == 604 and [r.toxic for r in rows if r.doc_id is None] == [True]
    assert sorted(r.severity for r in rows if r.doc_id == 1)[:2] == [0.0, 0.0]
    assert all(r.severity == 0 for r in toxicity.severity(df, some.limit(0)).collect()) and toxicity.severity(full.limit(0), some).count() == 0


def naive_notices(text):
    words = [(m.start(), m.end(), m[0].lower()) for m in licenses._WORD.finditer(text)] if text.isascii() else None
    out = set()
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            w = [m[0].lower() for m in licenses._WORD.finditer(t)]
            own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
            n = len(w) - 4
            for i in range(len(words)):
                part = [tuple(x[2] for x in words[j : j + 5]) for j in range(i, min(i + n, len(words) - 4))]
                if len(own & set(part)) >= 0.8 * len(own):
                    out.add(name)
    return out


def test_licenses_against_containment(spark):
    rng = random.Random(6)
    docs = []
    for i in range(120):
        parts = [prose(rng, 2)]
        for name in rng.sample(sorted(licenses.TEMPLATES), rng.randint(0, 2)):
            t = rng.choice(licenses.TEMPLATES[name]).split()
            if len(t) > 12 and rng.random() < 0.5:
                t[rng.randrange(len(t))] = "changed"
            parts += [" ".join(t), prose(rng, 1)]
        docs.append((i, "\n".join(parts)))
    df = spark.createDataFrame([(i, t, 0) for i, t in docs] + [(None, None, 0), (500, "", 0), (501, "MIT", 0)], "doc_id long, text string, license int").repartition(3)
    got = {}
    for r in licenses.notices(df).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
        assert r.containment >= 0.8 and 0 <= r.start < r.end
    assert got == {i: n for i, t in docs if (n := naive_notices(t))}
    assert licenses.notices(df.limit(0)).count() == 0


def test_license_does_not_cross_texts():
    scan = licenses.Scanner(licenses.TEMPLATES)
    assert scan(["Released under the", "MIT License.", "ñ Released under the MIT License."]) == [[], [], [("MIT", 2, 32, 1.0)]]


def level(sizes, weights, share=1.5, most=2.0):
    total, open_ = share * sum(sizes), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while True:
        rest = total - sum(most * sizes[i] for i in range(len(sizes)) if i not in open_)
        w = sum(weights[i % 3] for i in open_)
        over = {i for i in open_ if rest * weights[i % 3] / w > most * sizes[i]}
        if not over:
            for i in range(len(sizes)):
                out[i] = rest * weights[i % 3] / w if i in open_ else most * sizes[i]
            return out
        open_ -= over


def test_targets_against_resharing(spark):
    rng = random.Random(9)
    for _ in range(3):
        sizes = [rng.randint(1, 1000) for _ in range(rng.randint(1, 12))]
        names = [f"s{i:02d}" for i in range(len(sizes) - 1)] + [None]
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).collect()}
        assert all(math.isclose(got[n], t) for n, t in zip(names, level(sizes, (5, 2, 1))))


def test_mix_keeps_targets_and_bounds(spark):
    rng = random.Random(10)
    docs = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "É", None]), 5, 1) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, parts int, copies int").repartition(4)
    rows = mixing.mixed_sizes(df).collect()
    assert len(rows) == 3000
    by = {}
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size)
        by.setdefault(round(r.target, 6), []).append((r.size, r.source_size, r.taken))
    for target, some in by.items():
        assert sum(s for s, _, _ in some) == some[0][1] and abs(sum(t for _, _, t in some) - target) <= 2 * 60 + 0.01 * target
    again = {(r.doc_id, r.taken) for r in mixing.mixed_sizes(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and sum(len(r.text.split()) for r in mixed.collect()) == sum(r.taken for r in rows)


def test_mix_edges(spark):
    df = spark.createDataFrame([(None, None, None), (1, "", "a"), (2, "x y", "b"), (2, "x y", "b"), (3, "long " * 9000, "c")], "doc_id long, text string, source string")
    rows = mixing.mixed_sizes(df).collect()
    assert len(rows) == 5 and all(r.taken <= 2 * r.size for r in rows) and {r.size for r in rows} == {0, 2, 9000}
    assert mixing.mixed_sizes(df.limit(0)).count() == 0 == mixing.mix(df.limit(0)).count()
    assert all(r.taken == 0 for r in mixing.mixed_sizes(df.limit(2)).collect())


def test_features_do_not_depend_on_partitions(spark, insults):
    docs, labels = insults
    df, some = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = lambda n: sorted(tuple(r) for r in df.join(some, "doc_id").select("toxic", "text").repartition(n).mapInArrow(toxicity._seen, "feature string, clean long, toxic long").groupBy("feature").sum("clean", "toxic").collect())
    assert seen(1) == seen(200) and len(seen(1)) > 0


def test_short_license_notices():
    scan = licenses.Scanner(licenses.ALL)
    got = scan(["x\nAll rights reserved.", "SPDX-License-Identifier: MIT", "all rights", "reserved", "ñ SPDX-License-Identifier: Apache-2.0", "rights reserved", ""])
    assert got == [[("All-rights-reserved", 2, 21, 1.0)], [("MIT", 0, 28, 1.0)], [], [], [("Apache-2.0", 2, 37, 1.0)], [], []]
    assert licenses.Scanner({"x": ["one two"]})(["one two"]) == [[("x", 0, 7, 1.0)]]


def test_models_do_not_depend_on_the_layout(spark, rated, insults):
    for module, call, rows, columns in (
        (toxicity, "severity", insults, ("severity", "p_toxic")), (quality, "judge", rated, ("p_document", "path_posterior", "quality")),
    ):
        docs, labels = rows
        schema = "doc_id long, text string" + (", lang string, source string" if len(docs[0]) > 2 else "")
        docs = docs + [docs[0][:1] + ("another text " * 5,) + docs[0][2:]] + docs[5:7]
        df, some = spark.createDataFrame(docs, schema), spark.createDataFrame(labels[:400] + [(0, 0, 1)], "doc_id long, quality int, toxic int")
        key = lambda r: (r.doc_id, *(r[c] for c in columns))
        a = sorted(map(key, getattr(module, call)(df.coalesce(1), some).collect()))
        b = sorted(map(key, getattr(module, call)(df.repartition(16), some.repartition(7)).collect()))
        assert [x[0] for x in a] == [x[0] for x in b] and np.allclose([x[1:] for x in a], [x[1:] for x in b], rtol=0, atol=1e-9)


def test_ordinal_fit_is_a_maximum_of_the_likelihood():
    rng = np.random.default_rng(3)
    counts = [{k: int(n) for k, n in enumerate(rng.poisson(0.3 + (i % 4) * np.array([0.8, 0.4, 0.0]))) if n} for i in range(400)]
    lengths, toxic = rng.integers(20, 60, 400).tolist(), np.array([int(i % 4 > 0) for i in range(400)])
    weight, ridge = [3.0, 2.0, 1.0], 3e-5
    model = toxicity.Ordinal(["a", "b", "c"], weight, counts, lengths, toxic, ridge)
    x = np.array([[math.log2(1 + c.get(k, 0)) for k in range(3)] + [math.log(1 + n)] for c, n in zip(counts, lengths)])
    x[:, 3] -= x[:, 3].mean()
    held = x[:, :3] @ weight
    cuts = np.quantile(held[toxic == 1], [1 / 3, 2 / 3])
    grade = np.where(toxic == 1, 1 + (held >= cuts[0]) + (held >= cuts[1]), 0)

    def loss(w, b):
        edge = [1.0, *[1 / (1 + np.exp(t - x @ w)) for t in b], 0.0]
        up = [np.broadcast_to(e, len(x)) for e in edge]
        p = np.choose(grade, [up[k] - up[k + 1] for k in range(4)])
        return -np.log(p).mean() + ridge / 2 * (w @ w)

    best = loss(model.w, model.b)
    assert list(model.b) == sorted(model.b)
    for k in range(4):
        for step in (-0.02, 0.02):
            assert loss(model.w + step * (np.arange(4) == k), model.b) > best - 1e-5
    for k in range(3):
        for step in (-0.02, 0.02):
            assert loss(model.w, model.b + step * (np.arange(3) == k)) > best - 1e-5
    up = model.exceed(counts, lengths)
    assert np.allclose(up, [[1 / (1 + np.exp(t - s)) for t in model.b] for s in x @ model.w]) and (np.diff(up, axis=1) <= 0).all()


def test_mix_leaves_columns_of_the_same_names_alone(spark):
    rows = [(i, "some words here", "a" if i % 2 else "b", "MINE", 77, -1.0, i) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string, copies int, source_size double, words long")
    got = mixing.mix(df)
    assert got.columns == df.columns and set(map(tuple, got.collect())) <= set(rows) and got.count() == 30


def test_checkpoint_folder_must_be_shared(spark, monkeypatch):
    from types import SimpleNamespace

    from axonframe.llm import common

    def session(master, conf=None):
        held = []
        sc = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k, d: conf), getCheckpointDir=lambda: held[-1] if held else None, setCheckpointDir=held.append)
        return SimpleNamespace(sparkContext=sc)

    assert common.shared_dir(session("spark://host:7077", "hdfs://there/x")) == "hdfs://there/x"
    assert common.shared_dir(session("local[4]"))
    with pytest.raises(RuntimeError):
        common.shared_dir(session("spark://host:7077"))


def test_operators_leave_the_session_as_it_is(spark):
    before = dict(spark.sparkContext.getConf().getAll()) | {"rows": spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")}
    licenses.notices(spark.createDataFrame([(1, "All rights reserved.")], "doc_id long, text string"), licenses.ALL).count()
    assert before == dict(spark.sparkContext.getConf().getAll()) | {"rows": spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")}

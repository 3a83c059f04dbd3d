"""Queries that take all of their table, against brute force."""

from itertools import combinations

import numpy as np
import pytest

from axonframe.plans import REGISTRY
from axonframe.sources.lifts import Tables


class Fixture:
    def __init__(self, **frames):
        self.__dict__.update(frames)


def test_closeness_of_every_frame(spark):
    edges = {("N", 2, 0): "ab bc cd", ("A", 1, 3): "ab ac bc ef", ("R", 0, 5): "xy"}
    rows = [(*k, e[0], e[1], 2.0) for k, es in edges.items() for e in es.split()]
    got = {(r.freq, r.trial, r.t_idx, r.node): r.closeness for r in REGISTRY["graph_closeness"].plan(Fixture(frames=spark.createDataFrame(rows, "freq string, trial long, t_idx long, src string, dst string, weight double"))).collect()}
    want = {}
    for k, es in edges.items():
        nodes = sorted(set(es) - {" "})
        d = {(a, b): 0 if a == b else 1 if a + b in es.split() or b + a in es.split() else 99 for a in nodes for b in nodes}
        for m in nodes:
            for a in nodes:
                for b in nodes:
                    d[a, b] = min(d[a, b], d[a, m] + d[m, b])
        want |= {(*k, a): sum(d[a, b] for b in nodes if d[a, b] < 99) for a in nodes}
    assert got == want


def test_meta_connectivity_of_all_nodes(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(7, 12))
    sig = spark.createDataFrame([(n, "f", 0, k, float(x[n, k])) for n in range(7) for k in range(12)], "node long, freq string, trial long, t_idx long, value double")
    t = Fixture(sig=sig)
    edges = list(combinations(range(7), 2))
    c = np.corrcoef([x[a] * x[b] for a, b in edges])
    mc = {(r.edge_a, r.edge_b): r.mc for r in REGISTRY["meta_connectivity_all_nodes"].plan(t).collect()}
    assert len(mc) == 21 * 22 // 2
    name = [f"{a}~{b}" for a, b in edges]
    assert all(mc[name[i], name[j]] == pytest.approx(c[i, j]) for i in range(21) for j in range(i, 21))
    ent = {r.edge: r.entanglement for r in REGISTRY["entanglement_all_nodes"].plan(t).collect()}
    assert ent == {n: pytest.approx(s) for n, s in zip(name, c.sum(axis=1))}
    trimer = {int(r.node): r.strength for r in REGISTRY["trimer_strength_all_nodes"].plan(t).collect()}
    assert trimer == {v: pytest.approx(sum(c[i, j] for i, j in combinations(range(21), 2) if v in edges[i] and v in edges[j])) for v in range(7)}


def test_factors_of_every_signal(spark, small):
    t = Tables(spark, small)
    got = REGISTRY["tf_factors"].plan(t).select("trial", "node").distinct().count()
    assert got == t.table("embeddings").count() > 50

"""Operators on small tables with known answers."""

import random

import numpy as np

from simspark.operators import align, distance, effects, graphs, programs
from simspark.plans.code import PROGRAMS
from simspark.sources.code import parse_functions, parse_program


def test_rule_tiers(spark):
    rules = spark.createDataFrame([(0, "default", ""), (1, "regex", "a"), (2, "fqname", "ab"), (3, "module", "m"), (4, "regex", "ab")], "rule_id int, kind string, pattern string")
    calls = spark.createDataFrame([("ab",), ("ac",), ("m.x",), ("z",), ("abc",)], "call string")
    assert dict(map(tuple, effects.match_rules(calls, rules).collect())) == {"ab": 2, "ac": 1, "m.x": 3, "z": 0, "abc": 1}


def test_diamond(spark):
    nodes = spark.createDataFrame([(1, n, "x" if n in (1, 3) else None, "x" if n == 4 else None) for n in (1, 2, 3, 4)], "g int, n int, writes string, reads string")
    edges = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (1, 2, 4), (1, 3, 4)], "g int, src int, dst int")
    assert sorted(map(tuple, graphs.reaching_definitions(nodes, edges).collect())) == [(1, 1, 4, "x"), (1, 3, 4, "x")]
    assert sorted(map(tuple, graphs.control_dependence(nodes.select("g", "n"), edges).collect())) == [(1, 1, 2), (1, 1, 3)]
    assert (1, 1, 4) in set(map(tuple, graphs.postdominators(nodes.select("g", "n"), edges).collect()))


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(9)], "id long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (8, 3), (5, 6)], "src long, dst long")
    got = dict(map(tuple, graphs.connected_components(nodes, edges).collect()))
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 8: 1, 4: 4, 5: 5, 6: 5, 7: 7}


def test_greedy_matching(spark):
    rows = [("p", "q", 1, 7, 0.9), ("p", "q", 1, 8, 0.8), ("p", "q", 2, 7, 0.85), ("p", "q", 2, 8, 0.1)]
    got = programs.greedy_matches(spark.createDataFrame(rows, "prog_a string, prog_b string, fa int, fb int, score double")).collect()
    assert sorted((r.fa, r.fb) for r in got) == [(1, 7), (2, 8)]


def test_clusters_of_points():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.01, (12, 2)), rng.normal(1, 0.01, (12, 2)), [[5, 5]]])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    labels = distance.hdbscan_labels(d, 5)
    assert len(set(labels[:12])) == 1 and len(set(labels[12:24])) == 1 and labels[0] != labels[12] and labels[24] == -1
    cut = distance.average_linkage_labels(d, 0.5)
    assert cut.tolist() == [0] * 12 + [1] * 12 + [2]


def test_parsing(spark):
    rows = parse_functions(spark.createDataFrame([p for p in PROGRAMS if p[0].endswith(".py")], "program string, code string")).collect()
    by = {(r.program, r.name): r for r in rows}
    assert by["bad/broken.py", None].error == "SyntaxError"
    total = by["sum/base.py", "total"]
    assert [n.kind for n in total.nodes] == ["Assign", "For", "If", "Assign", "Return"]
    data = {(e.src, e.dst, e.label) for e in total.edges if e.view == "data"}
    assert {(1, 4, "s"), (4, 4, "s"), (1, 5, "s"), (4, 5, "s"), (2, 3, "x"), (2, 4, "x")} <= data
    assert parse_program("p", None)[0][-1] == "no text"


def test_tiles_match_all_pairs(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 3))
    x[5] = 0
    rows = [(i % 3, i, v.tolist()) for i, v in enumerate(x)] + [(9, 100, [1.0, 0.0, 0.0]), (None, 101, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "g int, id long, v array<double>").repartition(3)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    cos = unit @ unit.T
    d = np.round(np.clip(1 - cos, 0, 1), 6)
    peers = {i: [j for j in range(60) if j != i and j % 3 == i % 3] for i in range(60)}
    near = {(r.i, r["rank"]): (r.j, r.d) for r in distance.nearest(df, 4, tile=7).collect()}
    assert near == {(i, k + 1): (j, d[i, j]) for i in peers for k, j in enumerate(sorted(peers[i], key=lambda j: (d[i, j], j))[:4])}
    sums = {r.i: r.s for r in distance.distance_sums(df, tile=7).collect()}
    assert set(sums) == {*range(60), 100} and all(abs(sums[i] - sum(d[i, j] for j in peers[i])) < 1e-9 for i in peers)
    pairs = {(r.i, r.j) for r in distance.similar_pairs(df, 0.8, tile=7).collect()}
    assert pairs == {(i, j) for i in peers for j in peers[i] if i < j and cos[i, j] >= 0.8}


def test_reachability_of_a_group_of_several_tiles(spark):
    rng = random.Random(9)
    rows = [(n % 2, n, [rng.uniform(-1, 1) for _ in range(4)]) for n in range(40)]
    vectors = spark.createDataFrame(rows, "g int, id long, v array<double>")
    core = spark.createDataFrame([(g, i, i / 100) for g, i, _ in rows], "g int, i long, core double")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    want = {(g, i, j): max(round(min(1, max(0, 1 - cos(v, w))), 6), i / 100, j / 100) for g, i, v in rows for h, j, w in rows if g == h and i != j}
    for tile in (6, 100):
        found = distance.mutual_reachability(vectors, core, tile)
        got = {(r.g, r.i, r.j): r.reach for r in found.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
        assert found.count() == len(want)


def test_supplement_in_cells_is_that_of_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.poisson(2.0, (900, 5)).astype(float)
    x[:40], x[40:120] = 0, x[119] * rng.integers(1, 4, (80, 1))
    monkeypatch.setattr(align, "cells", lambda v, share, fit=align.cells: fit(v, share, 60))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    asked = rows.where("id % 3 < 2")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    sim = np.round(unit @ unit.T, 6)
    want = {(i, j) for i in range(900) if i % 3 < 2 for j in sorted((j for j in range(900) if j != i), key=lambda j: (-sim[i, j], j))[:7]}
    got = align.supplement(asked, rows, 7).collect()
    assert len(got) == len(want) and {(r.i, r.j) for r in got} == want
    assert all(r.sim == sim[r.i, r.j] for r in got)

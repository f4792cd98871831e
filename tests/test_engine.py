"""The stages over parsed code, on small programs with known answers."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from simspark.functions import columns as C
from simspark.jobs import cli, stages
from simspark.operators import engine, graphs, parsed, programs
from simspark.plans import report
from simspark.plans.code import PROGRAMS
from simspark.sources import code, graph_json


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("programs")
    for name, text in PROGRAMS:
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    return root


@pytest.fixture(scope="module")
def built(spark):
    rows = [(p, c, "python") for p, c in PROGRAMS if p.endswith(".py")]
    return stages.built(spark, spark.createDataFrame(rows, "program string, code string, language string"))


def test_scan_by_language_and_encoding(spark, tmp_path):
    (tmp_path / "b.py").write_text("x = 1\n")
    (tmp_path / "a.c").write_bytes("int é;".encode("latin-1"))
    assert [(r.program.rpartition("/")[2], r.code, r.language) for r in code.scan(spark, str(tmp_path)).collect()] == [("a.c", "int é;", "c"), ("b.py", "x = 1\n", "python")]
    assert code.scan(spark, str(tmp_path), "python").count() == 1


def test_effects_of_nodes(spark):
    source = "import json\n\ndef f(p):\n    x = json.load(open(p))\n    print(x)\n    y = time.time()\n"
    rows = spark.createDataFrame([("f.py", source, "python")], "program string, code string, language string")
    _, signed, raw = stages.built(spark, rows)
    got = {(r.nid, r.resource, r.tag) for r in raw.where("func_id like '%::f@%'").collect()}
    # open and print have no rule by their bare names; flags are those of the last call that states them
    assert {(1, "FILE[path]", "READ"), (1, "HEAP[*]", "READ"), (1, "HEAP[*]", "WRITE"), (2, "HEAP[*]", "WRITE"), (3, "TIME", "READ"), (1, "FLAG:unknown", "FLAG"), (3, "FLAG:time", "FLAG")} <= got
    assert (1, "FLAG:io_file", "FLAG") not in got and (3, "FLAG:unknown", "FLAG") not in got
    f = signed.where("func_id like '%::f@%'").first()
    assert (f.FILE_IO, f.R_HEAP, f.W_HEAP, f.TIME, f.EXC) == (1, 2, 2, 1, 2)
    named = stages.built(spark, rows, normalise_builtins=True)[1].where("func_id like '%::f@%'").first()
    assert (named.FILE_IO, named.R_HEAP, named.TIME) == (3, 0, 1)


def test_resource_nodes_come_behind_a_functions_own(built):
    t, _, _ = built
    nodes = t.nodes.where("func_id = 'net/fetch.py::fetch@4'").orderBy("nid").collect()
    kinds = [(n.nid, n.kind) for n in nodes if n.kind.startswith("RES")]
    top = max(n.nid for n in nodes if not n.kind.startswith("RES"))
    assert kinds[0] == (top + 1, "RES_NET_READ") and [n for n, _ in kinds] == list(range(top + 1, top + 1 + len(kinds)))
    assert t.edges.where("func_id = 'net/fetch.py::fetch@4' and view = 'effect'").where(F.col("dst") == top + 1).count() == 1


def test_lent_views(spark):
    rows = [("f", "data", 1, 2, "x"), ("f", "data", 1, 2, "y"), ("f", "control", 2, 3, "IF"), ("g", "data", 1, 2, "x"), ("g", "dfg", 5, 6, "")]
    got = parsed.enrich_views(spark.createDataFrame(rows, "func_id string, view string, src int, dst int, label string"))
    assert {(r.func_id, r.view, r.src, r.dst) for r in got.where("view in ('dfg', 'ast')").collect()} == {("f", "dfg", 1, 2), ("f", "ast", 2, 3), ("g", "dfg", 5, 6)}


def test_structural_vector(spark):
    nodes = spark.createDataFrame([("f", i) for i in (1, 2, 3)] + [("g", 1)], "func_id string, nid int")
    edges = spark.createDataFrame([("f", "cfg", 1, 2), ("f", "cfg", 2, 3), ("f", "data", 1, 3), ("f", "ast", 1, 3)], "func_id string, view string, src int, dst int")
    got = dict(map(tuple, parsed.structural_vectors(nodes.select("func_id").distinct(), nodes, edges).collect()))
    want = np.array([3, 2, 1, 0, *[0] * 13, 2, 0, 2.0])
    assert np.allclose(got["f"], want / (np.linalg.norm(want) + 1e-8)) and np.allclose(got["g"], [1 / (1 + 1e-8), *[0] * 19])


def test_blocks(spark):
    nodes = spark.createDataFrame([("f", 0, 9), ("f", 1, 2), ("f", 2, 3), ("f", 3, 0), ("g", 1, 4), ("g", 2, 7)], "func_id string, nid int, line int")
    edges = spark.createDataFrame([("f", "cfg", 1, 2), ("f", "data", 0, 0), ("f", "effect", 0, 1)], "func_id string, view string, src int, dst int")
    got = sorted((r.func_id, r.block, sorted(r.nids), r.line_min, r.line_max) for r in parsed.blocks(nodes, edges).collect())
    assert got == [("f", 0, [3], 0, 0), ("f", 1, [1, 2], 2, 3), ("f", 2, [0], 9, 9), ("g", 0, [1, 2], 4, 7)]


def test_nearest_and_last_definitions(spark):
    functions = spark.createDataFrame([("f", 10), ("f", 3), ("g", 1)], "name string, line int")
    objects = spark.createDataFrame([("f", 6), ("f", 14), ("f", 4)], "name string, line int")
    assert sorted((r.name, r.line, r.near) for r in programs.nearest(functions, objects).collect()) == [("f", 3, 4), ("f", 10, 6)]
    nodes = spark.createDataFrame([(1, 1, "a", True, False), (1, 2, "a", True, True), (1, 3, "a", False, True), (1, 4, "b", False, True)], "g int, n int, var string, writes boolean, reads boolean")
    assert sorted(map(tuple, graphs.last_definitions(nodes).collect())) == [(1, 1, 2, "a"), (1, 2, 3, "a")]


def test_similar_sets_match_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [f"t{x}" for x in rng.choice(12, rng.integers(0, 9), replace=False)]) for i in range(60)]
    for least in (0.3, 0.6, 1.0):
        got = {(r.i, r.j): r.jaccard for r in engine.set_similarity_pairs(spark.createDataFrame(rows, "id int, s array<string>"), least).collect()}
        want = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for (a, x), (b, y) in itertools.combinations(rows, 2) if x and y}
        assert got == {k: v for k, v in want.items() if v >= least - 1e-12}
    with pytest.raises(ValueError):
        engine.set_similarity_pairs(spark.createDataFrame(rows, "id int, s array<string>"), 0)


def test_candidates_and_program_pairs(spark, built):
    t, signed, _ = built
    index = engine.build_index(t, signed, stages.with_options(min_candidates=1))
    assert {r.view for r in index.buckets.select("view").distinct().collect()} == {"token", "graph"}
    cands = engine.candidates(index, stages.with_options(min_candidates=0)).collect()
    pairs = {(c.meta_i.id, c.meta_j.id): c for c in cands}
    renamed = pairs["sum/base.py::total@1", "sum/renamed.py::add_up@1"]
    assert renamed.lsh_sim == 0.0  # neither has an effect
    copied = pairs["io/copy.py::load_file@3", "io/read.py::load@3"]
    assert abs(copied.lsh_sim - 1) < 1e-9 and copied.meta_i.token_len > 8 and not copied.meta_i.is_template_like
    assert all(i < j and i.split("::")[0].rpartition("/")[2] != j.split("::")[0].rpartition("/")[2] for i, j in pairs)
    # the supplement brings functions that share no bucket
    assert len(engine.candidates(index, stages.with_options(min_candidates=10)).collect()) > len(cands)
    kept = engine.function_pairs(engine.candidates(index), 0.5)
    best = engine.program_pairs(kept).first()
    assert (best.prog_a, best.prog_b, [(m.fa, m.fb) for m in best.matches]) == ("io/copy.py", "io/read.py", [("io/copy.py::load_file@3", "io/read.py::load@3")])
    assert best.score > 0.9
    weights = spark.createDataFrame([("io/copy.py::load_file@3", 0.1)], "func_id string, weight double")
    light = engine.function_pairs(engine.candidates(index), 0.5, weights).where("fa = 'io/copy.py::load_file@3'").first()
    assert 1 <= light.la < light.lb


def test_all_vs_all(built):
    t, signed, _ = built
    matches, pairs = engine.all_vs_all(t.functions, signed)
    got = {(r.prog_a, r.prog_b): r.n_matches for r in pairs.collect()}
    assert got["sum/base.py", "sum/renamed.py"] == 2 and got["io/copy.py", "io/read.py"] == 2
    assert matches.groupBy("prog_a", "prog_b", "fa").count().where("count > 1").isEmpty()


def test_graph_documents_round_trip(spark, built, tmp_path):
    t, signed, raw = built
    graph_json.write_graphs(graph_json.documents(t, signed, raw), str(tmp_path / "g"))
    graph_json.write_enriched(spark, str(tmp_path / "g"), str(tmp_path / "mv"))
    for folder in ("g", "mv"):
        back = graph_json.read_graphs(spark, str(tmp_path / folder))
        again = graph_json.tables(back)
        key = ["func_id", "nid", "kind", "reads", "writes", "calls"]
        assert again.nodes.select(key).exceptAll(t.nodes.select(key)).isEmpty() and again.nodes.count() == t.nodes.count()
        assert stages.read_signatures(back).exceptAll(signed.select(stages.read_signatures(back).columns)).isEmpty()
    views = again.edges.groupBy("view").count().collect()
    assert {r.view for r in views} >= {"dfg", "ast", "cfg", "data", "control", "effect"}
    f = back.where("id = 'io/read.py::load@3'").first()
    assert "json.load" in f.called_funcs and f.modules == ["json"] and f.op_category_counts["Try"] == 1
    span = graph_json.spans(back).where("id = 'io/read.py::load@3'").first()
    assert (span.start_line, span.end_line, span.effect_counts["FILE_IO"]) == (4, 9, 1.0)
    assert [r.key for r in graph_json.effect_keys(back).collect()][:2] == ["DB_IO", "ENV"]
    assert graph_json.cluster_functions(back, "java").isEmpty() and graph_json.cluster_functions(back, "auto", 3).count() == 3


def test_places_and_labels(spark):
    df = spark.createDataFrame([("f", 3), (None, 0)], "name string, line int").select(graph_json.function_label(F.col("name"), F.col("line")).alias("x"))
    assert [r.x for r in df.collect()] == ["f @L3", "<anon>"]
    functions = spark.createDataFrame([("a.py",), ("gone.py",)], "program string")
    got = graph_json.source_lines(functions, spark.createDataFrame([("a.py", "x\ny")], "program string, code string"))
    assert {r.program: r.lines for r in got.collect()} == {"a.py": ["x", "y"], "gone.py": ["# source not found: gone.py"]}
    langs = spark.createDataFrame([("a.py",), ("b.H",), ("c.java",), ("d",)], "p string").select(graph_json.report_language(F.col("p")).alias("l"))
    assert [r.l for r in langs.collect()] == ["python", "c/cpp", "java", "unknown"]


def test_clusters_and_weights(spark):
    rows = [(f"f{i}", f"p{i % 5}", i, [float(i < 20), float(i >= 20), 0.01 * i], ["EXC"] if i < 20 else ["ENV"], [f"s{i < 20}"]) for i in range(40)]
    df = spark.createDataFrame(rows, "func_id string, program string, func_idx int, v array<double>, bag array<string>, shingles array<string>")
    signed = df.select("func_id", *(F.array_contains("bag", c).cast("long").alias(c) for c in engine.E.COUNTERS))
    nodes = df.select("func_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("nid"))
    found = engine.clusters(df, df.select("func_id", "v"), signed, df.select("func_id", "shingles"), nodes).orderBy("cluster_id").collect()
    assert [(c.size, c.mean_node_size, c.distinct_files, c.is_template_like) for c in found] == [(20, 2.0, 5, True)] * 2
    weights = engine.template_weights(spark.createDataFrame(found)).collect()
    assert len(weights) == 40 and all(abs(w.weight - 2 / np.log(22) / 2) < 1e-9 for w in weights)
    given = spark.createDataFrame([("f0", [3.0, 4.0]), ("f1", [])], "func_id string, v array<double>")
    own = dict(map(tuple, parsed.semantic_vectors(df.select("func_id", "v"), given).collect()))
    assert own["f0"] == [0.6, 0.8] and own["f1"] == rows[1][3]


def test_expressions(spark):
    row = spark.range(1).select(
        C.effect_tags(F.lit("Logging; IO/net,")).alias("tags"),
        C.name_similarity(F.lit("parse_line"), F.lit("line_parse_all")).alias("words"),
        C.name_similarity(F.lit("parse"), F.lit("parse_line")).alias("prefix"),
        C.name_similarity(F.lit("main_x"), F.lit("util_y")).alias("generic"),
        C.task_similarity(F.lit(0.9), F.lit(1.0), F.lit(0.0)).alias("task"),
        C.task_similarity(F.lit(0.9), F.lit(0.0), F.lit(0.1)).alias("other"),
        C.first_number(F.lit(None).cast("int"), F.lit(7)).alias("degree"),
    ).first()
    assert row.tags == ["logging", "io", "net"] and abs(row.words - 2 / 3) < 1e-9 and row.prefix == 0.8 and row.generic == 0.0
    assert abs(row.task - 0.9 * 0.76) < 1e-9 and row.other == 0.0 and row.degree == 7


def test_reports(spark, built):
    t, _, _ = built
    pairs = spark.createDataFrame([("io/copy.py", "io/read.py", 0.95, [("io/copy.py::load_file@3", "io/read.py::load@3", 0.9)])], "prog_a string, prog_b string, score double, matches array<struct<fa:string,fb:string,score:double>>")
    places = t.functions.select("func_id", "name", F.col("first_line").alias("start_line"), F.col("last_line").alias("end_line"))
    sources = spark.createDataFrame(PROGRAMS, "program string, code string")
    text = report.pair_report(pairs, places, sources, nodes=t.nodes, edges=t.edges, blocks=parsed.blocks(t.nodes, t.edges), templates=spark.createDataFrame([("io/read.py::load@3",)], "func_id string"))
    assert "load_file @L3 (3-9)" in text and "B template" in text and text.count("ln mark") == 14 and "RES_FILE_READ" in text
    pages = report.program_cluster_report(pairs, sources)
    assert set(pages) == {"index.html", "pairs/edge0.html"} and "copy.py" in pages["index.html"]
    clusters = spark.createDataFrame([(0, 2, ["a<", "b"], "b", 1.0, 0.5, 1, False), (1, 9, ["c"], "c", 1.0, 0.1, 3, True)], graph_json.CLUSTERS)
    page = report.cluster_report(clusters, 11)
    assert page.index("Cluster #1") < page.index("Cluster #0") and "a&lt;" in page and "11 functions" in page
    assert report.highlight_line("class A: # 'x'") == "<span class='k'>class</span> A: <span class='c'># &#x27;x&#x27;</span>"


def test_command_line(spark, tree, tmp_path):
    run = lambda *a: cli.run(spark, [str(x) for x in a])
    run("pipeline", "--input", tree, "--output", tmp_path / "w", "--threshold", 0.3, "--with-clusters", "--min-cluster-size", 2)
    rows = [json.loads(x) for f in (tmp_path / "w/program_pairs/rows").glob("*.json") for x in f.read_text().splitlines()]
    found = {tuple(r[p].partition("/programs")[2].partition("/")[2] for p in ("prog_a", "prog_b")): r["score"] for r in rows}
    assert found["io/copy.py", "io/read.py"] > 0.9
    run("rank", "--candidates", tmp_path / "w/candidates", "--output", tmp_path / "again", "--threshold", 0.3)
    run("all-vs-all", "--json-root", tmp_path / "w/graphs_mv", "--output", tmp_path / "ava", "--input", tree)
    assert spark.read.json(str(tmp_path / "ava/programs")).where("code = ''").isEmpty()
    run("cluster-report", "--clusters", tmp_path / "w/clusters", "--output", tmp_path / "page")
    assert "exemplar" in "".join(f.read_text() for f in (tmp_path / "page").glob("*.txt")).lower()

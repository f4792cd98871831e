"""Graph JSON, lexers, the summary page and streaming recall."""

import json

from pyspark.sql import functions as F

from simspark.functions import lexers
from simspark.plans.report import render_pairs
from simspark.sources import code, graph_json
from simspark.streaming import incremental


def test_graph_json(spark, tmp_path):
    f = {"id": "f0", "name": "f", "first_lineno": 1, "nodes": [{"nid": 0, "kind": "Assign", "lineno": 1, "reads": [], "writes": ["x"], "calls": []}], "cfg": {"edges": [[0, 1]]}, "pdg": {"data_edges": [[0, 1, "x"]], "control_edges": [], "effect_edges": [[0, 2]]}, "tokens_norm": ["a"]}
    (tmp_path / "a.json").write_text(json.dumps({"file": "a.py", "py_version": "3", "functions": [f, f | {"id": None, "name": "g"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"file": "b.py", "functions": [f | {"name": "later"}]}))
    (tmp_path / "c.json").write_text("{broken")
    graphs = graph_json.read_graphs(spark, str(tmp_path))
    assert {(r.id, r.name) for r in graphs.collect()} == {("f0", "later"), ("a.py::g@1", "g")}
    assert {tuple(r)[1:] for r in graph_json.edges(graphs.where("id = 'f0'")).collect()} == {("cfg", 0, 1, None), ("data", 0, 1, "x"), ("effect", 0, 2, None)}


def test_lexer(spark):
    row = spark.range(1).select(lexers.lexemes(F.lit("int a = 10; // x\n/* y */ f(\"s\");")).alias("t"), lexers.calls(F.lit('if (g.h(x, "k(") > 1) puts("a");'), "java").alias("c")).first()
    assert row.t == ["int", "a", "=", "<NUM>", ";", "f", "(", "s", ")", ";"]
    assert row.c == ["g.h", "puts"]


def test_source_scan(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.txt").write_text("no")
    assert [(r.code, r.language) for r in code.scan(spark, str(tmp_path)).collect()] == [("x = 1\n", "python")]


def test_summary_page(spark):
    page = render_pairs(spark.createDataFrame([("a<b", "c", 0.9), ("d", "e", 0.1)], "prog_a string, prog_b string, score double"))
    assert "a&lt;b" in page and page.index("0.900") < page.index("0.100")


def test_streaming_recall(spark, tmp_path):
    texts = ["one two three four five six seven", "one two three four five six seven", "other words stand here in this text", "one two three four five six seven"]
    for i, t in enumerate(texts):
        spark.createDataFrame([(i, t)], "id long, text string").withColumn("ts", F.timestamp_seconds(F.lit(100_000 + i))).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id long, text string, ts timestamp").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    incremental.start(spark, source, str(tmp_path / "index"), str(tmp_path / "pairs"), str(tmp_path / "state")).awaitTermination()
    pairs = {(r.i, r.j) for r in spark.read.parquet(str(tmp_path / "pairs")).collect()}
    assert pairs == {(0, 1), (0, 3), (1, 3)}

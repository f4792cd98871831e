"""Queries over programs of our own: each stage from sources to program pairs, on files that are written and scanned.

The driver's tables hold no code, so these queries have programs of their own and no SQL; tests hold their rows against values made by hand.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simspark.functions import columns as C
from simspark.jobs import stages
from simspark.operators import effects as E
from simspark.operators import engine, parsed
from simspark.operators.graphs import materialised, shared_dir
from simspark.plans.registry import query
from simspark.sources import code, graph_json, rules

PROGRAMS = [
    ("sum/base.py", "def total(xs):\n    s = 0\n    for x in xs:\n        if x > 0:\n            s = s + x\n    return s\n"),
    ("sum/renamed.py", "def add_up(values):\n    acc = 0\n    for v in values:\n        if v > 0:\n            acc = acc + v\n    return acc\n"),
    ("sum/other.py", "def total(xs):\n    return sum(x for x in xs if x > 0)\n"),
    ("io/read.py", "import json\n\ndef load(path):\n    try:\n        with open(path) as f:\n            return json.load(f)\n    except ValueError:\n        print('bad')\n    return None\n"),
    ("io/copy.py", "import json\n\ndef load_file(name):\n    try:\n        with open(name) as g:\n            return json.load(g)\n    except ValueError:\n        print('broken')\n    return None\n"),
    ("net/fetch.py", "import requests\nimport random\n\ndef fetch(url):\n    while True:\n        r = requests.get(url)\n        if r.ok or random.random() < 0.1:\n            return r.text\n"),
    ("bad/broken.py", "def broken(:\n"),
    ("c/dice.c", "#include <stdio.h>\nint roll(int n) {\n  int r = rand() % n; /* one */\n  if (r > 2) {\n    printf(\"%d\", r);\n  }\n  return r;\n}\n"),
    ("c/dice.s.c", "\t.text\n\t.globl roll\nroll:\n\tpush rbp\n\tmov rbp, rsp\n\tmov dword ptr [rbp-4], edi\n\tcall rand@PLT\n\tcmp eax, 2\n\tjle .L2\n\tcall printf@PLT\n.L2:\n\tpop rbp\n\tret\n"),
    ("c/dice.ll.c", "define i32 @roll(i32 %n) {\n  %1 = call i32 @rand()\n  %2 = srem i32 %1, %n\n  call i32 @printf(i32 %2)\n  ret i32 %2\n}\n"),
    ("c/arm.c", "\t.text\nadd_up:\n\tstp x29, x30, [sp, #-16]!\n\tldr w0, [x1, x2, lsl #2]\n\tcbz w0, .Lend\n\tadd x3, x0, #300\n\tbl puts\n.Lend:\n\tret\n"),
    ("java/Dice.java", "import java.util.Random;\nclass Dice {\n  int roll(int n) {\n    int r = new Random().nextInt(n);\n    System.out.println(\"r\" + r);\n    return r;\n  }\n}\n"),
    ("java/Listed.java", "Compiled from \"Listed.java\"\nclass Listed {\n  void f();\n    Code:\n       0: getstatic     #7\n       3: invokevirtual #13                 // Method java/io/PrintStream.println:(I)V\n       6: return\n}\n"),
]


def source_tree(spark: SparkSession) -> str:
    """The programs as files under a shared folder of this run, written by the executors."""
    root = f"{shared_dir(spark)}/programs-{uuid.uuid4().hex}"
    one = spark.createDataFrame(PROGRAMS, "program string, code string")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(root)
        for t in batches:
            for name, text in zip(t.program, t.code):
                fs.create_dir(f"{base}/{name.rpartition('/')[0]}", recursive=True)
                with fs.open_output_stream(f"{base}/{name}") as out:
                    out.write(text.encode())
            yield t[["program"]]

    one.mapInPandas(write, "program string").write.format("noop").mode("overwrite").save()
    return root


def programs(spark: SparkSession) -> DataFrame:
    """The programs as a scan finds them, named by their place under the tree."""
    root = source_tree(spark)
    return code.scan(spark, root).withColumn("program", F.regexp_extract("program", "/programs-[0-9a-f]+/(.*)$", 1))


def built(spark: SparkSession, backend: str = "auto") -> tuple[parsed.Tables, DataFrame, DataFrame]:
    return stages.built(spark, programs(spark), backend=backend)


@query()
def code_parse_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = code.parse_functions(programs(spark))
    return found.select("program", "func_idx", "name", "first_line", F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges"), F.size("tokens").alias("n_tokens"), "error")


@query()
def code_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.bundled_rules(spark).select("rule_id", "kind", "pattern", *(F.concat_ws(",", c).alias(c) for c in ("reads", "writes", "flags")))


@query()
def code_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of all functions with those of their resources."""
    return built(spark)[0].nodes.select("func_id", "nid", "kind", "line", *(F.concat_ws(",", c).alias(c) for c in ("reads", "writes", "calls")))


@query()
def code_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow, data, control, effect, dfg and ast edges, the last two lent where a function has none."""
    return parsed.enrich_views(built(spark)[0].edges)


@query()
def code_effect_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark)[1].withColumn("flags", F.concat_ws(",", "flags"))


@query()
def code_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each function: opcodes of Python, lexemes of C and Java, normalised instructions of listings."""
    return built(spark)[0].functions.select("func_id", F.posexplode("tokens").alias("at", "token"))


@query()
def code_bytecode_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow, data and control edges between the blocks of compiled Python functions."""
    found = parsed.long_tables(materialised(code.parse_functions(programs(spark).where("language = 'python'"), "bytecode"), "parsed"))
    return found.edges


@query()
def code_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph_json.summaries(built(spark)[0].nodes)
    return found.select("func_id", F.concat_ws(",", "called_funcs").alias("called_funcs"), F.concat_ws(",", "modules").alias("modules"), F.explode("op_category_counts").alias("kind", "n"))


@query()
def code_structural_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = built(spark)[0]
    return parsed.structural_vectors(t.functions, t.nodes, t.edges).select("func_id", F.posexplode("v").alias("at", "x"))


@query()
def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = built(spark)[0]
    return parsed.blocks(t.nodes, t.edges).select("func_id", "block", F.size("nids").alias("n_nodes"), "line_min", "line_max")


@query()
def code_graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions as they come back from written graph documents."""
    root = f"{shared_dir(spark)}/graphs-{uuid.uuid4().hex}"
    graph_json.write_graphs(graph_json.documents(*built(spark)), root)
    graphs = graph_json.read_graphs(spark, root)
    return graph_json.spans(graphs).select("id", "file", "name", "start_line", "end_line", F.size("tokens").alias("n_tokens"), F.concat_ws(",", "effect_flags").alias("flags"))


def _index(spark: SparkSession) -> engine.Index:
    t, signed, _ = built(spark)
    return engine.build_index(t, signed)


@query()
def code_index_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of both views with more than one function."""
    b = _index(spark).buckets.groupBy("view", "band", "bucket").agg(F.count("*").alias("size"))
    return b.where("size > 1").groupBy("view", "band", "size").agg(F.count("*").alias("n_buckets"))


@query()
def code_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cands = engine.candidates(_index(spark))
    return cands.select(F.col("meta_i.id").alias("i"), F.col("meta_j.id").alias("j"), F.round("lsh_sim", 6).alias("lsh_sim"), F.col("meta_i.neighbor_degree").alias("degree_i"), F.col("meta_j.neighbor_degree").alias("degree_j"))


@query()
def code_program_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = materialised(engine.function_pairs(engine.candidates(_index(spark)), 0.3), "function-pairs")
    return engine.program_pairs(pairs).select("prog_a", "prog_b", F.round("base", 6).alias("base"), F.round("score", 6).alias("score"), F.size("matches").alias("n_matches"))


@query()
def code_all_vs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, signed, _ = built(spark)
    return engine.all_vs_all(t.functions, signed)[1].withColumn("score", F.round("score", 6))


@query()
def code_template_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, signed, _ = built(spark)
    v = parsed.semantic_vectors(parsed.structural_vectors(t.functions, t.nodes, t.edges))
    found = engine.clusters(t.functions, v, signed, parsed.graph_shingles(t.nodes, t.edges), t.nodes, stages.with_options(min_cluster_size=2))
    return found.select("cluster_id", "size", "exemplar", F.round("mean_node_size", 6).alias("mean_node_size"), F.round("mean_intra_distance", 6).alias("mean_distance"), "distinct_files", "is_template_like")


@query()
def code_effect_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark)[1].select("func_id", F.concat_ws(",", parsed.effect_bag()).alias("bag"), F.round(C.norm(C.l2_normalised(E.effect_vector())), 6).alias("norm"))


@query()
def code_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline over folders: graphs, enriched graphs, index, candidates, clusters, ranking and page."""
    pairs = stages.pipeline(spark, source_tree(spark), f"{shared_dir(spark)}/code-{uuid.uuid4().hex}", threshold=0.3, with_clusters=True)
    place = lambda c: F.regexp_extract(c, "/programs-[0-9a-f]+/(.*)$", 1).alias(c)
    return pairs.select(place("prog_a"), place("prog_b"), F.round("base", 6).alias("base"), F.round("score", 6).alias("score"), F.size("matches").alias("n_matches"))


@query()
def code_end_to_end_bytecode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same stages over compiled Python."""
    work = f"{shared_dir(spark)}/code-{uuid.uuid4().hex}"
    stages.build_graphs(spark, source_tree(spark), f"{work}/graphs", lang="python", backend="bytecode")
    stages.build_index(spark, f"{work}/graphs", f"{work}/index")
    stages.find_candidates(spark, f"{work}/index", f"{work}/candidates")
    pairs = stages.rank(spark, f"{work}/candidates", f"{work}/program_pairs", threshold=0.3)
    place = lambda c: F.regexp_extract(c, "/programs-[0-9a-f]+/(.*)$", 1).alias(c)
    return pairs.select(place("prog_a"), place("prog_b"), F.round("base", 6).alias("base"), F.round("score", 6).alias("score"), F.size("matches").alias("n_matches"))

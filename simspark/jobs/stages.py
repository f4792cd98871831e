"""Stages over folders: each reads what the one before has written. A folder is a path that all machines share."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simspark.operators import effects as E
from simspark.operators import engine, parsed
from simspark.operators.graphs import materialised
from simspark.params import DEFAULT, Params
from simspark.plans import report
from simspark.sources import code, graph_json, rules


def built(spark: SparkSession, programs: DataFrame, rule_rows: DataFrame | None = None, backend: str = "auto", normalise_builtins: bool = False) -> tuple[parsed.Tables, DataFrame, DataFrame]:
    """(tables with resource nodes and effect edges, effect signatures, raw effects) of programs (program, code, language)."""
    found = parsed.long_tables(materialised(code.parse_functions(programs, backend), "parsed"))
    raw = materialised(parsed.raw_effects(found.nodes, rules.bundled_rules(spark) if rule_rows is None else rule_rows, normalise_builtins), "raw-effects")
    nodes, effect_edges = parsed.effect_nodes(found.nodes, raw)
    tables = parsed.Tables(found.functions, nodes, found.edges.unionByName(effect_edges))
    return tables, parsed.signatures(found.functions, raw), raw


def build_graphs(spark: SparkSession, source: str, out: str, rules_path: str | None = None, lang: str = "auto", backend: str = "auto", normalise_builtins: bool = False) -> None:
    rule_rows = rules.read_rules(spark, rules_path) if rules_path else None
    graph_json.write_graphs(graph_json.documents(*built(spark, code.scan(spark, source, lang), rule_rows, backend, normalise_builtins)), out)


def enrich(spark: SparkSession, root: str, out: str) -> None:
    graph_json.write_enriched(spark, root, out)


def read_signatures(graphs: DataFrame) -> DataFrame:
    count = lambda c: F.coalesce(F.try_element_at("effect_signature.counts", F.lit(c)), F.lit(0.0)).cast("long").alias(c)
    return graphs.select(F.col("id").alias("func_id"), *map(count, E.COUNTERS), F.coalesce("effect_signature.flags", F.array().cast("array<string>")).alias("flags"))


def build_index(spark: SparkSession, root: str, out: str, params: Params = DEFAULT) -> None:
    graphs = graph_json.read_graphs(spark, root)
    engine.save_index(engine.build_index(graph_json.tables(graphs), read_signatures(graphs), params), out)


def find_candidates(spark: SparkSession, index: str, out: str, params: Params = DEFAULT) -> None:
    cands = engine.candidates(engine.load_index(spark, index), params)
    graph_json.write_candidates(cands, out, topk_recall=params.topk_recall, min_candidates=params.min_candidates, min_tokens=params.min_tokens, template_degree_soft=params.template_degree_soft, template_degree_hard=params.template_degree_hard)


def rank(spark: SparkSession, candidates: str, out: str, clusters: str | None = None, threshold: float = DEFAULT.threshold, params: Params = DEFAULT) -> DataFrame:
    """Program pairs, written and read again; members of template clusters count for less where clusters are given."""
    weights = engine.template_weights(graph_json.read_clusters(spark, clusters, templates=True)) if clusters else None
    pairs = materialised(engine.function_pairs(graph_json.read_candidates(spark, candidates), threshold, weights), "function-pairs")
    found = engine.program_pairs(pairs, params)
    graph_json.write_program_pairs(found, out, threshold=threshold, min_coverage=params.min_coverage)
    return spark.read.schema(found.schema).json(f"{out}/rows")


def all_vs_all(spark: SparkSession, root: str, out: str, source: str | None = None, params: Params = DEFAULT) -> DataFrame:
    graphs = graph_json.read_graphs(spark, root)
    matches, pairs = engine.all_vs_all(graph_json.tables(graphs).functions, read_signatures(graphs), params)
    nested = matches.groupBy("prog_a", "prog_b").agg(F.sort_array(F.collect_list(F.struct("score", "fa", "fb")), asc=False).alias("m"))
    pairs = pairs.join(nested, ["prog_a", "prog_b"]).select("prog_a", "prog_b", "score", "n_matches", F.transform("m", lambda x: F.struct(x.fa.alias("fa"), x.fb.alias("fb"), x.score.alias("score"))).alias("matches"))
    sources = code.scan(spark, source) if source else None
    graph_json.write_all_vs_all(pairs, graph_json.programs(spark, graph_json.read_documents(spark, root), sources), graph_json.effect_keys(graphs), out, alpha=params.alpha, prog_threshold=params.prog_threshold, func_threshold=params.func_threshold, topk_pairs=params.topk_pairs)
    return spark.read.schema(pairs.schema).json(f"{out}/rows")


def cluster(spark: SparkSession, root: str, out: str, lang: str = "auto", max_funcs: int = 0, method: str = "hdbscan", params: Params = DEFAULT, vectors: DataFrame | None = None) -> None:
    """vectors (func_id, v): those of an encoder, which stand in for the structural ones."""
    graphs = materialised(graph_json.cluster_functions(graph_json.read_graphs(spark, root), lang, max_funcs), "cluster-functions")
    t = graph_json.tables(graphs)
    own = parsed.semantic_vectors(parsed.structural_vectors(t.functions, t.nodes, t.edges), vectors)
    found = engine.clusters(t.functions, own, read_signatures(graphs), parsed.graph_shingles(t.nodes, t.edges), t.nodes, params, 0, method)
    graph_json.write_clusters(found, out, lang=lang, max_funcs=max_funcs, min_cluster_size=params.min_cluster_size, epsilon=params.epsilon)


def write_page(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def pair_page(spark: SparkSession, pairs: DataFrame, root: str, source: str, out: str, threshold: float = 0.0) -> None:
    graphs = graph_json.read_graphs(spark, root)
    t = graph_json.tables(graphs)
    places = graph_json.spans(graphs).select(F.col("id").alias("func_id"), "name", "start_line", "end_line")
    write_page(spark, out, report.pair_report(pairs, places, code.scan(spark, source), threshold=threshold, nodes=t.nodes, edges=t.edges, blocks=parsed.blocks(t.nodes, t.edges)))


def pipeline(spark: SparkSession, source: str, work: str, backend: str = "auto", rules_path: str | None = None, threshold: float = 0.5, with_clusters: bool = False, params: Params = DEFAULT, normalise_builtins: bool = False) -> DataFrame:
    """From sources to program pairs and a page: graphs, enriched graphs, index, candidates, clusters if asked, ranking."""
    build_graphs(spark, source, f"{work}/graphs", rules_path, backend=backend, normalise_builtins=normalise_builtins)
    enrich(spark, f"{work}/graphs", f"{work}/graphs_mv")
    build_index(spark, f"{work}/graphs_mv", f"{work}/index", params)
    find_candidates(spark, f"{work}/index", f"{work}/candidates", params)
    if with_clusters:
        cluster(spark, f"{work}/graphs_mv", f"{work}/clusters", params=params)
    pairs = rank(spark, f"{work}/candidates", f"{work}/program_pairs", f"{work}/clusters" if with_clusters else None, threshold, params)
    pair_page(spark, pairs, f"{work}/graphs_mv", source, f"{work}/report")
    return pairs


def with_options(params: Params = DEFAULT, **options: object) -> Params:
    return replace(params, **{k: v for k, v in options.items() if v is not None and k in Params.__dataclass_fields__})

"""Graph documents as JSON: one for each program, functions nested in it; and the JSON files of the later stages."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simspark.functions.columns import basename, language
from simspark.operators.parsed import Tables

NODE = "struct<nid:int,kind:string,lineno:int,reads:array<string>,writes:array<string>,calls:array<string>>"
SIGNATURE = "struct<counts:map<string,double>,flags:array<string>>"
FUNCTION = f"struct<id:string,name:string,first_lineno:int,nodes:array<{NODE}>,cfg:struct<edges:array<array<int>>>,pdg:struct<data_edges:array<array<string>>,control_edges:array<array<string>>,effect_edges:array<array<int>>,effect_raw:array<array<string>>>,dfg_edges:array<array<int>>,ast_edges:array<array<int>>,effect_signature:{SIGNATURE},tokens_norm:array<string>,called_funcs:array<string>,modules:array<string>,op_category_counts:map<string,bigint>>"
SCHEMA = f"file string, source_path string, source_file string, py_version string, functions array<{FUNCTION}>, _corrupt_record string"
META = "struct<id:string,program:string,func_idx:int,name:string,first_lineno:int,token_len:int,neighbor_degree:bigint,is_template_like:boolean,flags:array<string>>"
CANDIDATES = f"lsh_sim double, meta_i {META}, meta_j {META}"
CLUSTERS = "cluster_id int, size int, members array<string>, exemplar string, mean_node_size double, mean_intra_distance double, distinct_files int, is_template_like boolean"


def or_default(value: Column, default: Column) -> Column:
    """The default for null and empty text. Never for ids, where 0 is a value."""
    return F.coalesce(F.nullif(value, F.lit("")), default)


def one_a_line(spark: SparkSession, root: str) -> bool:
    """Documents stand one a line, as write_graphs writes them, and not one a file over many lines."""
    first = spark.read.option("recursiveFileLookup", True).text(root).where("value <> ''").first()
    try:
        return first is not None and isinstance(json.loads(first.value), dict)
    except ValueError:
        return False


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, file, py_version, functions): broken files are left out. file: the source that a document names, else its own path."""
    docs = spark.read.schema(SCHEMA).option("multiLine", not one_a_line(spark, root)).option("recursiveFileLookup", True).json(root).withColumn("path", F.input_file_name())
    source = or_default(F.col("source_path"), or_default(F.col("source_file"), or_default(F.col("file"), F.col("path"))))
    return docs.where("_corrupt_record is null").select("path", source.alias("file"), "py_version", "functions")


def read_graphs(spark: SparkSession, root: str) -> DataFrame:
    """(path, file, func_idx, id, name, first_lineno, nodes, ...): one row for each function; of equal ids the last path wins."""
    rows = read_documents(spark, root).select("path", "file", F.posexplode("functions").alias("func_idx", "f")).select("path", "file", "func_idx", "f.*")
    named = rows.withColumn("id", or_default(F.col("id"), F.concat_ws("", "file", F.lit("::"), "name", F.lit("@"), "first_lineno")))
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("path"), F.desc("func_idx")))
    return named.withColumn("__r", last).where("__r = 1").drop("__r")


def locations(graphs: DataFrame) -> DataFrame:
    """(id, path, func_idx, name, first_lineno, effect_signature); -1 for a line that isn't known."""
    return graphs.select("id", "path", "func_idx", "name", F.coalesce("first_lineno", F.lit(-1)).alias("first_lineno"), "effect_signature")


def edges(graphs: DataFrame) -> DataFrame:
    """(id, view, src, dst, label) of all views; ids of nodes may be 0."""
    pick = lambda view, column, label: graphs.select("id", F.lit(view).alias("view"), F.explode(column).alias("e")).select("id", "view", F.try_element_at("e", F.lit(1)).cast("int").alias("src"), F.try_element_at("e", F.lit(2)).cast("int").alias("dst"), (F.try_element_at("e", F.lit(3)).cast("string") if label else F.lit(None).cast("string")).alias("label"))
    views = [("cfg", "cfg.edges", False), ("data", "pdg.data_edges", True), ("control", "pdg.control_edges", True), ("effect", "pdg.effect_edges", False), ("dfg", "dfg_edges", False), ("ast", "ast_edges", False)]
    out = pick(*views[0])
    for v in views[1:]:
        out = out.unionByName(pick(*v))
    return out.where("src is not null and dst is not null")


def tables(graphs: DataFrame) -> Tables:
    """The engine's long tables of functions that were read."""
    last = F.array_max(F.transform("nodes", lambda n: n.lineno))
    functions = graphs.select(F.col("id").alias("func_id"), F.col("file").alias("program"), "func_idx", "name", F.col("first_lineno").alias("first_line"), F.coalesce(last, "first_lineno").alias("last_line"), F.coalesce("tokens_norm", F.array().cast("array<string>")).alias("tokens"))
    nodes = graphs.select(F.col("id").alias("func_id"), F.explode("nodes").alias("x")).select("func_id", "x.nid", "x.kind", F.col("x.lineno").alias("line"), "x.reads", "x.writes", "x.calls")
    return Tables(functions, nodes, edges(graphs).select(F.col("id").alias("func_id"), "view", "src", "dst", F.coalesce("label", F.lit("")).alias("label")))


def summaries(nodes: DataFrame) -> DataFrame:
    """(func_id, called_funcs, modules, op_category_counts): what a function calls, of which modules, and how often each kind of node comes."""
    calls = nodes.select("func_id", F.explode_outer("calls").alias("c"))
    module = F.when(F.col("c").contains("."), F.substring_index("c", ".", 1))
    called = calls.groupBy("func_id").agg(F.sort_array(F.collect_set("c")).alias("called_funcs"), F.sort_array(F.collect_set(module)).alias("modules"))
    kinds = nodes.groupBy("func_id", "kind").agg(F.count("*").alias("n")).groupBy("func_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("op_category_counts"))
    return called.join(kinds, "func_id")


def documents(t: Tables, signatures: DataFrame, raw: DataFrame, py_version: str = "3") -> DataFrame:
    """(file, py_version, functions) of long tables, ready to be written as JSON."""
    from simspark.operators.effects import COUNTERS

    nodes = t.nodes.groupBy("func_id").agg(F.sort_array(F.collect_list(F.struct("nid", "kind", F.col("line").alias("lineno"), "reads", "writes", "calls"))).alias("nodes"))
    pair, triple = F.array("src", "dst"), F.array(F.col("src").cast("string"), F.col("dst").cast("string"), "label")
    of = lambda view, e: F.sort_array(F.collect_list(F.when(F.col("view") == view, e)))
    linked = t.edges.groupBy("func_id").agg(of("cfg", pair).alias("cfg"), of("data", triple).alias("data"), of("control", triple).alias("control"), of("effect", pair).alias("effect"), of("dfg", pair).alias("dfg_edges"), of("ast", pair).alias("ast_edges"))
    text = raw.groupBy("func_id").agg(F.sort_array(F.collect_list(F.struct("nid", "part", "pos", "i", "resource", "tag"))).alias("raw")).select("func_id", F.transform("raw", lambda x: F.array(x.nid.cast("string"), x.resource, x.tag)).alias("effect_raw"))
    counts = F.create_map(*(x for c in COUNTERS for x in (F.lit(c), F.col(c).cast("double"))))
    signed = signatures.select("func_id", F.struct(counts.alias("counts"), "flags").alias("effect_signature"))
    rows = t.functions
    for part in (nodes, linked, text, signed, summaries(t.nodes)):
        rows = rows.join(part, "func_id", "left")
    pdg = F.struct(F.col("data").alias("data_edges"), F.col("control").alias("control_edges"), F.col("effect").alias("effect_edges"), "effect_raw").alias("pdg")
    function = F.struct("func_idx", F.col("func_id").alias("id"), "name", F.col("first_line").alias("first_lineno"), "nodes", F.struct(F.col("cfg").alias("edges")).alias("cfg"), pdg, "dfg_edges", "ast_edges", "effect_signature", F.col("tokens").alias("tokens_norm"), "called_funcs", "modules", "op_category_counts")
    return rows.groupBy(F.col("program").alias("file")).agg(F.lit(py_version).alias("py_version"), F.array_sort(F.collect_list(function), lambda a, b: a.func_idx - b.func_idx).alias("functions"))


def write_graphs(graphs: DataFrame, path: str) -> None:
    graphs.write.mode("overwrite").json(path)


def write_enriched(spark: SparkSession, root: str, out: str) -> None:
    """Documents again, with dfg and ast edges lent from data and control edges where a function has none."""
    ends = lambda es: F.transform(es, lambda e: F.array(e[0].cast("int"), e[1].cast("int")))
    given = lambda f, own, lent: F.when(F.size(F.coalesce(f[own], F.array())) > 0, f[own]).otherwise(ends(f["pdg"][lent])).alias(own)
    lent = {"dfg_edges": "data_edges", "ast_edges": "control_edges"}
    names = [f.name for f in spark.createDataFrame([], SCHEMA).schema["functions"].dataType.elementType]
    enriched = F.transform("functions", lambda f: F.struct(*(given(f, n, lent[n]) if n in lent else f[n].alias(n) for n in names)))
    read_documents(spark, root).select("file", "py_version", enriched.alias("functions")).write.mode("overwrite").json(out)


# All-vs-all scan, sources and places


def report_language(path: Column) -> Column:
    found = language(path)
    return F.when(found.isin("c", "cpp"), "c/cpp").otherwise(F.coalesce(found, F.lit("unknown")))


def programs(spark: SparkSession, docs: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(prog_id, file, language, code): numbered in the order of their first document; no text where the source isn't there. sources (program, code)."""
    first = docs.groupBy("file").agg(F.min("path").alias("path"))
    # one number for each program in order of path; programs are far fewer than functions, and the window holds two texts of each
    rows = first.withColumn("prog_id", F.row_number().over(Window.orderBy("path", "file")) - 1)
    code = sources.select(F.col("program").alias("file"), "code") if sources is not None else spark.createDataFrame([], "file string, code string")
    return rows.join(code, "file", "left").select("prog_id", "file", report_language(F.col("file")).alias("language"), F.coalesce("code", F.lit("")).alias("code"))


def spans(graphs: DataFrame) -> DataFrame:
    """(id, file, name, start_line, end_line, tokens, effect_counts, effect_flags): lines of a function's nodes, its first line without any."""
    known = F.filter(F.transform("nodes", lambda n: n.lineno), lambda x: x > 0)
    first = F.coalesce("first_lineno", F.lit(1))
    return graphs.select("id", "file", "name", F.coalesce(F.array_min(known), first).alias("start_line"), F.coalesce(F.array_max(known), first).alias("end_line"), F.array_distinct(F.coalesce("tokens_norm", F.array().cast("array<string>"))).alias("tokens"), F.col("effect_signature.counts").alias("effect_counts"), F.coalesce("effect_signature.flags", F.array().cast("array<string>")).alias("effect_flags"))


def effect_keys(graphs: DataFrame) -> DataFrame:
    """(key): the effect counters that any function has, in order."""
    return graphs.select(F.explode(F.map_keys("effect_signature.counts")).alias("key")).distinct().orderBy("key")


def cluster_functions(graphs: DataFrame, lang: str = "auto", max_funcs: int = 0) -> DataFrame:
    """The functions that a clustering takes: of one language if asked, the first max_funcs by path if that isn't 0."""
    rows = graphs if lang == "auto" else graphs.where(F.coalesce(language(F.col("file")), F.lit("unknown")) == lang)
    rows = rows.orderBy("path", "func_idx")
    return rows.limit(max_funcs) if max_funcs else rows


def by_basename(graphs: DataFrame) -> DataFrame:
    """graphs with the name of the file that they are looked up by; files of one name in different folders are looked up together."""
    return graphs.withColumn("base", basename(F.col("file")))


def source_lines(functions: DataFrame, sources: DataFrame) -> DataFrame:
    """functions (program, ...) with the lines of their program, or one line that says it isn't there. sources (program, code)."""
    missing = F.array(F.concat(F.lit("# source not found: "), F.col("program")))
    return functions.join(sources.select("program", "code"), "program", "left").withColumn("lines", F.when(F.col("code").isNull(), missing).otherwise(F.split("code", "\n"))).drop("code")


def function_label(name: Column, line: Column) -> Column:
    return F.when(line > 0, F.format_string("%s @L%d", F.coalesce(name, F.lit("<anon>")), line)).otherwise(F.coalesce(name, F.lit("<anon>")))


# Files of the later stages: rows in one folder, what they were made with in another


def _write(rows: DataFrame, path: str, **meta: object) -> None:
    """rows as JSON, and one row of their number and the parameters beside them."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    spark = rows.sparkSession
    count = spark.read.schema(rows.schema).json(f"{path}/rows").agg(F.count("*").alias("num_rows"))
    count.select("num_rows", *(F.lit(v).alias(k) for k, v in meta.items())).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def write_candidates(pairs: DataFrame, path: str, **params: object) -> None:
    _write(pairs, path, built_by="candidates", **params)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CANDIDATES).json(f"{path}/rows")


def write_program_pairs(pairs: DataFrame, path: str, **params: object) -> None:
    """pairs (prog_a, prog_b, score, matches), the best first."""
    _write(pairs.orderBy(F.desc("score"), "prog_a", "prog_b"), path, built_by="program pairs", **params)


def write_all_vs_all(pairs: DataFrame, found: DataFrame, keys: DataFrame, path: str, **params: object) -> None:
    """Program pairs, the programs with their code, and the effect counters."""
    _write(pairs.orderBy(F.desc("score"), "prog_a", "prog_b"), path, built_by="all vs all", **params)
    found.orderBy("prog_id").write.mode("overwrite").json(f"{path}/programs")
    keys.coalesce(1).write.mode("overwrite").json(f"{path}/effect_keys")


def write_clusters(found: DataFrame, path: str, **params: object) -> None:
    _write(found.orderBy("cluster_id"), path, built_by="clusters", **params)


def read_clusters(spark: SparkSession, path: str, templates: bool = False) -> DataFrame:
    rows = spark.read.schema(CLUSTERS).json(f"{path}/rows")
    return rows.where("is_template_like") if templates else rows

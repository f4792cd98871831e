"""Long tables of parsed functions: nodes, edges, effects, resource nodes, bags and structural vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simspark.functions import columns as C
from simspark.operators import effects as E
from simspark.operators import fingerprints


@dataclass(frozen=True)
class Tables:
    """functions (func_id, program, func_idx, name, first_line, last_line, tokens), nodes (func_id, nid, kind, line, reads, writes, calls),
    edges (func_id, view, src, dst, label)."""

    functions: DataFrame
    nodes: DataFrame
    edges: DataFrame


def function_id(program: Column, name: Column, first_line: Column) -> Column:
    return F.concat(program, F.lit("::"), name, F.lit("@"), first_line.cast("string"))


def long_tables(parsed: DataFrame) -> Tables:
    """parsed: rows of sources.code.SCHEMA; save them first if they come from a front end, as all three tables read them."""
    rows = parsed.where("error is null").withColumn("func_id", function_id(F.col("program"), F.col("name"), F.col("first_line")))
    functions = rows.select("func_id", "program", "func_idx", "name", "first_line", "last_line", "tokens")
    nodes = rows.select("func_id", F.explode("nodes").alias("x")).select("func_id", "x.*")
    edges = rows.select("func_id", F.explode("edges").alias("x")).select("func_id", "x.*")
    return Tables(functions, nodes, edges)


def raw_effects(nodes: DataFrame, rules: DataFrame, normalise_builtins: bool = False) -> DataFrame:
    """(func_id, nid, part, pos, i, resource, tag): what the calls of each node read (part 0), write (1) and flag (2).

    Calls without a rule take the default rule; in LLVM listings they have no effect, in compiled Python they may write the heap and
    raise. An assembly call is its node's only one. A flag holds if the node's last call that states it says so; on lines of C and Java,
    if any call says so. normalise_builtins: print, input and open are the builtins, where the published rules don't match bare names.
    """
    calls = nodes.select("func_id", "nid", "kind", F.posexplode("calls").alias("pos", "call"))
    calls = calls.where(~F.col("kind").startswith("asm::") | (F.col("pos") == 0))
    if normalise_builtins:
        bare = rules.where("kind = 'fqname' and startswith(pattern, 'builtins.')").select(F.substring_index("pattern", ".", -1).alias("call"), F.col("pattern").alias("full"))
        calls = calls.join(F.broadcast(E.small(bare)), "call", "left").withColumn("call", F.coalesce("full", "call")).drop("full")
    known = rules.select("rule_id", F.col("kind").alias("rule_kind"), "reads", "writes", "flags", "unset")
    found = E.match_rules(calls, rules).join(F.broadcast(E.small(known)), "rule_id", "left")
    default, compiled = F.col("rule_kind") == "default", F.col("kind") == "BasicBlock"
    found = found.where(~(default & F.col("kind").startswith("llvm::")))
    none = F.array().cast("array<string>")
    found = found.withColumns({
        "reads": F.when(default & compiled, none).otherwise(F.col("reads")),
        "writes": F.when(default & compiled, F.array(F.lit("HEAP[?]"))).otherwise(F.col("writes")),
        "flags": F.when(default & compiled, F.array(F.lit("exception"))).otherwise(F.col("flags")),
        "unset": F.when(default & compiled, none).otherwise(F.col("unset")),
    })
    item = lambda part, column, tag: found.select("func_id", "nid", F.lit(part).alias("part"), "pos", F.posexplode(column).alias("i", "resource"), F.lit(tag).alias("tag"))
    on = F.transform("flags", lambda f: F.struct(f.alias("flag"), F.lit(True).alias("on")))
    off = F.transform("unset", lambda f: F.struct(f.alias("flag"), F.lit(False).alias("on")))
    flags = found.select("func_id", "nid", "kind", "pos", F.explode(F.concat(on, off)).alias("f")).groupBy("func_id", "nid", "kind", F.col("f.flag").alias("flag"))
    flags = flags.agg(F.max(F.when(F.col("f.on"), F.col("pos"))).alias("on"), F.max(F.when(~F.col("f.on"), F.col("pos"))).alias("off"))
    any_ = F.col("kind") == "Line"
    holds = F.col("on").isNotNull() & (any_ | (F.col("on") > F.coalesce("off", F.lit(-1))))
    flagged = flags.where(holds).select("func_id", "nid", F.lit(2).alias("part"), F.col("on").alias("pos"), F.lit(0).alias("i"), F.concat(F.lit("FLAG:"), "flag").alias("resource"), F.lit("FLAG").alias("tag"))
    return item(0, "reads", "READ").unionByName(item(1, "writes", "WRITE")).unionByName(flagged)


def signatures(functions: DataFrame, raw: DataFrame) -> DataFrame:
    """One row of counters and flags for each function, those without effects included."""
    found = functions.select("func_id").join(E.signatures(raw, "func_id"), "func_id", "left")
    return found.select("func_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in E.COUNTERS), F.coalesce("flags", F.array().cast("array<string>")).alias("flags"))


def effect_nodes(nodes: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with resource nodes, effect edges): a node for each kind of resource and tag, numbered behind a function's own in the order
    in which they are first met."""
    kinds = raw.withColumn("kind", E.resource_kind())
    first = kinds.groupBy("func_id", "kind").agg(F.min(F.struct("nid", "part", "pos", "i", "resource")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("func_id").orderBy("first"))
    top = nodes.groupBy("func_id").agg(F.max("nid").alias("top"))
    numbered = first.withColumn("r", rank).join(top, "func_id").select("func_id", "kind", (F.col("top") + F.col("r")).cast("int").alias("dst"))
    none = F.array().cast("array<string>")
    own = numbered.select("func_id", F.col("dst").alias("nid"), "kind", F.lit(0).alias("line"), none.alias("reads"), none.alias("writes"), none.alias("calls"))
    edges = kinds.select("func_id", "nid", "kind").distinct().join(numbered, ["func_id", "kind"]).select("func_id", F.lit("effect").alias("view"), F.col("nid").alias("src"), "dst", F.lit("").alias("label"))
    return nodes.unionByName(own), edges


def enrich_views(edges: DataFrame) -> DataFrame:
    """Functions without dfg edges get those of their data edges, functions without ast edges those of their control edges."""
    out = edges
    for view, source in (("dfg", "data"), ("ast", "control")):
        have = edges.where(F.col("view") == view).select("func_id").distinct()
        lent = edges.where(F.col("view") == source).join(have, "func_id", "left_anti")
        out = out.unionByName(lent.select("func_id", F.lit(view).alias("view"), "src", "dst", F.lit("").alias("label")).distinct())
    return out


def graph_shingles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(func_id, shingles): neighbourhood labels and paths over data, control and effect edges."""
    ns = nodes.select(F.col("func_id").alias("g"), F.col("nid").alias("n"), "kind")
    es = edges.where(F.col("view").isin("data", "control", "effect")).select(F.col("func_id").alias("g"), "src", "dst")
    adj = fingerprints.adjacency(ns, es)
    both = fingerprints.wl_labels(ns, adj).select("g", F.col("label").alias("s")).unionByName(fingerprints.kpath_shingles(ns, adj).select("g", F.col("path").alias("s")))
    return both.groupBy("g").agg(F.sort_array(F.collect_set("s")).alias("shingles")).withColumnRenamed("g", "func_id")


def effect_bag() -> Column:
    """The counters of a signature that aren't 0."""
    return F.array_compact(F.array(*(F.when(F.col(c) > 0, F.lit(c)) for c in E.COUNTERS)))


#: The order of the counters in a structural vector.
VECTOR_COUNTERS = ["FILE_IO", "NET_IO", "DB_IO", "ENV", "RNG", "TIME", "EXC", "R_GLOBAL", "W_GLOBAL", "R_HEAP", "W_HEAP", "R_STACK", "W_STACK"]


def structural_vectors(functions: DataFrame, nodes: DataFrame, edges: DataFrame, counters: DataFrame | None = None) -> DataFrame:
    """(func_id, v): 20 numbers of length one: nodes, edges of three views, 13 counters, and mean, deviation and maximum of degrees.

    The published vectors have 0 for all counters, as they look for flags of other names; with `counters` (a signature) they are filled.
    """
    sizes = nodes.groupBy("func_id").agg(F.count("*").alias("nodes"))
    flow = edges.where(F.col("view").isin("cfg", "data", "control"))
    views = flow.groupBy("func_id").agg(*(F.count(F.when(F.col("view") == v, 1)).alias(v) for v in ("cfg", "data", "control")))
    ends = flow.select("func_id", F.explode(F.array("src", "dst")).alias("n")).groupBy("func_id", "n").agg(F.count("*").alias("d"))
    degrees = ends.groupBy("func_id").agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.max("d").alias("max"))
    rows = functions.select("func_id").join(sizes, "func_id", "left").join(views, "func_id", "left").join(degrees, "func_id", "left")
    counts = [F.lit(0.0)] * len(VECTOR_COUNTERS)
    if counters is not None:
        rows, counts = rows.join(counters, "func_id", "left"), [F.col(c) for c in VECTOR_COUNTERS]
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    values = [*(F.col(c) for c in ("nodes", "cfg", "data", "control")), *counts, *(F.col(c) for c in ("mean", "std", "max"))]
    v = rows.select("func_id", F.array(*map(number, values)).alias("v"))
    return v.select("func_id", F.transform("v", lambda x: x / (C.norm(F.col("v")) + 1e-8)).alias("v"))


def semantic_vectors(fallback: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(func_id, v): vectors of an encoder, where there are any that aren't empty, else the structural ones. given (func_id, v)."""
    if given is None:
        return fallback
    own = given.where(F.size("v") > 0).select("func_id", C.l2_normalised(F.col("v").cast("array<double>")).alias("own"))
    return fallback.join(own, "func_id", "left").select("func_id", F.coalesce("own", "v").alias("v"))


def blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(func_id, block, nids, line_min, line_max): nodes that flow, data and control edges connect, numbered by their first line.

    A function without edges is one block. Functions are small, so each is solved as one row.
    """
    from simspark.operators.graphs import per_graph, small_components

    def solve(ns: list[dict], es: list[tuple[int, int]]):
        ids, line = [x["n"] for x in ns], {x["n"]: x["line"] for x in ns}
        links = [(a, b) for a, b in es if a != b]
        groups = small_components(sorted({*ids, *(x for e in links for x in e)}), links) if links else [sorted(ids)]
        spans = []
        for k, group in enumerate(groups):
            known = [line[n] for n in group if line.get(n)]
            spans.append((min(known, default=0), k, group, max(known, default=0)))
        for i, (low, _, group, high) in enumerate(sorted(spans, key=lambda s: s[:2])):
            yield i, group, low, high

    ns = nodes.select(F.col("func_id").alias("g"), F.col("nid").alias("n"), "line")
    es = edges.where(F.col("view").isin("cfg", "data", "control")).select(F.col("func_id").alias("g"), "src", "dst")
    return per_graph(ns, es, solve, "g string, block int, nids array<int>, line_min int, line_max int").withColumnRenamed("g", "func_id")

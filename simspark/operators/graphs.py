"""Flow analyses over many small graphs, and components over large ones.

Flow analyses are per function, and functions are small: a graph is gathered as one row of arrays by a single shuffle and solved in
an Arrow batch. Components have no such bound, so they are labelled by joins.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def per_graph(nodes: DataFrame, edges: DataFrame, solve: Callable[[list[dict], list[tuple[int, int]]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows (g, ...) that solve(nodes, edges) yields for each graph. nodes (g, n, ...), edges (g, src, dst)."""
    cols = [c for c in nodes.columns if c != "g"]
    ns = nodes.groupBy("g").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("ns"))
    es = edges.groupBy("g").agg(F.sort_array(F.collect_set(F.struct("src", "dst"))).alias("es"))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            rows = [(g, *r) for g, n, e in zip(t.g, t.ns, t.es) for r in solve([x if isinstance(x, dict) else x.asDict() for x in n], [(x["src"], x["dst"]) for x in (e if e is not None else ())])]
            yield pd.DataFrame(rows, columns=names)

    return ns.join(es, "g", "left").select("g", "ns", "es").mapInPandas(run, schema)


def reaching_definitions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, def, use, var): definitions that reach a use along the flow. nodes (g, n, writes, reads), one variable each, may be null."""

    def solve(ns: list[dict], es: list[tuple[int, int]]) -> Iterator[tuple]:
        kind = {x["n"]: x for x in ns}
        after: dict[int, list[int]] = {}
        for a, b in es:
            after.setdefault(a, []).append(b)
        for d in ns:
            var = d["writes"]
            if var is None:
                continue
            todo, seen = list(after.get(d["n"], ())), set()
            while todo:
                m = todo.pop()
                if m in seen or m not in kind:
                    continue
                seen.add(m)
                if kind[m]["reads"] == var:
                    yield d["n"], m, var
                if kind[m]["writes"] != var:
                    todo.extend(after.get(m, ()))

    kind = dict(nodes.dtypes)
    return per_graph(nodes, edges, solve, f"g {kind['g']}, def {kind['n']}, use {kind['n']}, var {kind['writes']}")


def _postdominators(ns: list[dict], es: list[tuple[int, int]]) -> dict[int, set[int]]:
    every = {x["n"] for x in ns}
    after: dict[int, set[int]] = {n: set() for n in every}
    for a, b in es:
        if a in every and b in every:
            after[a].add(b)
    found = {n: {n} if not after[n] else set(every) for n in every}
    changed = True
    while changed:
        changed = False
        for n in sorted(every, reverse=True):
            if after[n]:
                new = {n} | set.intersection(*(found[m] for m in after[n]))
                if new != found[n]:
                    found[n], changed = new, True
    return found


def postdominators(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, n, p): p stands on every way from n to an exit."""
    kind = dict(nodes.dtypes)
    return per_graph(nodes, edges, lambda ns, es: ((n, p) for n, ps in _postdominators(ns, es).items() for p in ps), f"g {kind['g']}, n {kind['n']}, p {kind['n']}")


def control_edges(ns: Iterable[int], es: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """(src, dst): dst runs or not as src branches: it postdominates a successor of src, but not src."""
    post = _postdominators([{"n": n} for n in ns], es)
    return {(a, n) for a, b in es if a in post and b in post for n in post[b] - post[a] if n != a}


def control_dependence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, src, dst) of control_edges of each graph."""
    kind = dict(nodes.dtypes)
    return per_graph(nodes, edges, lambda ns, es: iter(control_edges([x["n"] for x in ns], es)), f"g {kind['g']}, src {kind['n']}, dst {kind['n']}")


def last_definitions(nodes: DataFrame) -> DataFrame:
    """(g, def, use, var): the last node before each that wrote what it reads. nodes (g, n, var, writes, reads): one row a variable of a node."""
    w = Window.partitionBy("g", "var").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    found = nodes.withColumn("def", F.last(F.when(F.col("writes"), F.col("n")), ignorenulls=True).over(w))
    return found.where("reads and def is not null").select("g", "def", F.col("n").alias("use"), "var")


def small_components(ns: list[int], es: list[tuple[int, int]]) -> list[list[int]]:
    """The nodes of each component of a small graph, by their smallest node."""
    level, groups = bfs_levels(ns, es), []
    near: dict[int, set[int]] = {}
    for a, b in es:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for start in (n for n in sorted(ns) if level[n] == 0):
        group, front = {start}, {start}
        while front:
            front = {m for n in front for m in near.get(n, ())} - group
            group |= front
        groups.append(sorted(group))
    return groups


def bfs_levels(ns: list[int], es: list[tuple[int, int]]) -> dict[int, int]:
    """Depth of each node from the smallest of its component."""
    near: dict[int, list[int]] = {n: [] for n in ns}
    for a, b in es:
        if a in near and b in near:
            near[a].append(b), near[b].append(a)
    level: dict[int, int] = {}
    for start in sorted(ns):
        if start in level:
            continue
        level[start], front = 0, [start]
        while front:
            front = [m for n in front for m in near[n] if m not in level and not level.update({m: level[n] + 1})]
    return level


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a session on one machine may leave it unset, as in tests: it gets a folder there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/simspark-shared"
    return base.rstrip("/")


def materialised(df: DataFrame, tag: str) -> DataFrame:
    """df written to the folder that the cluster shares (spark.checkpoint.dir) and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable. nodes (id), edges (src, dst); labels hook to the smallest neighbour and then jump."""
    both = materialised(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct(), "edges")
    labels = materialised(nodes.select("id", F.col("id").alias("component")).distinct(), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("m"))
        hooked = labels.join(near, "id", "left").select("id", F.least("component", "m").alias("component"), (F.col("m") < F.col("component")).alias("moved"))
        jump = hooked.select(F.col("id").alias("component"), F.col("component").alias("up"))
        now = materialised(hooked.join(jump, "component", "left").select("id", F.least("component", "up").alias("component"), F.coalesce(F.col("moved"), F.lit(False)).alias("moved")), "labels")
        labels = now.select("id", "component")
        if now.where("moved").isEmpty():
            return labels

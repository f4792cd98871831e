"""Command line of the stages: spark-submit this file, or python -m simspark.jobs.cli."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from simspark.jobs import stages
from simspark.params import DEFAULT
from simspark.plans import report
from simspark.sources import graph_json

_NUMBERS = {
    "index": ["num_perm", "bands", "k", "wl_iters", "kpath_k", "kpath_per_node"],
    "candidates": ["topk_recall", "min_candidates", "min_tokens", "template_degree_soft", "template_degree_hard"],
    "rank": ["min_coverage"],
    "all-vs-all": ["alpha", "prog_threshold", "func_threshold", "topk_pairs"],
    "cluster": ["min_cluster_size", "epsilon"],
    "pipeline": ["min_coverage", "min_cluster_size", "epsilon"],
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, *paths: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        for path in paths:
            c.add_argument(f"--{path}", required=True)
        for option in _NUMBERS.get(name, []):
            default = getattr(DEFAULT, option)
            c.add_argument(f"--{option.replace('_', '-')}", type=type(default), default=default)
        return c

    for name, paths in (("graphs", ("input", "output")), ("pipeline", ("input", "output"))):
        c = command(name, *paths)
        c.add_argument("--effects")
        c.add_argument("--backend", default="auto")
        c.add_argument("--normalise-builtins", action="store_true")
        if name == "graphs":
            c.add_argument("--lang", default="auto", choices=["auto", "python", "c", "cpp", "java"])
        else:
            c.add_argument("--threshold", type=float, default=0.5)
            c.add_argument("--with-clusters", action="store_true")
    command("enrich", "json-root", "output")
    command("index", "json-root", "output")
    command("candidates", "index", "output")
    c = command("rank", "candidates", "output")
    c.add_argument("--clusters")
    c.add_argument("--threshold", type=float, default=DEFAULT.threshold)
    c = command("all-vs-all", "json-root", "output")
    c.add_argument("--input")
    c = command("cluster", "json-root", "output")
    c.add_argument("--lang", default="auto")
    c.add_argument("--max-funcs", type=int, default=0)
    c.add_argument("--method", default="hdbscan", choices=["hdbscan", "average"])
    c = command("cluster-report", "clusters", "output")
    c.add_argument("--num-functions", type=int, default=0)
    return p


def run(spark: SparkSession, argv: Sequence[str]) -> None:
    a = parser().parse_args(argv)
    params = stages.with_options(**vars(a))
    if a.command == "graphs":
        stages.build_graphs(spark, a.input, a.output, a.effects, a.lang, a.backend, a.normalise_builtins)
    elif a.command == "enrich":
        stages.enrich(spark, a.json_root, a.output)
    elif a.command == "index":
        stages.build_index(spark, a.json_root, a.output, params)
    elif a.command == "candidates":
        stages.find_candidates(spark, a.index, a.output, params)
    elif a.command == "rank":
        stages.rank(spark, a.candidates, a.output, a.clusters, a.threshold, params)
    elif a.command == "all-vs-all":
        stages.all_vs_all(spark, a.json_root, a.output, a.input, params)
    elif a.command == "cluster":
        stages.cluster(spark, a.json_root, a.output, a.lang, a.max_funcs, a.method, params)
    elif a.command == "cluster-report":
        stages.write_page(spark, a.output, report.cluster_report(graph_json.read_clusters(spark, a.clusters), a.num_functions))
    else:
        stages.pipeline(spark, a.input, a.output, a.backend, a.effects, a.threshold, a.with_clusters, params, a.normalise_builtins)


def main(argv: Sequence[str] | None = None) -> None:
    spark = SparkSession.builder.getOrCreate()
    try:
        import sys

        run(spark, sys.argv[1:] if argv is None else argv)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

"""From parsed functions to candidates, program pairs and clusters: the engine's stages over long tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simspark.functions import columns as C
from simspark.operators import align, fingerprints, parsed, programs, recall
from simspark.operators import distance as D
from simspark.operators import effects as E
from simspark.operators.graphs import materialised
from simspark.params import DEFAULT, Params


@dataclass(frozen=True)
class Index:
    """functions (func_id, program, func_idx, name, first_line, token_len, tokens, v, flags), buckets (view, band, bucket, func_id)."""

    functions: DataFrame
    buckets: DataFrame


def build_index(tables: parsed.Tables, signatures: DataFrame, params: Params = DEFAULT) -> Index:
    """Fingerprints of the token view and the graph view, and effect vectors."""
    vectors = signatures.select("func_id", C.l2_normalised(E.effect_vector()).alias("v"), "flags")
    functions = tables.functions.select("func_id", "program", "func_idx", "name", "first_line", F.size("tokens").alias("token_len"), "tokens").join(vectors, "func_id", "left")
    functions = materialised(functions, "index-functions")
    # short functions are left out before they are hashed
    long = functions.where(F.col("token_len") >= params.min_tokens)
    token = fingerprints.fingerprint(long.select("func_id", "tokens"), "func_id", params=params)
    graph = parsed.graph_shingles(tables.nodes, tables.edges)
    signed = graph.withColumn("signature", C.minhash(F.col("shingles"), params.num_perm))
    graph = signed.withColumn("bands", C.band_keys(F.col("signature"), params.bands, params.num_perm))
    view = lambda df, name: fingerprints.buckets(df, "func_id").select(F.lit(name).alias("view"), "band", "bucket", "func_id")
    return Index(functions, materialised(view(token, "token").unionByName(view(graph, "graph")), "index-buckets"))


def save_index(index: Index, path: str) -> None:
    index.functions.write.mode("overwrite").parquet(f"{path}/functions")
    index.buckets.write.mode("overwrite").partitionBy("view", "band").parquet(f"{path}/buckets")


def load_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/functions"), spark.read.parquet(f"{path}/buckets"))


def candidates(index: Index, params: Params = DEFAULT, view: str = "token") -> DataFrame:
    """(lsh_sim, meta_i, meta_j): pairs of functions of different files, from the buckets and, for functions that meet fewer than
    min_candidates others there, from the nearest effect vectors. lsh_sim is the cosine of the effect vectors.

    The graph view's buckets are built like the token view's; the published candidates use the token view alone.
    """
    zero = F.array(*[F.lit(0.0)] * len(E.COUNTERS))
    functions = materialised(index.functions.select("func_id", "program", "func_idx", "name", "first_line", "token_len", F.coalesce("v", zero).alias("v"), "flags", F.xxhash64("func_id").alias("no")), "functions")
    asked = functions.where(F.col("token_len") >= params.min_tokens)
    pairs = recall.candidate_pairs(index.buckets.where(F.col("view") == view), "func_id")
    hits = materialised(recall.both_ways(pairs), "hits")
    counts = hits.groupBy("i").agg(F.count("*").alias("n"))
    few = asked.join(counts, asked.func_id == counts.i, "left").where(F.coalesce("n", F.lit(0)) < params.min_candidates)
    near = align.supplement(few.select(F.col("no").alias("id"), "v"), functions.select(F.col("no").alias("id"), "v"), max(5 * params.min_candidates, 50))
    named = lambda x: functions.select(F.col("no").alias(f"n{x}"), F.col("func_id").alias(x))
    extra = near.select(F.col("i").alias("ni"), F.col("j").alias("nj")).join(named("i"), "ni").join(named("j"), "nj").select("i", "j")
    met = hits.unionByName(extra).distinct()
    side = lambda x: asked.select(F.col("func_id").alias(x), F.col("v").alias(f"v{x}"), C.basename(F.col("program")).alias(f"file_{x}"))
    scored = met.join(side("i"), "i").join(side("j"), "j").where("file_i <> file_j").select("i", "j", C.cosine(F.col("vi"), F.col("vj")).alias("sim"))
    top = materialised(recall.top_per_query(scored, k=params.topk_recall), "top")
    degree = recall.neighbor_degree(top)
    both = recall.with_degrees(top.select("i", "j", "sim"), degree).where(recall.not_both_hard(params))
    one = both.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.max("sim").alias("lsh_sim"))
    meta = functions.join(degree.withColumnRenamed("j", "func_id"), "func_id", "left").withColumn("neighbor_degree", F.coalesce("degree", F.lit(0)).cast("long"))
    meta = meta.select("func_id", F.struct(F.col("func_id").alias("id"), "program", "func_idx", "name", F.col("first_line").alias("first_lineno"), "token_len", "neighbor_degree", recall.is_template_degree(F.col("neighbor_degree"), params).alias("is_template_like"), "flags").alias("meta"))
    end = lambda x, name: meta.select(F.col("func_id").alias(x), F.col("meta").alias(name))
    return one.join(end("a", "meta_i"), "a").join(end("b", "meta_j"), "b").select("lsh_sim", "meta_i", "meta_j")


def is_template(meta: str) -> Column:
    """A side of a candidate pair is boilerplate. Signatures are no texts, so they give no tags."""
    m = lambda c: F.col(f"{meta}.{c}")
    return C.is_template_func(m("name"), F.lit(None).cast("string"), C.inferred_length(m("token_len")), m("neighbor_degree"), F.lit(0))


def function_pairs(cands: DataFrame, threshold: float = DEFAULT.threshold, weights: DataFrame | None = None) -> DataFrame:
    """(prog_a, prog_b, fa, fb, la, lb, score) of candidates that are kept: similar, no boilerplate, over the threshold.

    weights (func_id, weight): functions in template clusters count for less of their length; lengths stay 1 at least.
    """
    p = cands.where((F.col("lsh_sim") > 0) & ~is_template("meta_i") & ~is_template("meta_j"))
    m = lambda x, c: F.col(f"meta_{x}.{c}")
    length = lambda x: C.inferred_length(m(x, "token_len"))
    score = C.func_pair_score(F.col("lsh_sim"), m("i", "name"), m("j", "name"), length("i"), length("j"), m("i", "neighbor_degree"), m("j", "neighbor_degree"), F.lit(False), threshold)
    kept = p.select(m("i", "program").alias("prog_a"), m("j", "program").alias("prog_b"), m("i", "id").alias("fa"), m("j", "id").alias("fb"), length("i").cast("double").alias("la"), length("j").cast("double").alias("lb"), score.alias("score"))
    kept = kept.where(F.col("score") > 0)
    if threshold > 0:
        kept = kept.where(F.col("score") >= threshold)
    for x in "ab" if weights is not None else "":
        w = weights.select(F.col("func_id").alias(f"f{x}"), F.col("weight").alias("w"))
        kept = kept.join(w, f"f{x}", "left").withColumn(f"l{x}", F.col(f"l{x}") * F.coalesce("w", F.lit(1.0))).drop("w")
    return programs.canonical(kept.withColumns({f"l{x}": F.greatest(F.lit(1.0), f"l{x}") for x in "ab"}))


def program_pairs(pairs: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(prog_a, prog_b, base, score, matches), the best first: totals are those of the functions that have a kept pair."""
    side = lambda x: pairs.select(F.col(f"prog_{x}").alias("prog"), F.col(f"f{x}").alias("f"), F.col(f"l{x}").alias("l"))
    kept = side("a").unionByName(side("b")).groupBy("prog", "f").agg(F.max("l").alias("l"))
    totals = kept.groupBy("prog").agg(F.sum("l").alias("total_len"), F.count("*").alias("total_funcs"))
    scored = programs.program_scores(pairs, totals, params)
    matches = pairs.groupBy("prog_a", "prog_b").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "fa", "fb"))).alias("m"))
    nested = F.transform("m", lambda x: F.struct(x.fa.alias("fa"), x.fb.alias("fb"), (-x.s).alias("score"))).alias("matches")
    return scored.join(matches, ["prog_a", "prog_b"]).select("prog_a", "prog_b", "base", "score", nested).orderBy(F.desc("score"), "prog_a", "prog_b")


def set_similarity_pairs(sets: DataFrame, least: float) -> DataFrame:
    """(i, j, jaccard) of all rows of sets (id, s array of distinct strings) with a Jaccard similarity of `least` or more.

    Prefixes of the sets in order of rarity meet in an equi-join: two sets that similar share an item of their prefixes, so no pair is
    lost and none is made that has no item in common. The join is by rare items first, and by a set's own length.
    """
    if not 0 < least <= 1:
        raise ValueError("without a similarity above 0 every pair would be a result")
    items = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("item"))
    counts = items.groupBy("item").agg(F.count("*").alias("df"))
    ordered = items.join(counts, "item").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("df", "item")))
    prefix = materialised(ordered.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select("id", "n", "item", "rank"), "prefixes")
    side = lambda x: prefix.select("item", F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("rank").alias(f"r{x}"))
    met = side("i").join(side("j"), "item").where("i < j").where(F.least("ni", "nj") >= least * F.greatest("ni", "nj") - 1e-9)
    # what can still be shared behind this item must do
    ahead = F.least(F.col("ni") - F.col("ri"), F.col("nj") - F.col("rj")) + F.least("ri", "rj")
    met = met.where(ahead >= least / (1 + least) * (F.col("ni") + F.col("nj")) - 1e-9).select("i", "j").distinct()
    return recall.with_jaccard(met, sets.select("id", "s"), "id", "s").where(F.col("jaccard") >= least - 1e-12)


def all_vs_all(functions: DataFrame, signatures: DataFrame, params: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(matches, program pairs) of all functions of all programs: similarity of token sets and effects, one-to-one, mean score.

    A pair over the threshold must share tokens as far as the weights allow, which is what all pairs are searched by.
    """
    least = (params.func_threshold - (1 - params.alpha)) / params.alpha
    sets = functions.select(F.col("func_id").alias("id"), F.array_distinct("tokens").alias("s"))
    effects = signatures.select("func_id", E.effect_vector().alias("v"), F.array_contains("flags", "unknown").alias("u"))
    rows = functions.select("func_id", "program").join(effects, "func_id")
    side = lambda x, f: rows.select(F.col("func_id").alias(f), F.col("program").alias(f"prog_{x}"), F.col("v").alias(f"v{x}"), F.col("u").alias(f"u{x}"))
    pairs = set_similarity_pairs(sets, least).withColumnsRenamed({"i": "fa", "j": "fb"}).join(side("a", "fa"), "fa").join(side("b", "fb"), "fb").where("prog_a <> prog_b")
    score = C.func_similarity(F.col("jaccard"), C.cosine(F.col("va"), F.col("vb")), F.col("ua") | F.col("ub"), params.alpha, params.unknown_penalty)
    pairs = pairs.withColumn("score", score).where(F.col("score") >= params.func_threshold)
    one = F.lit(1)
    matches = materialised(programs.greedy_matches(programs.canonical(pairs.withColumns({"la": one, "lb": one}))), "matches")
    return matches, programs.all_vs_all(matches, params)


#: Functions that one clustering takes: their distances are one matrix.
MAX_CLUSTERED = 5_000


def clusters(functions: DataFrame, vectors: DataFrame, signatures: DataFrame, shingles: DataFrame, nodes: DataFrame, params: Params = DEFAULT, max_funcs: int = 2_000, method: str = "hdbscan") -> DataFrame:
    """(cluster_id, size, members, exemplar, mean_node_size, mean_intra_distance, distinct_files, is_template_like) of the first
    max_funcs functions by program (0: of all, if there are no more than MAX_CLUSTERED)."""
    chosen = functions.orderBy("program", "func_idx").limit(max_funcs or MAX_CLUSTERED + 1)
    sizes = nodes.groupBy("func_id").agg(F.count("*").alias("nodes"))
    bags = signatures.select("func_id", parsed.effect_bag().alias("effects"))
    rows = chosen.select("func_id", "program").join(vectors, "func_id").join(bags, "func_id").join(shingles, "func_id", "left").join(sizes, "func_id", "left")

    def run(t: pd.DataFrame) -> pd.DataFrame:
        if len(t) > MAX_CLUSTERED:
            raise ValueError(f"one clustering takes {MAX_CLUSTERED} functions; choose max_funcs")
        t = t.sort_values("func_id", ignore_index=True)
        d = view_distances(t, params)
        labels = D.hdbscan_labels(d, params.min_cluster_size, params.epsilon) if method == "hdbscan" else D.average_linkage_labels(d, params.epsilon)
        out = []
        for label in sorted(set(labels.tolist()) - {-1}):
            at = np.flatnonzero(labels == label)
            inner = d[np.ix_(at, at)]
            mean = float(inner[np.triu_indices(len(at), 1)].mean()) if len(at) > 1 else 0.0
            nodes_, files = float(t.nodes[at].fillna(0).mean()), int(t.program[at].nunique())
            template = len(at) >= max(8, 2 * params.min_cluster_size) and nodes_ < 12 and mean < 0.35 and files >= 3
            out.append((label, len(at), t.func_id[at].tolist(), t.func_id[at[int(inner.mean(axis=1).argmin())]], nodes_, mean, files, template))
        return pd.DataFrame(out, columns=["cluster_id", "size", "members", "exemplar", "mean_node_size", "mean_intra_distance", "distinct_files", "is_template_like"])

    schema = "cluster_id int, size int, members array<string>, exemplar string, mean_node_size double, mean_intra_distance double, distinct_files int, is_template_like boolean"
    return rows.groupBy(F.lit(0).alias("all")).applyInPandas(run, schema)


def _overlap(bags: list[list[str]]) -> np.ndarray:
    """Jaccard similarity of all pairs; 1 for two empty bags."""
    code = {x: i for i, x in enumerate(sorted({x for b in bags for x in b}))}
    have = np.zeros((len(bags), len(code)), np.float32)
    for i, b in enumerate(bags):
        have[i, [code[x] for x in b]] = 1
    both, size = have @ have.T, have.sum(axis=1)
    union = size[:, None] + size[None] - both
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def view_distances(t: pd.DataFrame, params: Params = DEFAULT) -> np.ndarray:
    """Distances of functions (v, effects, shingles) by all three views."""
    plain = lambda c: [list(x) if x is not None else [] for x in t[c]]
    v = np.array(plain("v"), float)
    norm = np.linalg.norm(v, axis=1)
    cos = (v @ v.T) / (norm[:, None] * norm[None] + 1e-9)
    weight = params.weight_semantic + params.weight_effect + params.weight_graph
    d = params.weight_semantic * (1 - cos) + params.weight_effect * (1 - _overlap(plain("effects"))) + params.weight_graph * (1 - _overlap(plain("shingles")))
    d = np.clip(d / weight if weight else np.ones_like(d), 0, 1)
    np.fill_diagonal(d, 0)
    return (d + d.T) / 2


def template_weights(found: DataFrame) -> DataFrame:
    """(func_id, weight) of the members of template clusters; of several clusters the smallest weight holds."""
    like = found.where("is_template_like").select(F.explode("members").alias("func_id"), C.template_weight(F.col("size"), F.col("distinct_files")).alias("weight"))
    return like.groupBy("func_id").agg(F.min("weight").alias("weight"))


def alignment_plan(vectors: DataFrame, k: int = 20) -> DataFrame:
    """(i, j, cos): the pairs that are worth aligning, each function with its k nearest by cosine. vectors (id long, v)."""
    near = align.supplement(vectors, vectors, k)
    return near.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max(F.greatest("sim", F.lit(0.0))).alias("cos"))

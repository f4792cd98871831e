"""Shingles, MinHash signatures, bands, graph fingerprints and effect vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simspark.functions import columns as C
from simspark.params import DEFAULT, Params


def fingerprint(df: DataFrame, id_col: str, seq: str = "tokens", params: Params = DEFAULT) -> DataFrame:
    """Adds shingles, signature and bands; row by row, without a shuffle."""
    with_shingles = df.withColumn("shingles", C.shingles(F.col(seq), params.k))
    with_signature = with_shingles.withColumn("signature", C.minhash(F.col("shingles"), params.num_perm))
    return with_signature.withColumn("bands", C.band_keys(F.col("signature"), params.bands, params.num_perm))


def representatives(df: DataFrame, id_col: str, by: str = "shingles") -> DataFrame:
    """One row for each distinct value of `by`: the smallest id and its row. Copies needn't be compared with each other."""
    named = df.withColumn("__class", F.xxhash64(F.array_sort(by)))
    first = named.groupBy("__class").agg(F.min(id_col).alias(id_col))
    return named.join(first, ["__class", id_col], "left_semi").drop("__class")


def buckets(df: DataFrame, id_col: str) -> DataFrame:
    """(band, bucket, id) of fingerprinted rows that have shingles: the index as a table."""
    # outer, as a filter on the exploded array would make its Arrow functions run again for each use
    rows = df.where(F.size("shingles") > 0).select(id_col, F.posexplode_outer("bands").alias("band", "bucket"))
    return rows.select("band", "bucket", id_col)


def marked(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """df with `marks` (n, c, bands) of its column `words` in place of it; row by row. Save it before fields are taken, or each makes them anew."""
    return df.withColumn("marks", C.marks(F.col("words"), params.k, params.num_perm, params.bands)).drop("words")


def band_rows(marked: DataFrame, id_col: str) -> DataFrame:
    """(band, bucket, id) of saved rows with bands."""
    return marked.select(id_col, F.posexplode("bands").alias("band", "bucket")).select("band", "bucket", id_col)


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, u, v): undirected neighbours, both ends present. nodes (g, n, kind), edges (g, src, dst)."""
    both = edges.select("g", F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(edges.select("g", F.col("dst").alias("u"), F.col("src").alias("v"))).distinct()
    ends = nodes.select("g", "n")
    return both.join(ends.withColumnRenamed("n", "u"), ["g", "u"], "left_semi").join(ends.withColumnRenamed("n", "v"), ["g", "v"], "left_semi").select("g", "u", "v")


def wl_labels(nodes: DataFrame, adj: DataFrame, iters: int = DEFAULT.wl_iters) -> DataFrame:
    """(g, n, round, label): Weisfeiler-Lehman labels; round 0 is the kind."""
    now = nodes.select("g", "n", F.concat(F.lit("WL0:"), F.col("kind")).alias("label"))
    out = now.withColumn("round", F.lit(0))
    for i in range(1, iters + 1):
        seen = adj.join(now.select("g", F.col("n").alias("v"), F.col("label").alias("next")), ["g", "v"]).groupBy("g", F.col("u").alias("n")).agg(F.array_join(F.array_sort(F.collect_list("next")), "|").alias("near"))
        now = now.join(seen, ["g", "n"], "left").select("g", "n", F.concat(F.lit(f"WL{i}:"), F.md5(F.concat_ws("|", "label", F.coalesce("near", F.lit(""))))).alias("label"))
        out = out.unionByName(now.withColumn("round", F.lit(i)))
    return out.select("g", "n", "round", "label") if iters > 0 else out.where(F.lit(False)).select("g", "n", "round", "label")


def kpath_shingles(nodes: DataFrame, adj: DataFrame, budget: int = DEFAULT.kpath_per_node) -> DataFrame:
    """(g, path): distinct labelled walks of two and three nodes without turning back, at most `budget` steps from each start.

    Steps are counted as a depth-first walk makes them: a walk comes before its extensions, neighbours rise.
    """
    one = adj.select("g", F.col("u").alias("s"), F.col("v").alias("a"), F.lit(None).cast(dict(adj.dtypes)["v"]).alias("b"))
    step = adj.select("g", F.col("u").alias("a"), F.col("v").alias("b"))
    two = one.drop("b").join(step, ["g", "a"]).where("b <> s").select("g", "s", "a", "b")
    order = Window.partitionBy("g", "s").orderBy(F.col("a").asc_nulls_first(), F.col("b").asc_nulls_first())
    walked = one.unionByName(two).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= budget)
    kind = lambda x: nodes.select("g", F.col("n").alias(x), F.col("kind").alias(f"k{x}"))
    named = walked.join(kind("s"), ["g", "s"]).join(kind("a"), ["g", "a"]).join(kind("b"), ["g", "b"], "left")
    return named.where("b is not null").select("g", F.concat(F.lit("PATH:"), F.concat_ws("->", "ks", "ka", "kb")).alias("path")).distinct()


def degree_stats(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """(g, n_nodes, mean_degree, std_degree, max_degree); population deviation, isolated nodes count."""
    degree = nodes.select("g", "n").join(adj.groupBy("g", F.col("u").alias("n")).agg(F.count("*").alias("d")), ["g", "n"], "left").withColumn("d", F.coalesce("d", F.lit(0)))
    return degree.groupBy("g").agg(F.count("*").alias("n_nodes"), F.avg("d").alias("mean_degree"), F.stddev_pop("d").alias("std_degree"), F.max("d").alias("max_degree"))

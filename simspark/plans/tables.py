"""Graph, vector, name and line queries over the other tables.

An order is a small graph: its lines are nodes of the kind of their return flag, linked in sequence and by two steps. Embeddings are
functions' vectors, their labels clusters. Conversations and events stand for lines and definitions in order, pages for source text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simspark.functions import columns as C
from simspark.operators import distance as D
from simspark.operators import effects as E
from simspark.functions import lexers
from simspark.operators import align, fingerprints, graphs, parsed, programs, recall
from simspark.params import DEFAULT
from simspark.plans.documents import _CANDS, _TOK, _VEC, _signature
from simspark.plans.registry import query, table

_NODES = "nodes AS (SELECT l_orderkey AS g, l_linenumber AS n, max(l_returnflag) AS kind, max(l_linestatus) AS status FROM lineitem GROUP BY ALL)"
_EDGES = f"{_NODES}, edges AS (SELECT a.g, a.n AS src, b.n AS dst FROM nodes a JOIN nodes b ON a.g = b.g AND b.n IN (a.n + 1, a.n + 2))"
_ADJ = f"{_EDGES}, adj AS (SELECT g, src AS u, dst AS v FROM edges UNION SELECT g, dst, src FROM edges)"


def order_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("n"))
    return rows.agg(F.max("l_returnflag").alias("kind"), F.max("l_linestatus").alias("status"))


def order_edges(nodes: DataFrame) -> DataFrame:
    """Lines follow each other directly or by two; both come from the order of lines, without a join."""
    w = Window.partitionBy("g").orderBy("n")
    ahead = nodes.select("g", F.col("n").alias("src"), F.array(F.lead("n", 1).over(w), F.lead("n", 2).over(w)).alias("next"))
    near = ahead.select("g", "src", F.explode("next").alias("dst"))
    return near.where((F.col("dst") - F.col("src")).isin(1, 2)).distinct()


def order_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = order_nodes(spark, sf_dir)
    return nodes, fingerprints.adjacency(nodes, order_edges(nodes))


@query(f"WITH {_ADJ} SELECT g, u, v FROM adj")
def undirected_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_graph(spark, sf_dir)[1]


@query(f"WITH {_ADJ}, d AS (SELECT nodes.g, nodes.n, count(v) AS d FROM nodes LEFT JOIN adj ON adj.g = nodes.g AND adj.u = nodes.n GROUP BY ALL) SELECT g, count(*) AS n_nodes, round(avg(d), 6) AS mean_degree, round(stddev_pop(d), 6) AS std_degree, max(d) AS max_degree FROM d GROUP BY g")
def degree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.degree_stats(*order_graph(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean_degree", "std_degree")})


_WL = f"""{_ADJ}, w0 AS (SELECT g, n, 'WL0:' || kind AS label FROM nodes),
w1 AS (SELECT w0.g, w0.n, 'WL1:' || md5(any_value(w0.label) || '|' || coalesce(array_to_string(list_sort(list(x.label) FILTER (WHERE x.label IS NOT NULL)), '|'), '')) AS label FROM w0 LEFT JOIN adj ON adj.g = w0.g AND adj.u = w0.n LEFT JOIN w0 x ON x.g = adj.g AND x.n = adj.v GROUP BY w0.g, w0.n),
w2 AS (SELECT w1.g, w1.n, 'WL2:' || md5(any_value(w1.label) || '|' || coalesce(array_to_string(list_sort(list(x.label) FILTER (WHERE x.label IS NOT NULL)), '|'), '')) AS label FROM w1 LEFT JOIN adj ON adj.g = w1.g AND adj.u = w1.n LEFT JOIN w1 x ON x.g = adj.g AND x.n = adj.v GROUP BY w1.g, w1.n),
wl AS (SELECT *, 0 AS round FROM w0 UNION ALL SELECT *, 1 FROM w1 UNION ALL SELECT *, 2 FROM w2)"""
_KPATH = """one AS (SELECT g, u AS s, v AS a, CAST(NULL AS INTEGER) AS b FROM adj), two AS (SELECT x.g, x.u AS s, x.v AS a, y.v AS b FROM adj x JOIN adj y ON y.g = x.g AND y.u = x.v AND y.v <> x.u),
walk AS (SELECT *, row_number() OVER (PARTITION BY g, s ORDER BY a ASC NULLS FIRST, b ASC NULLS FIRST) AS r FROM (SELECT * FROM one UNION ALL SELECT * FROM two)),
kp AS (SELECT DISTINCT walk.g, 'PATH:' || k1.kind || '->' || k2.kind || '->' || k3.kind AS path FROM walk JOIN nodes k1 ON k1.g = walk.g AND k1.n = s JOIN nodes k2 ON k2.g = walk.g AND k2.n = a JOIN nodes k3 ON k3.g = walk.g AND k3.n = b WHERE r <= 32)"""


@query(f"WITH {_WL} SELECT g, n, round, label FROM wl")
def wl_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.wl_labels(*order_graph(spark, sf_dir))


@query(f"WITH {_ADJ}, {_KPATH} SELECT g, path FROM kp")
def kpath_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.kpath_shingles(*order_graph(spark, sf_dir))


def _graph_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, adj = order_graph(spark, sf_dir)
    labels = fingerprints.wl_labels(nodes, adj).select("g", F.col("label").alias("s"))
    return labels.unionByName(fingerprints.kpath_shingles(nodes, adj).select("g", F.col("path").alias("s"))).distinct()


@query(f"WITH {_WL}, {_KPATH}, gs AS (SELECT g, label AS s FROM wl UNION SELECT g, path FROM kp) SELECT g, count(*) AS n_shingles FROM gs GROUP BY g")
def graph_shingle_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph_shingles(spark, sf_dir).groupBy("g").agg(F.count("*").alias("n_shingles"))


@query(f"""WITH {_WL}, {_KPATH}, gs AS (SELECT g, label AS s FROM wl UNION SELECT g, path FROM kp), sets AS (SELECT g, list_sort(list(s)) AS sh FROM gs GROUP BY g)
SELECT min(g) AS rep, count(*) AS size, len(any_value(sh)) AS n_shingles FROM sets GROUP BY sh""")
def graph_class_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of graphs with equal shingle sets: their smallest member, size and shingles."""
    sets = _graph_shingles(spark, sf_dir).groupBy("g").agg(F.sort_array(F.collect_list("s")).alias("sh"))
    return sets.groupBy(F.md5(F.concat_ws(",", "sh")).alias("c"), F.size("sh").cast("long").alias("n_shingles")).agg(F.min("g").alias("rep"), F.count("*").alias("size")).select("rep", "size", "n_shingles")


_GRAPHS = f"{_WL}, {_KPATH}, gs AS (SELECT g, label AS s FROM wl UNION SELECT g, path FROM kp), sets AS (SELECT g, list_sort(list(s)) AS sh FROM gs GROUP BY g)"
_GREPS = f"{_GRAPHS}, reps AS (SELECT min(g) AS g, sh FROM sets GROUP BY sh)"


def graph_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(g, rep, shingles): each graph, the smallest one with its shingle set, and the set where the graph is that one."""
    sets = _graph_shingles(spark, sf_dir).groupBy("g").agg(F.sort_array(F.collect_list("s")).alias("shingles"))
    sets = graphs.materialised(sets.withColumn("c", F.md5(F.concat_ws(",", "shingles"))), "graph-sets")
    named = sets.join(sets.groupBy("c").agg(F.min("g").alias("rep")), "c")
    return named.select("g", "rep", F.when(F.col("g") == F.col("rep"), F.col("shingles")).alias("shingles"))


@query(f"WITH {_GREPS} SELECT sets.g, reps.g AS rep FROM sets JOIN reps ON sets.sh = reps.sh")
def graph_copy_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of what graph_lsh_pairs pairs up."""
    return graph_classes(spark, sf_dir).select("g", "rep")


@query(f"WITH {_GREPS}, {_signature('reps', key='g')} SELECT DISTINCT x.g AS i, y.g AS j FROM sigb x JOIN sigb y ON x.band = y.band AND x.bucket = y.bucket AND x.g < y.g")
def graph_lsh_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different graphs, each for its class, that share a bucket of the graph view."""
    reps = graph_classes(spark, sf_dir).where("g = rep").select("g", "shingles")
    signed = reps.withColumn("signature", C.minhash(F.col("shingles"), DEFAULT.num_perm))
    # both sides of the join read these rows
    marked = graphs.materialised(signed.withColumn("bands", C.band_keys(F.col("signature"), DEFAULT.bands, DEFAULT.num_perm)), "graph-signatures")
    return recall.candidate_pairs(fingerprints.buckets(marked, "g"), "g")


@query(f"""WITH {_EDGES}, flow AS (SELECT e.g, src, dst, CASE WHEN x.kind = 'R' THEN 'control' WHEN dst - src = 1 THEN 'cfg' ELSE 'data' END AS view FROM edges e JOIN nodes x ON x.g = e.g AND x.n = e.src),
ends AS (SELECT g, n, count(*) AS d FROM (SELECT g, src AS n FROM flow UNION ALL SELECT g, dst FROM flow) GROUP BY ALL), deg AS (SELECT g, avg(d) AS mean, stddev_pop(d) AS std, max(d)::DOUBLE AS most FROM ends GROUP BY g),
vw AS (SELECT g, count(*) FILTER (WHERE view = 'cfg') AS c, count(*) FILTER (WHERE view = 'data') AS d, count(*) FILTER (WHERE view = 'control') AS k FROM flow GROUP BY g), sz AS (SELECT g, count(*) AS n FROM nodes GROUP BY g),
f AS (SELECT sz.g, [n::DOUBLE, coalesce(c, 0), coalesce(d, 0), coalesce(k, 0), 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, coalesce(mean, 0), coalesce(std, 0), coalesce(most, 0)] AS v FROM sz LEFT JOIN vw ON vw.g = sz.g LEFT JOIN deg ON deg.g = sz.g),
u AS (SELECT g, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-8 AS l FROM f)
SELECT g, """ + ", ".join(f"round(v[{i + 1}] / l, 6) AS v{i}" for i in range(20)) + " FROM u")
def structural_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 20 numbers of each order's graph; edges from returned lines are control, steps by two data, the others flow."""
    nodes = order_nodes(spark, sf_dir)
    kind = nodes.select("g", F.col("n").alias("src"), "kind")
    view = F.when(F.col("kind") == "R", "control").when(F.col("dst") - F.col("src") == 1, "cfg").otherwise("data")
    edges = order_edges(nodes).join(kind, ["g", "src"]).select(F.col("g").alias("func_id"), view.alias("view"), "src", "dst")
    own = nodes.select(F.col("g").alias("func_id"), F.col("n").alias("nid"))
    v = parsed.structural_vectors(own.select("func_id").distinct(), own, edges)
    return v.select(F.col("func_id").alias("g"), *(F.round(F.col("v")[i], 6).alias(f"v{i}") for i in range(20)))


@query(f"""WITH RECURSIVE {_EDGES}, reach(g, d, var, n) AS (SELECT e.g, e.src, x.kind, e.dst FROM edges e JOIN nodes x ON x.g = e.g AND x.n = e.src
UNION SELECT r.g, r.d, r.var, e.dst FROM reach r JOIN nodes m ON m.g = r.g AND m.n = r.n AND m.kind <> r.var JOIN edges e ON e.g = r.g AND e.src = r.n)
SELECT r.g, r.d AS def, r.n AS use, r.var FROM reach r JOIN nodes m ON m.g = r.g AND m.n = r.n AND m.kind = r.var""")
def reaching_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = order_nodes(spark, sf_dir)
    return graphs.reaching_definitions(nodes.select("g", "n", F.col("kind").alias("writes"), F.col("kind").alias("reads")), order_edges(nodes))


_POST = f"""{_EDGES}, away(g, p, n) AS (SELECT a.g, a.n, b.n FROM nodes a JOIN nodes b ON a.g = b.g AND a.n <> b.n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.g = b.g AND e.src = b.n)
UNION SELECT r.g, r.p, e.src FROM away r JOIN edges e ON e.g = r.g AND e.dst = r.n WHERE e.src <> r.p),
post AS (SELECT a.g, a.n, b.n AS p FROM nodes a JOIN nodes b ON a.g = b.g WHERE NOT EXISTS (SELECT 1 FROM away r WHERE r.g = a.g AND r.n = a.n AND r.p = b.n))"""


@query(f"WITH RECURSIVE {_POST} SELECT g, n, p FROM post")
def postdominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = order_nodes(spark, sf_dir)
    return graphs.postdominators(nodes.select("g", "n"), order_edges(nodes))


@query(f"WITH RECURSIVE {_POST} SELECT DISTINCT e.g, e.src, p.p AS dst FROM edges e JOIN post p ON p.g = e.g AND p.n = e.dst WHERE p.p <> e.src AND NOT EXISTS (SELECT 1 FROM post q WHERE q.g = e.g AND q.n = e.src AND q.p = p.p)")
def control_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = order_nodes(spark, sf_dir)
    return graphs.control_dependence(nodes.select("g", "n"), order_edges(nodes))


@query(f"WITH {_EDGES}, views AS (SELECT g, 'data' AS view, src, dst FROM edges UNION ALL SELECT g, 'dfg', src, dst FROM edges WHERE g % 2 = 0) SELECT * FROM views UNION ALL SELECT g, 'dfg', src, dst FROM edges WHERE g NOT IN (SELECT g FROM views WHERE view = 'dfg')")
def view_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs without a view of their own get it from the data edges."""
    edges = order_edges(order_nodes(spark, sf_dir))
    data = edges.select("g", F.lit("data").alias("view"), "src", "dst")
    own = edges.where("g % 2 = 0").select("g", F.lit("dfg").alias("view"), "src", "dst")
    lent = edges.join(own.select("g").distinct(), "g", "left_anti").select("g", F.lit("dfg").alias("view"), "src", "dst")
    return data.unionByName(own).unionByName(lent)


@query("SELECT l_orderkey AS g, l_returnflag AS kind, count(*) AS n FROM lineitem GROUP BY ALL")
def kind_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("g"), F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"))


# Vectors


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("g"), F.col("embedding").cast("array<double>").alias("v"))


_PAIRS = "p AS (SELECT a.label AS g, a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cos FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)"
_BOTH = f"{_PAIRS}, d AS (SELECT g, i, j, round(least(1.0, greatest(0.0, 1 - cos)), 6) AS d FROM p UNION ALL SELECT g, j, i, round(least(1.0, greatest(0.0, 1 - cos)), 6) FROM p)"


@query(f"WITH {_PAIRS} SELECT i, j, round(cos, 6) AS cos FROM p WHERE cos >= 0.3")
def embedding_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.similar_pairs(_vectors(spark, sf_dir), 0.3).select("i", "j", F.round("cos", 6).alias("cos"))


@query(f"WITH {_BOTH}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM d) SELECT i, j, d, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.nearest(_vectors(spark, sf_dir), 10).select("i", "j", "d", "rank")


_CORE = f"{_BOTH}, k AS (SELECT *, row_number() OVER (PARTITION BY g, i ORDER BY d, j) AS r FROM d), core AS (SELECT g, i, max(d) AS core FROM k WHERE r <= 8 GROUP BY ALL)"


@query(f"WITH {_CORE} SELECT g, i, core FROM core")
def core_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.nearest(_vectors(spark, sf_dir), DEFAULT.min_cluster_size).groupBy("g", "i").agg(F.max("d").alias("core"))


@query(f"WITH {_CORE} SELECT d.g, d.i, d.j, greatest(d, a.core, b.core) AS reach FROM d JOIN core a ON a.g = d.g AND a.i = d.i JOIN core b ON b.g = d.g AND b.i = d.j")
def mutual_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.mutual_reachability(_vectors(spark, sf_dir), core_distance(spark, sf_dir))


@query(f"WITH {_BOTH}, s AS (SELECT g, i, sum(d) AS s FROM d GROUP BY ALL) SELECT g AS cluster, arg_min(i, (round(s, 9), i)) AS medoid FROM s GROUP BY g")
def cluster_medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.medoids(D.distance_sums(_vectors(spark, sf_dir)).withColumnRenamed("g", "cluster"))


@query(f"WITH {_BOTH}, m AS (SELECT label AS cluster, count(*) AS size, avg(vec_id % 20) AS nodes, count(DISTINCT vec_id % 5) AS files FROM embeddings GROUP BY label), dd AS (SELECT g, avg(d) AS md FROM d WHERE i < j GROUP BY g) SELECT cluster, size, round(nodes, 6) AS mean_nodes, files, round(coalesce(md, 0.0), 6) AS mean_distance, size >= 16 AND nodes < 12 AND coalesce(md, 0.0) < 0.35 AND files >= 3 AS template FROM m LEFT JOIN dd ON dd.g = m.cluster")
def cluster_stats_template_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _vectors(spark, sf_dir).select(F.col("g").alias("cluster"), "id", (F.col("id") % 20).alias("nodes"), (F.col("id") % 5).alias("file"))
    st = D.cluster_stats(members, D.distance_sums(_vectors(spark, sf_dir)).withColumnRenamed("g", "cluster"))
    return st.withColumns({c: F.round(c, 6) for c in ("mean_nodes", "mean_distance")})


@query()
def hdbscan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.cluster_groups(_vectors(spark, sf_dir), "hdbscan")


@query()
def average_linkage_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.cluster_groups(_vectors(spark, sf_dir), "average")


@query(f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT i, j FROM p WHERE cos >= 0.45 UNION ALL SELECT j, i FROM p WHERE cos >= 0.45), reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, e.j FROM reach r JOIN e ON e.i = r.b)
SELECT a AS id, min(b) AS component FROM reach GROUP BY a""")
def threshold_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = D.similar_pairs(_vectors(spark, sf_dir), 0.45).select(F.col("i").alias("src"), F.col("j").alias("dst"))
    return graphs.connected_components(_vectors(spark, sf_dir).select("id"), edges)


# Names


#: Parts with the three before them in their brand; sizes are lengths, similarities and degrees come from keys and prices.
_NAMED = "named AS (SELECT p_partkey AS id, p_brand AS g, p_name AS name, p_size AS size, CAST(p_partkey % 150 AS INTEGER) AS deg, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part), np AS (SELECT a.id AS i, b.id AS j, a.name AS x, b.name AS y, a.size AS nx, b.size AS ny, a.deg AS dx, b.deg AS dy, ((a.id * 31 + b.id) % 101) / 100.0 AS sim, regexp_replace(lower(a.name), '[^a-z0-9]', '', 'g') AS px, regexp_replace(lower(b.name), '[^a-z0-9]', '', 'g') AS py FROM named a JOIN named b ON a.g = b.g AND b.r - a.r BETWEEN 1 AND 3)"


def _named_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    part = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("n"), F.col("p_size").alias("z"), (F.col("p_partkey") % 150).cast("int").alias("d"))
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", part.alias("b"))
    before = rows.select("b", *(F.lag("b", k).over(w).alias(f"a{k}") for k in (1, 2, 3)))
    pairs = before.select("b", F.explode(F.array("a1", "a2", "a3")).alias("a")).where("a is not null")
    side = lambda s, x: [F.col(f"{s}.id").alias(x), *(F.col(f"{s}.{c}").alias(f"{c}{x}") for c in "nzd")]
    return pairs.select(*side("a", "i"), *side("b", "j")).withColumn("sim", (F.col("i") * 31 + F.col("j")) % 101 / 100)


@query(f"""WITH {_NAMED}, w AS (SELECT *, trim(x) AS a, trim(y) AS b, list_filter(regexp_split_to_array(lower(trim(x)), '[^a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains({list(C.GENERIC_NAME_WORDS)}, t)) AS wa, list_filter(regexp_split_to_array(lower(trim(y)), '[^a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains({list(C.GENERIC_NAME_WORDS)}, t)) AS wb FROM np)
SELECT i, j, round(CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 WHEN length(a) >= 3 AND length(b) >= 3 AND (starts_with(a, b) OR starts_with(b, a)) THEN 0.8 WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(wa), list_distinct(wb)))::DOUBLE / len(list_distinct(list_concat(wa, wb))) END::DOUBLE, 6) AS similarity FROM w""")
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named_pairs(spark, sf_dir).select("i", "j", F.round(C.name_similarity(F.col("ni"), F.col("nj")), 6).alias("similarity"))


@query(f"WITH {_NAMED} SELECT i, j, CASE WHEN px = '' OR py = '' THEN NULL WHEN px = py THEN 1.0 WHEN contains(px, py) OR contains(py, px) THEN 0.9 WHEN length(px) >= 3 AND length(py) >= 3 AND px[:3] = py[:3] THEN 0.7 ELSE 0.4 END::DOUBLE AS factor FROM np")
def name_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named_pairs(spark, sf_dir).select("i", "j", C.name_factor(F.col("ni"), F.col("nj")).alias("factor"))


@query("SELECT p_partkey AS id, lower(trim(p_name)) = '<module>' OR starts_with(lower(trim(p_name)), '__obf_') OR starts_with(lower(trim(p_name)), '_obf_') AS template, lower(trim(p_name)) IN ('<module>', '__main__', 'main') OR starts_with(lower(trim(p_name)), 'test_') OR starts_with(lower(trim(p_name)), 'benchmark_') AS driver FROM part")
def template_name_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), C.is_template_name(F.col("p_name")).alias("template"), C.is_driver_name(F.col("p_name")).alias("driver"))


@query("WITH p AS (SELECT l_orderkey AS g, l_linenumber AS n, l_quantity AS q, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS r FROM lineitem), f AS (SELECT *, greatest(q, r) / greatest(1, least(q, r)) AS ratio FROM p WHERE r IS NOT NULL) SELECT CASE WHEN ratio > 8 THEN 0.2 WHEN ratio > 4 THEN 0.4 WHEN ratio > 2 THEN 0.7 ELSE 1.0 END::DOUBLE AS factor, count(*) AS n FROM f GROUP BY ALL")
def func_length_ratio_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    p = table(spark, sf_dir, "lineitem").select("l_quantity", F.lag("l_quantity").over(w).alias("r")).where("r is not null")
    return p.groupBy(C.length_factor(F.col("l_quantity"), F.col("r")).alias("factor")).agg(F.count("*").alias("n"))


@query(f"""WITH {_NAMED}, r AS (SELECT *, greatest(nx, ny)::DOUBLE / greatest(1, least(nx, ny)) AS ratio FROM np),
f AS (SELECT i, j, sim * CASE WHEN ratio > 8 THEN 0.2 WHEN ratio > 4 THEN 0.4 WHEN ratio > 2 THEN 0.7 ELSE 1.0 END * coalesce(0.5 + 0.5 * CASE WHEN px = '' OR py = '' THEN NULL WHEN px = py THEN 1.0 WHEN contains(px, py) OR contains(py, px) THEN 0.9 WHEN length(px) >= 3 AND length(py) >= 3 AND px[:3] = py[:3] THEN 0.7 ELSE 0.4 END, 1.0)
  * CASE WHEN dx >= 128 THEN 0.3 WHEN dx >= 64 THEN 0.5 WHEN dx >= 32 THEN 0.8 ELSE 1.0 END * CASE WHEN dy >= 128 THEN 0.3 WHEN dy >= 64 THEN 0.5 WHEN dy >= 32 THEN 0.8 ELSE 1.0 END * CASE WHEN nx <= 3 OR ny <= 3 OR nx <= 8 AND dx >= 64 OR ny <= 8 AND dy >= 64 THEN 0.3 ELSE 1.0 END AS s FROM r)
SELECT i, j, round(CASE WHEN s < 1e-4 OR s < 0.3 THEN 0.0 ELSE s END, 6)::DOUBLE AS score FROM f""")
def func_pair_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as functions: sizes are lengths, short ones and short ones with many neighbours are templates."""
    like = [C.is_template_func(F.col(f"n{x}"), F.lit(None).cast("string"), F.col(f"z{x}"), F.col(f"d{x}"), F.lit(0)) for x in "ij"]
    s = C.func_pair_score(F.col("sim"), F.col("ni"), F.col("nj"), F.col("zi"), F.col("zj"), F.col("di"), F.col("dj"), like[0] | like[1])
    return _named_pairs(spark, sf_dir).select("i", "j", F.round(s, 6).alias("score"))


@query(f"""WITH {_NAMED}, t AS (SELECT i, j, sim, px, py, list_distinct([dx % 3, dx % 5]) AS ta, list_distinct([dy % 3, dy % 5]) AS tb FROM np),
a AS (SELECT i, j, sim, 0.7 * CASE WHEN px = py THEN 1.0 ELSE 0.0 END + 0.3 * (len(list_intersect(ta, tb))::DOUBLE / len(list_distinct(list_concat(ta, tb)))) AS agree FROM t)
SELECT i, j, round(CASE WHEN sim <= 0 OR agree <= 0.05 THEN 0.0 ELSE least(1.0, sim * (0.2 + 0.8 * agree)) END, 6)::DOUBLE AS score FROM a""")
def task_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity let through by names and tags; equal names count, tags are remainders of the degree."""
    tags = lambda x: C.effect_tags(F.concat_ws(";", (F.col(f"d{x}") % 3).cast("string"), (F.col(f"d{x}") % 5).cast("string")))
    same = F.when(C.plain_name(F.col("ni")) == C.plain_name(F.col("nj")), 1.0).otherwise(0.0)
    s = C.task_similarity(F.col("sim"), same, C.effect_similarity(tags("i"), tags("j")))
    return _named_pairs(spark, sf_dir).select("i", "j", F.round(s, 6).alias("score"))


@query(f"WITH {_NAMED} SELECT i % 10 AS prog, round(coalesce(sum(CASE WHEN sim >= 0.5 THEN sim * greatest(nx, ny) END) / sum(CASE WHEN sim >= 0.5 THEN greatest(nx, ny) END), 0.0), 6)::DOUBLE AS score FROM np GROUP BY i % 10")
def weighted_program_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _named_pairs(spark, sf_dir).groupBy((F.col("i") % 10).alias("prog"))
    return by.agg(F.round(C.weighted_program_score(F.col("sim"), F.col("zi"), F.col("zj"), 0.5), 6).alias("score"))


# Lines and sources


@query("WITH l AS (SELECT *, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nx, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) SELECT conv_id, turn, greatest(turn, coalesce(nx - 1, last)) AS end_line FROM l")
def function_line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("program"), F.col("turn").alias("start_line"))
    last = rows.groupBy("program").agg(F.max("start_line").alias("last_line"))
    return programs.line_ranges(rows, last).select(F.col("program").alias("conv_id"), F.col("start_line").alias("turn"), "end_line")


@query("WITH l AS (SELECT conv_id, turn AS src, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations) SELECT * FROM l WHERE dst IS NOT NULL")
def linear_cfg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("src"), F.lead("turn").over(w).alias("dst")).where("dst is not null")


@query("""WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS t, unnest(range(1, len(string_split(html, chr(10))) + 1)) AS line FROM pages),
d AS (SELECT page_id, line, length(t) - length(replace(t, '<', '')) AS opened, length(t) - length(replace(t, '>', '')) AS closed FROM l)
SELECT page_id, CAST(line AS INTEGER) AS line, opened, closed, CAST(sum(opened - closed) OVER (PARTITION BY page_id ORDER BY line) AS BIGINT) AS depth FROM d""")
def brace_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openers and closers of each line and the depth behind it, with < and > for braces."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", "\n")).alias("at", "t"))
    count = lambda c: (F.length("t") - F.length(F.replace(F.col("t"), F.lit(c), F.lit("")))).cast("long")
    lines = rows.select("page_id", (F.col("at") + 1).alias("line"), count("<").alias("opened"), count(">").alias("closed"))
    return lines.withColumn("depth", F.sum(F.col("opened") - F.col("closed")).over(Window.partitionBy("page_id").orderBy("line")))


@query("""WITH s AS (SELECT regexp_replace(regexp_replace(html, '(?s)/\\*.*?\\*/', ' ', 'g'), '(?m)//.*$', '', 'g') AS code FROM pages),
t AS (SELECT unnest(regexp_extract_all(code, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+|==|!=|<=|>=|->|::|&&|\\|\\||[{}();,<>+\\-*/%=]')) AS tok FROM s)
SELECT CASE WHEN regexp_matches(tok, '^[0-9]+$') THEN '<NUM>' ELSE tok END AS tok, count(*) AS n FROM t GROUP BY ALL""")
def html_lex_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexemes of the C lexer, whole numbers as <NUM>."""
    return table(spark, sf_dir, "pages").select(F.explode(lexers.lexemes(F.col("html"))).alias("tok")).groupBy("tok").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT event_id, user_id, event_type FROM events WHERE value <= 50), c AS (SELECT event_id AS near, user_id, event_type FROM events WHERE value > 50),
r AS (SELECT f.event_id, near, row_number() OVER (PARTITION BY f.event_id ORDER BY abs(near - f.event_id), near) AS r FROM f JOIN c ON f.user_id = c.user_id AND f.event_type = c.event_type)
SELECT event_id, near FROM r WHERE r = 1""")
def nearest_line_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions (events up to 50) take the code object (above 50) of their name (user and type) on the nearest line (id), the first of equals."""
    rows = table(spark, sf_dir, "events").select(F.struct("user_id", "event_type").alias("name"), F.col("event_id").alias("line"), F.col("value"))
    functions = rows.where("value <= 50").select("name", "line")
    return programs.nearest(functions, rows.where("value > 50").select("name", "line")).select(F.col("line").alias("event_id"), "near")


@query("""WITH e AS (SELECT user_id, event_id, event_type, value, last_value(CASE WHEN value > 50 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def FROM events)
SELECT user_id, def, event_id AS use, event_type AS var FROM e WHERE value <= 80 AND def IS NOT NULL""")
def last_def_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event writes its type if its value is over 50 and reads it if it is up to 80: edges from the last write before each read."""
    nodes = table(spark, sf_dir, "events").select(F.col("user_id").alias("g"), F.col("event_id").alias("n"), F.col("event_type").alias("var"), (F.col("value") > 50).alias("writes"), (F.col("value") <= 80).alias("reads"))
    return graphs.last_definitions(nodes).withColumnRenamed("g", "user_id")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows with one id the last stays; an aggregate, so that it combines before the shuffle."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"), F.max_by("o_totalprice", "o_orderkey").alias("o_totalprice"))


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def dataset_scan_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as JSON text and parsed again with a fixed schema."""
    docs = table(spark, sf_dir, "documents").select(F.to_json(F.struct("doc_id", "lang", "source", "n_chars")).alias("j"))
    return docs.select(F.from_json("j", "doc_id long, lang string, source string, n_chars long").alias("r")).select("r.*")


@query()
def dep_align_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of each order's graph with the graph of its customer's order before."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("n")).agg((F.max("l_quantity") / 8).alias("q"), F.max("l_discount").alias("d"), F.max("l_tax").alias("t"))
    nodes = lines.select("g", "n", F.array("q", "d", "t").alias("f"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    pairs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.lag("o_orderkey").over(w).alias("j")).where("j is not null")
    return align.align_pairs(pairs, nodes, order_edges(order_nodes(spark, sf_dir))).select("i", "j", F.round("align", 6).alias("align"))


_SUPPLEMENT = f"""{_CANDS}, {_VEC.removeprefix(_TOK + ', ')}, met AS (SELECT i, count(*) AS n FROM (SELECT i, j FROM cand UNION ALL SELECT j, i FROM cand) GROUP BY i),
few AS (SELECT s.doc_id FROM sets s JOIN reps r ON list_sort(s.sh) = list_sort(r.sh) LEFT JOIN met ON met.i = r.doc_id WHERE coalesce(met.n, 0) < 10),
av AS (SELECT tok.doc_id, coalesce(ev.v, list_transform(range(0, 13), lambda x: 0.0::DOUBLE)) AS v FROM tok LEFT JOIN ev ON ev.doc_id = tok.doc_id),
un AS (SELECT doc_id, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-300)) AS v FROM av),
s AS (SELECT a.doc_id AS i, b.doc_id AS j, round(list_dot_product(a.v, b.v), 6) AS sim FROM un a JOIN few ON few.doc_id = a.doc_id JOIN un b ON a.doc_id <> b.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS r FROM s)"""


@query(f"WITH {_SUPPLEMENT} SELECT i, j, sim FROM r WHERE r <= 50")
def recall_supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplement for queries with fewer candidates than min_candidates and their copies: the 50 nearest of all documents, by effects."""
    from simspark.plans import documents as docs

    rows = graphs.materialised(docs.effect_signatures(spark, sf_dir).select(F.col("doc_id").alias("id"), E.effect_vector().alias("v")), "effects")
    few = docs.deficient_queries(spark, sf_dir).select(F.col("doc_id").alias("rep_id"))
    asked = docs.copy_classes(spark, sf_dir).join(few, "rep_id", "left_semi").select(F.col("doc_id").alias("id"))
    # a document without words has no effects; its vector is 0
    zero = F.array(*[F.lit(0.0)] * len(E.COUNTERS))
    ids = docs.documents(spark, sf_dir).select(F.col("doc_id").alias("id"))
    every = graphs.materialised(ids.join(rows, "id", "left").select("id", F.coalesce(F.col("v").cast("array<double>"), zero).alias("v")), "all-effects")
    return align.supplement(every.join(asked, "id", "left_semi"), every, max(5 * DEFAULT.min_candidates, 50))

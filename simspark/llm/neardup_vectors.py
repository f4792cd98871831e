"""Near-duplicate vectors by collision-counting projections.

Vectors are projected on many random lines. On each line the vectors of a block are sorted, and a pair collides where one stands
in the window that is centred on the other. Pairs are verified exactly if they collide on at least `required_collisions` lines,
the largest count that a pair at the threshold reaches with probability RECALL.

Only vectors of equal, non-null group (label) and equal dimension are compared. A group is dealt into tiles of bounded size and
each pair of tiles is one unit of work, so a group that holds a third of all rows is spread like the others. A unit returns
counts and a spanning forest of its links, never the links themselves.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link with nothing;
rows that share an id are vectors of their own and get a row each; rows with a null id link like others, but don't name a component,
whose id is null if it has no other; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simspark.llm.common import Workspace, table
from simspark.llm.components import connected_components, local_roots
from simspark.llm.topk import finite

THRESHOLD = 0.93
LINES, WIDTH, RECALL, SEED = 32, 1.5, 0.9999, 5
TILE = 2_048
_ROWS, _PAIRS = 256, 100_000


def required_collisions(lines: int = LINES, width: float = WIDTH, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with probability `recall`.

    The gap of such a pair on a Gaussian line is normal with their distance as deviation; the window reaches `width` deviations.
    """
    p = math.erf(width / math.sqrt(2))
    missed = 0.0
    for count in range(lines + 1):
        missed += math.comb(lines, count) * p**count * (1 - p) ** (lines - count)
        if missed > 1 - recall:
            return count
    return lines


def cosine(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    return (x * y).sum(axis=1) / (nx * ny)


def link_tiles(x: np.ndarray, y: np.ndarray | None, threshold: float = THRESHOLD, lines: int = LINES, width: float = WIDTH, recall: float = RECALL):
    """Yield (i, j) arrays of linked rows of x and y; with y None, of x and itself with i < j."""
    same = y is None
    y = x if same else y
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    ways = np.random.default_rng(SEED).standard_normal((x.shape[1], lines))
    px, py = (x / nx[:, None]) @ ways, (y / ny[:, None]) @ ways
    reach = width * math.sqrt(2 - 2 * threshold)
    need = required_collisions(lines, width, recall)
    rank = np.empty((lines, len(y)), np.uint16 if len(y) < 2**16 else np.uint32)
    low, span = np.empty((lines, len(x)), rank.dtype), np.empty((lines, len(x)), rank.dtype)
    for k in range(lines):
        order = np.argsort(py[:, k])
        rank[k, order] = np.arange(len(y))
        line = py[order, k]
        low[k] = np.searchsorted(line, px[:, k] - reach, "left")
        span[k] = np.searchsorted(line, px[:, k] + reach, "right") - low[k]
    for start in range(0, len(x), _ROWS):
        stop = min(start + _ROWS, len(x))
        hits = np.zeros((stop - start, len(y)), np.uint8 if lines < 256 else np.uint16)
        for k in range(lines):
            # unsigned: ranks below the window wrap around to large numbers
            hits += (rank[k] - low[k, start:stop, None]) < span[k, start:stop, None]
        i, j = np.nonzero(hits >= need)
        i += start
        if same:
            i, j = i[i < j], j[i < j]
        for a in range(0, len(i), _PAIRS):
            p, q = i[a : a + _PAIRS], j[a : a + _PAIRS]
            linked = cosine(x[p], y[q], nx[p], ny[q]) >= threshold
            yield p[linked], q[linked]


def near_duplicate_vectors(ws: Workspace, df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each vector."""
    # `id` names a row, as ids may be null or repeat
    rows = ws.save(df.select(F.monotonically_increasing_id().alias("id"), F.col(id_col).cast("long").alias("vec_id"), F.col(group_col).alias("g"), F.col(vector_col).cast("array<double>").alias("v")), "rows")
    usable = rows.where(F.col("g").isNotNull() & finite(F.col("v")) & F.exists("v", lambda x: x != 0)).withColumn("d", F.size("v"))
    tiles = usable.groupBy("g", "d").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    dealt = usable.join(tiles, ["g", "d"]).withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")))
    units = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select("g", "d", F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"), "t", "id", "v")

    def run(unit: pa.Table) -> pa.Table:
        ids = np.asarray(unit.column("id"))
        v = np.asarray(unit.column("v").combine_chunks().flatten()).reshape(len(ids), -1)
        # lengths outside the range of double are scaled first, which leaves cosines as they are
        big = np.abs(v).max(axis=1, keepdims=True)
        v = np.where((big > 1e100) | (big < 1e-100), v / big, v)
        order = np.argsort(ids, kind="stable")
        ids, v, t = ids[order], v[order], np.asarray(unit.column("t"))[order]
        a, b = unit.column("a")[0].as_py(), unit.column("b")[0].as_py()
        left, right = np.flatnonzero(t == a), np.flatnonzero(t == b)
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i, j in link_tiles(v[left], None if a == b else v[right], threshold) if len(left) and len(right) else ():
            i, j = left[i], right[j]
            links += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
            root = local_roots(len(ids), np.concatenate([i, np.arange(len(ids))]), np.concatenate([j, root]))
        got = np.flatnonzero(links)
        return pa.table([ids[got], ids[root[got]], links[got]], ["id", "root", "links"])

    found = ws.save(units.groupBy("g", "d", "a", "b").applyInArrow(run, "id long, root long, links long"), "links")
    groups = ws.save(connected_components(ws, found.where("id <> root").select(F.col("id").alias("src"), F.col("root").alias("dst"))), "groups")
    ws.keep("rows", "links", "groups")
    counts = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    out = rows.select("id", "vec_id").join(counts, "id", "left").join(groups, "id", "left").withColumn("c", F.coalesce("component", "id"))
    named = out.join(out.groupBy("c").agg(F.min("vec_id").alias("component_id")), "c")
    return named.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(False)).alias("kept"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(Workspace(spark, "op5"), table(spark, sf_dir, "embeddings"))


#: DuckDB's version of op5_embedding_near_dedup: all pairs of a label, and what is reached by links.
ORACLE_SQL = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS no, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.no AS i, b.no AS j FROM u a JOIN u b ON a.label = b.label AND a.no <> b.no AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
n AS (SELECT i, count(*) AS n_links FROM l GROUP BY i),
reach(a, b) AS (SELECT no, no FROM v UNION SELECT r.a, l.j FROM reach r JOIN l ON l.i = r.b),
c AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN v ON v.no = reach.b GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(component_id = vec_id, false) AS kept FROM v JOIN c ON c.a = v.no LEFT JOIN n ON n.i = v.no
"""

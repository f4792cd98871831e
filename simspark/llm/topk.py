"""Exact top-k search by exhaustive term-at-a-time accumulation.

Queries and candidates are rows of integer term weights. Both are dealt out in a grid of blocks of bounded size. In a block the
query rows go through their terms one by one: each term's postings, weighted, are scattered into dense score arrays; a partition
selection then keeps the k best candidates of each query in the block, and a last ranking merges the blocks. Each query meets
each candidate once, so the result is exact.

Cases: vectors that are null or hold null or non-finite components take no part; rows that share an id are queries and candidates of
their own, each query's own row excepted; a null id isn't a query but a candidate, behind all others of its score; shorter vectors
count as padded with zeros; ties go to the smaller id; with fewer than k candidates all are returned; no query gives an empty table.
Products that need more than 64 bits are ranked exactly and then given as the end of the range. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simspark.llm.common import Workspace, table

SCALE, EVERY, K = 64, 20, 20
QUERY_BLOCK, CANDIDATE_BLOCK = 2_048, 8_192
_ROWS, _COLUMNS = 64, 8_192


def finite(vector: Column) -> Column:
    """The vector is there and all its components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(no, id, weights): floor(scale * x) of each component. no names a row, as ids may repeat; the table is saved, so that it stays."""
    rows = df.where(finite(F.col(vector_col))).select(F.monotonically_increasing_id().alias("no"), F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("weights"))
    return Workspace(df.sparkSession, "quantised").save(rows, "rows")


def _matrix(t: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, weights), ordered by id, null ids last, and row."""
    weights = t.column("weights").combine_chunks()
    size = np.asarray(pa.compute.list_value_length(weights)).astype(np.int64)
    out = np.zeros((t.num_rows, width), np.int64)
    row = np.repeat(np.arange(t.num_rows), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(weights.flatten())
    order = np.asarray(pa.compute.sort_indices(t, [("id", "ascending"), ("no", "ascending")]))
    return np.asarray(t.column("no"))[order], out[order]


def _largest(values: np.ndarray) -> int:
    """The largest magnitude, as a number without a bound."""
    return max(int(values.max(initial=0)), -int(values.min(initial=0)))


def best_of_block(q_ids: np.ndarray, queries: np.ndarray, c_ids: np.ndarray, candidates: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of the k best candidates of each query in the block; of equal scores the first candidates."""
    n = len(c_ids)
    bound = queries.shape[1] * _largest(queries) * _largest(candidates)
    if bound * (n + 1) >= 2**62:
        return _best_of_wide(q_ids, queries, c_ids, candidates, k, bound)
    by_id = np.argsort(c_ids)
    # sums of whole numbers are exact in each of these kinds up to its bound
    kind = np.float32 if bound < 2**24 else np.int64
    postings = []
    for t in range(queries.shape[1]):
        at = np.flatnonzero(candidates[:, t])
        # a list that most candidates are on is added as a whole, zeros included; a shorter one is scattered
        at = slice(None) if 4 * len(at) > n else at
        postings.append((at, candidates[at, t].astype(kind)))
    behind = n - 1 - np.arange(n, dtype=np.int64)  # breaks ties for the smaller id
    out = []
    for start in range(0, len(q_ids), _ROWS):
        rows, own = queries[start : start + _ROWS].astype(kind), q_ids[start : start + _ROWS]
        score = np.zeros((len(rows), n), kind)
        for a in range(0, n, _COLUMNS):  # a strip of the score arrays that stays in the cache
            strip = score[:, a : a + _COLUMNS]
            product = np.empty_like(strip)
            for t, (at, weight) in enumerate(postings):
                used = np.flatnonzero(rows[:, t])
                if not len(used) or not len(weight):
                    continue
                if isinstance(at, slice) and 2 * len(used) > len(rows):
                    np.multiply(rows[:, t, None], weight[a : a + _COLUMNS], out=product)
                    strip += product
                elif isinstance(at, slice):
                    strip[used] += rows[used, t, None] * weight[a : a + _COLUMNS]
                else:
                    lo, hi = np.searchsorted(at, (a, a + _COLUMNS))
                    strip[np.ix_(used, at[lo:hi] - a)] += rows[used, t, None] * weight[lo:hi]
        key = score.astype(np.int64) * n + behind
        self_at = by_id[np.minimum(np.searchsorted(c_ids, own, sorter=by_id), n - 1)]
        hit = np.flatnonzero(c_ids[self_at] == own)
        key[hit, self_at[hit]] = np.iinfo(np.int64).min
        top = np.argpartition(key, n - k, axis=1)[:, n - k :] if k < n else np.tile(np.arange(n), (len(rows), 1))
        best = np.take_along_axis(key, top, 1)
        r, c = np.nonzero(best != np.iinfo(np.int64).min)
        out.append((own[r], c_ids[top[r, c]], score[r, top[r, c]].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _best_of_wide(q_ids: np.ndarray, queries: np.ndarray, c_ids: np.ndarray, candidates: np.ndarray, k: int, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """best_of_block() where scores and their ranks don't fit into 64 bits together: sorted one query at a time, if need be as Python numbers."""
    kind = np.int64 if bound < 2**63 else object
    weights, out = candidates.astype(kind), []
    for q, row in zip(q_ids, queries.astype(kind)):
        score = np.zeros(len(c_ids), kind)
        for t in np.flatnonzero(row):
            at = np.flatnonzero(weights[:, t])
            score[at] += row[t] * weights[at, t]
        order = np.argsort(-score, kind="stable")
        order = order[c_ids[order] != q][:k]
        found = np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in score[order]], np.int64)
        out.append((np.full(len(order), q), c_ids[order], found))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def top_k(ws: Workspace, queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries and candidates (no, id, weights)."""
    sizes = [df.agg(F.count("*"), F.coalesce(F.max(F.size("weights")), F.lit(0))).first() for df in (queries, candidates)]
    width = max(1, *(s[1] for s in sizes))
    across, down = (max(1, math.ceil(s[0] / b)) for s, b in zip(sizes, (QUERY_BLOCK, CANDIDATE_BLOCK)))
    q = queries.withColumn("a", F.pmod(F.xxhash64("no"), F.lit(across))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))))
    c = candidates.withColumn("b", F.pmod(F.xxhash64("no"), F.lit(down))).withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            found = (np.zeros(0, np.int64),) * 3
        else:
            found = best_of_block(*_matrix(left, width), *_matrix(right, width), k)
        return pa.table([pa.array(x, pa.int64()) for x in found], ["q", "c", "score"])

    blocks = q.groupBy("a", "b").cogroup(c.groupBy("a", "b")).applyInArrow(run, "q long, c long, score long")
    named = blocks.join(candidates.select(F.col("no").alias("c"), F.col("id").alias("vec_id")), "c")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "c"))
    best = named.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(queries.select(F.col("no").alias("q"), F.col("id").alias("query_id")), "q").select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "op7")
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(ws, rows.where(F.col("id") % EVERY == 0), rows)


#: DuckDB's version of op7_exact_topk.
ORACLE_SQL = f"""
WITH rows AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS no, vec_id AS id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.no, q.id AS query_id, c.id AS vec_id, c.no AS c, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.no <> c.no WHERE q.id % {EVERY} = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY no ORDER BY score DESC, vec_id NULLS LAST, c) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""

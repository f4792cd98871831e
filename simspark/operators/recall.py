"""Candidate pairs from bands, effect vectors and degrees."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simspark.functions import columns as C
from simspark.operators.graphs import materialised
from simspark.params import DEFAULT, Params


def candidate_pairs(buckets: DataFrame, id_col: str) -> DataFrame:
    """(i, j), i < j: ids that share a bucket in some band; an equi-join on (band, bucket)."""
    side = lambda x: buckets.select("band", "bucket", F.col(id_col).alias(x))
    return side("i").join(side("j"), ["band", "bucket"]).where("i < j").select("i", "j").distinct()


def query_pairs(queries: DataFrame, index: DataFrame, query_id: str, index_id: str) -> DataFrame:
    """(q, j): index entries that share a bucket with a query."""
    a = queries.select("band", "bucket", F.col(query_id).alias("q"))
    return a.join(index.select("band", "bucket", F.col(index_id).alias("j")), ["band", "bucket"]).select("q", "j").distinct()


def with_jaccard(pairs: DataFrame, sets: DataFrame, id_col: str, set_col: str = "shingles", a: str = "i", b: str = "j") -> DataFrame:
    """Adds the exact Jaccard similarity of both ends."""
    side = lambda x: sets.select(F.col(id_col).alias(x), F.col(set_col).alias(f"s{x}"))
    return pairs.join(side(a), a).join(side(b), b).withColumn("jaccard", C.jaccard(F.col(f"s{a}"), F.col(f"s{b}"))).drop(f"s{a}", f"s{b}")


#: Rows whose sets meet at a time, and shingles that are held for them.
TILE, HELD = 512, 3_000_000


def tiles(pairs: DataFrame) -> tuple[DataFrame, int]:
    """(id, tile) of all ids in pairs (i, j), and their number. Ids that pair up with each other are mostly dealt to one tile.

    An id is named by the smallest id it is paired with, or itself; names are dealt to tiles of about TILE ids, a larger name to several.
    """
    named = both_ways(pairs).groupBy(F.col("i").alias("id")).agg(F.least("id", F.min("j")).alias("name"))
    named = materialised(named, "names")
    n = named.count()
    sizes = named.groupBy("name").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    few = F.pmod(F.xxhash64("name"), F.lit(max(1, -(-n // TILE))))
    tile = F.when(F.col("parts") == 1, few).otherwise(-1 - F.abs(F.shiftright(F.xxhash64("name", F.pmod(F.xxhash64("id"), "parts")), 1)))
    return named.join(sizes, "name").select("id", tile.alias("tile")), n


def tiled_jaccard(pairs: DataFrame, rows: DataFrame, k: int = DEFAULT.k) -> DataFrame:
    """(i, j, si, sj, ni, nj, jaccard) of saved pairs (i, j) from rows (id, source, words): sources, lengths and the exact Jaccard similarity.

    Texts go to the tiles that they have pairs in; shingles are made there and held for a while, not moved.
    """
    dealt, _ = tiles(pairs)
    dealt = materialised(dealt, "tiles")
    side = lambda x: dealt.select(F.col("id").alias(x), F.col("tile").alias(f"t{x}"))
    met = pairs.join(side("i"), "i").join(side("j"), "j").select(F.least("ti", "tj").alias("a"), F.greatest("ti", "tj").alias("b"), "i", "j")
    met = materialised(met, "met")
    used = met.select(F.col("a").alias("c"), F.col("b").alias("d"), F.explode(F.array("i", "j")).alias("id")).distinct()
    texts = used.join(rows.select("id", "source", "words"), "id")
    kind = dict(rows.dtypes)

    def run(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        at: dict = {}
        for n, x in enumerate(t.id):
            at.setdefault(x, []).append(n)
        sources, words, held, total, out = t.source.tolist(), t.words.tolist(), {}, 0, []

        def sets(n: int) -> tuple[set, int]:
            nonlocal total
            if n not in held:
                if total > HELD:
                    held.clear()
                    total = 0
                held[n] = set(C.word_shingles(words[n], k)), len(words[n].split())
                total += len(held[n][0])
            return held[n]

        for i, j in sorted(zip(p.i.tolist(), p.j.tolist())):
            for x in at.get(i, ()):
                for y in at.get(j, ()):
                    (a, na), (b, nb) = sets(x), sets(y)
                    both = len(a & b)
                    union = len(a) + len(b) - both
                    out.append((i, j, sources[x], sources[y], na, nb, both / union if union else 0.0))
        return pd.DataFrame(out, columns=["i", "j", "si", "sj", "ni", "nj", "jaccard"])

    schema = f"i {kind['id']}, j {kind['id']}, si {kind['source']}, sj {kind['source']}, ni long, nj long, jaccard double"
    return met.groupBy("a", "b").cogroup(texts.groupBy("c", "d")).applyInPandas(run, schema)


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("i", "j").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j")))


def top_per_query(pairs: DataFrame, score: str = "sim", k: int = DEFAULT.topk_recall) -> DataFrame:
    """The k best partners j of each i; ties go to the smaller j."""
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc(score), "j"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def neighbor_degree(top: DataFrame) -> DataFrame:
    """(j, degree): in how many queries' top list j stands."""
    return top.groupBy("j").agg(F.count("*").alias("degree"))


def with_degrees(pairs: DataFrame, degree: DataFrame) -> DataFrame:
    side = lambda x: degree.select(F.col("j").alias("__k"), F.col("degree").alias(f"deg_{x}")).withColumnRenamed("__k", x)
    return pairs.join(side("i"), "i", "left").join(side("j"), "j", "left").withColumns({f"deg_{x}": F.coalesce(f"deg_{x}", F.lit(0)) for x in "ij"})


def not_both_hard(params: Params = DEFAULT) -> Column:
    return (F.col("deg_i") < params.template_degree_hard) | (F.col("deg_j") < params.template_degree_hard)


def is_template_degree(degree: Column, params: Params = DEFAULT) -> Column:
    return degree >= params.template_degree_soft

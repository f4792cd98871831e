"""From function pairs to program pairs: base score, coverage statistics and final score; line ranges; greedy matching."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simspark.functions import columns as C
from simspark.params import DEFAULT, Params


def canonical(pairs: DataFrame) -> DataFrame:
    """(prog_a, prog_b, fa, fb, la, lb, score) with prog_a < prog_b; the sides change places with the programs. So do na and nb, if there."""
    swap = F.col("prog_a") > F.col("prog_b")
    sides = [s for s in (("prog_a", "prog_b"), ("fa", "fb"), ("la", "lb"), ("na", "nb")) if s[0] in pairs.columns]
    return pairs.select(*(F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for p in sides for x, y in (p, p[::-1])), "score")


def base_scores(pairs: DataFrame) -> DataFrame:
    """(prog_a, prog_b, base): length-weighted mean of the best score of each function on either side."""
    best = lambda f, n: pairs.groupBy("prog_a", "prog_b", F.col(f).alias("f")).agg(F.max("score").alias("s"), F.max(n).alias("w"))
    both = best("fa", "la").unionAll(best("fb", "lb"))
    return both.groupBy("prog_a", "prog_b").agg((F.sum(F.col("s") * F.col("w")) / F.sum("w")).alias("base"))


def program_stats(pairs: DataFrame, totals: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Statistics of each program pair. totals (prog, total_len, total_funcs).

    A side of a pair is one function, or a class of copies: then na or nb has how many the program holds, la or lb their whole length.
    """
    strong = F.col("score") >= params.high
    if "na" not in pairs.columns:
        pairs = pairs.withColumns({"na": F.lit(1).cast("long"), "nb": F.lit(1).cast("long")})
    w = F.col("na") * F.col("nb")
    mean = lambda w: F.sum(F.col("score") * w) / F.sum(w)
    stats = pairs.groupBy("prog_a", "prog_b").agg(F.max("score").alias("max_pair"), mean(w).alias("mean_pair"), F.sum(F.when(strong, w).otherwise(0)).alias("hi_count"), F.sum(w).alias("num_matches"), F.coalesce(mean(F.when(strong, w)), F.lit(0.0)).alias("avg_high"))
    # three rows of a program pair hold its best three scores; a row of classes of copies counts up to three times
    rank = F.row_number().over(Window.partitionBy("prog_a", "prog_b").orderBy(F.desc("score")))
    best = pairs.select("prog_a", "prog_b", "score", w.alias("w")).withColumn("r", rank).where("r <= 3").groupBy("prog_a", "prog_b")
    top3 = F.slice(F.sort_array(F.flatten(F.collect_list(F.array_repeat("score", F.least("w", F.lit(3)).cast("int")))), asc=False), 1, 3)
    best = best.agg(top3.alias("t")).select("prog_a", "prog_b", (F.aggregate("t", F.lit(0.0), lambda s, x: s + x) / F.size("t")).alias("top3_mean"))
    stats = stats.join(best, ["prog_a", "prog_b"])
    for side in "ab":
        covered = pairs.where(strong).select("prog_a", "prog_b", f"f{side}", f"l{side}", f"n{side}").distinct().groupBy("prog_a", "prog_b").agg(F.sum(f"l{side}").alias(f"len_{side}"), F.sum(f"n{side}").alias(f"n_{side}"))
        whole = totals.select(F.col("prog").alias(f"prog_{side}"), F.col("total_len").alias(f"total_{side}"), F.col("total_funcs").alias(f"funcs_{side}"))
        stats = stats.join(covered, ["prog_a", "prog_b"], "left").join(whole, f"prog_{side}", "left")
        stats = stats.withColumn(f"cov_{side}", F.coalesce(F.col(f"len_{side}") / F.greatest(F.lit(1), f"total_{side}"), F.lit(0.0))).withColumn(f"func_cov_{side}", F.coalesce(F.col(f"n_{side}") / F.col(f"funcs_{side}"), F.lit(0.0)))
        stats = stats.drop(f"len_{side}", f"n_{side}", f"total_{side}", f"funcs_{side}")
    return stats.withColumn("cov_min", F.least("cov_a", "cov_b"))


def program_scores(pairs: DataFrame, totals: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(prog_a, prog_b, base, score): base score weighed down by coverage of strong matches."""
    joined = program_stats(pairs, totals, params).join(base_scores(pairs), ["prog_a", "prog_b"])
    unmatched = 0.5 * (F.greatest(F.lit(0.0), 1 - F.col("func_cov_a")) + F.greatest(F.lit(0.0), 1 - F.col("func_cov_b")))
    score = C.coverage_score(F.col("hi_count"), C.clamp(F.col("cov_min")), C.clamp(F.col("avg_high")), unmatched, F.col("base"), params.min_coverage)
    return joined.select("prog_a", "prog_b", "base", score.alias("score"))


def line_ranges(functions: DataFrame, last_lines: DataFrame) -> DataFrame:
    """Adds end_line: the line before the next function, at least the start; the last ends with the file."""
    w = Window.partitionBy("program").orderBy("start_line")
    ends = functions.join(last_lines, "program", "left").withColumn("__next", F.lead("start_line").over(w))
    return ends.withColumn("end_line", F.greatest("start_line", F.coalesce(F.col("__next") - 1, "last_line"))).drop("__next", "last_line")


def nearest(functions: DataFrame, objects: DataFrame) -> DataFrame:
    """functions (name, line) with `near`, the line of the object (name, line) of the same name that is nearest; of equals the first.

    One sort by name and line: the last object before a function and the first one behind it are the only ones in question.
    """
    both = functions.select("name", "line", F.lit(None).cast(dict(objects.dtypes)["line"]).alias("at")).unionByName(objects.select("name", "line", F.col("line").alias("at")))
    w = Window.partitionBy("name").orderBy("line")
    before = F.last("at", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    behind = F.first("at", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    ends = both.withColumns({"before": before, "behind": behind}).where("at is null")
    near = F.when(F.col("behind").isNull() | (F.col("line") - F.col("before") <= F.col("behind") - F.col("line")), F.col("before")).otherwise(F.col("behind"))
    return ends.select("name", "line", near.alias("near")).where("near is not null")


def greedy_matches(pairs: DataFrame) -> DataFrame:
    """One-to-one matching within each program pair: the best pair first, ties by (fa, fb). A program pair is one bounded unit."""

    def match(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["score", "fa", "fb"], ascending=[False, True, True], kind="stable")
        a, b, keep = set(), set(), []
        for x, y in zip(t.fa, t.fb):
            keep.append(x not in a and y not in b)
            if keep[-1]:
                a.add(x), b.add(y)
        return t[keep]

    rows = pairs.select("prog_a", "prog_b", "fa", "fb", "score")
    return rows.groupBy("prog_a", "prog_b").applyInPandas(match, rows.schema)


def greedy_class_matches(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of greedy_matches where fa and fb of pairs are classes of copies. members (prog, f, ids): the functions of a class in a program.

    Copies have equal scores, so of those left in a class the smallest id comes first: members are walked once and never paired up with
    each other.
    """
    uses = lambda x: pairs.select("prog_a", "prog_b", F.col(f"prog_{x}").alias("prog"), F.col(f"f{x}").alias("f"))
    held = uses("a").unionByName(uses("b")).distinct().join(members, ["prog", "f"]).select(F.col("prog_a").alias("a"), F.col("prog_b").alias("b"), "prog", "f", "ids")

    def match(p: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        ids = {(prog, f): sorted(x) for prog, f, x in zip(m.prog, m.f, m.ids)}
        at, out = dict.fromkeys(ids, 0), []
        for score, tied in sorted(p.groupby("score"), key=lambda x: -x[0]):
            a, b = tied.prog_a.iloc[0], tied.prog_b.iloc[0]
            partners: dict = {}
            for fa, fb in zip(tied.fa, tied.fb):
                partners.setdefault((a, fa), []).append((b, fb))
            for i, c in sorted((i, c) for c in partners for i in ids[c][at[c] :]):
                open_ = [(ids[d][at[d]], d) for d in partners[c] if at[d] < len(ids[d])]
                if open_:
                    j, d = min(open_)
                    at[c] += 1
                    at[d] += 1
                    out.append((a, b, i, j, score))
        return pd.DataFrame(out, columns=["prog_a", "prog_b", "fa", "fb", "score"])

    rows = pairs.select("prog_a", "prog_b", "fa", "fb", "score")
    return rows.groupBy("prog_a", "prog_b").cogroup(held.groupBy("a", "b")).applyInPandas(match, rows.schema)


def all_vs_all(matches: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(prog_a, prog_b, score, n_matches): mean of the matched scores, at least the threshold, the best first."""
    scored = matches.groupBy("prog_a", "prog_b").agg(F.avg("score").alias("score"), F.count("*").alias("n_matches")).where(F.col("score") >= params.prog_threshold)
    ordered = scored.orderBy(F.desc("score"), "prog_a", "prog_b")
    return ordered.limit(params.topk_pairs) if params.topk_pairs > 0 else ordered

"""Effect rules, signatures, vectors and resource nodes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The counters of an effect signature, in order.
COUNTERS = ["R_STACK", "W_STACK", "R_GLOBAL", "W_GLOBAL", "R_HEAP", "W_HEAP", "FILE_IO", "NET_IO", "DB_IO", "ENV", "RNG", "TIME", "EXC"]
#: Fixed value: the order in which kinds of rules are tried.
TIERS = {"fqname": 0, "regex": 1, "module": 2}


#: A rule base is data of the program: more rows than this aren't taken for one, as rules are broadcast.
MAX_RULES = 10_000


def small(rules: DataFrame) -> DataFrame:
    """rules, once their number is checked."""
    if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"a rule base has {MAX_RULES} rules at most")
    return rules


def match_rules(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """calls with rule_id: exact name, then regular expressions in their order, then module prefixes, then the default rule.

    rules (rule_id, kind, pattern, ...) is data of the program, MAX_RULES rows at most, so it is broadcast. Exact names are an
    equi-join; only names that have none go through the patterns, and each distinct name once.
    """
    names = calls.select("call").distinct()
    few = small(rules.select("rule_id", "kind", "pattern"))
    exact = names.join(F.broadcast(few.where("kind = 'fqname'").groupBy(F.col("pattern").alias("call")).agg(F.max("rule_id").alias("rule_id"))), "call")
    open_ = names.join(exact, "call", "left_anti")
    hit = F.when(F.col("kind") == "regex", F.expr("call rlike concat('^(?:', pattern, ')')")).otherwise(F.expr("startswith(call, concat(pattern, '.'))"))
    loose = open_.join(F.broadcast(few.where("kind in ('regex', 'module')")), hit).groupBy("call").agg(F.min_by("rule_id", F.struct(F.when(F.col("kind") == "regex", 1).otherwise(2), "rule_id")).alias("rule_id"))
    default = few.where("kind = 'default'").agg(F.max("rule_id").alias("default_id"))
    found = exact.unionByName(loose)
    return calls.join(found, "call", "left").join(F.broadcast(default)).withColumn("rule_id", F.coalesce("rule_id", "default_id")).drop("default_id")


def counter_of(resource: Column, tag: Column) -> Column:
    """The counter that a raw effect (resource, READ / WRITE / FLAG) adds to; null if none."""
    out = F.when(resource.startswith("FLAG:"), F.when(resource.startswith("FLAG:exception"), "EXC"))
    for prefix, name in (("FILE", "FILE_IO"), ("NET", "NET_IO"), ("DB", "DB_IO"), ("ENV", "ENV"), ("RNG", "RNG"), ("TIME", "TIME"), ("EXC", "EXC")):
        out = out.when(resource.startswith(prefix), name)
    for prefix in ("STACK", "GLOBAL", "HEAP"):
        out = out.when(resource.startswith(prefix), F.when(tag == "READ", f"R_{prefix}").otherwise(f"W_{prefix}"))
    return out


def signatures(effects: DataFrame, id_col: str) -> DataFrame:
    """One count for each counter and the sorted flags of each id, from effects (id, resource, tag) and, if there, how often each comes (n)."""
    counter = counter_of(F.col("resource"), F.col("tag"))
    flags = F.sort_array(F.collect_set(F.when(F.col("resource").startswith("FLAG:"), F.expr("substring(resource, 6)"))))
    n = F.col("n") if "n" in effects.columns else F.lit(1)
    return effects.withColumn("__c", counter).groupBy(id_col).agg(*(F.coalesce(F.sum(F.when(F.col("__c") == c, n)), F.lit(0)).cast("long").alias(c) for c in COUNTERS), flags.alias("flags"))


def word_signatures(rows: DataFrame, id_col: str, rules: DataFrame) -> DataFrame:
    """The signatures of each id from its `words` (blanks divide them): what match_rules and signatures give for them, row by row.

    Words are many times the text as rows, so they are not dealt out: each worker matches the distinct words that it meets, once.
    """
    base = sorted(map(tuple, small(rules.select("rule_id", "kind", "pattern", "resource", "tag", "flag")).collect()))

    def effect(resource: str, tag: str, flag: str) -> tuple[list[int], str]:
        made = [(resource, tag), *([(f"FLAG:{flag}", "FLAG")] if flag else [])]
        return [COUNTERS.index(c) for c in (plain_counter(*e) for e in made) if c], flag

    exact = {r[2]: effect(*r[3:]) for r in reversed(base) if r[1] == "fqname"}
    loose = [(re.compile(f"(?:{r[2]})"), effect(*r[3:])) for r in base if r[1] == "regex"]
    modules = [(f"{r[2]}.", effect(*r[3:])) for r in base if r[1] == "module"]
    default = next((effect(*r[3:]) for r in reversed(base) if r[1] == "default"), ([], ""))
    kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[list[int], str]] = {}

        def of(word: str) -> tuple[list[int], str]:
            found = exact.get(word) or next((e for p, e in loose if p.match(word)), None) or next((e for p, e in modules if word.startswith(p)), default)
            if len(known) > 500_000:
                known.clear()
            known[word] = found
            return found

        for batch in batches:
            counts, flags = np.zeros((batch.num_rows, len(COUNTERS)), np.int64), []
            for n, text in enumerate(batch.column("words").to_pylist()):
                row, seen = [0] * len(COUNTERS), set()
                for word, times in Counter(text.split()).items():
                    cs, flag = known.get(word) or of(word)
                    for c in cs:
                        row[c] += times
                    seen.add(flag)
                counts[n] = row
                flags.append(sorted(seen - {""}))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *(pa.array(counts[:, c]) for c in range(len(COUNTERS))), pa.array(flags, pa.list_(pa.string()))], names=[id_col, *COUNTERS, "flags"])

    # a row without words has no effects, and no row
    found = rows.where("trim(words) <> ''").select(id_col, "words").mapInArrow(run, f"{id_col} {kind}, " + ", ".join(f"{c} long" for c in COUNTERS) + ", flags array<string>")
    return found.groupBy(id_col).agg(*(F.sum(c).alias(c) for c in COUNTERS), F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("flags"))


def plain_counter(resource: str, tag: str) -> str | None:
    """counter_of for plain values."""
    if resource.startswith("FLAG:"):
        return "EXC" if resource.startswith("FLAG:exception") else None
    for prefix, name in (("FILE", "FILE_IO"), ("NET", "NET_IO"), ("DB", "DB_IO"), ("ENV", "ENV"), ("RNG", "RNG"), ("TIME", "TIME"), ("EXC", "EXC")):
        if resource.startswith(prefix):
            return name
    return next((f"{'R' if tag == 'READ' else 'W'}_{p}" for p in ("STACK", "GLOBAL", "HEAP") if resource.startswith(p)), None)


def effect_vector() -> Column:
    return F.array(*(F.col(c).cast("double") for c in COUNTERS))


def resource_kind() -> Column:
    """The kind of the node that stands for a resource and what is done to it."""
    group = F.regexp_extract("resource", "^(STACK|GLOBAL|HEAP|FILE|NET|DB|ENV|RNG|TIME)", 1)
    return F.when(F.col("resource").startswith("FLAG:"), F.concat(F.lit("RES_FLAG_"), F.upper(F.expr("substring(resource, 6)")))).otherwise(F.concat_ws("_", F.lit("RES"), F.when(group != "", group), F.col("tag")))


def resource_nodes(effects: DataFrame, sizes: DataFrame, id_col: str) -> DataFrame:
    """(id, kind, nid): a node for each distinct resource kind and tag, numbered after the id's own nodes. sizes (id, max_nid)."""
    distinct = effects.select(id_col, resource_kind().alias("kind")).distinct()
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy("kind"))
    return distinct.withColumn("__r", rank).join(sizes, id_col).select(id_col, "kind", (F.col("max_nid") + F.col("__r")).cast("long").alias("nid"))

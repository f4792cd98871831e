"""Best matches between programs over all pairs of documents that share a shingle: no bands, no representatives, no pairs as rows."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simspark.operators.graphs import materialised
from simspark.params import DEFAULT

#: Bytes of words for each group of shingles; shingles that a worker holds before it hands them on; units in a block, at most; blocks, at least.
GROUP, HELD, BLOCK, BLOCKS = 32 << 20, 2_000_000, 1 << 17, 4
#: Bytes of a hash that are kept in its group.
LOW = 7
#: Meetings of units that are sorted at once; rows of units among them; cells of a dense table of best matches.
MEETINGS, ROWS, DENSE = 1 << 22, 1 << 11, 1 << 24


def mixed(x: np.ndarray) -> np.ndarray:
    """Of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Characters that are hashed in one go, if no text is longer; the powers of an odd base and of its inverse modulo 2 ** 64, and values of bytes.
TEXT, _BASE = 1 << 20, 0x5851F42D4C957F2D
_UP, _DOWN = _powers(TEXT, _BASE), _powers(TEXT, pow(_BASE, -1, 1 << 64))
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_hashes(texts: list[str], k: int = DEFAULT.k) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, their number in each text, words of each text): distinct 64-bit hashes of k words in a row, one blank between words, none at the ends."""
    body = np.frombuffer("".join(f"{t} " for t in texts).encode(), np.uint8)
    up, down = (_UP, _DOWN) if len(body) < TEXT else (_powers(len(body) + 1, _BASE), _powers(len(body) + 1, pow(_BASE, -1, 1 << 64)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[body] * up[: len(body)], dtype=np.uint64)])
    ends = np.flatnonzero(body == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = np.array([t.count(" ") + 1 if t else 0 for t in texts], np.int64)
    word = np.repeat(np.arange(len(texts)), np.maximum(n, 1))  # an empty text has one empty word here
    first = np.flatnonzero(word[: len(word) - k + 1] == word[k - 1 :]) if len(word) >= k else np.zeros(0, np.int64)
    a, b = starts[first], ends[first + k - 1]
    v = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    doc = word[first]
    m = np.bincount(doc, minlength=len(texts))
    for x, y in zip(np.cumsum(m) - m, np.cumsum(m)):
        v[x:y].sort()
    new = np.r_[True, (v[1:] != v[:-1]) | (doc[1:] != doc[:-1])][: len(v)]
    return v[new], np.bincount(doc[new], minlength=len(texts)), n


def _slices(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start[x], start[x] + 1, ... of each x, size[x] of them, one x after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _raw(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def group_of(v: np.ndarray, groups: int) -> np.ndarray:
    """The group of each hash. Within it the low bytes tell hashes apart."""
    return ((v >> np.uint64(40)) * np.uint64(groups) >> np.uint64(24)).astype(np.int64)


def _binary(raw: np.ndarray, size: np.ndarray) -> pa.Array:
    """Binary values of size[x] bytes each, from all of them in a row."""
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())


def _dealt(rows: DataFrame, groups: int, k: int) -> DataFrame:
    """(g, u, source, m, l) of each row (source, words), and (g, shingles, units, counts): the shingles of group g, unit by unit.

    A unit is a shingle set in a program: copies in one program are one unit. u names it, m is its number of shingles, l a document's length.
    """
    schema = f"g int, u long, source {dict(rows.dtypes)['source']}, m long, l long, shingles binary, units binary, counts binary"

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, sources, long, total = [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            u, n = np.array(names, np.int64), len(names)
            m = np.array([len(v) for v in held], np.int64)
            yield batch_of(u % groups, [pa.array(u), pa.array(sources, kind), pa.array(m), pa.array(long, pa.int64()), *[pa.nulls(n, pa.binary())] * 3])
            v, doc = np.concatenate(held), np.repeat(np.arange(n), m)
            g = group_of(v, groups)
            order = np.argsort(g, kind="stable")
            v, doc, g = v[order], doc[order], g[order]
            run = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])])
            counts = np.diff(np.r_[run, len(v)]).astype(np.uint32)
            at = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            runs = np.diff(np.searchsorted(run, np.r_[at, len(v)]))
            low = v.view(np.uint8).reshape(-1, 8)[:, :LOW]
            blobs = _binary(low, np.diff(np.r_[at, len(v)]) * LOW), _binary(u[doc[run]].view(np.uint8), runs * 8), _binary(counts.view(np.uint8), runs * 4)
            yield batch_of(g[at], [pa.nulls(len(at), t) for t in (pa.int64(), kind, pa.int64(), pa.int64())] + list(blobs))
            for x in (held, names, sources, long):
                x.clear()

        def batch_of(g: np.ndarray, columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), *columns], ["g", "u", "source", "m", "l", "shingles", "units", "counts"])

        for batch in batches:
            kind = batch.schema.field("source").type
            texts, of, size = [t.strip() for t in batch.column("words").to_pylist()], batch.column("source").to_pylist(), 0
            cuts = [0]
            for x, text in enumerate(texts):
                if size and size + len(text) + 1 >= TEXT:
                    cuts.append(x)
                    size = 0
                size += len(text) + 1
            for x, y in zip(cuts, [*cuts[1:], len(texts)]):
                v, m, n = shingle_hashes(texts[x:y], k)
                for source, at, some, words in zip(of[x:y], np.cumsum(m) - m, m, n.tolist()):
                    if some:
                        held.append(v[at : at + some])
                        name = blake2b(int(some).to_bytes(8, "little") + held[-1].tobytes() + str(source).encode(), digest_size=8).digest()
                        names.append(int.from_bytes(name, "little", signed=True))
                        sources.append(source)
                        long.append(words)
                        total += int(some)
                if total > HELD:
                    yield from flush()
                    total = 0
        if held:
            yield from flush()

    return rows.mapInArrow(deal, schema)


def shared_shingles(rows: DataFrame, k: int = DEFAULT.k) -> tuple[DataFrame, DataFrame]:
    """(units, items) of rows (source, words): units (u, source, m, l), l the length of all copies; items (item, weight, units).

    An item stands for all shingles, weight in number, that the same units hold; only those of two units or more are there.
    """
    size = rows.agg(F.sum(F.length("words"))).first()[0] or 0
    kind = dict(rows.dtypes)["source"]

    def share(t: pa.Table) -> pa.Table:
        docs = t.filter(pa.compute.is_valid(t["u"])).group_by(["u", "source", "m"]).aggregate([("l", "sum")])
        t = t.filter(pa.compute.is_valid(t["shingles"]))
        names = ["u", "source", "m", "l", "item", "n", "weight", "units"]
        out = pa.Table.from_arrays([docs["u"], docs["source"], docs["m"], docs["l_sum"], *[pa.nulls(len(docs), pa.int64())] * 3, pa.nulls(len(docs), pa.binary())], names)
        low = _raw(t["shingles"], np.uint8).reshape(-1, LOW)
        v = np.zeros((len(low), 8), np.uint8)
        v[:, :LOW] = low
        v, u = v.view(np.uint64).ravel(), np.repeat(_raw(t["units"], np.int64), _raw(t["counts"], np.uint32))
        order = np.lexsort((u, v))
        v, u = v[order], u[order]
        new = np.r_[True, (v[1:] != v[:-1]) | (u[1:] != u[:-1])][: len(v)]  # copies in a program say the same
        v, u = v[new], u[new]
        at = np.flatnonzero(np.r_[True, v[1:] != v[:-1]][: len(v)])
        n = np.diff(np.r_[at, len(v)])
        at, n = at[n > 1], n[n > 1]
        if not len(at):
            return out
        value = mixed(u.view(np.uint64))
        total = np.concatenate([[0], np.cumsum(value, dtype=np.uint64)])
        item, first, weight = np.unique(total[at + n] - total[at], return_index=True, return_counts=True)
        at, n = at[first], n[first]
        null = lambda kind: pa.nulls(len(at), kind)
        held = _binary(u[_slices(at, n)].view(np.uint8), n * 8)
        found = pa.Table.from_arrays([null(pa.int64()), null(out["source"].type), null(pa.int64()), null(pa.int64()), pa.array(item.view(np.int64)), pa.array(n), pa.array(weight.astype(np.int64)), held], names)
        return pa.concat_tables([out, found])

    dealt = _dealt(rows, max(1, -(-size // GROUP)), k)
    shared = materialised(dealt.groupBy("g").applyInArrow(share, f"u long, source {kind}, m long, l long, item long, n long, weight long, units binary"), "shared")
    items = shared.where("item is not null").groupBy("item", "n").agg(F.sum("weight").alias("weight"), F.first("units").alias("units"))
    return shared.where("u is not null").select("u", "source", "m", "l"), items.select("item", "weight", "units")


def _side(t: pa.Table, programs: pa.Array) -> tuple:
    """Of a block: its units by program and name, their programs' numbers and sizes; its items, and for each its weight and units' numbers."""
    docs = t.filter(pa.compute.is_valid(t["u"]))
    u, m, p = docs["u"].to_numpy(), docs["m"].to_numpy(), pa.compute.index_in(docs["source"], programs).to_numpy()
    order = np.lexsort((u, p))
    u, m, p = u[order], m[order], p[order].astype(np.int64)
    items = t.filter(pa.compute.is_valid(t["items"]))
    item, weight, n = _raw(items["items"], np.int64), _raw(items["weights"], np.int64), _raw(items["counts"], np.int64)
    by = np.argsort(u)
    place = by[np.searchsorted(u, _raw(items["units"], np.int64), sorter=by)] if len(u) else np.zeros(0, np.int64)
    return u, p, m, item, weight, n, np.cumsum(n) - n, place


def _best(unit: np.ndarray, program: np.ndarray, score: np.ndarray, programs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The highest score of each unit and program: (units, programs, scores)."""
    key = unit * programs + program
    if (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, score = key[order], score[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[at] // programs, key[at] % programs, np.maximum.reduceat(score, at) if len(at) else score


def _meetings(a: tuple, b: tuple, same: bool) -> Iterator[tuple]:
    """(units of a, units of b, Jaccard similarity) of all pairs of different programs that share an item, some rows of a at a time."""
    _, pa_, ma, item_a, weight, na, at_a, place_a = a
    _, pb, mb, item_b, _, nb, at_b, place_b = b
    _, x, y = np.intersect1d(item_a, item_b, assume_unique=True, return_indices=True)
    i = place_a[_slices(at_a[x], na[x])]
    it = np.repeat(np.arange(len(x)), na[x])
    order = np.argsort(i, kind="stable")
    i, it = i[order], it[order]
    start, size, w = at_b[y], nb[y], weight[x]
    cost = np.concatenate([[0], np.cumsum(size[it])])
    rows = np.flatnonzero(np.r_[True, i[1:] != i[:-1]][: len(i)])  # a unit's items stay together
    ends = np.r_[rows[1:], len(i)] if len(i) else rows
    r = 0
    while r < len(rows):
        stop = max(r + 1, min(r + ROWS, int(np.searchsorted(cost[ends], cost[rows[r]] + MEETINGS, "right"))))
        part = slice(rows[r], ends[stop - 1])
        t, n = it[part], size[it[part]]
        local = np.repeat(np.arange(stop - r), np.diff(np.r_[rows[r:stop], ends[stop - 1]]))
        j = place_b[_slices(start[t], n)]
        packed = (np.repeat(local << 20, n) | j) << 31 | np.repeat(w[t], n)
        if same:
            packed = packed[j > np.repeat(i[part], n)]
        packed.sort()
        pair = packed >> 31
        at = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
        if len(at):
            both = np.add.reduceat(packed & ((1 << 31) - 1), at)
            p, q = i[rows[r:stop]][pair[at] >> 20], pair[at] & ((1 << 20) - 1)
            other = pa_[p] != pb[q]
            p, q, both = p[other], q[other], both[other]
            yield p, q, both / (ma[p] + mb[q] - both)
        r = stop


def best_matches(rows: DataFrame, k: int = DEFAULT.k) -> DataFrame:
    """(prog_a, prog_b, s, w) of rows (source, words), one for each unit and other program that it shares a shingle with: s is the highest
    Jaccard similarity to a document there, w the length of its copies. prog_a < prog_b; units of both sides are rows.

    Shingles are told apart by 64-bit hashes. Units meet in pairs of blocks, in the workers' memory; the work is that of all meetings.
    """
    rows = rows.where("source is not null and words is not null").select("source", "words")
    units, items = shared_shingles(rows, k)
    items = materialised(items, "items")
    gc.collect()
    rows.sparkSession._jvm.System.gc()  # the shuffle files of all shingles go
    kind = dict(rows.dtypes)["source"]
    blocks = max(BLOCKS, -(-units.count() // BLOCK))

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            item, weight = batch.column("item").to_numpy(), batch.column("weight").to_numpy()
            n = pa.compute.binary_length(batch.column("units")).to_numpy() // 8
            u, at = np.frombuffer(b"".join(batch.column("units").to_pylist()), np.int64), np.repeat(np.arange(len(item)), n)
            block = u % blocks
            for x in range(blocks):
                which = block == x
                held, counts = np.unique(at[which], return_counts=True)
                if len(held):
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()), *(pa.array([v.astype(np.int64).tobytes()], pa.binary()) for v in (item[held], weight[held], counts, u[which]))], ["block", "items", "weights", "counts", "units"])

    def run(key: tuple, t: pa.Table) -> pa.Table:
        x, y = (v.as_py() for v in key)
        programs = t["source"].drop_null().unique()
        a = _side(t.filter(pa.compute.equal(t["block"], x)), programs)
        b = a if x == y else _side(t.filter(pa.compute.equal(t["block"], y)), programs)
        p = max(1, len(programs))
        dense = np.zeros(len(b[0]) * p) if len(b[0]) * p <= DENSE else None
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i, j, score in _meetings(a, b, x == y):
            u, q, s = _best(i, b[1][j], score, p)
            found.append((a[0][u], q, s))
            if dense is None:
                u, q, s = _best(j, a[1][i], score, p)
                found.append((b[0][u], q, s))
            else:
                np.maximum.at(dense, j * p + a[1][i], score)
        if dense is not None:
            at = np.flatnonzero(dense)
            found.append((b[0][at // p], at % p, dense[at]))
        u, q, s = (np.concatenate(c) for c in zip(*found))
        return pa.Table.from_arrays([pa.array(u), programs.take(pa.array(q)), pa.array(s)], ["u", "other", "s"])

    null = lambda name, type_: F.lit(None).cast(type_).alias(name)
    parts = items.mapInArrow(split, "block int, items binary, weights binary, counts binary, units binary").select("block", null("u", "long"), null("source", kind), null("m", "long"), "items", "weights", "counts", "units")
    docs = units.select(F.pmod("u", F.lit(blocks)).cast("int").alias("block"), "u", "source", "m", *(null(c, "binary") for c in ("items", "weights", "counts", "units")))
    each = parts.unionByName(docs).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = each.groupBy(F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y")).applyInArrow(run, f"u long, other {kind}, s double")
    best = met.groupBy("u", "other").agg(F.max("s").alias("s")).join(units.select("u", "source", F.col("l").alias("w")), "u")
    return best.select(F.least("source", "other").alias("prog_a"), F.greatest("source", "other").alias("prog_b"), "s", "w")

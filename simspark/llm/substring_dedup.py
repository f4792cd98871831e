"""Removal of repeated byte strings by suffix arrays.

A byte goes if a string of LENGTH bytes covers it that also starts anywhere else, in the same document or another.

Suffix arrays are built in shards. What may repeat is dealt to the shards by anchors: the anchor of a window of LENGTH bytes is the
ANCHOR-byte string in it with the smallest hash, so equal windows have equal anchors at equal distance. Neighbouring windows of
one anchor are one segment. Segments whose anchor comes once in the corpus can't repeat and stay behind. Of equal
segments two copies at most enter a shard. An anchor with more than HOT different segments is not put into one shard: its windows
are dealt by their cores instead, the bytes that CELL neighbouring windows share, and where a core still has more than HOT different
segments, window by window. So no shard depends on how often a passage occurs, and nothing is left out.
Each shard finds the repeated windows by external induced sorting (suffix.py) and their places go back to all documents.

Runs of words that repeat, whatever their bytes, are found in the same way: each word is written as a code of CODE bytes, a hash whose first
byte only stands at the start of a code, and windows of so many codes are kept that start at a code.

Cases: null and empty texts and those under LENGTH bytes keep all; very long texts are used whole; rows with equal id and text, and
rows with a null id, are documents like others and repeat each other; an empty table gives an empty table. Other columns are
kept by `dedup_documents` and ignored by the query. Segments count as equal if their 64-bit hashes and anchors are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simspark.llm.common import RollingHash, Workspace, give_back, mix64, slices, table, text_buffer
from simspark.llm.suffix import repeated_starts

LENGTH, ANCHOR, HOT, CELL = 400, 96, 512, 32
SHARD_BYTES = 1 << 21
#: Bytes of a word's code: 6 bits of the hash in the first, 5 in the others.
CODE = 6
_BYTES, _UNIT = 1 << 20, 1 << 16
_hash = RollingHash(1)


def uid() -> Column:
    """Names a row by its content, since ids may be null or repeat."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), F.col("text"))


def span_name(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, parts: int = 8) -> np.ndarray:
    """A hash of each span that isn't a sum over it: certain long strings, taken whole, cancel out in sums modulo a power of two."""
    size, name = end - start, np.zeros(len(start), np.uint64)
    for k in range(parts):
        name = mix64(name ^ _hash.span(prefix, start + size * k // parts, start + size * (k + 1) // parts))
    return name


def segments(body: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR, named: bool = True):
    """(text number, first window, windows, anchor place, anchor hash, segment hash) of each segment; places are within the text.

    named: whether segment hashes are wanted; else they are 0.
    """
    width = length - anchor + 1
    columns: list[list[np.ndarray]] = [[] for _ in range(6)]
    n = len(body)
    if n < length:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    prefix = _hash.prefix(body)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for lo in range(0, n - length + 1, _UNIT):  # windows that start in [lo, hi)
        hi = min(lo + _UNIT, n - length + 1)
        least = _hash.windows(prefix, lo, hi + width - 1, anchor)
        least &= ~np.uint64((1 << 21) - 1)
        least |= np.arange(len(least), dtype=np.uint64)
        size = 1
        while size < width:  # sliding minimum by doubling
            step = min(size, width - size)
            least = np.minimum(least[:-step], least[step:])
            size += step
        at = (least & np.uint64((1 << 21) - 1)).astype(np.int64) + lo
        start = np.arange(lo, hi)
        own = owner[lo:hi]
        inside = start + length <= offsets[own + 1]
        start, at, own = start[inside], at[inside], own[inside]
        if not len(start):
            continue
        cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(start) != 1) | (np.diff(own) != 0)) + 1
        first, last = np.append(0, cut), np.append(cut, len(start)) - 1
        a, b, m, d = start[first], start[last], at[first], own[first]
        for c, v in zip(columns, (d, a - offsets[d], b - a + 1, m - offsets[d], _hash.span(prefix, m, m + anchor), span_name(prefix, a, b + length) if named else np.zeros(len(a), np.uint64))):
            c.append(v)
    return [np.concatenate(c) if c else np.zeros(0, np.int64 if i < 4 else np.uint64) for i, c in enumerate(columns)]


def _occurrences(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """(key, seg, uid, lo, windows, ahead): the segments of each document; key is the hash of the anchor, which stands `ahead` of lo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", _BYTES):
                d, lo, windows, mark, key, seg = segments(*text_buffer(batch.column("text")), length, anchor)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(seg.view(np.int64)), batch.column("uid").take(pa.array(d)), pa.array(lo, pa.int64()), pa.array(windows, pa.int32()), pa.array(mark - lo, pa.int32())], ["key", "seg", "uid", "lo", "windows", "ahead"])
        give_back()

    return docs.select("uid", "text").mapInArrow(run, "key long, seg long, uid long, lo long, windows int, ahead int")


def _anchor_counts(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """(key, n) with the counts of each batch; the corpus' counts are their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", _BYTES):
                key, n = np.unique(segments(*text_buffer(batch.column("text")), length, anchor, named=False)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n, pa.int32())], ["key", "n"])
        give_back()

    return docs.select("text").mapInArrow(run, "key long, n int")


def _classes(occurrences: DataFrame) -> DataFrame:
    """(key, seg, n, rep): equal segments, how often they come and where the first is."""
    return occurrences.groupBy("key", "seg").agg(F.sum("n").alias("n"), F.min(F.struct("uid", "lo", "windows", "ahead")).alias("rep"))


def _repeated(ws: Workspace, classes: DataFrame, name: str, hot: int) -> DataFrame:
    """The classes whose key comes twice or more, and whether the key has too many of them for one shard, or only one."""
    saved = ws.save(classes, f"{name}-classes")
    keys = saved.groupBy("key").agg(F.sum("n").alias("all"), F.count("*").alias("different")).where("all > 1").select("key", (F.col("different") > hot).alias("hot"), (F.col("different") == 1).alias("only"))
    found = ws.save(saved.join(keys, "key").select("key", "seg", "n", "rep.*", "hot", "only"), name)
    ws.drop(f"{name}-classes")
    ws.free()
    return found


def _with_text(docs: DataFrame, reps: DataFrame, columns: list[str]) -> DataFrame:
    """(text, items array<struct>) of each document that holds a representative."""
    items = reps.groupBy("uid").agg(F.collect_list(F.struct(*columns)).alias("items"))
    return docs.select("uid", "text").dropDuplicates(["uid"]).join(items, "uid").select("text", "items")


def _items(batch: pa.RecordBatch) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(row of each item, columns of the items)."""
    items = batch.column("items")
    flat = items.flatten()
    row = np.repeat(np.arange(len(items)), np.asarray(pa.compute.list_value_length(items)))
    return row, {f.name: np.asarray(flat.field(i)) for i, f in enumerate(flat.type)}


def _split(docs: DataFrame, hot: DataFrame, cell: int, length: int) -> DataFrame:
    """(pkey, pseg, off, key, seg, uid, lo, windows, ahead, n): windows of hot classes dealt by the bytes that `cell` windows share.

    Cells are counted from the anchor, so that equal windows of one anchor fall into equal cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", _BYTES):
                body, offsets = text_buffer(batch.column("text"))
                prefix = _hash.prefix(body)
                row, it = _items(batch)
                base, lo, n = offsets[row], it["lo"], it["windows"].astype(np.int64)
                mark = lo + it["ahead"]
                if cell == 1:
                    count, first = n, lo
                else:
                    first = lo - (lo - mark) % cell
                    count = (lo + n - 1 - first) // cell + 1
                at = np.repeat(np.arange(len(lo)), count)
                k = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
                a = first[at] + k * cell
                start, stop = np.maximum(a, lo[at]), np.minimum(a + cell, (lo + n)[at])
                core = _hash.span(prefix, base[at] + a + cell - 1, base[at] + a + length) if cell > 1 else _hash.span(prefix, base[at] + a, base[at] + a + length)
                seg = span_name(prefix, base[at] + start, base[at] + stop - 1 + length)
                key = mix64(core ^ (a - mark[at]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ it["key"][at].view(np.uint64)) if cell > 1 else core
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(it[c][at]) for c in ("pkey", "pseg")] + [pa.array(start - it["plo"][at]), pa.array(key.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(it["uid"]).take(take), pa.array(start), pa.array((stop - start).astype(np.int32)), pa.array((mark[at] - start).astype(np.int32)), pa.array(it["n"]).take(take)], ["pkey", "pseg", "off", "key", "seg", "uid", "lo", "windows", "ahead", "n"])

    return _with_text(docs, hot, ["pkey", "pseg", "plo", "key", "uid", "lo", "windows", "ahead", "n"]).mapInArrow(run, "pkey long, pseg long, off long, key long, seg long, uid long, lo long, windows int, ahead int, n long")


def _ranges(starts: np.ndarray) -> np.ndarray:
    """Rising places as pairs (first, behind last)."""
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    return np.stack([starts[np.append(0, cut)], starts[np.append(cut, len(starts)) - 1] + 1], 1)


def _sort_shards(docs: DataFrame, classes: DataFrame, length: int, shards: int) -> DataFrame:
    """(key, seg, found): the repeated windows of each class, as pairs of 32-bit places in its segment."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", _BYTES):
                body, offsets = text_buffer(batch.column("text"))
                row, it = _items(batch)
                order = np.lexsort((it["lo"], row))
                row, it = row[order], {k: v[order] for k, v in it.items()}
                lo, stop, only = it["lo"], it["lo"] + it["windows"], it["only"]
                # segments that follow each other go as one string where no other segment has their anchors
                joint = np.append(False, (row[1:] == row[:-1]) & only[1:] & only[:-1] & (lo[1:] == stop[:-1])) if len(row) else np.zeros(0, bool)
                first = np.flatnonzero(~joint)
                last = np.append(first[1:], len(row)) - 1
                a, b = (offsets[row] + lo)[first], (offsets[row] + stop)[last] - 1 + length
                parts = np.stack([it["key"], it["seg"], it["windows"].astype(np.int64)], 1)
                yield pa.RecordBatch.from_arrays([pa.array(it["key"][first]), pa.array([parts[x : y + 1].tobytes() for x, y in zip(first.tolist(), last.tolist())], pa.binary()), pa.array(it["n"][first] > 1), pa.array([body[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist())], pa.binary())], ["key", "parts", "twice", "bytes"])
        give_back()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings, owners, at, n = [], [], [], 0
        for batch in batches:
            for parts, twice, data in zip(*(batch.column(c).to_pylist() for c in ("parts", "twice", "bytes"))):
                # code 0 separates, so bytes 0 give way to 255, which UTF-8 doesn't use
                data = data.replace(b"\0", b"\xff") + b"\0"
                owners.append(np.frombuffer(parts, np.int64).reshape(-1, 3))
                at.append(n)
                strings.extend([data, data] if twice else [data])
                n += len(data) * (1 + twice)
        if not owners:
            return
        whole = np.frombuffer(b"".join(strings), np.uint8)
        del strings
        starts = repeated_starts(whole, length)
        give_back()
        out = []
        for begin, own in zip(at, owners):
            edge = begin + np.append(0, np.cumsum(own[:, 2]))
            cut = np.searchsorted(starts, edge)
            for (key, seg, _), x, y, base in zip(own.tolist(), cut, cut[1:], edge):
                if y > x:
                    out.append((key, seg, _ranges(starts[x:y] - base).astype("<i4").tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], names=["key", "seg", "found"])
        give_back()

    cut = _with_text(docs, classes, ["key", "seg", "n", "lo", "windows", "only"]).mapInArrow(texts, "key long, parts binary, twice boolean, bytes binary")
    return cut.repartition(shards, "key").mapInArrow(sort, "key long, seg long, found binary")


def repeated_windows(ws: Workspace, docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, cell: int = CELL, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(uid, items): for each document of docs (uid, text) with any, where segments lie and which of their windows repeat.

    Saved; all other tables of ws are deleted.
    """
    keys = _anchor_counts(docs, length, anchor).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
    seen = ws.save(_occurrences(docs, length, anchor).join(keys, "key", "left_semi"), "occurrences")
    ws.free()
    classes = _repeated(ws, _classes(seen.withColumn("n", F.lit(1).cast("long"))), "anchors", hot)
    cool, found, wide = classes.where(~F.col("hot")), None, []
    level, size = classes.where("hot"), cell
    level = level.select(F.col("key").alias("pkey"), F.col("seg").alias("pseg"), F.col("lo").alias("plo"), "key", "uid", "lo", "windows", "ahead", "n")
    while not level.isEmpty():
        parts = ws.save(_split(docs, level, size, length), f"split-{size}")
        own = _repeated(ws, _classes(parts), f"cells-{size}", hot if size > 1 else 1 << 62)
        wide.append(parts.join(own.where(~F.col("hot")).select("key", "seg"), ["key", "seg"], "left_semi").select("pkey", "pseg", "off", "key", "seg"))
        cool = cool.unionByName(own.where(~F.col("hot")))
        again = own.where("hot").select("key", "seg")
        level = parts.join(again, ["key", "seg"], "left_semi").select("pkey", "pseg", (F.col("lo") - F.col("off")).alias("plo"), "key", "uid", "lo", "windows", "ahead", "n")
        size = 1
    cool = ws.save(cool.select("key", "seg", "n", "uid", "lo", "windows", "only"), "cool")
    # joint strings share their ends, so this counts single segments somewhat high for what runs on
    total = cool.agg(F.sum((F.col("windows") + F.when(F.col("only"), length // 4).otherwise(length)) * F.least(F.col("n"), F.lit(2)))).first()[0] or 0
    found = ws.save(_sort_shards(docs, cool, length, max(1, math.ceil(total / shard_bytes))), "found")
    ws.drop("cool")
    ws.free()
    parents = found.select("key", "seg", F.array(F.struct(F.lit(0).cast("long").alias("off"), "found")).alias("found"))
    if wide:
        lifted = wide[0]
        for w in wide[1:]:
            lifted = lifted.unionByName(w)
        lifted = lifted.join(found, ["key", "seg"]).groupBy("pkey", "pseg").agg(F.collect_list(F.struct("off", "found")).alias("found"))
        parents = parents.join(classes.where(~F.col("hot")).select("key", "seg"), ["key", "seg"], "left_semi").unionByName(lifted.select(F.col("pkey").alias("key"), F.col("pseg").alias("seg"), "found"))
    items = ws.save(seen.join(parents, ["key", "seg"]).groupBy("uid").agg(F.collect_set(F.struct("lo", "found")).alias("items")), "items")
    ws.keep("items")
    ws.free()
    return items


def word_spans(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of words and the bytes behind them: words are what str.split() splits, and don't cross offsets."""
    space = (body == 32) | (body >= 9) & (body <= 13) | (body >= 28) & (body <= 31)
    lead = np.flatnonzero(np.isin(body, (0xC2, 0xE1, 0xE2, 0xE3)))
    if len(lead):  # white space of more than one byte
        a, b, c = (np.append(body, [0, 0])[lead + i].astype(np.int64) for i in range(3))
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        three = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        three |= (a == 0xE2) & (b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | np.isin(c, (0xA8, 0xA9, 0xAF)))
        for mask, n in ((two, 2), (three, 3)):
            for i in range(n):
                space[lead[mask] + i] = True
    n = len(body)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.append(True, space) | edge, np.append(space, True) | edge
    return np.flatnonzero(~space & before[:n]), np.flatnonzero(~space & after[1:]) + 1


def word_codes(docs: DataFrame) -> DataFrame:
    """(uid, text): the codes of the words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", _BYTES):
                body, offsets = text_buffer(batch.column("text"))
                start, end = word_spans(body, offsets)
                h = _hash.span(_hash.prefix(body), start, end)
                codes = np.empty((len(h), CODE), np.uint8)
                codes[:, 0] = 64 + (h & np.uint64(63))
                for i in range(1, CODE):
                    codes[:, i] = 32 + (h >> np.uint64(1 + 5 * i) & np.uint64(31))
                at = (np.searchsorted(start, offsets) * CODE).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.StringArray.from_buffers(batch.num_rows, pa.py_buffer(at.tobytes()), pa.py_buffer(codes.tobytes()))], ["uid", "text"])

    return docs.select("uid", "text").mapInArrow(run, "uid long, text string")


def _found(items: list[dict]) -> np.ndarray:
    """Repeated windows as pairs (first, behind last)."""
    parts = [(item["lo"] + part["off"], part["found"]) for item in items for part in item["found"]]
    pairs = np.frombuffer(b"".join(f for _, f in parts), "<i4").reshape(-1, 2).astype(np.int64)
    return pairs + np.repeat(np.array([at for at, _ in parts], np.int64), [len(f) // 8 for _, f in parts])[:, None]


def removed_words(body: np.ndarray, items: list[dict], words: int) -> np.ndarray:
    """Which bytes belong to repeated runs of so many words, with the white space inside them."""
    start, end = word_spans(body, np.array([0, len(body)]))
    first, last = (_found(items) + [CODE - 1, CODE - 1]).T // CODE
    change = np.zeros(len(start) + 1, np.int32)
    some = last > first
    np.add.at(change, first[some], 1)
    np.add.at(change, last[some] - 1 + words, -1)
    gone = np.cumsum(change[:-1]) > 0
    inner = gone & np.append(gone[1:], False)
    cut = np.zeros(len(body) + 1, np.int32)
    np.add.at(cut, start[gone], 1)
    np.add.at(cut, np.where(inner, np.append(start[1:], 0), end)[gone], -1)
    return np.cumsum(cut[:-1]) > 0


def removed_mask(n: int, items: list[dict], length: int = LENGTH) -> np.ndarray:
    """Which of n bytes are covered by repeated windows."""
    change = np.zeros(n + 1, np.int32)
    pairs = _found(items)
    np.add.at(change, pairs[:, 0], 1)
    np.add.at(change, pairs[:, 1] - 1 + length, -1)
    return np.cumsum(change[:n]) > 0


def covered(ws: Workspace, docs: DataFrame, **options) -> DataFrame:
    """docs with uid and, for documents with repeats, the items of repeated_windows."""
    named = docs.withColumn("uid", uid())
    return named.join(repeated_windows(ws, named, **options), "uid", "left")


def dedup_documents(ws: Workspace, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 0, **options) -> DataFrame:
    """docs with the repeated bytes taken out of the text. A character that loses a byte loses all of them.

    words: runs of so many words that repeat go as well.
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(rest)))
    length = options.get("length", LENGTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, items, runs in zip(*(batch.column(c).to_pylist() for c in ("text", "items", "runs"))):
                if items or runs:
                    body = np.frombuffer(text.encode(), np.uint8)
                    gone = removed_mask(len(body), items or [], length)
                    if runs:
                        gone |= removed_words(body, runs, words)
                    lead = np.cumsum((body & 0xC0) != 0x80) - 1  # the character of each byte
                    gone = np.bincount(lead, gone)[lead] > 0
                    text = body[~gone].tobytes().decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 3)), pa.array(texts, pa.string())], [*batch.schema.names[:-3], "text"])

    source = covered(ws, plain, **options)
    if words:
        apart = Workspace(ws.spark, "words")
        codes = apart.save(word_codes(plain.withColumn("uid", uid())), "codes")
        source = source.join(repeated_windows(apart, codes, length=words * CODE).withColumnRenamed("items", "runs"), "uid", "left")
    else:
        source = source.withColumn("runs", F.lit(None))
    source = source.select("doc_id", *(f"c{i}" for i in range(len(rest))), "text", "items", "runs")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name not in ("text", "items", "runs"))
    out = source.mapInArrow(run, f"{schema}, text string")
    names = {"doc_id": id_col, "text": text_col} | {f"c{i}": c for i, c in enumerate(rest)}
    back = {v: k for k, v in names.items()}
    return out.select(*(F.col(back[c]).alias(c) for c in docs.columns))


def digests(ws: Workspace, docs: DataFrame, with_text: bool = False, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of docs (doc_id, text), and if asked the text that is left, without parts of characters."""
    length = options.get("length", LENGTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            body, offsets = text_buffer(batch.column("text"))
            for items, a, b in zip(batch.column("items"), offsets.tolist(), offsets[1:].tolist()):
                mine = body[a:b]
                gone, spans = np.zeros(b - a, bool), 0
                if items.is_valid and b > a:
                    gone = removed_mask(b - a, items.as_py(), length)
                    spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
                left = mine[~gone].tobytes() if spans else mine.tobytes()
                out.append((b - a, int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left.decode(errors="ignore")))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = covered(ws, docs.select("doc_id", "text"), **options).select("doc_id", "text", "items").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
    return out if with_text else out.drop("text")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(Workspace(spark, "op1"), table(spark, sf_dir, "documents"), with_text=True)

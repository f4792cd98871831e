"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

A document's ids are followed by id 0. Documents over `capacity` ids are cut into pieces of `capacity`; the first piece is the
shorter one. Pieces are dealt into shards of about SHARD pieces. A shard is packed by best fit, longest piece first, and then
improved: the emptiest bins exchange pieces one for one, two for one or one for two with other underfull bins, or move them
there, always so that the sum of squared fills rises, until bins run empty or nothing helps. What lies in underfull bins of all
shards is dealt and packed once more.

Cases: a null or empty text is a document of the single id 0; documents of any length are packed whole; rows that repeat are
packed as often as they come; equal lengths go by id; a null doc_id is kept; an empty table gives an empty table. Other columns
are ignored. Strings of special tokens in a text become those tokens, as the tokenizer file asks for.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simspark.llm.common import Workspace, slices, table
from simspark.llm.pretoken import encoder

CAPACITY, END_ID = 2_048, 0
SHARD = 40_000
#: Bins under this share of the capacity take part in the second round.
UNDERFULL = 0.98
_BYTES = 2_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(2)
def special_tokens(tokenizer_path: str | None = None) -> dict[str, int]:
    """The strings that a tokenizer file takes for tokens wherever they stand, with their ids."""
    with open(tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def cut(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, ranks_path: str | None = None) -> DataFrame:
    """The pieces of each document. The rank file and the tokenizer file of the vocabulary give the same ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", _BYTES):
                ids, at = encoder(ranks_path).encode_around([t or "" for t in batch.column("text").to_pylist()], special_tokens())
                size = np.diff(at) + 1
                full = np.insert(ids, at[1:], END_ID).astype("<u4")
                begin = np.concatenate([[0], np.cumsum(size)])
                count = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                first = size - (count - 1) * capacity
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[row], capacity)
                a = (begin[row] + start).tolist()
                crc = [zlib.crc32(full[x : x + n]) for x, n in zip(a, length.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers; items come longest first, each goes to the fullest bin it fits in."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[item]
        if fits := rooms >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(item)
        else:
            room, b = capacity, len(bins)
            bins.append([item])
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


def _pairs(items: list[int], lengths: list[int]) -> list[tuple[int, int]]:
    """Two pieces of a bin for each two lengths in it; a bin of `capacity` ids has few different lengths."""
    by: dict[int, list[int]] = {}
    for i in sorted(items, key=lambda i: (-lengths[i], i)):
        by.setdefault(lengths[i], []).append(i)
    return [(x[0], y[0]) for x, y in combinations(by.values(), 2)] + [(x[0], x[1]) for x in by.values() if len(x) > 1]


def improve(bins: list[list[int]], lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Local search: empties bins by exchanges that raise the sum of squared fills, until none does."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    live = [k for k in range(len(bins)) if 0 < fill[k] < capacity]
    # options: what a bin can give back for what it gets; nothing, one piece, or two
    where, gives, value = [], [], []

    def options(b: int) -> list[tuple]:
        return [(), *((i,) for i in bins[b]), *_pairs(bins[b], lengths)]

    for b in live:
        for o in options(b):
            where.append(b), gives.append(o), value.append(sum(lengths[i] for i in o))
    where_, value_ = np.array(where, np.int64), np.array(value, np.int64)
    kind = np.array([len(o) for o in gives], np.int64)
    fills = np.array(fill, np.int64)
    again = True
    while again:
        again = False
        for donor in sorted(live, key=lambda b: (fills[b], b)):
            while bins[donor] and fills[donor] < capacity:
                best, act = 0, None
                room = capacity - fills[where_]
                other = where_ != donor
                taken = {(lengths[i],): (i,) for i in bins[donor]}
                taken |= {(lengths[i], lengths[j]): (i, j) for i, j in _pairs(bins[donor], lengths)}
                for sizes, items in taken.items():
                    gain = sum(sizes) - value_
                    rise = gain * (fills[where_] - fills[donor] + gain)
                    rise[~(other & (gain > 0) & (gain <= room) & ((kind == 1) if len(items) == 2 else True))] = 0
                    k = int(np.argmax(rise)) if len(rise) else 0
                    if len(rise) and rise[k] > best:
                        best, act = rise[k], (items, k)
                if act is None:
                    break
                again = True
                items, k = act
                b, back = int(where_[k]), gives[k]
                bins[donor] = [i for i in bins[donor] if i not in items] + list(back)
                bins[b] = [i for i in bins[b] if i not in back] + list(items)
                moved = sum(lengths[i] for i in items) - int(value_[k])
                fills[donor] -= moved
                fills[b] += moved
                stay = np.flatnonzero((where_ != donor) & (where_ != b))
                more = [(x, o) for x in (donor, b) if bins[x] and fills[x] < capacity for o in options(x)]
                where_ = np.concatenate([where_[stay], np.array([x for x, _ in more], np.int64)])
                value_ = np.concatenate([value_[stay], np.array([sum(lengths[i] for i in o) for _, o in more], np.int64)])
                kind = np.concatenate([kind[stay], np.array([len(o) for _, o in more], np.int64)])
                gives = [gives[i] for i in stay.tolist()] + [o for _, o in more]
    return [b for b in bins if b]


def pack(pieces: DataFrame, capacity: int = CAPACITY, round_: int = 0) -> DataFrame:
    """Pack each partition of pieces; adds sequence_id, offset and the fill of the sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if t is None or not t.num_rows:
            return
        t = t.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("length", "ascending")])
        lengths = t.column("length").to_pylist()
        whole = [i for i, n in enumerate(lengths) if n >= capacity]
        rest = [i for i, n in enumerate(lengths) if n < capacity]
        bins = [[i] for i in whole] + [[rest[i] for i in b] for b in improve(*(lambda n: (best_fit(n, capacity), n))([lengths[i] for i in rest]), capacity)]
        base = (round_ << 60) + (TaskContext.get().partitionId() << 32)
        order = np.array([i for b in bins for i in b])
        size = np.array([len(b) for b in bins])
        n = np.array(lengths)[order]
        at = np.cumsum(n) - n
        first = np.cumsum(size) - size
        fill = np.add.reduceat(n, first)
        out = t.take(pa.array(order)).combine_chunks()
        out = out.append_column("sequence_id", pa.array(base + np.repeat(np.arange(len(bins)), size), pa.int64()))
        out = out.append_column("offset", pa.array(at - np.repeat(at[first], size), pa.int64()))
        yield from out.append_column("fill", pa.array(np.repeat(fill, size), pa.int64())).to_batches()

    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32").mapInArrow(run, f"{PIECES}, sequence_id long, offset long, fill long")


def pack_documents(ws: Workspace, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, ranks_path: str | None = None, shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    pieces = ws.save(cut(docs, id_col, text_col, capacity, ranks_path), "pieces")
    n = pieces.count()
    # dealt in turn: ids may be null or repeat
    first = ws.save(pack(pieces.repartition(max(1, math.ceil(n / shard))), capacity), "round-1")
    enough = F.col("fill") >= UNDERFULL * capacity
    left = first.where(~enough)
    again = pack(left.repartition(max(1, math.ceil(left.count() / shard))), capacity, 1)
    return first.where(enough).unionByName(again).drop("fill")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(Workspace(spark, "op6"), table(spark, sf_dir, "documents"))

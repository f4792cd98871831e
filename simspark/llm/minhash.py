"""MinHash near-duplicates by a multi-index Hamming join.

A document's set is its distinct word shingles. Its signature has CHUNKS x CHUNK_SYMBOLS symbols of 16 bits, each the hash of a
minimum over the set. By the pigeonhole principle two signatures that differ in fewer than CHUNKS * (ERRORS + 1) symbols have a
chunk with at most ERRORS (one) differing symbols; the allowed error is enumerated by leaving out each symbol of each chunk in
turn, so such a pair shares a key. For a pair at the threshold 0.8 a chunk of six qualifies with probability 0.66, so that all ten
fail with probability 2e-5. Links are confirmed on the full sets.

Documents with equal sets are one class from the start. Buckets of a key are not expanded into pairs: first, in STARS rounds, each
class meets one class of another component in its buckets. Only buckets whose classes are then still in several components are gone
through in full, in tiles of bounded size: signatures are compared inside a tile; the classes of pairs that are close, in different
components and under no earlier key of the two get their full sets, and the tile gives a spanning forest of the links it confirms.

Cases: null and empty texts and texts without a word have an empty set and link with nothing; fewer than `width` words form one
shingle; very long texts are used whole; rows with a null doc_id link with nothing, their component is null and kept is false;
rows that repeat are returned as often as they come; rows that share a doc_id are documents of their own; an empty table gives an empty
table. Other columns are ignored. Shingles and sets count as equal if their hashes, of 64 and 128 bits, are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simspark.llm.common import RollingHash, Workspace, give_back, grouped, mix64, slices, table, text_buffer
from simspark.llm.components import connected_components

WIDTH, PERCENT = 4, 80
CHUNKS, CHUNK_SYMBOLS = 10, 6
SYMBOLS = CHUNKS * CHUNK_SYMBOLS
#: All symbols of a signature, those that a star is filtered by, and the deviations that a pair at the threshold may lie off.
TOTAL, STAR, DEVIATIONS = 8 * SYMBOLS, 2 * SYMBOLS, 5.0
#: Classes of one part of a bucket, their shingles together, and rounds in which each class meets one other before parts are compared.
TILE, TILE_SHINGLES, STARS = 1_024, 4_000_000, 2
LONG_WORD = 32
_BYTES = 1_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(10)
_PLACE = _rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_FLIP = _rng.integers(1, 2**63, TOTAL, dtype=np.uint64)
_TIMES = _rng.integers(1, 2**63, TOTAL, dtype=np.uint64) | np.uint64(1)
_KEY = _rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_SLOT = _rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64)
_words = RollingHash(3)


def shingle_sets(body: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, at): the distinct shingles of text i are hashes[at[i]:at[i + 1]], rising."""
    n = len(offsets) - 1
    if not len(body):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    body = _LOWER[body]
    blank = _BLANK[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets] = True
    opens = ~blank
    opens[1:] &= blank[:-1] | edge[1:-1]
    closes = ~blank
    closes[:-1] &= blank[1:] | edge[1:-1]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    word = _words.span(_words.prefix(body), first, last)
    for i in np.flatnonzero(last - first > LONG_WORD).tolist():
        # sums of powers of two's modulus cancel out for certain long strings
        word[i] = xxhash.xxh3_64_intdigest(body[first[i] : last[i]].tobytes(), seed=3)
    at = np.searchsorted(first, offsets)  # words before each text
    count = np.diff(at)
    size = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    out = np.concatenate([[0], np.cumsum(size)])
    start = np.arange(out[-1]) + np.repeat(at[:-1] - out[:-1], size)
    padded = np.concatenate([word, np.zeros(width, np.uint64)])
    have = np.repeat(np.minimum(count, width), size)
    h = have.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(width):
        h += np.where(k < have, padded[start + k] * _PLACE[k % 16], np.uint64(0))
        h = mix64(h) if k == width - 1 or k % 16 == 15 else h
    for a, b in zip(out[:-1].tolist(), out[1:].tolist()):
        h[a:b].sort()
    if not len(h):
        return h, out
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[out[:-1][size > 0]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[out]


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of TOTAL 16-bit symbols for each set; zeros for empty ones."""
    out = np.zeros((len(at) - 1, TOTAL), np.uint16)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        work = np.empty_like(h)
        for k in range(TOTAL):
            np.bitwise_xor(h, _FLIP[k], out=work)
            np.multiply(work, _TIMES[k], out=work)
            out[some, k] = mix64(np.minimum.reduceat(work, at[some])) >> np.uint64(48)
    return out


def max_distance(symbols: int, percent: int = PERCENT) -> int:
    """Symbols in which a pair at the threshold differs at most, but for one in three million."""
    p = 1 - percent / 100
    return int(symbols * p + DEVIATIONS * (symbols * p * (1 - p)) ** 0.5)


def index_keys(symbols: np.ndarray) -> np.ndarray:
    """(rows, SYMBOLS) keys: of each chunk with each of its symbols left out. Equal keys: at most that one symbol differs."""
    value = symbols.astype(np.uint64).reshape(len(symbols), CHUNKS, CHUNK_SYMBOLS) * _KEY.reshape(CHUNKS, CHUNK_SYMBOLS)
    key = (value.sum(axis=2, keepdims=True) - value).reshape(len(symbols), SYMBOLS) + _SLOT
    return mix64(key)


def set_names(h: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """Two 64-bit names of each set, which together stand for it."""
    names = []
    for seed in (0x1234567, 0x89ABCDE):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(h ^ np.uint64(seed)))])
        names.append(pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)))
    return names


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, sig): h1 and h2 name the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", _BYTES):
                h, at = shingle_sets(*text_buffer(batch.column("text")), width)
                sig = [x.tobytes() for x in signatures(h, at)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), *set_names(h, at), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "h1", "h2", "sig"])
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sig binary")


def _keys(rows: DataFrame) -> DataFrame:
    """(key, id) of (id, sig), sig being the first SYMBOLS symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 5_000):
                batch = whole.slice(start, 5_000)
                keys = index_keys(_matrix(batch.column("sig"), SYMBOLS))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(np.asarray(batch.column("id")), SYMBOLS))], ["key", "id"])
        give_back()

    return rows.select("id", "sig").mapInArrow(run, "key long, id long")


def _matrix(column: pa.Array, symbols: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), symbols)


def _sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(id, set) of the members (id, doc_id, h1, h2), from their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", _BYTES):
                h, at = shingle_sets(*text_buffer(batch.column("text")), width)
                sets = pa.array([h[a:b].tobytes() for a, b in zip(at.tolist(), at[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *set_names(h, at), sets], ["doc_id", "h1", "h2", "set"])
        give_back()

    texts = docs.join(members.select("doc_id").distinct(), "doc_id", "left_semi")
    made = texts.mapInArrow(run, "doc_id long, h1 long, h2 long, set binary")
    return made.join(members, ["doc_id", "h1", "h2"]).dropDuplicates(["id"]).select("id", "set")


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two rising arrays have in common."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    n = shared(x, y)
    return 100 * n >= percent * (len(x) + len(y) - n) > 0


def _confirmed(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), the links: percent of the union is shared, on the full sets. Signatures spare most others that look-up."""
    distance = max_distance(STAR, percent)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(np.flatnonzero((_matrix(batch.column("sa"), STAR) != _matrix(batch.column("sb"), STAR)).sum(axis=1) <= distance))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], ["a", "b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("x"), batch.column("y"))
            keep = pa.array([i for i, v in enumerate(both) if _linked(*(np.frombuffer(w.as_buffer(), np.uint64) for w in v), percent)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], ["src", "dst"])

    side = lambda x: reps.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.substring("sig", 1, 2 * STAR).alias(f"s{x}"))
    text = lambda x, s: sets.select(F.col("id").alias(x), F.col("set").alias(s))
    alike = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    found = alike.select("a", "b", "sa", "sb").mapInArrow(near, "a long, b long")
    return found.join(text("a", "x"), "a").join(text("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(exact, "src long, dst long")


def _star(live: DataFrame, groups: DataFrame, tried: DataFrame) -> DataFrame:
    """A pair (a, b) for each class at most: with a class of another component in one of its buckets that it hasn't met."""
    own = live.join(groups, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    # the two ends of a bucket by component; the members of one end meet a class of the other
    ends = own.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.min_by("id", "c").alias("e1"), F.max_by("id", "c").alias("e2")).where("c1 < c2")
    other = own.join(ends, "key").select("id", F.when(F.col("c") == F.col("c1"), F.col("e2")).otherwise(F.col("e1")).alias("end"))
    pairs = other.distinct().select(F.least("id", "end").alias("a"), F.greatest("id", "end").alias("b"), "id").join(tried, ["a", "b"], "left_anti")
    return pairs.withColumn("end", F.when(F.col("a") == F.col("id"), F.col("b")).otherwise(F.col("a"))).groupBy("id").agg(F.min("end").alias("end")).select(F.least("id", "end").alias("a"), F.greatest("id", "end").alias("b")).distinct()


class _Tile:
    """Two parts of a bucket: which pairs across them are still to be looked at."""

    def __init__(self, name: tuple[int, int, int], t: pa.Table, percent: int):
        self.key, i, j = name
        column = lambda x: np.asarray(t.column(x))
        part, self.ids, self.c, self.n = column("t"), column("id"), column("c"), column("n_shingles")
        self.sig = _matrix(t.column("sig").combine_chunks(), TOTAL)
        self.keys = index_keys(self.sig[:, :SYMBOLS]).view(np.int64)
        self.left, self.right, self.same = np.flatnonzero(part == i), np.flatnonzero(part == j), i == j
        self.percent, self.limit = percent, max_distance(TOTAL, percent)

    def partners(self, i: int, component: np.ndarray) -> np.ndarray:
        """Rows that i may link with: of another component, of like size and signature, and not met under an earlier key."""
        other = self.right[self.right > i] if self.same else self.right
        other = other[(component[other] != component[i]) & (100 * np.minimum(self.n[other], self.n[i]) >= self.percent * np.maximum(self.n[other], self.n[i]))]
        if len(other):
            other = other[(self.sig[other] != self.sig[i]).sum(axis=1) <= self.limit]
        if len(other):
            first = (self.keys[other] == self.keys[i]).argmax(axis=1)
            other = other[self.keys[i][first] == self.key]
        return other


def _wanted(rows: DataFrame, percent: int) -> DataFrame:
    """(key, i, j, id): the rows of each tile that have a partner in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, t in grouped(batches, ["key", "i", "j"]):
            tile = _Tile(name, t, percent)
            hit = np.zeros(len(tile.ids), bool)
            for i in tile.left.tolist():
                if len(other := tile.partners(i, tile.c)):
                    hit[i] = hit[other] = True
            ids = tile.ids[hit]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(ids), x)) for x in name), pa.array(ids)], ["key", "i", "j", "id"])
        give_back()

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "key long, i long, j long, id long")


def _tile_links(rows: DataFrame, percent: int) -> DataFrame:
    """(src, dst): links of each tile, on the full sets, that join two components; no more of them than rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, t in grouped(batches, ["key", "i", "j"]):
            tile = _Tile(name, t, percent)
            sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in t.column("set")]
            component = np.unique(tile.c, return_inverse=True)[1].ravel()
            out = []
            for i in tile.left.tolist():
                for k in tile.partners(i, component).tolist():
                    if component[k] != component[i] and _linked(sets[i], sets[k], percent):
                        component[component == component[k]] = component[i]
                        out.append((tile.ids[i], tile.ids[k]))
            found = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["src", "dst"])
        give_back()

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "src long, dst long")


def _open_tiles(live: DataFrame, groups: DataFrame, reps: DataFrame) -> DataFrame:
    """(key, i, j, t, id, c, n_shingles, sig): buckets that hold several components, in pairs of parts of bounded size."""
    own = live.join(groups, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    rows = own.join(reps.select("id", "n_shingles"), "id")
    open_ = rows.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.ceil(F.greatest(F.count("*") / TILE, F.sum("n_shingles") / TILE_SHINGLES)).alias("tiles")).where("c1 < c2").select("key", "tiles")
    dealt = own.join(open_, "key").withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    dealt = dealt.select("key", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "t", "id", "c")
    return dealt.join(reps, "id").select("key", "i", "j", "t", "id", "c", "n_shingles", "sig")


def classes_and_groups(ws: Workspace, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(sketches of all rows, (h1, h2, least, c) of each class of equal sets: its smallest doc_id and its component)."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # `no` names a row from here on: ids may repeat with other texts
    sketches = ws.save(sketch(docs, width=width).withColumn("no", F.monotonically_increasing_id()), "sketches")
    some = sketches.where(_linkable())
    classes = ws.save(some.groupBy("h1", "h2").agg(F.min("no").alias("id"), F.min("doc_id").alias("least")), "classes")
    firsts = some.join(classes.select(F.col("id").alias("no")), "no", "left_semi").withColumnRenamed("no", "id")
    # buckets: keys that two classes or more share
    keys = _keys(firsts.select("id", F.substring("sig", 1, 2 * SYMBOLS).alias("sig")))
    ends = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    live = ws.save(keys.join(ends, "key").select("key", "id"), "live")
    members = live.select("id").distinct()
    reps = ws.save(firsts.join(members, "id", "left_semi").select("id", "n_shingles", "sig"), "reps")
    sets = ws.save(_sets(docs, firsts.join(members, "id", "left_semi").select("id", "doc_id", "h1", "h2"), width), "sets")
    groups = tried = ws.spark.createDataFrame([], "a long, b long")
    groups = groups.select(F.col("a").alias("id"), F.col("b").alias("component"))
    edges = groups.select(F.col("id").alias("src"), F.col("component").alias("dst"))
    for turn in range(STARS):
        pairs = ws.save(_star(live, groups, tried), f"pairs-{turn}")
        edges = edges.unionByName(ws.save(_confirmed(pairs, reps, sets, percent), f"links-{turn}"))
        groups, tried = connected_components(ws, edges, f"cc-{turn}"), tried.unionByName(pairs)
    # what the stars left open, in full
    tiles = ws.save(_open_tiles(live, groups, reps), "tiles")
    wanted = _wanted(tiles, percent).join(sets, "id")
    more = ws.save(_tile_links(tiles.join(wanted, ["key", "i", "j", "id"]), percent), "links-tiles")
    groups = ws.save(connected_components(ws, edges.unionByName(more), "cc-last"), "groups")
    ws.keep("sketches", "classes", "groups")
    return sketches, classes.join(groups, "id", "left").select("h1", "h2", "least", F.coalesce("component", "id").alias("c"))


def _linkable() -> Column:
    return F.coalesce(F.expr("n_shingles > 0 and doc_id is not null"), F.lit(False))


def near_duplicates(ws: Workspace, documents: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of documents."""
    sketches, named = classes_and_groups(ws, documents, **options)
    first = named.groupBy("c").agg(F.min("least").alias("component"))
    named = named.join(first, "c").select("h1", "h2", "component")
    rest = sketches.where(~_linkable()).select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    out = sketches.where(_linkable()).select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"]).select("doc_id", "n_shingles", "component").unionByName(rest)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(False)).alias("kept"))


def with_names(documents: DataFrame, text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """documents with n_shingles, h1 and h2 as __n, __h1 and __h2."""
    # columns go by number, as any name may be taken
    plain = documents.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(documents.columns)))
    text = f"c{documents.columns.index(text_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, _BYTES):
                h, at = shingle_sets(*text_buffer(batch.column(text)), width)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(at), pa.int64()), *set_names(h, at)], [*batch.schema.names, "n", "h1", "h2"])

    made = plain.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema), "n long, h1 long, h2 long"]))
    return made.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(documents.columns)), *(F.col(x).alias(f"__{x}") for x in ("n", "h1", "h2")))


def one_of_each(ws: Workspace, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """documents without all but one row of each component, one with the smallest id. Rows without an id or a word all stay."""
    _, named = classes_and_groups(ws, documents, id_col=id_col, text_col=text_col, width=width, percent=percent)
    first = named.groupBy("c").agg(F.min(F.struct("least", "h1", "h2")).alias("f")).select(F.col("f.least").alias("__id"), F.col("f.h1").alias("__h1"), F.col("f.h2").alias("__h2"))
    rows = with_names(documents, text_col, width).withColumn("__id", F.col(f"`{id_col}`").cast("long"))
    free = F.col("__id").isNull() | (F.col("__n") == 0)
    kept = rows.where(~free).join(first, ["__id", "__h1", "__h2"], "left_semi").dropDuplicates(["__id", "__h1", "__h2"])
    return kept.unionByName(rows.where(free)).select(*(F.col(f"`{c}`") for c in documents.columns))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(Workspace(spark, "op10"), table(spark, sf_dir, "documents"))


#: DuckDB's version of op10_minhash_near_dedup: all pairs that share a shingle, and what is reached by links.
ORACLE_SQL = f"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS no, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT no, doc_id, CASE WHEN len(w) >= {WIDTH} THEN list_distinct(list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM t),
x AS (SELECT no, len(sh) AS n, unnest(sh) AS g FROM s WHERE doc_id IS NOT NULL),
p AS (SELECT a.no AS i, b.no AS j, a.n AS ni, b.n AS nj, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.no <> b.no GROUP BY ALL),
l AS (SELECT i, j FROM p WHERE 100 * shared >= {PERCENT} * (ni + nj - shared)),
reach(a, b) AS (SELECT no, no FROM s UNION SELECT r.a, l.j FROM reach r JOIN l ON l.i = r.b),
c AS (SELECT a, min(doc_id) AS component_id FROM reach JOIN s ON s.no = reach.b GROUP BY a)
SELECT doc_id, len(sh) AS n_shingles, component_id, coalesce(component_id = doc_id, false) AS kept FROM s JOIN c ON c.a = s.no
"""

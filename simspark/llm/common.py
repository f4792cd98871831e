"""What the training-data operators share: the shared work folder, Arrow text buffers, and window hashes."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


#: Rows in an Arrow batch between Spark and Python: whole texts go in them, so Spark's default of 10,000 would hold too much.
BATCH_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine may leave it unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'simspark-shared')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Workspace:
    """Tables of one query run in the shared folder. They cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, tag: str):
        bounded_batches(spark)
        self.spark, self.path, self.names = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", set()

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").options(**options).parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that nothing will read again."""
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Delete all tables but these."""
        for name in self.names - set(names):
            self.drop(name)

    def free(self) -> None:
        """Shuffle files of finished steps go now: Spark deletes them only once the driver has collected the plans they belong to."""
        gc.collect()
        self.spark._jvm.System.gc()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    if column.null_count:
        column = pc.fill_null(column, b"" if large == pa.large_binary() else "")
    column = column.cast(large)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    body = np.frombuffer(data, np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
    return body, offsets - first


def slices(batch: pa.RecordBatch, column: str, limit: int):
    """The batch in runs of rows whose texts hold about `limit` bytes together; a longer text makes a run of its own."""
    _, offsets = text_buffer(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, min(end, n) - at)
        at = min(end, n)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """(key values, rows) of each group in a stream of rows that is sorted by whole-number keys; one group is held at a time."""
    now, parts = None, []
    for batch in batches:
        names = np.stack([np.asarray(batch.column(x)).astype(np.int64) for x in keys], 1)
        cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist()] if len(names) else []
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
            name = tuple(names[a].tolist())
            if name != now and parts:
                yield now, pa.Table.from_batches(parts)
                parts = []
            now = name
            parts.append(batch.slice(a, b - a))
    if parts:
        yield now, pa.Table.from_batches(parts)


def give_back() -> None:
    """Freed memory goes back to the system, where the C library can: workers live on, and what a stage has used would count in the next."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


class RollingHash:
    """Hashes of any sub-ranges of an array by prefix sums of a polynomial modulo 2**64. The seed chooses the values of the codes."""

    BASE = 0x5851F42D4C957F2D
    up = down = np.ones(1, np.uint64)  # powers of BASE and of its inverse, shared by all

    def __init__(self, seed: int, values: int = 256):
        self.table = np.random.default_rng(seed).integers(1, 2**63, values, dtype=np.uint64) if values else None

    @classmethod
    def _grow(cls, n: int) -> None:
        with np.errstate(over="ignore"):
            up, down = np.full(n, cls.BASE, np.uint64), np.full(n, pow(cls.BASE, -1, 2**64), np.uint64)
            up[0] = down[0] = 1
            cls.up, cls.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        """prefix[i]: sum over the first i codes; hash it with span()."""
        n = len(codes)
        if n + 1 > len(self.up):
            self._grow(max(n + 1, min(2 * len(self.up), 1 << 21)))
        out = np.zeros(n + 1, np.uint64)
        value = self.table[codes] if self.table is not None else mix64(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        np.cumsum(value * self.down[:n], out=out[1:])
        return out

    def span(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of codes[start:end]: the same wherever those codes stand."""
        return mix64((prefix[end] - prefix[start]) * self.up[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def windows(self, prefix: np.ndarray, first: int, stop: int, size: int) -> np.ndarray:
        """span() of the `size` codes from each place in [first, stop)."""
        return mix64((prefix[first + size : stop + size] - prefix[first:stop]) * self.up[first:stop] + np.uint64(size * 0x9E3779B97F4A7C15 % 2**64))

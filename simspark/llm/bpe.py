"""Byte-level BPE encoding and decoding by overlapping chunks.

Each text is cut into overlapping chunks that are pre-tokenised independently; neighbours are stitched where their pre-token
boundaries resynchronise; the pieces are then encoded. Decoding concatenates the raw bytes of the ids.

Cases: null and empty texts have no ids; texts of any length are encoded whole; repeated rows give repeated results;
an empty table gives an empty table; other columns of the input don't matter. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simspark.llm.common import slices, table
from simspark.llm.pretoken import CHUNK, OVERLAP, encoder, gather

_BYTES = 2_000_000


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids array<int>): the ids of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", _BYTES):
                ids, at = encoder(ranks_path).encode([t or "" for t in batch.column("text").to_pylist()], chunk, overlap)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_ids(df: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, bytes binary) of (doc_id, ids): the raw bytes of the ids, concatenated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = encoder(ranks_path).tables[0]
        for batch in batches:
            ids = batch.column("ids")
            flat = np.asarray(ids.flatten())
            size = np.array([len(x) for x in ids], np.int64) if ids.null_count else np.asarray(pa.compute.list_value_length(ids))
            data, at = gather(*raw, flat)
            stop = at[np.concatenate([[0], np.cumsum(size)])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([data[a:b].tobytes() for a, b in zip(stop, stop[1:])], pa.binary())], ["doc_id", "bytes"])

    return df.select("doc_id", "ids").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, bytes binary")


def digest_round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in one pass, so the ids of the corpus needn't be moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(ranks_path)
        raw, digits = code.tables
        for whole in batches:
            for batch in slices(whole, "text", _BYTES):
                ids, at = code.encode([t or "" for t in batch.column("text").to_pylist()], chunk, overlap)
                found = []
                for (offsets, data), tail in ((digits, 1), (raw, 0)):
                    out, where = gather(offsets, data, ids)
                    view, stop = memoryview(out), where[at].tolist()
                    found.append([hashlib.sha256(view[a : max(a, b - tail)]).hexdigest() for a, b in zip(stop, stop[1:])])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(found[0]), pa.array(found[1])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_round_trip(table(spark, sf_dir, "documents"))

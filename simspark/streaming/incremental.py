"""Incremental recall: new functions of a stream against the stored bucket table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from simspark.functions import columns as C
from simspark.operators import fingerprints, recall
from simspark.params import DEFAULT, Params


def start(spark: SparkSession, source: DataFrame, index_path: str, pairs_path: str, checkpoint: str, params: Params = DEFAULT, delay: str = "1 hour") -> StreamingQuery:
    """source (id long, text string, ts timestamp), streaming: repeated submissions within the delay count once.

    Each micro-batch is fingerprinted row by row, joined to the buckets of all earlier ones, written as pairs (i, j) and then added
    to the index. Tables are written by batch number, so a batch that runs again replaces what it wrote.
    """

    def step(batch: DataFrame, number: int) -> None:
        seq = batch.select("id", C.tokens(F.col("text")).alias("tokens"))
        new = fingerprints.buckets(fingerprints.fingerprint(seq, "id", params=params), "id").persist()
        try:
            new.write.mode("overwrite").parquet(f"{index_path}/batch={number}")
            earlier = spark.read.parquet(index_path).where(F.col("batch") < number).select("band", "bucket", "id")
            across = recall.query_pairs(new, earlier, "id", "id").select(F.least("q", "j").alias("i"), F.greatest("q", "j").alias("j"))
            recall.candidate_pairs(new, "id").unionByName(across).distinct().write.mode("overwrite").parquet(f"{pairs_path}/batch={number}")
        finally:
            new.unpersist()

    once = source.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])
    return once.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

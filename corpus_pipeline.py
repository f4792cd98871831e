"""A training corpus from documents: language ID, near-duplicate removal, removal of repeated strings, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept. All but the last return the columns of documents.

Cases: null texts and texts without a letter go in the first stage; empty texts that the third stage leaves are kept and packed as a
document of the end id; very long texts are used whole; rows that repeat are near duplicates of each other; rows without a doc_id pass
through; extra columns are carried up to packing, whatever their names; an empty table gives an empty table at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simspark.llm import language, minhash, packing, substring_dedup
from simspark.llm.common import Workspace, bounded_batches, table


#: Passages of over 50 words that repeat go, whatever their length in bytes; so do strings of substring_dedup.LENGTH bytes.
PASSAGE_WORDS = 51


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language, which stands in where `lang` is null; those without a letter, null texts included, go."""
    bounded_batches(spark)
    model = language.fit(docs.where(~language.held_out()))
    found = language.predict(docs, model, keep=[c for c in docs.columns if c != "text"], carry_text=True)
    known = found.where(F.col("lang_pred") != language.UNKNOWN)
    if "lang" in docs.columns:
        known = known.withColumn("lang", F.coalesce("lang", "lang_pred"))
    return known.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, one with the smallest doc_id. Rows without a doc_id or a word stay, as they link
    with nothing; rows that share a doc_id are documents of their own."""
    return minhash.one_of_each(Workspace(spark, "pipeline-10"), docs)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that repeat; n_chars counts what is left."""
    left = substring_dedup.dedup_documents(Workspace(spark, "pipeline-1"), docs, words=PASSAGE_WORDS)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and the sequence each lies in."""
    return packing.pack_documents(Workspace(spark, "pipeline-6"), docs)


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_strings),
    ("best_fit_packing", pack),
]

#: SQL can express neither the language model nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus from raw documents: toxicity, near-duplicates, repeated strings, benchmark text, piece ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last
return the columns of documents. run() writes each stage's rows as Parquet to the shared folder and
reads them again, so a later stage never repeats an earlier one, whatever is lost meanwhile; what a stage
has read is then deleted.

Repeated rows repeat in the result unless near_dedup drops their id, ties go to the smaller id, very long
texts pass whole, and empty tables and extra columns of any name are fine in every stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshflow.llm import bag_minhash, decontaminate, piece_viterbi, run_index, shared, toxic_crf


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic. Null and empty texts stay; without labels of both kinds all stay."""
    return toxic_crf.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with the smallest id of each class; texts without words and rows with a null id stay."""
    return bag_minhash.keep_one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with their texts cut and n_chars counted anew; a null id is larger than all."""
    return run_index.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; null and empty texts stay, and all where there are no items."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids, ids_sha256 and round_trip of each row; null texts have no ids."""
    return piece_viterbi.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_benchmark_text),
    ("piece_encoding", encode_pieces),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared.folder(spark)}/corpus_{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if number:
            shared.delete(spark, f"{folder}/{STAGES[number - 1][0]}")
    return docs

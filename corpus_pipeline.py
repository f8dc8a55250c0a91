"""A training corpus from raw documents: reject toxic ones, drop repeated lines, keep one of each group of near copies, drop
documents that hold benchmark passages, pack the rest into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes each stage's result as Parquet to the shared folder and reads it again for the next.  Results come in few
partitions, by the bytes of the stage's input: each file that is written costs processes of the executor's JVM, see ``storage``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm import decontamination, jaccard, lines, packing, toxicity
from moraine.llm.storage import in_few_files, size_of, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the toxicity threshold by the classifier learned from the labelled ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    scored = toxicity.score(docs, model, keep=tuple(F.col(c) for c in COLUMNS[1:]))
    return in_few_files(scored.where("predicted = 0").withColumnRenamed("id", "doc_id").select(*COLUMNS), size_of(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in the corpus before; a document that so loses all its text goes."""
    slim = lines.dedup_lines(docs, exact=1, keep=("lang", "source", "n_chars")).withColumnRenamed("id", "doc_id")
    left = slim.where((F.col("n_removed") == 0) | (F.btrim("text", F.lit(" \t\r\n")) != ""))
    left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return in_few_files(left.select(*COLUMNS), size_of(docs))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked by a shingle Jaccard similarity of 0.8 or more."""
    return in_few_files(jaccard.keep_one(docs).select(*COLUMNS), size_of(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no span of ten words with a benchmark item."""
    clean = decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return in_few_files(clean.select(*COLUMNS), size_of(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the sequences of 4096 tokens."""
    return in_few_files(packing.pack(docs).withColumnRenamed("id", "doc_id"), size_of(docs))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL expresses neither the classifier nor the tokenizer; ``tests/llm`` holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""The operators bound to the standard tables: one query for each, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import SQL as _DECONTAMINATION_SQL
from .jaccard import SQL as _JACCARD_SQL
from .vectors import SQL as _NEAR_VECTORS_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as read back from the token files of all of them: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``."""
    from .token_files import read_token_files, write_token_files

    return read_token_files(write_token_files(_table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of similar texts, its number of links and whether it is the one kept."""
    from .jaccard import jaccard_classes

    return jaccard_classes(_table(spark, sf_dir, "documents")).drop("mark").withColumnRenamed("id", "doc_id")


def _remainder(column: str, by: int) -> Column:
    return F.crc32(F.col(column).cast("string")) % by


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language and score, learned from the documents that are not held out."""
    from .language import identify, learn

    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(_remainder("doc_id", 5) == 0, F.lit(False))
    model = learn(docs, _remainder("doc_id", 5) != 0)
    return identify(docs, model, keep=(held_out.alias("held_out"),)).withColumnRenamed("id", "doc_id")


def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links of cosine 0.9 or more, its component and whether it is the one kept."""
    from .vectors import near_vectors as operator

    return operator(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labelled documents that are not held out."""
    from .toxicity import learn, score

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.coalesce(_remainder("doc_id", 4) == 2, F.lit(False))
    model = learn(docs, labels, _remainder("doc_id", 4) != 2)
    return score(docs, model, keep=(held_out.alias("held_out"),)).withColumnRenamed("id", "doc_id")


def chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's digests, read back from its formatted windows; with one of control strings added."""
    from .chat import conversation_digests, format_windows
    from .storage import written

    hard = "\\### Assistant: </turn> ok"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return conversation_digests(written(format_windows(turns.unionByName(added)), "chat-windows"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words within occurrences of benchmark windows, and the items they belong to."""
    from .decontamination import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items", "text_md5").withColumnRenamed("id", "doc_id")


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand elsewhere before, with its numbers of lines and of removed ones."""
    from .lines import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents"), exact=1).withColumnRenamed("id", "doc_id")


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's visible text with its layout."""
    from .html_text import extract_text

    return extract_text(_table(spark, sf_dir, "pages"), keep=("url",)).withColumnRenamed("id", "page_id")


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and where each stands in the packed sequences."""
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": jaccard_join,
    "op2_language": language,
    "op3_token_files": token_files,
    "op4_near_vectors": near_vectors,
    "op5_toxicity": toxicity,
    "op6_chat_windows": chat_windows,
    "op7_decontamination": decontamination,
    "op8_line_dedup": line_dedup,
    "op9_html_text": html_text,
    "op10_best_fit_packing": best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op1_jaccard_join": _JACCARD_SQL,
    "op4_near_vectors": _NEAR_VECTORS_SQL,
    "op7_decontamination": _DECONTAMINATION_SQL,
}

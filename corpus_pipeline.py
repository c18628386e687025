"""A corpus pipeline of five stages over ``documents``; each stage's rows are written as Parquet and read again.

1. quality: documents that the quality classifier rejects go.
2. lines: repeated chunks of lines go but for their first place; documents left without a line go.
3. near_duplicates: of each group (five-word shingles, similarity 0.8 or more) the least doc_id stays.
4. decontaminate: documents that hold a benchmark item go.
5. pieces: SentencePiece ids of what is left, with a check that they decode to the text.

All but the last stage return the columns of documents. Documents are told apart by doc_id and text: of rows of one doc_id with
different texts each is judged by its own, and equal rows stay or go together. Rows with a null doc_id pass stages 2 and 3 as they are.
A null text is empty: the classifier judges it, and what it keeps passes the other stages. Extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.llm import _common as C
from gritstone.llm import decontaminate, line_dedup, near_dup, quality_model, sentence_pieces


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.good(docs, quality_model.fit(docs, C.table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup(docs).filter((F.col("__lines_out") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" not in docs.columns:
        return rows.select(*docs.columns)
    size = F.when(F.col("__lines_out") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", size).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return C.without(docs, near_dup.near_duplicates(docs, width=5, percent=80).filter("not stays"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, C.table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(docs, sentence_pieces.public_model())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("pieces", pieces),
]

#: A trained classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.save(stage(spark, docs, sf_dir), C.scratch(spark, f"pipeline-{name}"))
    return docs

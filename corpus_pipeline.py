"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the docs of the next. All but the last return the columns of documents; n_chars follows the
text. A stage that drops rows keeps the others as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sameleaf.llm.common import importable, keep_columns, remove, shared_folder, table
from sameleaf.llm.decontamination import decontaminate
from sameleaf.llm.line_dedup import drop_shared_lines
from sameleaf.llm.near_duplicates import keep_one_of_each
from sameleaf.llm.packing import pack_documents
from sameleaf.llm.quality import keep_quality


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _own(docs: DataFrame) -> DataFrame:
    """Only the columns of documents: others could clash with those that a stage adds."""
    return keep_columns(docs, *[c for c in COLUMNS if c in docs.columns])


def _counted(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars of the present text."""
    n = {"n_chars": F.length("text").cast(df.schema["n_chars"].dataType)} if "n_chars" in columns else {}
    return df.withColumns(n).select(*[F.col(f"`{c}`") for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer rejects go, those without words among them. Repeated rows stay or go together."""
    importable(spark)
    return keep_quality(_own(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more go; documents of which nothing but white space is left go, too."""
    importable(spark)
    docs = _own(docs)
    made = drop_shared_lines(docs, texts=True, carry=tuple(docs.columns))
    empty = (F.col("n_dropped") > 0) & (F.trim(F.regexp_replace("kept_text", r"\s+", "")) == "")
    return _counted(made.where(~F.coalesce(empty, F.lit(False))).withColumn("text", F.col("kept_text")), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked (sets of five-word shingles, similarity 0.8 or more) the one with the smallest doc_id stays.

    Five words are the pipeline's own width; op2's contract asks for four. Of rows that share a doc_id one
    stays; a row without doc_id or without words is linked with nothing and stays."""
    importable(spark)
    return keep_one_of_each(_own(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from others with hits the words of the hits are cut. Null texts stay null."""
    docs = _own(docs)
    return _counted(decontaminate(docs, table(spark, sf_dir, "benchmark")), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their digests; a null text is the final id alone."""
    importable(spark)
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: SQL has neither the classifier nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents. Each stage is written to the shared folder, and taken away once the next is."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            remove(spark, before)
        before = at
    return docs

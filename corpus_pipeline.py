"""The corpus pipeline: five stages, each one operator of ``strandflow.llm``; part of that subpackage.

A stage takes the documents that the one before has kept and returns the columns of documents; the last returns the
rows of the token file: id, start, number and checksum of the ids.

Rows of one doc_id are one document: near-duplicate detection keeps or drops them together.  Rows with a null doc_id
are in no group and stay.  Other columns pass every stage unchanged, whatever their names; documents need doc_id, text and
source.  The mix emits a document once or twice; the token file holds each copy as a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm.common import new_path, staged
from strandflow.llm.decontaminate import decontaminate
from strandflow.llm.mixing import emitted, mix
from strandflow.llm.neardup import near_duplicates
from strandflow.llm.quality import weak_quality
from strandflow.llm.queries import VOCABULARY, tokenizer_file
from strandflow.llm.tokens import read_tokens, write_tokens


def carried(docs: DataFrame) -> DataFrame:
    """The columns that stages read, and the whole row as one column ``__doc``: so no column that a document has, of
    whatever name or case, meets an operator's."""
    return docs.select("doc_id", "text", "source", F.struct("*").alias("__doc"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules reject go."""
    return weak_quality(carried(docs), keep=["__doc"]).where("kept").select("__doc.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays."""
    gone = near_duplicates(docs.select("doc_id", "text")).where(~F.col("kept")).select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go.  The result is staged: its documents pass through Python, in batches of few rows."""
    judged = decontaminate(carried(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["__doc"])
    return staged(judged.where(~F.col("contaminated")).select("__doc.*"), "pipeline-clean")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return emitted(mix(carried(docs), keep=["__doc"])).select("__doc.*")


def token_file(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the token file, read back from it."""
    path = write_tokens(docs.select("doc_id", "text"), new_path(spark, "tokens"), tokenizer_file(), vocabulary=VOCABULARY)
    return read_tokens(spark, path, vocabulary=VOCABULARY)


STAGES = [("quality", good_quality), ("near_dedup", one_of_each), ("decontaminate", clean_of_benchmark), ("mix", mixed_sources), ("tokens", token_file)]

#: Neither the posterior of EM nor the signatures are expressible in SQL; tests/llm/test_pipeline.py runs all stages on a
#: small corpus against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES) and stage is not clean_of_benchmark:
            docs = staged(docs, f"pipeline-{name}")
    return docs

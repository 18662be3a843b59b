"""A corpus pipeline of five stages over the documents table, each stage one operator of ``gridloom.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import byte_bpe, exact_dedup, mixing, simhash, toxicity
from gridloom.session import discard, materialize

#: Score from which a document counts as toxic and goes.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC; the model learns from the labels beside the tables."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select("text", F.struct("*").alias("row"))
    return toxicity.score(rows, toxicity.fit(docs, labels), keep=["row"]).where(F.col("score") < TOXIC).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest id."""
    return exact_dedup.exact_dedup(docs, carry=True).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the smallest id (null is last).

    Rows are told apart by their file and place in it, as ids may repeat or be null; documents that are not read from
    files are written first. What goes is a table of its own, so the documents need no shuffle where that is small.
    """
    try:
        placed = _placed(docs)
    except AnalysisException as error:
        if "_metadata" not in str(error):  # any other fault is not about where the rows come from
            raise
        placed = _placed(materialize(docs, "documents"))
    rows = placed.select(F.struct(F.col("doc.doc_id").isNull().alias("last"), "doc.doc_id", "file", "place").alias("key"), "doc.text")
    found = simhash.near_duplicates(rows, id_col="key").where("doc_id != component_id")
    gone = materialize(found.select("doc_id.file", "doc_id.place"), "near-copies")
    return placed.join(gone, ["file", "place"], "left_anti").select("doc.*")


def _placed(docs: DataFrame) -> DataFrame:
    """Each row as ``doc``, with the file that it is read from and its place there."""
    read_from = docs.metadataColumn("_metadata")
    return docs.select(F.struct("*").alias("doc"), read_from["file_path"].alias("file"), read_from["row_index"].alias("place"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to target weights takes it."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source", "text"], with_decoded=True)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL cannot express the stages; tests compare the removal of copies and near copies with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return docs

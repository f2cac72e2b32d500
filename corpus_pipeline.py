"""Corpus pipeline: documents to packed training sequences.

Quality rules, SimHash near-dedup, substring dedup, secret scan, packing.
Each stage works on all that its predecessor kept and returns the columns of
``documents``; the last returns the packed pieces.  ``run`` writes each
stage's result as Parquet to the shared folder and reads it for the next.

In every stage null texts count as texts without words, repeated rows are
rows of their own unless it says otherwise, an empty table gives an empty
result, and further columns come through unchanged whatever their names:
inside a stage all columns but the operators' own have positional names.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.llm import packing, quality, secret_scan, simhash, substring_dedup
from ledgerlens.llm.common import staged, table
from ledgerlens.llm.tokens import tokenizer_path

OWN = ("doc_id", "text", "n_chars")  # the columns stages read or write


def filtering(stage):
    """A stage that returns rows of its input: other columns are x0, x1, ... inside."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inner = [c if c in OWN else f"x{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*inner), sf_dir).select(*inner).toDF(*docs.columns)

    return run


def with_text(docs: DataFrame, text) -> DataFrame:
    """``docs`` with a new text, and its length where there is a column for it."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


@filtering
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality rules keep.  Null and empty texts fail the base
    rules and go; without labels only the base rules judge."""
    return quality.filtered(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@filtering
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (null and empty texts are one) the
    document with the smallest id.  Rows with a null id stay; of rows with one
    id each group of which it is the smallest keeps one, the smallest text, so
    repeated rows become one."""
    return simhash.first_of_groups(docs)


@filtering
def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that a smaller document starts too.
    Texts that lose nothing, null ones too, stay as they are; rows with a null
    id lose nothing, rows of equal id nothing to each other."""
    cut = substring_dedup.dedup(docs)
    return with_text(cut, F.when(F.col("dedup.n_removed") > 0, F.col("dedup.kept")).otherwise(F.col("text")))


@filtering
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret span replaced by a mask; null texts stay null."""
    masked = secret_scan.redact(secret_scan.scan(docs))
    return with_text(masked, F.col("text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all texts, with their ids.  Null and empty texts
    give the end id alone; a repeated row is packed as often as it occurs."""
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring),
    ("secret scan", secrets),
    ("packing", pack),
]

# automata, fingerprints and subset sums are beyond SQL: tests/llm holds a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name.replace(" ", "-"))
    return docs

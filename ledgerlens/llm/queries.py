"""Registered queries of the llm operators.

Each query applies its operator with production parameters to its whole
table and returns the digest columns; ``ORACLE`` has the DuckDB SQL of those
that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline

from . import (ann, bpe_automaton, chat, langid, minhash, packing, prefix_trie, quality, secret_scan, simhash,
               substring_dedup, tokenfile, vector_codes)
from .common import table
from .tokens import tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


@register("op1_packing")
def op1_packing(spark, sf_dir):
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return packed.drop("ids")


@register("op2_simhash")
def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register("op3_secret_scan")
def op3_secret_scan(spark, sf_dir):
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


@register("op4_langid")
def op4_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.identify(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@register("op5_substring_dedup")
def op5_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup(docs).select(
        "doc_id", "dedup.n_words", "dedup.n_removed",
        F.sha2(F.col("dedup.kept").cast("binary"), 256).alias("kept_sha256"))


@register("op6_ann")
def op6_ann(spark, sf_dir):
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


@register("op7_quality")
def op7_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@register("op8_bpe")
def op8_bpe(spark, sf_dir):
    coded = bpe_automaton.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@register("op9_token_file")
def op9_token_file(spark, sf_dir):
    file = tokenfile.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return tokenfile.read_documents(file)


def own_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7: texts that look like a chat template."""
    said = "\\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                 "conv_id long, turn long, role string, text string")


@register("op10_chat")
def op10_chat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    formatted = chat.format_windows(turns.unionByName(own_conversation(spark)), tokenizer_path("byte_bpe_50k.json"))
    return chat.read_back(formatted)


@register("op11_vector_codes")
def op11_vector_codes(spark, sf_dir):
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


@register("op12_prefix_trie")
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@register("op13_minhash")
def op13_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    """The packed pieces; their ids as a digest."""
    return corpus_pipeline.run(spark, sf_dir).drop("ids")

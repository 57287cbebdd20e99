"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import chat_hmm, cotraining, html_layout, importance_radix, kk_packing, matroska, ngram_jaccard, nn_descent, oracles, ownership_secrets, piece_bpe, ring, simhash_tiles, tight_arcs
from factloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Where SQL can express a result.
ORACLES: dict[str, str] = {"op2_ngram_jaccard": oracles.JACCARD, "op3_consistent_ring": oracles.shards(), "op10_ownership_secrets": oracles.SECRETS, "op11_tight_arcs": oracles.repairs(), "op12_importance_radix": oracles.RESAMPLED}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op3_consistent_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shard_texts(table(spark, sf_dir, "documents"))


@query
def op4_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kk_packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_features(table(spark, sf_dir, "documents"))


@query
def op10_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ownership_secrets.scan(docs, owner="source", repository=F.concat_ws("/", "source", "lang"))


def good() -> Column:
    """Of high quality and not toxic."""
    return (F.col("quality") == 1) & (F.col("toxic") == 0)


@query
def op9_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), good())


@query
def op8_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract(table(spark, sf_dir, "pages"))


@query
def op5_chat_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table holds turns; they are first written as raw transcripts, a quarter of them without markers."""
    return chat_hmm.format_conversations(chat_hmm.transcripts(table(spark, sf_dir, "conversations")))


@query
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.join(table(spark, sf_dir, "documents"))


@query
def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(table(spark, sf_dir, "embeddings"))


@query
def op11_tight_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tight_arcs.digests(tight_arcs.repair(tight_arcs.damage(table(spark, sf_dir, "conversations")), copies="copies"))


@query
def op12_importance_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_radix.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_tiles.classes(table(spark, sf_dir, "documents"))

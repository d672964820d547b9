"""Registered queries of the subpackage; ``statements.py`` has their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bpe, clusters, fingerprint, langid, lattice, main_text, minhash, mixing, packing, resampling, suffixes, warc
from lectern.llm.quality import quality

RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    return bpe.digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=["doc_id"])


def op3_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.components(_table(spark, sf, "documents"), shingle=2, percent=80)


def op4_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Languages are the domains, learned from the rows that the table of labels names."""
    docs, weights = _table(spark, sf, "documents"), corpus_pipeline.EVEN
    return mixing.mixed(docs, corpus_pipeline.labelled(spark, docs, sf), weights).drop("posterior")


def op5_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return lattice.scores(_table(spark, sf, "documents"), public_tokenizers.path(PIECES))


def op6_document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.compare_next(_table(spark, sf, "documents"))


def op7_warc(spark: SparkSession, sf: str) -> DataFrame:
    records = warc.round_trip(_table(spark, sf, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op8_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffixes.removal_facts(_table(spark, sf, "documents"))


def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text", "lang")
    held = langid.remainder(docs["doc_id"], 4) == 2
    model = langid.fit(docs.where(~held))
    return langid.predict(docs.withColumn("held_out", held), model, keep=["doc_id", "held_out"])


def op10_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return main_text.extract(_table(spark, sf, "pages"), keep=["page_id", "url"])


def op11_packing(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), keep=["doc_id"], with_ids=False)


def op12_centroid_clustering(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.facts(clusters.fit(_table(spark, sf, "embeddings")))


def op13_target_resampling(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    return resampling.facts(resampling.resample(docs, _table(spark, sf, "benchmark"), keep=["doc_id"]))


_QUERIES = (
    op1_quality_rules, op2_byte_bpe, op3_minhash_near_dedup, op4_source_mixing, op5_lm_scoring, op6_document_fingerprints,
    op7_warc, op8_suffix_array_dedup, op9_language_id, op10_html_extraction, op11_packing, op12_centroid_clustering,
    op13_target_resampling,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES} | {"pipeline": corpus_pipeline.run}

"""Documents to training tokens: five stages, each a DataFrame to the next.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)``. ``run``
writes each stage's rows to the shared folder and gives them to the next one.

1. quality rules: documents that break a rule go;
2. near duplicates (five-word shingles, similarity 0.8): one document of each group stays;
3. repeated passages of more than 50 words are cut from the texts, no document is dropped;
4. mixing: documents of languages below their target weight are repeated, none is dropped;
5. tokens: byte-level BPE ids, and the digest of the text that they decode to.

All stages but the last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, minhash, mixing, suffixes
from lectern.llm.quality import passing
from lectern.session import materialized

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Shares of all tokens by language.
EVEN = {"de": 0.25, "en": 0.25, "es": 0.25, "fr": 0.25}
TARGETS = {"de": 0.18, "en": 0.5, "es": 0.14, "fr": 0.18}
MAX_LABELLED = 20_000
#: Repeated passages of this many words are cut; so many words and the spaces between them have at least ``PASSAGE_BYTES``.
PASSAGE_WORDS = 51
PASSAGE_BYTES = 2 * PASSAGE_WORDS - 1
#: Mixing and tokenizing with a public vocabulary have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def labelled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """At most ``MAX_LABELLED`` documents that the table of labels names, with their language as ``domain``.

    The bound makes the list of ids small enough to be broadcast, so no text is shuffled.
    """
    ids = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("_labelled")).distinct()
    some = F.broadcast(ids.orderBy(F.xxhash64("_labelled")).limit(MAX_LABELLED))
    named = docs.join(some, docs["doc_id"] == some["_labelled"], "left_semi")
    return named.select("text", F.col("lang").alias("domain"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates_removed(docs, shingle=5, percent=80).select(*(f"`{c}`" for c in docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffixes.repeats_removed(docs, PASSAGE_BYTES, min_words=PASSAGE_WORDS)
    return cut.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))


def language_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rates = mixing.mixed(docs, labelled(spark, docs, sf_dir), TARGETS, floor=1.0)
    return mixing.repeated(docs, rates.select("doc_id", "copies"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    return bpe.tokens(docs, path, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"])


STAGES = [
    ("quality", quality_rules),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("mixing", language_mix),
    ("tokens", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents`` of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

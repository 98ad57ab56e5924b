"""From raw documents to token ids: language, repeated lines, near duplicates, mix, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. A null or empty text
has no letters and goes in the first stage; other columns than doc_id, text, lang, source and n_chars are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cuelattice.llm import language_id, line_chunks, pareto_mix, prefix_bpe, superminhash
from cuelattice.session import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are far from every language's centroids, or have no letters, go."""
    told = language_id.identify(docs, language_id.fit(docs))
    return told.filter(~F.col("rejected")).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go; a document of which nothing is left goes with them. n_chars follows the text."""
    told = line_chunks.dedup_lines(docs)
    told = told.filter((F.col("n_removed") == 0) | (F.trim("new_text") != ""))
    changed = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return told.select(*[F.coalesce(F.when(F.col("n_removed") > 0, changed[c]), F.col(f"row.{c}")).alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns])


NEAR_KEY = "near-dedup key"


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least id where ids tell documents apart, and one row of a repeated one. A document without an id, or whose id
    other texts have too, goes by a hash of id and text instead."""
    th = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text")
    shared = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(th).alias("lo"), F.max(th).alias("hi")).filter("lo != hi")
    # Written: mostly it is empty, and the planner should know.
    shared = materialize(shared.select(F.col("doc_id").alias("shared id")), "pipeline-shared-ids")
    met = docs.join(shared, F.col("doc_id") == F.col("shared id"), "left")
    keyed = met.withColumn(NEAR_KEY, F.when(F.col("doc_id").isNull() | F.col("shared id").isNotNull(), th).otherwise(F.col("doc_id").cast("long"))).drop("shared id")
    gone = superminhash.near_duplicates(keyed, key=NEAR_KEY).filter(~F.col("kept")).select(NEAR_KEY).distinct()
    return keyed.join(gone, NEAR_KEY, "left_anti").dropDuplicates([NEAR_KEY]).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return pareto_mix.copied(pareto_mix.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of ids and decoded bytes, one row per copy."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return prefix_bpe.encode_decode(docs, path, public_tokenizers.PATTERN, with_ids=True).drop("same_bytes")


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

# Centroids and shingle signatures have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{i}")
    return docs

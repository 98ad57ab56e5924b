"""The registered queries of the numbered operators, their SQL, and their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cuelattice.llm import (
    balanced_labels, class_lm, language_id, line_chunks, nn_descent, pareto_mix, prefix_bpe, scaled_sketch, superminhash, term_pipeline, token_alignment, token_orc, zstd_quality,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn=None, *, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add if fn is None else add(fn)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(key: str = "doc_id") -> Column:
    """crc32 of the id as text; the folds are its remainders."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))


@query
def op1_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc() % 3 == 1
    model = language_id.fit(docs.filter(~held_out))
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("row.doc_id", "lang_pred", "score", "rejected").withColumn("held_out", held_out)


@query
def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_orc.new_path(spark)
    token_orc.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_orc.checksums(token_orc.read_tokens(spark, path))


@query
def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(table(spark, sf_dir, "embeddings"))


MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
s1 AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w, source_size * 2 AS lim FROM s0),
s2 AS (SELECT *, (SELECT sum(source_size)::DOUBLE FROM s0) * 1.5::DOUBLE AS budget, (SELECT sum(w) FROM s1)::DOUBLE AS all_w FROM s1),
s3 AS (SELECT *, (budget - coalesce(sum(lim) OVER r, 0)::DOUBLE) / (all_w - coalesce(sum(w) OVER r, 0)::DOUBLE) * w > lim AS limited FROM s2
       WINDOW r AS (ORDER BY lim::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT source, source_size, CASE WHEN limited THEN lim::DOUBLE ELSE
         (budget - (SELECT coalesce(sum(lim), 0) FROM s3 WHERE limited)::DOUBLE) * w / (SELECT sum(w) FROM s3 WHERE NOT limited)::DOUBLE END AS target FROM s3),
l0 AS (SELECT source, ceil(sqrt(size::DOUBLE))::DOUBLE AS h, sum(size)::BIGINT AS words FROM d GROUP BY 1, 2),
l1 AS (SELECT l0.*, s4.target, (s4.target - 2 * coalesce(sum(words) OVER (PARTITION BY l0.source ORDER BY h DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / sum(h * words) OVER (PARTITION BY l0.source ORDER BY h DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * h > 2 AS over FROM l0 JOIN s4 ON l0.source IS NOT DISTINCT FROM s4.source),
c AS (SELECT source, (any_value(target) - 2 * coalesce(sum(words) FILTER (over), 0)::DOUBLE) / sum(h * words) FILTER (NOT coalesce(over, false)) AS c FROM l1 GROUP BY 1),
e AS (SELECT d.*, s4.source_size, s4.target, CASE WHEN d.size = 0 THEN 0.0 WHEN s4.target >= 2 * s4.source_size THEN 2.0 ELSE coalesce(least(2.0::DOUBLE, c.c * ceil(sqrt(d.size::DOUBLE))::DOUBLE), 0.0) END::DOUBLE AS copies
      FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source JOIN c ON d.source IS NOT DISTINCT FROM c.source),
n AS (SELECT *, floor(copies) AS sure, copies - floor(copies) AS p FROM e),
r AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (u / (1 - u) + p / (1 - p)) END AS q FROM n),
k AS (SELECT *, target - sum(sure * size) OVER (PARTITION BY source) AS need,
        sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q ASC NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM r)
SELECT doc_id, size, source_size, target,
  (size * (sure + CASE WHEN q IS NOT NULL AND (upto <= need OR (upto - size < need AND upto - need < need - (upto - size))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k"""


@query(sql=MIX_SQL)
def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pareto_mix.mix(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "size", "source_size", "target", "taken")


@query
def op5_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_chunks.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_removed", "new_text")


@query
def op6_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_sketch.edited_pairs(table(spark, sf_dir, "documents"))


@query
def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc() % 10 == 0
    model = class_lm.fit(docs.filter(~held_out))
    out = class_lm.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


@query
def op8_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


@query
def op9_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc() % 5 == 0
    model = zstd_quality.fit(docs.filter(~held_out), table(spark, sf_dir, "labels"))
    out = zstd_quality.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op10_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefix_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op11_balanced_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = balanced_labels.shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


RANK_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS nid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
k AS (SELECT doc_id, nid, ts, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
g AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM k),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
qt AS (SELECT item_id, term, count(*)::BIGINT AS q FROM q GROUP BY 1, 2),
p AS (SELECT nid, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT nid, doc_id, n, unnest(ts) AS term FROM k) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3, 4),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT n_docs FROM g) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p GROUP BY 1),
s AS (SELECT item_id, nid, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * (SELECT n_docs FROM g)) // (SELECT n_terms FROM g)))))::BIGINT AS score
      FROM p JOIN w USING (term) JOIN qt USING (term) GROUP BY 1, 2, 3)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST, nid)::INT AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST, nid) <= 20"""


@query(sql=RANK_SQL)
def op12_term_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_pipeline.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_alignment.align(table(spark, sf_dir, "documents"), *paths)

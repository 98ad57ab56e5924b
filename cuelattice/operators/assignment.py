"""Nearest-entry assignment against a codebook, and ordered dithering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuelattice.session import materialize

# Codes one chunk of the codebook carries; a larger codebook is searched chunk by chunk.
CHUNK = 256


def nearest(rows: DataFrame, row: str, vec: str, codebook: DataFrame, code: str, entry: str, weights: Column | None = None) -> DataFrame:
    """``(row, code, distance)``: smallest weighted squared distance, lower code on a tie.

    The codebook is written first, so its true size is known and Spark itself decides whether it
    may be broadcast. A codebook of several chunks fans a row out once per chunk and keeps the best. Where chunks are joined by shuffle, each is copied to several
    salts, so that a chunk's rows, which are all rows, fill as many tasks as there are.
    """
    packed = codebook.withColumn("chunk", F.floor(F.col(code) / F.lit(CHUNK)).cast("long")).groupBy("chunk").agg(
        F.collect_list(F.struct(F.col(code).alias("code"), F.col(entry).alias("e"))).alias("codes")
    )
    packed = materialize(packed, "codebook")
    last = packed.agg(F.max("chunk")).first()[0]
    if last is None:
        return rows.limit(0).select(row, F.lit(None).cast(codebook.schema[code].dataType).alias(code), F.lit(None).cast("double").alias("distance"))
    salts = max(1, -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // (last + 1)))
    packed = packed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    spread = rows.select(row, vec).withColumn("salt", F.pmod(F.xxhash64(row), F.lit(salts)))
    spread = spread.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
    spread = spread.join(packed, ["chunk", "salt"])
    w = weights if weights is not None else F.lit(None)

    def dist(e: Column) -> Column:
        sq = F.zip_with(vec, e, lambda a, b: (a - b) * (a - b))
        sq = sq if weights is None else F.zip_with(sq, w, lambda s, k: s * k)
        return F.aggregate(sq, F.lit(0.0), lambda acc, s: acc + s)

    best = F.array_min(F.transform("codes", lambda c: F.struct(dist(c["e"]).alias("distance"), c["code"].alias("code"))))
    return spread.withColumn("_b", best).groupBy(row).agg(F.min("_b").alias("_b")).select(row, F.col("_b.code").alias(code), F.col("_b.distance").alias("distance"))


def centroids(rows: DataFrame, label: str, vec: str) -> DataFrame:
    """Mean vector per label; sums combine per (label, dimension) before any vector is built."""
    dims = rows.select(label, F.posexplode(vec).alias("pos", "v")).groupBy(label, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    mean = dims.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("vs"))
    return mean.select(label, F.transform("vs", lambda s: s["v"]).alias("centroid"))


def bayer(n: int) -> list[list[float]]:
    """Threshold matrix by doubling, centred on zero; ``n`` is a power of two."""
    cell = lambda x, y, bits: 0 if bits == 0 else 4 * cell(x % (1 << (bits - 1)), y % (1 << (bits - 1)), bits - 1) + (
        (0, 2, 3, 1)[2 * (y >> (bits - 1)) + (x >> (bits - 1))]
    )
    bits = n.bit_length() - 1
    return [[(cell(x, y, bits) + 0.5) / (n * n) - 0.5 for x in range(n)] for y in range(n)]


def dithered(value: Column, x: Column, y: Column, n: int, spread: float) -> Column:
    flat = F.array(*[F.lit(v) for line in bayer(n) for v in line])
    return value + F.element_at(flat, (y % n * n + x % n + 1).cast("int")) * spread


def uniform_levels(value: Column, steps: float = 5.0) -> Column:
    v = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
    return F.rint(v * steps) / steps


def luma_index(luma: Column, size: int) -> Column:
    v = F.floor(F.least(F.greatest(luma, F.lit(0.0)), F.lit(1.0)) * size)
    return F.least(v, F.lit(size - 1)).cast("int")

"""Ready-made series operators in a registry, for chains over ``(series_id, idx, block, y)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cuelattice.functions import scalars as sc
from cuelattice.operators import mixing as mx, series as se
from cuelattice.plans.chain_runner import Param, Registry

REGISTRY = Registry()
KEYS = ["series_id"]


@REGISTRY.register("gain", "audio", Param("db", "float", 0.0, -60.0, 24.0))
def gain(df: DataFrame, db: float) -> DataFrame:
    return df if db == 0.0 else df.withColumn("y", F.col("y") * 10 ** (db / 20))


@REGISTRY.register("hold_rows", "audio", Param("step", "float", 1.0, 1.0, 1000.0))
def hold_rows(df: DataFrame, step: float) -> DataFrame:
    if step == 1.0:
        return df
    return se.take_at(se.hold(df.drop("y"), KEYS, step), KEYS, df, "src_idx", "y", "y").drop("src_idx")


@REGISTRY.register("bitcrush", "audio", Param("bits", "int", 8, 2, 16), Param("mix", "float", 1.0, 0.0, 1.0))
def bitcrush(df: DataFrame, bits: int, mix: float) -> DataFrame:
    return df.withColumn("y", sc.quantise(F.col("y"), bits, mix))


@REGISTRY.register("soften", "audio", Param("amount", "float", 0.5, 0.0, 1.0))
def soften(df: DataFrame, amount: float) -> DataFrame:
    return mx.convolve(df, KEYS, "y", [1.0 - amount, amount], "_s").withColumn("y", F.col("_s")).drop("_s")


@REGISTRY.register("smooth", "audio", Param("alpha", "float", 0.2, 0.001, 0.999))
def smooth(df: DataFrame, alpha: float) -> DataFrame:
    return se.smooth(df, KEYS, F.col("y"), alpha, "_s").withColumn("y", F.col("_s")).drop("_s")


@REGISTRY.register("drive", "audio", Param("amount", "float", 3.0, 1.0, 20.0), Param("law", "enum", "soft", choices=("soft", "hard", "fuzz", "asym")))
def drive(df: DataFrame, amount: float, law: str) -> DataFrame:
    peak = df.groupBy(*KEYS).agg(F.max(F.abs("y")).alias("_pk"))
    return df.join(peak, KEYS).withColumn("y", sc.drive(F.col("y"), F.col("_pk"), law, amount)).drop("_pk")


def burst_rows(events: DataFrame) -> DataFrame:
    """One row per planned hit of every event: ``k mod 10`` hits half a second apart."""
    hits = events.withColumn("_n", F.col("k") % 10).filter("_n > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return hits.withColumn("id", F.concat_ws(":", F.lit("burst"), "event_id", "i")).withColumn("t", F.col("t") + F.col("i") * 0.5).drop("_n", "i")

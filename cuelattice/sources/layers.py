"""Layer specs: a JSON array of layers per job to typed layer rows, rejects kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cuelattice.schemas import EDIT_DOC, LAYER_DOC


def read_layers(specs: DataFrame, job: str, spec: str) -> tuple[DataFrame, DataFrame]:
    """``(layers, rejects)``: layers in order without the disabled ones, defaults filled in, only
    object edits kept; a job whose spec is no array, empty, lacks a preset or is all disabled is rejected."""
    d = specs.select(job, F.from_json(spec, LAYER_DOC).alias("ls"))
    on = lambda x: F.coalesce(x["enabled"], F.lit(True))
    missing = F.exists("ls", lambda x: F.coalesce(x["preset"], F.lit("")) == "")
    why = (
        F.when(F.col("ls").isNull(), "not an array").when(F.size("ls") == 0, "empty").when(missing, "no preset")
        .when(~F.exists("ls", on), "all disabled")
    )
    d = d.withColumn("error", why)
    rows = d.filter("error IS NULL").select(job, F.posexplode(F.filter("ls", on)).alias("layer_pos", "l"))
    layers = rows.select(
        job, "layer_pos", F.col("l.preset").alias("preset_id"), F.nullif(F.col("l.variant"), F.lit("")).alias("variant_id"), F.col("l.sets").alias("sets"),
        F.coalesce("l.seed", F.lit(1).cast("long")).alias("seed"), F.coalesce("l.intensity", F.lit(1.0)).alias("intensity"),
        F.coalesce("l.texture", F.lit(1.0)).alias("texture"), F.filter(F.coalesce("l.events", F.array().cast("array<string>")), lambda e: F.ltrim(e).startswith("{")).alias("edits"),
    )
    return layers, d.filter("error IS NOT NULL").select(job, "error")


def layer_edits(layers: DataFrame, job: str) -> DataFrame:
    """The edit operations of every layer, in list order."""
    ops = layers.select(job, "layer_pos", F.posexplode("edits").alias("op_pos", "raw"))
    return ops.select(job, "layer_pos", "op_pos", F.from_json("raw", EDIT_DOC).alias("e")).select(job, "layer_pos", "op_pos", "e.*")

"""Layer stacks and phase progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuelattice.functions.scalars import clip, even


def hand_off(layers: DataFrame, clips: DataFrame, job: str) -> DataFrame:
    """Geometry and start of every layer of a stack.

    Only the first layer trims and scales; its even output size is what every later layer reads and
    writes, so one join with the clip replaces a walk along the stack.
    """
    first = F.col("pos") == 0
    out_w = even(F.floor(F.col("width") * F.col("scale")))
    return layers.join(clips, job).select(
        job, "pos", F.when(first, F.col("width").cast("long")).otherwise(out_w).alias("in_w"), out_w.alias("out_w"),
        F.when(first, F.col("clip_t0")).otherwise(F.lit(0.0)).alias("t0"), "clip_t0",
    )


def phase_weights(has_video: bool, has_audio: bool) -> list[tuple[str, float]]:
    """Shares of the bar per phase, in order; only their ratio matters."""
    audio = (0.11 if has_video else 0.52) if has_audio else 0.0
    return [("video", 0.86 if has_video else 0.42), ("audio", audio), ("mux", 0.03), ("done", 0.0)]


def phase_position(phase: Column, fraction: Column, weights: list[tuple[str, float]]) -> Column:
    """Position on the whole bar; null for an unknown phase, which leaves the bar where it is."""
    total = sum(w for _, w in weights) or 1.0
    at, out = 0.0, F.lit(None).cast("double")
    for name, w in weights:
        out = F.when(phase == name, F.lit(at / total) + clip(fraction, 0.0, 1.0) * (w / total)).otherwise(out)
        at += w
    return out

"""Media probe documents: nested JSON to one typed row per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuelattice.schemas import PROBE_DOC


def _present(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def real_video(st: Column) -> Column:
    """A picture stream that plays: no cover art, no single frame without a frame rate."""
    art = F.coalesce(st["disposition"]["attached_pic"], F.lit(0)) != 0
    rate = st["avg_frame_rate"]
    still = (rate.isNull() | rate.isin("0/0", "0/1")) & F.coalesce(st["nb_frames"], F.lit("")).isin("1", "")
    return (st["codec_type"] == "video") & ~art & ~still


def normalise(docs: DataFrame, path: str, doc: str) -> DataFrame:
    """One row per probe document; ``error`` is set when it has neither picture nor sound."""
    d = docs.select(path, F.from_json(doc, PROBE_DOC).alias("d"))
    streams = F.col("d.streams")
    d = d.select(
        path, F.col("d.format.duration").alias("fd"),
        F.try_element_at(F.filter(streams, real_video), F.lit(1)).alias("v"),
        F.try_element_at(F.filter(streams, lambda s: s["codec_type"] == "audio"), F.lit(1)).alias("a"),
    )
    video, audio = F.col("v").isNotNull(), F.col("a").isNotNull()
    rate = F.split(F.coalesce(_present(F.col("v.r_frame_rate")), F.lit("30/1")), "/")
    fps = F.when(video, rate[0].cast("double") / F.greatest(rate[1].cast("double"), F.lit(1.0))).otherwise(F.lit(30.0))
    whole = F.nullif(_present(F.col("fd")).try_cast("double"), F.lit(0.0))
    own = F.when(video, F.col("v.duration")).otherwise(F.col("a.duration")).try_cast("double")
    d = d.withColumn("fps", fps).withColumn("duration", F.coalesce(whole, own, F.lit(0.0)))
    counted = F.nullif(_present(F.col("v.nb_frames")).try_cast("long"), F.lit(0).cast("long"))
    frames = F.coalesce(counted, F.greatest(F.rint(F.col("duration") * F.col("fps")).cast("long"), F.lit(1).cast("long")))
    return d.select(
        path, F.when(~video & ~audio, F.lit("no video or audio stream")).alias("error"),
        F.coalesce(F.col("v.width"), F.lit(0)).alias("width"), F.coalesce(F.col("v.height"), F.lit(0)).alias("height"),
        "fps", "duration", frames.alias("n_frames"), video.alias("has_video"), audio.alias("has_audio"),
        F.coalesce(F.col("a.sample_rate").try_cast("int"), F.lit(48000)).alias("sr"), F.coalesce(F.col("a.channels"), F.lit(2)).alias("channels"),
        F.coalesce(F.col("v.color_space"), F.lit("")).alias("color_space"),
    )

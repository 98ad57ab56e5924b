"""Resampling, repair, dynamics and mixing built from the series passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cuelattice.functions.scalars import clip, db_to_lin, knee_reduction_db
from cuelattice.operators.intervals import expand
from cuelattice.operators.kernels import fold_blocks, follower
from cuelattice.operators.series import (
    block_reduce, exact_percentiles, last_known, next_known, previous, running_max, running_sum, take_at, with_block,
)
from cuelattice.session import block_rows, materialize


def interpolate_known(df: DataFrame, keys: list[str], pos: str, known: Column, out: str) -> DataFrame:
    """Linear interpolation along ``pos`` between rows where ``known`` is not null; ends are held."""
    point = F.when(known.isNotNull(), F.struct(F.col(pos).alias("p"), known.alias("v")))
    df = next_known(last_known(df, keys, point, "_a"), keys, point, "_b")
    f = (F.col(pos) - F.col("_a.p")) / (F.col("_b.p") - F.col("_a.p"))
    mid = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * f
    y = F.when(F.col("_a").isNull(), F.col("_b.v")).when(
        F.col("_b").isNull() | (F.col("_a.p") == F.col("_b.p")), F.col("_a.v")
    ).otherwise(mid)
    return df.withColumn(out, y).drop("_a", "_b")


def upsample_cells(df: DataFrame, keys: list[str], cells: DataFrame, size: int, value: str, out: str) -> DataFrame:
    """Back from one value per cell to one per row, linear between cell centres, ends held."""
    c = with_block(cells.select(*keys, F.col("cell").alias("idx"), F.col(value).alias("_env")))
    c = previous(c, keys, F.col("_env"), "_before")
    after = cells.select(*keys, (F.col("cell") - 1).alias("idx"), F.col(value).alias("_after"))
    c = c.join(after, [*keys, "idx"], "left").select(
        *keys, F.col("idx").alias("_cell"), "_env", F.coalesce("_before", "_env").alias("_before"), F.coalesce("_after", "_env").alias("_after")
    )
    p = F.col("idx") / F.lit(size) - 0.5 - F.col("_cell")
    y = F.when(p < 0, F.col("_before") + (F.col("_env") - F.col("_before")) * (p + 1)).otherwise(
        F.col("_env") + (F.col("_after") - F.col("_env")) * p
    )
    return (
        df.withColumn("_cell", F.floor(F.col("idx") / F.lit(size)).cast("long"))
        .join(c, [*keys, "_cell"])
        .withColumn(out, y)
        .drop("_cell", "_env", "_before", "_after")
    )


def follow_cells(
    df: DataFrame, keys: list[str], value: Column, size: int, stat: str, dt: float,
    attack_ms: float, release_ms: float, rising_is_attack: bool = True,
) -> DataFrame:
    """Detector per cell (``peak``, ``rms`` or ``low``) run through the attack/release follower."""
    cells = block_reduce(df, keys, value, size).select(*keys, F.col("cell").alias("idx"), F.col(stat).alias("det"))
    k = follower(dt, attack_ms, release_ms, rising_is_attack)
    env = fold_blocks(with_block(cells), keys, ["det"], k, "env", tol=1e-13)
    # One row per cell; written once, because the neighbours of a cell are read from it as well.
    return materialize(env.select(*keys, F.col("idx").alias("cell"), "env"), "cells")


def envelope(df, keys, value: Column, size: int, stat: str, dt: float, attack_ms: float, release_ms: float, out: str) -> DataFrame:
    cells = follow_cells(df, keys, F.abs(value), size, stat, dt, attack_ms, release_ms)
    return upsample_cells(df, keys, cells, size, "env", out)


def smooth_gain(df, keys, gain: Column, size: int, dt: float, attack_ms: float, release_ms: float, out: str) -> DataFrame:
    """The fastest dip of each cell, attack meaning a falling gain."""
    cells = follow_cells(df, keys, gain, size, "low", dt, attack_ms, release_ms, rising_is_attack=False)
    return upsample_cells(df, keys, cells, size, "env", out)


def gain_ride(df, keys, x: str, size: int, dt: float, target_db: float, max_gain_db: float, attack_ms: float, release_ms: float, amount: float) -> DataFrame:
    """Automatic level: pull the envelope to a target within -24 dB and the allowed boost."""
    df = envelope(df, keys, F.col(x), size, "rms", dt, 15.0, 80.0, "env")
    want = clip(db_to_lin(F.lit(target_db)) / F.greatest(F.col("env"), F.lit(1e-5)), 10 ** (-24 / 20), 10 ** (max_gain_db / 20))
    df = smooth_gain(df.withColumn("_want", want), keys, F.col("_want"), size, dt, attack_ms, release_ms, "_g")
    return df.withColumn("gain", F.pow(F.col("_g"), F.lit(amount))).withColumn("y", F.col(x) * F.col("gain")).drop("_want", "_g")


def compress(df, keys, x: str, size: int, dt: float, threshold_db: float, ratio: float, knee_db: float, attack_ms: float, release_ms: float, makeup_db: float) -> DataFrame:
    """Soft-knee compression ridden by the gain smoother."""
    df = envelope(df, keys, F.col(x), size, "rms", dt, 0.5, 30.0, "env")
    level = F.log10(F.greatest(F.col("env"), F.lit(1e-6))) * 20.0
    raw = F.pow(F.lit(10.0), -knee_reduction_db(level, threshold_db, ratio, knee_db) / 20.0)
    df = smooth_gain(df.withColumn("_raw", raw), keys, F.col("_raw"), size, dt, attack_ms, release_ms, "gain")
    return df.withColumn("y", F.col(x) * F.col("gain") * 10 ** (makeup_db / 20)).drop("_raw")


def duck(df, keys, x: str, bed: str, size: int, dt: float, depth: float, level_db: float) -> DataFrame:
    """Bed brought to a level, then turned down where the programme is loud, then mixed in."""
    rms = df.groupBy(*keys).agg((F.sqrt(F.avg(F.col(bed) * F.col(bed))) + 1e-12).alias("_rms"))
    df = envelope(df, keys, F.col(x), size, "rms", dt, 30.0, 700.0, "env")
    ref = exact_percentiles(df, keys, "env", {"_p90": 0.9})
    loud = clip(F.col("env") / (F.col("_p90") + 1e-9), 0.0, 1.2)
    gain = F.pow(F.lit(10.0), loud * (-8.0 * depth) / 20.0)
    bed_level = 10 ** (level_db / 20) / (F.col("_rms") + 1e-12)
    return df.join(rms, keys).join(ref, keys).withColumn(
        "y", F.col(x) + F.col(bed) * bed_level * gain
    ).drop("_rms", "_p90")


def compose_remaps(spine: DataFrame, keys: list[str], n: str, maps: list) -> DataFrame:
    """Fold time remaps last to first, clip to the clip, then forbid going back.

    A map is a column function of the position (composed without touching data) or a table
    ``(keys, out_frame, src_frame)``. No maps leaves the identity, with no join and no pass.
    """
    df = spine.withColumn("src", F.col("idx"))
    last = F.col(n).cast("long") - 1
    for m in reversed(maps):
        if isinstance(m, DataFrame):
            hop = m.select(*keys, F.col("out_frame").alias("src"), F.col("src_frame").alias("_to"))
            df = df.join(hop, [*keys, "src"]).withColumn("src", F.col("_to")).drop("_to")
        else:
            df = df.withColumn("src", m(F.col("src")))
        df = df.withColumn("src", F.least(F.greatest(F.col("src"), F.lit(0).cast("long")), last))
    return running_max(df, keys, F.col("src"), "src_frame").drop("src") if maps else df.withColumnRenamed("src", "src_frame")


def apply_remap(remap: DataFrame, keys: list[str], rows: DataFrame, cols: list[str]) -> DataFrame:
    src = rows.select(*keys, F.col("idx").alias("src_frame"), *cols)
    return remap.join(src, [*keys, "src_frame"])


def loop_join(df: DataFrame, bed: DataFrame, m: int, value: str, out: str) -> DataFrame:
    """Long series against a short bed that repeats every ``m`` rows."""
    b = bed.select(F.col("idx").alias("_b"), F.col(value).alias(out))
    return df.withColumn("_b", F.pmod(F.col("idx"), F.lit(m))).join(b, "_b").drop("_b")


def reassemble(slices: DataFrame, keys: list[str], bed: DataFrame, value: str, xf: int, n: str, out: str) -> DataFrame:
    """Lay bed slices end to end with equal-power crossfades of ``xf`` rows.

    ``slices`` carries ``(keys, slice, start, length, pos, n)``; the first slice has no fade-in and
    every slice fades out under its successor.
    """
    last = slices.groupBy(*keys).agg(F.max("slice").alias("_last"))
    rows = expand(slices.filter("length > 0").join(last, keys), F.lit(0).cast("long"), F.col("length") - 1, "_k")
    rows = rows.withColumn("idx", F.col("pos") + F.col("_k")).filter(F.col("idx") < F.col(n))
    head = F.when((F.col("slice") > 0) & (F.col("_k") < xf), F.sqrt(F.col("_k") / float(xf - 1))).otherwise(F.lit(1.0))
    j = F.col("_k") - (F.col("length") - xf)
    tail = F.when((F.col("slice") < F.col("_last")) & (j >= 0), F.sqrt(F.lit(1.0) - j / float(xf - 1))).otherwise(F.lit(1.0))
    rows = rows.withColumn("_w", head * tail).withColumn("_b", F.col("start") + F.col("_k"))
    b = bed.select(F.col("idx").alias("_b"), F.col(value).alias("_x"))
    return rows.join(b, "_b").groupBy(*keys, "idx").agg(F.sum(F.col("_x") * F.col("_w")).alias(out))


def mix_at(base: DataFrame, keys: list[str], clips: DataFrame, lengths: DataFrame, value: str, out: str) -> DataFrame:
    """Add short clips ``(keys, start, len, amp)`` into the timeline, clipped to its ends."""
    parts = expand(clips.filter("len > 0"), F.col("start").cast("long"), (F.col("start") + F.col("len") - 1).cast("long"), "idx")
    parts = parts.join(lengths, keys).filter((F.col("idx") >= 0) & (F.col("idx") < F.col("n")))
    both = base.select(*keys, "idx", F.col(value).alias("_x")).unionByName(parts.select(*keys, "idx", F.col("amp").alias("_x")))
    return both.groupBy(*keys, "idx").agg(F.sum("_x").alias(out))


def overwrite(df: DataFrame, keys: list[str], damage: DataFrame, value: str, out: str) -> DataFrame:
    """Replace rows inside damage intervals ``(keys, start, stop, kind, loop)``; the later start wins.

    ``mute`` writes 0, ``hold`` the last value before the interval, ``stutter`` repeats the ``loop``
    rows before the interval.
    """
    hit = expand(damage.filter("stop > start"), F.col("start").cast("long"), (F.col("stop") - 1).cast("long"), "idx")
    hit = hit.groupBy(*keys, "idx").agg(F.max(F.struct("start", "kind", "loop")).alias("_d"))
    src = (
        F.when(F.col("_d.kind") == "hold", F.col("_d.start") - 1)
        .when(F.col("_d.kind") == "stutter", F.col("_d.start") - F.col("_d.loop") + (F.col("idx") - F.col("_d.start")) % F.col("_d.loop"))
        .otherwise(F.col("idx"))
    )
    marked = df.join(hit, [*keys, "idx"], "left").withColumn("_src", src.cast("long"))
    fresh = marked.filter(F.col("_src") == F.col("idx")).withColumn(
        out, F.when(F.col("_d.kind") == "mute", F.lit(0.0)).otherwise(F.col(value))
    )
    moved = take_at(marked.filter(F.col("_src") != F.col("idx")), keys, df, "_src", value, out)
    moved = moved.withColumn(out, F.coalesce(out, F.col(value)))
    return fresh.unionByName(moved).drop("_d", "_src")


def convolve(df: DataFrame, keys: list[str], value: str, taps: list[float], out: str) -> DataFrame:
    """Causal FIR ``y[n] = sum h[k] x[n-k]``, zero before the start.

    The last rows of a block are copied into the next one, so a single shuffle on (keys, block)
    serves every tap.
    """
    reach, size = len(taps) - 1, block_rows(df.sparkSession)
    if reach > size:
        raise ValueError("a block must be longer than the kernel")
    late = F.col("idx") - F.col("block") * F.lit(size) >= size - reach
    wide = df.withColumn("_home", F.col("block")).withColumn(
        "block", F.explode(F.when(late, F.array("block", F.col("block") + 1)).otherwise(F.array("block")))
    )
    w = Window.partitionBy(*keys, "block").orderBy("idx")
    y = F.lit(0.0)
    for k, h in enumerate(taps):
        y = y + F.coalesce(F.lag(value, k).over(w), F.lit(0.0)) * F.lit(float(h))
    return wide.withColumn(out, y).filter("block = _home").drop("_home")


def multi_tap(df: DataFrame, keys: list[str], value: str, delay: int, gain: float, repeats: int, lows: list[float], lengths: DataFrame, out: str) -> DataFrame:
    """Echoes at ``r * delay``: each repeat low-passed once more and scaled once more, cut at the end."""
    parts = df.select(*keys, "idx", F.col(value).alias("_x"))
    layer = df.select(*keys, "idx", "block", F.col(value).alias("_x"))
    for r in range(1, repeats + 1):
        layer = convolve(layer, keys, "_x", lows, "_y").select(*keys, "idx", "block", (F.col("_y") * gain).alias("_x"))
        echo = layer.select(*keys, (F.col("idx") + r * delay).alias("idx"), "_x")
        parts = parts.unionByName(echo)
    return parts.join(lengths, keys).filter("idx < n").groupBy(*keys, "idx").agg(F.sum("_x").alias(out))


def zero_cross_near(df: DataFrame, keys: list[str], value: str, n: str, reach: int, out: str) -> DataFrame:
    """Index of the rising zero crossing nearest to each row within ``reach`` rows, else the row itself."""
    df = previous(df, keys, F.col(value), "_prev")
    inner = (F.col("idx") >= 1) & (F.col("idx") < F.col(n) - 1)
    at = F.when(inner & (F.col("_prev") <= 0) & (F.col(value) > 0), F.col("idx"))
    df = next_known(last_known(df.withColumn("_at", at), keys, F.col("_at"), "_a"), keys, F.col("_at"), "_b")
    lo = F.greatest(F.col("idx") - reach, F.lit(1))
    hi = F.least(F.col("idx") + reach, F.col(n) - 1)
    a = F.when(F.col("_a") >= lo, F.col("_a"))
    b = F.when(F.col("_b") < hi, F.col("_b"))
    near = F.when(b.isNull() | (F.col("idx") - a <= b - F.col("idx")), F.coalesce(a, b, F.col("idx"))).otherwise(b)
    return df.withColumn(out, near).drop("_prev", "_at", "_a", "_b")


def read_positions(df: DataFrame, keys: list[str], speed: Column, out: str) -> DataFrame:
    """Variable-speed read position: the integral of speed up to, not including, the row."""
    return running_sum(df.withColumn("_s", speed), keys, F.col("_s"), "_cum").withColumn(
        out, F.col("_cum") - F.col("_s")
    ).drop("_s", "_cum")

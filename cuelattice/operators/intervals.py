"""Intervals against grids and points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuelattice.functions.scalars import edge_profile
from cuelattice.operators.series import index_rows, running_sum, with_block
from cuelattice.session import spread

# Longest list of frames that one row is expanded to at a time.
PIECE = 1 << 14


def on_grid(intervals: DataFrame, frame: str = "frame", k: str = "k") -> DataFrame:
    """One row per frame an interval ``[start, start+dur)`` covers; an empty interval covers none."""
    zero, last = F.lit(0).cast("long"), F.col("dur").cast("long") - 1
    return expand(intervals.filter("dur > 0"), zero, last, k).withColumn(frame, F.col("start") + F.col(k))


def expand(df: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """One row per whole number from ``first`` to ``last`` (not below it).

    Spans longer than a piece are cut into pieces, and the pieces are dealt to all tasks before they are expanded, so neither a list nor a task grows with a span.
    """
    piece = F.lit(PIECE).cast("long")
    short = df.filter(last - first < piece).withColumn(name, F.explode(F.sequence(first, last)))
    cut = df.filter(last - first >= piece).withColumn("_from", F.explode(F.sequence(first, last, piece))).withColumn("_to", F.least(F.col("_from") + (PIECE - 1), last))
    return short.unionByName(spread(cut, "_from").withColumn(name, F.explode(F.sequence(F.col("_from"), F.col("_to")))).drop("_from", "_to"))


def strongest(cells: DataFrame, keys: list[str], level: str, attrs: list[str], tie: list[str]) -> DataFrame:
    """Each frame takes the strongest covering value and that interval's attributes; earlier wins a tie.

    The per-frame maximum combines map-side, so a frame under very many intervals stays cheap.
    """
    best = F.min(F.struct((-F.col(level)).alias("_s"), *tie, *[a for a in attrs if a not in tie])).alias("_b")
    return cells.groupBy(*keys, "frame").agg(best).select(
        *keys, "frame", (-F.col("_b._s")).alias(level), *[F.col(f"_b.{a}").alias(a) for a in attrs]
    )


def glitch_profile(intervals: DataFrame, amp: str, out: str) -> DataFrame:
    cells = on_grid(intervals)
    return cells.withColumn(out, edge_profile(F.col("k"), F.col("dur"), F.col(amp)))


def active_at(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, bucket: int) -> DataFrame:
    """Intervals covering each point, as an equi-join on time buckets plus the exact test.

    An interval is copied to every bucket it touches; a point lies in one bucket, so no pair is
    found twice.
    """
    cut = lambda c: F.floor(c / F.lit(bucket)).cast("long")
    iv = expand(intervals.filter("dur > 0"), cut(F.col("start")), cut(F.col("start") + F.col("dur") - 1), "_bk")
    pts = points.withColumn("_bk", cut(F.col(at)))
    return pts.join(iv, [*keys, "_bk"]).filter(
        (F.col(at) >= F.col("start")) & (F.col(at) < F.col("start") + F.col("dur"))
    ).drop("_bk")


def longest_and_most(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Longest hold and the largest number of intervals open at one time."""
    edges = intervals.select(*keys, F.explode(F.array(
        F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct((F.col("start") + F.col("dur")).alias("at"), F.lit(-1).alias("step"))
    )).alias("e")).select(*keys, "e.*")
    # Equal times collapse to one net step first, so closing at t frees the slot for opening at t.
    net = edges.groupBy(*keys, "at").agg(F.sum("step").alias("step"))
    swept = running_sum(with_block(index_rows(net, keys, ["at"])), keys, F.col("step"), "open")
    most = swept.groupBy(*keys).agg(F.max("open").alias("most_open"))
    return intervals.groupBy(*keys).agg(F.max("dur").alias("longest")).join(most, keys)


def relaxed(tears: DataFrame, keys: list[str], level: str) -> DataFrame:
    """Tears plus a half-strength row on the next frame unless another tear is there."""
    after = tears.withColumn("frame", F.col("frame") + 1).withColumn(level, F.col(level) * 0.5).withColumn("relaxing", F.lit(True))
    occupied = tears.select(*keys, "frame").distinct()
    return tears.withColumn("relaxing", F.lit(False)).unionByName(after.join(occupied, [*keys, "frame"], "left_anti"))


def dips(intervals: DataFrame, keys: list[str], depth_db: Column) -> DataFrame:
    """Overlapping raised-cosine dips combined by their lowest gain."""
    import math

    cells = on_grid(intervals.withColumn("_floor", F.lit(1.0) - F.pow(F.lit(10.0), -depth_db / 20.0)))
    span = F.greatest(F.col("dur") - 1, F.lit(1))
    env = F.lit(0.5) - F.cos(F.col("k") / span * (2.0 * math.pi)) * 0.5
    return cells.withColumn("_g", F.lit(1.0) - env * F.col("_floor")).groupBy(*keys, "frame").agg(F.min("_g").alias("gain"))

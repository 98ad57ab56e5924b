"""Ordered passes over series, written so that one very long series is still many tasks.

A series row is ``(keys..., idx, ...)``. ``idx`` counts from 0 inside the key and
``block = idx div block_rows``. Every pass works on ``(keys, block)`` groups, whose size is
bounded, and carries a one-row summary per block from block to block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from cuelattice.session import DIRECT_ROWS_KEY, block_rows, materialize

INF = Window.unboundedPreceding


def index_rows(df: DataFrame, keys: list[str], order: list[str], idx: str = "idx") -> DataFrame:
    """Give each row its 0-based position inside its key.

    A plain ``row_number`` would sort a whole key in one task. Here the rows are range-sorted on
    key *and* order columns (so a hot key spreads over many partitions), written once, and the
    position is the position inside the partition plus the counts of the key's earlier partitions.
    """
    placed = materialize(df.sort(*keys, *order).withColumn("_mid", F.monotonically_increasing_id()), "sorted")
    placed = placed.withColumn("_pid", F.shiftright("_mid", 33))
    runs = placed.groupBy(*keys, "_pid").agg(F.min("_mid").alias("_m0"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(INF, -1)
    runs = runs.withColumn("_off", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return (
        placed.join(runs, [*keys, "_pid"])
        .withColumn(idx, F.col("_mid") - F.col("_m0") + F.col("_off"))
        .drop("_mid", "_pid", "_m0", "_off")
    )


def with_block(df: DataFrame, size: int | None = None, idx: str = "idx", block: str = "block") -> DataFrame:
    size = size or block_rows(df.sparkSession)
    return df.withColumn(block, F.floor(F.col(idx) / F.lit(size)).cast("long"))


def _local(keys: list[str]):
    return Window.partitionBy(*keys, "block").orderBy("idx")


def _carry(df: DataFrame, keys: list[str], summary: Column, over_blocks) -> DataFrame:
    """One row per block with ``_c``: the combination of the summaries of all earlier blocks."""
    blocks = df.groupBy(*keys, "block").agg(summary.alias("_s"))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(INF, -1)
    return blocks.select(*keys, "block", over_blocks(F.col("_s"), earlier).alias("_c"))


def running_sum(df: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    df = df.withColumn("_v", value)
    carry = _carry(df, keys, F.sum("_v"), lambda s, w: F.sum(s).over(w))
    local = F.sum("_v").over(_local(keys).rowsBetween(INF, 0))
    return (
        df.withColumn("_l", local)
        .join(carry, [*keys, "block"])
        .withColumn(out, F.coalesce("_c", F.lit(0)) + F.coalesce("_l", F.lit(0)))
        .drop("_v", "_l", "_c")
    )


def running_max(df: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    df = df.withColumn("_v", value)
    carry = _carry(df, keys, F.max("_v"), lambda s, w: F.max(s).over(w))
    local = F.max("_v").over(_local(keys).rowsBetween(INF, 0))
    return (
        df.withColumn("_l", local)
        .join(carry, [*keys, "block"])
        .withColumn(out, F.greatest("_l", "_c"))
        .drop("_v", "_l", "_c")
    )


def last_known(df: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """Most recent non-null value at or before the row."""
    df = df.withColumn("_v", value)
    newest = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("idx")))
    carry = _carry(df, keys, newest, lambda s, w: F.last(s, ignorenulls=True).over(w))
    local = F.last("_v", ignorenulls=True).over(_local(keys).rowsBetween(INF, 0))
    return (
        df.withColumn("_l", local)
        .join(carry, [*keys, "block"])
        .withColumn(out, F.coalesce("_l", "_c"))
        .drop("_v", "_l", "_c")
    )


def next_known(df: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """Nearest non-null value at or after the row."""
    df = df.withColumn("_v", value)
    blocks = df.groupBy(*keys, "block").agg(F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col("idx"))).alias("_s"))
    later = Window.partitionBy(*keys).orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    carry = blocks.select(*keys, "block", F.first("_s", ignorenulls=True).over(later).alias("_c"))
    local = F.first("_v", ignorenulls=True).over(_local(keys).rowsBetween(0, Window.unboundedFollowing))
    return (
        df.withColumn("_l", local)
        .join(carry, [*keys, "block"])
        .withColumn(out, F.coalesce("_l", "_c"))
        .drop("_v", "_l", "_c")
    )


def previous(df: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """The value one row earlier; only a block's first row looks across the block edge."""
    df = df.withColumn("_v", value)
    ends = df.groupBy(*keys, "block").agg(F.max_by("_v", "idx").alias("_c"))
    ends = ends.withColumn("block", F.col("block") + 1)
    w = _local(keys)
    return (
        df.withColumn("_l", F.lag("_v").over(w))
        .withColumn("_first", F.row_number().over(w) == 1)
        .join(ends, [*keys, "block"], "left")
        .withColumn(out, F.when(F.col("_first"), F.col("_c")).otherwise(F.col("_l")))
        .drop("_v", "_l", "_c", "_first")
    )


def islands(df: DataFrame, keys: list[str], active: Column, run: str = "run_start") -> DataFrame:
    """Maximal runs of active rows: keeps the active rows and tags each with its run's first idx."""
    on = previous(df.filter(active), keys, F.col("idx"), "_was")
    opens = F.when(F.col("_was").isNull() | (F.col("_was") != F.col("idx") - 1), F.col("idx"))
    return last_known(on, keys, opens, run).drop("_was")


def episodes(df: DataFrame, keys: list[str], active: Column, level: Column) -> DataFrame:
    """Start, length and peak of every run."""
    runs = islands(df.withColumn("_level", level), keys, active)
    return runs.groupBy(*keys, "run_start").agg(
        F.count(F.lit(1)).alias("length"), F.max("_level").alias("peak")
    )


def longest_run(df: DataFrame, keys: list[str], active: Column) -> DataFrame:
    """First longest run of each key: ``(start, stop)``, stop inclusive."""
    runs = episodes(df, keys, active, F.lit(0.0))
    best = F.max_by("run_start", F.struct("length", -F.col("run_start")))
    return runs.groupBy(*keys).agg(best.alias("start"), F.max("length").alias("_n")).select(
        *keys, "start", (F.col("start") + F.col("_n") - 1).alias("stop")
    )


def smooth(df: DataFrame, keys: list[str], value: Column, alpha: float, out: str) -> DataFrame:
    """``y = y + (x - y) * alpha``, the first value seeding ``y``."""
    df = df.withColumn("_x", F.when(F.col("idx") == 0, value).otherwise(value * F.lit(alpha)))
    return _decayed_sum(df, keys, 1.0 - alpha, out).drop("_x")


def _decayed_sum(df: DataFrame, keys: list[str], a: float, out: str) -> DataFrame:
    """``y_i = a * y_{i-1} + _x_i`` for 0 < a < 1.

    Inside a span of m rows ``y`` is a prefix sum of ``x * a**-k`` times ``a**k``; m is chosen so
    that ``a**-m`` stays in range. Span ends form a shorter series with factor ``a**m`` and go
    through the same pass, until ``a**m`` is below double precision and one span back is enough.
    """
    if not 0.0 < a < 1.0:
        raise ValueError("smoothing factor must lie strictly between 0 and 1")
    m = max(1, min(block_rows(df.sparkSession), int(200.0 / -math.log(a))))
    am = a**m
    df = df.withColumn("_span", F.floor(F.col("idx") / F.lit(m)).cast("long")).withColumn("_k", F.col("idx") % F.lit(m))
    w = Window.partitionBy(*keys, "_span").orderBy("idx").rowsBetween(INF, 0)
    df = df.withColumn("_y", F.sum(F.col("_x") * F.pow(F.lit(a), -F.col("_k"))).over(w) * F.pow(F.lit(a), F.col("_k")))
    ends = df.groupBy(*keys, "_span").agg(F.max_by("_y", "idx").alias("_x"))
    ends = ends.select(*keys, F.col("_span").alias("idx"), "_x")
    if am >= 1e-30 and not _single_span(ends):
        ends = _decayed_sum(materialize(ends, "spans"), keys, am, "_x2").select(*keys, "idx", F.col("_x2").alias("_x"))
    carry = ends.select(*keys, (F.col("idx") + 1).alias("_span"), F.col("_x").alias("_c"))
    return (
        df.join(carry, [*keys, "_span"], "left")
        .withColumn(out, F.col("_y") + F.coalesce("_c", F.lit(0.0)) * F.pow(F.lit(a), F.col("_k") + 1))
        .drop("_span", "_k", "_y", "_c")
    )


def _single_span(ends: DataFrame) -> bool:
    """Cheap answer from the span table: does any key have a second span?"""
    return ends.filter("idx > 0").isEmpty()


def decaying_max(df: DataFrame, keys: list[str], value: Column, ratio: float, out: str) -> DataFrame:
    """``y = max(x, ratio * y_prev)`` for x >= 0: a running max of logarithms picks the row whose
    decayed value rules, and that row's value is decayed by the distance.

    Levels count from the block start, so precision does not fall with series length.
    """
    if not 0.0 < ratio < 1.0:
        raise ValueError("ratio must lie strictly between 0 and 1")
    lr = math.log(ratio)
    span = F.lit(block_rows(df.sparkSession) * lr)
    k = (F.col("idx") - F.col("block") * F.lit(block_rows(df.sparkSession))).cast("double")
    level = F.log(value) - k * F.lit(lr)
    df = df.withColumn("_v", F.when(value > 0, F.struct(level.alias("l"), value.alias("x"), F.col("idx").alias("i"))))
    lift = lambda c, by: F.when(c.isNotNull(), F.struct((c["l"] + by).alias("l"), c["x"].alias("x"), c["i"].alias("i")))
    blocks = df.groupBy(*keys, "block").agg(F.max("_v").alias("_s"))
    # A block's level measured on a scale shared by all of the key's blocks, and back again.
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(INF, -1)
    blocks = blocks.withColumn("_s", lift(F.col("_s"), -F.col("block") * span)).withColumn("_c", F.max("_s").over(earlier))
    carry = blocks.select(*keys, "block", lift(F.col("_c"), F.col("block") * span).alias("_c"))
    local = F.max("_v").over(_local(keys).rowsBetween(INF, 0))
    return (
        df.withColumn("_l", local)
        .join(carry, [*keys, "block"])
        .withColumn("_m", F.greatest("_l", "_c"))
        .withColumn(out, F.coalesce(F.col("_m.x") * F.pow(F.lit(ratio), F.col("idx") - F.col("_m.i")), F.lit(0.0)))
        .drop("_v", "_l", "_c", "_m")
    )


def block_reduce(df: DataFrame, keys: list[str], value: Column, size: int) -> DataFrame:
    """Max, rms and min of fixed-size blocks; the last block is filled up with the series' last value."""
    cell = F.floor(F.col("idx") / F.lit(size)).cast("long")
    g = df.withColumn("cell", cell).withColumn("_v", value).groupBy(*keys, "cell").agg(
        F.max("_v").alias("_mx"),
        F.min("_v").alias("_mn"),
        F.sum(F.col("_v") * F.col("_v")).alias("_ss"),
        F.count(F.lit(1)).alias("_n"),
        F.max_by("_v", "idx").alias("_last"),
    )
    fill = F.lit(size) - F.col("_n")
    return g.select(
        *keys,
        "cell",
        F.col("_mx").alias("peak"),
        F.sqrt((F.col("_ss") + fill * F.col("_last") * F.col("_last")) / F.lit(size)).alias("rms"),
        F.col("_mn").alias("low"),
    )


def hold(df: DataFrame, keys: list[str], step: float) -> DataFrame:
    """Zero-order hold: the index each row reads, ``floor(floor(i/step)*step)``."""
    return df.withColumn("src_idx", F.floor(F.floor(F.col("idx") / F.lit(step)) * F.lit(step)).cast("long"))


def take_at(df: DataFrame, keys: list[str], source: DataFrame, at: str, value: str, out: str) -> DataFrame:
    """Read ``source.value`` at position ``at``; a missing position gives null."""
    src = source.select(*keys, F.col("idx").alias(at), F.col(value).alias(out))
    return df.join(src, [*keys, at], "left")


def lerp_at(df: DataFrame, keys: list[str], source: DataFrame, pos: str, value: str, out: str) -> DataFrame:
    """Linear interpolation at fractional ``pos`` from the two neighbours; past the end reads 0."""
    df = df.withColumn("_p0", F.floor(F.col(pos)).cast("long"))
    # Each source row serves the position before it (as right neighbour) and its own.
    pairs = source.select(
        *keys,
        F.explode(F.array(
            F.struct(F.col("idx").alias("_p0"), F.col(value).alias("_a"), F.lit(None).cast("double").alias("_b")),
            F.struct((F.col("idx") - 1).alias("_p0"), F.lit(None).cast("double").alias("_a"), F.col(value).alias("_b")),
        )).alias("_e"),
    ).select(*keys, "_e.*")
    pairs = pairs.groupBy(*keys, "_p0").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    f = F.col(pos) - F.col("_p0")
    return (
        df.join(pairs, [*keys, "_p0"], "left")
        .withColumn(out, F.when(f == 0, F.coalesce("_a", F.lit(0.0))).when(
            F.col("_a").isNull() | F.col("_b").isNull(), F.lit(0.0)
        ).otherwise(F.col("_a") * (1 - f) + F.col("_b") * f))
        .drop("_p0", "_a", "_b")
    )


def fit_length(df: DataFrame, keys: list[str], lengths: DataFrame, value: str, block: int | None = None) -> DataFrame:
    """Trim or zero-pad each series to ``lengths.n`` rows."""
    from cuelattice.operators.schedules import spine

    grid = spine(lengths, keys, "n")
    return grid.join(df.select(*keys, "idx", value), [*keys, "idx"], "left").withColumn(
        value, F.coalesce(value, F.lit(0.0))
    )


def exact_percentiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated percentiles per key. ``qs`` maps output names to fractions.

    Spark's own ``percentile`` keeps a key's distinct values in one task, so it serves keys up to a
    checked number of rows; larger keys are narrowed down by histograms. Both are exact.
    """
    limit = int(df.sparkSession.conf.get(DIRECT_ROWS_KEY, str(1 << 20)))
    base = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    counts = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") > limit).select(*keys)
    direct = [F.percentile("_v", F.lit(q)).alias(name) for name, q in qs.items()]
    if hot.isEmpty():
        return base.groupBy(*keys).agg(*direct)
    hot = materialize(hot, "hot-keys")
    usual = base.join(hot, keys, "left_anti").groupBy(*keys).agg(*direct)
    return usual.unionByName(_ranked_percentiles(base.join(hot, keys, "left_semi"), keys, qs))


def _ranked_percentiles(base: DataFrame, keys: list[str], qs: dict[str, float], bins: int = 4096) -> DataFrame:
    """Percentiles of ``_v`` without gathering a key in one task.

    Rounds of histogram counting narrow every wanted rank until its value range holds few rows, however
    the values are spread; only the distinct values in that range are ordered.
    """
    few = int(base.sparkSession.conf.get(DIRECT_ROWS_KEY, str(1 << 20)))
    base = materialize(base, "values")
    stats = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    wants = stats.select(
        *keys, "_lo", "_hi",
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("_q"), side.alias("_rank"))
            for name, q in qs.items()
            for side in (F.floor((F.col("_n") - 1) * F.lit(q)).cast("long"), F.ceil((F.col("_n") - 1) * F.lit(q)).cast("long"))
        ])).alias("_w"),
    ).select(*keys, "_lo", "_hi", F.col("_w._rank").alias("_rank")).distinct().withColumn("_below", F.lit(0).cast("long"))
    while True:
        ranges = wants.select(*keys, "_lo", "_hi").distinct()
        # Halves, so that the width of a range of finite values stays finite.
        share = F.try_divide(F.col("_v") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2)
        bin_of = F.when(F.col("_v") == F.col("_hi"), F.lit(bins - 1)).otherwise(F.least(F.floor(share * bins), F.lit(bins - 2)))
        bin_of = F.when(F.col("_hi") > F.col("_lo"), bin_of).otherwise(F.lit(0)).cast("int")
        counts = (
            base.join(ranges, keys).filter("_v >= _lo AND _v <= _hi")
            .withColumn("_b", bin_of).groupBy(*keys, "_lo", "_hi", "_b")
            .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_blo"), F.max("_v").alias("_bhi"))
        )
        before = Window.partitionBy(*keys, "_lo", "_hi").orderBy("_b").rowsBetween(INF, -1)
        counts = counts.withColumn("_cum", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        r = F.col("_rank") - F.col("_below")
        # Lowest and highest value lie in different bins, so every round makes a range of several values smaller.
        narrowed = materialize(
            wants.join(counts, [*keys, "_lo", "_hi"])
            .filter((r >= F.col("_cum")) & (r < F.col("_cum") + F.col("_c")))
            .select(*keys, F.col("_blo").alias("_lo"), F.col("_bhi").alias("_hi"), "_rank", (F.col("_below") + F.col("_cum")).alias("_below"), "_c"),
            "ranges",
        )
        wants = narrowed.drop("_c")
        if narrowed.filter((F.col("_c") > few) & (F.col("_hi") > F.col("_lo"))).isEmpty():
            break
    ranges = wants.select(*keys, "_lo", "_hi").distinct()
    vals = (
        base.join(ranges, keys).filter("_v >= _lo AND _v <= _hi")
        .groupBy(*keys, "_lo", "_hi", "_v").agg(F.count(F.lit(1)).alias("_c"))
    )
    before = Window.partitionBy(*keys, "_lo", "_hi").orderBy("_v").rowsBetween(INF, -1)
    vals = vals.withColumn("_cum", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    r = F.col("_rank") - F.col("_below")
    at_rank = (
        wants.join(vals, [*keys, "_lo", "_hi"])
        .filter((r >= F.col("_cum")) & (r < F.col("_cum") + F.col("_c")))
        .select(*keys, "_rank", "_v")
    )
    # A key holds at most two ranks per asked percentile, so this gather is small.
    ranked = at_rank.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("_rank", "_v"))).alias("_at"))
    outs = []
    for name, q in qs.items():
        pos = (F.col("_n") - 1) * F.lit(q)
        lo, hi = F.col("_at")[F.floor(pos).cast("long")], F.col("_at")[F.ceil(pos).cast("long")]
        outs.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return stats.join(ranked, keys).select(*keys, *outs)

"""Series generators: spines, noise tracks, seeded schedules and cadence maps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from cuelattice.functions import keyed
from cuelattice.operators.series import exact_percentiles
from cuelattice.session import materialize, spread

SPINE_BLOCK = 4096
CELL_BLOCK = 256


def spine(clips: DataFrame, keys: list[str], n: str, halo: int = 0, block: int = SPINE_BLOCK) -> DataFrame:
    """Rows ``idx = 0..n-1`` per clip. Blocks are spread first, so one long clip fills many tasks.

    With ``halo`` each block also carries that many rows beyond both edges (idx may then be
    negative or past n); windows over (keys, block) see their neighbours without a shuffle.
    """
    return spine_blocks(clips, keys, n, halo, block).withColumn("idx", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")


def spine_blocks(clips: DataFrame, keys: list[str], n: str, halo: int = 0, block: int = SPINE_BLOCK) -> DataFrame:
    """The blocks of a spine, spread, with their first and last idx ``_lo`` and ``_hi``."""
    blocks = clips.filter(F.col(n) > 0).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / F.lit(block)).cast("long")))
    )
    lo = F.col("block") * F.lit(block) - F.lit(halo)
    hi = F.least((F.col("block") + 1) * F.lit(block), F.col(n).cast("long")) - 1 + F.lit(halo)
    return spread(blocks, *keys, "block").withColumns({"_lo": lo, "_hi": hi})


def hann_taps(half: int) -> list[float]:
    raw = [0.5 + 0.5 * math.cos(math.pi * k / (half + 1)) for k in range(-half, half + 1)]
    total = sum(raw)
    return [r / total for r in raw]


def normalise_p95(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Divide by the exact p95 of |value| over the whole series."""
    p = exact_percentiles(df.withColumn("_a", F.abs(F.col(value))), keys, "_a", {"_p95": 0.95})
    return df.join(p, keys).withColumn(out, F.col(value) / (F.col("_p95") + 1e-9)).drop("_p95", "_a")


def smooth_track(clips: DataFrame, keys: list[str], n: str, key: str, half: int, out: str) -> DataFrame:
    """Low-passed Gaussian track, normalised over the whole clip. ``clips`` carries ``seed``."""
    grid = spine(clips, keys, n, halo=half).withColumn(
        "_g", keyed.gaussian(F.col("seed"), *[F.col(k) for k in keys], key, F.col("idx"))
    )
    w = Window.partitionBy(*keys, "block").orderBy("idx")
    taps = hann_taps(half)
    acc = sum((F.lag("_g", -k).over(w) * F.lit(t) for k, t in zip(range(-half, half + 1), taps)), F.lit(0.0))
    raw = grid.withColumn("_f", acc).filter((F.col("idx") >= F.col("block") * SPINE_BLOCK) & (
        F.col("idx") < F.least((F.col("block") + 1) * SPINE_BLOCK, F.col(n)))).drop("_g")
    # Written once: the normaliser reads the track several times, and the draws are the costly part.
    return normalise_p95(materialize(raw, "track"), keys, "_f", out).drop("_f")


def onef_track(df: DataFrame, keys: list[str], key: str, alpha: float, octaves: int, out: str) -> DataFrame:
    """Approximate 1/f**alpha track: held white tracks, one per octave, summed and normalised."""
    total = F.lit(0.0)
    for o in range(octaves):
        held = F.floor(F.col("idx") / F.lit(2**o)).cast("long")
        gain = 2.0 ** (o * (alpha - 1.0) / 2.0)
        total = total + keyed.white(F.col("seed"), *[F.col(k) for k in keys], f"{key}/{o}", held) * F.lit(gain)
    return normalise_p95(materialize(df.withColumn("_o", total), "track"), keys, "_o", out).drop("_o")


def activation(gate: Column, threshold: float, flicker: Column) -> Column:
    """Episode level from a slow gate: a soft threshold to the power 1.3, shaded by flicker, zero when faint."""
    t = F.least(F.greatest((gate - F.lit(0.92 - threshold)) / 0.3, F.lit(0.0)), F.lit(1.0))
    level = F.pow(t, F.lit(1.3)) * (F.lit(0.55) + F.abs(flicker) * 0.45)
    # Most rows lie below the threshold; only those above it draw their flicker.
    return F.when((t > 0) & (level > 0.02), level).otherwise(F.lit(0.0))


def bernoulli_mask(df: DataFrame, keys: list[str], key: str, per_second: float, fps: Column) -> DataFrame:
    """Rows of a spine where a sparse event fires."""
    p = F.least(F.lit(per_second) / fps, F.lit(1.0))
    return df.filter(keyed.uniform(F.col("seed"), *[F.col(k) for k in keys], key, F.col("idx")) < p)


def poisson_times(clips: DataFrame, keys: list[str], key: str, per_minute: float, cell_s: float) -> DataFrame:
    """Poisson event times over ``duration`` seconds, drawn cell by cell.

    Counts in disjoint cells are independent Poisson draws with uniform times, so the whole is the
    same process as one big draw, and a long clip is generated by many tasks.
    """
    lam = per_minute / 60.0 * cell_s
    part = [F.col("seed"), *[F.col(k) for k in keys]]
    # Blocks of cells are spread and become cells behind the shuffle: a filter on a cell's draws cannot move before it, into the few tasks that list the clips.
    last = F.ceil(F.col("duration") / cell_s).cast("long") - 1
    blocks = clips.filter("duration > 0").withColumn("_last", last).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / CELL_BLOCK).cast("long"))))
    first = F.col("_block") * CELL_BLOCK
    cells = spread(blocks, *keys, "_block").withColumn("cell", F.explode(F.sequence(first, F.least(first + (CELL_BLOCK - 1), F.col("_last"))))).drop("_block", "_last")
    hits = cells.withColumn("_n", keyed.poisson(lam, keyed.uniform(*part, key, F.col("cell"), "n"))).filter("_n > 0")
    hits = hits.withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")
    t = (F.col("cell") + keyed.uniform(*part, key, F.col("cell"), F.col("draw"))) * F.lit(cell_s)
    # Written before the cut: a filter on ``t`` would draw it again, and so would the sampling of a sort.
    return materialize(hits.withColumn("t", t), "hits").filter(F.col("t") < F.col("duration"))


def bursty_counts(df: DataFrame, keys: list[str], key: str, rate: Column, fps: Column, burst: float, track: Column) -> DataFrame:
    """Per-frame event counts whose rate rides a burst track, at most 40 in a frame, one row per event."""
    lift = F.greatest(track, F.lit(0.0))
    lam = rate / F.greatest(fps, F.lit(1.0)) * (F.lit(1.0) + F.lit(burst * 7.0) * lift * lift)
    u = keyed.uniform(F.col("seed"), *[F.col(k) for k in keys], key, F.col("idx"))
    # Most rows have none: one comparison tells, before the count of the others.
    some = df.withColumns({"_u": u, "_lam": lam}).filter(F.col("_u") >= F.exp(-F.col("_lam")))
    n = keyed.poisson_varying(F.col("_lam"), F.col("_u"), 40)
    return some.withColumn("_n", n).drop("_u", "_lam").withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    ).drop("_n")


def fixed_hold(h: int) -> Column:
    return (F.floor(F.col("idx") / F.lit(h)) * F.lit(h)).cast("long")


def pulldown_src() -> Column:
    """3:2 pulldown: five output rows read four source rows."""
    off = F.element_at(F.array(*[F.lit(v) for v in (0, 0, 1, 2, 3)]), (F.col("idx") % 5 + 1).cast("int"))
    return (F.floor(F.col("idx") / 5) * 5 + off).cast("long")


def retime_16_in_24(pos: Column) -> Column:
    return F.floor(F.floor(pos * 2 / 3) * 3 / 2).cast("long")


def hold_length(u: Column, pattern: str, u2: Column) -> Column:
    """Length of one random hold: mostly ones to threes, or long holds of 4 to 8."""
    if pattern == "long":
        return F.when(u < 0.07, 1).otherwise(F.floor(u2 * 5) + 4).cast("long")
    return F.when(u < 0.12, 1).when(u < 0.82, 2).otherwise(3).cast("long")


def flutter_src(df: DataFrame, keys: list[str], key: str, rate: float, out: str) -> DataFrame:
    """Rows that repeat what the row before showed: a fluttered row reads the last unfluttered index."""
    from cuelattice.operators.series import last_known

    hit = keyed.uniform(F.col("seed"), *[F.col(k) for k in keys], key, F.col("idx")) < rate
    clean = F.when((F.col("idx") == 0) | ~hit, F.col("idx"))
    return last_known(df, keys, clean, out)


def periodic_cues(clips: DataFrame, keys: list[str], every_s: Column, leads: list[float]) -> DataFrame:
    """Change points every ``every_s`` seconds and the cue blocks that lead each of them."""
    k = F.floor(F.col("duration") / every_s).cast("long")
    points = clips.withColumn("_k", k).filter("_k >= 1").withColumn(
        "_r", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_k")))
    ).withColumn("change", F.col("_r") * every_s).drop("_k", "_r").filter(F.col("change") < F.col("duration"))
    cued = points.withColumn("lead", F.explode(F.array(*[F.lit(v) for v in leads])))
    start = F.greatest(F.rint((F.col("change") + F.col("lead")) * F.col("fps")), F.lit(0)).cast("long")
    length = F.greatest(F.rint(F.col("fps") / 6), F.lit(3)).cast("long")
    return cued.withColumn("start_frame", start).withColumn("n_frames", length)


CRANK_ONE = 1 << 21  # a row, in the whole units that the crank counts in


def crank_steps(df: DataFrame, keys: list[str], ratio: float, out: str) -> DataFrame:
    """Hold lengths of an irregular crank: each hold takes the whole rows of a carried remainder to which ``ratio`` and a draw in
    [-0.25, 0.25) are added, one row at least. ``df`` has idx, block and seed.

    While ratio - 0.25 is at least 1 no hold is ever raised to one, so hold k is what the running sum gains in whole rows: no row needs the one before. Otherwise
    the remainder is carried by a kernel, block by block. Units are whole numbers, so both are exact.
    """
    from cuelattice.operators.kernels import carried_holds, fold_blocks
    from cuelattice.operators.series import running_sum

    draw = keyed.uniform(F.col("seed"), *[F.col(k) for k in keys], "crank", F.col("idx"))
    unit = F.lit(int(ratio * CRANK_ONE)) + F.floor(draw * (CRANK_ONE // 2)).cast("long") - F.lit(CRANK_ONE // 4)
    df = df.withColumn("_unit", unit)
    if ratio - 0.25 >= 1.0:
        df = running_sum(df, keys, F.col("_unit"), "_sum")
        whole = lambda s: F.floor(s / F.lit(CRANK_ONE)).cast("long")
        return df.withColumn(out, whole(F.col("_sum")) - whole(F.col("_sum") - F.col("_unit"))).drop("_unit", "_sum")
    return fold_blocks(df, keys, ["_unit"], carried_holds(CRANK_ONE), "_len").withColumn(out, F.col("_len").cast("long")).drop("_len", "_unit")


def irregular_crank(clips: DataFrame, keys: list[str], n: str, ratio: float, slip: float) -> DataFrame:
    """(keys, idx, src): which row every output row shows. After a hold the crank goes on as far as it held, and one more where it slips."""
    from cuelattice.operators.series import running_sum, with_block

    steps = crank_steps(with_block(spine(clips, keys, n)), keys, ratio, "_hold")
    slips = keyed.uniform(F.col("seed"), *[F.col(k) for k in keys], "slip", F.col("idx")) < slip
    steps = running_sum(steps, keys, F.col("_hold"), "_end")
    steps = running_sum(steps, keys, F.col("_hold") + slips.cast("long"), "_went").withColumn("_from", F.col("_went") - F.col("_hold") - slips.cast("long"))
    held = steps.filter(F.col("_end") - F.col("_hold") < F.col(n)).withColumn("_at", F.explode(F.sequence(F.col("_end") - F.col("_hold"), F.col("_end") - 1)))
    return held.filter(F.col("_at") < F.col(n)).select(*keys, F.col("_at").alias("idx"), F.col("_from").alias("src"))

"""State-dependent recursions, cut into blocks that run at the same time.

Spark shuffles and sorts rows by ``(keys, block)`` and a small Python loop walks them batch by
batch, holding one batch and one state at a time. A block first runs cold; its end state becomes the next block's start, and all
blocks run again from there. What still changes after that are runs of blocks of a recursion that forgets slowly: one task walks a run
and the blocks behind it, carrying the state on until it agrees with the one known. When no start changes any more the outcome is the
plain sequential one, however long the series is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from cuelattice.session import materialize, spread

# A kernel maps (columns, start state or None) to (outputs, end state).
Kernel = Callable[[dict[str, list], list[float] | None], tuple[np.ndarray, list[float]]]


# Blocks behind a changed run that its task may walk on into; doubled every round.
LOOK_AHEAD = 16


def fold_blocks(
    df: DataFrame, keys: list[str], inputs: list[str], kernel: Kernel, out: str, tol: float = 0.0
) -> DataFrame:
    """Add ``out``: the kernel's output per row. Starts that differ by at most ``tol`` count as equal.

    The input is written once; every round reads it back instead of computing it again.
    """
    df = materialize(df, "folded")
    group = [*keys, "block"]
    out_schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    slim = df.select(*group, "idx", *inputs)
    starts = None if slim.filter("block > 0").isEmpty() else _starts(slim, keys, inputs, kernel, tol)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, state = None, None
        for pdf, spans in _spans(batches, group):
            parts = []
            for key, lo, hi in spans:
                if key != open_key:
                    open_key, state = key, _state_at(pdf, "_start", lo)
                y, state = kernel(_slice(pdf, inputs, lo, hi), state)
                parts.append(y)
            yield pdf.drop(columns="_start").assign(**{out: np.concatenate(parts)})

    none = F.lit(None).cast("array<double>")
    joined = df.withColumn("_start", none) if starts is None else df.join(starts, group, "left").select(*df.columns, "_start")
    return spread(joined, *group).sortWithinPartitions(*group, "idx").mapInPandas(emit, out_schema)


def _starts(slim: DataFrame, keys: list[str], inputs: list[str], kernel: Kernel, tol: float) -> DataFrame:
    """The start state of every block."""
    group, none = [*keys, "block"], F.lit(None).cast("array<double>")
    cold = slim.withColumns({"_run": F.col("block"), "_moved": F.lit(True), "_start": none, "_used": none, "_end": none})
    state = materialize(_walk(cold, keys, inputs, kernel, tol), "ends")
    reach = 0
    while True:
        due = materialize(_due(state, keys, reach, tol), "due")
        if due.isEmpty():
            return state.select(*group, F.col("_used").alias("_start"))
        redone = _walk(slim.join(due, group), keys, inputs, kernel, tol)
        state = materialize(state.join(due, group, "left_anti").unionByName(redone), "ends")
        reach = reach * 2 or LOOK_AHEAD


def _due(state: DataFrame, keys: list[str], reach: int, tol: float) -> DataFrame:
    """Blocks whose start is no longer the end of the block before, and up to ``reach`` blocks behind each.

    Adjacent ones form a run for one task; without a reach every block is a run of its own.
    """
    w = Window.partitionBy(*keys).orderBy("block")
    gap = F.aggregate(
        F.zip_with("_start", "_used", lambda a, b: F.when(a.eqNullSafe(b), 0.0).otherwise(F.abs(a - b))),
        F.lit(0.0), lambda m, g: F.greatest(m, g),
    )
    moved = F.col("_start").isNotNull() & (F.col("_used").isNull() | (F.size("_start") != F.size("_used")) | (gap > tol))
    rows = state.withColumn("_start", F.lag("_end").over(w)).withColumn("_at", F.row_number().over(w)).withColumn("_moved", moved)
    rows = rows.withColumn("_last", F.max(F.when(F.col("_moved"), F.col("_at"))).over(w))
    near = F.coalesce(F.col("_at") - F.col("_last") <= reach, F.lit(False))
    rows = rows.withColumn("_new", near & ~F.lag(near, 1, False).over(w))
    run = F.sum(F.col("_new").cast("long")).over(w) if reach else F.col("block")
    return rows.withColumn("_run", run).filter(near).select(*keys, "block", "_run", "_moved", "_start", "_used", "_end")


def _walk(rows: DataFrame, keys: list[str], inputs: list[str], kernel: Kernel, tol: float) -> DataFrame:
    """Walk runs of blocks in order; the start used and the end reached of every block.

    A run begins at its first block's ``_start``. A later block whose own start did not move is left as it is
    when the state carried so far agrees with the start it was run from.
    """
    group = [*keys, "_run", "block"]
    states = T.ArrayType(T.DoubleType())
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("block", T.LongType()), T.StructField("_used", states), T.StructField("_end", states)])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, used, state, skip = None, None, None, False
        for pdf, spans in _spans(batches, group):
            done = []
            for key, lo, hi in spans:
                if key != open_key:
                    if open_key is not None:
                        done.append((*open_key[:-2], open_key[-1], used, state))
                    follows = open_key is not None and key[:-1] == open_key[:-1]
                    known = _state_at(pdf, "_used", lo)
                    used = state if follows else _state_at(pdf, "_start", lo)
                    skip = follows and not pdf["_moved"].iloc[lo] and _agree(used, known, tol)
                    if skip:
                        used, state = known, _state_at(pdf, "_end", lo)
                    else:
                        state = used
                    open_key = key
                if not skip:
                    _, state = kernel(_slice(pdf, inputs, lo, hi), state)
            if done:
                yield pd.DataFrame(done, columns=schema.names)
        if open_key is not None:
            yield pd.DataFrame([(*open_key[:-2], open_key[-1], used, state)], columns=schema.names)

    return spread(rows, *keys, "_run").sortWithinPartitions(*group, "idx").mapInPandas(walk, schema)


def _agree(a: list[float] | None, b: list[float] | None, tol: float) -> bool:
    if a is None or b is None:
        return a is b
    return len(a) == len(b) and all(x == y or abs(x - y) <= tol or (math.isnan(x) and math.isnan(y)) for x, y in zip(a, b))


def _spans(batches: Iterator[pd.DataFrame], group: list[str]):
    """Each batch with its runs of equal group keys; a group may go on in the next batch."""
    for pdf in batches:
        if pdf.empty:
            continue
        cols = [pdf[c].to_numpy() for c in group]
        new = np.zeros(len(pdf), dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        at = [0, *np.flatnonzero(new).tolist(), len(pdf)]
        yield pdf, [(tuple(c[lo] for c in cols), lo, hi) for lo, hi in zip(at[:-1], at[1:])]


def _state_at(pdf: pd.DataFrame, column: str, row: int) -> list[float] | None:
    state = pdf[column].iloc[row]
    return None if state is None else list(state)


def _slice(pdf: pd.DataFrame, inputs: list[str], lo: int, hi: int) -> dict[str, list]:
    return {c: pdf[c].to_numpy()[lo:hi].tolist() for c in ["idx", *inputs]}


def follower(dt: float, attack_ms: float, release_ms: float, rising_is_attack: bool = True) -> Kernel:
    """Attack/release one-pole follower at a control rate of one step per ``dt`` seconds."""
    ca = float(np.exp(-dt / max(attack_ms * 1e-3, 1e-4)))
    cr = float(np.exp(-dt / max(release_ms * 1e-3, 1e-4)))

    def run(cols, state):
        x = cols["det"]
        y = np.empty(len(x))
        e = x[0] if state is None else state[0]
        for i, v in enumerate(x):
            c = ca if (v > e) == rising_is_attack and v != e else cr
            e = c * e + (1.0 - c) * v
            y[i] = e
        return y, [float(e)]

    return run


def gated_recursion(strength: float) -> Kernel:
    """Temporal denoise: the previous output counts more where the change is small."""

    def run(cols, state):
        x = cols["x"]
        y = np.empty(len(x))
        prev = None if state is None else state[0]
        for i, v in enumerate(x):
            prev = v if prev is None else v + (prev - v) * (strength * 0.8 * math.exp(-abs(v - prev) / 0.13))
            y[i] = prev
        return y, [float(prev)]

    return run


def stepped_tracking(every: int, quantum: float = 0.035) -> Kernel:
    """Level that moves only every ``every`` rows, by 0.6 of the gap rounded to whole quanta."""

    def run(cols, state):
        x, idx = cols["x"], cols["idx"]
        y = np.empty(len(x))
        level = None if state is None else state[0]
        for i, v in enumerate(x):
            if level is None:
                level = v
            elif idx[i] % every == 0:
                level += round((v - level) / quantum) * quantum * 0.6
            y[i] = level
        return y, [float(level)]

    return run


def iris_servo(fps: float, lag: float, overshoot: float, iris_step: float) -> Kernel:
    """Second-order gain servo whose applied gain clicks between quantised stops (hysteresis)."""
    wn = 2.2 / max(lag, 0.05)
    zeta = float(np.clip(1.0 - 0.55 * overshoot, 0.25, 1.2))
    dt = 1.0 / max(fps, 1.0)
    q = 0.046 + 0.231 * iris_step

    def run(cols, state):
        want = cols["want"]
        y = np.empty(len(want))
        g, vel, stop = (want[0], 0.0, None) if state is None else (state[0], state[1], state[2])
        if stop is not None and math.isnan(stop):
            stop = None
        for i, d in enumerate(want):
            vel += (wn * wn * (d - g) - 2.0 * zeta * wn * vel) * dt
            g += vel * dt
            if iris_step > 0:
                if stop is None or abs(g - stop) > 0.62 * q:
                    stop = round(g / q) * q
                y[i] = stop
            else:
                y[i] = g
        return y, [float(g), float(vel), float("nan") if stop is None else float(stop)]

    return run


def min_gap(gap: float, inclusive: bool, by: str) -> Kernel:
    """Greedy thinning: 1.0 for kept rows. ``inclusive`` keeps a row exactly ``gap`` after the last kept."""

    def run(cols, state):
        pos = cols[by]
        y = np.zeros(len(pos))
        last = -np.inf if state is None else state[0]
        for i, p in enumerate(pos):
            if (p - last >= gap) if inclusive else (p - last > gap):
                y[i] = 1.0
                last = p
        return y, [float(last)]

    return run


def carried_holds(one: int) -> Kernel:
    """Whole parts of a carried remainder, one at least; a remainder below zero is made up for by later rows."""

    def run(cols, state):
        y = np.zeros(len(cols["_unit"]))
        rest = 0 if state is None else int(state[0])
        for i, unit in enumerate(cols["_unit"]):
            rest += int(unit)
            y[i] = max(int(rest / one), 1)
            rest -= int(y[i]) * one
        return y, [float(rest)]

    return run

"""Registered queries over the event series: windows, scans, kernels, repair, dynamics, mixing."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cuelattice.functions import scalars as sc
from cuelattice.functions.keyed import uniform
from cuelattice.operators import kernels as kn, mixing as mx, series as se
from cuelattice.plans.inputs import S_SQL, event_series, series_lengths, table
from cuelattice.plans.registry import query
from cuelattice.session import materialize

K = ["series_id"]
ROW = ["series_id", "idx"]
XS_SQL = "(x / 250.0 - 1.0)"
SIZE, DT = 4, 0.01                     # rows per control cell, seconds per cell


def X():
    return F.col("x")


def XS():
    """The value as a signal in -1..1."""
    return F.col("x") / 250.0 - 1.0


def with_(body: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([S_SQL, *ctes])} {body}"


def step_sql(name: str, src: str, cols: list[str], first: list[str], step: list[str]) -> str:
    """A recursion over rows ``b`` of ``src`` in idx order with state ``r``."""
    return (
        f"{name} AS (SELECT b.series_id, b.idx, {', '.join(f'{e} AS {c}' for c, e in zip(cols, first))} FROM {src} b WHERE b.idx = 0 "
        f"UNION ALL SELECT b.series_id, b.idx, {', '.join(step)} FROM {name} r JOIN {src} b ON b.series_id = r.series_id AND b.idx = r.idx + 1)"
    )


def cells_sql(name: str, src: str, expr: str, stat: str) -> str:
    full = f"{SIZE} - count(*)"
    pick = {
        "peak": "max(v)", "low": "min(v)",
        "rms": f"sqrt((sum(v * v) + ({full}) * pow(arg_max(v, idx), 2)) / {SIZE})",
    }[stat]
    return (
        f"{name} AS MATERIALIZED (SELECT series_id, idx // {SIZE} AS idx, {pick} AS det FROM "
        f"(SELECT series_id, idx, {expr} AS v FROM {src}) GROUP BY 1, 2)"
    )


def follow_sql(name: str, cells: str, attack_ms: float, release_ms: float, cmp: str) -> str:
    ca, cr = (math.exp(-DT / max(m * 1e-3, 1e-4)) for m in (attack_ms, release_ms))
    c = f"(CASE WHEN b.det {cmp} r.env THEN {ca!r} ELSE {cr!r} END)"
    return step_sql(name, cells, ["env"], ["b.det::DOUBLE"], [f"{c} * r.env + (1.0 - {c}) * b.det"])


def up_sql(name: str, src: str, env: str, out: str) -> str:
    """Rows of ``src`` with the cell values of ``env`` interpolated between cell centres."""
    return (
        f"{name}_e AS MATERIALIZED (SELECT series_id, idx AS c, env AS ev, coalesce(lag(env) OVER w, env) AS eb, coalesce(lead(env) OVER w, env) AS ea "
        f"FROM {env} WINDOW w AS (PARTITION BY series_id ORDER BY idx)), "
        f"{name} AS MATERIALIZED (SELECT q.*, CASE WHEN q.idx / {SIZE}.0 - 0.5 - e.c < 0 THEN eb + (ev - eb) * (q.idx / {SIZE}.0 + 0.5 - e.c) "
        f"ELSE ev + (ea - ev) * (q.idx / {SIZE}.0 - 0.5 - e.c) END AS {out} FROM {src} q JOIN {name}_e e ON e.series_id = q.series_id AND e.c = q.idx // {SIZE})"
    )


# ── source ──────────────────────────────────────────────────────────────

@query("S12_series_source", with_("SELECT series_id, idx, event_id, x FROM s"))
def series_source(spark, d):
    return event_series(spark, d).select("series_id", "idx", "event_id", "x")


# ── windows and scans ───────────────────────────────────────────────────

@query("W2_running_max", with_("SELECT series_id, idx, max(x) OVER (PARTITION BY series_id ORDER BY idx) AS top FROM s"))
def running_max(spark, d):
    return se.running_max(event_series(spark, d), K, X(), "top").select(*ROW, "top")


@query("W3_cumulative_integral", with_("SELECT series_id, idx, round(sum(x) OVER (PARTITION BY series_id ORDER BY idx), 6) AS total FROM s"))
def cumulative(spark, d):
    return se.running_sum(event_series(spark, d), K, X(), "total").select(*ROW, sc.r6(F.col("total")).alias("total"))


ISLANDS = """r AS (SELECT series_id, idx, x, idx - row_number() OVER (PARTITION BY series_id ORDER BY idx) AS g FROM s WHERE x > 120),
 runs AS (SELECT series_id, min(idx) AS run_start, count(*) AS length, max(x) AS peak FROM r GROUP BY series_id, g)"""


@query("W4_gaps_and_islands", with_("SELECT series_id, idx, min(idx) OVER (PARTITION BY series_id, g) AS run_start FROM r", ISLANDS))
def islands(spark, d):
    return se.islands(event_series(spark, d), K, X() > 120).select(*ROW, "run_start")


@query("A19_episode_summary", with_("SELECT series_id, run_start, length, peak FROM runs", ISLANDS))
def episode_summary(spark, d):
    return se.episodes(event_series(spark, d), K, X() > 120, X()).select("series_id", "run_start", "length", "peak")


@query("W5_longest_run", with_(
    "SELECT series_id, run_start AS start, run_start + length - 1 AS stop FROM runs "
    "QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY length DESC, run_start) = 1", ISLANDS))
def longest_run(spark, d):
    return se.longest_run(event_series(spark, d), K, X() > 120)


@query("W6_min_gap_mask", with_(
    "SELECT series_id, idx FROM r WHERE kept = idx",
    step_sql("r", "s", ["kept"], ["CASE WHEN b.x > 150 THEN 0 ELSE -1000 END"],
             ["CASE WHEN b.x > 150 AND b.idx - r.kept > 3 THEN b.idx ELSE r.kept END"]), recursive=True))
def min_gap_mask(spark, d):
    hits = event_series(spark, d).filter(X() > 150)
    return kn.fold_blocks(hits, K, [], kn.min_gap(3.0, False, "idx"), "kept").filter("kept = 1").select(*ROW)


@query("W7_min_gap_times", with_(
    "SELECT r.series_id, r.idx, round(s.t, 6) AS t FROM r JOIN s USING (series_id, idx) WHERE kept = s.t",
    step_sql("r", "s", ["kept"], ["b.t"], ["CASE WHEN b.t - r.kept >= 14400 THEN b.t ELSE r.kept END"]), recursive=True))
def min_gap_times(spark, d):
    kept = kn.fold_blocks(event_series(spark, d), K, ["t"], kn.min_gap(14400.0, True, "t"), "kept")
    return kept.filter("kept = 1").select(*ROW, sc.r6(F.col("t")).alias("t"))


@query("W8_zero_order_hold", with_(
    "SELECT a.series_id, a.idx, b.x AS held FROM s a JOIN s b ON b.series_id = a.series_id AND b.idx = floor(floor(a.idx / 2.7) * 2.7)"))
def zero_order_hold(spark, d):
    s = event_series(spark, d)
    return se.take_at(se.hold(s.select(*ROW), K, 2.7), K, s, "src_idx", "x", "held").select(*ROW, "held")


@query("W9_previous_row_blend", with_(
    "SELECT series_id, idx, round(CASE WHEN idx % 2 = 1 THEN x * 0.4 + lag(x) OVER (PARTITION BY series_id ORDER BY idx) * 0.6 ELSE x END, 6) AS y FROM s"))
def previous_blend(spark, d):
    s = se.previous(event_series(spark, d), K, X(), "was")
    return s.select(*ROW, sc.r6(F.when(F.col("idx") % 2 == 1, X() * 0.4 + F.col("was") * 0.6).otherwise(X())).alias("y"))


@query("W10_straddle_blend", with_(
    "SELECT series_id, idx, round(CASE WHEN idx % 5 = 2 THEN x * 0.75 + lag(x) OVER (PARTITION BY series_id ORDER BY idx) * 0.25 ELSE x END, 6) AS y FROM s"))
def straddle_blend(spark, d):
    s = se.previous(event_series(spark, d), K, X(), "was")
    return s.select(*ROW, sc.r6(F.when(F.col("idx") % 5 == 2, X() * 0.75 + F.col("was") * 0.25).otherwise(X())).alias("y"))


ALPHA = 1.0 - math.exp(-1.0 / (0.7 * 30.0))


@query("W11_exponential_smoothing", with_(
    "SELECT series_id, idx, round(y, 6) AS y FROM r",
    step_sql("r", "s", ["y"], ["b.x"], [f"r.y + (b.x - r.y) * {ALPHA!r}"]), recursive=True))
def exponential_smoothing(spark, d):
    return se.smooth(event_series(spark, d), K, X(), ALPHA, "y").select(*ROW, sc.r6(F.col("y")).alias("y"))


@query("W12_attack_release", with_(
    "SELECT series_id, idx AS cell, round(env, 6) AS env FROM r",
    cells_sql("c", "s", f"abs({XS_SQL})", "rms"), follow_sql("r", "c", 15.0, 80.0, ">"), recursive=True))
def attack_release(spark, d):
    cells = mx.follow_cells(event_series(spark, d), K, F.abs(XS()), SIZE, "rms", DT, 15.0, 80.0)
    return cells.select("series_id", "cell", sc.r6(F.col("env")).alias("env"))


@query("W13_gain_smoothing", with_(
    "SELECT series_id, idx AS cell, round(env, 6) AS env FROM r",
    cells_sql("c", "s", "x / 500.0", "low"), follow_sql("r", "c", 5.0, 60.0, "<"), recursive=True))
def gain_smoothing(spark, d):
    cells = mx.follow_cells(event_series(spark, d), K, X() / 500.0, SIZE, "low", DT, 5.0, 60.0, rising_is_attack=False)
    return cells.select("series_id", "cell", sc.r6(F.col("env")).alias("env"))


@query("W14_decaying_max", with_(
    "SELECT series_id, idx, round(y, 6) AS y FROM r",
    step_sql("r", "s", ["y"], ["b.x"], ["greatest(b.x, r.y * 0.8731)"]), recursive=True))
def decaying_max(spark, d):
    return se.decaying_max(event_series(spark, d), K, X(), 0.8731, "y").select(*ROW, sc.r6(F.col("y")).alias("y"))


@query("W15_change_gated", with_(
    "SELECT series_id, idx, round(y, 6) AS y FROM r",
    "n AS MATERIALIZED (SELECT series_id, idx, x / 500.0 AS x FROM s)",
    step_sql("r", "n", ["y"], ["b.x"], ["b.x + (r.y - b.x) * (0.72 * exp(-abs(b.x - r.y) / 0.13))"]), recursive=True))
def change_gated(spark, d):
    s = event_series(spark, d).withColumn("x", X() / 500.0)
    return kn.fold_blocks(s, K, ["x"], kn.gated_recursion(0.9), "y").select(*ROW, sc.r6(F.col("y")).alias("y"))


@query("W16_stepped_tracking", with_(
    "SELECT series_id, idx, round(y, 6) AS y FROM r",
    "n AS MATERIALIZED (SELECT series_id, idx, x / 500.0 AS x FROM s)",
    step_sql("r", "n", ["y"], ["b.x"],
             ["CASE WHEN b.idx % 3 = 0 THEN r.y + round_even((b.x - r.y) / 0.035, 0) * 0.035 * 0.6 ELSE r.y END"]), recursive=True))
def stepped_tracking(spark, d):
    s = event_series(spark, d).withColumn("x", X() / 500.0)
    return kn.fold_blocks(s, K, ["x"], kn.stepped_tracking(3), "y").select(*ROW, sc.r6(F.col("y")).alias("y"))


WN, ZETA, SDT, Q = 2.2 / 0.5, 1.0 - 0.55 * 0.6, 1.0 / 24.0, 0.046 + 0.231 * 0.5
VEL = f"(r.vel + ({WN * WN!r} * (b.want - r.g) - {2.0 * ZETA * WN!r} * r.vel) * {SDT!r})"
GAIN = f"(r.g + {VEL} * {SDT!r})"
VEL0 = f"(({WN * WN!r} * (b.want - b.want)) * {SDT!r})"


@query("W17_hysteresis_servo", with_(
    "SELECT series_id, idx, round(stop, 6) + 0.0 AS y FROM r",
    "n AS MATERIALIZED (SELECT series_id, idx, ln(least(greatest(150.0 / x, 0.25), 3.0)) AS want FROM s)",
    step_sql("r", "n", ["g", "vel", "stop"], ["b.want", "0.0::DOUBLE", f"round_even(b.want / {Q!r}, 0) * {Q!r}"],
             [GAIN, VEL, f"CASE WHEN abs({GAIN} - r.stop) > {0.62 * Q!r} THEN round_even({GAIN} / {Q!r}, 0) * {Q!r} ELSE r.stop END"]),
    recursive=True))
def hysteresis_servo(spark, d):
    s = event_series(spark, d).withColumn("want", F.log(sc.clip(sc.ratio(150.0, X()), 0.25, 3.0)))
    y = kn.fold_blocks(s, K, ["want"], kn.iris_servo(24.0, 0.5, 0.6, 0.5), "y", tol=1e-12)
    return y.select(*ROW, sc.r6(F.col("y")).alias("y"))


@query("W18_zero_crossing_near", with_(
    "SELECT q.series_id, q.idx, coalesce((SELECT arg_min(z.idx, abs(z.idx - q.idx) * 2 + CASE WHEN z.idx > q.idx THEN 1 ELSE 0 END) FROM z "
    "WHERE z.series_id = q.series_id AND z.idx >= greatest(q.idx - 5, 1) AND z.idx < least(q.idx + 5, q.n - 1)), q.idx) AS near "
    "FROM (SELECT series_id, idx, count(*) OVER (PARTITION BY series_id) AS n FROM s) q",
    f"p AS (SELECT series_id, idx, {XS_SQL} AS v, lag({XS_SQL}) OVER (PARTITION BY series_id ORDER BY idx) AS w FROM s)",
    "z AS MATERIALIZED (SELECT series_id, idx FROM p WHERE w <= 0 AND v > 0)"))
def zero_crossing(spark, d):
    s = event_series(spark, d)
    s = s.join(series_lengths(s), K).withColumn("v", XS())
    return mx.zero_cross_near(s, K, "v", "n", 5, "near").select(*ROW, F.col("near").cast("long").alias("near"))


# ── dynamics ────────────────────────────────────────────────────────────

ENV15 = [cells_sql("c1", "s", f"abs({XS_SQL})", "rms"), follow_sql("r1", "c1", 15.0, 80.0, ">"), up_sql("u1", "s", "r1", "env")]


@query("W23_gain_ride", with_(
    f"SELECT series_id, idx, round(pow(g, 0.8), 6) AS gain, round({XS_SQL} * pow(g, 0.8), 6) + 0.0 AS y FROM u2",
    *ENV15, f"w1 AS MATERIALIZED (SELECT *, least(greatest(pow(10.0, -12.0 / 20) / greatest(env, 1e-5), {10 ** (-24 / 20)!r}), {10 ** (12 / 20)!r}) AS want FROM u1)",
    cells_sql("c2", "w1", "want", "low"), follow_sql("r2", "c2", 20.0, 200.0, "<"), up_sql("u2", "w1", "r2", "g"), recursive=True))
def gain_ride(spark, d):
    s = event_series(spark, d).withColumn("xs", XS())
    y = mx.gain_ride(s, K, "xs", SIZE, DT, -12.0, 12.0, 20.0, 200.0, 0.8)
    return y.select(*ROW, sc.r6(F.col("gain")).alias("gain"), sc.r6(F.col("y")).alias("y"))


@query("W24_soft_knee_compressor", with_(
    f"SELECT series_id, idx, round(g, 6) AS gain, round({XS_SQL} * g * {10 ** (3 / 20)!r}, 6) + 0.0 AS y FROM u2",
    cells_sql("c1", "s", f"abs({XS_SQL})", "rms"), follow_sql("r1", "c1", 0.5, 30.0, ">"), up_sql("u1", "s", "r1", "env"),
    "o1 AS (SELECT *, 20.0 * log10(greatest(env, 1e-6)) + 20.0 AS ov FROM u1)",
    f"w1 AS MATERIALIZED (SELECT *, pow(10.0, -(CASE WHEN ov <= -3.0 THEN 0.0 WHEN ov < 3.0 THEN {(1 - 1 / 3)!r} * pow(ov + 3.0, 2) / 12.0 ELSE {(1 - 1 / 3)!r} * ov END) / 20.0) AS raw FROM o1)",
    cells_sql("c2", "w1", "raw", "low"), follow_sql("r2", "c2", 8.0, 200.0, "<"), up_sql("u2", "w1", "r2", "g"), recursive=True))
def compressor(spark, d):
    s = event_series(spark, d).withColumn("xs", XS())
    y = mx.compress(s, K, "xs", SIZE, DT, -20.0, 3.0, 6.0, 8.0, 200.0, 3.0)
    return y.select(*ROW, sc.r6(F.col("gain")).alias("gain"), sc.r6(F.col("y")).alias("y"))


BED_SQL = "bed AS MATERIALIZED (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS idx, s_acctbal / 10000.0 AS b FROM supplier)"


def bed_of(spark, d):
    """The short bed: supplier balances in key order; its length comes with it."""
    sup = table(spark, d, "supplier").withColumn("one", F.lit(1))
    rows = se.index_rows(sup, ["one"], ["s_suppkey"]).select("idx", (F.col("s_acctbal") / 10000.0).alias("b"))
    # Written, so that its true size is known to the planner: a short bed is broadcast, a long one
    # has enough positions to shuffle on.
    return materialize(rows, "bed"), sup.count()


@query("J16_loop_join", with_(
    "SELECT s.series_id, s.idx, round(s.x + bed.b, 6) AS y FROM s JOIN bed ON bed.idx = s.idx % (SELECT count(*) FROM bed)", BED_SQL))
def loop_join(spark, d):
    bed, m = bed_of(spark, d)
    y = mx.loop_join(event_series(spark, d), bed, m, "b", "b")
    return y.select(*ROW, sc.r6(X() + F.col("b")).alias("y"))


@query("W25_ducked_mix", with_(
    f"SELECT q.series_id, q.idx, round({XS_SQL} + b * ({10 ** (-18 / 20)!r} / (rms + 1e-12)) * pow(10.0, -8.0 * 0.7 * least(greatest(env / (p90 + 1e-9), 0.0), 1.2) / 20.0), 6) + 0.0 AS y "
    "FROM u1 q JOIN agg USING (series_id)",
    BED_SQL, "m AS MATERIALIZED (SELECT s.*, bed.b FROM s JOIN bed ON bed.idx = s.idx % (SELECT count(*) FROM bed))",
    cells_sql("c1", "s", f"abs({XS_SQL})", "rms"), follow_sql("r1", "c1", 30.0, 700.0, ">"), up_sql("u1", "m", "r1", "env"),
    "agg AS MATERIALIZED (SELECT series_id, sqrt(avg(b * b)) + 1e-12 AS rms, quantile_cont(env, 0.9) AS p90 FROM u1 GROUP BY 1)", recursive=True))
def ducked_mix(spark, d):
    bed, m = bed_of(spark, d)
    s = mx.loop_join(event_series(spark, d), bed, m, "b", "b").withColumn("xs", XS())
    return mx.duck(s, K, "xs", "b", SIZE, DT, 0.7, -18.0).select(*ROW, sc.r6(F.col("y")).alias("y"))


# ── repair and mixing ───────────────────────────────────────────────────

N_SQL = "n AS MATERIALIZED (SELECT series_id, count(*) AS n FROM s GROUP BY 1)"
XF = 4
U_SQL = lambda key: f"(('0x' || substr(sha256({key}), 1, 13))::BIGINT::DOUBLE / 4503599627370496)"


@query("J17_slice_reassembly", with_(
    f"SELECT w.series_id, w.idx, round(sum(bed.b * w.wt), 6) AS y FROM w JOIN bed ON bed.idx = w.bi GROUP BY 1, 2",
    BED_SQL, N_SQL, "m AS (SELECT count(*) AS m FROM bed)",
    f"d0 AS (SELECT series_id, n, i.i AS slice, floor({U_SQL(chr(39) + '7:' + chr(39) + ' || series_id || ' + chr(39) + ':at:' + chr(39) + ' || i.i')} * greatest(m - {2 * XF}, 1))::BIGINT AS start, "
    f"10 + floor({U_SQL(chr(39) + '7:' + chr(39) + ' || series_id || ' + chr(39) + ':len:' + chr(39) + ' || i.i')} * 21)::BIGINT AS want, m FROM n, m, range(0, 1000000) i(i) WHERE i.i <= (n + {XF}) // {10 - XF})",
    f"d1 AS (SELECT *, CASE WHEN least(want, m - start) < {2 * XF} THEN m - start ELSE least(want, m - start) END AS length FROM d0)",
    f"d2 AS (SELECT *, sum(length - {XF}) OVER (PARTITION BY series_id ORDER BY slice) - (length - {XF}) AS pos0, pos0::BIGINT AS pos FROM d1)",
    f"d3 AS MATERIALIZED (SELECT *, max(slice) OVER (PARTITION BY series_id) AS last FROM d2 WHERE pos < n + {XF})",
    f"w AS (SELECT series_id, pos + j.j AS idx, start + j.j AS bi, (CASE WHEN slice > 0 AND j.j < {XF} THEN sqrt(j.j / {XF - 1}.0) ELSE 1 END) "
    f"* (CASE WHEN slice < last AND j.j >= length - {XF} THEN sqrt(1.0 - (j.j - (length - {XF})) / {XF - 1}.0) ELSE 1 END) AS wt "
    f"FROM d3 JOIN range(0, 100000) j(j) ON j.j < length WHERE pos + j.j < n)"))
def slice_reassembly(spark, d):
    bed, m = bed_of(spark, d)
    lengths = series_lengths(event_series(spark, d))
    top = F.floor((F.col("n") + XF) / (10 - XF)).cast("long")
    sl = lengths.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), top)))
    draw = lambda what: uniform(7, F.col("series_id"), what, F.col("slice"))
    sl = sl.withColumn("start", F.floor(draw("at") * max(m - 2 * XF, 1)).cast("long"))
    want = F.least(F.floor(draw("len") * 21).cast("long") + 10, F.lit(m) - F.col("start"))
    sl = sl.withColumn("length", F.when(want < 2 * XF, F.lit(m) - F.col("start")).otherwise(want))
    sl = se.with_block(sl.withColumnRenamed("slice", "idx"))
    sl = se.running_sum(sl, K, F.col("length") - XF, "_end").withColumn("pos", F.col("_end") - (F.col("length") - XF))
    sl = sl.filter(F.col("pos") < F.col("n") + XF).withColumnRenamed("idx", "slice")
    return mx.reassemble(sl, K, bed, "b", XF, "n", "y").select(*ROW, sc.r6(F.col("y")).alias("y"))


@query("J22_additive_mix", with_(
    "SELECT series_id, idx, round(sum(v), 6) AS y FROM (SELECT series_id, idx, x AS v FROM s UNION ALL "
    "SELECT c.series_id, c.st + j.j, c.x * 0.1 FROM (SELECT series_id, idx * 2 - 3 AS st, 3 + k % 5 AS len, x FROM s) c JOIN range(0, 10) j(j) ON j.j < c.len JOIN n USING (series_id) "
    "WHERE c.st + j.j >= 0 AND c.st + j.j < n.n) GROUP BY 1, 2", N_SQL))
def additive_mix(spark, d):
    s = event_series(spark, d)
    clips = s.select("series_id", (F.col("idx") * 2 - 3).alias("start"), (F.lit(3) + F.col("k") % 5).alias("len"), (X() * 0.1).alias("amp"))
    return mx.mix_at(s, K, clips, series_lengths(s), "x", "y").select(*ROW, sc.r6(F.col("y")).alias("y"))


@query("J23_interval_overwrite", with_(
    "SELECT s.series_id, s.idx, CASE WHEN h.kind = 0 THEN 0.0 WHEN h.kind IS NULL THEN s.x ELSE o.x END AS y FROM s LEFT JOIN hit h USING (series_id, idx) "
    "LEFT JOIN s o ON o.series_id = s.series_id AND o.idx = CASE h.kind WHEN 1 THEN h.start - 1 WHEN 2 THEN h.start - h.lp + (s.idx - h.start) % h.lp END",
    """d0 AS (SELECT series_id, idx, k, x FROM s WHERE event_type = 'error' AND idx >= 1)""",
    """dmg AS MATERIALIZED (SELECT series_id, CASE WHEN k % 3 = 2 THEN idx + 2 + k % 4 ELSE idx END AS start,
  CASE WHEN k % 3 = 2 THEN idx + 3 * (2 + k % 4) ELSE idx + 2 + k % 4 END AS stop, k % 3 AS kind, 2 + k % 4 AS lp FROM d0)""",
    """h0 AS (SELECT s.series_id, s.idx, max({'start': dmg.start, 'ord': CASE kind WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END, 'lp': lp, 'kind': kind}) AS m
  FROM s JOIN dmg ON dmg.series_id = s.series_id AND s.idx >= dmg.start AND s.idx < dmg.stop GROUP BY 1, 2)""",
    "hit AS MATERIALIZED (SELECT series_id, idx, m.start AS start, m.kind AS kind, m.lp AS lp FROM h0)"))
def interval_overwrite(spark, d):
    s = event_series(spark, d)
    bad = s.filter("event_type = 'error' AND idx >= 1").withColumn("loop", (F.lit(2) + F.col("k") % 4).cast("long"))
    kind = F.element_at(F.array(F.lit("mute"), F.lit("hold"), F.lit("stutter")), F.col("k") % 3 + 1)
    late = F.when(kind == "stutter", F.col("loop")).otherwise(F.lit(0))
    damage = bad.select(
        "series_id", (F.col("idx") + late).alias("start"), (F.col("idx") + F.col("loop") + late * 2).alias("stop"), kind.alias("kind"), "loop"
    )
    return mx.overwrite(s, K, damage, "x", "y").select(*ROW, "y")


TAPS = [0.25, 0.5, 0.25]


@query("J24_convolution", with_(
    "SELECT series_id, idx, round(x * 0.25 + coalesce(lag(x, 1) OVER w, 0) * 0.5 + coalesce(lag(x, 2) OVER w, 0) * 0.25, 6) AS y FROM s WINDOW w AS (PARTITION BY series_id ORDER BY idx)"))
def convolution(spark, d):
    return mx.convolve(event_series(spark, d), K, "x", TAPS, "y").select(*ROW, sc.r6(F.col("y")).alias("y"))


@query("J24_multi_tap_echo", with_(
    "SELECT s.series_id, s.idx, round(s.x + coalesce(a.y, 0) + coalesce(b.y, 0), 6) AS y FROM s "
    "LEFT JOIN e1 a ON a.series_id = s.series_id AND a.idx = s.idx - 7 LEFT JOIN e2 b ON b.series_id = s.series_id AND b.idx = s.idx - 14",
    "e1 AS MATERIALIZED (SELECT series_id, idx, 0.6 * (x * 0.7 + coalesce(lag(x) OVER (PARTITION BY series_id ORDER BY idx), 0) * 0.3) AS y FROM s)",
    "e2 AS MATERIALIZED (SELECT series_id, idx, 0.6 * (y * 0.7 + coalesce(lag(y) OVER (PARTITION BY series_id ORDER BY idx), 0) * 0.3) AS y FROM e1)"))
def multi_tap(spark, d):
    s = event_series(spark, d)
    return mx.multi_tap(s, K, "x", 7, 0.6, 2, [0.7, 0.3], series_lengths(s), "y").select(*ROW, sc.r6(F.col("y")).alias("y"))


# ── remaps and lookups ──────────────────────────────────────────────────

@query("J12_compose_remaps", with_(
    "SELECT series_id, idx, max(src) OVER (PARTITION BY series_id ORDER BY idx) AS src_frame FROM "
    "(SELECT q.series_id, q.idx, least(greatest(m.src, 0), q.n - 1) AS src FROM (SELECT s.series_id, s.idx, n.n, least((s.idx // 5) * 5 + [0, 0, 1, 2, 3][s.idx % 5 + 1], n.n - 1) AS p FROM s JOIN n USING (series_id)) q "
    "JOIN (SELECT series_id, idx, idx - k % 3 AS src FROM s) m ON m.series_id = q.series_id AND m.idx = q.p)", N_SQL))
def compose(spark, d):
    s = event_series(spark, d)
    held = s.select("series_id", F.col("idx").alias("out_frame"), (F.col("idx") - F.col("k") % 3).alias("src_frame"))
    pulldown = lambda i: (F.floor(i / 5) * 5 + F.element_at(F.array(*[F.lit(v) for v in (0, 0, 1, 2, 3)]), (i % 5 + 1).cast("int"))).cast("long")
    base = s.select(*ROW, "block").join(series_lengths(s), K)
    return mx.compose_remaps(base, K, "n", [held, pulldown]).select(*ROW, "src_frame")


@query("J13_apply_remap", with_(
    "SELECT a.series_id, a.idx, b.x FROM s a JOIN s b ON b.series_id = a.series_id AND b.idx = a.idx // 2 * 2"))
def apply_remap(spark, d):
    s = event_series(spark, d)
    remap = s.select(*ROW, (F.floor(F.col("idx") / 2) * 2).cast("long").alias("src_frame"))
    return mx.apply_remap(remap, K, s, ["x"]).select(*ROW, "x")


@query("J14_interpolating_lookup", with_(
    "SELECT q.series_id, q.idx, round(CASE WHEN q.p = floor(q.p) THEN coalesce(a.x, 0) WHEN a.x IS NULL OR b.x IS NULL THEN 0 ELSE a.x * (1 - (q.p - floor(q.p))) + b.x * (q.p - floor(q.p)) END, 6) AS y "
    "FROM (SELECT series_id, idx, idx * 1.25 AS p FROM s) q LEFT JOIN s a ON a.series_id = q.series_id AND a.idx = floor(q.p) LEFT JOIN s b ON b.series_id = q.series_id AND b.idx = floor(q.p) + 1"))
def interpolating_lookup(spark, d):
    s = event_series(spark, d)
    pos = s.select(*ROW, (F.col("idx") * 1.25).alias("pos"))
    return se.lerp_at(pos, K, s, "pos", "x", "y").select(*ROW, sc.r6(F.col("y")).alias("y"))


@query("J15_control_to_row_rate", with_(
    "SELECT series_id, idx, round(CASE WHEN a IS NULL THEN b.v WHEN b IS NULL OR a.p = b.p THEN a.v ELSE a.v + (b.v - a.v) * ((t - a.p) / (b.p - a.p)) END, 6) AS y FROM z",
    "z AS (SELECT series_id, idx, t, last_value(c IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, "
    "first_value(c IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b "
    "FROM (SELECT *, CASE WHEN event_type = 'signup' THEN {'p': t, 'v': x} END AS c FROM s))"))
def control_to_row(spark, d):
    known = F.when(F.col("event_type") == "signup", X())
    y = mx.interpolate_known(event_series(spark, d), K, "t", known, "y")
    return y.select(*ROW, sc.r6(F.col("y")).alias("y"))


@query("W3_variable_speed_read", with_(
    "SELECT series_id, idx, round(sum(1.0 + 0.2 * (k % 5)) OVER (PARTITION BY series_id ORDER BY idx) - (1.0 + 0.2 * (k % 5)), 6) AS pos FROM s"))
def variable_speed(spark, d):
    y = mx.read_positions(event_series(spark, d), K, F.lit(1.0) + (F.col("k") % 5) * 0.2, "pos")
    return y.select(*ROW, sc.r6(F.col("pos")).alias("pos"))


@query("F29_fit_length", with_(
    "SELECT n.series_id, j.j AS idx, coalesce(s.x, 0.0) AS x FROM (SELECT series_id, (CASE WHEN series_id % 2 = 0 THEN count(*) + 5 ELSE count(*) // 2 END) AS m FROM s GROUP BY 1) n "
    "JOIN range(0, 1000000) j(j) ON j.j < n.m LEFT JOIN s ON s.series_id = n.series_id AND s.idx = j.j"))
def fit_length(spark, d):
    s = event_series(spark, d)
    want = F.when(F.col("series_id") % 2 == 0, F.col("n") + 5).otherwise(F.floor(F.col("n") / 2)).cast("long")
    return se.fit_length(s, K, series_lengths(s).withColumn("n", want), "x").select(*ROW, "x")


# ── aggregates over series ──────────────────────────────────────────────

@query("A6_rms", with_(f"SELECT series_id, round(sqrt(avg({XS_SQL} * {XS_SQL})) + 1e-12, 6) AS rms FROM s GROUP BY 1"))
def rms(spark, d):
    return event_series(spark, d).groupBy(*K).agg(sc.r6(F.sqrt(F.avg(XS() * XS())) + 1e-12).alias("rms"))


@query("A7_peak_guard", with_(
    f"SELECT series_id, idx, round({XS_SQL} * CASE WHEN max(abs({XS_SQL})) OVER (PARTITION BY series_id) > 0.95 THEN 0.95 / max(abs({XS_SQL})) OVER (PARTITION BY series_id) ELSE 1 END, 6) + 0.0 AS y FROM s"))
def peak_guard(spark, d):
    s = event_series(spark, d)
    peaks = s.groupBy(*K).agg(F.max(F.abs(XS())).alias("pk"))
    return s.join(peaks, K).select(*ROW, sc.r6(XS() * F.when(F.col("pk") > 0.95, F.lit(0.95) / F.col("pk")).otherwise(1.0)).alias("y"))


@query("A8_level_match", with_(
    "SELECT series_id, round(least(greatest(sqrt(avg(x * x) FILTER (event_type = 'view')) / (sqrt(avg(x * x) FILTER (event_type = 'click')) + 1e-12), pow(10.0, -0.1)), pow(10.0, 0.1)), 6) AS gain FROM s GROUP BY 1"))
def level_match(spark, d):
    part = lambda kind: F.sqrt(F.avg(F.when(F.col("event_type") == kind, X() * X())))
    gain = part("view") / (part("click") + 1e-12)
    lim = F.when(gain.isNotNull(), sc.clip(gain, 10 ** -0.1, 10 ** 0.1)).otherwise(F.lit(10 ** -0.1))
    return event_series(spark, d).groupBy(*K).agg(sc.r6(lim).alias("gain"))


@query("A9_robust_normalise", with_(
    f"SELECT series_id, idx, round({XS_SQL} / (p + 1e-9), 6) + 0.0 AS y FROM s JOIN (SELECT series_id, quantile_cont(abs({XS_SQL}), 0.95) AS p FROM s GROUP BY 1) USING (series_id)"))
def robust_normalise(spark, d):
    from cuelattice.operators.schedules import normalise_p95

    y = normalise_p95(event_series(spark, d).withColumn("xs", XS()), K, "xs", "y")
    return y.select(*ROW, sc.r6(F.col("y")).alias("y"))


@query("A10_quantile_reference", with_(
    "SELECT series_id, round(quantile_cont(x, 0.02), 6) AS p2, round(quantile_cont(x, 0.9), 6) AS p90, round(quantile_cont(x, 0.98), 6) AS p98 FROM s GROUP BY 1"))
def quantile_reference(spark, d):
    q = se.exact_percentiles(event_series(spark, d), K, "x", {"p2": 0.02, "p90": 0.9, "p98": 0.98})
    return q.select("series_id", *[sc.r6(F.col(c)).alias(c) for c in ("p2", "p90", "p98")])


@query("A11_block_reduce", with_(
    "SELECT p.series_id, p.idx AS cell, round(p.det, 6) AS peak, round(r.det, 6) AS rms, round(l.det, 6) AS low FROM p JOIN r USING (series_id, idx) JOIN l USING (series_id, idx)",
    cells_sql("p", "s", "x", "peak"), cells_sql("r", "s", "x", "rms"), cells_sql("l", "s", "x", "low")))
def block_reduce(spark, d):
    c = se.block_reduce(event_series(spark, d), K, X(), SIZE)
    return c.select("series_id", "cell", *[sc.r6(F.col(v)).alias(v) for v in ("peak", "rms", "low")])


@query("A18_channel_mean", """
SELECT user_id AS series_id, date_diff('day', TIMESTAMP '2024-01-01', ts) AS idx, event_type AS ch,
       round(avg(value) * 0.4 + avg(avg(value)) OVER (PARTITION BY user_id, date_diff('day', TIMESTAMP '2024-01-01', ts)) * 0.6, 6) AS y
FROM events GROUP BY 1, 2, 3""")
def channel_mean(spark, d):
    from cuelattice.plans.inputs import timed_events

    day = F.floor(F.col("t") / 86400).cast("long").alias("idx")
    ch = timed_events(spark, d).groupBy("series_id", day, F.col("event_type").alias("ch")).agg(F.avg("x").alias("v"))
    from cuelattice.operators.aggregates import mono_fold

    return mono_fold(ch, ["series_id", "idx"], "v", 0.6, "y").select("series_id", "idx", "ch", sc.r6(F.col("y")).alias("y"))


@query("W16_level_percentile_steps", with_(
    "SELECT series_id, cell, round(lo, 6) AS lo, round(hi, 6) AS hi FROM "
    f"(SELECT series_id, idx // 16 AS cell, quantile_cont(x, 0.02) AS lo, quantile_cont(x, 0.98) AS hi FROM s GROUP BY 1, 2)"))
def level_percentiles(spark, d):
    s = event_series(spark, d).withColumn("cell", F.floor(F.col("idx") / 16).cast("long"))
    q = se.exact_percentiles(s, ["series_id", "cell"], "x", {"lo": 0.02, "hi": 0.98})
    return q.select("series_id", "cell", sc.r6(F.col("lo")).alias("lo"), sc.r6(F.col("hi")).alias("hi"))

"""Registered queries over event plans: schedules, edits, intervals, cues, windows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cuelattice.functions import keyed, scalars as sc
from cuelattice.operators import edits as ed, intervals as iv, kernels as kn, mixing as mx, schedules as sd, series as se
from cuelattice.plans import event_plan as ep
from cuelattice.plans.catalog_inputs import CH_SQL, steps
from cuelattice.plans.event_plan import ACT_SQL, FRAMES, PLAN_SQL, USERS, _u, track_sql, user_clips
from cuelattice.plans.inputs import S_SQL, event_series, series_lengths, table, timed_events
from cuelattice.plans.registry import query

C = ["clip_id"]
SEED_SQL = "(clip_id % 10 + 77)"


def q(s: str) -> str:
    return f"'{s}'"


# ── generators ──────────────────────────────────────────────────────────

@query("G1_keyed_draw", f"SELECT event_id, round({_u('7', 'user_id', q('hits'), 'event_id')}, 9) AS u FROM events")
def keyed_draw(spark, d):
    return table(spark, d, "events").select("event_id", F.round(keyed.uniform(7, F.col("user_id"), "hits", F.col("event_id")), 9).alias("u"))


@query("G11_spine", f"WITH {USERS} SELECT clip_id, i.i AS idx FROM {FRAMES}")
def spine(spark, d):
    return sd.spine(user_clips(spark, d), C, "n_frames").select("clip_id", "idx")


@query("G2_white_track", f"WITH {USERS} SELECT clip_id, i.i AS idx, round({_u(SEED_SQL, 'clip_id', q('w'), 'i.i')} * 2 - 1, 6) + 0.0 AS v FROM {FRAMES}")
def white_track(spark, d):
    g = sd.spine(user_clips(spark, d), C, "n_frames")
    return g.select("clip_id", "idx", sc.r6(keyed.white(F.col("seed"), F.col("clip_id"), "w", F.col("idx"))).alias("v"))


@query("G3_smooth_track", f"WITH {track_sql('drift')} SELECT clip_id, idx, round(track, 6) + 0.0 AS v FROM tr")
def smooth_track(spark, d):
    g = sd.smooth_track(user_clips(spark, d), C, "n_frames", "drift", ep.HALF, "v")
    return g.select("clip_id", "idx", sc.r6(F.col("v")).alias("v"))


def onef_sql(key: str, alpha: float, octaves: int) -> str:
    total = " + ".join(
        f"({_u(SEED_SQL, 'clip_id', q(f'{key}/{o}'), f'(i.i // {2 ** o})')} * 2 - 1) * {2.0 ** (o * (alpha - 1.0) / 2.0)!r}" for o in range(octaves)
    )
    return (
        f"o AS MATERIALIZED (SELECT clip_id, i.i AS idx, {total} AS o FROM {FRAMES}), "
        "tr1 AS MATERIALIZED (SELECT clip_id, idx, o / (p + 1e-9) AS track FROM o JOIN (SELECT clip_id, quantile_cont(abs(o), 0.95) AS p FROM o GROUP BY 1) USING (clip_id))"
    )


@query("G4_onef_track", f"WITH {USERS}, {onef_sql('pink', 1.2, 6)} SELECT clip_id, idx, round(track, 6) + 0.0 AS v FROM tr1")
def onef_track(spark, d):
    g = sd.onef_track(sd.spine(user_clips(spark, d), C, "n_frames"), C, "pink", 1.2, 6, "v")
    return g.select("clip_id", "idx", sc.r6(F.col("v")).alias("v"))


MASK_SQL = f"m AS MATERIALIZED (SELECT clip_id, i.i AS idx FROM {FRAMES} WHERE {_u(SEED_SQL, 'clip_id', q('tear'), 'i.i')} < 0.08)"


def mask(spark, d):
    return sd.bernoulli_mask(sd.spine(user_clips(spark, d), C, "n_frames"), C, "tear", 0.08, F.lit(1.0))


@query("G5_sparse_mask", f"""WITH RECURSIVE {USERS}, {MASK_SQL}, n AS MATERIALIZED (SELECT clip_id, idx, row_number() OVER (PARTITION BY clip_id ORDER BY idx) AS rn FROM m),
 r AS (SELECT clip_id, rn, idx, idx AS kept FROM n WHERE rn = 1 UNION ALL SELECT n.clip_id, n.rn, n.idx, CASE WHEN n.idx - r.kept > 5 THEN n.idx ELSE r.kept END FROM r JOIN n ON n.clip_id = r.clip_id AND n.rn = r.rn + 1)
 SELECT clip_id, idx FROM r WHERE kept = idx""")
def sparse_mask(spark, d):
    return kn.fold_blocks(mask(spark, d), C, [], kn.min_gap(5.0, False, "idx"), "kept").filter("kept = 1").select("clip_id", "idx")


CELL, PER_MIN = 43200.0, 0.004
LAM = PER_MIN / 60.0 * CELL
POISSON_SQL = f"""th AS (SELECT unnest({keyed.poisson_thresholds(LAM)!r}::DOUBLE[]) AS c),
 pc AS (SELECT clip_id, n_frames, cell, (SELECT count(*) FROM th WHERE c <= un) AS n FROM (SELECT clip_id, n_frames, i.i AS cell, {_u(SEED_SQL, 'clip_id', q('hold'), 'i.i', q('n'))} AS un FROM u, unnest(range(0, ceil(n_frames * 3600 / {CELL})::BIGINT)) i(i))),
 pt AS MATERIALIZED (SELECT * FROM (SELECT clip_id, n_frames, cell, j.j AS draw, (cell + {_u(SEED_SQL, 'clip_id', q('hold'), 'cell', 'j.j')}) * {CELL} AS t FROM pc JOIN range(1, 100) j(j) ON j.j <= n) WHERE t < n_frames * 3600)"""


def poisson_times(spark, d):
    clips = user_clips(spark, d).withColumn("duration", F.col("n_frames") / F.col("fps"))
    return sd.poisson_times(clips, C, "hold", PER_MIN, CELL)


@query("G6_poisson_times", f"""WITH RECURSIVE {USERS}, {POISSON_SQL}, n AS MATERIALIZED (SELECT clip_id, t, row_number() OVER (PARTITION BY clip_id ORDER BY t) AS rn FROM pt),
 r AS (SELECT clip_id, rn, t, t AS kept FROM n WHERE rn = 1 UNION ALL SELECT n.clip_id, n.rn, n.t, CASE WHEN n.t - r.kept >= 7200 THEN n.t ELSE r.kept END FROM r JOIN n ON n.clip_id = r.clip_id AND n.rn = r.rn + 1)
 SELECT clip_id, round(t, 4) AS t FROM r WHERE kept = t""")
def poisson_schedule(spark, d):
    placed = se.with_block(se.index_rows(poisson_times(spark, d).select("clip_id", "t"), C, ["t"]))
    kept = kn.fold_blocks(placed, C, ["t"], kn.min_gap(7200.0, True, "t"), "kept").filter("kept = 1")
    return kept.select("clip_id", F.round("t", 4).alias("t"))


@query("G7_clip_anchored_window", f"WITH {PLAN_SQL} SELECT clip_id, id, round(t, 4) AS t, round(dur, 4) AS dur, round(peak, 6) AS peak, w.w AS win FROM plan, (VALUES (0), (1), (2)) w(w) WHERE t < (w.w + 1) * 604800.0 AND t + dur > w.w * 604800.0")
def clip_anchored(spark, d):
    plan = ep.plan_episodes(user_clips(spark, d))
    wins = plan.withColumn("win", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    cut = ep.in_window(wins, F.col("win") * 604800.0, (F.col("win") + 1) * 604800.0)
    return cut.select("clip_id", "id", F.round("t", 4).alias("t"), F.round("dur", 4).alias("dur"), F.round("peak", 6).alias("peak"), "win")


@query("G8_bursty_rate", f"""WITH {USERS}, {onef_sql('doburst', 1.2, 6)}, lam AS (SELECT clip_id, idx, 0.05 * (1.0 + 7.0 * 0.8 * greatest(track, 0.0) * greatest(track, 0.0)) AS l, {_u(SEED_SQL, 'clip_id', q('drop'), 'idx')} AS un FROM tr1),
 cum AS (SELECT clip_id, idx, un, k.k AS k, sum(exp(-l) * pow(l, k.k) / factorial(k.k::INTEGER)) OVER (PARTITION BY clip_id, idx ORDER BY k.k) AS c FROM lam, range(0, 20) k(k) WHERE un >= exp(-l)),
 cnt AS (SELECT clip_id, idx, count(*) FILTER (un >= c) AS n FROM cum GROUP BY 1, 2)
 SELECT clip_id, idx, i.i::INTEGER AS i, floor(20 + 280 * pow({_u(SEED_SQL, 'clip_id', q('geo'), 'idx', 'i.i')}, 2)) AS length FROM cnt JOIN range(0, 40) i(i) ON i.i < n""")
def bursty(spark, d):
    track = sd.onef_track(sd.spine(user_clips(spark, d), C, "n_frames"), C, "doburst", 1.2, 6, "track")
    rows = sd.bursty_counts(track, C, "drop", F.lit(0.05), F.lit(1.0), 0.8, F.col("track"))
    u = keyed.uniform(F.col("seed"), F.col("clip_id"), "geo", F.col("idx"), F.col("i"))
    return rows.select("clip_id", "idx", "i", F.floor(F.lit(20) + F.pow(u, F.lit(2)) * 280).cast("double").alias("length"))


@query("G9_cadence_maps", f"WITH {S_SQL} SELECT series_id, idx, idx // 2 * 2 AS twos, idx // 3 * 3 AS threes, idx // 5 * 5 + [0, 0, 1, 2, 3][idx % 5 + 1] AS pulldown, (idx * 2 // 3) * 3 // 2 AS retimed FROM s")
def cadence(spark, d):
    return event_series(spark, d).select(
        "series_id", "idx", sd.fixed_hold(2).alias("twos"), sd.fixed_hold(3).alias("threes"), sd.pulldown_src().alias("pulldown"),
        sd.retime_16_in_24(F.col("idx")).alias("retimed"),
    )


def holds_sql(long: bool) -> str:
    u1, u2 = _u("7", "series_id", q("hold"), "i.i"), _u("7", "series_id", q("len"), "i.i")
    h = f"CASE WHEN {u1} < 0.07 THEN 1 ELSE 4 + floor({u2} * 5)::BIGINT END" if long else f"CASE WHEN {u1} < 0.12 THEN 1 WHEN {u1} < 0.82 THEN 2 ELSE 3 END"
    return (
        f"h AS (SELECT series_id, i.i AS hold, {h} AS len, n FROM n JOIN range(0, 100000) i(i) ON i.i < n), "
        "p AS MATERIALIZED (SELECT *, (sum(len) OVER (PARTITION BY series_id ORDER BY hold) - len)::BIGINT AS pos FROM h) "
        "SELECT series_id, pos + j.j AS idx, pos AS src FROM p JOIN range(0, 10) j(j) ON j.j < len WHERE pos + j.j < n"
    )


def random_holds(spark, d, pattern: str):
    grid = sd.spine(series_lengths(event_series(spark, d)), ["series_id"], "n")
    draw = lambda what: keyed.uniform(7, F.col("series_id"), what, F.col("idx"))
    h = se.with_block(grid.withColumn("len", sd.hold_length(draw("hold"), pattern, draw("len"))))
    h = se.running_sum(h, ["series_id"], F.col("len"), "_end").withColumn("src", F.col("_end") - F.col("len")).filter("src < n")
    held = h.withColumn("idx", F.explode(F.sequence(F.col("src"), F.col("src") + F.col("len") - 1)))
    return held.filter("idx < n").select("series_id", "idx", "src")


@query("G9_mixed_holds", f"WITH {S_SQL}, n AS MATERIALIZED (SELECT series_id, count(*) AS n FROM s GROUP BY 1), {holds_sql(False)}")
def mixed_holds(spark, d):
    return random_holds(spark, d, "mixed")


@query("G9_long_holds", f"WITH {S_SQL}, n AS MATERIALIZED (SELECT series_id, count(*) AS n FROM s GROUP BY 1), {holds_sql(True)}")
def long_holds(spark, d):
    return random_holds(spark, d, "long")


@query("G9_flutter", f"WITH {S_SQL} SELECT series_id, idx, max(CASE WHEN idx = 0 OR {_u('7', 'series_id', q('flut'), 'idx')} >= 0.2 THEN idx END) OVER (PARTITION BY series_id ORDER BY idx) AS src FROM s")
def flutter(spark, d):
    s = event_series(spark, d).withColumn("seed", F.lit(7))
    return sd.flutter_src(s, ["series_id"], "flut", 0.2, "src").select("series_id", "idx", "src")


@query("G10_splice_skips", f"WITH {S_SQL} SELECT series_id, idx, (idx + sum(CASE WHEN event_type = 'error' THEN 2 + k % 4 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY idx))::BIGINT AS src FROM s")
def splice_skips(spark, d):
    skip = F.when(F.col("event_type") == "error", F.lit(2) + F.col("k") % 4).otherwise(F.lit(0))
    s = se.running_sum(event_series(spark, d), ["series_id"], skip, "skipped")
    return s.select("series_id", "idx", (F.col("idx") + F.col("skipped")).alias("src"))


@query("G12_periodic_cues", """SELECT o_orderkey AS clip_id, r.r * reel AS change, lead, greatest(round_even((r.r * reel + lead) * 24.0, 0), 0)::BIGINT AS start_frame, 4::BIGINT AS n_frames
 FROM (SELECT o_orderkey, o_totalprice / 100.0 AS duration, 600.0 + (o_orderkey % 5) * 60 AS reel FROM orders), range(1, 20) r(r), (VALUES (-7.0), (-1.2)) l(lead) WHERE r.r * reel < duration""")
def periodic(spark, d):
    clips = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("clip_id"), (F.col("o_totalprice") / 100.0).alias("duration"),
        (F.lit(600.0) + (F.col("o_orderkey") % 5) * 60).alias("reel"), F.lit(24.0).alias("fps"),
    )
    return sd.periodic_cues(clips, C, F.col("reel"), [-7.0, -1.2]).select("clip_id", "change", "lead", "start_frame", "n_frames")


# ── the plan ────────────────────────────────────────────────────────────

@query("F27_gate_activation", f"WITH {ACT_SQL} SELECT clip_id, idx, round(level, 6) AS level FROM ac")
def gate_activation(spark, d):
    return ep.activations(user_clips(spark, d)).select("clip_id", "idx", F.round("level", 6).alias("level"))


@query("S8_event_plan", f"WITH {PLAN_SQL} SELECT clip_id, layer, effect, kind, id, round(t, 4) AS t, round(dur, 4) AS dur, round(peak, 6) AS peak FROM plan WHERE t < 1728000.0 AND t + dur > 432000.0")
def event_plan(spark, d):
    return ep.planned_episodes(spark, d)


@query("P10_window_overlap", f"WITH {S_SQL} SELECT event_id FROM s WHERE t < 1000000 AND t + x * 10 > 500000")
def window_overlap(spark, d):
    return timed_events(spark, d).filter(sc.overlaps(F.col("t"), F.col("x") * 10, F.lit(500000.0), F.lit(1000000.0))).select("event_id")


@query("T2_event_order", f"WITH {S_SQL} SELECT event_id, row_number() OVER (ORDER BY round(t, 0), series_id, event_type, event_id) - 1 AS place FROM s")
def event_order(spark, d):
    ev = timed_events(spark, d).withColumn("tr", F.round("t", 0))
    return se.index_rows(ev.select("tr", "series_id", "event_type", "event_id"), [], ["tr", "series_id", "event_type", "event_id"], "place").select("event_id", "place")


# ── edits ───────────────────────────────────────────────────────────────

E_SQL = CH_SQL + """,
base AS MATERIALIZED (SELECT o_custkey AS job, 'o' || o_orderkey AS id, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS frame, 1.0 + floor(o_totalprice / 100000) AS dur_s,
  (o_orderkey % 100) / 100.0 AS intensity, 0.5::DOUBLE AS band_pos FROM orders),
ops AS MATERIALIZED (SELECT o_custkey AS job, 2 * pos + 2 AS op_pos, CASE WHEN q > 48 THEN 'remove' WHEN q > 40 THEN 'move' ELSE 'tune' END AS op,
  CASE WHEN q = 20 THEN 'lost' || c.job ELSE 'o' || c.job END AS id, CASE WHEN q > 40 AND q <= 48 THEN q * 60.0 END AS t,
  CASE WHEN q <= 40 THEN dc * 20 - 0.5 END AS intensity, q <= 40 AS has_i, CASE WHEN q <= 40 AND tx > 0.03 THEN tx * 100 END AS dur_s, q <= 40 AND tx > 0.03 AS has_d, NULL::DOUBLE AS band_pos, q <= 40 AND rf = 'R' AS has_b
  FROM ch c JOIN ordr USING (job)
  UNION ALL SELECT o_custkey, 0, 'add', 'edit:' || job, (job % 3000)::DOUBLE, 0.8, true, NULL, false, NULL, false FROM ordr WHERE status = 'P'
  UNION ALL SELECT o_custkey, 1, CASE WHEN job % 2 = 0 THEN 'tune' ELSE 'move' END, 'edit:' || job, CASE WHEN job % 2 = 1 THEN (job % 4000)::DOUBLE END, CASE WHEN job % 2 = 0 THEN 3.0 END, job % 2 = 0, NULL, false, 0.25, job % 2 = 0 FROM ordr WHERE status = 'P')"""

FIELDS = ["intensity", "dur_s", "band_pos"]
LIMITS = {"intensity": (0.05, 1.0), "band_pos": (0.0, 1.0)}
CLIP_FRAMES = 2700


def base_events(spark, d):
    """Orders as planned events of their customer's job: one frame a day."""
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_custkey").alias("job"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("id"),
        F.expr("timestampdiff(DAY, timestamp_ntz'1995-01-01 00:00:00', o_orderdate)").alias("frame"),
        (F.floor(F.col("o_totalprice") / 100000) + 1).cast("double").alias("dur_s"), (F.col("o_orderkey") % 100 / 100.0).alias("intensity"), F.lit(0.5).alias("band_pos"),
    )


def edit_ops(spark, d):
    """Order lines as edit operations; partial orders add an event of their own and edit it."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("job"), F.col("o_orderstatus").alias("status"))
    li = steps(spark, d).withColumnRenamed("job", "order").join(o, "order")
    q_, tune = F.col("q"), F.col("q") <= 40
    entry = lambda k, v, when: F.when(when, F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")))
    pack = lambda *es: F.map_from_entries(F.filter(F.array(*es), lambda e: e.isNotNull()))
    lines = li.select(
        "job", (F.col("pos") * 2 + 2).alias("op_pos"), F.when(q_ > 48, "remove").when(q_ > 40, "move").otherwise("tune").alias("op"),
        F.concat(F.when(q_ == 20, "lost").otherwise("o"), F.col("order")).alias("id"), F.when((q_ > 40) & (q_ <= 48), q_ * 60.0).alias("t"),
        pack(entry("intensity", F.col("dc") * 20 - 0.5, tune), entry("dur_s", F.col("tx") * 100, tune & (F.col("tx") > 0.03)),
             entry("band_pos", F.lit(None).cast("double"), tune & (F.col("rf") == "R"))).alias("detail"),
    )
    mine = o.filter("status = 'P'")
    key = F.concat(F.lit("edit:"), F.col("order")).alias("id")
    adds = mine.select("job", F.lit(0).cast("long").alias("op_pos"), F.lit("add").alias("op"), key, (F.col("order") % 3000).cast("double").alias("t"),
                       F.create_map(F.lit("intensity"), F.lit("0.8")).alias("detail"))
    even = F.col("order") % 2 == 0
    again = mine.select(
        "job", F.lit(1).cast("long").alias("op_pos"), F.when(even, "tune").otherwise("move").alias("op"), key, F.when(~even, (F.col("order") % 4000).cast("double")).alias("t"),
        pack(entry("intensity", F.lit(3.0), even), entry("band_pos", F.lit(0.25), even)).alias("detail"),
    )
    return lines.unionByName(adds).unionByName(again)


def edited(spark, d):
    return ed.apply_edits(
        base_events(spark, d), edit_ops(spark, d), ["job"], F.lit(1.0), F.lit(CLIP_FRAMES), FIELDS, LIMITS, {"intensity": 0.8, "dur_s": 0.6}
    )


CLAMP = {"intensity": "least(greatest({}, 0.05), 1.0)", "dur_s": "{}", "band_pos": "least(greatest({}, 0.0), 1.0)"}
FOLD_SQL = E_SQL + f""",
inst AS MATERIALIZED (SELECT job, id, frame, 'seeded' AS origin, -1 AS born, intensity, dur_s, band_pos FROM base
  UNION ALL SELECT job, id, t::BIGINT, 'added', op_pos, 0.8, 0.6, NULL FROM ops WHERE op = 'add' AND t >= 0 AND t < {CLIP_FRAMES}),
h AS MATERIALIZED (SELECT i.job, i.id, i.born, o.* EXCLUDE (job, id) FROM inst i JOIN ops o ON o.job = i.job AND o.id = i.id AND o.op <> 'add' AND o.op_pos > i.born),
fo AS (SELECT job, id, born, bool_or(op = 'remove' OR (op = 'move' AND t IS NOT NULL AND NOT (t >= 0 AND t < {CLIP_FRAMES}))) AS dead,
  arg_max(t, op_pos) FILTER (op = 'move' AND t IS NOT NULL) AS mt, max(op_pos) FILTER (has_i) AS pi, arg_max(intensity, op_pos) FILTER (has_i) AS vi,
  max(op_pos) FILTER (has_d) AS pd, arg_max(dur_s, op_pos) FILTER (has_d) AS vd, max(op_pos) FILTER (has_b) AS pb, max({{'p': op_pos, 'v': band_pos}}) FILTER (has_b) AS vb FROM h GROUP BY 1, 2, 3),
fin AS MATERIALIZED (SELECT i.job, i.id, coalesce(mt::BIGINT, i.frame) AS frame, i.origin, f.job IS NOT NULL AS edited,
  round(CASE WHEN pi IS NOT NULL THEN least(greatest(vi, 0.05), 1.0) ELSE i.intensity END, 6) AS intensity, round(CASE WHEN pd IS NOT NULL THEN vd ELSE i.dur_s END, 6) AS dur_s,
  round(CASE WHEN pb IS NOT NULL THEN vb.v ELSE i.band_pos END, 6) AS band_pos FROM inst i LEFT JOIN fo f ON f.job = i.job AND f.id = i.id AND f.born = i.born WHERE NOT coalesce(dead, false))"""


@query("J8_apply_edits", f"WITH {FOLD_SQL} SELECT job, id, frame, origin, edited, intensity, dur_s, band_pos FROM fin")
def apply_edits(spark, d):
    out = edited(spark, d)
    return out.select("job", "id", "frame", "origin", "edited", *[F.round(f, 6).alias(f) for f in FIELDS])


@query("J9_stale_edits", f"WITH {E_SQL} SELECT job, op_pos, id FROM ops WHERE op <> 'add' AND id LIKE 'lost%'")
def stale(spark, d):
    return ed.stale_edits(edit_ops(spark, d), base_events(spark, d), ["job"]).select("job", "op_pos", "id")


COMPACT_SQL = E_SQL + """,
mk AS (SELECT job, id, max(op_pos) FILTER (op = 'remove') AS gone, min(op_pos) FILTER (op = 'add') AS born FROM ops GROUP BY 1, 2),
lv AS MATERIALIZED (SELECT o.*, CASE WHEN op = 'remove' THEN 'remove' WHEN born IS NOT NULL AND coalesce(gone, -1) < born THEN 'add' ELSE op END AS nop
  FROM ops o JOIN mk USING (job, id) WHERE gone IS NULL OR op_pos > gone OR (op = 'remove' AND op_pos = gone AND born IS NULL))"""


@query("A14_edit_compaction", f"""WITH {COMPACT_SQL} SELECT job, id, nop AS op, min(op_pos) AS op_pos, arg_max(t, op_pos) FILTER (op IN ('add', 'move') AND t IS NOT NULL) AS t,
 round(arg_max(intensity, op_pos) FILTER (has_i), 6) AS intensity, round(arg_max(dur_s, op_pos) FILTER (has_d), 6) AS dur_s, count(*) FILTER (has_b) > 0 AS names_band FROM lv GROUP BY 1, 2, 3""")
def compaction(spark, d):
    c = ed.compact(edit_ops(spark, d), ["job"])
    num = lambda k: F.round(F.try_element_at("detail", F.lit(k)).try_cast("double"), 6).alias(k)
    return c.select("job", "id", "op", "op_pos", "t", num("intensity"), num("dur_s"), F.coalesce(F.map_contains_key("detail", F.lit("band_pos")), F.lit(False)).alias("names_band"))


@query("U1_seeded_and_added", f"WITH {E_SQL} SELECT job, id, frame::DOUBLE AS t FROM base UNION ALL SELECT job, id, t FROM ops WHERE op = 'add'")
def seeded_and_added(spark, d):
    base = base_events(spark, d).select("job", "id", F.col("frame").cast("double").alias("t"))
    return base.unionByName(edit_ops(spark, d).filter("op = 'add'").select("job", "id", "t"))


@query("U2_removed_ids", f"WITH {E_SQL} SELECT job, id FROM base ANTI JOIN (SELECT * FROM ops WHERE op = 'remove') r USING (job, id)")
def removed_ids(spark, d):
    gone = edit_ops(spark, d).filter("op = 'remove'").select("job", "id")
    return base_events(spark, d).select("job", "id").join(gone, ["job", "id"], "left_anti")


@query("U3_layer_concat", "SELECT l.layer, o_orderkey AS id, CASE l.layer WHEN 0 THEN o_totalprice ELSE o_totalprice * 0.5 END AS level FROM orders, (VALUES (0), (1)) l(layer) WHERE l.layer = 0 OR o_orderstatus = 'F'")
def layer_concat(spark, d):
    o = table(spark, d, "orders")
    first = o.select(F.lit(0).alias("layer"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("level"))
    second = o.filter("o_orderstatus = 'F'").select(F.lit(1).alias("layer"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") * 0.5).alias("level"))
    return first.unionByName(second)


@query("U5_edited_ids", f"WITH {E_SQL} SELECT DISTINCT job, id FROM ops WHERE op IN ('move', 'tune')")
def edited_ids(spark, d):
    return ed.edited_ids(edit_ops(spark, d), ["job"])


@query("P21_cue_ops", "SELECT conv_id AS clip_id, 'add' AS op, 'cue:' || conv_id || ':' || turn AS id, 'captions' AS effect, 'caption' AS kind, turn * 2.5 AS t, text, turn % 2 = 0 AS centred FROM conversations")
def cue_ops(spark, d):
    c = table(spark, d, "conversations").select(
        F.col("conv_id").alias("clip_id"), F.concat_ws(":", F.lit("cue"), "conv_id", "turn").alias("id"), (F.col("turn") * 2.5).alias("t"), "text",
        F.when(F.col("turn") % 2 == 0, "center").alias("align"),
    )
    ops = ed.cue_ops(c, C, ["text", "align"])
    return ops.select("clip_id", "op", "id", "effect", "kind", "t", F.col("detail")["text"].alias("text"), F.col("detail")["align"].isNotNull().alias("centred"))


@query("P21_replay_cues", f"""WITH d AS (SELECT conv_id, turn, role, 'c' || conv_id || ':' || turn AS id, length(text) AS n FROM conversations)
 SELECT conv_id AS clip_id, id, (turn * 60 + CASE WHEN role = 'user' THEN 7 ELSE 0 END)::BIGINT AS frame, CASE WHEN n % 2 = 0 THEN n / 10.0 ELSE 2.5 END AS dur_s FROM d WHERE n % 5 <> 0""")
def replay_cues(spark, d):
    c = table(spark, d, "conversations").select(
        F.col("conv_id").alias("clip_id"), "turn", "role", F.concat(F.lit("c"), F.col("conv_id"), F.lit(":"), F.col("turn")).alias("id"), F.length("text").alias("n")
    )
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    op = lambda rows, pos, name, t, detail=nothing: rows.select(
        "clip_id", (F.col("turn") * 4 + pos).alias("op_pos"), F.lit(name).alias("op"), "id", t.cast("double").alias("t"), detail.alias("detail")
    )
    adds = op(c, 0, "add", F.col("turn") * 2.0)
    moves = op(c.filter("role = 'user'"), 1, "move", F.col("turn") * 2.0 + 7 / 30)
    tunes = op(c.filter("n % 2 = 0"), 2, "tune", F.lit(None), F.create_map(F.lit("dur_s"), (F.col("n") / 10.0).cast("string")))
    cuts = op(c.filter("n % 5 = 0"), 3, "remove", F.lit(None))
    ops = adds.unionByName(moves).unionByName(tunes).unionByName(cuts)
    none = c.select("clip_id", "id", F.lit(0).cast("long").alias("frame"), F.lit(0.0).alias("dur_s")).filter(F.lit(False))
    return ed.apply_edits(none, ops, C, F.lit(30.0), F.lit(1 << 40), ["dur_s"], {}, {"dur_s": 2.5}).select("clip_id", "id", "frame", "dur_s")


# ── intervals ───────────────────────────────────────────────────────────

I_SQL = S_SQL + """, iv AS MATERIALIZED (SELECT series_id AS clip_id, event_id, floor(t / 600)::BIGINT AS start, (1 + floor(x / 20))::BIGINT AS dur, x / 500.0 AS amp, k % 10 / 10.0 AS pos FROM s),
cells AS MATERIALIZED (SELECT clip_id, event_id, start + j.j AS frame, j.j AS k, dur, amp, pos FROM iv JOIN range(0, 40) j(j) ON j.j < dur)"""


def event_intervals(spark, d):
    """Events as intervals on a ten-minute grid."""
    return timed_events(spark, d).select(
        F.col("series_id").alias("clip_id"), "event_id", F.floor(F.col("t") / 600).cast("long").alias("start"),
        (F.floor(F.col("x") / 20) + 1).cast("long").alias("dur"), (F.col("x") / 500.0).alias("amp"), (F.col("k") % 10 / 10.0).alias("pos"),
    )


@query("J10_rasterise_strongest", f"""WITH {I_SQL} SELECT clip_id, frame, round(amp, 6) AS amp, event_id, pos FROM cells QUALIFY row_number() OVER (PARTITION BY clip_id, frame ORDER BY amp DESC, event_id) = 1""")
def rasterise(spark, d):
    best = iv.strongest(iv.on_grid(event_intervals(spark, d)), C, "amp", ["event_id", "pos"], ["event_id"])
    return best.select("clip_id", "frame", F.round("amp", 6).alias("amp"), "event_id", "pos")


@query("J11_active_intervals", f"WITH {I_SQL} SELECT p.event_id AS point, i.event_id AS cue FROM iv p JOIN iv i ON i.clip_id = p.clip_id AND p.start >= i.start AND p.start < i.start + i.dur")
def active(spark, d):
    i = event_intervals(spark, d)
    pts = i.select("clip_id", F.col("event_id").alias("point"), F.col("start").alias("at"))
    return iv.active_at(pts, i.select("clip_id", F.col("event_id").alias("cue"), "start", "dur"), C, "at", 32).select("point", "cue")


@query("A17_longest_hold", f"WITH {I_SQL}, o AS (SELECT clip_id, frame, count(*) AS n FROM cells GROUP BY 1, 2) SELECT clip_id, max(n)::BIGINT AS most_open, any_value(l.longest) AS longest FROM o JOIN (SELECT clip_id, max(dur) AS longest FROM iv GROUP BY 1) l USING (clip_id) GROUP BY 1")
def longest_hold(spark, d):
    return iv.longest_and_most(event_intervals(spark, d), C).select("clip_id", "most_open", "longest")


@query("W20_edge_profile", f"""WITH {I_SQL} SELECT event_id, frame, round(amp * CASE WHEN k - (dur - e) >= 0 THEN CASE WHEN e = 1 THEN 1.0 ELSE 1.0 - (k - (dur - e)) / (e - 1) * 0.75 END
 WHEN k < e THEN CASE WHEN e = 1 THEN 0.3 ELSE 0.3 + 0.7 * k / (e - 1) END ELSE 1.0 END, 9) AS level FROM (SELECT *, greatest(least(3, dur // 2), 1) AS e FROM cells)""")
def edge_profile(spark, d):
    return iv.glitch_profile(event_intervals(spark, d), "amp", "level").select("event_id", "frame", F.round("level", 9).alias("level"))


@query("W21_relax_next", f"""WITH {I_SQL}, te AS (SELECT clip_id, start AS frame, max(amp) AS amp FROM iv GROUP BY 1, 2)
 SELECT clip_id, frame, round(amp, 6) AS amp, false AS relaxing FROM te UNION ALL SELECT clip_id, frame + 1, round(amp * 0.5, 6), true FROM te t WHERE NOT EXISTS (SELECT 1 FROM te o WHERE o.clip_id = t.clip_id AND o.frame = t.frame + 1)""")
def relax_next(spark, d):
    tears = event_intervals(spark, d).groupBy("clip_id", F.col("start").alias("frame")).agg(F.max("amp").alias("amp"))
    return iv.relaxed(tears, C, "amp").select("clip_id", "frame", F.round("amp", 6).alias("amp"), "relaxing")


@query("W26_dip_mix", f"WITH {I_SQL} SELECT clip_id, frame, round(min(1.0 - (0.5 - 0.5 * cos({2 * math.pi!r} * k / greatest(dur - 1, 1))) * (1.0 - pow(10.0, -(6.0 + pos * 20) / 20.0))), 6) AS gain FROM cells GROUP BY 1, 2")
def dip_mix(spark, d):
    return iv.dips(event_intervals(spark, d), C, F.lit(6.0) + F.col("pos") * 20).select("clip_id", "frame", F.round("gain", 6).alias("gain"))


@query("F28_band_bell", f"""SELECT event_id, round(0.5 + 0.5 * cos({math.pi!r} * least(greatest((r - (b / 2.0 + p * greatest(48 - b, 0))) / (b * 0.5), -1), 1)), 6) AS w
 FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) % 48 AS r, value / 500.0 AS p, greatest((0.05 + (event_id % 10) / 20.0) * 48, 3.0) AS b FROM events)""")
def band_bell(spark, d):
    h = F.lit(0.05) + F.col("event_id") % 10 / 20.0
    return timed_events(spark, d).select("event_id", F.round(sc.bell_weight(F.col("k") % 48, F.lit(48), F.col("x") / 500.0, h), 6).alias("w"))

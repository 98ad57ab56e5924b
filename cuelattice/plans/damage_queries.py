"""Registered queries over the damage plan of two-layer jobs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from cuelattice.operators.event_edits import DROPOUT, FIELDS, STORM
from cuelattice.operators.schedules import hann_taps
from cuelattice.plans import damage_plan as dp
from cuelattice.plans.event_plan import USERS, _u
from cuelattice.plans.registry import query

W0, W1 = 432000.0, 1728000.0
FPS = "(1.0::DOUBLE / 3600.0::DOUBLE)"


def q(s: str) -> str:
    return f"'{s}'"


def u(*what: str) -> str:
    return _u("seed", "clip_id", "layer", *what)


def mark_sql(name: str, p: str) -> str:
    """CTEs of marked frames, none less than the gap after the one before."""
    return f"""{name}_m AS MATERIALIZED (SELECT clip_id, layer, seed, i.i AS idx, row_number() OVER (PARTITION BY clip_id, layer ORDER BY i.i) AS rn FROM ly, unnest(range(0, n_frames)) i(i) WHERE {p}),
 {name}_r AS (SELECT clip_id, layer, seed, rn, idx, idx AS kept FROM {name}_m WHERE rn = 1 UNION ALL SELECT m.clip_id, m.layer, m.seed, m.rn, m.idx, CASE WHEN m.idx - r.kept > {dp.MIN_GAP} THEN m.idx ELSE r.kept END
  FROM {name}_r r JOIN {name}_m m ON m.clip_id = r.clip_id AND m.layer = r.layer AND m.rn = r.rn + 1),
 {name} AS MATERIALIZED (SELECT clip_id, layer, seed, idx FROM {name}_r WHERE kept = idx)"""


GAUSS = f"sqrt(-2.0 * ln(1.0 - {u(q('trgate'), 'i.i', q('r'))})) * cos({2 * math.pi!r} * {u(q('trgate'), 'i.i', q('a'))})"
FIR = " + ".join(f"{'lag' if k <= 0 else 'lead'}(g, {abs(k)}) OVER w * {t!r}" for k, t in zip(range(-dp.HALF, dp.HALF + 1), hann_taps(dp.HALF)))
BURST = " + ".join(f"({u(q(f'doburst/{o}'), f'(i.i // {2 ** o})')} * 2 - 1) * {2.0 ** (o * (dp.ALPHA - 1.0) / 2.0)!r}" for o in range(dp.OCTAVES))
GEO = lambda what: u(q("dropout"), "idx", "i", q(what))
EDIT = lambda what: _u(q("edit"), "id", what)
BAND = "CASE WHEN {v} IS NULL THEN NULL ELSE CASE kind WHEN 'tracking_storm' THEN least(greatest({v}, 0.02), 0.6) WHEN 'skew_tear' THEN least(greatest({v}, 0.004), 0.3) WHEN 'transport_glitch' THEN least(greatest({v}, 0.05), 0.8) END END"

SEEDED_SQL = f"""{USERS},
ly AS MATERIALIZED (SELECT clip_id, l.l AS layer, n_frames, CASE l.l WHEN 0 THEN clip_id % 10 + 77 ELSE clip_id % 7 + 101 END AS seed, CASE clip_id % 2 WHEN 1 THEN 768 ELSE 640 END AS width,
  CASE WHEN l.l = 1 THEN 0.25 * boost WHEN clip_id % 4 = 0 THEN 0.3 ELSE 0.2::DOUBLE + (clip_id % 5) * 0.05::DOUBLE END::DOUBLE AS tracking,
  CASE WHEN l.l = 1 THEN 0.0 WHEN clip_id % 3 = 0 THEN 0.08 ELSE 0.04 END::DOUBLE AS drops, CASE WHEN l.l = 1 THEN 0.3 * boost WHEN clip_id % 3 = 0 THEN 0.5 ELSE 0.3 END::DOUBLE AS skew,
  CASE WHEN l.l = 1 THEN 0.03 * boost END::DOUBLE AS glitch
  FROM (SELECT *, (0.5 + clip_id % 3 * 0.25)::DOUBLE AS boost FROM u), (VALUES (0), (1)) l(l) WHERE l.l = 0 OR clip_id % 2 = 1),
g AS MATERIALIZED (SELECT clip_id, layer, seed, tracking, n_frames, i.i AS idx, {GAUSS} AS g FROM ly, unnest(range({-dp.HALF}, n_frames + {dp.HALF})) i(i) WHERE tracking > 0),
f AS MATERIALIZED (SELECT * FROM (SELECT * EXCLUDE (g), {FIR} AS f FROM g WINDOW w AS (PARTITION BY clip_id, layer ORDER BY idx)) WHERE idx >= 0 AND idx < n_frames),
lv AS MATERIALIZED (SELECT * FROM (SELECT clip_id, layer, idx, pow(least(greatest((0.5 + f / (p + 1e-9) * 0.5 - (0.92 - tracking)) / 0.3, 0.0), 1.0), 1.3) * (0.55 + 0.45 * abs({u(q('trflick'), 'idx')} * 2 - 1)) AS level
  FROM f JOIN (SELECT clip_id, layer, quantile_cont(abs(f), 0.95) AS p FROM f GROUP BY 1, 2) USING (clip_id, layer)) WHERE level > 0.02),
st AS MATERIALIZED (SELECT clip_id, layer, min(idx) AS frame, count(*) AS frames, max(level) AS intensity, list(level ORDER BY idx) AS seg
  FROM (SELECT *, idx - row_number() OVER (PARTITION BY clip_id, layer ORDER BY idx) AS gr FROM lv) GROUP BY clip_id, layer, gr),
o AS MATERIALIZED (SELECT clip_id, layer, seed, width, drops, i.i AS idx, {BURST} AS o FROM ly, unnest(range(0, n_frames)) i(i) WHERE drops > 0),
rt AS (SELECT * EXCLUDE (o, p), drops * (1.0 + 0.8::DOUBLE * 7.0 * greatest(o / (p + 1e-9), 0.0) * greatest(o / (p + 1e-9), 0.0)) AS l, {u(q('dropouts'), 'idx')} AS un
  FROM o JOIN (SELECT clip_id, layer, quantile_cont(abs(o), 0.95) AS p FROM o GROUP BY 1, 2) USING (clip_id, layer)),
cu AS (SELECT *, sum(exp(-l) * pow(l, k.k) / factorial(k.k::INTEGER)) OVER (PARTITION BY clip_id, layer, idx ORDER BY k.k) AS c FROM rt, range(0, 20) k(k) WHERE un >= exp(-l)),
cn AS (SELECT clip_id, layer, seed, width, idx, count(*) FILTER (un >= c) AS n FROM cu GROUP BY ALL),
dr AS MATERIALIZED (SELECT clip_id, layer, idx AS frame, i, len AS length, floor({GEO('x')} * (width - len))::BIGINT AS x, floor({GEO('r')} * {dp.HEIGHT})::BIGINT AS row, {GEO('d')} < 0.12 AS dark, CASE WHEN {GEO('n')} < 0.65 THEN 1 ELSE 2 END AS rows
  FROM (SELECT *, greatest(least(floor((20.0 + pow({GEO('l')}, 2) * 280.0) * (width / 720.0::DOUBLE))::BIGINT, width - 2), 6) AS len FROM (SELECT cn.*, i.i::INTEGER AS i FROM cn JOIN range(0, 40) i(i) ON i.i < n))),
{mark_sql('te', f"skew > 0 AND {u(q('skewev'), 'i.i')} < 0.02 + skew * 0.1")},
{mark_sql('gl', f"glitch > 0 AND {u(q('glitch'), 'i.i')} < glitch")},
sd AS MATERIALIZED (
  SELECT clip_id, layer, 'vhs' AS effect, 'tracking_storm' AS kind, 'vhs:tracking_storm:' || frame || ':0' AS id, frame, frames, intensity::DOUBLE AS intensity, NULL::BIGINT AS x, NULL::BIGINT AS row, NULL::BIGINT AS length, NULL::BIGINT AS rows, NULL::BOOLEAN AS dark FROM st
  UNION ALL SELECT clip_id, layer, 'vhs', 'dropout', 'vhs:dropout:' || frame || ':' || i, frame, 1, NULL, x, row, length, rows, dark FROM dr
  UNION ALL SELECT clip_id, layer, 'vhs', 'skew_tear', 'vhs:skew_tear:' || idx || ':0', idx, 2, 1.0, NULL, NULL, NULL, NULL, NULL FROM te
  UNION ALL SELECT clip_id, layer, 'transport', 'transport_glitch', 'transport:transport_glitch:' || idx || ':0', idx, 2 + floor({u(q('glitchdur'), 'idx')} * 5)::BIGINT, 1.0, NULL, NULL, NULL, NULL, NULL FROM gl)"""

# A null flag means that the operation does not name the field.
EDITED_SQL = SEEDED_SQL + f""",
e0 AS (SELECT event_id, user_id AS clip_id, event_id % 2 AS layer, (epoch_us(ts) - 1704067200000000) // 3600000000 AS f, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
  ['vhs', 'vhs', 'vhs', 'transport'][(event_id // 2) % 4 + 1] AS effect, ['tracking_storm', 'dropout', 'skew_tear', 'transport_glitch'][(event_id // 2) % 4 + 1] AS kind,
  CASE event_type WHEN 'purchase' THEN 'add' WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'move' ELSE 'tune' END AS op FROM events),
e1 AS (SELECT *, CASE WHEN op = 'add' THEN 'edit:' || event_id ELSE effect || ':' || kind || ':' || f || ':0' END AS id FROM e0),
c0 AS (SELECT conv_id AS clip_id, turn, text, length(text) AS n, 'cue:' || conv_id || ':' || turn AS id, 1099511627776 + turn * 4 AS p, turn * 50 + length(text) % 11 AS f FROM conversations),
o0 AS (
  SELECT clip_id, layer, event_id * 2 AS op_pos, op, effect, kind, id, CASE op WHEN 'move' THEN f + k % 30 - 5 WHEN 'add' THEN f END AS f, CASE WHEN k % 4 <> 3 THEN 0.2::DOUBLE + k % 10 * 0.12::DOUBLE END AS i, CASE WHEN k % 3 = 0 THEN (k % 9 + 1) * 3600.0 END::DOUBLE AS d,
    k % 5 < 2 AS has_bp, CASE WHEN k % 5 = 1 THEN 0.5 END::DOUBLE AS bp, CASE WHEN k % 7 > 3 THEN k % 7 * 0.2::DOUBLE END AS bh, CASE WHEN k % 2 = 0 THEN k * 40 END AS x, CASE WHEN k % 3 = 0 THEN k * 20 END AS l, CASE WHEN k % 5 = 2 THEN k * 9 END AS r,
    CASE WHEN k % 4 > 0 THEN k % 4 END AS nr, CASE WHEN k % 6 = 0 THEN k % 2 = 0 END AS dk, NULL::VARCHAR AS text FROM e1
  UNION ALL SELECT clip_id, layer, event_id * 2 + 1, 'tune', effect, kind, id, NULL, CASE WHEN k % 2 = 0 THEN 0.3::DOUBLE + k % 6 * 0.1::DOUBLE END, CASE WHEN k % 2 = 1 THEN (k % 6 + 2) * 3600.0 END, false, NULL, NULL, k * 31, CASE WHEN k % 4 = 1 THEN k * 11 END, NULL, NULL, NULL, NULL FROM e1 WHERE event_id % 3 = 0
  UNION ALL SELECT clip_id, 0, p, 'add', 'captions', 'caption', id, f, NULL, CASE WHEN n % 2 = 0 THEN (n % 5 + 0.4) * 3600.0 END, false, NULL, NULL, NULL, NULL, NULL, NULL, NULL, text FROM c0
  UNION ALL SELECT clip_id, 0, p + 1, 'move', 'captions', 'caption', id, f + 2, NULL, NULL, false, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM c0 WHERE n % 4 = 1
  UNION ALL SELECT clip_id, 0, p + 2, 'tune', 'captions', 'caption', id, NULL, NULL, 10800.0, false, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '~' || text FROM c0 WHERE n % 3 = 1
  UNION ALL SELECT clip_id, 0, p + 3, 'remove', 'captions', 'caption', id, NULL, NULL, NULL, false, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM c0 WHERE n % 7 = 0),
op AS MATERIALIZED (SELECT o0.*, n_frames, width, CASE WHEN d IS NULL THEN NULL WHEN kind = 'transport_glitch' THEN greatest(floor(d * {FPS})::BIGINT, 2) WHEN kind = 'caption' THEN greatest(round_even(d * {FPS}, 0)::BIGINT, 1) ELSE greatest(round_even(d * {FPS}, 0)::BIGINT, 2) END AS fr
  FROM o0 JOIN ly USING (clip_id, layer) WHERE effect = 'vhs' OR (effect = 'captions' AND layer = 0) OR (effect = 'transport' AND layer = 1)),
ad AS MATERIALIZED (SELECT clip_id, layer, effect, kind, id, f AS frame, CASE kind WHEN 'dropout' THEN 1 WHEN 'skew_tear' THEN 2 WHEN 'caption' THEN coalesce(fr, 1) ELSE coalesce(fr, 2) END AS frames, op_pos AS born,
  CASE kind WHEN 'tracking_storm' THEN least(greatest(coalesce(i, 0.8), 0.05), 1.0) WHEN 'skew_tear' THEN least(greatest(coalesce(i, 1.0), 0.05), 2.0) WHEN 'transport_glitch' THEN least(greatest(coalesce(i, 1.0), 0.05), 1.0) END::DOUBLE AS intensity,
  CASE WHEN drop_ THEN greatest(least(coalesce(x, floor({EDIT(q('x'))} * greatest(width - len, 1))::BIGINT), width - len), 0) END AS x, CASE WHEN drop_ THEN greatest(least(coalesce(r, floor({EDIT(q('r'))} * {dp.HEIGHT})::BIGINT), {dp.HEIGHT - 1}), 0) END AS row,
  len AS length, CASE WHEN drop_ THEN coalesce(nr, 1) END AS rows, CASE WHEN drop_ THEN coalesce(dk, false) END AS dark, CASE WHEN NOT drop_ AND kind <> 'caption' THEN bp END AS bp, {BAND.format(v='bh')}::DOUBLE AS bh, CASE WHEN kind = 'caption' THEN coalesce(text, '') END AS text
  FROM (SELECT *, kind = 'dropout' AS drop_, CASE WHEN kind = 'dropout' THEN greatest(least(coalesce(l, floor(20 + pow({EDIT(q('l'))}, 2) * 280 * width / 720)::BIGINT), width - 2), 6) END AS len FROM op WHERE op = 'add' AND f >= 0 AND f < n_frames)),
al AS MATERIALIZED (SELECT sd.*, 'seeded' AS origin, -1::BIGINT AS born, NULL::DOUBLE AS bp, NULL::DOUBLE AS bh, NULL::VARCHAR AS text FROM sd
  UNION ALL SELECT clip_id, layer, effect, kind, id, frame, frames, intensity, x, row, length, rows, dark, 'added', born, bp, bh, text FROM ad),
ht AS MATERIALIZED (SELECT op.*, al.born FROM op JOIN al USING (clip_id, layer, effect, kind, id) WHERE op <> 'add' AND op_pos > al.born),
fo AS MATERIALIZED (SELECT clip_id, layer, id, kind, count(*) AS n_ops, bool_or(op = 'remove' OR (op = 'move' AND f IS NOT NULL AND NOT (f >= 0 AND f < n_frames))) AS dead, arg_max(f, op_pos) FILTER (op = 'move' AND f IS NOT NULL) AS mf,
  arg_max(CASE kind WHEN 'skew_tear' THEN least(greatest(i, 0.05), 2.0) ELSE least(greatest(i, 0.05), 1.0) END, op_pos) FILTER (op = 'tune' AND i IS NOT NULL AND kind IN ('skew_tear', 'transport_glitch')) AS vi,
  arg_max(fr, op_pos) FILTER (op = 'tune' AND fr IS NOT NULL AND kind IN ('transport_glitch', 'caption')) AS vf,
  arg_max(least(greatest(x, 0), width - 2), op_pos) FILTER (op = 'tune' AND x IS NOT NULL AND kind = 'dropout') AS vx, arg_max(least(greatest(r, 0), {dp.HEIGHT - 1}), op_pos) FILTER (op = 'tune' AND r IS NOT NULL AND kind = 'dropout') AS vr,
  max(op_pos) FILTER (op = 'tune' AND l IS NOT NULL AND kind = 'dropout') AS pl, arg_max(l, op_pos) FILTER (op = 'tune' AND l IS NOT NULL AND kind = 'dropout') AS vl,
  arg_max(CASE WHEN nr <= 1 THEN 1 ELSE 2 END, op_pos) FILTER (op = 'tune' AND nr IS NOT NULL AND kind = 'dropout') AS vn, arg_max(dk, op_pos) FILTER (op = 'tune' AND dk IS NOT NULL AND kind = 'dropout') AS vk,
  max({{'p': op_pos, 'v': bp}}) FILTER (op = 'tune' AND has_bp AND kind IN ('tracking_storm', 'skew_tear', 'transport_glitch')) AS vbp,
  arg_max({BAND.format(v='bh')}, op_pos) FILTER (op = 'tune' AND bh IS NOT NULL AND kind IN ('tracking_storm', 'skew_tear', 'transport_glitch')) AS vbh, arg_max(text, op_pos) FILTER (op = 'tune' AND text IS NOT NULL) AS vt FROM ht GROUP BY 1, 2, 3, 4),
xt AS (SELECT ht.clip_id, ht.layer, ht.id, arg_max(least(greatest(x, 0), width - 2), op_pos) AS x_then FROM ht JOIN fo ON fo.clip_id = ht.clip_id AND fo.layer = ht.layer AND fo.id = ht.id AND op_pos <= pl WHERE op = 'tune' AND x IS NOT NULL AND ht.kind = 'dropout' GROUP BY 1, 2, 3),
sp AS (SELECT clip_id, layer, id, op_pos, 0 AS k, i AS peak, NULL::BIGINT AS fr FROM ht WHERE op = 'tune' AND kind = 'tracking_storm' AND i IS NOT NULL UNION ALL SELECT clip_id, layer, id, op_pos, 1, NULL::DOUBLE, fr FROM ht WHERE op = 'tune' AND kind = 'tracking_storm' AND fr IS NOT NULL),
sn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY clip_id, layer, id ORDER BY op_pos, k) AS n FROM sp),
cv AS (SELECT clip_id, layer, id, 0 AS n, seg FROM (
    SELECT clip_id, layer, 'vhs:tracking_storm:' || frame || ':0' AS id, seg FROM st
    UNION ALL SELECT clip_id, layer, id, list((0.5 + 0.5 * cos({math.pi!r} * (-1.0 + j * (2.0 / (frames - 1))))) * intensity * (0.55 + 0.45 * {EDIT("'seg' || ':' || j")}) ORDER BY j) FROM (SELECT *, unnest(range(0, frames)) AS j FROM ad WHERE kind = 'tracking_storm') GROUP BY 1, 2, 3)
  UNION ALL SELECT cv.clip_id, cv.layer, cv.id, sn.n, CASE WHEN sn.peak IS NOT NULL THEN list_transform(seg, lambda v: least(greatest(v * (sn.peak / CASE WHEN list_max(seg) > 0 THEN list_max(seg) ELSE 1 END), 0.0), 1.0))
    WHEN len(seg) = 1 THEN list_transform(range(0, sn.fr), lambda j: seg[1])
    ELSE list_transform(range(0, sn.fr), lambda j: seg[1 + least(floor(j * ((len(seg) - 1)::DOUBLE / (sn.fr - 1))), len(seg) - 2)::INT] + (j * ((len(seg) - 1)::DOUBLE / (sn.fr - 1)) - least(floor(j * ((len(seg) - 1)::DOUBLE / (sn.fr - 1))), len(seg) - 2))
      * (seg[2 + least(floor(j * ((len(seg) - 1)::DOUBLE / (sn.fr - 1))), len(seg) - 2)::INT] - seg[1 + least(floor(j * ((len(seg) - 1)::DOUBLE / (sn.fr - 1))), len(seg) - 2)::INT])) END
  FROM cv JOIN sn ON sn.clip_id = cv.clip_id AND sn.layer = cv.layer AND sn.id = cv.id AND sn.n = cv.n + 1),
cf AS MATERIALIZED (SELECT clip_id, layer, id, arg_max(seg, n) AS seg FROM cv GROUP BY 1, 2, 3),
fin AS MATERIALIZED (SELECT al.clip_id, al.layer, al.effect, al.kind, al.id, coalesce(mf, frame) AS frame, CASE WHEN al.kind = 'tracking_storm' THEN len(cf.seg) ELSE coalesce(vf, frames) END AS frames, origin, fo.id IS NOT NULL AS edited,
  CASE WHEN al.kind = 'tracking_storm' THEN list_max(cf.seg) ELSE coalesce(vi, intensity) END AS intensity, coalesce(vx, x) AS x, coalesce(vr, row) AS row, CASE WHEN vl IS NOT NULL THEN greatest(least(vl, width - coalesce(x_then, x)), 6) ELSE length END AS length,
  coalesce(vn, rows) AS rows, coalesce(vk, dark) AS dark, CASE WHEN vbp IS NOT NULL THEN vbp.v ELSE bp END AS band_pos, coalesce(vbh, bh) AS band_height, coalesce(vt, text) AS text, cf.seg
  FROM al JOIN ly USING (clip_id, layer) LEFT JOIN fo ON fo.clip_id = al.clip_id AND fo.layer = al.layer AND fo.id = al.id LEFT JOIN xt ON xt.clip_id = al.clip_id AND xt.layer = al.layer AND xt.id = al.id
  LEFT JOIN cf ON cf.clip_id = al.clip_id AND cf.layer = al.layer AND cf.id = al.id WHERE NOT coalesce(dead, false))"""

ROW_SQL = "origin, edited, round(intensity, 6) AS intensity, x::DOUBLE AS x, row::DOUBLE AS row, length::DOUBLE AS length, rows::DOUBLE AS rows, dark::INT::DOUBLE AS dark, band_pos, round(band_height, 6) AS band_height, text"


def rounded(df: DataFrame) -> DataFrame:
    whole = {c: F.col(c).cast("int").cast("double") if c == "dark" else F.col(c).cast("double") for c in ("x", "row", "length", "rows", "dark")}
    return df.withColumns({c: F.round(c, 6) for c in ("intensity", "band_height")} | whole | {"edited": F.coalesce("edited", F.lit(False))})


@query("S8_layered_plan", f"""WITH RECURSIVE {EDITED_SQL}
SELECT clip_id, layer, effect, kind, id, round(frame / {FPS}, 4) AS t, round(frames / {FPS}, 4) AS dur, frames, {ROW_SQL} FROM fin WHERE frame / {FPS} < {W1} AND (frame / {FPS}) + (frames / {FPS}) > {W0}
UNION ALL SELECT clip_id, -1, '', 'header', '', {W0}, {W1 - W0}, any_value(n_frames), NULL, false, NULL, NULL, NULL, NULL, count(*), NULL, NULL, NULL, NULL FROM ly GROUP BY 1""")
def layered_plan(spark, d):
    p = dp.seeded_plan(spark, d)
    return rounded(dp.plan_table(p.layers, dp.edited_events(spark, d, p), W0, W1))


@query("G8_dropout_geometry", f"WITH RECURSIVE {SEEDED_SQL} SELECT clip_id, layer, id, frame, x, row, length, rows, dark FROM sd WHERE kind = 'dropout'")
def dropout_geometry(spark, d):
    layers = dp.dialled_layers(spark, d)
    grid = dp.spine_of(layers.filter("dropouts > 0"), {DROPOUT})
    rows = dp.dropouts(grid, grid)
    event_id = F.concat_ws(":", F.lit("vhs"), F.lit("dropout"), F.col("frame").cast("string"), F.col("i").cast("string"))
    return rows.select("clip_id", F.col("layer_pos").alias("layer"), event_id.alias("id"), "frame", "x", "row", "length", "rows", "dark")


@query("J8_tuned_storms", f"""WITH RECURSIVE {EDITED_SQL}
SELECT clip_id, layer, id, frame, frames, origin, edited, round(intensity, 6) AS intensity, round(list_sum(list_transform(seg, lambda v, j: v * j)), 6) AS moment FROM fin
WHERE kind = 'tracking_storm' AND (origin = 'added' OR EXISTS (SELECT 1 FROM sn WHERE sn.clip_id = fin.clip_id AND sn.layer = fin.layer AND sn.id = fin.id))""")
def tuned_storms(spark, d):
    storms = {STORM}
    got = dp.edited_events(spark, d, dp.seeded_plan(spark, d, storms), storms).filter(F.col("curve").isNotNull())
    weighed = F.transform("curve", lambda v, j: v * (j + 1))
    moment = F.aggregate(weighed, F.lit(0.0), lambda a, v: a + v)
    return got.select("clip_id", F.col("layer_pos").alias("layer"), "id", "frame", "frames", "origin", "edited", F.round("intensity", 6).alias("intensity"), F.round(moment, 6).alias("moment"))


@query("U3_layered_events", f"WITH RECURSIVE {SEEDED_SQL} SELECT clip_id, layer, effect, kind, id, frame, frames FROM sd")
def layered_events(spark, d):
    rows = dp.seeded_plan(spark, d).events
    return rows.select("clip_id", F.col("layer_pos").alias("layer"), "effect", "kind", "id", "frame", "frames")


assert set(FIELDS) <= set(dp.TYPES)

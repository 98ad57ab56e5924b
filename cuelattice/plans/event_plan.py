"""The event plan: seeded episodes for many clips, drawn over whole clips and then cut to a window."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cuelattice.functions.keyed import white
from cuelattice.functions.scalars import overlaps
from cuelattice.operators.schedules import SPINE_BLOCK, activation, hann_taps, smooth_track
from cuelattice.operators.series import episodes
from cuelattice.plans.inputs import seconds, table
from cuelattice.session import BLOCK_ROWS_KEY, materialize

KEYS = ["clip_id"]
HALF = 6
THRESHOLD = 0.3
FPS = 1.0 / 3600.0


def user_clips(spark: SparkSession, d: str) -> DataFrame:
    """One clip per user: a tape of one frame an hour, up to the hour of the user's last event."""
    last = F.floor(seconds("_last") / 3600).cast("long") + 1
    users = table(spark, d, "events").groupBy(F.col("user_id").alias("clip_id")).agg(F.max("ts").alias("_last"))
    users = users.select("clip_id", F.greatest(last, F.lit(1).cast("long")).alias("n_frames"))
    return users.withColumn("seed", F.col("clip_id") % 10 + 77).withColumn("fps", F.lit(FPS))


def activations(clips: DataFrame, key: str = "trgate") -> DataFrame:
    """Per-frame episode level. Everything is drawn and normalised over the whole clip, so a window
    filter belongs after this step and never before it."""
    gate = smooth_track(clips, KEYS, "n_frames", key, HALF, "track")
    flick = white(F.col("seed"), F.col("clip_id"), "trflick", F.col("idx"))
    return gate.withColumn("level", activation(F.lit(0.5) + F.col("track") * 0.5, THRESHOLD, flick))


def plan_episodes(clips: DataFrame, effect: str = "vhs") -> DataFrame:
    """Every episode of every clip with its stable id ``effect:kind:frame:n``."""
    acts = activations(clips).filter("level > 0")
    size = int(clips.sparkSession.conf.get(BLOCK_ROWS_KEY, str(SPINE_BLOCK)))
    acts = acts.withColumn("block", F.floor(F.col("idx") / F.lit(size)).cast("long")) if size != SPINE_BLOCK else acts
    # The active frames are few; written once, the run passes read them instead of drawing again.
    acts = materialize(acts.select(*KEYS, "block", "idx", "level"), "active")
    runs = episodes(acts, KEYS, F.col("level") > 0, F.col("level"))
    rows = runs.join(clips.select(*KEYS, "fps"), KEYS)
    return rows.select(
        *KEYS, F.lit(0).alias("layer"), F.lit(effect).alias("effect"), F.lit("tracking_storm").alias("kind"),
        F.concat(F.lit(f"{effect}:tracking_storm:"), F.col("run_start").cast("string"), F.lit(":0")).alias("id"),
        (F.col("run_start") / F.col("fps")).alias("t"), (F.col("length") / F.col("fps")).alias("dur"), F.col("peak"),
    )


def in_window(plan: DataFrame, w0: Column, w1: Column) -> DataFrame:
    return plan.filter(overlaps(F.col("t"), F.col("dur"), w0, w1))


def plan_rows(plan: DataFrame) -> DataFrame:
    """Plan rows as they are written: four decimals, in (t, layer, effect) order."""
    return plan.withColumns({"t": F.round("t", 4), "dur": F.round("dur", 4)}).orderBy("t", "layer", "effect", "clip_id")


PLAN_BUCKETS = 256


def write_plan(plan: DataFrame, path: str) -> None:
    """One folder per bucket of clips keeps readers of one clip away from most of the rest, however many clips there are."""
    rows = plan_rows(plan).withColumn("clip_bucket", F.pmod(F.xxhash64("clip_id"), F.lit(PLAN_BUCKETS)))
    rows.write.partitionBy("clip_bucket").parquet(path)


def planned_episodes(spark: SparkSession, d: str) -> DataFrame:
    plan = plan_episodes(user_clips(spark, d))
    cut = in_window(plan, F.lit(5 * 86400.0), F.lit(20 * 86400.0))
    return plan_rows(cut.withColumn("peak", F.round("peak", 6)))


def _u(*parts: str) -> str:
    text = " || ':' || ".join(parts)
    return f"(('0x' || substr(sha256({text}), 1, 13))::BIGINT::DOUBLE / 4503599627370496)"


# The clips in SQL; ``FRAMES`` lists a clip's frames as ``i.i``.
USERS = "u AS MATERIALIZED (SELECT user_id AS clip_id, greatest(max(epoch_us(ts) - 1704067200000000) // 3600000000 + 1, 1)::BIGINT AS n_frames FROM events GROUP BY 1)"
FRAMES = "u, unnest(range(0, n_frames)) i(i)"


def track_sql(key: str) -> str:
    """CTEs ``g``, ``f`` and ``tr``: the smooth track of every user clip."""
    args = ("(clip_id % 10 + 77)", "clip_id", f"'{key}'", "i.i")
    gauss = f"sqrt(-2.0 * ln(1.0 - {_u(*args, chr(39) + 'r' + chr(39))})) * cos({2 * math.pi!r} * {_u(*args, chr(39) + 'a' + chr(39))})"
    taps = hann_taps(HALF)
    fir = " + ".join(
        f"{'lag' if k <= 0 else 'lead'}(g, {abs(k)}) OVER w * {t!r}" for k, t in zip(range(-HALF, HALF + 1), taps)
    )
    return (
        f"{USERS}, g AS MATERIALIZED (SELECT clip_id, n_frames, i.i AS idx, {gauss} AS g FROM u, unnest(range({-HALF}, n_frames + {HALF})) i(i)), "
        f"f AS MATERIALIZED (SELECT * FROM (SELECT clip_id, n_frames, idx, {fir} AS f FROM g WINDOW w AS (PARTITION BY clip_id ORDER BY idx)) WHERE idx >= 0 AND idx < n_frames), "
        "tr AS MATERIALIZED (SELECT clip_id, idx, f / (p + 1e-9) AS track FROM f JOIN (SELECT clip_id, quantile_cont(abs(f), 0.95) AS p FROM f GROUP BY 1) USING (clip_id))"
    )


ACT_SQL = track_sql("trgate") + f""", ac AS MATERIALIZED (SELECT clip_id, idx, CASE WHEN lv > 0.02 THEN lv ELSE 0 END AS level FROM (SELECT clip_id, idx,
  pow(least(greatest((0.5 + track * 0.5 - {0.92 - THRESHOLD!r}) / 0.3, 0.0), 1.0), 1.3) * (0.55 + 0.45 * abs({_u('(clip_id % 10 + 77)', 'clip_id', chr(39) + 'trflick' + chr(39), 'idx')} * 2 - 1)) AS lv FROM tr))"""

PLAN_SQL = ACT_SQL + """, ru AS (SELECT clip_id, idx, level, idx - row_number() OVER (PARTITION BY clip_id ORDER BY idx) AS gr FROM ac WHERE level > 0),
 plan AS MATERIALIZED (SELECT clip_id, 0 AS layer, 'vhs' AS effect, 'tracking_storm' AS kind, 'vhs:tracking_storm:' || min(idx) || ':0' AS id,
 min(idx) * 3600.0 AS t, count(*) * 3600.0 AS dur, max(level) AS peak FROM ru GROUP BY clip_id, gr)"""

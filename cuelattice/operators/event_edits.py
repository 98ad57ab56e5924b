"""Edit lists on events with geometry and curves: what each kind of event lets an operation change.

Events are ``(keys..., effect, kind, id, frame, frames, fields...)``. All fields but two follow from the latest operation that names them,
so they are ``max_by`` aggregates. The length of a dropout is clamped by where it starts at that moment: its latest
operation is found first, then the latest start up to it. A storm's level is a curve over its frames: a tuned peak scales
it and a tuned duration samples it anew, and since both clip or resample what came before, its operations are folded in order, as
one array expression in the row of that one storm. Only storms whose curve is tuned are unfolded into curves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuelattice.functions import keyed
from cuelattice.functions.scalars import clip

STORM, DROPOUT, TEAR, GLITCH, CAPTION = "tracking_storm", "dropout", "skew_tear", "transport_glitch", "caption"
# The ranges an operation may set, by kind.
BAND_HEIGHT = {STORM: (0.02, 0.6), TEAR: (0.004, 0.3), GLITCH: (0.05, 0.8)}
STRENGTH = {TEAR: (0.05, 2.0), GLITCH: (0.05, 1.0)}
FIELDS = ["intensity", "x", "row", "length", "rows", "dark", "band_pos", "band_height", "text"]
LATEST = ["intensity", "frames", "x", "row", "rows", "dark", "band_pos", "band_height", "text"]


def has(key: str) -> Column:
    return F.map_contains_key("detail", F.lit(key))


def number(key: str) -> Column:
    return F.try_element_at("detail", F.lit(key)).try_cast("double")


def in_range(value: Column, ranges: dict[str, tuple[float, float]]) -> Column:
    """``value`` within the range of the row's kind; null where the kind has none."""
    out = F.lit(None).cast("double")
    for kind, (lo, hi) in ranges.items():
        out = F.when((F.col("kind") == kind) & value.isNotNull(), clip(value, lo, hi)).otherwise(out)
    return out


def frames_of(value: Column) -> Column:
    """Seconds to frames: glitches are cut, the others rounded; captions last one frame at least, the others two."""
    n = value * F.col("fps")
    return F.when(F.col("kind") == GLITCH, F.greatest(n.cast("long"), F.lit(2))).when(F.col("kind") == CAPTION, F.greatest(F.rint(n).cast("long"), F.lit(1))).otherwise(F.greatest(F.rint(n).cast("long"), F.lit(2)))


def whole(value: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(F.least(value.cast("long"), hi.cast("long")), lo.cast("long"))


def added_events(ops: DataFrame, keys: list[str]) -> DataFrame:
    """The events that ``add`` operations bring. What an operation leaves open is drawn from its own id, so it survives another seed.

    ``ops`` carries fps, n_frames, width and height of its layer.
    """
    adds = ops.filter("op = 'add'").withColumn("frame", F.rint(F.col("t") * F.col("fps")).cast("long")).filter("frame >= 0 AND frame < n_frames")
    adds = adds.withColumn("id", F.coalesce("id", F.concat(F.lit("edit:add:"), F.col("frame").cast("string"))))
    w, h = F.col("width"), F.col("height")
    draw = lambda what: keyed.uniform("edit", F.col("id"), what)
    drop, seconds = F.col("kind") == DROPOUT, {STORM: 0.6, GLITCH: 0.5, CAPTION: 2.5}
    default_s = F.lit(None).cast("double")
    for kind, s in seconds.items():
        default_s = F.when(F.col("kind") == kind, F.coalesce(number("dur_s"), F.lit(s))).otherwise(default_s)
    lasting = F.when(drop, F.lit(1).cast("long")).when(F.col("kind") == TEAR, F.lit(2).cast("long")).otherwise(frames_of(default_s))
    strength = F.when(F.col("kind") == STORM, clip(F.coalesce(number("intensity"), F.lit(0.8)), 0.05, 1.0)).otherwise(in_range(F.coalesce(number("intensity"), F.lit(1.0)), STRENGTH))
    length = whole(F.coalesce(number("length_px"), F.lit(20) + F.pow(draw("l"), F.lit(2)) * 280 * w / 720), F.lit(6), w - 2)
    adds = adds.withColumn("length", F.when(drop, F.greatest(length, F.lit(6))))
    x = F.coalesce(number("x"), F.floor(draw("x") * F.greatest(w - F.col("length"), F.lit(1))))
    row = F.coalesce(number("row"), F.floor(draw("r") * h))
    return adds.select(
        *keys, "effect", "kind", "id", "frame", lasting.alias("frames"), F.lit("added").alias("origin"), F.col("op_pos").alias("born"), "fps", "n_frames", "width", "height",
        strength.alias("intensity"), F.when(drop, whole(x, F.lit(0), w - F.col("length"))).alias("x"), F.when(drop, whole(row, F.lit(0), h - 1)).alias("row"), "length",
        F.when(drop, F.coalesce(number("rows").cast("long"), F.lit(1))).alias("rows"),
        F.when(drop, F.coalesce(F.try_element_at("detail", F.lit("polarity")) == "dark", F.lit(False))).alias("dark"),
        F.when(F.col("kind").isin(*BAND_HEIGHT), clip(number("band_pos"), 0.0, 1.0)).alias("band_pos"), in_range(number("band_height"), BAND_HEIGHT).alias("band_height"),
        F.when(F.col("kind") == CAPTION, F.coalesce(F.try_element_at("detail", F.lit("text")), F.lit(""))).alias("text"),
    )


def added_curve() -> Column:
    """The curve of an added storm: a bell up to its peak, shaded by draws from its id."""
    n = F.col("frames")
    u = lambda j: F.lit(-1.0) + j * (F.lit(2.0) / (n - 1))
    bell = lambda j: (F.lit(0.5) + F.cos(u(j) * F.lit(3.141592653589793)) * 0.5) * F.col("intensity")
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda j: bell(j) * (F.lit(0.55) + keyed.uniform("edit", F.col("id"), "seg", j) * 0.45))


def folded_curve(curve: Column, steps: Column) -> Column:
    """``curve`` after ``steps``, an ordered array of (peak, frames) with one of them set: scale to a peak and clip to 1, or sample at another length."""

    def scaled(seg: Column, peak: Column) -> Column:
        top = F.array_max(seg)
        return F.transform(seg, lambda v: clip(v * (peak / F.when(top > 0, top).otherwise(1.0)), 0.0, 1.0))

    def stretched(seg: Column, n: Column) -> Column:
        last = F.size(seg) - 1

        def at(j: Column) -> Column:
            x = j * (last.cast("double") / (n - 1))
            lo = F.least(F.floor(x), last - 1).cast("int")
            return F.when(last < 1, seg[0]).otherwise(F.get(seg, lo) + (x - lo) * (F.get(seg, lo + 1) - F.get(seg, lo)))

        return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), at)

    return F.aggregate(steps, curve, lambda seg, s: F.when(s["peak"].isNotNull(), scaled(seg, s["peak"])).otherwise(stretched(seg, s["frames"])))


def apply_edits(base: DataFrame, ops: DataFrame, curves, keys: list[str]) -> DataFrame:
    """``base`` and added events with ``ops`` applied in order: frame, frames, the fields, ``origin``, ``edited`` and, for storms that are added or whose curve is tuned, ``curve``.

    ``base`` and ``ops`` carry fps, n_frames, width and height. ``curves(storms)`` gives (keys..., id, curve) of seeded storms; it is asked for the tuned ones alone.
    Operations name effect and kind; one whose event does not exist is skipped.
    """
    ident = [*keys, "effect", "kind", "id"]
    seeded = base.withColumn("origin", F.lit("seeded")).withColumn("born", F.lit(-1).cast("long"))
    alive = seeded.unionByName(added_events(ops, keys), allowMissingColumns=True)
    frame = F.rint(F.col("t") * F.col("fps")).cast("long")
    tune, moved = F.col("op") == "tune", (F.col("op") == "move") & F.col("t").isNotNull()
    inside = (frame >= 0) & (frame < F.col("n_frames"))
    at = lambda when, v: F.when(when, F.struct("op_pos", v.alias("v")))
    drop, storm = F.col("kind") == DROPOUT, F.col("kind") == STORM
    hits = ops.filter("op <> 'add'").select(
        *ident, "op_pos", ((F.col("op") == "remove") | (moved & ~inside)).alias("kills"), F.when(moved, F.struct("op_pos", frame.alias("v"))).alias("to"),
        at(tune & has("intensity") & F.col("kind").isin(*STRENGTH), in_range(number("intensity"), STRENGTH)).alias("t_intensity"),
        at(tune & has("dur_s") & F.col("kind").isin(GLITCH, CAPTION), frames_of(number("dur_s"))).alias("t_frames"),
        at(tune & drop & has("x"), whole(number("x"), F.lit(0), F.col("width") - 2)).alias("t_x"),
        at(tune & drop & has("row"), whole(number("row"), F.lit(0), F.col("height") - 1)).alias("t_row"),
        at(tune & drop & has("length_px"), number("length_px").cast("long")).alias("t_length"),
        at(tune & drop & has("rows"), F.when(number("rows").cast("long") <= 1, F.lit(1)).otherwise(2).cast("long")).alias("t_rows"),
        at(tune & drop & has("polarity"), F.coalesce(F.try_element_at("detail", F.lit("polarity")) == "dark", F.lit(False))).alias("t_dark"),
        at(tune & has("band_pos") & F.col("kind").isin(*BAND_HEIGHT), clip(number("band_pos"), 0.0, 1.0)).alias("t_band_pos"),
        at(tune & has("band_height") & F.col("kind").isin(*BAND_HEIGHT), in_range(number("band_height"), BAND_HEIGHT)).alias("t_band_height"),
        at(tune & has("text") & (F.col("kind") == CAPTION), F.coalesce(F.try_element_at("detail", F.lit("text")), F.lit(""))).alias("t_text"),
        F.when(tune & storm & number("intensity").isNotNull(), number("intensity")).alias("peak"),
        F.when(tune & storm & number("dur_s").isNotNull(), frames_of(number("dur_s"))).alias("stretch"),
    )
    hits = hits.join(alive.select(*ident, "born"), ident).filter(F.col("op_pos") > F.col("born"))
    steps = F.array(F.struct("op_pos", F.lit(0).alias("k"), F.col("peak"), F.lit(None).cast("long").alias("frames")), F.struct("op_pos", F.lit(1).alias("k"), F.lit(None).cast("double").alias("peak"), F.col("stretch").alias("frames")))
    steps = F.filter(steps, lambda s: s["peak"].isNotNull() | s["frames"].isNotNull())
    folded = hits.withColumn("steps", F.when(F.col("peak").isNotNull() | F.col("stretch").isNotNull(), steps)).groupBy(*ident, "born").agg(
        F.max("kills").alias("dead"), F.max("to").alias("to"), *[F.max(f"t_{f}").alias(f"t_{f}") for f in [*LATEST, "length"]],
        # An edit list's operations on one storm's curve.
        F.array_sort(F.flatten(F.collect_list("steps"))).alias("steps"), F.count(F.lit(1)).alias("ops"),
    )
    # Where a dropout started when its length was last set.
    where = hits.filter("t_x IS NOT NULL").join(folded.filter("t_length IS NOT NULL").select(*ident, "born", F.col("t_length.op_pos").alias("upto")), [*ident, "born"])
    where = where.filter(F.col("op_pos") <= F.col("upto")).groupBy(*ident, "born").agg(F.max("t_x").alias("x_then"))
    out = alive.join(folded, [*ident, "born"], "left").join(where, [*ident, "born"], "left").filter(~F.coalesce("dead", F.lit(False)))
    latest = lambda f: F.when(F.col(f"t_{f}").isNotNull(), F.col(f"t_{f}.v")).otherwise(F.col(f)).alias(f)
    room = F.col("width") - F.coalesce("x_then.v", "x")
    length = F.when(F.col("t_length").isNotNull(), F.greatest(F.least("t_length.v", room), F.lit(6))).otherwise(F.col("length")).alias("length")
    out = out.select(
        *ident, F.coalesce("to.v", "frame").alias("frame"), *[latest(f) for f in LATEST], length, "origin", F.col("ops").isNotNull().alias("edited"), "fps", "n_frames",
        F.when(storm & ((F.size("steps") > 0) | (F.col("origin") == "added")), F.coalesce("steps", F.array().cast(folded.schema["steps"].dataType))).alias("steps"),
    )
    # An added storm's peak is that of its drawn curve.
    tuned = out.filter("steps IS NOT NULL")
    own = tuned.filter("origin = 'added'").select(*keys, "id", added_curve().alias("curve"))
    shape = curves(tuned.filter("origin = 'seeded'")).unionByName(own)
    done = tuned.join(shape, [*keys, "id"]).withColumn("curve", folded_curve(F.col("curve"), F.col("steps")))
    done = done.withColumn("frames", F.size("curve").cast("long")).withColumn("intensity", F.array_max("curve"))
    return out.filter("steps IS NULL").withColumn("curve", F.lit(None).cast("array<double>")).unionByName(done.select(*out.columns, "curve")).drop("steps")

"""The damage plan of layered jobs: every schedule of every layer, edited, cut to a window, with a header per job.

Layer specs become layer rows, presets and overrides give their dials, and the dials say which schedules run (``SCHEDULES``). All schedules read
one spine of (clip, layer, frame) rows that carries the draws their layers need and is written once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cuelattice.functions import keyed
from cuelattice.functions.scalars import overlaps
from cuelattice.operators import catalog as ca, kernels as kn, schedules as sd
from cuelattice.operators.event_edits import CAPTION, DROPOUT, FIELDS, GLITCH, STORM, TEAR, apply_edits
from cuelattice.operators.series import episodes, exact_percentiles
from cuelattice.plans.event_plan import user_clips
from cuelattice.plans.inputs import seconds, table
from cuelattice.session import BLOCK_ROWS_KEY, materialize, spread
from cuelattice.sources.layers import read_layers

K = ["clip_id", "layer_pos"]
HALF, OCTAVES, ALPHA = 6, 6, 1.2
MIN_GAP = 4.0
HEIGHT = 480
CHAINS = {"tape": ["vhs", "captions"], "deck": ["vhs", "transport"]}
DIALS = {("vhs", "tracking_error"): 0.3, ("vhs", "dropouts"): 0.03, ("vhs", "dropout_burst"): 0.8, ("vhs", "skew_tear"): 0.3, ("transport", "random_glitch_rate"): 0.02}
AUTHORED = [("tape", "vhs", "dropouts", "0.04"), ("deck", "vhs", "tracking_error", "0.25"), ("deck", "vhs", "dropouts", "0"), ("deck", "transport", "random_glitch_rate", "0.03")]
VARIANTS = [("worn", "vhs", "dropouts", "0.08"), ("worn", "vhs", "skew_tear", "0.5")]


def layer_specs(spark: SparkSession, d: str) -> DataFrame:
    """The clips with a layer spec each: a tape, and for odd clips a deck on top of it."""
    c = F.col("clip_id")
    own = F.when(c % 4 != 0, F.create_map(F.lit("vhs.tracking_error"), (F.lit(0.2) + c % 5 * 0.05).cast("string")))
    tape = F.struct(F.lit("tape").alias("preset"), F.when(c % 3 == 0, "worn").otherwise("").alias("variant"), F.lit(True).alias("enabled"), own.alias("sets"), (c % 10 + 77).alias("seed"), F.lit(1.0).alias("intensity"))
    none = F.lit(None).cast("map<string,string>")
    deck = F.struct(F.lit("deck").alias("preset"), F.lit("").alias("variant"), (c % 2 == 1).alias("enabled"), none.alias("sets"), (c % 7 + 101).alias("seed"), (F.lit(0.5) + c % 3 * 0.25).alias("intensity"))
    # Written, so that filters on a spec meet it once per clip: before, they moved below the clip's aggregate and read the spec of every event.
    return materialize(user_clips(spark, d).drop("seed"), "clips").withColumn("spec", F.to_json(F.array(tape, deck)))


def dialled_layers(spark: SparkSession, d: str) -> DataFrame:
    """One row per layer: seed, size, frames, and the resolved number of every dial (null where its chain lacks the effect)."""
    clips = layer_specs(spark, d)
    layers = materialize(read_layers(clips.select("clip_id", "spec"), "clip_id", "spec")[0], "specs")  # read five times
    chain = spark.createDataFrame([(p, e) for p, es in CHAINS.items() for e in es], "preset_id string, effect_key string")
    steps = layers.join(chain, "preset_id").withColumn("effect_id", F.col("effect_key"))
    params = spark.createDataFrame(
        [(e, p, "float", str(v), 0.0, 1.0, [], p != "dropout_burst") for (e, p), v in DIALS.items()],
        "effect_id string, param string, kind string, default_value string, lo double, hi double, choices array<string>, iscale boolean",
    )
    keys = [*K, "effect_key"]
    authored = layers.join(spark.createDataFrame(AUTHORED, "preset_id string, effect_key string, param string, value string"), "preset_id")
    variant = layers.join(spark.createDataFrame(VARIANTS, "variant_id string, effect_key string, param string, value string"), "variant_id")
    sets = layers.select(*K, F.explode("sets").alias("path", "value")).select(*K, F.substring_index("path", ".", 1).alias("effect_key"), F.substring_index("path", ".", -1).alias("param"), "value")
    got = ca.resolve(steps, params, [authored, variant, sets], keys, intensity=F.col("intensity"))
    dials = got.groupBy(*K).agg(*[F.max(F.when((F.col("effect_key") == e) & (F.col("param") == p), F.col("num"))).alias(p) for e, p in DIALS])
    chained = steps.groupBy(*K).agg(F.array_sort(F.collect_set("effect_key")).alias("effects"))
    rows = layers.select(*K, "seed").join(chained, K).join(dials, K).join(clips.select("clip_id", "n_frames", "fps"), "clip_id")
    return materialize(rows.withColumn("width", F.when(F.col("clip_id") % 2 == 1, 768).otherwise(640)).withColumn("height", F.lit(HEIGHT)), "layers")


PREFIXED = ["trgate", "doburst/0", "skewev", "glitch"]


def _first_held(octave: int) -> int:
    """Where the draws of an octave begin in a span's array of held draws: octaves from 1 on, each with the draws of one span."""
    return sum(SPAN >> o for o in range(1, octave))


def spans(layers: DataFrame, halo: int, bursts: Column | None) -> DataFrame:
    """The spine, made over spans of ``SPAN`` frames: ``_at`` is a frame's place in its span, ``_held`` the span's draws of the octaves that hold
    theirs (where ``bursts``), each made once and not once per frame."""
    blocks = sd.spine_blocks(layers, K, "n_frames", halo)
    first = F.floor(F.col("_lo") / SPAN).cast("long")
    rows = blocks.withColumn("_span", F.explode(F.sequence(first, F.floor(F.col("_hi") / SPAN).cast("long"))))
    whose = [F.col("seed"), *[F.col(k) for k in K]]
    rows = rows.withColumns({f"_{n}": F.concat(keyed.joined(*whose, n), F.lit(":")) for n in PREFIXED})
    if bursts is not None:
        draws = []
        for o in range(1, OCTAVES):
            rows = rows.withColumn(f"_o{o}", F.concat(keyed.joined(*whose, f"doburst/{o}"), F.lit(":")))
            n = SPAN >> o
            draws += [keyed.drawn(F.concat(f"_o{o}", (F.col("_span") * n + j).cast("string"))) for j in range(n)]
        rows = rows.withColumn("_held", F.when(bursts, F.array(*draws))).drop(*[f"_o{o}" for o in range(1, OCTAVES)])
    frames = F.sequence(F.greatest("_lo", F.col("_span") * SPAN), F.least("_hi", F.col("_span") * SPAN + (SPAN - 1)))
    # Dealt again by block, so that windows over a block's frames need no shuffle of the frames.
    rows = spread(materialize(rows, "spans"), *K, "block").withColumn("idx", F.explode(frames))
    return rows.withColumn("_at", F.col("idx") - F.col("_span") * SPAN).drop("_lo", "_hi", "_span")


def draw(*what) -> Column:
    return keyed.uniform(F.col("seed"), F.col("clip_id"), F.col("layer_pos"), *what)


TRACKS = {STORM: "gate", DROPOUT: "burst", TEAR: "tears", GLITCH: "glitches"}  # what a kind's schedule reads of the spine
SPAN = 2 ** (OCTAVES - 1)  # frames that share the draw of the slowest octave


def spine_of(layers: DataFrame, kinds: set[str] | None = None) -> DataFrame:
    """(clip, layer, frame) rows with a storm gate, a burst track and hit marks (or those that some ``kinds`` read), each where the layer's
    dial asks for it. Both tracks are normalised over the whole clip."""
    wanted = {t for k, t in TRACKS.items() if kinds is None or k in kinds}
    wants = lambda dial: F.coalesce(F.col(dial), F.lit(0.0)) > 0
    halo = HALF if "gate" in wanted else 0
    grid = spans(layers, halo, wants("dropouts") if "burst" in wanted else None)
    # First parts of the texts that a frame's draws hash are joined once per span.
    with_prefix = lambda name, *last: keyed.drawn(F.concat(f"_{name}", F.col("idx").cast("string"), *map(F.lit, last)))
    if "gate" in wanted:
        grid = grid.withColumn("_g", F.when(wants("tracking_error"), keyed.polar(with_prefix("trgate", ":r"), with_prefix("trgate", ":a"))))
        w = Window.partitionBy(*K, "block").orderBy("idx")
        fir = sum((F.lag("_g", -k).over(w) * F.lit(t) for k, t in zip(range(-HALF, HALF + 1), sd.hann_taps(HALF))), F.lit(0.0))
        grid = grid.withColumn("_gate", fir).filter((F.col("idx") >= F.col("block") * sd.SPINE_BLOCK) & (F.col("idx") < F.least((F.col("block") + 1) * sd.SPINE_BLOCK, F.col("n_frames"))))
    if "burst" in wanted:
        burst = F.lit(0.0)
        for o in range(OCTAVES):
            u = with_prefix("doburst/0") if o == 0 else F.get("_held", F.floor(F.col("_at") / F.lit(2**o)).cast("int") + _first_held(o))
            burst = burst + (u * 2.0 - 1.0) * F.lit(2.0 ** (o * (ALPHA - 1.0) / 2.0))
        grid = grid.withColumn("_burst", F.when(wants("dropouts"), burst))
    if "tears" in wanted:
        grid = grid.withColumn("tears", wants("skew_tear") & (with_prefix("skewev") < F.lit(0.02) + F.col("skew_tear") * 0.1))
    if "glitches" in wanted:
        grid = grid.withColumn("glitches", wants("random_glitch_rate") & (with_prefix("glitch") < F.col("random_glitch_rate")))
    grid = materialize(grid.drop("_g", "_at", "_held", *[f"_{n}" for n in PREFIXED]), "spine")
    # The layers' scales meet in one small written table, so that the frames are joined once and the planner knows the other side's size.
    tracks = [t for t in ("gate", "burst") if t in wanted]
    scales = layers.select(*K)
    for t in tracks:
        scales = scales.join(exact_percentiles(grid.withColumn("_a", F.abs(F.col(f"_{t}"))), K, "_a", {f"_p_{t}": 0.95}), K, "left")
    if tracks:
        grid = grid.join(materialize(scales, "scales"), K, "left")
    return grid.withColumns({t: F.col(f"_{t}") / (F.col(f"_p_{t}") + 1e-9) for t in tracks}).drop(*[f"_{t}" for t in tracks], *[f"_p_{t}" for t in tracks])


def storm_levels(grid: DataFrame) -> DataFrame:
    flick = draw("trflick", F.col("idx")) * 2.0 - 1.0
    level = sd.activation(F.lit(0.5) + F.col("gate") * 0.5, F.col("tracking_error"), flick)
    acts = grid.filter("gate IS NOT NULL").withColumn("level", level).filter("level > 0")
    size = int(grid.sparkSession.conf.get(BLOCK_ROWS_KEY, str(sd.SPINE_BLOCK)))
    acts = acts.withColumn("block", F.floor(F.col("idx") / F.lit(size)).cast("long")) if size != sd.SPINE_BLOCK else acts
    return materialize(acts.select(*K, "block", "idx", "level"), "levels")


def storms(grid: DataFrame, levels: DataFrame) -> DataFrame:
    runs = episodes(levels, K, F.col("level") > 0, F.col("level"))
    return runs.select(*K, F.col("run_start").alias("frame"), F.lit(0).alias("i"), F.col("length").alias("frames"), F.col("peak").alias("intensity"))


def dropouts(grid: DataFrame, levels: DataFrame) -> DataFrame:
    """Dropouts of every frame. Start follows length, for it must fit the row."""
    hits = sd.bursty_counts(grid.filter("burst IS NOT NULL"), K, "dropouts", F.col("dropouts"), F.lit(1.0), F.col("dropout_burst"), F.col("burst"))
    g = lambda what: draw("dropout", F.col("idx"), F.col("i"), what)
    w = F.col("width")
    length = F.greatest(F.least(((F.lit(20.0) + F.pow(g("l"), F.lit(2)) * 280.0) * (w / 720.0)).cast("long"), w - 2), F.lit(6)).cast("long")
    hits = hits.withColumn("length", length)
    return hits.select(
        *K, F.col("idx").alias("frame"), "i", F.lit(1).cast("long").alias("frames"), F.floor(g("x") * (w - F.col("length"))).alias("x"), F.floor(g("r") * F.col("height")).alias("row"), "length",
        (g("d") < 0.12).alias("dark"), F.when(g("n") < 0.65, 1).otherwise(2).cast("long").alias("rows"),
    )


def thinned(grid: DataFrame, mark: str) -> DataFrame:
    """Marked frames, none less than the gap after the one before."""
    return kn.fold_blocks(grid.filter(mark).select(*K, "block", "idx", "seed"), K, [], kn.min_gap(MIN_GAP, False, "idx"), "kept").filter("kept = 1")


def tears(grid: DataFrame, levels: DataFrame) -> DataFrame:
    return thinned(grid, "tears").select(*K, F.col("idx").alias("frame"), F.lit(0).alias("i"), F.lit(2).cast("long").alias("frames"), F.lit(1.0).alias("intensity"))


def glitches(grid: DataFrame, levels: DataFrame) -> DataFrame:
    lasting = F.floor(draw("glitchdur", F.col("idx")) * 5) + 2
    return thinned(grid, "glitches").select(*K, F.col("idx").alias("frame"), F.lit(0).alias("i"), lasting.alias("frames"), F.lit(1.0).alias("intensity"))


@dataclass(frozen=True)
class Schedule:
    dial: str
    rows: Callable[[DataFrame, DataFrame], DataFrame]


SCHEDULES = {
    ("vhs", STORM): Schedule("tracking_error", storms), ("vhs", DROPOUT): Schedule("dropouts", dropouts), ("vhs", TEAR): Schedule("skew_tear", tears),
    ("transport", GLITCH): Schedule("random_glitch_rate", glitches),
}
TYPES = {"intensity": "double", "x": "long", "row": "long", "length": "long", "rows": "long", "dark": "boolean", "band_pos": "double", "band_height": "double", "text": "string"}


def seeded_events(layers: DataFrame, grid: DataFrame, levels: DataFrame, kinds: set[str] | None = None) -> DataFrame:
    """All schedules' events (or those of some ``kinds``) with their stable ids ``effect:kind:frame:n``; each schedule sees the layers whose dial is above zero."""
    out = None
    for (effect, kind), s in SCHEDULES.items():
        if kinds is not None and kind not in kinds:
            continue
        rows = s.rows(grid.filter(F.col(s.dial) > 0), levels)
        event_id = F.concat_ws(":", F.lit(effect), F.lit(kind), F.col("frame").cast("string"), F.col("i").cast("string"))
        fields = [F.col(f).cast(t).alias(f) if f in rows.columns else F.lit(None).cast(t).alias(f) for f, t in TYPES.items()]
        rows = rows.select(*K, F.lit(effect).alias("effect"), F.lit(kind).alias("kind"), event_id.alias("id"), "frame", "frames", *fields)
        out = rows if out is None else out.unionByName(rows)
    return out.join(layers.select(*K, "fps", "n_frames", "width", "height"), K)


def edit_ops(spark: SparkSession, d: str, layers: DataFrame) -> DataFrame:
    """Events as operations on what their user's clip plans at that hour, some of them twice, and conversations as caption cues."""
    e = table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("clip_id"), (F.col("event_id") % 2).cast("int").alias("layer_pos"), F.floor(seconds() / 3600).cast("long").alias("f"), "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"), (F.floor(F.col("event_id") / 2) % 4).cast("int").alias("which"),
    )
    kinds = list(SCHEDULES)
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in kinds]), F.col("which") + 1)
    e = e.withColumn("effect", pick(0)).withColumn("kind", pick(1))
    op = F.when(F.col("event_type") == "purchase", "add").when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "signup", "move").otherwise("tune")
    k = F.col("k")
    entry = lambda name, v, when=F.lit(True): F.when(when, F.struct(F.lit(name).alias("key"), v.cast("string").alias("value")))
    pack = lambda *es: F.map_from_entries(F.filter(F.array(F.lit(None).cast("struct<key: string, value: string>"), *es), lambda x: x.isNotNull()))
    first = pack(
        entry("intensity", F.lit(0.2) + k % 10 * 0.12, k % 4 != 3), entry("dur_s", (k % 9 + 1) * 3600.0, k % 3 == 0), entry("band_pos", F.when(k % 5 == 1, 0.5), k % 5 < 2),
        entry("band_height", k % 7 * 0.2, k % 7 > 3), entry("x", k * 40, k % 2 == 0), entry("length_px", k * 20, k % 3 == 0), entry("row", k * 9, k % 5 == 2),
        entry("rows", k % 4, k % 4 > 0), entry("polarity", F.when(k % 2 == 0, "dark").otherwise("bright"), k % 6 == 0),
    )
    second = pack(entry("intensity", F.lit(0.3) + k % 6 * 0.1, k % 2 == 0), entry("dur_s", (k % 6 + 2) * 3600.0, k % 2 == 1), entry("x", k * 31), entry("length_px", k * 11, k % 4 == 1))
    own = F.when(op == "add", F.concat(F.lit("edit:"), F.col("event_id"))).otherwise(F.concat_ws(":", F.col("effect"), F.col("kind"), F.col("f").cast("string"), F.lit("0")))
    t = F.when(op == "move", (F.col("f") + k % 30 - 5) * 3600.0).when(op == "add", F.col("f") * 3600.0)
    cols = lambda pos, name, ident, when, detail: [*K, pos.cast("long").alias("op_pos"), name.alias("op"), "effect", "kind", ident.alias("id"), when.cast("double").alias("t"), detail.alias("detail")]
    ops = e.select(*cols(F.col("event_id") * 2, op, own, t, first))
    ops = ops.unionByName(e.filter(F.col("event_id") % 3 == 0).select(*cols(F.col("event_id") * 2 + 1, F.lit("tune"), own, F.lit(None), second)))
    c = table(spark, d, "conversations").select(
        F.col("conv_id").alias("clip_id"), F.lit(0).alias("layer_pos"), "turn", "text", F.length("text").alias("n"), F.concat_ws(":", F.lit("cue"), "conv_id", "turn").alias("own"),
        F.lit("captions").alias("effect"), F.lit(CAPTION).alias("kind"), (F.lit(1 << 40) + F.col("turn") * 4).alias("p"),
    )
    at = (F.col("turn") * 50 + F.col("n") % 11) * 3600.0
    cues = c.select(*cols(F.col("p"), F.lit("add"), F.col("own"), at, pack(entry("text", F.col("text")), entry("dur_s", (F.col("n") % 5 + 0.4) * 3600.0, F.col("n") % 2 == 0))))
    cues = cues.unionByName(c.filter("n % 4 = 1").select(*cols(F.col("p") + 1, F.lit("move"), F.col("own"), at + 7200.0, pack())))
    cues = cues.unionByName(c.filter("n % 3 = 1").select(*cols(F.col("p") + 2, F.lit("tune"), F.col("own"), F.lit(None), pack(entry("text", F.concat(F.lit("~"), F.col("text"))), entry("dur_s", F.lit(10800.0))))))
    cues = cues.unionByName(c.filter("n % 7 = 0").select(*cols(F.col("p") + 3, F.lit("remove"), F.col("own"), F.lit(None), pack())))
    # A layer takes operations on the effects of its chain only.
    ops = ops.unionByName(cues).join(layers.select(*K, "effects", "fps", "n_frames", "width", "height"), K)
    return ops.filter(F.array_contains("effects", F.col("effect"))).drop("effects")


@dataclass(frozen=True)
class Seeded:
    layers: DataFrame
    levels: DataFrame
    events: DataFrame


def seeded_plan(spark: SparkSession, d: str, kinds: set[str] | None = None) -> Seeded:
    """The layers, their storm levels, and what their schedules plan before any edit."""
    layers = dialled_layers(spark, d)
    # Edits ask for the curves of storms: levels are made whatever kinds are planned.
    grid = spine_of(layers, None if kinds is None else kinds | {STORM})
    levels = storm_levels(grid)
    return Seeded(layers, levels, materialize(seeded_events(layers, grid, levels, kinds), "seeded"))


def edited_events(spark: SparkSession, d: str, p: Seeded, kinds: set[str] | None = None) -> DataFrame:
    """The plan after the layers' edits, of all ``kinds`` or some."""

    def curves(asked: DataFrame) -> DataFrame:
        start = F.element_at(F.split("id", ":"), 3).cast("long")
        cells = asked.select(*K, "id", "frames", start.alias("_start")).withColumn("idx", F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col("frames") - 1)))
        met = cells.join(p.levels.select(*K, "idx", "level"), [*K, "idx"])
        ordered = F.array_sort(F.collect_list(F.struct("idx", "level")))
        return met.groupBy(*K, "id").agg(F.transform(ordered, lambda s: s["level"]).alias("curve"))

    ops = edit_ops(spark, d, p.layers)
    ops = ops if kinds is None else ops.filter(F.col("kind").isin(*kinds))
    return apply_edits(p.events, materialize(ops, "edit-ops"), curves, K)


def plan_table(layers: DataFrame, events: DataFrame, w0: float, w1: float) -> DataFrame:
    """The rows of the plan inside a window, in (t, layer, effect) order, and a header row per job: frames of its clip, start and length of the window."""
    t, dur = F.col("frame") / F.col("fps"), F.col("frames") / F.col("fps")
    rows = events.withColumn("t", F.round(t, 4)).withColumn("dur", F.round(dur, 4)).filter(overlaps(t, dur, F.lit(w0), F.lit(w1)))
    cols = ["clip_id", F.col("layer_pos").alias("layer"), "effect", "kind", "id", "t", "dur", "frames", "origin", "edited", *FIELDS]
    head = layers.groupBy("clip_id").agg(F.max("n_frames").alias("frames"), F.count(F.lit(1)).alias("rows")).select(
        "clip_id", F.lit(-1).alias("layer"), F.lit("").alias("effect"), F.lit("header").alias("kind"), F.lit("").alias("id"), F.lit(w0).alias("t"), F.lit(w1 - w0).alias("dur"), "frames", "rows",
    )
    return rows.select(*cols).unionByName(head, allowMissingColumns=True).orderBy("t", "layer", "effect", "clip_id", "id")

"""Catalog work: chain keys, layered override resolution, dials, facets, validation and audits.

Tables (see ``cuelattice.schemas``): a *step* is ``(job, which, pos, effect_id, effect_key)``, an
*override* is ``(job, effect_key, param, value)`` with the value as text. A present override with a
null value is still present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cuelattice.functions.scalars import clip
from cuelattice.operators.series import index_rows, running_sum, with_block
from cuelattice.session import materialize, spread

TRUE_WORDS = ("1", "true", "yes", "on")


# ── typing and coercion ─────────────────────────────────────────────────

def value_kind(raw: Column) -> Column:
    """What a typed-in value is: bool, int, float or str."""
    low = F.lower(raw)
    return (
        F.when(low.isin("true", "on", "yes", "false", "off", "no"), "bool")
        .when(raw.rlike(r"^\s*[+-]?\d+\s*$") & raw.try_cast("long").isNotNull(), "int")
        .when(raw.try_cast("double").isNotNull(), "float")
        .otherwise("str")
    )


def split_override(text: Column) -> dict[str, Column]:
    """``effect.param=value`` into parts; ``error`` names what is missing."""
    eq = F.instr(text, "=")
    path = F.trim(F.substring_index(text, "=", 1))
    dot = F.instr(path, ".")
    return {
        "effect_key": F.when((eq > 0) & (dot > 0), F.substring_index(path, ".", 1)),
        "param": F.when((eq > 0) & (dot > 0), path.substr(dot + 1, F.length(path))),
        "value": F.when((eq > 0) & (dot > 0), F.trim(text.substr(eq + 1, F.length(text)))),
        "error": F.when(eq == 0, "no value").when(dot == 0, "no parameter"),
    }


def route(effect_key: Column) -> Column:
    return F.when(effect_key.startswith("a_"), "audio").otherwise("video")


def coerce_number(kind: Column, value: Column, lo: Column, hi: Column) -> Column:
    """Numbers clipped to their range; ints rounded half to even first; null for other kinds."""
    v = value.try_cast("double")
    return F.when(kind == "int", clip(F.rint(v), lo, hi)).when(kind == "float", clip(v, lo, hi))


def coerce_text(kind: Column, value: Column, choices: Column) -> Column:
    """Bools as true/false, enums only when allowed (else null: see ``enum_error``), text as it is."""
    return (
        F.when(kind == "bool", F.lower(value).isin(*TRUE_WORDS).cast("string"))
        .when((kind == "enum") & F.array_contains(choices, value), value)
        .when(kind == "str", value)
    )


def enum_error(kind: Column, value: Column, choices: Column) -> Column:
    return F.coalesce((kind == "enum") & ~F.array_contains(choices, value), F.lit(False))


# ── chains ──────────────────────────────────────────────────────────────

# Most steps of a chain that one task may order; longer chains take a range sort.
CHAIN_ROWS = 1 << 20


def chains_fit(steps: DataFrame, job: list[str]) -> bool:
    """Whether no chain is too long for one task. Counts are of hash values of the job, so they are at least a chain's own, and few."""
    counts = steps.groupBy(F.pmod(F.xxhash64(*job), F.lit(1 << 16)).alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") > CHAIN_ROWS).isEmpty()


def chain_keys(steps: DataFrame, job: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """Positions in the chain and keys: the nth repeat of an effect is ``effect#n``. Steps without a job or an effect have none.

    With ``parts`` a job's steps meet in one of so many tasks, in a single shuffle (see ``chains_fit``).
    """
    if parts is None:
        placed = index_rows(steps, job, order, "pos")
        nth = index_rows(placed, [*job, "which", "effect_id"], ["pos"], "_nth")
    else:
        at = lambda keys, by: (F.row_number().over(Window.partitionBy(*keys).orderBy(*by)) - 1).cast("long")
        dealt = steps.dropna(subset=job).repartition(parts, *job).withColumn("pos", at(job, order)).dropna(subset=["which", "effect_id"])
        nth = dealt.withColumn("_nth", at([*job, "which", "effect_id"], ["pos"]))
    key = F.when(F.col("_nth") == 0, F.col("effect_id")).otherwise(
        F.concat_ws("#", "effect_id", (F.col("_nth") + 1).cast("string"))
    )
    return nth.withColumn("effect_key", key).drop("_nth")


def segment_chain(steps: DataFrame, job: list[str], barrier: Column) -> DataFrame:
    """Segment numbers: each barrier step stands alone and splits the run of ordinary steps."""
    df = with_block(steps.withColumnRenamed("pos", "idx")).withColumn("_bar", barrier)
    df = running_sum(df, job, F.col("_bar").cast("int"), "_n")
    seg = F.col("_n") * 2 - F.when(F.col("_bar"), 1).otherwise(0)
    return df.withColumn("segment", seg).withColumnRenamed("idx", "pos").drop("block", "_n", "_bar")


def declared_for(steps: DataFrame, params: DataFrame) -> DataFrame:
    """Every declared parameter of every chain step."""
    return steps.join(params, "effect_id")


def with_authored(steps: DataFrame, params: DataFrame, authored: DataFrame, keys: list[str]) -> DataFrame:
    """Declared parameters with a marker for those the chain sets itself."""
    mine = authored.select(*keys, "param", F.col("value").alias("_set"), F.lit(True).alias("_has"))
    full = declared_for(steps, params).join(mine, [*keys, "param"], "left")
    return full.withColumn("authored", F.coalesce("_has", F.lit(False))).withColumn(
        "value", F.when(F.col("authored"), F.col("_set")).otherwise(F.col("default_value"))
    ).drop("_set", "_has")


def resolve(
    steps: DataFrame, params: DataFrame, layers: list[DataFrame], keys: list[str],
    intensity: Column | None = None, texture: Column | None = None, texture_pairs: DataFrame | None = None,
) -> DataFrame:
    """The value each parameter ends up with.

    Layers come weakest first; the strongest layer that *has* the parameter wins, whatever its
    value. A layer is (keys, param, value), or (keys, sets) with an array of (param, value) in a row. A step meets its
    overrides in one aggregation on the keys; only then its declared parameters are listed. ``intensity`` and ``texture`` are columns of ``steps``; the dials act
    on the coerced number, which is then coerced again.
    """
    info = ["kind", "lo", "hi", "choices", "iscale"]
    dials = {"_intensity": F.lit(1.0) if intensity is None else intensity, "_texture": F.lit(1.0) if texture is None else texture}
    noise = F.lit(False)
    if texture_pairs is not None:
        params = params.join(texture_pairs.select("effect_id", "param", F.lit(True).alias("_pair")), ["effect_id", "param"], "left")
        noise = F.coalesce("_pair", F.lit(False))
    params = params.select("effect_id", "param", "default_value", *info, noise.alias("_noise"))
    of_step, of_layer = f"struct<effect_id: string, {', '.join(f'{c}: double' for c in dials)}>", "struct<layer: int, sets: array<struct<param: string, value: string>>>"
    own = F.struct("effect_id", *[F.col(c).cast("double").alias(c) for c in dials])
    rows = steps.withColumns(dials).select(*keys, own.cast(of_step).alias("_step"), F.lit(None).cast(of_layer).alias("_set"))
    for rank, layer in enumerate(layers, start=1):
        sets = F.array(F.struct("param", "value")) if "param" in layer.columns else F.col("sets")
        rows = rows.unionByName(layer.select(*keys, F.lit(None).cast(of_step).alias("_step"), F.struct(F.lit(rank).alias("layer"), sets.alias("sets")).cast(of_layer).alias("_set")))
    met = rows.groupBy(*keys).agg(F.max("_step").alias("_step"), F.collect_list("_set").alias("_sets")).filter("_step IS NOT NULL")
    # Strongest first.
    flat = F.flatten(F.transform(F.reverse(F.array_sort("_sets")), lambda s: F.transform(
        s["sets"], lambda p: F.struct(s["layer"].alias("layer"), p["param"].alias("param"), p["value"].alias("value"))
    )))
    declared = declared_for(met.select(*keys, "_step.*", flat.alias("_sets")), params)
    first = F.get(F.filter("_sets", lambda e: e["param"] == F.col("param")), F.lit(0))
    won = declared.withColumn("_won", first).select(
        *keys, "param", F.when(F.col("_won").isNull(), F.col("default_value")).otherwise(F.col("_won.value")).alias("value"),
        F.coalesce("_won.layer", F.lit(0)).alias("layer"), "effect_id", *info, *dials, "_noise",
    )
    kind, lo, hi = F.col("kind"), F.col("lo"), F.col("hi")
    again = lambda v: F.when(kind == "int", clip(F.rint(v), lo, hi)).otherwise(clip(v, lo, hi))
    base = coerce_number(kind, F.col("value"), lo, hi)
    dialled = F.when(F.col("iscale") & (F.col("_intensity") != 1.0), again(base * F.col("_intensity"))).otherwise(base)
    won = won.withColumn("_d", dialled)
    num = F.when(F.coalesce("_noise", F.lit(False)) & (F.col("_texture") != 1.0), again(F.col("_d") * F.col("_texture"))).otherwise(F.col("_d"))
    return won.withColumn("num", num).withColumn("txt", coerce_text(kind, F.col("value"), F.col("choices"))).withColumn(
        "bad_choice", enum_error(kind, F.col("value"), F.col("choices"))
    ).drop("_d", "_noise", *dials)


def live_steps(steps: DataFrame, resolved: DataFrame, keys: list[str]) -> DataFrame:
    """Steps whose resolved ``enabled`` is not false; keys were minted before, so they keep their names."""
    off = resolved.filter("param = 'enabled' AND txt = 'false'").select(*keys)
    return steps.join(off, keys, "left_anti")


# ── validation and audits ───────────────────────────────────────────────

def unknown_params(authored: DataFrame, params: DataFrame) -> DataFrame:
    """Authored parameters no effect declares."""
    return authored.join(params.select("effect_id", "param"), ["effect_id", "param"], "left_anti")


def dangling_overrides(overrides: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """Overrides aimed at an effect key the chain does not have."""
    return overrides.join(steps.select(*keys), keys, "left_anti")


def out_of_range(authored: DataFrame, params: DataFrame) -> DataFrame:
    """Authored numbers outside the declared range, with the value they would be clipped to."""
    num = params.filter("kind IN ('int', 'float')").select("effect_id", "param", "lo", "hi")
    v = F.col("value").try_cast("double")
    return authored.join(num, ["effect_id", "param"]).filter(~v.between(F.col("lo"), F.col("hi"))).withColumn(
        "clipped", clip(v, F.col("lo"), F.col("hi"))
    )


def guardrail_hits(authored: DataFrame, rails: DataFrame) -> DataFrame:
    """Authored numbers outside the vetted range, with the reason."""
    v = F.col("value").try_cast("double")
    return authored.join(rails, ["effect_id", "param"]).filter(~v.between(F.col("lo"), F.col("hi")))


def mode_cap_hits(authored: DataFrame, keys: list[str], mode_param: str, caps: dict[str, float], default_mode: str, other: float, capped: list[str]) -> DataFrame:
    """Values above the cap that the step's own mode sets.

    The step's mode travels to its sibling rows through one aggregation per step instead of a
    self-join: a step has few parameters, so the gathered map is small.
    """
    wanted = authored.filter(F.col("param").isin(mode_param, *capped))
    per_step = wanted.groupBy(*keys).agg(*_mode_and_amounts(mode_param, capped))
    mode, cap = _mode_cap(caps, default_mode, other)
    long = per_step.withColumn("mode", mode).withColumn("cap", cap).withColumn(
        "_p", F.explode(F.array(*[F.struct(F.lit(c).alias("param"), F.col(c).alias("amount")) for c in capped]))
    )
    return long.select(*keys, "mode", "cap", "_p.*").filter("amount > cap")


def _mode_and_amounts(mode_param: str, capped: list[str]) -> list[Column]:
    """Aggregates of a step: its mode and the values a mode may cap."""
    return [
        F.max(F.when(F.col("param") == mode_param, F.col("value"))).alias("_mode"),
        *[F.max(F.when(F.col("param") == c, F.col("value").try_cast("double"))).alias(c) for c in capped],
    ]


def _mode_cap(caps: dict[str, float], default_mode: str, other: float) -> tuple[Column, Column]:
    mode = F.coalesce("_mode", F.lit(default_mode))
    cap = F.lit(other)
    for m, v in caps.items():
        cap = F.when(mode == m, F.lit(v)).otherwise(cap)
    return mode, cap


def step_problems(
    authored: DataFrame, params: DataFrame, rails: DataFrame, keys: list[str],
    mode_param: str, caps: dict[str, float], default_mode: str, other: float, capped: list[str],
) -> DataFrame:
    """``n`` problems of every authored step: what ``unknown_params``, ``out_of_range``, ``guardrail_hits`` and
    ``mode_cap_hits`` list, counted in one pass. ``params`` and ``rails`` hold one row per effect and parameter."""
    declared = params.select("effect_id", "param", F.lit(True).alias("_known"), F.col("kind").isin("int", "float").alias("_num"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    vetted = rails.select("effect_id", "param", F.col("lo").alias("_rlo"), F.col("hi").alias("_rhi"))
    v = F.col("value").try_cast("double")
    count = lambda test: F.coalesce(test.cast("long"), F.lit(0).cast("long"))
    flagged = authored.join(declared, ["effect_id", "param"], "left").join(vetted, ["effect_id", "param"], "left").withColumn(
        "_n", count(F.col("_known").isNull()) + count(F.col("_num") & ~v.between(F.col("_lo"), F.col("_hi"))) + count(~v.between(F.col("_rlo"), F.col("_rhi")))
    )
    per_step = flagged.groupBy(*keys).agg(F.sum("_n").alias("_n"), *_mode_and_amounts(mode_param, capped))
    _, cap = _mode_cap(caps, default_mode, other)
    over = sum((count(F.col(c) > cap) for c in capped), F.lit(0).cast("long"))
    return per_step.select(*keys, (F.col("_n") + over).alias("n"))


def problem_totals(problems: list[DataFrame], jobs: DataFrame, job: str) -> DataFrame:
    """Problems per job from rows with a count ``n``, jobs without any included."""
    rows = problems[0].select(job, "n")
    for p in problems[1:]:
        rows = rows.unionByName(p.select(job, "n"))
    counts = rows.groupBy(job).agg(F.sum("n").alias("problems"))
    return jobs.select(job).join(counts, job, "left").withColumn("problems", F.coalesce("problems", F.lit(0).cast("long"))).withColumn(
        "passed", F.col("problems") == 0
    )


# ── browsing ────────────────────────────────────────────────────────────

# The order families are listed in; unknown ones follow.
FAMILY_ORDER = (
    "adjust", "vhs", "film", "broadcast", "cartoon", "digital", "world",
    "decay", "exhibition", "print", "transmission", "stylized", "captions", "audio",
)


def family_rank(family: Column, order: tuple[str, ...] = FAMILY_ORDER, audio_first: bool = False) -> Column:
    at = F.array_position(F.array(*[F.lit(f) for f in order]), family)
    rank = F.when(at == 0, F.lit(len(order))).otherwise(at - 1).cast("int")
    return F.when(family == order[-1], F.lit(-1)).otherwise(rank) if audio_first else rank


def search(df: DataFrame, fields: list[str], tags: str | None, text: str) -> DataFrame:
    parts = [F.coalesce(F.col(f), F.lit("")) for f in fields]
    if tags:
        parts.append(F.array_join(F.coalesce(F.col(tags), F.array().cast("array<string>")), " "))
    return df.filter(F.lower(F.concat_ws(" ", *parts)).contains(text.lower()))


def facet_filter(df: DataFrame, families: list[str], decade: str | None, favourites: DataFrame | None, key: str) -> DataFrame:
    """All facets at once; an empty facet lets everything pass."""
    if families:
        df = df.filter(F.col("family").isin(families))
    if decade:
        df = df.filter(F.col("decade") == decade)
    return df if favourites is None else df.join(favourites.select(key), key, "left_semi")


# Names that one block of the known ids holds on average.
NAMES_PER_BLOCK = 4096


def closest(unknown: DataFrame, known: DataFrame, text: str, candidate: str, n: int = 3, near: int = 2) -> DataFrame:
    """The ``n`` nearest known ids to each unknown one by edit distance, ties to the smaller id; fewer only where fewer are known.

    Two texts within edit distance d share a deletion neighbourhood of depth d, so candidates up to ``near`` meet in an
    equi-join on deletion variants. Only texts with fewer than ``n`` such candidates go on to the blocks of all known ids, and
    take ``n`` from each block; a text answered nearby never meets them. Null ids take no part; repeated ids count once.
    """
    asked = materialize(unknown.select(text).filter(F.col(text).isNotNull()).distinct(), "asked")
    names = materialize(known.select(candidate).filter(F.col(candidate).isNotNull()).distinct(), "known")
    pairs = _deletion_pairs(asked, names, text, candidate, near)
    nearby = materialize(pairs.withColumn("distance", F.levenshtein(text, candidate)).filter(F.col("distance") <= near), "nearby")
    answered = nearby.groupBy(text).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n).select(text)
    far = _from_blocks(asked.join(answered, text, "left_anti"), names, text, candidate, n)
    left = materialize(nearby.join(answered, text, "left_semi").unionByName(far), "candidates")
    out = None
    for r in range(1, n + 1):
        # Each round takes the nearest and removes it: a hot text needs no sort in one task.
        first = left.groupBy(text).agg(F.min(F.struct("distance", candidate)).alias("_m")).select(text, F.lit(r).alias("rank"), "_m.*")
        out = first if out is None else out.unionByName(first)
        left = left.join(first.select(text, candidate), [text, candidate], "left_anti")
    return out


def _from_blocks(asked: DataFrame, names: DataFrame, text: str, candidate: str, n: int) -> DataFrame:
    """The ``n`` nearest of each block of ``names`` to every text, compared inside one row's expression."""
    blocks = -(-names.count() // NAMES_PER_BLOCK)
    if not blocks:
        return asked.select(text, F.lit(None).cast("string").alias(candidate), F.lit(None).cast("int").alias("distance")).filter("false")
    listed = names.groupBy(F.pmod(F.xxhash64(candidate), F.lit(blocks)).alias("_kb")).agg(F.collect_list(candidate).alias("_names"))
    met = spread(asked, text).withColumn("_kb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(listed, "_kb")
    scored = F.transform("_names", lambda c: F.struct(F.levenshtein(F.col(text), c).alias("distance"), c.alias(candidate)))
    return met.select(text, F.explode(F.slice(F.array_sort(scored), 1, n)).alias("_s")).select(text, f"_s.{candidate}", "_s.distance")


def deletions(text: Column, depth: int) -> Column:
    """All strings reached by deleting up to ``depth`` characters."""
    level = F.array(text)
    every = level
    for _ in range(depth):
        level = F.array_distinct(F.flatten(F.transform(level, lambda s: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))),
            lambda i: F.concat(F.left(s, i - 1), s.substr(i + 1, F.length(s))),
        ))))
        every = F.array_union(every, level)
    return every


def _deletion_pairs(a: DataFrame, b: DataFrame, ca: str, cb: str, depth: int) -> DataFrame:
    left = a.withColumn("_d", F.explode(deletions(F.col(ca), depth)))
    right = b.withColumn("_d", F.explode(deletions(F.col(cb), depth)))
    return left.join(right, "_d").select(ca, cb).distinct()

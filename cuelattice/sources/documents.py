"""Catalog documents, reports, indexes and inventories, read and written as DataFrames."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cuelattice import schemas
from cuelattice.session import materialize


def step_structs(steps: DataFrame, authored: DataFrame, keys: list[str]) -> DataFrame:
    """Each step with its authored parameters in name order (a step has few)."""
    own = authored.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col("param"), F.col("value")))).alias("params")
    )
    return steps.join(own, keys, "left")


def catalog_documents(steps: DataFrame, authored: DataFrame, job: str, keys: list[str]) -> DataFrame:
    """One nested JSON document per job, whatever its length: the document is one value of one row."""
    step = F.struct("pos", "which", "effect_id", "params")
    docs = step_structs(steps, authored, keys).groupBy(job).agg(F.sort_array(F.collect_list(step)).alias("chain"))
    return docs.select(job, F.to_json(F.struct("chain")).alias("document"))


def read_catalog_documents(docs: DataFrame, job: str) -> DataFrame:
    """Documents back to one row per (step, parameter)."""
    parsed = docs.select(job, F.from_json("document", f"chain ARRAY<{schemas.STEP}>").alias("d"))
    st = parsed.select(job, F.explode("d.chain").alias("s")).select(job, "s.*")
    return st.select(job, "which", "pos", "effect_id", F.explode("params").alias("p")).select(
        job, "which", "pos", "effect_id", "p.param", "p.value"
    )


def read_schema_file(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A whole exported catalog file as flat tables: effects, params, presets, chain, variants, variant_overrides."""
    raw = spark.read.schema(schemas.CATALOG_FILE).json(path, multiLine=True)
    eff = raw.select(F.explode("effects").alias("effect_id", "e"))
    pre = raw.select(F.explode("presets").alias("preset_id", "p"))
    effects = eff.select("effect_id", "e.label", "e.kind", F.col("e.desc").alias("descr"))
    params = eff.select("effect_id", F.posexplode("e.params").alias("pos", "p")).select(
        "effect_id", "pos", "p.name", "p.label", "p.kind", F.col("p.default").alias("default_value"), "p.lo", "p.hi", "p.step",
        "p.choices", "p.unit", F.col("p.desc").alias("descr"), F.col("p.group").alias("grp"), "p.iscale", "p.fmt",
    )
    presets = pre.select(
        "preset_id", "p.name", "p.family", "p.era", F.col("p.desc").alias("descr"), "p.tagline", "p.tags", "p.proc_height", "p.upscale"
    )
    # A step is written as a two-element array [effect, {param: value}]; its mixed types arrive as text.
    step = "ARRAY<STRING>"
    chain = None
    for which in ("video", "audio"):
        part = pre.select("preset_id", F.lit(which).alias("which"), F.posexplode(f"p.{which}").alias("pos", "raw"))
        part = part.withColumn("pair", F.from_json("raw", step)).select(
            "preset_id", "which", "pos", F.col("pair")[0].alias("effect_id"),
            F.from_json(F.col("pair")[1], "MAP<STRING, STRING>").alias("params"),
        )
        chain = part if chain is None else chain.unionByName(part)
    var = pre.select("preset_id", F.explode("p.variants").alias("v"))
    variants = var.select("preset_id", F.col("v.id").alias("variant_id"), "v.name", F.col("v.desc").alias("descr"))
    over = None
    for which in ("video", "audio"):
        part = var.select("preset_id", F.col("v.id").alias("variant_id"), F.lit(which).alias("which"), F.explode(f"v.{which}").alias("path", "value"))
        part = part.select(
            "preset_id", "variant_id", "which", F.substring_index("path", ".", 1).alias("effect_key"),
            F.expr("substr(path, instr(path, '.') + 1)").alias("param"), "value",
        )
        over = part if over is None else over.unionByName(part)
    return {"effects": effects, "params": params, "presets": presets, "chain": chain, "variants": variants, "variant_overrides": over}


def report_lines(steps: DataFrame, authored: DataFrame, keys: list[str]) -> DataFrame:
    """One markdown line per chain step."""
    full = step_structs(steps, authored, keys)
    shown = F.array_join(F.transform(
        "params", lambda p: F.concat(F.lit("`"), F.col("effect_key"), F.lit("."), p["param"], F.lit("="), p["value"], F.lit("`"))
    ), ", ")
    shown = F.when(F.coalesce(F.size("params"), F.lit(0)) > 0, shown).otherwise(F.lit("(defaults)"))
    return full.withColumn("line", F.concat(F.lit("- **"), F.col("effect_id"), F.lit("** - "), shown))


def write_report(lines: DataFrame, path: str, order: list[str]) -> None:
    """Lines as text files, range-sorted so the parts read in order."""
    lines.orderBy(*order).select("line").write.text(path)


def thumbnail_index(presets: DataFrame, posters: DataFrame, anims: DataFrame, key: str, poster_end: str, anim_end: str) -> DataFrame:
    """Entries with a poster; the animation may be missing."""
    stem = lambda end: F.expr(f"left(name, length(name) - {len(end)})")
    p = posters.select(stem(poster_end).alias(key), F.col("name").alias("poster"))
    a = anims.select(stem(anim_end).alias(key), F.col("name").alias("anim"))
    return presets.join(p, key).join(a, key, "left").select(key, "poster", "anim", "audio_only")


def pack_status(expected: DataFrame, present: DataFrame, pack: str, item: str) -> DataFrame:
    """Expected and present counts per pack, zero when nothing is there."""
    return expected.select(pack, item).join(present, item, "left").groupBy(pack).agg(
        F.count(F.lit(1)).alias("expected"), F.count("here").alias("present")
    )


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Picture files by pack folder; the file bodies are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    return files.filter(F.col("path").rlike(r"(?i)\.(png|jpe?g)$")).select(
        F.element_at(F.split("path", "/"), -2).alias("pack"), F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime"
    )


def store_totals(files: DataFrame, size: str, changed: str) -> DataFrame:
    """Count, bytes and newest time; the time is null for an empty store."""
    return files.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.max(changed).alias("newest")
    )


def drifted(now: DataFrame, saved: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Does the current setting differ from the saved one in any field, nulls compared as values?"""
    old = saved.select(key, *[F.col(f).alias(f"_old_{f}") for f in fields])
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_old_{f}"))
    return now.join(old, key).select(key, (~same).alias("drifted"))


def fingerprint(parts: list[Column]) -> Column:
    """Hash of the canonical settings; the order of ``parts`` is the canonical order."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("\u0002")) for p in parts]), 256)


def pictures(files: DataFrame, path: str) -> DataFrame:
    """Pack and name of the png, jpg and jpeg paths, whatever their case."""
    parts = F.split(path, "/")
    return files.filter(F.col(path).rlike(r"(?i)\.(png|jpe?g)$")).withColumn("pack", F.element_at(parts, -2)).withColumn(
        "name", F.element_at(parts, -1)
    )


def first_assets(assets: DataFrame, key: str, pos: str, name: str, suffixes: list[str]) -> DataFrame:
    """First asset per platform suffix, by position."""
    which = F.lit(None).cast("string")
    for s in suffixes:
        which = F.when(F.lower(name).endswith(s), s).otherwise(which)
    return assets.withColumn("suffix", which).filter("suffix IS NOT NULL").groupBy(key, "suffix").agg(F.min_by(name, pos).alias("asset"))


def release_label(labels: DataFrame, key: str, label: str, known: list[str], skip: str) -> DataFrame:
    """Exactly one release label, or the skip label alone; anything else is an error row."""
    norm = F.lower(F.trim(F.col(label)))
    flags = labels.groupBy(key).agg(
        F.max(norm == skip).alias("_skip"), *[F.max(norm == k).alias(f"_l_{k}") for k in known]
    )
    hits = sum((F.col(f"_l_{k}").cast("int") for k in known), F.lit(0))
    one = F.coalesce(*[F.when(F.col(f"_l_{k}"), k) for k in known])
    error = F.when(F.col("_skip") & (hits > 0), "skip with others").when(~F.col("_skip") & (hits == 0), "no label").when(
        ~F.col("_skip") & (hits > 1), "several labels"
    )
    return flags.select(key, F.when(error.isNull(), F.when(F.col("_skip"), "none").otherwise(one)).alias("label"), error.alias("error"))


def store_cleared(before: DataFrame, after: DataFrame, name: str, size: str) -> DataFrame:
    """What a clear has removed and freed: files of the first listing that the second lacks, their bytes, and how many are still there.

    A file that could not be removed is in both; one that has come meanwhile is in the second only and counts for nothing.
    """
    met = before.select(name, size).join(after.select(name, F.lit(True).alias("_left")).distinct(), name, "left")
    gone = F.col("_left").isNull()
    return met.agg(
        F.count(F.when(gone, 1)).alias("removed"), F.coalesce(F.sum(F.when(gone, F.col(size))), F.lit(0)).alias("bytes"), F.count(F.when(~gone, 1)).alias("left")
    )


def setting_changes(now: DataFrame, saved: DataFrame, key: str, maps: list[str], lists: dict[str, str]) -> DataFrame:
    """(key, part, name, change): what differs between two settings of a key; no row where they are alike.

    ``maps`` are map columns: entries are compared whatever their order, and a null value is a value. ``lists`` name array-of-struct columns and the field that tells
    their items apart; the nth item of a name meets the nth. An item is added, removed, changed, or moved: alike, but at another place among
    the items that both lists have. A null map or list is empty.

    Every step is a window that begins with the key. So where both sides come dealt by it, nothing is shuffled; else a long list is spread by the names of its items.
    """
    # Under a name of its own the key keeps the way its rows are dealt through a union.
    own = F.col(key).alias(key)

    def rows(df: DataFrame, is_now: bool) -> list[DataFrame]:
        out, at = [], F.lit(None).cast("long")
        for c in maps:
            part = df.select(own, F.explode(F.col(c)).alias("name", "_v"))
            out.append(part.select(own, F.lit(c).alias("part"), "name", F.lit(0).alias("_nth"), at.alias("_at"), F.lit(is_now).alias("_now"), F.to_json(F.struct(F.col("_v").alias("v"))).alias("_body")))
        for c, ident in lists.items():
            part = df.select(own, F.posexplode(F.col(c)).alias("_at", "_v")).select(own, F.col(f"_v.{ident}").alias("name"), F.col("_at").cast("long").alias("_at"), F.to_json("_v").alias("_body"))
            part = part.dropna(subset=[key, "name"]).withColumn("_nth", F.row_number().over(Window.partitionBy(key, "name").orderBy("_at")))
            out.append(part.select(own, F.lit(c).alias("part"), "name", "_nth", "_at", F.lit(is_now).alias("_now"), "_body"))
        return out

    met = functools.reduce(DataFrame.unionByName, [*rows(now, True), *rows(saved, False)])
    # The item of now takes that of saved along; entries of a key with several settings meet each with each, as in a join.
    alike = Window.partitionBy(key, "part", "name", "_nth")
    met = met.withColumn("_olds", F.collect_list(F.when(~F.col("_now"), F.struct("_at", "_body"))).over(alike)).withColumn("_stays", F.max("_now").over(alike))
    met = met.filter(F.col("_now") | ~F.col("_stays")).withColumn("_old", F.explode_outer(F.when(F.col("_now"), F.col("_olds"))))
    change = F.when(~F.col("_now"), "removed").when(F.col("_old").isNull(), "added").when(F.col("_body") != F.col("_old._body"), "changed")
    both = F.col("_now") & F.col("_at").isNotNull() & F.col("_old._at").isNotNull()
    met = met.select(key, "part", "name", F.col("_at").alias("_here"), F.col("_old._at").alias("_there"), both.alias("_both"), change.alias("change"))
    met = met.filter(F.col("_both") | F.col("change").isNotNull())
    place = lambda at: F.row_number().over(Window.partitionBy(key, "part", "_both").orderBy(at))
    met = met.withColumn("_a", place("_here")).withColumn("_b", place("_there"))
    moved = F.when(F.col("_both") & (F.col("_a") != F.col("_b")), "moved")
    return met.select(key, "part", "name", F.coalesce("change", moved).alias("change")).filter("change IS NOT NULL")


def full_report(presets: DataFrame, variants: DataFrame, steps: DataFrame, authored: DataFrame, knobs: DataFrame, keys: list[str], title: str) -> DataFrame:
    """(line_no, line): the whole catalog in document order: title and totals, a heading per family and preset, its variants, picture and sound steps, knob count.

    ``presets`` (preset_id, name, family, era, descr), ``variants`` (preset_id, variant_id, name, descr), ``steps`` with preset_id besides ``keys``, ``authored`` (keys, param, value),
    ``knobs`` (effect_id, n). Each kind of line is one aggregation; numbers come from a range sort, so no task holds the document.
    """
    from cuelattice.operators.series import index_rows

    place = presets.select("preset_id", "family")
    line = lambda df, rank, text, pos=F.lit(0): df.select("family", "preset_id", F.lit(rank).alias("rank"), pos.cast("long").alias("pos"), text.alias("line"))
    named = F.format_string("`%s` (%s - %s)", "variant_id", "name", "descr")
    listed = variants.groupBy("preset_id").agg(F.array_sort(F.collect_list(F.struct("variant_id", named.alias("text")))).alias("v"), F.count(F.lit(1)).alias("n"))
    out = line(presets.select("family").distinct().withColumn("preset_id", F.lit("")), 1, F.concat(F.lit("## "), F.upper("family")))
    out = out.unionByName(line(presets, 2, F.format_string("### `%s` - %s (%s)", "preset_id", "name", "era"))).unionByName(line(presets, 3, F.col("descr")))
    out = out.unionByName(line(listed.join(place, "preset_id"), 4, F.concat(F.lit("**Variants:** "), F.array_join(F.transform("v", lambda x: x["text"]), ", "))))
    shown = authored.groupBy(*keys).agg(F.array_sort(F.collect_list(F.concat(F.lit("`"), F.col(keys[-1]), F.lit("."), F.col("param"), F.lit("="), F.coalesce("value", F.lit("null")), F.lit("`")))).alias("_s"))
    full = steps.join(shown, keys, "left").join(place, "preset_id")
    for rank, which, label in ((5, "video", "**Picture:**"), (7, "audio", "**Sound:**")):
        own = full.filter(F.col("which") == which)
        out = out.unionByName(line(own.select("family", "preset_id").distinct(), rank, F.lit(label)))
        text = F.concat(F.lit("- **"), F.col("effect_id"), F.lit("** - "), F.coalesce(F.array_join("_s", ", "), F.lit("(defaults)")))
        out = out.unionByName(line(own, rank + 1, text, F.col("pos")))
    counted = place.join(steps.join(knobs, "effect_id").groupBy("preset_id").agg(F.sum("n").alias("_k")), "preset_id", "left")
    out = out.unionByName(line(counted, 9, F.concat(F.lit("*"), F.coalesce("_k", F.lit(0)).cast("string"), F.lit(" adjustable parameters in this preset.*"))))
    zero = F.lit(0).cast("long")
    totals = presets.agg(F.count(F.lit(1)).alias("p"), zero.alias("v")).unionByName(variants.agg(zero.alias("p"), F.count(F.lit(1)).alias("v"))).agg(F.sum("p").alias("p"), F.sum("v").alias("v"))
    head = totals.select(F.explode(F.array(
        F.struct(F.lit(0).alias("pos"), F.lit(f"# {title}").alias("line")), F.struct(F.lit(1).alias("pos"), F.concat(F.lit("**"), F.col("p").cast("string"), F.lit(" presets, "), F.col("v").cast("string"), F.lit(" variants.**")).alias("line")),
    )).alias("l")).select(F.lit("").alias("family"), F.lit("").alias("preset_id"), F.lit(0).alias("rank"), F.col("l.pos").cast("long").alias("pos"), "l.line")
    return index_rows(out.unionByName(head), [], ["family", "preset_id", "rank", "pos"], "line_no").select("line_no", "line")


def nested_documents(effects: DataFrame, presets: DataFrame, chain: DataFrame, variants: DataFrame, overrides: DataFrame) -> DataFrame:
    """(kind, id, document): an effect with its parameters, or a preset with its chain and its variants with their overrides, as one JSON text each.

    ``effects`` are parameter rows (effect_id, pos, param, kind, default_value, lo, hi, choices, iscale); ``presets`` (preset_id, name, family, era, tags); ``chain`` (preset_id, which,
    pos, effect_id, params map); ``variants`` (preset_id, variant_id, name); ``overrides`` (preset_id, variant_id, which, path, value). A catalog is many documents, so no row holds it whole.
    """
    own = F.struct("pos", F.col("param").alias("name"), "kind", F.col("default_value").alias("default"), "lo", "hi", "choices", "iscale")
    eff = effects.groupBy("effect_id").agg(F.array_sort(F.collect_list(own)).alias("params"))
    eff = eff.select(F.lit("effect").alias("kind"), F.col("effect_id").alias("id"), F.to_json(F.struct(F.col("effect_id").alias("id"), "params")).alias("document"))
    sets = overrides.groupBy("preset_id", "variant_id").agg(F.array_sort(F.collect_list(F.struct("which", "path", "value"))).alias("sets"))
    var = variants.join(sets, ["preset_id", "variant_id"], "left").groupBy("preset_id").agg(F.array_sort(F.collect_list(F.struct(F.col("variant_id").alias("id"), "name", "sets"))).alias("variants"))
    # Maps have no order, so steps are ordered by their place alone.
    step = F.struct("pos", "which", F.col("effect_id").alias("effect"), F.to_json("params").alias("params"))
    steps = chain.groupBy("preset_id").agg(F.array_sort(F.collect_list(step)).alias("chain"))
    pre = presets.join(steps, "preset_id", "left").join(var, "preset_id", "left")
    body = F.struct(F.col("preset_id").alias("id"), "name", "family", "era", "tags", "chain", "variants")
    return eff.unionByName(pre.select(F.lit("preset").alias("kind"), F.col("preset_id").alias("id"), F.to_json(body).alias("document")))


def read_nested(docs: DataFrame) -> dict[str, DataFrame]:
    """Flat tables of (kind, id, document) rows: params, presets, chain, variants, overrides, and ``rejects`` with the reason.

    Rejected are texts that are no such document, documents without an id or under another's, and effects with a parameter that has no name or no known kind.
    """
    param = "STRUCT<pos: INT, name: STRING, kind: STRING, default: STRING, lo: DOUBLE, hi: DOUBLE, choices: ARRAY<STRING>, iscale: BOOLEAN>"
    variant = "STRUCT<id: STRING, name: STRING, sets: ARRAY<STRUCT<which: STRING, path: STRING, value: STRING>>>"
    step = "STRUCT<pos: BIGINT, which: STRING, effect: STRING, params: STRING>"
    kind = f"id STRING, name STRING, family STRING, era STRING, tags ARRAY<STRING>, params ARRAY<{param}>, chain ARRAY<{step}>, variants ARRAY<{variant}>, _corrupt STRING"
    read = docs.withColumn("d", F.from_json("document", kind, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}))
    odd = F.exists(F.coalesce("d.params", F.array()), lambda p: p["name"].isNull() | ~F.coalesce(p["kind"].isin("bool", "int", "float", "enum", "str"), F.lit(False)))
    error = F.when(F.col("d").isNull() | F.col("d._corrupt").isNotNull(), "not a document").when(F.col("d.id").isNull(), "no id").when(F.col("d.id") != F.col("id"), "another id").when(
        ~F.col("kind").isin("effect", "preset"), "unknown kind").when(odd, "bad parameter")
    read = materialize(read.withColumn("error", error), "catalog-read")
    eff, pre = (read.filter(F.col("error").isNull() & (F.col("kind") == k)).select("d.*") for k in ("effect", "preset"))
    params = eff.select(F.col("id").alias("effect_id"), F.explode("params").alias("p")).select("effect_id", "p.pos", F.col("p.name").alias("param"), "p.kind", F.col("p.default").alias("default_value"), "p.lo", "p.hi", "p.choices", "p.iscale")
    chain = pre.select(F.col("id").alias("preset_id"), F.explode("chain").alias("s")).select("preset_id", "s.which", "s.pos", F.col("s.effect").alias("effect_id"), F.from_json("s.params", "MAP<STRING, STRING>").alias("params"))
    variants = pre.select(F.col("id").alias("preset_id"), F.explode("variants").alias("v"))
    sets = variants.select("preset_id", F.col("v.id").alias("variant_id"), F.explode("v.sets").alias("s"))
    return {
        "params": params, "presets": pre.select(F.col("id").alias("preset_id"), "name", "family", "era", "tags"), "chain": chain,
        "variants": variants.select("preset_id", F.col("v.id").alias("variant_id"), "v.name"), "overrides": sets.select("preset_id", "variant_id", "s.which", "s.path", "s.value"),
        "rejects": read.filter("error IS NOT NULL").select("kind", "id", "error"),
    }

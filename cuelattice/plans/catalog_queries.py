"""Registered queries over the catalog: chains, overrides, validation, audits, browsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelattice.functions import scalars as sc, text as tx
from cuelattice.operators import catalog as ca, series as se
from cuelattice.plans import catalog_inputs as ci
from cuelattice.plans.catalog_inputs import AU_SQL, CH_SQL, KEYS, PRESET_SQL, RESOLVED_SQL
from cuelattice.plans.inputs import table
from cuelattice.plans.registry import query
from cuelattice.session import materialize
from cuelattice.sources import documents as doc

KCOLS = "job, which, effect_key"


def resolved(spark, d):
    dials = ci.orders(spark, d).select("job", "intensity", "texture")
    st = ci.steps(spark, d).select(*KEYS, "effect_id").join(dials, "job")
    layers = [ci.authored_sets(spark, d).select(*KEYS, "sets"), ci.variant_overrides(spark, d), ci.user_overrides(spark, d)]
    return ca.resolve(
        st, ci.params(spark, d), layers, KEYS, F.col("intensity"), F.col("texture"), ci.texture_pairs(spark, d)
    )


# ── chains ──────────────────────────────────────────────────────────────

@query("W1_repeat_keys", f"WITH {CH_SQL} SELECT job, which, pos, effect_key FROM ch")
def repeat_keys(spark, d):
    return ci.steps(spark, d).select("job", "which", "pos", "effect_key")


@query("W27_chain_segments", f"""WITH {CH_SQL} SELECT job, pos, (2 * sum(b) OVER (PARTITION BY job ORDER BY pos) - b)::BIGINT AS segment
FROM (SELECT job, pos, CASE WHEN rf = 'A' THEN 1 ELSE 0 END AS b FROM ch)""")
def chain_segments(spark, d):
    return ca.segment_chain(ci.steps(spark, d), ["job"], F.col("rf") == "A").select("job", "pos", "segment")


@query("J1_chain_params", f"""WITH {AU_SQL} SELECT ch.job, ch.which, ch.effect_key, pr.param, a.job IS NOT NULL AS authored,
  CASE WHEN a.job IS NOT NULL THEN a.value ELSE default_value END AS value FROM ch JOIN pr USING (effect_id)
  LEFT JOIN aut a ON a.job = ch.job AND a.which = ch.which AND a.effect_key = ch.effect_key AND a.param = pr.param""")
def chain_params(spark, d):
    st = ci.steps(spark, d).select(*KEYS, "effect_id")
    out = ca.with_authored(st, ci.params(spark, d), ci.authored(spark, d), KEYS)
    return out.select(*KEYS, "param", "authored", "value")


@query("J2_resolve_overrides", f"WITH {RESOLVED_SQL} SELECT {KCOLS}, param, layer, value, round(num, 6) AS num, txt, bad_choice FROM rs")
def resolve_overrides(spark, d):
    return resolved(spark, d).select(*KEYS, "param", "layer", "value", F.round("num", 6).alias("num"), "txt", "bad_choice")


@query("P1_coerce", f"""WITH {AU_SQL} SELECT {KCOLS}, param, CASE WHEN kind = 'int' THEN least(greatest(round_even(TRY_CAST(value AS DOUBLE), 0), lo), hi)
  WHEN kind = 'float' THEN least(greatest(TRY_CAST(value AS DOUBLE), lo), hi) END AS num,
  CASE WHEN kind = 'bool' THEN CASE WHEN lower(value) IN ('1', 'true', 'yes', 'on') THEN 'true' ELSE 'false' END WHEN kind = 'enum' AND value IN ('A', 'N', 'R') THEN value END AS txt,
  kind = 'enum' AND value NOT IN ('A', 'N', 'R') AS bad_choice FROM aut JOIN pr USING (effect_id, param)""")
def coerce(spark, d):
    k, v, c = F.col("kind"), F.col("value"), F.col("choices")
    rows = ci.authored(spark, d).join(ci.params(spark, d), ["effect_id", "param"])
    return rows.select(
        *KEYS, "param", ca.coerce_number(k, v, F.col("lo"), F.col("hi")).alias("num"), ca.coerce_text(k, v, c).alias("txt"),
        ca.enum_error(k, v, c).alias("bad_choice"),
    )


@query("P2_intensity_dial", f"WITH {RESOLVED_SQL} SELECT {KCOLS}, param, round(v2, 6) AS num FROM n2 WHERE iscale")
def intensity_dial(spark, d):
    dials = ci.orders(spark, d).select("job", "intensity")
    st = ci.steps(spark, d).select(*KEYS, "effect_id").join(dials, "job")
    layers = [ci.authored_sets(spark, d).select(*KEYS, "sets"), ci.variant_overrides(spark, d), ci.user_overrides(spark, d)]
    out = ca.resolve(st, ci.params(spark, d).filter("iscale"), layers, KEYS, F.col("intensity"))
    return out.select(*KEYS, "param", F.round("num", 6).alias("num"))


@query("P3_texture_dial", f"WITH {RESOLVED_SQL} SELECT {KCOLS}, param, round(v2, 6) AS before, round(num, 6) AS after FROM rs WHERE noise AND texture <> 1.0")
def texture_dial(spark, d):
    dials = ci.orders(spark, d).filter("texture <> 1.0").select("job", "intensity", "texture")
    noisy = ci.texture_pairs(spark, d)
    st = ci.steps(spark, d).select(*KEYS, "effect_id").join(noisy.select("effect_id"), "effect_id", "left_semi").join(dials, "job")
    layers = [ci.authored_sets(spark, d).select(*KEYS, "sets"), ci.variant_overrides(spark, d), ci.user_overrides(spark, d)]
    par = ci.params(spark, d).filter("param = 'discount'")
    plain = ca.resolve(st, par, layers, KEYS, F.col("intensity")).select(*KEYS, "param", F.round("num", 6).alias("before"))
    dialled = ca.resolve(st, par, layers, KEYS, F.col("intensity"), F.col("texture"), noisy).select(*KEYS, "param", F.round("num", 6).alias("after"))
    return plain.join(dialled, [*KEYS, "param"])


@query("P4_live_steps", f"""WITH {RESOLVED_SQL} SELECT {KCOLS} FROM ch ANTI JOIN (SELECT * FROM rs WHERE param = 'enabled' AND txt = 'false') o USING (job, which, effect_key)""")
def live_steps(spark, d):
    st = ci.steps(spark, d).select(*KEYS, "effect_id")
    on = ca.resolve(st, ci.params(spark, d).filter("param = 'enabled'"), [ci.authored(spark, d).filter("param = 'enabled'").drop("effect_id")], KEYS)
    return ca.live_steps(st, on, KEYS).select(*KEYS)


# ── validation ──────────────────────────────────────────────────────────

@query("J3_unknown_params", f"WITH {AU_SQL} SELECT {KCOLS}, param, value FROM aut ANTI JOIN pr USING (effect_id, param)")
def unknown_params(spark, d):
    return ca.unknown_params(ci.authored(spark, d), ci.params(spark, d)).select(*KEYS, "param", "value")


DANGLING_SQL = "ovr AS (SELECT job, 'video' AS which, 'Brand#1' AS effect_key, 'tax' AS param, '0.01' AS value FROM ordr WHERE priority = '2-HIGH')"


def aimed_overrides(spark, d):
    high = ci.orders(spark, d).filter("priority = '2-HIGH'")
    return high.select(
        "job", F.lit("video").alias("which"), F.lit("Brand#1").alias("effect_key"), F.lit("tax").alias("param"), F.lit("0.01").alias("value")
    )


@query("J4_dangling_overrides", f"WITH {CH_SQL}, {DANGLING_SQL} SELECT {KCOLS}, param FROM ovr ANTI JOIN ch USING (job, which, effect_key)")
def dangling(spark, d):
    return ca.dangling_overrides(aimed_overrides(spark, d), ci.steps(spark, d), KEYS).select(*KEYS, "param")


J5_SQL = """(SELECT job, which, effect_key, param, TRY_CAST(value AS DOUBLE) AS v, lo, hi FROM aut JOIN pr USING (effect_id, param)
  WHERE kind IN ('int', 'float') AND NOT (TRY_CAST(value AS DOUBLE) BETWEEN lo AND hi))"""


@query("J5_out_of_range", f"WITH {AU_SQL} SELECT {KCOLS}, param, v AS given, least(greatest(v, lo), hi) AS clipped FROM {J5_SQL}")
def out_of_range(spark, d):
    bad = ca.out_of_range(ci.authored(spark, d), ci.params(spark, d))
    return bad.select(*KEYS, "param", F.col("value").cast("double").alias("given"), "clipped")


RAIL_SQL = """rail AS (SELECT p_brand AS effect_id, 'quantity' AS param, min(p_size) + 0.0 AS lo, avg(p_size) AS hi, 'set by size' AS why FROM part GROUP BY 1)"""


def rails(spark, d):
    """Vetted quantity range per brand, taken from its part sizes. Written, so the planner knows the size."""
    ranges = table(spark, d, "part").groupBy(F.col("p_brand").alias("effect_id")).agg(
        F.min("p_size").cast("double").alias("lo"), F.avg("p_size").alias("hi")
    )
    return materialize(ranges.withColumn("param", F.lit("quantity")).withColumn("why", F.lit("set by size")), "rails")


@query("J6_guardrails", f"WITH {AU_SQL}, {RAIL_SQL} SELECT {KCOLS}, param, TRY_CAST(value AS DOUBLE) AS given, why FROM aut JOIN rail USING (effect_id, param) WHERE NOT (TRY_CAST(value AS DOUBLE) BETWEEN lo AND hi)")
def guardrails(spark, d):
    hits = ca.guardrail_hits(ci.authored(spark, d), rails(spark, d))
    return hits.select(*KEYS, "param", F.col("value").cast("double").alias("given"), "why")


CAPS = {"A": 0.03, "R": 0.05}
J7_SQL = """(SELECT m.job, m.which, m.effect_key, u.param, m.value AS mode, CASE m.value WHEN 'A' THEN 0.03 WHEN 'R' THEN 0.05 ELSE 0.07 END AS cap, TRY_CAST(u.value AS DOUBLE) AS amount
  FROM (SELECT * FROM aut WHERE param = 'mode') m JOIN (SELECT * FROM aut WHERE param IN ('discount', 'tax')) u USING (job, which, effect_key))"""


# From the step rows alone: their modes and what of them the modes cap.
J7_STEPS = """SELECT job, which, effect_key, p.param AS param, mode, cap, p.amount::DOUBLE AS amount FROM (SELECT *, CASE mode WHEN 'A' THEN 0.03 WHEN 'R' THEN 0.05 ELSE 0.07 END AS cap,
  unnest([{'param': 'discount', 'amount': dc}, {'param': 'tax', 'amount': tx}]) AS p FROM (SELECT *, CASE WHEN tx = 0.08 THEN 'X' ELSE rf END AS mode FROM ch)) WHERE p.amount > cap"""


@query("J7_mode_caps", f"WITH {CH_SQL} {J7_STEPS}")
def mode_caps(spark, d):
    hits = ca.mode_cap_hits(ci.authored(spark, d), KEYS, "mode", CAPS, "N", 0.07, ["discount", "tax"])
    return hits.select(*KEYS, "param", "mode", "cap", "amount")


@query("A16_validation_rollup", f"""WITH {AU_SQL}, {RAIL_SQL}, {DANGLING_SQL}, bad AS (
  SELECT job FROM aut ANTI JOIN pr USING (effect_id, param) UNION ALL SELECT job FROM ovr ANTI JOIN ch USING (job, which, effect_key) UNION ALL SELECT job FROM {J5_SQL}
  UNION ALL SELECT job FROM aut JOIN rail USING (effect_id, param) WHERE NOT (TRY_CAST(value AS DOUBLE) BETWEEN lo AND hi) UNION ALL SELECT job FROM {J7_SQL} WHERE amount > cap)
SELECT o.job, count(b.job) AS problems, count(b.job) = 0 AS passed FROM ordr o LEFT JOIN bad b USING (job) GROUP BY o.job""")
def validation_rollup(spark, d):
    found = [
        ca.step_problems(ci.authored(spark, d), ci.params(spark, d), rails(spark, d), KEYS, "mode", CAPS, "N", 0.07, ["discount", "tax"]),
        ca.dangling_overrides(aimed_overrides(spark, d), ci.steps(spark, d), KEYS).withColumn("n", F.lit(1).cast("long")),
    ]
    return ca.problem_totals(found, ci.orders(spark, d), "job")


# ── typed text ──────────────────────────────────────────────────────────

@query("S5_override_strings", """SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 7 = 0 THEN NULL ELSE event_type END AS effect_key,
  CASE WHEN event_id % 11 = 0 OR event_id % 7 = 0 THEN NULL ELSE 'k' END AS param, CASE WHEN event_id % 11 = 0 OR event_id % 7 = 0 THEN NULL ELSE json_extract_string(props, '$.k') || '=x.y' END AS value,
  CASE WHEN event_id % 11 = 0 THEN 'no value' WHEN event_id % 7 = 0 THEN 'no parameter' END AS error FROM events""")
def override_strings(spark, d):
    ev = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    text = F.when(F.col("event_id") % 11 == 0, F.concat("event_type", F.lit(".k"))).when(
        F.col("event_id") % 7 == 0, F.concat("event_type", F.lit("="), F.col("k"))
    ).otherwise(F.concat("event_type", F.lit(".k= "), F.col("k"), F.lit("=x.y ")))
    parts = ca.split_override(text)
    return ev.select("event_id", *[c.alias(n) for n, c in parts.items()])


RAW_SQL = """CASE event_id % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'off' WHEN 2 THEN json_extract_string(props, '$.k') WHEN 3 THEN value::VARCHAR WHEN 4 THEN event_type ELSE json_extract_string(props, '$.k') || 'e2' END"""


@query("P5_value_typing", f"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'bool' WHEN 1 THEN 'bool' WHEN 2 THEN 'int' WHEN 3 THEN 'float' WHEN 4 THEN 'str' ELSE 'float' END AS kind,
  TRY_CAST(CASE WHEN event_id % 6 IN (2, 3, 5) THEN {RAW_SQL} END AS DOUBLE) AS num FROM events""")
def value_typing(spark, d):
    m, k = F.col("event_id") % 6, F.get_json_object("props", "$.k")
    raw = F.when(m == 0, "Yes").when(m == 1, "off").when(m == 2, k).when(m == 3, F.col("value").cast("string")).when(m == 4, F.col("event_type")).otherwise(F.concat(k, F.lit("e2")))
    kind = ca.value_kind(raw)
    return table(spark, d, "events").select("event_id", kind.alias("kind"), F.when(kind.isin("int", "float"), raw.try_cast("double")).alias("num"))


@query("P6_chain_routing", "SELECT p_partkey, CASE WHEN p_name LIKE 'r%' THEN 'a_' || p_name ELSE p_name END AS effect_key, CASE WHEN p_name LIKE 'r%' THEN 'audio' ELSE 'video' END AS which FROM part")
def routing(spark, d):
    key = F.when(F.col("p_name").startswith("r"), F.concat(F.lit("a_"), F.col("p_name"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", key.alias("effect_key"), ca.route(key).alias("which"))


# ── browsing ────────────────────────────────────────────────────────────

@query("P7_family_listing", f"WITH {PRESET_SQL} SELECT family, preset_id, count(o_orderkey) AS variants FROM pre LEFT JOIN orders ON o_custkey = c_custkey WHERE family IN ('BUILDING', 'FURNITURE') GROUP BY 1, 2")
def family_listing(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("variants"))
    pre = ci.presets(spark, d).filter(F.col("family").isin("BUILDING", "FURNITURE"))
    out = pre.join(n, "c_custkey", "left").select("family", "preset_id", F.coalesce("variants", F.lit(0).cast("long")).alias("variants"))
    return out.orderBy("family", "preset_id")


@query("P8_faceted_filter", f"WITH {PRESET_SQL} SELECT preset_id, family, decade FROM pre WHERE c_acctbal > 8000 AND family IN ('BUILDING', 'MACHINERY') AND decade = '1970s'")
def faceted_filter(spark, d):
    pre = ci.presets(spark, d).withColumn("decade", tx.decade(F.col("era")))
    out = ca.facet_filter(pre, ["BUILDING", "MACHINERY"], "1970s", ci.favourites(spark, d), "preset_id")
    return out.select("preset_id", "family", "decade")


@query("P9_text_search", f"WITH {PRESET_SQL} SELECT preset_id, name FROM pre WHERE contains(lower(concat_ws(' ', preset_id, name, era, family, tagline, n_name || ' ' || r_name)), ' asia')")
def text_search(spark, d):
    return ca.search(ci.presets(spark, d), ["preset_id", "name", "era", "family", "tagline"], "tags", " ASIA").select("preset_id", "name")


@query("P15_audio_only", f"WITH {CH_SQL} SELECT job, count(*) FILTER (which = 'video') = 0 AS audio_only FROM ch GROUP BY 1")
def audio_only(spark, d):
    n = F.count(F.when(F.col("which") == "video", 1))
    return ci.steps(spark, d).groupBy("job").agg((n == 0).alias("audio_only"))


SAVED = """(o.o_orderstatus IS DISTINCT FROM p.o_orderstatus OR o.o_orderpriority IS DISTINCT FROM p.o_orderpriority OR o.o_totalprice IS DISTINCT FROM p.o_totalprice)"""


@query("P16_drift", f"SELECT o.o_orderkey AS job, {SAVED} AS drifted FROM orders o JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders) p USING (o_orderkey)")
def drift(spark, d):
    now = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    saved = now.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus"))).withColumn(
        "o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    )
    return doc.drifted(now, saved, "o_orderkey", ["o_orderstatus", "o_orderpriority", "o_totalprice"]).withColumnRenamed("o_orderkey", "job")


@query("A1_catalog_totals", f"WITH {PRESET_SQL} SELECT coalesce(family, 'all') AS family, count(*) AS presets, sum(n)::BIGINT AS variants FROM (SELECT family, preset_id, count(o_orderkey) AS n FROM pre LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY ROLLUP (family)")
def catalog_totals(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = ci.presets(spark, d).join(n, "c_custkey", "left").rollup("family").agg(
        F.count(F.lit(1)).alias("presets"), F.coalesce(F.sum("n"), F.lit(0)).alias("variants")
    )
    return rows.withColumn("family", F.coalesce("family", F.lit("all")))


@query("A1_knobs_per_preset", f"WITH {AU_SQL} SELECT job, count(*) AS knobs FROM ch JOIN pr USING (effect_id) GROUP BY 1")
def knobs(spark, d):
    per = ci.params(spark, d).groupBy("effect_id").agg(F.count(F.lit(1)).alias("n"))
    return ci.steps(spark, d).join(per, "effect_id").groupBy("job").agg(F.sum("n").alias("knobs"))


@query("A2_facets", f"WITH {PRESET_SQL} SELECT DISTINCT 'family' AS facet, family AS value FROM pre UNION ALL SELECT DISTINCT 'decade', decade FROM pre WHERE decade IS NOT NULL")
def facets(spark, d):
    pre = ci.presets(spark, d).select("family", tx.decade(F.col("era")).alias("decade"))
    long = pre.select(F.explode(F.array(
        F.struct(F.lit("family").alias("facet"), F.col("family").alias("value")), F.struct(F.lit("decade").alias("facet"), F.col("decade").alias("value"))
    )).alias("f")).select("f.*")
    return long.filter("value IS NOT NULL").distinct().orderBy("facet", "value")


@query("A3_expected_vs_present", "SELECT p_brand AS pack, count(DISTINCT p_partkey) AS expected, count(l.k) AS present FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 48) l ON l.k = p_partkey GROUP BY 1")
def expected_present(spark, d):
    here = table(spark, d, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("here", F.lit(1))
    return doc.pack_status(table(spark, d, "part").withColumnRenamed("p_brand", "pack"), here, "pack", "p_partkey")


@query("T1_rank_sort", f"WITH {PRESET_SQL} SELECT preset_id, row_number() OVER (ORDER BY CASE family WHEN 'BUILDING' THEN 0 WHEN 'AUTOMOBILE' THEN 1 WHEN 'MACHINERY' THEN -1 ELSE 3 END, preset_id) - 1 AS place FROM pre")
def rank_sort(spark, d):
    order = ("BUILDING", "AUTOMOBILE", "MACHINERY")
    pre = ci.presets(spark, d).select("preset_id", ca.family_rank(F.col("family"), order, audio_first=True).alias("rank"))
    return se.index_rows(pre, [], ["rank", "preset_id"], "place").select("preset_id", "place")


@query("A20_ordered_distinct", f"WITH {PRESET_SQL} SELECT preset_id, min(pos) AS first_pos FROM (SELECT preset_id, c_custkey AS pos FROM pre WHERE c_acctbal > 8000 UNION ALL SELECT preset_id, 10000000 + c_custkey FROM pre) GROUP BY 1")
def ordered_distinct(spark, d):
    pre = ci.presets(spark, d)
    top = pre.filter("c_acctbal > 8000").select("preset_id", F.col("c_custkey").alias("pos"))
    shown = top.unionByName(pre.select("preset_id", (F.col("c_custkey") + 10000000).alias("pos")))
    return shown.groupBy("preset_id").agg(F.min("pos").alias("first_pos"))


@query("J21_saved_items", "SELECT o_orderkey AS saved, p_partkey AS base FROM orders JOIN part ON p_partkey = o_orderkey AND p_size > 25")
def saved_items(spark, d):
    base = table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("base"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("saved")).withColumn("base", F.col("saved")).join(base, "base", "left_semi").select("saved", "base")


NEAR_SQL = """names AS (SELECT DISTINCT p_name AS candidate FROM part), typo AS (SELECT DISTINCT substr(candidate, 1, 1) || substr(candidate, 3) AS asked FROM names),
rk AS (SELECT asked, candidate, levenshtein(asked, candidate) AS distance, row_number() OVER (PARTITION BY asked ORDER BY levenshtein(asked, candidate), candidate) AS rank FROM typo, names)"""


def suggestions(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("candidate")).distinct()
    typo = names.select(F.concat(F.left("candidate", F.lit(1)), F.expr("substr(candidate, 3)")).alias("asked")).distinct()
    return ca.closest(typo, names, "asked", "candidate", n=3)


@query("J20_fuzzy_suggestion", f"WITH {NEAR_SQL} SELECT asked, candidate, distance FROM rk WHERE rank = 1")
def fuzzy(spark, d):
    return suggestions(spark, d).filter("rank = 1").select("asked", "candidate", "distance")


@query("T4_closest_three", f"WITH {NEAR_SQL} SELECT asked, candidate, distance, rank::INTEGER AS rank FROM rk WHERE rank <= 3")
def closest_three(spark, d):
    return suggestions(spark, d).select("asked", "candidate", "distance", "rank")


# ── catalog documents ───────────────────────────────────────────────────

@query("S2_catalog_write", f"""WITH {AU_SQL}, st AS (SELECT job, pos, {{'pos': pos, 'which': which, 'effect_id': effect_id, 'params': list({{'param': param, 'value': value}} ORDER BY param)}} AS s
  FROM aut JOIN ch USING (job, which, effect_key, effect_id) GROUP BY job, which, effect_key, effect_id, pos)
SELECT job, to_json({{'chain': list(s ORDER BY pos)}})::VARCHAR AS document FROM st GROUP BY job""")
def catalog_write(spark, d):
    return doc.catalog_documents(ci.steps(spark, d), ci.authored(spark, d), "job", KEYS)


@query("S1_catalog_read", f"WITH {AU_SQL} SELECT job, which, pos, effect_id, param, value FROM aut JOIN ch USING (job, which, effect_key, effect_id)")
def catalog_read(spark, d):
    return doc.read_catalog_documents(doc.catalog_documents(ci.steps(spark, d), ci.authored(spark, d), "job", KEYS), "job")


@query("S9_catalog_report", f"""WITH {AU_SQL}, ln AS (SELECT job, which, pos, '- **' || effect_id || '** - ' || string_agg('`' || effect_key || '.' || param || '=' || value || '`', ', ' ORDER BY param) AS line
  FROM aut JOIN ch USING (job, which, effect_key, effect_id) GROUP BY job, which, effect_key, effect_id, pos)
SELECT job, which, pos, line FROM ln""")
def catalog_report(spark, d):
    return doc.report_lines(ci.steps(spark, d), ci.authored(spark, d), KEYS).select("job", "which", "pos", "line")


@query("S10_thumbnail_index", f"""WITH {PRESET_SQL} SELECT preset_id, preset_id || '.png' AS poster, CASE WHEN c_custkey % 4 = 0 THEN preset_id || '.webp' END AS anim, family = 'MACHINERY' AS audio_only FROM pre WHERE c_acctbal > 0""")
def thumbnail_index(spark, d):
    pre = ci.presets(spark, d)
    posters = pre.filter("c_acctbal > 0").select(F.concat("preset_id", F.lit(".png")).alias("name"))
    anims = pre.filter("c_custkey % 4 = 0").select(F.concat("preset_id", F.lit(".webp")).alias("name"))
    return doc.thumbnail_index(pre.withColumn("audio_only", F.col("family") == "MACHINERY"), posters, anims, "preset_id", ".png", ".webp")


@query("J19_job_matrix", f"WITH {PRESET_SQL} SELECT preset_id, CASE WHEN family = 'BUILDING' THEN 'AMERICA' ELSE 'ASIA' END AS sample, n.n_name AS take FROM pre p JOIN (SELECT n_name, r_name AS rn FROM nation JOIN region ON r_regionkey = n_regionkey) n ON n.rn = CASE WHEN family = 'BUILDING' THEN 'AMERICA' ELSE 'ASIA' END")
def job_matrix(spark, d):
    takes = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    takes = takes.select(F.col("r_name").alias("sample"), F.col("n_name").alias("take"))
    pre = ci.presets(spark, d).withColumn("sample", F.when(F.col("family") == "BUILDING", "AMERICA").otherwise("ASIA"))
    return pre.join(takes, "sample").select("preset_id", "sample", "take")

"""Registered queries over clips, jobs, texts, releases, colours and codebooks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cuelattice.functions import scalars as sc, text as tx
from cuelattice.operators import aggregates as ag, assignment as an, series as se
from cuelattice.plans.catalog_inputs import CH_SQL, steps
from cuelattice.plans.inputs import S_SQL, event_series, table, timed_events
from cuelattice.plans.registry import query
from cuelattice.session import spread
from cuelattice.sources import documents as doc, layers as ly, probe as pb

def X():
    return F.col("x")


# ── clips and jobs ──────────────────────────────────────────────────────

def probe_docs(spark, d):
    """Parts as probe documents: cover art, stills, pictures and sound in changing mixes."""
    p = table(spark, d, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    opt = lambda when, text: F.when(when, text)
    art = opt(size % 3 == 0, F.lit('{"codec_type":"video","disposition":{"attached_pic":1},"avg_frame_rate":"0/0","nb_frames":"1","width":9,"height":9}'))
    still = opt(size % 5 == 0, F.lit('{"codec_type":"video","avg_frame_rate":"0/0","width":8,"height":8}'))
    rate = F.when(k % 2 == 0, "30000/1001").otherwise("25/1")
    frames = F.when(k % 4 == 0, F.concat(F.lit(',"nb_frames":"'), (size * 10).cast("string"), F.lit('"'))).otherwise(F.lit(""))
    video = opt(k % 7 != 0, F.concat(
        F.lit('{"codec_type":"video","disposition":{"attached_pic":0},"avg_frame_rate":"25/1","r_frame_rate":"'), rate, F.lit('"'), frames,
        F.lit(',"width":'), (size * 20 + 320).cast("string"), F.lit(',"height":'), (size * 16 + 240).cast("string"), F.lit(',"duration":"'), size.cast("string"),
        F.lit('.5","color_space":"'), F.when(size % 2 == 0, "smpte170m").otherwise("unknown"), F.lit('"}'),
    ))
    audio = opt(k % 3 != 0, F.concat(F.lit('{"codec_type":"audio","sample_rate":"'), F.when(size % 2 == 0, "44100").otherwise("48000"),
                                     F.lit('","duration":"7.25"'), F.when(size % 4 == 0, F.lit(',"channels":1')).otherwise(F.lit("")), F.lit("}")))
    streams = F.array_join(F.filter(F.array(art, still, video, audio), lambda s: s.isNotNull()), ",")
    fmt = F.when(k % 5 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"duration":"'), size.cast("string"), F.lit('.75"}')))
    return p.select(k.alias("path"), F.concat(F.lit('{"streams":['), streams, F.lit('],"format":'), fmt, F.lit("}")).alias("doc"))


@query("S3_probe_normalise", """SELECT path, CASE WHEN NOT v AND NOT a THEN 'no video or audio stream' END AS error, CASE WHEN v THEN sz * 20 + 320 ELSE 0 END AS width, CASE WHEN v THEN sz * 16 + 240 ELSE 0 END AS height,
 round(fps, 6) AS fps, duration, CASE WHEN v AND path % 4 = 0 THEN sz * 10 ELSE greatest(round_even(duration * fps, 0), 1) END::BIGINT AS n_frames, v AS has_video, a AS has_audio,
 CASE WHEN a AND sz % 2 = 0 THEN 44100 ELSE 48000 END AS sr, CASE WHEN a AND sz % 4 = 0 THEN 1 ELSE 2 END AS channels, CASE WHEN v THEN CASE WHEN sz % 2 = 0 THEN 'smpte170m' ELSE 'unknown' END ELSE '' END AS color_space
 FROM (SELECT *, CASE WHEN path % 5 <> 0 THEN sz + 0.75 WHEN v THEN sz + 0.5 WHEN a THEN 7.25 ELSE 0 END::DOUBLE AS duration, CASE WHEN NOT v THEN 30.0 WHEN path % 2 = 0 THEN 30000.0 / 1001 ELSE 25.0 END::DOUBLE AS fps
 FROM (SELECT p_partkey AS path, p_size AS sz, p_partkey % 7 <> 0 AS v, p_partkey % 3 <> 0 AS a FROM part))""")
def probe_normalise(spark, d):
    return pb.normalise(probe_docs(spark, d), "path", "doc").withColumn("fps", F.round("fps", 6))


def layer_specs(spark, d):
    """Orders as layer specs: none to three layers, some disabled, some broken."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    one = lambda i: F.concat(
        F.lit('{"preset":"'), F.when((k % 13 == 0) & (F.lit(i) == 1), "").otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))), F.lit('"'),
        F.when((k + i) % 4 == 0, F.lit(',"enabled":false')).otherwise(F.lit("")),
        F.when((k + i) % 3 == 0, F.lit(f',"seed":{i + 5},"intensity":0.5')).otherwise(F.lit("")),
        F.lit(f',"sets":{{"a_gain.db":"-{i}"}},"events":[{{"op":"move","id":"e{i}","t":1.5}},7]}}'),
    )
    items = F.array_join(F.slice(F.array(one(1), one(2), one(3)), F.lit(1), (k % 4).cast("int")), ",")
    return o.select(k.alias("job"), F.concat(F.lit("["), items, F.lit("]")).alias("spec"))


L_SQL = """l AS (SELECT o_orderkey AS job, i.i AS i, CASE WHEN o_orderkey % 13 = 0 AND i.i = 1 THEN '' ELSE 'c' || o_custkey END AS preset, (o_orderkey + i.i) % 4 <> 0 AS enabled, (o_orderkey + i.i) % 3 = 0 AS tuned
 FROM orders JOIN range(1, 4) i(i) ON i.i <= o_orderkey % 4), st AS (SELECT o_orderkey AS job, count(i) AS n, bool_or(preset = '') AS bad, bool_or(enabled) AS any_on FROM orders LEFT JOIN l ON job = o_orderkey GROUP BY 1)"""


@query("S4_layer_specs", f"WITH {L_SQL} SELECT job, (row_number() OVER (PARTITION BY job ORDER BY i) - 1)::INTEGER AS layer_pos, preset AS preset_id, CASE WHEN tuned THEN i + 5 ELSE 1 END AS seed, CASE WHEN tuned THEN 0.5 ELSE 1.0 END::DOUBLE AS intensity, 1.0::DOUBLE AS texture, 1 AS n_edits FROM l JOIN st USING (job) WHERE enabled AND NOT bad")
def layer_rows(spark, d):
    layers, _ = ly.read_layers(layer_specs(spark, d), "job", "spec")
    return layers.select("job", "layer_pos", "preset_id", "seed", "intensity", "texture", F.size("edits").alias("n_edits"))


@query("S4_layer_rejects", f"WITH {L_SQL} SELECT job, CASE WHEN n = 0 THEN 'empty' WHEN bad THEN 'no preset' ELSE 'all disabled' END AS error FROM st WHERE n = 0 OR bad OR NOT any_on")
def layer_rejects(spark, d):
    return ly.read_layers(layer_specs(spark, d), "job", "spec")[1]


@query("S6_picture_inventory", "SELECT p_brand AS pack, p_name || '-' || p_partkey || CASE p_size % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.jpeg' END AS name FROM part WHERE p_size % 4 <> 3")
def picture_inventory(spark, d):
    ext = F.element_at(F.array(*[F.lit(e) for e in (".png", ".JPG", ".jpeg", ".txt")]), F.col("p_size") % 4 + 1)
    paths = table(spark, d, "part").select(F.concat(F.lit("/packs/"), "p_brand", F.lit("/"), "p_name", F.lit("-"), F.col("p_partkey").cast("string"), ext).alias("path"))
    return doc.pictures(paths, "path").select("pack", "name").orderBy("pack", "name")


@query("A4_store_totals", "SELECT count(*) AS files, coalesce(sum(p_size), 0)::BIGINT AS bytes, max(p_partkey) AS newest FROM part")
def store_totals(spark, d):
    return doc.store_totals(table(spark, d, "part"), "p_size", "p_partkey")


@query("A5_batch_progress", """SELECT o_custkey AS batch, round(coalesce(avg(CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderstatus IN ('F') THEN 1.0 WHEN o_orderstatus = 'P' THEN (o_orderkey % 100) / 100.0 ELSE 0.0 END), 0), 6) AS progress FROM orders GROUP BY 1""")
def batch_progress(spark, d):
    state = F.when(F.col("o_orderpriority") == "5-LOW", "cancelled").when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "running").otherwise("queued")
    p = ag.batch_progress(state, F.col("o_orderkey") % 100 / 100.0)
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("batch")).agg(F.round(p, 6).alias("progress"))


@query("A15_health_check", """SELECT job, CASE WHEN abs(d - n) > 3 THEN 'duration' WHEN na = 0 THEN 'no audio' WHEN coalesce(mx, 0) < 0.3 THEN 'near black' ELSE 'ok' END AS verdict
 FROM (SELECT o_orderkey AS job, any_value(o_orderkey % 8) AS d, count(l_orderkey) AS n, count(*) FILTER (l_returnflag = 'A') AS na, max(l_quantity / 50) FILTER (l_linenumber <= 3) AS mx FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)""")
def health_check(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), (F.col("o_orderkey") % 8).alias("want"))
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("l_returnflag") == "A", 1)).alias("sound"),
        F.max(F.when(F.col("l_linenumber") <= 3, F.col("l_quantity") / 50)).alias("bright"),
        F.max(F.isnan("l_quantity")).alias("broken"),
    )
    rows = o.join(li, "job", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    verdict = ag.health(F.abs(F.col("want") - F.col("n")) > 3, F.coalesce("sound", F.lit(0)) > 0, F.col("bright"), 0.3, F.coalesce("broken", F.lit(False)))
    return rows.select("job", verdict.alias("verdict"))


@query("P11_window_trim", """SELECT o_orderkey AS job, round(least(coalesce(req, rest), rest), 6) AS duration, greatest(round_even(least(coalesce(req, rest), rest) * 24.0, 0), 1)::BIGINT AS n_frames
 FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 400 + 0.37 END AS req, greatest(o_totalprice / 1000 - o_custkey % 300, 0.1) AS rest FROM orders)""")
def window_trim(spark, d):
    req = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 400 + 0.37)
    dur = sc.trimmed_duration(F.col("o_totalprice") / 1000, F.col("o_custkey") % 300, req)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), sc.r6(dur).alias("duration"), sc.frames_of(dur, F.lit(24.0)).alias("n_frames"))


@query("P12_preview_window", "SELECT o_orderkey AS job, round(coalesce(CASE WHEN o_orderkey % 4 = 0 THEN o_custkey / 10.0 END, greatest((o_totalprice / 1000 - 3.0) / 2.0, 0)), 6) AS start FROM orders")
def preview_window(spark, d):
    at = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey") / 10.0)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), sc.r6(sc.preview_start(F.col("o_totalprice") / 1000, at)).alias("start"))


EVEN = lambda e: f"greatest(round_even(({e}) / 2.0, 0) * 2, 2)"


@query("P13_geometry", f"""SELECT p_partkey, ow::BIGINT AS out_w, oh::BIGINT AS out_h, (CASE WHEN ph < oh THEN {EVEN('ow * (' + EVEN('ph') + ') / oh')} ELSE ow END)::BIGINT AS proc_w, (CASE WHEN ph < oh THEN {EVEN('ph')} ELSE oh END)::BIGINT AS proc_h
 FROM (SELECT p_partkey, {EVEN('floor((p_size * 37 + 320) * 0.75)')} AS ow, {EVEN('floor((p_size * 23 + 240) * 0.75)')} AS oh, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 900 + 1 END AS ph FROM part)""")
def geometry(spark, d):
    p = table(spark, d, "part")
    era = F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey") % 900 + 1)
    g = sc.geometry(F.col("p_size") * 37 + 320, F.col("p_size") * 23 + 240, F.lit(0.75), era)
    return p.select("p_partkey", *[g[n].alias(n) for n in ("out_w", "out_h", "proc_w", "proc_h")])


@query("P14_frame_conversion", f"WITH {S_SQL} SELECT event_id, (round_even(k * 0.3 * 24.0, 0) + idx)::BIGINT AS abs_frame, round_even((t - 3600.0 * k) * 24.0, 0)::BIGINT AS frame FROM s")
def frame_conversion(spark, d):
    fps = F.lit(24.0)
    return event_series(spark, d).select(
        "event_id", sc.abs_frame(F.col("k") * 0.3, fps, F.col("idx")).alias("abs_frame"), sc.frame_of(F.col("t"), F.col("k") * 3600.0, fps).alias("frame")
    )


@query("P20_lead_in", f"""WITH {CH_SQL} SELECT job, round(CASE WHEN m > 0 THEN least(m + 0.4, 4.0) ELSE 0.0 END, 6) AS lead FROM (SELECT job, max(CASE WHEN effect_id = 'Brand#1' THEN q / 10 WHEN effect_id IN ('Brand#2', 'Brand#3') AND rf = 'A' THEN coalesce(nullif(tx * 30, 0), 1.2) ELSE 0 END) AS m FROM ch WHERE which = 'video' GROUP BY 1)""")
def lead_in(spark, d):
    junk = F.when(F.col("effect_id") == "Brand#1", F.col("q") / 10)
    deck = F.when(F.col("effect_id").isin("Brand#2", "Brand#3") & (F.col("rf") == "A"), F.coalesce(F.nullif(F.col("tx") * 30, F.lit(0.0)), F.lit(1.2)))
    m = F.max(F.coalesce(junk, deck, F.lit(0.0)))
    rows = steps(spark, d).filter("which = 'video'").groupBy("job").agg(m.alias("m"))
    return rows.select("job", sc.r6(F.when(F.col("m") > 0, F.least(F.col("m") + 0.4, F.lit(4.0))).otherwise(0.0)).alias("lead"))


@query("W22_layer_handoff", f"""WITH l AS (SELECT l_orderkey AS job, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS pos FROM lineitem)
 SELECT job, pos, (CASE WHEN pos = 0 THEN o_orderkey % 1000 + 320 ELSE ow END)::BIGINT AS in_w, ow::BIGINT AS out_w, CASE WHEN pos = 0 THEN o_custkey / 10.0 ELSE 0.0 END AS t0, o_custkey / 10.0 AS clip_t0
 FROM l JOIN (SELECT *, {EVEN('floor((o_orderkey % 1000 + 320) * 0.6)')} AS ow FROM orders) o ON o_orderkey = job""")
def layer_handoff(spark, d):
    from cuelattice.plans.event_layers import hand_off

    clips = table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), (F.col("o_orderkey") % 1000 + 320).alias("width"), (F.col("o_custkey") / 10.0).alias("clip_t0"), F.lit(0.6).alias("scale"))
    return hand_off(steps(spark, d).select("job", "pos"), clips, "job")


@query("W28_phase_progress", f"""WITH {S_SQL} SELECT series_id, idx, round(coalesce(max(v) OVER (PARTITION BY series_id ORDER BY idx), 0.0), 6) AS progress FROM (SELECT series_id, idx,
 CASE event_type WHEN 'click' THEN 0.86 * least(k / 90.0, 1.0) WHEN 'view' THEN 0.86 + 0.11 * least(k / 90.0, 1.0) WHEN 'purchase' THEN 0.97 + 0.03 * least(k / 90.0, 1.0) WHEN 'signup' THEN 1.0 END / 1.0 * (CASE WHEN idx < 40 AND event_type <> 'click' THEN NULL ELSE 1 END) AS v FROM s)""")
def phase_progress(spark, d):
    from cuelattice.plans.event_layers import phase_position

    names = {"click": "video", "view": "audio", "purchase": "mux", "signup": "done"}
    phase = F.col("event_type")
    for a, b in names.items():
        phase = F.when(F.col("event_type") == a, b).otherwise(phase)
    phase = F.when((F.col("idx") < 40) & (F.col("event_type") != "click"), "unknown").otherwise(phase)
    weights = [("video", 0.86), ("audio", 0.11), ("mux", 0.03), ("done", 0.0)]
    s = event_series(spark, d).withColumn("v", phase_position(phase, F.col("k") / 90.0, weights))
    out = se.running_max(s, ["series_id"], F.col("v"), "progress")
    return out.select("series_id", "idx", sc.r6(F.coalesce("progress", F.lit(0.0))).alias("progress"))


@query("S11_progress_log", """SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_type END AS phase, CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS DOUBLE) / 100 END AS progress FROM events""")
def progress_log(spark, d):
    from cuelattice.streaming.twins import parse_progress

    k = F.get_json_object("props", "$.k").cast("double") / 100
    line = F.when(F.col("event_id") % 17 == 0, "not json").otherwise(F.to_json(F.struct(F.col("event_type").alias("phase"), k.alias("progress"))))
    return parse_progress(table(spark, d, "events").select("event_id", line.alias("value")), ["event_id"])


# ── releases ────────────────────────────────────────────────────────────

TAG_SQL = "CASE p_partkey % 9 WHEN 0 THEN 'nightly' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'v' ELSE '' END || p_size || '.' || p_partkey % 10 || '.' || p_partkey // 10 || CASE WHEN p_partkey % 5 = 0 THEN '-rc1' ELSE '' END END"
R_SQL = f"""rel AS MATERIALIZED (SELECT p_partkey, {TAG_SQL} AS tag, p_partkey % 11 = 0 AS draft, p_size AS a, p_partkey % 10 AS b, p_partkey // 10 AS c, p_partkey % 9 <> 0 AS ok FROM part)"""


def releases(spark, d):
    k = F.col("p_partkey")
    tag = F.when(k % 9 == 0, "nightly").otherwise(F.concat(
        F.when(k % 2 == 0, "v").otherwise(""), F.col("p_size").cast("string"), F.lit("."), (k % 10).cast("string"), F.lit("."), F.floor(k / 10).cast("string"), F.when(k % 5 == 0, "-rc1").otherwise("")
    ))
    return table(spark, d, "part").select("p_partkey", tag.alias("tag"), (k % 11 == 0).alias("draft"), "p_name")


@query("F11_version_compare", f"WITH {R_SQL} SELECT p_partkey, (CASE WHEN ok THEN a ELSE -1 END)::BIGINT AS major, (CASE WHEN ok THEN c ELSE -1 END)::BIGINT AS patch, CASE WHEN NOT ok THEN 'unknown' WHEN (a, b, c) > (25, 5, 100) THEN 'newer' WHEN (a, b, c) < (25, 5, 100) THEN 'older' ELSE 'current' END AS direction FROM rel")
def version_compare(spark, d):
    v = sc.version_parts(F.col("tag"))
    return releases(spark, d).select("p_partkey", F.coalesce(v["major"], F.lit(-1)).alias("major"), F.coalesce(v["patch"], F.lit(-1)).alias("patch"), sc.version_direction(F.col("tag"), F.lit("v25.5.100")).alias("direction"))


@query("P17_release_eligible", f"WITH {R_SQL} SELECT p_partkey, tag FROM rel WHERE ok AND NOT draft")
def release_eligible(spark, d):
    return releases(spark, d).filter(~F.col("draft") & sc.version_parts(F.col("tag")).isNotNull()).select("p_partkey", "tag")


@query("T3_release_list", f"WITH {R_SQL} SELECT p_partkey, tag FROM rel WHERE ok AND NOT draft ORDER BY a DESC, b DESC, c DESC, p_partkey LIMIT 30")
def release_list(spark, d):
    r = releases(spark, d).withColumn("v", sc.version_parts(F.col("tag"))).filter("NOT draft AND v IS NOT NULL")
    return r.orderBy(F.col("v").desc(), "p_partkey").limit(30).select("p_partkey", "tag")


@query("T6_platform_asset", f"WITH {CH_SQL} SELECT job, suffix, arg_min('app-' || pos || suffix, pos) AS asset FROM (SELECT job, pos, CASE WHEN q < 15 THEN '-mac-arm64.zip' WHEN q < 30 THEN '-win-x64-setup.exe' END AS suffix FROM ch) WHERE suffix IS NOT NULL GROUP BY 1, 2")
def platform_asset(spark, d):
    ext = F.when(F.col("q") < 15, "-mac-arm64.zip").when(F.col("q") < 30, "-WIN-x64-setup.exe").otherwise(".txt")
    assets = steps(spark, d).select("job", "pos", F.concat(F.lit("app-"), F.col("pos").cast("string"), F.lower(ext)).alias("name"))
    return doc.first_assets(assets, "job", "pos", "name", ["-mac-arm64.zip", "-win-x64-setup.exe"])


@query("U4_missing_and_present", "SELECT p_partkey, 'present' AS state FROM (SELECT p_partkey FROM part INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 40) UNION ALL SELECT p_partkey, 'missing' FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def missing_present(spark, d):
    want = table(spark, d, "part").select("p_partkey")
    have = table(spark, d, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return want.intersect(have).withColumn("state", F.lit("present")).unionByName(want.exceptAll(want.intersect(have)).withColumn("state", F.lit("missing")))


@query("P19_release_label", """SELECT job, CASE WHEN skip AND hits > 0 THEN NULL WHEN skip THEN 'none' WHEN hits = 1 THEN CASE WHEN mj THEN 'major' WHEN mn THEN 'minor' ELSE 'patch' END END AS label,
 CASE WHEN skip AND hits > 0 THEN 'skip with others' WHEN NOT skip AND hits = 0 THEN 'no label' WHEN NOT skip AND hits > 1 THEN 'several labels' END AS error
 FROM (SELECT *, mj::INT + mn::INT + pt::INT AS hits FROM (SELECT l_orderkey AS job, bool_or(l_returnflag = 'A' AND l_quantity < 25) AS mj, bool_or(l_returnflag = 'N' AND l_quantity < 25) AS mn, bool_or(l_returnflag = 'R' AND l_quantity < 25) AS pt, bool_or(l_quantity > 45) AS skip FROM lineitem GROUP BY 1))""")
def release_label(spark, d):
    li = table(spark, d, "lineitem")
    low = F.col("l_quantity") < 25
    name = F.when(F.col("l_quantity") > 45, " Skip ").when(low & (F.col("l_returnflag") == "A"), "Major").when(low & (F.col("l_returnflag") == "N"), "minor").when(low & (F.col("l_returnflag") == "R"), "patch").otherwise("chore")
    return doc.release_label(li.select(F.col("l_orderkey").alias("job"), name.alias("label")), "job", "label", ["major", "minor", "patch"], "skip")


# ── links and texts ─────────────────────────────────────────────────────

def link_texts(spark, d):
    """Pages as texts of review threads, each with a picture link in one of three spellings."""
    k = F.col("page_id")
    to = F.regexp_replace("url", "^https?", "https")
    tail = F.when(k % 3 == 0, F.concat(F.lit(" ![shot]("), to, F.lit(".png) "))).when(
        k % 3 == 1, F.concat(F.lit(' <img width="3" src="'), to, F.lit('.jpg"> '))
    ).otherwise(F.concat(F.lit(" see "), to, F.lit(".webp. ")))
    return table(spark, d, "pages").select(F.floor(k / 10).cast("long").alias("thread"), (k % 10).alias("i"), F.concat("html", tail).alias("text"))


@query("A21_image_links", """WITH t AS (SELECT page_id // 10 AS thread, page_id % 10 AS i, page_id % 3 AS m, regexp_replace(url, '^https?', 'https') || CASE page_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' ELSE '.webp' END AS url FROM pages)
 SELECT thread, url, min(i) AS first_text, bool_or(i = 0 AND m <> 2) AS inline FROM t GROUP BY 1, 2""")
def image_links(spark, d):
    rows = link_texts(spark, d).select("thread", "i", F.posexplode(tx.image_links(F.col("text"), F.col("i") == 0)).alias("pos", "l")).select("thread", "i", "pos", "l.*")
    rows = rows.filter(tx.is_image_url(F.col("url")))
    return rows.groupBy("thread", "url").agg(F.min(F.struct("i", "pos"))["i"].alias("first_text"), F.max("is_inline").alias("inline"))


@query("P18_link_eligibility", "SELECT page_id, url LIKE 'https://%' AND page_id % 4 < 2 AS eligible FROM pages")
def link_eligibility(spark, d):
    k = F.col("page_id") % 4
    url = F.when(k == 0, F.concat("url", F.lit(".PNG?v=2"))).when(k == 1, F.concat("url", F.lit("/user-images.githubusercontent.com/1"))).otherwise(F.concat("url", F.lit(".pngx")))
    return table(spark, d, "pages").select("page_id", tx.is_image_url(url).alias("eligible"))


@query("F20_body_clean", r"""SELECT page_id, length(b) AS n, md5(b) AS h FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(html, '</p>', '</p>' || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10)), '<!--.*?-->', '', 'gs'), '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS b FROM pages)""")
def body_clean(spark, d):
    raw = F.regexp_replace("html", "</p>", "</p>\r\n\r\n\r\n")
    b = tx.clean_body(raw)
    return table(spark, d, "pages").select("page_id", F.length(b).cast("long").alias("n"), F.md5(b).alias("h"))


@query("F14_tagline", r"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN source WHEN length(t) <= 45 THEN t ELSE regexp_replace(CASE WHEN sp > 28 THEN substr(h, 1, sp) ELSE h END, '[\s,;:.\-–—]+$', '') || '…' END AS tagline
 FROM (SELECT *, CASE WHEN contains(h, ' ') THEN length(h) - strpos(reverse(h), ' ') ELSE -1 END AS sp FROM (SELECT *, substr(t, 1, 44) AS h FROM (SELECT doc_id, source, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)))""")
def tagline(spark, d):
    own = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" "), F.col("source")))
    return table(spark, d, "documents").select("doc_id", tx.tagline(own, F.col("text")).alias("tagline"))


@query("F19_slug", r"SELECT doc_id, CASE WHEN s = '' THEN 'custom' ELSE s END AS slug FROM (SELECT doc_id, substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS s FROM documents)")
def slug(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.slug(F.col("text")).alias("slug"))


MOST = 64
CHUNK_SQL = rf"""pa AS (SELECT doc_id, unnest(regexp_split_to_array(replace(text, chr(13), ''), '\n\s*\n+')) AS p, generate_subscripts(regexp_split_to_array(replace(text, chr(13), ''), '\n\s*\n+'), 1) AS pn FROM documents),
 fl AS (SELECT doc_id, pn, trim(regexp_replace(p, '\s*\n\s*', ' ', 'g'), ' ' || chr(9)) AS f FROM pa),
 se AS MATERIALIZED (SELECT doc_id, pn, list_filter(list_transform(regexp_extract_all(f, '[^.!?]+[.!?]+["'')\]]*\s*|[^.!?]+$'), lambda x: trim(x)), lambda x: x <> '') AS ss, f FROM fl WHERE f <> ''),
 s2 AS MATERIALIZED (SELECT doc_id, pn, CASE WHEN len(ss) = 0 THEN [f] ELSE ss END AS ss FROM se),
 w AS (SELECT doc_id, pn, ''::VARCHAR AS cur, 1 AS si, 0 AS step, NULL::VARCHAR AS o FROM s2
  UNION ALL SELECT w.doc_id, w.pn,
   CASE WHEN length(cur) > {MOST} THEN trim(substr(cur, cut + 1)) WHEN si > len(ss) THEN NULL WHEN cur = '' OR length(cur) + 1 + length(ss[si]) > {MOST} THEN ss[si] ELSE cur || ' ' || ss[si] END,
   CASE WHEN length(cur) > {MOST} OR si > len(ss) THEN si ELSE si + 1 END, step + 1,
   CASE WHEN length(cur) > {MOST} THEN trim(substr(cur, 1, cut)) WHEN si > len(ss) THEN nullif(cur, '') WHEN cur <> '' AND length(cur) + 1 + length(ss[si]) > {MOST} THEN cur END
  FROM (SELECT w1.*, ss, CASE WHEN length(cur) - c1 < 12 AND bk > {MOST * 0.4} THEN bk ELSE c1 END AS cut FROM
   (SELECT *, CASE WHEN c0 < {MOST * 0.4} THEN {MOST} ELSE c0 END AS c1 FROM
    (SELECT *, CASE WHEN contains(substr(cur, 1, {MOST} + 1), ' ') THEN length(substr(cur, 1, {MOST} + 1)) - strpos(reverse(substr(cur, 1, {MOST} + 1)), ' ') ELSE -1 END AS c0,
      CASE WHEN length(cur) > 11 AND contains(substr(cur, 1, length(cur) - 11), ' ') THEN length(cur) - 11 - strpos(reverse(substr(cur, 1, length(cur) - 11)), ' ') ELSE -1 END AS bk FROM w WHERE cur IS NOT NULL)) w1 JOIN s2 USING (doc_id, pn)) w),
 ck AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pn, step) - 1 AS pos, o AS chunk FROM w WHERE o IS NOT NULL)"""


def script_chunks(spark, d):
    docs = spread(table(spark, d, "documents"), "doc_id")
    return docs.select("doc_id", F.col("n_chars"), F.posexplode(tx.script_chunks(F.col("text"), MOST)).alias("pos", "chunk"))


@query("F22_script_chunks", f"WITH RECURSIVE {CHUNK_SQL} SELECT doc_id, pos, chunk FROM ck")
def chunks(spark, d):
    return script_chunks(spark, d).select("doc_id", F.col("pos").cast("long").alias("pos"), "chunk")


@query("W19_cue_slots", f"""WITH RECURSIVE {CHUNK_SQL}, sl AS (SELECT *, greatest(length(chunk), 8) AS w, sum(greatest(length(chunk), 8)) OVER (PARTITION BY doc_id ORDER BY pos) AS cw, sum(greatest(length(chunk), 8)) OVER (PARTITION BY doc_id) AS tw, greatest(n_chars / 12.0 - 0.2, 1) AS us FROM ck JOIN documents USING (doc_id)),
 s3 AS (SELECT *, us * (w / tw) AS slot, greatest(1.0, length(chunk) / 14.0) AS rd, 0.1 + us * ((cw - w) / tw) AS t0 FROM sl)
 SELECT doc_id, pos, round(floor(t0 * 20 + 0.5) / 20, 2) AS t, round(greatest(floor(greatest(least(slot - least(0.35, slot * 0.12), rd * 1.6), least(0.8, slot * 0.8)) * 20 + 0.5) / 20, 0.3), 2) AS dur_s FROM s3""")
def cue_slots(spark, d):
    c = script_chunks(spark, d)
    return tx.slot_times(c, ["doc_id"], F.col("n_chars") / 12.0).select("doc_id", F.col("pos").cast("long").alias("pos"), F.round("t", 2).alias("t"), F.round("dur_s", 2).alias("dur_s"))


def wrap_sql(width: str) -> str:
    """CTE ``ln`` (doc_id, width, para, run, part, line): wrapped lines, by least squared slack over every run of words.

    A run is folded from its end; the fold keeps the next 22 words with the least cost and the lines from each on. A line holds no more words.
    """
    wide = "(x[1].n + coalesce(list_sum(list_transform(a[1:m], lambda y: y.n + 1)), 0))"
    costs = f"list_transform(range(0, least(len(a), 21)), lambda m: {{'c': CASE WHEN m = 0 OR {wide} <= width THEN pow(greatest(width - {wide}, 0), 2) + a[m + 1].c ELSE 1e300 END, 'm': m}})"
    state = "{'n': x[1].n, 'w': x[1].w, 'c': b.c, 's': x[1].w || coalesce(' ' || nullif(array_to_string(list_transform(a[1:b.m], lambda y: y.w), ' '), ''), '') || CASE WHEN a[b.m + 1].n = 0 THEN '' ELSE chr(10) || a[b.m + 1].s END}"
    return f"""pa AS (SELECT doc_id, {width} AS width, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS para FROM documents),
 w0 AS (SELECT doc_id, width, para, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT *, list_filter(string_split_regex(p, '\\s+'), lambda x: x <> '') AS ws FROM pa)),
 w1 AS (SELECT *, (length(w) - 1) // width * width AS stop FROM w0),
 w2 AS (SELECT *, sum(CASE WHEN stop > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, para ORDER BY i) AS run FROM w1),
 rn AS (SELECT doc_id, width, para, run, list([{{'n': length(w) - stop, 'w': substr(w, (stop + 1)::INT), 'c': 0.0::DOUBLE, 's': ''}}] ORDER BY i DESC) AS els, any_value(substr(w, 1, stop::INT)) FILTER (stop > 0) AS head FROM w2 GROUP BY 1, 2, 3, 4),
 dp AS (SELECT doc_id, width, para, run, head, list_reduce(list_prepend([{{'n': 0::BIGINT, 'w': '', 'c': 0.0::DOUBLE, 's': ''}}], els), lambda a, x: list_prepend(list_transform([list_min({costs})], lambda b: {state})[1], a)[1:22])[1].s AS s FROM rn),
 ln AS MATERIALIZED (SELECT doc_id, width, para, run, 0 AS k, j.j AS part, substr(head, (j.j * width + 1)::INT, width::INT) AS line FROM dp, range(0, 2000) j(j) WHERE j.j < coalesce(length(head) // width, 0)
  UNION ALL SELECT doc_id, width, para, run, 1, unnest(range(0, len(string_split(s, chr(10))))), unnest(string_split(s, chr(10))) FROM dp
  UNION ALL SELECT doc_id, width, para, 0, 0, 0, '' FROM pa WHERE regexp_replace(p, '\\s', '', 'g') = ''),
 kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para, run, k, part) - 1 AS line_no, max(CASE WHEN line <> '' THEN para END) OVER (PARTITION BY doc_id) AS last FROM ln)"""


KEPT_SQL = "(para <= coalesce(last, 1))"


@query("F21_balanced_wrap", f"WITH {wrap_sql('(doc_id % 33 + 8)')} SELECT doc_id, count(*) AS n_lines, sum(pow(width - length(line), 2))::BIGINT AS slack, bool_and(length(line) <= width) AS fits FROM kept WHERE {KEPT_SQL} GROUP BY 1")
def balanced_wrap(spark, d):
    width = (F.col("doc_id") % 33 + 8).cast("int")
    docs = spread(table(spark, d, "documents"), "doc_id").select("doc_id", width.alias("width"), tx.wrapped(F.col("text"), width).alias("lines"))
    gap = F.transform("lines", lambda x: (F.col("width") - F.length(x)).cast("long"))
    slack = F.aggregate(gap, F.lit(0).cast("long"), lambda a, x: a + x * x)
    return docs.select("doc_id", F.size("lines").cast("long").alias("n_lines"), slack.alias("slack"), F.forall("lines", lambda x: F.length(x) <= F.col("width")).alias("fits"))


@query("X2_wrapped_lines", f"WITH {wrap_sql('32')} SELECT doc_id, line_no, line FROM kept WHERE {KEPT_SQL}")
def wrapped_lines(spark, d):
    docs = spread(table(spark, d, "documents"), "doc_id")
    return docs.select("doc_id", F.posexplode(tx.wrapped(F.col("text"), F.lit(32))).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


@query("S7_subtitle_read", r"""SELECT conv_id, turn, t, dur_s, body AS text FROM (SELECT conv_id, turn, trim(regexp_replace(text, '[<>\r\n]+', ' ', 'g')) AS body,
 unnest([{'t': 1.5, 'dur_s': 1.75}, {'t': floor((turn * 3 + 0.43) * 20 + 0.5) / 20 + 3600, 'dur_s': 2.5}], recursive := true) FROM conversations) WHERE body <> ''""")
def subtitle_read(spark, d):
    body = F.regexp_replace("text", r"[<>\r\n]+", " ")
    at = F.col("turn") * 3
    stamp = lambda s: F.format_string("01:%02d:%02d", F.floor(s / 60).cast("long"), s % 60)
    srt = F.concat(
        F.lit("1\r\n00:00:01,5 --> 00:00:03.25\r\n<i>"), body, F.lit("</i>\r\n\r\n2\r\n"), stamp(at), F.lit(",430 --> "), stamp(at + 2), F.lit(".93\n17\n"), body, F.lit("\n\n")
    )
    c = table(spark, d, "conversations").select("conv_id", "turn", F.explode(tx.parse_srt(srt)).alias("c"))
    return c.select("conv_id", "turn", "c.*")


@query("F13_decade", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE ((1900 + p_size + p_partkey % 90) // 10 * 10) || 's' END AS decade FROM part")
def decade(spark, d):
    year = (F.lit(1900) + F.col("p_size") + F.col("p_partkey") % 90).cast("string")
    era = F.when(F.col("p_partkey") % 4 == 0, "late").otherwise(F.concat(F.lit(" "), year, F.lit("-ish")))
    return table(spark, d, "part").select("p_partkey", tx.decade(era).alias("decade"))


@query("F15_timecode", """SELECT event_id, CASE WHEN t >= 60 THEN t // 60 || ':' || CASE WHEN t % 60 < 10 THEN '0' ELSE '' END || t % 60 || '.5' ELSE t || '.5' END AS code, t + 0.5 AS parsed, CASE WHEN event_id % 2 = 0 THEN NULL ELSE t::DOUBLE END AS bare
 FROM (SELECT event_id, CAST(floor(value * 3) AS BIGINT) AS t FROM events)""")
def timecode(spark, d):
    t = F.floor(F.col("value") * 3)
    code = sc.timecode(t + 0.5)
    bare = F.concat(F.when(F.col("event_id") % 2 == 0, "x").otherwise(" "), t.cast("string"))
    return table(spark, d, "events").select("event_id", code.alias("code"), sc.parse_timecode(code).alias("parsed"), sc.parse_timecode(bare).alias("bare"))


@query("F16_running_clock", """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE upper(strftime(t, '%b')) || strftime(t, ' %-d %Y') || chr(10) || strftime(t, '%-I:%M %p') END AS mon, strftime(t, '%d-%m-%Y') AS dmy, strftime(t, '%Y-%m-%d') AS ymd,
 strftime(t, '%m/%d/%Y %-I:%M %p') AS mdy, upper(strftime(t, '%a')) || strftime(t, ' %d-%m-%y %H:%M:%S') AS dow, strftime(t, '%H:%M:%S') AS hms FROM (SELECT event_id,
 CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('minute', ts) WHEN 2 THEN date_trunc('day', ts) END + INTERVAL 1 SECOND * (CAST(json_extract(props, '$.k') AS BIGINT) * 48 // 24) AS t FROM events)""")
def running_clock(spark, d):
    m = F.col("event_id") % 4
    start = F.when(m == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(m == 1, F.date_format("ts", "yyyy-MM-dd HH:mm")).when(m == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise("soon")
    frame = F.get_json_object("props", "$.k").cast("long") * 48
    t = sc.clock_at(sc.parse_clock_start(start), frame, F.lit(24.0))
    styles = {"mon": "mon_d_yyyy", "dmy": "dd-mm-yyyy", "ymd": "yyyy-mm-dd", "mdy": "mdy_time", "dow": "dow_dmy_hms", "hms": "hms"}
    return table(spark, d, "events").select("event_id", *[sc.clock_text(t, s).alias(n) for n, s in styles.items()])


@query("F17_counter", "SELECT o_orderkey, s // 3600 || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS c FROM (SELECT o_orderkey, floor(o_totalprice / 10)::BIGINT AS s FROM orders)")
def counter(spark, d):
    return table(spark, d, "orders").select("o_orderkey", sc.counter(F.col("o_totalprice") / 10).alias("c"))


@query("F18_byte_sizes", "SELECT doc_id, CASE WHEN n * 4099 / 1048576.0 >= 1024 THEN format('{:.2f} GB', n * 4099 / 1073741824.0) ELSE format('{:.0f} MB', n * 4099 / 1048576.0) END AS big, CASE WHEN n * 409 < 1048576 THEN format('{:.0f} KB', n * 409 / 1024.0) ELSE format('{:.1f} MB', n * 409 / 1048576.0) END AS small FROM (SELECT doc_id, n_chars * 401 + 7 AS n FROM documents)")
def byte_sizes(spark, d):
    n = F.col("n_chars") * 401 + 7
    return table(spark, d, "documents").select("doc_id", sc.download_size(n * 4099).alias("big"), sc.file_size(n * 409).alias("small"))


@query("F23_placement", """SELECT doc_id, x0::BIGINT AS x0, y0::BIGINT AS y0, round(x0::BIGINT / 1000.0, 4) AS left_edge, round((y0 + th) / 500.0, 4) AS bottom_edge FROM (SELECT *,
 round_even(CASE WHEN 950 - tw < 50 THEN wx ELSE least(greatest(wx, 50), 950 - tw) END, 0) AS x0, round_even(CASE WHEN 475 - th < 25 THEN wy ELSE least(greatest(wy, 25), 475 - th) END, 0) AS y0 FROM (SELECT doc_id, n_chars AS tw, 18 + n_chars % 90 AS th,
 (doc_id % 11) / 10.0 * 1000 - n_chars / 2.0 AS wx, (doc_id % 7) / 6.0 * 500 - (18 + n_chars % 90) / 2.0 AS wy FROM documents))""")
def placement(spark, d):
    tw, th = F.col("n_chars"), F.lit(18) + F.col("n_chars") % 90
    x0 = sc.place(F.col("doc_id") % 11 / 10.0, tw, F.lit(1000), 0.05)
    y0 = sc.place(F.col("doc_id") % 7 / 6.0, th, F.lit(500), 0.05)
    return table(spark, d, "documents").select("doc_id", x0.alias("x0"), y0.alias("y0"), F.round(x0 / 1000.0, 4).alias("left_edge"), F.round((y0 + th) / 500.0, 4).alias("bottom_edge"))


@query("F24_fade_and_reveal", f"WITH {S_SQL} SELECT event_id, round(least(greatest(k / 24.0 / 0.5, 0), 1) * least(greatest((99 - k) / 24.0 / 0.5, 0), 1), 6) AS gain, floor(x / 24.0 * 11)::BIGINT + 1 AS shown FROM s")
def fade_reveal(spark, d):
    k = F.col("k")
    return timed_events(spark, d).select("event_id", sc.r6(sc.fade_gain(k / 24.0, (F.lit(99) - k) / 24.0, 0.5)).alias("gain"), sc.reveal_count(X() / 24.0, 11.0).alias("shown"))


@query("F25_fingerprint", "SELECT o_orderkey, sha256(concat_ws(chr(1), o_orderkey::VARCHAR, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE chr(2) END, '0.1')) AS f FROM orders")
def fingerprint(spark, d):
    return table(spark, d, "orders").select("o_orderkey", doc.fingerprint([F.col("o_orderkey"), F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")), F.lit("0.1")]).alias("f"))


@query("F26_content_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


# ── scalar laws ─────────────────────────────────────────────────────────

@query("F1_db_to_linear", f"WITH {S_SQL} SELECT event_id, round(x / 250.0 * pow(10.0, (k - 50) / 2.0 / 20.0), 6) AS y FROM s")
def db_to_linear(spark, d):
    return timed_events(spark, d).select("event_id", sc.r6(X() / 250.0 * sc.db_to_lin((F.col("k") - 50) / 2.0)).alias("y"))


@query("F2_smoothstep", f"WITH {S_SQL} SELECT event_id, round(u * u * (3 - 2 * u), 6) AS y FROM (SELECT event_id, least(greatest((x - 80.0) / 253.0, 0), 1) AS u FROM s)")
def smoothstep(spark, d):
    return timed_events(spark, d).select("event_id", sc.r6(sc.smoothstep(80.0, 333.0, X())).alias("y"))


@query("F3_soft_clip", f"WITH {S_SQL} SELECT event_id, round(CASE WHEN v > 0.8 THEN 0.8 + 0.2 * tanh((v - 0.8) / 0.2) ELSE v END, 6) AS y FROM (SELECT event_id, x / 300.0 AS v FROM s)")
def soft_clip(spark, d):
    return timed_events(spark, d).select("event_id", sc.r6(sc.soft_clip(X() / 300.0, 0.8)).alias("y"))


@query("F4_tone_curve", f"""WITH {S_SQL}, a AS (SELECT event_id, pow(greatest((x / 500.0 * {2 ** 0.3!r} - 0.45) * 1.2 + 0.45, 0), {1 / 1.1!r}) AS v FROM s),
 b AS (SELECT event_id, least(greatest(v + -0.03 * (1 - v), 0), 1.2) AS v FROM a) SELECT event_id, round(least(greatest(CASE WHEN v > 0.85 THEN 0.85 + 0.15 * tanh((v - 0.85) / {1 - 0.85!r}) ELSE v END, 0), 1), 6) AS y FROM b""")
def tone_curve(spark, d):
    y = sc.tone_curve(X() / 500.0, exposure=0.3, contrast=1.2, pivot=0.45, gamma=1.1, lift=-0.03, knee=0.85)
    return timed_events(spark, d).select("event_id", sc.r6(y).alias("y"))


RGB_SQL = "rgb AS (SELECT event_id, x / 500.0 AS r, k / 100.0 AS g, (event_id % 97) / 97.0 AS b FROM s)"


def rgb(spark, d):
    return timed_events(spark, d).select("event_id", (X() / 500.0).alias("r"), (F.col("k") / 100.0).alias("g"), (F.col("event_id") % 97 / 97.0).alias("b"))


@query("F5_colour_maps", f"""WITH {S_SQL}, {RGB_SQL}, l AS (SELECT *, 0.299 * r + 0.587 * g + 0.114 * b AS y FROM rgb) SELECT event_id, round(y, 6) AS luma, round(0.5959 * r - 0.2746 * g - 0.3213 * b, 6) + 0.0 AS i,
 round(0.2115 * r - 0.5227 * g + 0.3112 * b, 6) + 0.0 AS q, round(y + (r - y) * 1.4, 6) + 0.0 AS sat_r, round(pow(least(greatest(g * 0.9 + 0.05 * (1 - g), 0), 1), {1 / 1.2!r}), 6) AS lgg, round(b * 0.95, 6) AS cool_b FROM l""")
def colour_maps(spark, d):
    v = [F.col(c) for c in "rgb"]
    yiq = sc.linear_map(v, sc.YIQ_ROWS)
    return rgb(spark, d).select(
        "event_id", sc.r6(yiq[0]).alias("luma"), sc.r6(yiq[1]).alias("i"), sc.r6(yiq[2]).alias("q"), sc.r6(sc.saturate(v, 1.4)[0]).alias("sat_r"),
        sc.r6(sc.lift_gamma_gain(v[1], 0.05, 1.2, 0.9)).alias("lgg"), sc.r6(v[2] * sc.temperature_gains(0.25)[2]).alias("cool_b"),
    )


@query("F6_quantise", f"WITH {S_SQL} SELECT event_id, round(v * 0.3 + round_even(least(greatest(v, -1), 1) * 31.0, 0) / 31.0 * 0.7, 6) + 0.0 AS y FROM (SELECT event_id, x / 200.0 - 1.1 AS v FROM s)")
def quantise(spark, d):
    return timed_events(spark, d).select("event_id", sc.r6(sc.quantise(X() / 200.0 - 1.1, 6, 0.7)).alias("y"))


@query("F7_mulaw", f"""WITH {S_SQL}, c AS (SELECT event_id, sign(v) * ln(1 + 255.0 * abs(v)) / ln(256.0) AS c FROM (SELECT event_id, x / 250.0 - 1 AS v FROM s)), r AS (SELECT event_id, round_even(c * 127.0, 0) / 127.0 AS c FROM c)
 SELECT event_id, round(sign(c) * (pow(256.0, abs(c)) - 1) / 255.0, 6) + 0.0 AS y FROM r""")
def mulaw(spark, d):
    return timed_events(spark, d).select("event_id", sc.r6(sc.mulaw_round_trip(X() / 250.0 - 1.0)).alias("y"))


@query("F8_clip_laws", f"""WITH {S_SQL}, n AS (SELECT event_id, v / (pk + 1e-9) AS v, pk + 1e-9 AS pk FROM (SELECT *, max(abs(v)) OVER (PARTITION BY series_id) AS pk FROM (SELECT series_id, event_id, x / 250.0 - 1 AS v FROM s))),
 z AS (SELECT *, tanh(6.0 * (v + 0.08)) - {math.tanh(2 * 3.0 * 0.08)!r} AS f FROM n)
 SELECT event_id, round(tanh(3.0 * v) * pk, 6) + 0.0 AS soft, round(least(greatest(3.0 * v, -1), 1) * pk, 6) + 0.0 AS hard, round((f - tanh(30.0 * f) / 30.0 * 0.9) * pk, 6) + 0.0 AS fuzz, round(CASE WHEN v >= 0 THEN tanh(3.0 * v) ELSE tanh(6.6 * v) / 1.4 END * pk, 6) + 0.0 AS asym FROM z""")
def clip_laws(spark, d):
    s = event_series(spark, d).withColumn("v", X() / 250.0 - 1.0)
    s = s.join(s.groupBy("series_id").agg(F.max(F.abs("v")).alias("pk")), "series_id")
    return s.select("event_id", *[sc.r6(sc.drive(F.col("v"), F.col("pk"), law, 3.0)).alias(law) for law in ("soft", "hard", "fuzz", "asym")])


@query("F9_colour_matrix", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'bt601' WHEN 1 THEN 'bt2020' WHEN 2 THEN 'fcc' ELSE CASE WHEN p_size * 20 >= 720 OR p_size * 40 >= 1280 THEN 'bt709' ELSE 'bt601' END END AS matrix FROM part")
def colour_matrix(spark, d):
    tag = F.element_at(F.array(F.lit("SMPTE170M"), F.lit("bt2020nc"), F.lit("fcc"), F.lit("gbr"), F.lit(None)), F.col("p_size") % 5 + 1)
    return table(spark, d, "part").select("p_partkey", sc.colour_matrix(tag, F.col("p_size") * 40, F.col("p_size") * 20).alias("matrix"))


@query("F10_hex_colour", """SELECT p_partkey, round(CASE WHEN p_partkey % 3 = 2 THEN 1.0 ELSE (strpos('0123456789abcdef', a) - 1) * 16 / 255.0 + (strpos('0123456789abcdef', CASE WHEN p_partkey % 3 = 0 THEN substr(h, 2, 1) ELSE a END) - 1) / 255.0 END, 6) AS red
 FROM (SELECT p_partkey, md5(p_name) AS h, substr(md5(p_name), 1, 1) AS a FROM part)""")
def hex_colour(spark, d):
    h, m = F.md5("p_name"), F.col("p_partkey") % 3
    text = F.when(m == 0, F.concat(F.lit("#"), F.upper(F.left(h, F.lit(6))))).when(m == 1, F.left(h, F.lit(3))).otherwise("#12345g")
    return table(spark, d, "part").select("p_partkey", sc.r6(sc.hex_channel(text, 0)).alias("red"))


def bayer_sql(n: int, x: str, y: str) -> str:
    flat = ", ".join(repr(v) for line in an.bayer(n) for v in line)
    return f"([{flat}])[{y} % {n} * {n} + {x} % {n} + 1]"


@query("F30_bayer_dither", f"""WITH {S_SQL}, v AS (SELECT event_id, x / 500.0 + {bayer_sql(4, 'idx', 'k')} * 0.2 AS v FROM s) SELECT event_id, round_even(least(greatest(v, 0), 1) * 5.0, 0) / 5.0 AS level, least(floor(least(greatest(v, 0), 1) * 4), 3)::INTEGER AS tone FROM v""")
def bayer_dither(spark, d):
    v = an.dithered(X() / 500.0, F.col("idx"), F.col("k"), 4, 0.2)
    return event_series(spark, d).select("event_id", an.uniform_levels(v).alias("level"), an.luma_index(v, 4).alias("tone"))


@query("F31_precision", """SELECT event_id, round(value, p) AS shown, CASE WHEN u = '' THEN b WHEN u = '°' THEN b || u ELSE b || ' ' || u END AS label FROM (SELECT *, CASE p WHEN 0 THEN format('{:.0f}', round(value, 0)) WHEN 2 THEN format('{:.2f}', round(value, 2)) ELSE format('{:.3f}', round(value, 3)) END AS b FROM (SELECT event_id, value,
 CASE WHEN event_id % 4 = 0 THEN 0 WHEN event_id % 4 = 1 THEN 3 WHEN abs(value) >= 100 THEN 0 ELSE 2 END AS p, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '°' ELSE 'dB' END AS u FROM events))""")
def precision(spark, d):
    m = F.col("event_id") % 4
    places = sc.decimals_for(F.when(m == 0, "int").otherwise("float"), F.lit(0.0), F.when(m == 1, 0.4).otherwise(500.0), F.col("value"))
    shown = sc.printed(F.col("value"), places)
    unit = F.element_at(F.array(F.lit(""), F.lit("°"), F.lit("dB")), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", shown.alias("shown"), sc.with_unit(shown, places, unit).alias("label"))


# ── codebooks ───────────────────────────────────────────────────────────

DIMS = 64
VEC_SQL = "e AS MATERIALIZED (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p FROM embeddings)"


@query("J18_nearest_entry", f"""WITH {VEC_SQL}, c AS MATERIALIZED (SELECT label AS code, p, avg(v) AS m FROM e GROUP BY 1, 2), dd AS (SELECT vec_id, code, round(sum((v - m) * (v - m) * (1.0 / p)), 9) AS distance FROM e JOIN c USING (p) GROUP BY 1, 2)
 SELECT vec_id, arg_min(code, {{'d': distance, 'c': code}}) AS code, min(distance) AS distance FROM dd GROUP BY 1""")
def nearest_entry(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("vec"))
    book = an.centroids(e, "label", "vec").withColumnRenamed("label", "code")
    weights = F.transform(F.sequence(F.lit(1), F.size("vec")), lambda i: F.lit(1.0) / i)
    return an.nearest(e, "vec_id", "vec", book, "code", "centroid", weights).withColumn("distance", F.round("distance", 9))


@query("A12_cell_pair_codes", f"""WITH {S_SQL}, p AS MATERIALIZED (SELECT series_id, idx // 8 AS cell, idx, k % 6 AS code FROM s), n AS (SELECT series_id, cell, code, count(*) AS n, row_number() OVER (PARTITION BY series_id, cell ORDER BY count(*) DESC, code) AS r FROM p GROUP BY 1, 2, 3),
 t AS (SELECT series_id, cell, max(code) FILTER (r = 1) AS a, coalesce(max(code) FILTER (r = 2), max(code) FILTER (r = 1)) AS b FROM n GROUP BY 1, 2) SELECT series_id, idx, CASE WHEN abs(code - a) <= abs(code - b) THEN a ELSE b END AS snapped FROM p JOIN t USING (series_id, cell)""")
def cell_pairs(spark, d):
    p = event_series(spark, d).select("series_id", "idx", F.floor(F.col("idx") / 8).cast("long").alias("cell"), (F.col("k") % 6).alias("code"))
    top = ag.top_codes(p, ["series_id", "cell"], "code")
    near = F.when(F.abs(F.col("code") - F.col("first")) <= F.abs(F.col("code") - F.col("second")), F.col("first")).otherwise(F.col("second"))
    return p.join(top, ["series_id", "cell"]).select("series_id", "idx", near.alias("snapped"))


@query("A13_typical_row", f"""WITH {VEC_SQL}, f AS MATERIALIZED (SELECT vec_id, label, avg(v) AS mean, stddev_pop(v) AS sd FROM e GROUP BY 1, 2), m AS (SELECT label, median(mean) AS mm, median(sd) AS ms, greatest(stddev_pop(mean), 1e-6) AS sm, greatest(stddev_pop(sd), 1e-6) AS ss FROM f GROUP BY 1),
 dd AS (SELECT label, vec_id, round(abs(mean - mm) / sm + abs(sd - ms) / ss, 9) AS distance FROM f JOIN m USING (label)) SELECT label, arg_min(vec_id, {{'d': distance, 'v': vec_id}}) AS vec_id, round(min(distance), 6) AS distance FROM dd GROUP BY 1""")
def typical_row(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("vec"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    e = e.withColumn("mean", total(F.col("vec")) / F.size("vec"))
    sq = F.transform("vec", lambda v: (v - F.col("mean")) * (v - F.col("mean")))
    f = e.withColumn("sd", F.sqrt(total(sq) / F.size("vec"))).select("vec_id", "label", "mean", "sd")
    return ag.typical_row(f, ["label"], "vec_id", ["mean", "sd"]).withColumn("distance", F.round("distance", 6))


# ── operator chains ─────────────────────────────────────────────────────

@query("X5_chain_runner", f"""WITH {S_SQL}, g AS (SELECT series_id, idx, (x / 250.0 - 1) * pow(10.0, -6.0 / 20) AS y FROM s), h AS (SELECT a.series_id, a.idx, b.y FROM g a JOIN g b ON b.series_id = a.series_id AND b.idx = a.idx // 2 * 2)
 SELECT series_id, idx, round(round_even(least(greatest(y, -1), 1) * 127.0, 0) / 127.0, 6) + 0.0 AS y FROM h""")
def chain_runner(spark, d):
    from cuelattice.plans.series_operators import REGISTRY

    s = event_series(spark, d).select("series_id", "idx", "block", (X() / 250.0 - 1.0).alias("y"))
    chain = [("gain", {"db": -6}), ("hold_rows", {"step": 2}), ("soften", {"enabled": "no"}), ("bitcrush", {"bits": "8"})]
    return REGISTRY.apply(s, chain).select("series_id", "idx", sc.r6(F.col("y")).alias("y"))


@query("X4_event_rows", f"WITH {S_SQL} SELECT series_id, event_id, 'burst:' || event_id || ':' || i.i AS id, t + i.i * 0.5 AS t FROM s JOIN range(0, 10) i(i) ON i.i < k % 10")
def event_rows(spark, d):
    from cuelattice.plans.series_operators import burst_rows

    return burst_rows(timed_events(spark, d)).select("series_id", "event_id", "id", "t")

"""Steps that must not repeat draws, move below a shuffle, or shuffle more than once."""

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import functions as F

from cuelattice.functions import keyed
from cuelattice.operators import edits as ed, schedules as sd
from cuelattice.plans import damage_plan as dp
from cuelattice.session import materialize_bucketed
from cuelattice.sources import documents as doc
from cuelattice.streaming import twins


def uniform(*parts):
    return int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2.0**52


def hash_of(n, *parts):
    return int(uniform(*parts) * n)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_poisson_times_are_drawn_once_behind_the_shuffle(spark):
    """F22"""
    clips = spark.createDataFrame([(1, 7, 1000.0), (2, 8, 30 * 600.0), (3, 9, 0.0)], "clip_id long, seed long, duration double")
    got = sd.poisson_times(clips, ["clip_id"], "hold", 1.0, 30.0)
    assert "sha2" not in plan(got)
    cuts, want = keyed.poisson_thresholds(0.5), []
    for clip, seed, duration in ((1, 7, 1000.0), (2, 8, 18000.0)):
        for cell in range(math.ceil(duration / 30.0)):
            n = sum(c <= uniform(seed, clip, "hold", cell, "n") for c in cuts)
            want += [(clip, t) for t in ((cell + uniform(seed, clip, "hold", cell, j)) * 30.0 for j in range(1, n + 1)) if t < duration]
    assert sorted((r["clip_id"], r["t"]) for r in got.collect()) == sorted(want)


def test_counts_of_a_varying_rate(spark):
    rows = [(lam, u / 97.0) for lam in (0.0, 0.05, 0.7, 3.0, 30.0) for u in range(97)] + [(None, 0.5), (0.5, None)]
    df = spark.createDataFrame(rows, "lam double, u double").withColumn("n", keyed.poisson_varying(F.col("lam"), F.col("u"), 40))
    for lam, u, n in df.filter("lam IS NOT NULL AND u IS NOT NULL").collect():
        p = c = math.exp(-lam)
        want = 0
        for k in range(1, 41):
            want += u >= c
            p = p * lam / k
            c += p
        assert n == want, (lam, u)


def test_specs_are_read_once_per_clip(spark, sf_dir):
    """no clip aggregate is left below which a filter on the spec could move."""
    assert "Aggregate" not in plan(dp.layer_specs(spark, sf_dir))


def test_held_draws_are_those_of_each_frame(spark, monkeypatch):
    """F20, F21, F24, F25"""
    monkeypatch.setattr(sd, "SPINE_BLOCK", 4096)
    row = (5, 0, 77, 4200, 0.3, 0.04, 0.8, 0.3, 0.02)
    layers = spark.createDataFrame([row, (6, 1, 101, 40, None, 0.08, 0.8, None, None), (7, 0, 99, 33, 0.2, 0.0, 0.8, 0.3, None)], "clip_id long, layer_pos int, seed long, n_frames long, tracking_error double, dropouts double, dropout_burst double, skew_tear double, random_glitch_rate double")
    got = dp.spine_of(layers)
    assert "sha2" not in plan(got)
    for clip, pos, seed, n, drops in ((5, 0, 77, 4200, True), (6, 1, 101, 40, True), (7, 0, 99, 33, False)):
        rows = {r["idx"]: r for r in got.filter(F.col("clip_id") == clip).collect()}
        assert sorted(rows) == list(range(n))
        raw = []
        for i in range(n):
            total = 0.0
            for o in range(dp.OCTAVES):
                total += (uniform(seed, clip, pos, f"doburst/{o}", i // 2**o) * 2.0 - 1.0) * 2.0 ** (o * (dp.ALPHA - 1.0) / 2.0)
            raw.append(total)
        if not drops:
            assert all(r["burst"] is None for r in rows.values())
            continue
        a, at = sorted(map(abs, raw)), 0.95 * (n - 1)
        p95 = a[int(at)] + (a[math.ceil(at)] - a[int(at)]) * (at - int(at))
        assert all(math.isclose(rows[i]["burst"], raw[i] / (p95 + 1e-9), rel_tol=1e-12) for i in range(n))
        if pos == 0:
            assert all(rows[i]["tears"] == (uniform(seed, clip, pos, "skewev", i) < 0.02 + 0.3 * 0.1) for i in range(n))
    some = dp.spine_of(layers, {dp.DROPOUT})
    key = lambda r: (r["clip_id"], r["idx"], r["burst"])
    assert "gate" not in some.columns and sorted(map(key, some.collect()), key=str) == sorted(map(key, got.collect()), key=str)


def test_compaction_shuffles_an_edit_list_once(spark):
    """F23"""
    detail = F.map_from_arrays(F.array(F.lit("intensity")), F.array(F.col("n").cast("string")))
    ops = spark.range(200).select((F.col("id") % 7).alias("job"), F.concat(F.lit("o"), F.col("id") % 20).alias("id"), F.col("id").alias("op_pos"), F.when(F.col("id") % 31 == 0, "remove").when(F.col("id") % 3 == 0, "move").otherwise("tune").alias("op"), F.col("id").cast("double").alias("t"), F.col("id").alias("n"))
    got = ed.compact(ops.withColumn("detail", detail).drop("n"), ["job"])
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    live = {}
    for i in range(200):
        key = (i % 7, f"o{i % 20}")
        if i % 31 == 0:
            live[key] = {"remove": (i, None)}
        else:
            op = "move" if i % 3 == 0 else "tune"
            first = live.setdefault(key, {}).get(op, (i, None))[0]
            live[key][op] = (first, str(i))
    want = {(*k, op): v for k, ops_ in live.items() for op, v in ops_.items()}
    assert {(r["job"], r["id"], r["op"]): r["op_pos"] for r in got.collect()} == {k: v[0] for k, v in want.items()}
    assert all(r["detail"]["intensity"] == want[r["job"], r["id"], r["op"]][1] for r in got.collect() if r["op"] != "remove")


def test_pieces_of_a_batch_are_bounded():
    from cuelattice.llm import nn_descent as nn

    b = pa.RecordBatch.from_arrays([pa.array([list(range(i % 5)) for i in range(1300)])], ["met"])
    parts = list(nn._pieces(iter([b, b.slice(0, 0)])))
    assert [p.num_rows for p in parts] == [512, 512, 276]
    assert [v for p in parts for v in p.column(0).to_pylist()] == b.column(0).to_pylist()


SETTING = "job long, sets map<string,string>, edits array<struct<id:string,v:int>>"


def changes_of(now, saved):
    """The changes of settings whose keys come once for each side that has lists; entries of repeated keys meet each with each."""
    out = []
    for job in {r[0] for r in [*now, *saved]}:
        a, b = ([r for r in side if r[0] == job] for side in (now, saved))
        pairs = lambda name: [(x, y) for x in ([r[1][name] for r in a if name in (r[1] or {})] or [...]) for y in ([r[1][name] for r in b if name in (r[1] or {})] or [...])]
        kind = lambda x, y: "added" if y is ... else "removed" if x is ... else "changed" if x != y else None
        out += [(job, "sets", name, kind(x, y)) for name in {k for r in [*a, *b] for k in r[1] or {}} for x, y in pairs(name) if kind(x, y)]
        if job is None:
            continue
        items = [{}, {}]
        for side, rows in enumerate((a, b)):
            for at, item in enumerate(i for r in rows for i in r[2] or []):
                if item is not None and item[0] is not None:
                    items[side][item[0], sum(k[0] == item[0] for k in items[side])] = (at, item)
        both = [k for k in items[0] if k in items[1]]
        rank = [{k: i for i, k in enumerate(sorted(both, key=lambda k, m=m: m[k][0]))} for m in items]
        for k in {*items[0], *items[1]}:
            x, y = (m.get(k, (0, ...))[1] for m in items)
            if change := kind(x, y) or ("moved" if rank[0][k] != rank[1][k] else None):
                out.append((job, "edits", k[0], change))
    return out


def test_changes_of_settings_dealt_by_key_need_no_shuffle(spark):
    """F2 of round 4"""

    def setting(job, side):
        sets = {f"k{i}": None if hash_of(5, job, i, side) == 0 else f"v{hash_of(3, job, i, side)}" for i in range(hash_of(6, job, side))}
        edits = [(f"e{hash_of(3, job, i)}", hash_of(2, job, i, side)) for i in range(hash_of(7, job, side, 1))]
        return job, sets, edits[::-1] if hash_of(3, job, side) == 0 else edits

    now, saved = ([setting(j, side) for j in range(120) if hash_of(9, j, side, 2)] for side in (0, 1))
    dealt = [materialize_bucketed(spark.createDataFrame(rows, SETTING), "settings", ["job"], [], 4) for rows in (now, saved)]
    got = doc.setting_changes(*dealt, "job", ["sets"], {"edits": "id"})
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(changes_of(now, saved))


def test_changes_of_odd_settings(spark):
    """Keys that are null or come again, null maps, lists, items and names; the sides come in any order."""
    now = [(1, {"a": "x", "b": None}, [("p", 1), None, (None, 2), ("q", 3), ("p", 4)]), (1, {"a": "y"}, None), (2, None, [("p", 1)]), (None, {"a": "x"}, [("p", 1)]), (4, {}, [])]
    saved = [(1, {"a": "y", "c": None}, [("q", 3), ("p", 1)]), (1, {"a": "z", "b": None}, None), (2, {"a": None}, None), (None, {"a": "z", "d": "w"}, None), (5, {"a": "1"}, [("p", None)])]
    got = doc.setting_changes(spark.createDataFrame(now, SETTING), spark.createDataFrame(saved, SETTING), "job", ["sets"], {"edits": "id"})
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(changes_of(now, saved), key=key)


def test_batches_of_edits_save_their_changes_only(spark, tmp_path, monkeypatch):
    """F1 of round 4: what a batch leaves on disk does not grow with the state, and few versions stay."""
    kinds = "job LONG, op_pos LONG, op STRING, id STRING, t DOUBLE, detail MAP<STRING, STRING>"
    ops = [(uniform(i, "job") // 0.25, i, ["tune", "move", "remove", "add"][hash_of(20, i, "op") // 6], f"e{hash_of(9, i)}", float(hash_of(60, i, "t")), {"intensity": str(round(uniform(i), 2))}) for i in range(120)]
    ops = [(int(job), pos, op, f"new{pos}" if op == "add" else None if pos % 31 == 0 else name, t, detail) for job, pos, op, name, t, detail in ops]
    for i in (3, 0, 5, 2, 4, 1):
        spark.createDataFrame(ops[i * 20:i * 20 + 20], kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ops")
    base = spark.createDataFrame([(j, f"e{i}", 10 + i, 0.5) for j in (0, 1, 2, 3, 4) for i in range(7)] + [(1, "e1", 90, 0.1), (1, "x", 7, 0.2), (1, "x", 7, 0.2)], "job LONG, id STRING, frame LONG, intensity DOUBLE").filter("NOT (job = 1 AND id = 'e1' AND frame < 90)")
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/ops")
    limits, defaults = {"intensity": (0.05, 1.0)}, {"intensity": 0.8}
    before = spark.conf.get("spark.sql.streaming.minBatchesToRetain")
    monkeypatch.setattr(twins, "scratch_dir", lambda _: str(tmp_path))
    rows = twins.folded_edits(stream, base, F.lit(1.0), F.lit(50), ["intensity"], lambda f, v: ed.clamp_field(f, v, limits), defaults)
    every = twins.run_to_latest(rows, "slim", ["job", "id"], "v", newest=False, settings=twins.SAVED_CHANGES)
    assert spark.conf.get("spark.sql.streaming.minBatchesToRetain") == before
    (state,) = tmp_path.glob("stream/slim-*/state")
    assert [*state.glob("state/0/*/*.changelog")] and len([*state.glob("offsets/[0-9]*")]) <= 3
    assert every.select("v").distinct().count() == 6
    got = twins.folded_plan(every, base, ["intensity"], "v")
    assert len(re.findall(r"hashpartitioning\(job#\d+L?, id#\d+", got._jdf.queryExecution().executedPlan().toString())) == 1
    want = ed.apply_edits(base, spark.createDataFrame(ops, kinds), ["job"], F.lit(1.0), F.lit(50), ["intensity"], limits, defaults).filter("job <> 4")
    cols = ["job", "id", "frame", "origin", "edited", "intensity"]
    assert sorted(map(tuple, got.select(cols).collect()), key=str) == sorted(map(tuple, want.select(cols).collect()), key=str)

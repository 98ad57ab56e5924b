"""Properties and small worked examples."""

import itertools
import json
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cuelattice.functions import scalars as sc, text as tx
from cuelattice.operators import assignment, catalog, edits, kernels, mixing, schedules, series
from cuelattice.plans import event_plan
from cuelattice.plans.chain_runner import Param, Registry
from cuelattice.streaming import twins


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def blocked(spark, values, size=7, cols="series_id INT, idx LONG, x DOUBLE"):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], cols)
    return series.with_block(df.repartition(5), size)


# ── streams ─────────────────────────────────────────────────────────────

@pytest.fixture
def two_partitions(spark):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_event_order_across_micro_batches(spark, tmp_path, two_partitions):
    """Files that overlap by less than the watermark's delay, one micro-batch each, give the sequential result."""
    rng = np.random.default_rng(5)
    data = [(i, int(rng.integers(0, 3)), i * 60.0, float(rng.uniform(0, 100))) for i in range(240)]
    parts = [data[:80:2] + data[80:84], data[1:80:2][-4:] + data[84:160], data[160:]]
    seen = sorted(x for part in parts for x in part)
    for part in parts:
        df = spark.createDataFrame(part, "event_id LONG, user_id LONG, t DOUBLE, value DOUBLE")
        df.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("t"))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")

    def drained(processor, schema):
        ev, path = twins.with_end(twins.table_stream(spark, str(tmp_path), "events", "1"), "order")
        closing = spark.createDataFrame([tuple({"ts": twins.END_OF_INPUT}.get(c) for c in ev.columns)], ev.schema)
        out = twins.with_state(ev, "user_id", "ts", F.col("t"), F.col("value"), processor, schema)
        return twins.run_to_files(out, "order", (path, closing))

    step = twins.follower_step(0.4, 0.9)
    want, kept, last, alert = {}, [], {}, {}
    for i, user, t, x in seen:
        last[user] = want[i] = step(x, last.get(user), 0.0)
        if user not in alert or t - alert[user] >= 600.0:
            alert[user] = t
            kept.append(i)
    got = dict(rows(drained(twins.CarriedState("user_id", step), "user_id BIGINT, event_id BIGINT, y DOUBLE"), "event_id", "y"))
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert [r[0] for r in rows(drained(twins.MinGap("user_id", 600.0), "user_id BIGINT, event_id BIGINT"), "event_id")] == kept


def test_event_order_in_dealt_buckets(spark, tmp_path, two_partitions):
    """Null keys are one key, and shards with more rows than a bucket holds give the sequential result too."""
    rng = np.random.default_rng(6)
    data = [(i, None if i % 7 == 0 else int(rng.integers(0, 2)), float(rng.integers(0, 3 * 86400)), float(rng.uniform(0, 100))) for i in range(120)]
    df = spark.createDataFrame(data, "event_id LONG, user_id LONG, t DOUBLE, value DOUBLE")
    df.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("t"))).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    ev, path = twins.with_end(twins.table_stream(spark, str(tmp_path), "events"), "dealt")
    closing = spark.createDataFrame([tuple({"ts": twins.END_OF_INPUT}.get(c) for c in ev.columns)], ev.schema)
    step = twins.smoothing_step(0.23)
    small = twins.CarriedState("user_id", step)
    small.bucket_rows = 8
    out = twins.with_state(ev, "user_id", "ts", F.col("t"), F.col("value"), small, "user_id BIGINT, event_id BIGINT, y DOUBLE")
    got = {r.event_id: (r.user_id, r.y) for r in twins.run_to_files(out, "dealt", (path, closing)).collect()}
    last, want = {}, {}
    for i, user, t, x in sorted(data, key=lambda r: (r[2], r[0])):
        last[user] = step(x, last.get(user), 0.0)
        want[i] = (user, last[user])
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9 for i in want)


def test_a_key_of_few_rows_makes_few_state_calls():
    """Rows of many keys and minutes are one entry of a shard, not an entry for each minute."""
    import pandas as pd

    class State:
        def __init__(self):
            self.calls, self.rows = 0, {}

        def getMapState(self, *_):
            return self

        getValueState = getMapState

        def get(self):
            return None

        def updateValue(self, key, value):
            self.calls += 1
            self.rows[key] = value

        def __getattr__(self, name):
            return lambda *_: None

    state = State()
    p = twins.MinGap("user_id", 600.0)
    p.init(state)
    n = 2000
    pdf = pd.DataFrame({"key": np.arange(n) % 50, "none": False, "ms": np.arange(n) * 60_000, "t": np.arange(n) * 60.0, "event_id": np.arange(n), "x": 0.0})
    p.handleInputRows((0,), iter([pdf]), None)
    assert state.calls == 1


def test_streams_in_twenty_batches_read_their_own_rows_and_let_state_go(spark, tmp_path, two_partitions):
    from cuelattice.operators import edits as ed

    kinds = "job LONG, op_pos LONG, op STRING, id STRING, t DOUBLE, detail MAP<STRING, STRING>"
    rng = np.random.default_rng(8)
    ops, progress = [], []
    for b in range(20):
        mine = []
        for k in range(12):
            pos, op = b * 100 + k, ["tune", "move", "remove", "add"][int(rng.choice(4, p=[0.6, 0.2, 0.05, 0.15]))]
            name = f"new{pos}" if op == "add" else f"e{rng.integers(0, 6)}" if rng.random() < 0.8 else f"new{rng.integers(0, b * 100 + 1)}"
            detail = {"intensity": None if rng.random() < 0.2 else str(round(float(rng.uniform(0, 2)), 2))} if op in ("tune", "add") else {}
            mine.append((int(rng.integers(0, 4)), pos, op, name, float(rng.integers(-3, 60)) if op in ("move", "add") else None, detail))
        ops.append(mine)
        progress.append([(i, b * 86400 + i * 600, float(rng.uniform(0, 1))) for i in range(b % 5, b % 5 + 4)])
    # The batches come in another order than the list's.
    for i in rng.permutation(20):
        spark.createDataFrame(ops[i], kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ops")
    base = spark.createDataFrame([(j, f"e{i}", 10 + i, 0.5) for j in range(4) for i in range(6)], "job LONG, id STRING, frame LONG, intensity DOUBLE")
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/ops")
    limits, defaults = {"intensity": (0.05, 1.0)}, {"intensity": 0.8}
    rows_ = twins.folded_edits(stream, base, F.lit(1.0), F.lit(50), ["intensity"], lambda f, v: ed.clamp_field(f, v, limits), defaults)
    latest, seen = twins.run_to_latest(rows_, "twenty", ["job", "id"], "v", history := []), [r for part in ops for r in part]
    got = rows(twins.folded_plan(latest, base, ["intensity"]), "job", "id", "frame", "origin", "edited", "intensity")
    want = ed.apply_edits(base, spark.createDataFrame(seen, kinds), ["job"], F.lit(1.0), F.lit(50), ["intensity"], limits, defaults)
    assert Counter(got) == Counter(rows(want, "job", "id", "frame", "origin", "edited", "intensity"))
    assert [p["numInputRows"] for p in history if p["numInputRows"]] == [12] * 20

    for part in progress:
        df = spark.createDataFrame(part, "job LONG, s LONG, progress DOUBLE").withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("s")))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/progress.parquet")
    log = twins.table_stream(spark, str(tmp_path), "progress", "1")
    out = twins.run_to_latest(twins.monotone_progress(log, "ts", "job", "progress", "1 day"), "progress", ["span", "job"], "v", history := [])
    best = {}
    for part in progress:
        for job, _, x in part:
            best[job] = max(x, best.get(job, 0.0))
    assert dict(rows(out.groupBy("job").agg(F.max("progress").alias("p")), "job", "p")) == best
    held = [p["stateOperators"][0]["numRowsTotal"] for p in history]
    assert len(held) >= 20 and max(held) <= 8 < sum(len(part) for part in progress)


def test_ratio_to_zero(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (2.0,), (None,)], "x DOUBLE")
    assert [r[0] for r in df.select(sc.ratio(150.0, F.col("x"))).collect()] == [float("inf"), float("-inf"), 75.0, None]


# ── chains ──────────────────────────────────────────────────────────────

def test_chain_keys_by_one_shuffle_equal_those_by_range_sort(spark, monkeypatch):
    data = [(j, ["video", "audio"][i % 2], i, None if i == 5 else f"e{i % 3}") for j in (1, 2, None) for i in range(12)]
    df = spark.createDataFrame(data, "job LONG, which STRING, line INT, effect_id STRING")
    cols = ("job", "which", "line", "effect_id", "pos", "effect_key")
    dealt = catalog.chain_keys(df, ["job"], ["line"], 3)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert Counter(rows(dealt, *cols)) == Counter(rows(catalog.chain_keys(df, ["job"], ["line"]), *cols))
    assert catalog.chains_fit(df, ["job"])
    monkeypatch.setattr(catalog, "CHAIN_ROWS", 11)
    assert not catalog.chains_fit(df, ["job"])


def test_resolve_takes_packed_layers_and_repeated_steps(spark):
    steps = spark.createDataFrame([(1, "a", "e"), (1, "a", "e"), (None, "b", "e")], "job LONG, effect_key STRING, effect_id STRING")
    params = spark.createDataFrame([("e", p, "float", "0.5", 0.0, 1.0, [], False) for p in ("x", "y")], "effect_id STRING, param STRING, kind STRING, default_value STRING, lo DOUBLE, hi DOUBLE, choices ARRAY<STRING>, iscale BOOLEAN")
    long = spark.createDataFrame([(1, "a", "x", "0.1"), (1, "a", "y", "0.2"), (None, "b", "x", "2"), (7, "a", "x", "0.9")], "job LONG, effect_key STRING, param STRING, value STRING")
    long = long.withColumn("sets", F.lit(None).cast("map<string,string>"))
    packed = spark.createDataFrame([(1, "a", [("y", None), ("z", "1")])], "job LONG, effect_key STRING, sets ARRAY<STRUCT<param: STRING, value: STRING>>")
    got = catalog.resolve(steps, params, [long, packed], ["job", "effect_key"]).select("job", "effect_key", "param", "layer", "value", "num").collect()
    assert Counter(map(tuple, got)) == Counter([(1, "a", "x", 1, "0.1", 0.1), (1, "a", "y", 2, None, None), (None, "b", "x", 1, "2", 1.0), (None, "b", "y", 0, "0.5", 0.5)])


# ── intervals ───────────────────────────────────────────────────────────

def test_an_interval_of_ten_million_frames_spreads_over_tasks(spark):
    from cuelattice.operators import intervals as iv

    spans = spark.createDataFrame([(1, 5, 10_000_000), (1, 100, 3), (2, 0, 1), (2, 7, 0)], "clip_id LONG, start LONG, dur LONG")
    cells = iv.on_grid(spans).withColumn("p", F.spark_partition_id())
    n, low, high = cells.filter("dur = 10000000").agg(F.count("*"), F.min("frame"), F.max("frame")).first()
    assert (n, low, high) == (10_000_000, 5, 10_000_004) and cells.filter("dur < 10").count() == 4
    assert cells.filter("dur = 10000000").groupBy("p").count().agg(F.max("count")).first()[0] < 4_000_000
    points = spark.createDataFrame([(1, 9_999_999), (1, 101), (1, 4), (2, 7)], "clip_id LONG, at LONG")
    got = iv.active_at(points, spans, ["clip_id"], "at", 32).select("at", "start").collect()
    assert sorted(map(tuple, got)) == [(101, 5), (101, 100), (9_999_999, 5)]


# ── text ────────────────────────────────────────────────────────────────

def slack(lines, width):
    return sum((width - len(x)) ** 2 for x in lines)


def test_wrap_is_the_least_squared_slack():
    rng = random.Random(3)
    for _ in range(60):
        words = ["x" * rng.randint(1, 7) for _ in range(rng.randint(1, 8))]
        width = rng.randint(8, 20)
        best = None
        for cuts in itertools.product([0, 1], repeat=len(words) - 1):
            lines, cur = [], words[0]
            for w, cut in zip(words[1:], cuts):
                if cut:
                    lines.append(cur)
                    cur = w
                else:
                    cur += " " + w
            lines.append(cur)
            if all(len(x) <= width for x in lines):
                best = slack(lines, width) if best is None else min(best, slack(lines, width))
        got = tx.wrap(" ".join(words), width)
        assert slack(got, width) == best and " ".join(got) == " ".join(words)


def test_wrap_splits_long_words_and_keeps_newlines():
    assert tx.wrap("abcdefghij kl", 4) == ["abcd", "efgh", "ij", "kl"]
    assert tx.wrap("one\n\ntwo\n\n", 20) == ["one", "", "two"]
    assert tx.wrap("", 20) == [""]


def test_chunks_lose_no_word():
    rng = random.Random(5)
    text = " ".join("w" * rng.randint(1, 12) + rng.choice(["", "", ".", "!"]) for _ in range(400))
    got = tx.chunk_script(text, 64)
    assert " ".join(got).split() == text.split() and max(map(len, got)) <= 64


def test_text_that_is_no_subtitle_gives_null(spark):
    df = spark.createDataFrame([("hello",), ("1\n00:00:01,000 --> 00:00:00,500\nback\n",)], "t STRING")
    assert [r[0] for r in df.select(tx.parse_srt(F.col("t"))).collect()] == [None, None]


# ── scalar rules ────────────────────────────────────────────────────────

def test_coercion(spark):
    df = spark.createDataFrame(
        [("int", "2.5"), ("int", "9"), ("float", "-1"), ("bool", "ON"), ("bool", "2"), ("enum", "b"), ("enum", "z"), ("str", "q"), ("int", None)], "kind STRING, value STRING"
    ).withColumn("choices", F.array(F.lit("a"), F.lit("b")))
    k, v, c = F.col("kind"), F.col("value"), F.col("choices")
    got = df.select(catalog.coerce_number(k, v, F.lit(0.0), F.lit(5.0)), catalog.coerce_text(k, v, c), catalog.enum_error(k, v, c)).collect()
    assert [tuple(r) for r in got] == [
        (2.0, None, False), (5.0, None, False), (0.0, None, False), (None, "true", False), (None, "false", False), (None, "b", False), (None, None, True), (None, "q", False), (None, None, False),
    ]


def test_versions(spark):
    df = spark.createDataFrame([("0.5.0",), ("v1.2.3",), ("v1.2.3-rc1",), ("1.2",), ("x1.2.3",), ("10.0.0",)], "tag STRING")
    assert [r[0] for r in df.select(sc.version_direction(F.col("tag"), F.lit("1.2.3"))).collect()] == ["older", "current", "current", "unknown", "unknown", "newer"]


def test_bayer_matrix_by_doubling():
    m = np.zeros((1, 1))
    for _ in range(3):
        m = np.block([[4 * m, 4 * m + 2], [4 * m + 3, 4 * m + 1]])
    assert np.allclose(np.array(assignment.bayer(8)), (m + 0.5) / 64 - 0.5)


# ── chains, remaps, registry ────────────────────────────────────────────

def test_repeat_keys(spark):
    st = spark.createDataFrame([(1, "video", 0, "tone"), (1, "video", 1, "fade"), (1, "video", 2, "tone")], "job INT, which STRING, ord INT, effect_id STRING")
    assert [r[1] for r in rows(catalog.chain_keys(st, ["job"], ["ord"]), "pos", "effect_key")] == ["tone", "fade", "tone#2"]


def test_composed_remaps(spark):
    grid = series.with_block(spark.range(10).select(F.lit(1).alias("clip_id"), F.col("id").alias("idx"), F.lit(10).alias("n")), 4)
    hold2 = lambda i: (F.floor(i / 2) * 2).cast("long")
    skip = spark.createDataFrame([(1, i, min(i, 4)) for i in range(10)], "clip_id INT, out_frame LONG, src_frame LONG")
    half = lambda i: F.floor(i / 2).cast("long")
    got = mixing.compose_remaps(grid, ["clip_id"], "n", [hold2, half])
    assert [r[1] for r in rows(got, "idx", "src_frame")] == [0, 0, 0, 0, 2, 2, 2, 2, 4, 4]
    assert [r[1] for r in rows(mixing.compose_remaps(grid, ["clip_id"], "n", [skip, hold2]), "idx", "src_frame")] == [0, 0, 2, 2, 4, 4, 4, 4, 4, 4]
    assert [r[1] for r in rows(mixing.compose_remaps(grid, ["clip_id"], "n", []), "idx", "src_frame")] == list(range(10))


def test_registry_rules(spark):
    reg = Registry()
    reg.register("twice", "audio", Param("by", "float", 2.0, 0.0, 4.0))(lambda df, by: df.withColumn("y", F.col("y") * by))
    with pytest.raises(ValueError):
        reg.register("twice", "audio")(lambda df: df)
    with pytest.raises(ValueError):
        reg.resolve("twice", {"ghost": 1})
    df = spark.createDataFrame([(1.0,)], "y DOUBLE")
    assert reg.apply(df, [("twice", {"by": 9}), ("twice", {"enabled": "off"})]).first()[0] == 4.0
    assert reg.apply(df, []) is df


# ── series ──────────────────────────────────────────────────────────────

def test_positions_do_not_depend_on_partitions(spark):
    data = [(i % 2 if i % 3 else 0, i * 37 % 101) for i in range(101)]
    df = spark.createDataFrame(data, "k INT, o INT")
    one, many = (rows(series.index_rows(df.repartition(n), ["k"], ["o"]), "k", "o", "idx") for n in (1, 17))
    want = sorted((k, o, sorted(x[1] for x in data if x[0] == k).index(o)) for k, o in data)
    assert one == many == want


def test_hot_key_percentiles_are_exact(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.lognormal(size=3000), np.full(1500, 1.25)])
    df = spark.createDataFrame([(0, float(x)) for x in v] + [(1, float(x)) for x in v[:7]], "k INT, v DOUBLE")
    spark.conf.set("cuelattice.percentile.directRows", "100")
    try:
        got = {r["k"]: r for r in series.exact_percentiles(df, ["k"], "v", {"a": 0.02, "b": 0.5, "c": 0.95}).collect()}
    finally:
        spark.conf.unset("cuelattice.percentile.directRows")
    for k, part in ((0, v), (1, v[:7])):
        assert np.allclose([got[k]["a"], got[k]["b"], got[k]["c"]], np.percentile(part, [2, 50, 95]))


def test_heavy_tails_are_narrowed_round_by_round(spark):
    v = np.concatenate([10.0 ** np.arange(-150, 150, 0.5), np.linspace(1.0, 1.0001, 900), [-1e308, 1.7e308]])
    df = spark.createDataFrame([(0, float(x)) for x in v], "k INT, v DOUBLE")
    spark.conf.set("cuelattice.percentile.directRows", "100")
    try:
        got = series.exact_percentiles(df, ["k"], "v", {"a": 0.02, "b": 0.5, "c": 0.6}).first()
    finally:
        spark.conf.unset("cuelattice.percentile.directRows")
    assert np.allclose([got["a"], got["b"], got["c"]], np.percentile(v, [2, 50, 60]), rtol=1e-12, atol=0)


def test_block_runs_equal_the_sequential_run(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, 200)
    for k in (kernels.gated_recursion(0.9), kernels.stepped_tracking(3)):
        want, _ = k({"idx": list(range(200)), "x": x.tolist()}, None)
        got = [r[1] for r in rows(kernels.fold_blocks(blocked(spark, x), ["series_id"], ["x"], k, "y"), "idx", "y")]
        assert np.allclose(got, want)


def test_a_slowly_forgetting_recursion_takes_few_rounds(spark, monkeypatch):
    x = np.random.default_rng(3).uniform(0, 1, 400)
    calls, due = [], kernels._due

    def counted(*args):
        calls.append(args)
        return due(*args)

    monkeypatch.setattr(kernels, "_due", counted)
    k = kernels.stepped_tracking(3)
    df = blocked(spark, x, 16)
    df = df.withColumn("key", F.lit("a")).unionByName(df.filter("idx < 10 OR idx >= 200").withColumn("key", F.lit("b")))
    got = rows(kernels.fold_blocks(df, ["key"], ["x"], k, "y"), "key", "idx", "y")
    for name, at in (("a", list(range(400))), ("b", [*range(10), *range(200, 400)])):
        want, _ = k({"idx": at, "x": x[at].tolist()}, None)
        assert np.allclose([r[2] for r in got if r[0] == name], want)
    # The last call finds nothing to do.
    assert len(calls) - 1 <= 3


def test_min_gap_thinning_of_a_dense_series(spark):
    gap = kernels.min_gap(3.0, False, "idx")
    kept = kernels.fold_blocks(blocked(spark, range(100), 10), ["series_id"], [], gap, "kept").filter("kept = 1")
    assert [r[0] for r in rows(kept, "idx")] == list(range(0, 100, 4))


def test_smoothing_with_short_spans(spark):
    x = np.sin(np.arange(150))
    want, e = [], x[0]
    for v in x:
        e += (v - e) * 0.01
        want.append(e)
    spark.conf.set("cuelattice.series.blockRows", "9")
    try:
        got = [r[1] for r in rows(series.smooth(blocked(spark, x, 9), ["series_id"], F.col("x"), 0.01, "y"), "idx", "y")]
    finally:
        spark.conf.unset("cuelattice.series.blockRows")
    assert np.allclose(got, want, atol=1e-12)


# ── plans and edits ─────────────────────────────────────────────────────

def test_windows_agree_with_the_whole_plan(spark):
    clips = spark.createDataFrame([(1, 200, 77, 30.0), (2, 270, 78, 30.0)], "clip_id INT, n_frames LONG, seed LONG, fps DOUBLE")
    plan = event_plan.plan_episodes(clips)
    whole = rows(plan, "clip_id", "id", "t", "dur")
    assert whole
    for t0 in (0.0, 2.0, 5.5):
        cut = rows(event_plan.in_window(plan, F.lit(t0), F.lit(t0 + 2.5)), "clip_id", "id", "t", "dur")
        assert cut == [r for r in whole if r[2] < t0 + 2.5 and r[2] + r[3] > t0]


def replay(base, ops, n):
    live = [dict(e) for e in base]
    for op in sorted(ops, key=lambda o: o["op_pos"]):
        if op["op"] == "add":
            if 0 <= round(op["t"]) < n:
                live.append({"id": op["id"], "frame": round(op["t"]), "level": float(op["detail"].get("level", 0.5))})
            continue
        hit = next((e for e in live if e["id"] == op["id"]), None)
        if hit is None:
            continue
        if op["op"] == "remove":
            live.remove(hit)
        elif op["op"] == "move":
            if 0 <= round(op["t"]) < n:
                hit["frame"] = round(op["t"])
            else:
                live.remove(hit)
        elif "level" in op["detail"]:
            v = op["detail"]["level"]
            hit["level"] = None if v is None else min(max(float(v), 0.0), 1.0)
    return sorted((e["id"], e["frame"], e["level"]) for e in live if e["level"] is not None) + sorted(
        (e["id"], e["frame"]) for e in live if e["level"] is None
    )


def test_edit_lists_equal_an_ordered_replay(spark):
    rng = random.Random(11)
    base = [{"id": f"e{i}", "frame": i * 5, "level": 0.5} for i in range(30)]
    ops = [{"op_pos": 0, "op": "add", "id": "mine", "t": 12.0, "detail": {"level": "0.25"}}]
    for p in range(1, 120):
        kind = rng.choices(["move", "tune", "remove"], [5, 6, 1])[0]
        t = float(rng.randint(-5, 170)) if kind == "move" else None
        detail = {} if kind != "tune" else rng.choice([{"level": str(rng.uniform(-1, 2))}, {"level": None}, {"other": "1"}])
        ops.append({"op_pos": p, "op": kind, "id": rng.choice(["mine", "ghost", *[f"e{i}" for i in range(30)]]), "t": t, "detail": detail})
    b = spark.createDataFrame([(1, e["id"], e["frame"], e["level"]) for e in base], "job INT, id STRING, frame LONG, level DOUBLE")
    o = spark.createDataFrame([(1, x["op_pos"], x["op"], x["id"], x["t"], x["detail"]) for x in ops], "job INT, op_pos LONG, op STRING, id STRING, t DOUBLE, detail MAP<STRING,STRING>")
    out = edits.apply_edits(b, o, ["job"], F.lit(1.0), F.lit(150), ["level"], {"level": (0.0, 1.0)}, {"level": 0.5}).collect()
    got = sorted((r["id"], r["frame"], r["level"]) for r in out if r["level"] is not None) + sorted((r["id"], r["frame"]) for r in out if r["level"] is None)
    assert got == replay(base, ops, 150)
    stale = edits.stale_edits(o, b, ["job"]).select("id").distinct().collect()
    assert {r[0] for r in stale} <= {"ghost"}


def test_poisson_counts_have_the_right_mean(spark):
    clips = spark.createDataFrame([(i, 5, 6000.0) for i in range(20)], "clip_id INT, seed LONG, duration DOUBLE")
    n = schedules.poisson_times(clips, ["clip_id"], "hits", 6.0, 60.0).count()
    assert abs(n - 20 * 600) < 500


# ── files ───────────────────────────────────────────────────────────────

def test_schema_file_and_reports(spark, tmp_path):
    from cuelattice.sources import documents as doc

    spec = {
        "version": "1",
        "effects": {"tone": {"id": "tone", "label": "Tone", "kind": "frame", "desc": "", "params": [
            {"name": "lift", "label": "Lift", "kind": "float", "default": 0.0, "lo": -1, "hi": 1, "step": None, "choices": [], "unit": "", "desc": "", "group": "g", "iscale": True, "fmt": "text"}]}},
        "presets": {"p1": {"id": "p1", "name": "One", "family": "film", "era": "1970s", "desc": "d", "tagline": "", "tags": ["a"], "proc_height": None, "upscale": "x",
                           "video": [["tone", {"lift": 0.1}], ["tone", {}]], "audio": [], "variants": [{"id": "v", "name": "V", "desc": "", "video": {"tone#2.lift": 0.3}, "audio": {}}]}},
    }
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps(spec))
    t = doc.read_schema_file(spark, str(path))
    assert rows(t["chain"], "which", "pos", "effect_id") == [("video", 0, "tone"), ("video", 1, "tone")]
    assert t["chain"].filter("pos = 0").first()["params"] == {"lift": "0.1"}
    assert rows(t["variant_overrides"], "effect_key", "param", "value") == [("tone#2", "lift", "0.3")]
    assert rows(t["params"], "name", "lo", "iscale") == [("lift", -1.0, True)]
    doc.write_report(spark.createDataFrame([(1, "b"), (0, "a")], "pos INT, line STRING"), str(tmp_path / "report"), ["pos"])
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "report")).collect()) == ["a", "b"]


def test_inventory_reads_no_bodies(spark, tmp_path):
    from cuelattice.sources import documents as doc

    (tmp_path / "mold").mkdir()
    for n in ("a.PNG", "b.jpg", "c.txt"):
        (tmp_path / "mold" / n).write_bytes(b"12")
    assert rows(doc.inventory(spark, str(tmp_path)), "pack", "name", "length") == [("mold", "a.PNG", 2), ("mold", "b.jpg", 2)]
    empty = doc.store_totals(spark.createDataFrame([], "n LONG, t LONG"), "n", "t").first()
    assert tuple(empty) == (0, 0, None)


def test_plan_sink(spark, tmp_path):
    clips = spark.createDataFrame([(1, 200, 77, 30.0)], "clip_id INT, n_frames LONG, seed LONG, fps DOUBLE")
    plan = event_plan.plan_episodes(clips)
    event_plan.write_plan(plan, str(tmp_path / "plan"))
    assert spark.read.parquet(str(tmp_path / "plan")).count() == plan.count()


def test_layers_dials_and_audits_on_a_small_catalog(spark):
    from cuelattice.operators import fixed_tables as ft

    keys = ["job", "effect_key"]
    st = spark.createDataFrame([(1, "grain", "grain"), (1, "vhs", "vhs")], "job INT, effect_key STRING, effect_id STRING")
    pr = spark.createDataFrame(
        [("grain", "amount", "float", "0.4", 0.0, 1.0, [], True), ("grain", "enabled", "bool", "true", 0.0, 1.0, [], False), ("vhs", "mode", "enum", "sp", 0.0, 1.0, ["sp", "ep"], False),
         ("vhs", "luma_noise", "float", "0.2", 0.0, 1.0, [], True)],
        "effect_id STRING, param STRING, kind STRING, default_value STRING, lo DOUBLE, hi DOUBLE, choices ARRAY<STRING>, iscale BOOLEAN")
    au = spark.createDataFrame([(1, "grain", "grain", "amount", "0.8"), (1, "vhs", "vhs", "mode", "ep"), (1, "vhs", "vhs", "luma_noise", "0.5")], "job INT, effect_key STRING, effect_id STRING, param STRING, value STRING")
    user = spark.createDataFrame([(1, "vhs", "luma_noise", None)], "job INT, effect_key STRING, param STRING, value STRING")
    got = catalog.resolve(st, pr, [au.drop("effect_id"), user], keys, F.lit(0.5), F.lit(0.5), ft.texture_pairs(spark))
    num = {(r["effect_key"], r["param"]): r["num"] for r in got.collect()}
    assert num[("grain", "amount")] == pytest.approx(0.2) and num[("vhs", "luma_noise")] is None
    assert rows(catalog.guardrail_hits(au, ft.guardrails(spark)), "effect_id", "param") == [("grain", "amount")]
    caps = catalog.mode_cap_hits(au, keys, "mode", ft.MODE_CAPS, "sp", ft.OTHER_MODE_CAP, list(ft.CAPPED_PARAMS))
    assert rows(caps, "effect_key", "param", "cap") == [("vhs", "luma_noise", 0.32)]


def test_empty_and_long_intervals(spark):
    from cuelattice.operators import intervals, mixing

    iv = spark.createDataFrame([(5, 0), (7, 2), (0, 3_000_000)], "start long, dur long")
    got = intervals.on_grid(iv)
    assert got.filter("start IN (5, 7)").orderBy("frame").select("frame").collect() == [(7,), (8,)]
    assert got.count() == 3_000_002 and got.agg({"frame": "max"}).first()[0] == 2_999_999
    base = spark.range(10).selectExpr("1 AS c", "id AS idx", "0.0D AS x")
    clips = spark.createDataFrame([(1, 5, 0, 1.0), (1, 2, 2, 1.0)], "c int, start long, len long, amp double")
    n = spark.createDataFrame([(1, 10)], "c int, n long")
    out = mixing.mix_at(base, ["c"], clips, n, "x", "y").filter("y > 0").orderBy("idx").select("idx").collect()
    assert [r[0] for r in out] == [2, 3]


def test_streams_over_a_folder(spark, sf_dir, tmp_path):
    """The same rows from a folder of part files as from one file, and from an empty table none."""
    import __spark_entry__ as entry

    for name in ("events", "pages"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(4).write.parquet(str(tmp_path / f"{name}.parquet"))
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    for q in ("R1_tumbling_reduce", "R2_sliding_preview", "R3_session_episodes", "R4_carried_smoothing", "R5_min_gap_alerts", "R6_job_progress", "R7_latest_request"):
        fn = entry.queries()[q]
        one, many = (fn(spark, d).collect() for d in (sf_dir, str(tmp_path)))
        assert sorted(map(str, one)) == sorted(map(str, many)) and one
    for q in ("R1_tumbling_reduce", "R3_session_episodes", "R6_job_progress"):
        assert entry.queries()[q](spark, str(tmp_path / "none")).count() == 0


@given(st.lists(st.sampled_from(["a", "bc", "word", "longerword" * 3, " ", "  ", ".", "!?", '."', "\n", "\n\n", ")", ","]), max_size=60), st.integers(16, 60))
@settings(max_examples=200, deadline=None)
def test_script_chunks_fit_and_keep_the_text(parts, most):
    from cuelattice.functions.text import chunk_script

    text = "".join(parts)
    chunks = chunk_script(text, most)
    assert all(0 < len(c) <= most for c in chunks)
    letters = lambda s: [c for c in s if c.isalpha()]
    assert letters("".join(chunks)) == letters(text)


def test_closest_ranks_far_names_too(spark, monkeypatch):
    rng = random.Random(11)
    names = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(0, 9))) for _ in range(60)}) + [None, "abc", "abc"]
    asked = ["abcd", "", "zzzzzzzzzzzzzzzz", None, "abcd"]
    monkeypatch.setattr(catalog, "NAMES_PER_BLOCK", 7)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = []
    for a in {x for x in asked if x is not None}:
        ranked = sorted((distance(a, b), b) for b in {x for x in names if x is not None})
        want += [(a, r, b, d) for r, (d, b) in enumerate(ranked[:3], 1)]
    ask, know = spark.createDataFrame([(a,) for a in asked], "asked STRING"), spark.createDataFrame([(b,) for b in names], "name STRING")
    assert rows(catalog.closest(ask, know, "asked", "name"), "asked", "rank", "name", "distance") == sorted(want)
    assert not catalog.closest(ask, know.filter("false"), "asked", "name").collect()
    assert not catalog.closest(ask.filter("false"), know, "asked", "name").collect()

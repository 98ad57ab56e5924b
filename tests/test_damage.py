"""Edits on events with geometry and curves, against a replay in order; the damage plan over many blocks."""

import random

import numpy as np
from pyspark.sql import functions as F

from cuelattice.operators import event_edits as ee

BASE = "clip_id long, effect string, kind string, id string, frame long, frames long, intensity double, x long, row long, length long, rows long, dark boolean, band_pos double, band_height double, text string, fps double, n_frames long, width int, height int"
OPS = "clip_id long, op_pos long, op string, effect string, kind string, id string, t double, detail map<string,string>, fps double, n_frames long, width int, height int"
FPS, N, W, H = 10.0, 200, 640, 480


def replay(curve, dropout, ops):
    """One storm and one dropout through the operations in order."""
    storm, drop = {"f": 20, "seg": np.array(curve)}, dict(dropout)
    for op, kind, t, d in ops:
        x = storm if kind == ee.STORM else drop
        if x.get("gone"):
            continue
        if op == "remove":
            x["gone"] = True
        elif op == "move":
            f = round(t * FPS)
            x["gone"] = not 0 <= f < N
            x["f"] = f
        elif kind == ee.STORM:
            if "intensity" in d:
                x["seg"] = np.clip(x["seg"] * (float(d["intensity"]) / (x["seg"].max() or 1.0)), 0, 1)
            if "dur_s" in d:
                n = max(round(float(d["dur_s"]) * FPS), 2)
                x["seg"] = np.interp(np.linspace(0, len(x["seg"]) - 1, n), np.arange(len(x["seg"])), x["seg"])
        else:
            if "row" in d:
                x["row"] = min(max(int(d["row"]), 0), H - 1)
            if "x" in d:
                x["x"] = min(max(int(d["x"]), 0), W - 2)
            if "length_px" in d:
                x["length"] = max(min(int(d["length_px"]), W - x["x"]), 6)
            if "rows" in d:
                x["rows"] = 1 if int(d["rows"]) <= 1 else 2
    return storm, drop


def test_edits_replay_in_order(spark):
    rnd = random.Random(2)
    base, ops, want, shapes = [], [], {}, {}
    for clip in range(40):
        curve = [round(rnd.uniform(0.05, 1), 3) for _ in range(rnd.randint(1, 9))]
        drop = {"f": 30, "x": rnd.randint(0, 500), "row": 5, "length": 90, "rows": 1}
        base.append((clip, "vhs", ee.STORM, "s", 20, len(curve), max(curve), *[None] * 8, FPS, N, W, H))
        base.append((clip, "vhs", ee.DROPOUT, "d", 30, 1, None, drop["x"], 5, 90, 1, False, None, None, None, FPS, N, W, H))
        shapes[clip] = curve
        mine = []
        for pos in range(rnd.randint(0, 7)):
            kind = rnd.choice([ee.STORM, ee.DROPOUT])
            op = rnd.choices(["tune", "move", "remove"], [12, 2, 1])[0]
            pick = {"intensity": round(rnd.uniform(0.1, 1.6), 2), "dur_s": round(rnd.uniform(0.05, 2), 2)} if kind == ee.STORM else {"x": rnd.randint(-50, 800), "length_px": rnd.randint(-5, 700), "row": rnd.randint(-9, 600), "rows": rnd.randint(0, 4)}
            detail = {k: str(v) for k, v in pick.items() if rnd.random() < 0.6} if op == "tune" else {}
            t = rnd.uniform(-2, 22) if op == "move" else None
            mine.append((op, kind, t, detail))
            ops.append((clip, pos, op, "vhs", kind, "s" if kind == ee.STORM else "d", t, detail, FPS, N, W, H))
        want[clip] = replay(curve, drop, mine)
    curves = spark.createDataFrame([(c, "s", v) for c, v in shapes.items()], "clip_id long, id string, curve array<double>")
    got = ee.apply_edits(spark.createDataFrame(base, BASE), spark.createDataFrame(ops, OPS), lambda asked: curves.join(asked.select("clip_id", "id"), ["clip_id", "id"]), ["clip_id"]).collect()
    assert len(got) == sum(not x.get("gone") for pair in want.values() for x in pair)
    for r in got:
        storm, drop = want[r["clip_id"]]
        if r["kind"] == ee.STORM:
            assert (r["frame"], r["frames"]) == (storm["f"], len(storm["seg"])) and abs(r["intensity"] - storm["seg"].max()) < 1e-9
            assert r["curve"] is None or np.allclose(r["curve"], storm["seg"])
        else:
            assert (r["frame"], r["x"], r["row"], r["length"], r["rows"]) == tuple(drop[k] for k in ("f", "x", "row", "length", "rows"))


def test_added_events_and_null_pins(spark):
    ops = [
        (1, 0, "add", "vhs", ee.STORM, "a", 2.0, {"intensity": "3", "dur_s": "0.5", "band_pos": "2"}, FPS, N, W, H), (1, 1, "tune", "vhs", ee.STORM, "a", None, {"band_pos": None}, FPS, N, W, H),
        (1, 2, "add", "vhs", ee.DROPOUT, "b", 3.0, {"x": "630", "length_px": "100", "row": "999"}, FPS, N, W, H), (1, 3, "add", "vhs", ee.TEAR, "gone", 99.0, {}, FPS, N, W, H),
        (1, 4, "add", "captions", ee.CAPTION, "c", 0.0, {"text": "hello"}, FPS, N, W, H), (1, 5, "remove", "vhs", ee.GLITCH, "never made", None, {}, FPS, N, W, H),
    ]
    none = spark.createDataFrame([], BASE)
    got = {r["id"]: r for r in ee.apply_edits(none, spark.createDataFrame(ops, OPS), lambda asked: asked.select("clip_id", "id", F.lit(None).cast("array<double>").alias("curve")), ["clip_id"]).collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"]["frames"] == 5 and len(got["a"]["curve"]) == 5 and 0.5 < got["a"]["intensity"] <= 1.0 and got["a"]["band_pos"] is None and got["a"]["edited"]
    assert (got["b"]["x"], got["b"]["length"], got["b"]["row"], got["b"]["edited"]) == (540, 100, 479, False)
    assert (got["c"]["frame"], got["c"]["frames"], got["c"]["text"]) == (0, 25, "hello")

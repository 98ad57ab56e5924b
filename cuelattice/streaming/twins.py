"""Structured Streaming twins of the operators that carry state or close windows.

Late rows are dropped past the watermark (ten minutes unless said otherwise) and show up in the
query's progress metrics. Sinks are files in the shared folder, so a restarted query goes on from
its checkpoint.
"""

from __future__ import annotations

import datetime
import json
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cuelattice.session import scratch_dir

WATERMARK = "10 minutes"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# A batch saves its changes, the state as a whole is saved every few batches, and versions that no restart needs are cleared. Else every batch
# saves the files that it has merged anew, and those of 100 batches stay: the disk would grow with the batches times the state.
SAVED_CHANGES = {"spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", "spark.sql.streaming.minBatchesToRetain": "2"}


def parse_progress(lines: DataFrame, keep: list[str]) -> DataFrame:
    """``{"phase", "progress"}`` lines, batch or stream; unreadable lines give nulls."""
    p = F.from_json("value", "phase STRING, progress DOUBLE")
    return lines.select(*keep, p.alias("p")).select(*keep, "p.phase", "p.progress")


def table_stream(spark: SparkSession, sf_dir: str, name: str, batch_bytes: str | None = None) -> DataFrame:
    """A table folder as a stream: files that arrive later join in. ``batch_bytes`` bounds a micro-batch,
    and with it the rows of one key that a stateful step sorts at a time."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    reader = reader if batch_bytes is None else reader.option("maxBytesPerTrigger", batch_bytes)
    # A pattern may stand for one file as well as for a folder of part files.
    return reader.parquet(f"{sf_dir}/{name}[.]parquet")


# A row of this time ends a bounded input: it moves the watermark past every open window.
END_OF_INPUT = datetime.datetime(9999, 1, 1)


def with_end(events: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The stream together with a folder, empty so far, that ``run_to_files`` puts the closing row into."""
    spark = events.sparkSession
    path = f"{scratch_dir(spark)}/stream/{label}-end-{uuid.uuid4().hex}"
    spark.createDataFrame([], events.schema).write.parquet(path)
    return events.unionByName(spark.readStream.schema(events.schema).parquet(path)), path


def run_to_files(df: DataFrame, label: str, end: tuple[str, DataFrame] | None = None) -> DataFrame:
    """Drain what is available now into Parquet files (append, exactly once) and read them.

    ``end`` (the folder of ``with_end`` and its closing row) says that the input is complete: after the drain the row is
    written and the query goes on from its checkpoint, so that windows still open are emitted too.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/stream/{label}-{uuid.uuid4().hex}"

    def drain() -> None:
        q = (
            df.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out")
            .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        )
        q.awaitTermination()

    drain()
    if end is not None:
        end[1].write.mode("append").parquet(end[0])
        drain()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def run_to_latest(
    df: DataFrame, label: str, keys: list[str], version: str, progress: list | None = None, newest: bool = True, settings: dict[str, str] | None = None,
) -> DataFrame:
    """Drain in update mode: every batch is appended with its number, readers keep the newest row per key. ``progress`` takes the batches' metrics.

    Without ``newest`` the rows of all batches come back, numbered in ``version``, for a reader that groups them itself. ``settings`` hold for this query alone.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/stream/{label}-{uuid.uuid4().hex}"

    # An empty input writes no batch; the reader needs a table all the same.
    spark.createDataFrame([], df.schema).withColumn(version, F.lit(-1)).write.parquet(f"{path}/out/batch=-1")

    def put(batch: DataFrame, number: int) -> None:
        # One folder per batch, overwritten on a retry, keeps a repeated batch from counting twice.
        batch.withColumn(version, F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    # A query keeps the settings of its start.
    before = {k: spark.conf.get(k, None) for k in settings or {}}
    for k, v in (settings or {}).items():
        spark.conf.set(k, v)
    try:
        q = (
            df.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/state")
            .trigger(availableNow=True).start()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    q.awaitTermination()
    if progress is not None:
        progress.extend(json.loads(p.json) for p in q.recentProgress)
    rows = spark.read.parquet(f"{path}/out").drop("batch")
    if not newest:
        return rows
    rest = [c for c in df.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r"))
    return latest.select(*keys, "_r.*")


# ── windows ─────────────────────────────────────────────────────────────

def tumbling_reduce(events: DataFrame, ts: str, keys: list[str], value: str, size: str) -> DataFrame:
    """Peak, rms and low of tumbling event-time blocks."""
    x = F.col(value)
    return events.withWatermark(ts, WATERMARK).groupBy(F.window(ts, size), *keys).agg(
        F.max(x).alias("peak"), F.sqrt(F.avg(x * x)).alias("rms"), F.min(x).alias("low")
    )


def sliding_preview(events: DataFrame, ts: str, keys: list[str], size: str, slide: str) -> DataFrame:
    return events.withWatermark(ts, WATERMARK).groupBy(F.window(ts, size, slide), *keys).agg(F.count(F.lit(1)).alias("n"))


def session_episodes(active: DataFrame, ts: str, keys: list[str], value: str, gap: str) -> DataFrame:
    """Episodes as sessions: runs of active rows no further apart than one tick."""
    return active.withWatermark(ts, WATERMARK).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("length"), F.max(value).alias("peak")
    )


def latest_wins(requests: DataFrame, ts: str, keys: list[str], order: list[str], cols: list[str], span: str) -> DataFrame:
    """Newest request per surface and ``span`` of event time.

    The watermark ends a span's state. A surface that comes back later starts a new span; ``newest_of`` reads the newest over all spans, so what was superseded stays so.
    """
    spans = requests.withWatermark(ts, WATERMARK).groupBy(F.window(ts, span).alias("span"), *keys)
    return spans.agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"), F.max(F.struct(*order)).alias("_order")).select("span", *keys, "_order", "_r.*")


def newest_of(spans: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return spans.groupBy(*keys).agg(F.max_by(F.struct(*cols), "_order").alias("_r")).select(*keys, "_r.*")


def monotone_progress(progress: DataFrame, ts: str, job: str, value: str, span: str) -> DataFrame:
    """Highest progress per job and ``span`` of event time; the watermark ends a span's state.

    A job that reports again after its span has ended starts a new one; the reader takes the highest over all spans, so progress never goes back.
    """
    return progress.withWatermark(ts, WATERMARK).groupBy(F.window(ts, span).alias("span"), job).agg(F.max(value).alias("progress"))


# ── carried state ───────────────────────────────────────────────────────

Step = Callable[[float, float | None, float], float]


BUCKET_MS = 60_000
# Buckets of event time in which rows wait, in minutes, the widest last; one above them holds all times.
BUCKET_MINUTES = (1, 64, 64**2, 64**3)
BUCKET_ROWS = 1 << 16
COLUMNS = (("key", "<i8"), ("none", "u1"), ("ms", "<i8"), ("t", "<f8"), ("event_id", "<i8"), ("x", "<f8"))
MS = 2
# Keys share this many states: a state is read and written as a whole, and a call for each of very many keys would cost more than their rows.
SHARDS = 1024


class EventOrder(StatefulProcessor):
    """Takes the rows of a shard of keys in event order, however they are spread over micro-batches.

    Rows wait in a map state by bucket of event time, one entry per bucket and arriving batch of rows, until the watermark has passed their minute. A shard begins with one bucket for
    all times, so few rows are few entries; a bucket that comes to hold more than ``bucket_rows`` rows is dealt to narrower ones, down to a minute. Buckets are then read,
    sorted and taken one after the other, so a shard never has more rows in memory than a bucket or an arriving batch of rows holds. Rows come as (shard, key, whether the key is
    null, ms since the epoch, t seconds, event_id, x). What ``take`` carries for its keys is ``width`` numbers a key.
    """

    bucket_ms, bucket_rows = BUCKET_MS, BUCKET_ROWS
    width = 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "width int, bucket bigint, part int", ", ".join(f"{c} binary" for c, _ in COLUMNS))
        # JSON: ``due``, the time of the shard's timer, and ``at``, (width, bucket) with its number of parts, its rows and its first minute; no part says that it was dealt out.
        self.held = handle.getValueState("held", "doc string")
        self.last = handle.getValueState("last", "key binary, none binary, carried binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, at = self._held()
        for pdf in rows:
            if len(pdf):
                self._put(at, (len(BUCKET_MINUTES), 0), [pdf[c].to_numpy(kind) for c, kind in COLUMNS])
        self._hold(due, at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // self.bucket_ms
        _, at = self._held()
        ready = sorted((w for w, (parts, _, first) in at.items() if parts and first < passed), key=lambda w: at[w][2])
        carried = self._carried() if ready else {}
        for where in ready:
            got = self._take_out(at, where)
            minute = got[MS] // self.bucket_ms
            if minute.max() >= passed:
                self._put(at, where, [c[minute >= passed] for c in got])
                got = [c[minute < passed] for c in got]
            yield self._taken(got, carried)
        if ready:
            keys = np.array([k for k, _ in carried], "<i8"), np.array([n for _, n in carried], "u1")
            self.last.update((*(c.tobytes() for c in keys), np.array([*carried.values()], "<f8").tobytes()))
        for where in [w for w, (parts, _, _) in at.items() if not parts and self._end(w) <= passed]:
            del at[where]
        self._hold(None, at)

    def _carried(self) -> dict[tuple[int, int], tuple[float, ...]]:
        got = self.last.get()
        if got is None:
            return {}
        keys, none, values = (np.frombuffer(g, kind) for g, kind in zip(got, ("<i8", "u1", "<f8")))
        return dict(zip(zip(keys.tolist(), none.tolist()), map(tuple, values.reshape(-1, self.width).tolist())))

    def _taken(self, got: list[np.ndarray], carried: dict) -> pd.DataFrame:
        """One bucket's rows, key by key in event order."""
        key, none, _, t, ids, x = got
        order = np.lexsort((ids, t, key, none))
        key, none = key[order], none[order]
        rows = list(zip(t[order].tolist(), ids[order].tolist(), x[order].tolist()))
        at = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (none[1:] != none[:-1])) + 1).tolist(), len(rows)]
        outs, counts = [], []
        for lo, hi in zip(at[:-1], at[1:]):
            who = (int(key[lo]), int(none[lo]))
            out, carried[who] = self.take(rows[lo:hi], carried.get(who))
            outs += out
            counts.append(len(out))
        firsts = at[:-1]
        whose = pd.array(np.repeat(key[firsts], counts), dtype="Int64")
        whose[np.repeat(none[firsts], counts).astype(bool)] = pd.NA
        return pd.DataFrame({self.key: whose, **{c: [o[i] for o in outs] for i, c in enumerate(self.columns)}})

    def _end(self, where: tuple[int, int]) -> float:
        width, bucket = where
        return (bucket + 1) * BUCKET_MINUTES[width] if width < len(BUCKET_MINUTES) else math.inf

    def _put(self, at: dict, where: tuple[int, int], cols: list[np.ndarray]) -> None:
        """Rows into a bucket, or into narrower ones where it holds too many."""
        parts, n, first = at.get(where, (0, 0, None))
        dealt = where in at and not parts
        if not dealt and where[0] and n + len(cols[0]) > self.bucket_rows:
            if parts:
                cols = [np.concatenate(c) for c in zip(self._take_out(at, where), cols)]
            at[where], dealt = (0, 0, None), True
        minute = cols[MS] // self.bucket_ms
        if not dealt:
            self.waiting.updateValue((*where, parts), tuple(c.tobytes() for c in cols))
            least = int(minute.min())
            at[where] = (parts + 1, n + len(minute), least if first is None else min(first, least))
            return
        bucket = minute // BUCKET_MINUTES[where[0] - 1]
        for b in np.unique(bucket).tolist():
            self._put(at, (where[0] - 1, b), [c[bucket == b] for c in cols])

    def _take_out(self, at: dict, where: tuple[int, int]) -> list[np.ndarray]:
        got = []
        for part in range(at.pop(where)[0]):
            got.append(self.waiting.getValue((*where, part)))
            self.waiting.removeKey((*where, part))
        return [np.concatenate([np.frombuffer(g[i], kind) for g in got]) for i, (_, kind) in enumerate(COLUMNS)]

    def _held(self) -> tuple[int | None, dict]:
        doc = self.held.get()
        doc = {"due": None, "at": []} if doc is None else json.loads(doc[0])
        return doc["due"], {(w, b): (parts, n, first) for w, b, parts, n, first in doc["at"]}

    def _hold(self, due: int | None, at: dict) -> None:
        """One timer per key: the moment its earliest waiting minute is passed."""
        firsts = [first for parts, _, first in at.values() if parts]
        if not firsts:
            self.held.clear()
            return
        ms = (min(firsts) + 1) * self.bucket_ms
        if due is not None and due > ms:
            self.handle.deleteTimer(due)
        if due is None or due > ms:
            self.handle.registerTimer(ms)
            due = ms
        self.held.update((json.dumps({"due": due, "at": [[*w, *v] for w, v in at.items()]}),))

    def take(self, rows: list[tuple], carried: tuple[float, ...] | None) -> tuple[list[tuple], tuple[float, ...]]:
        """The rows (t, event_id, x) of one key and what it carries so far, to output rows (``columns``) and what it carries on."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class CarriedState(EventOrder):
    """One number per key carried from row to row.

    ``step(x, previous output, seconds since the row before)`` gives the new output.
    """

    width, columns = 2, ("event_id", "y")

    def __init__(self, key: str, step: Step):
        self.key, self.step = key, step

    def take(self, rows: list[tuple], carried: tuple[float, ...] | None) -> tuple[list[tuple], tuple[float, ...]]:
        y, t0 = carried or (None, None)
        out = []
        for t, i, x in rows:
            y = self.step(x, y, 0.0 if t0 is None else t - t0)
            t0 = t
            out.append((i, y))
        return out, (float(y), float(t0))


class MinGap(EventOrder):
    """Alert throttling: keeps a row only ``gap`` or more after the last kept one of its key."""

    columns = ("event_id",)

    def __init__(self, key: str, gap: float):
        self.key, self.gap = key, gap

    def take(self, rows: list[tuple], carried: tuple[float, ...] | None) -> tuple[list[tuple], tuple[float, ...]]:
        last = None if carried is None else carried[0]
        out = []
        for t, i, _ in rows:
            if last is None or t - last >= self.gap:
                last = t
                out.append((i,))
        return out, (float(last),)


def with_state(events: DataFrame, key: str, ts: str, t: Column, x: Column, processor: EventOrder, schema: str) -> DataFrame:
    """Events through ``processor``: ``ts`` is their event time, ``t`` their place in seconds, ``x`` the value taken. ``key`` holds whole numbers; null is a key of its own."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    # The closing row only moves the watermark; a filter on the event time stays above it.
    rows = events.withWatermark(ts, WATERMARK).filter(F.col(ts) < F.lit(END_OF_INPUT))
    own = F.col(key).cast("long")
    rows = rows.select(
        F.pmod(F.xxhash64(own), F.lit(SHARDS)).alias("shard"), F.coalesce(own, F.lit(0).cast("long")).alias("key"), own.isNull().alias("none"),
        ts, t.alias("t"), F.unix_millis(ts).alias("ms"), "event_id", x.cast("double").alias("x"),
    )
    return rows.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


def smoothing_step(alpha: float) -> Step:
    return lambda x, y, _: x if y is None else y + (x - y) * alpha


def decay_step(ratio: float) -> Step:
    return lambda x, y, _: x if y is None else max(x, y * ratio)


def gated_step(strength: float) -> Step:
    return lambda x, y, _: x if y is None else x + (y - x) * strength * 0.8 * math.exp(-abs(x - y) / 0.13)


def follower_step(attack: float, release: float) -> Step:
    """Attack/release follower; the coefficients are what is kept of the output while it rises or falls."""

    def step(x: float, y: float | None, _: float) -> float:
        if y is None:
            return x
        c = attack if x > y else release
        return c * y + (1.0 - c) * x

    return step


# ── edits ───────────────────────────────────────────────────────────────

def folded_edits(
    edits: DataFrame, base: DataFrame, fps: Column, clip_frames: Column, fields: list[str], clamp: Callable[[str, Column], Column], defaults: dict[str, float | None],
) -> DataFrame:
    """What an edit list has made of each event so far, one row per batch and event (job, id) that the batch names.

    The state is an aggregate of DataFrame functions: the instances added (``born``, by their position), and the latest position of any edit, of a removal (``kill``), of a move
    (``to``) and of each field's tune. An operation counts for an instance if it comes after it, and only the latest of a sort counts, so operations may arrive in
    any order and a batch reads nothing but its own rows and the states they name. ``folded_plan`` puts the folds to the events of ``base``.
    """
    edits.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    frame = F.rint(F.col("t") * fps).cast("long")
    inside = F.coalesce((frame >= 0) & (frame < clip_frames), F.lit(False))
    add, moves = F.coalesce(F.col("op") == "add", F.lit(False)), F.coalesce((F.col("op") == "move") & frame.isNotNull(), F.lit(False))
    own = F.when(add, F.coalesce("id", F.concat(F.lit("edit:add:"), frame.cast("string")))).otherwise(F.col("id"))
    value = lambda f: clamp(f, F.try_element_at("detail", F.lit(f)))
    named = lambda f: F.coalesce(F.map_contains_key("detail", F.lit(f)), F.lit(False))
    pos = F.col("op_pos").cast("long")
    born = F.struct(pos.alias("at"), frame.alias("frame"), *[F.when(named(f), value(f)).otherwise(F.lit(defaults.get(f)).cast("double")).alias(f) for f in fields])
    rows = edits.select(
        "job", own.alias("id"), F.when(add & inside, born).alias("born"), F.when(~add, pos).alias("any"),
        F.when(~add & (F.coalesce(F.col("op") == "remove", F.lit(False)) | (moves & ~inside)), pos).alias("kill"), F.when(moves, F.struct(pos.alias("at"), frame.alias("v"))).alias("to"),
        *[F.when((F.col("op") == "tune") & named(f), F.struct(pos.alias("at"), value(f).alias("v"))).alias(f"t_{f}") for f in fields],
    )
    latest = [F.max(c).alias(c) for c in ("any", "kill", "to", *[f"t_{f}" for f in fields])]
    return rows.groupBy("job", "id").agg(F.collect_set("born").alias("born"), *latest)


def folded_plan(latest: DataFrame, base: DataFrame, fields: list[str], version: str | None = None) -> DataFrame:
    """The plan of every job that was edited: the instances its newest folds leave alive, and its events that no operation named.

    ``latest`` has one fold an event; with ``version`` it may have one of every batch, and the newest counts. The events of edited jobs meet the folds in one shuffle by event.
    """
    folds = [c for c in latest.columns if c not in ("job", "id", version)]
    number = F.lit(0) if version is None else F.col(version)
    folded = latest.select("job", "id", F.struct(*folds).alias("fold"), number.alias("_number"))
    seed = F.struct(F.lit(-1).cast("long").alias("at"), F.col("frame").cast("long").alias("frame"), *[F.col(f).cast("double").alias(f) for f in fields])
    mine = base.join(latest.select("job").distinct(), "job", "left_semi").unionByName(base.filter("job IS NULL"))
    met = mine.select("job", "id", seed.alias("seed")).unionByName(folded, allowMissingColumns=True)
    met = met.groupBy("job", "id").agg(F.collect_list("seed").alias("seeds"), F.max_by("fold", "_number").alias("fold"))
    met = met.select("job", "id", "seeds", F.col("fold").isNotNull().alias("named"), "fold.*")
    # One instance a position.
    born = F.array_sort("born")
    born = F.filter(born, lambda e, i: (i == 0) | (F.get(born, i - 1)["at"] != e["at"]))
    alive = F.concat(F.when(F.size("seeds") == 0, F.array()).otherwise(F.array(F.array_max("seeds"))).cast(latest.schema["born"].dataType), born)
    # No operation names an event without an id, and none of its job an event without a job.
    rest = F.when((~F.col("named") | F.col("id").isNull()) & F.col("job").isNotNull(), F.col("seeds"))
    each = lambda of, rest: F.transform(F.coalesce(of, F.array().cast(latest.schema["born"].dataType)), lambda e: F.struct(F.lit(rest).alias("rest"), e.alias("e")))
    met = met.withColumn("_i", F.explode(F.concat(each(F.when(F.col("named"), alive), False), each(rest, True)))).select("*", "_i.*")
    after = lambda at: F.coalesce(~F.col("rest") & (at > F.col("e.at")), F.lit(False))
    return met.filter(~after(F.col("kill"))).select(
        "job", "id", F.when(after(F.col("to.at")), F.col("to.v")).otherwise(F.col("e.frame")).alias("frame"),
        F.when(F.col("e.at") < 0, "seeded").otherwise("added").alias("origin"), after(F.col("any")).alias("edited"),
        *[F.when(after(F.col(f"t_{f}.at")), F.col(f"t_{f}.v")).otherwise(F.col(f"e.{f}")).alias(f) for f in fields],
    )

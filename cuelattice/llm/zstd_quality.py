"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text is cut into slices of ``SLICE`` bytes, so that the dictionary matters in every part of a long text, and each slice is
compressed with either dictionary. The difference of the two sums per byte of text is the one feature (near 0 for text that repeats
itself, which either dictionary compresses away); isotonic calibration on
labelled texts that the dictionaries have not seen makes it the probability of label 1.

The dictionaries are fitted on ``SAMPLE_BYTES`` of slices per label at most (of ``SAMPLE`` whole texts, both by hash), the calibration on
``CALIBRATION`` texts per label at most.

Defined cases: null and empty texts have feature 0 and so the score that the calibration gives there; without labelled text of both kinds every
score is the share of label 1 (0.5 without any); null labels are not learned from; repeated labels of one document count once
per distinct label; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cuelattice.llm.arrays import text_buffer, worker_memo
from cuelattice.session import materialize

SAMPLE = 1500
SAMPLE_BYTES = 6 << 20
CALIBRATION = 2000
DICTIONARY = 112 << 10
SLICE = 512
LEVEL = 1


@dataclass
class Model:
    good: bytes
    bad: bytes
    xs: np.ndarray  # calibration: features, rising, and the probability of label 1 at each
    ps: np.ndarray

    def compressors(self):
        import zstandard as z

        made = []
        for d in (self.good, self.bad):
            kept = z.ZstdCompressionDict(d)
            kept.precompute_compress(level=LEVEL)
            made.append(z.ZstdCompressor(level=LEVEL, dict_data=kept, write_content_size=False, write_checksum=False, write_dict_id=False))
        return made

    def features(self, col: pa.Array) -> np.ndarray:
        """(bad - good) compressed bytes per byte of text; 0 for an empty text."""
        good, bad = worker_memo(("zstd", hash((self.good, self.bad))), self.compressors)
        raw, off = text_buffer(col)
        data = memoryview(raw)
        out = np.zeros(len(off) - 1)
        for i, (a, z) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            g = b = 0
            for s in range(a, z, SLICE):
                part = data[s : min(z, s + SLICE)]
                g += len(good.compress(part))
                b += len(bad.compress(part))
            if z > a:
                out[i] = (b - g) / (z - a)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.xs, self.ps)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step function nearest to ``y`` (pooled neighbours), as the mean feature and the mean label of its steps."""
    pools: list[list[float]] = []  # weight, weight * x, weight * y
    order = np.argsort(x, kind="stable")
    for xi, yi, wi in zip(x[order].tolist(), y[order].tolist(), w[order].tolist()):
        pools.append([wi, wi * xi, wi * yi])
        while len(pools) > 1 and pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    m = np.array(pools)
    return m[:, 1] / m[:, 0], m[:, 2] / m[:, 0]


def labelled(docs: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(k, y) of the labelled documents; no text is read."""
    side = labels.select(F.col(key).alias("lk"), F.col(label).cast("int").alias("y")).filter("y IN (0, 1)").distinct()
    return docs.select(F.col(key).alias("k")).distinct().join(side, F.col("k") == F.col("lk")).select("k", "y")


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    rows = materialize(labelled(docs, labels, key, label), "quality-labels")
    sizes = materialize(rows.groupBy("y").count(), "quality-sizes")
    share = {r["y"]: r["count"] for r in sizes.collect()}
    n1, n0 = share.get(1, 0), share.get(0, 0)
    flat = np.zeros(1), np.full(1, n1 / (n1 + n0) if n1 + n0 else 0.5)
    if not n1 or not n0:
        return Model(b"", b"", *flat)
    # By hash: the first part of the hashes feeds the dictionaries, what follows the calibration.
    want = SAMPLE + CALIBRATION
    rows = rows.join(sizes, "y").withColumn("h", F.xxhash64(F.lit("quality"), "k"))
    few = rows.filter(F.pmod("h", F.lit(1 << 30)) <= F.lit(1.5 * want * (1 << 30)) / F.col("count"))
    # The few are written before they meet the texts: the planner knows their size then, and no text is shuffled for them.
    few = materialize(few, "quality-few")
    texts = docs.select(F.col(key).alias("tk"), F.col(text).alias("text")).filter("text IS NOT NULL AND text != ''")
    few = few.join(texts, F.col("k") == F.col("tk")).drop("tk")
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("h", "text"))).filter(F.col("r") <= want)
    cut = F.least(F.lit(SAMPLE), F.floor(F.least(F.col("count"), F.lit(want)) / 2))
    few = few.withColumn("for_dictionary", F.col("r") <= cut).select("y", "r", "h", "for_dictionary", "text")
    few = materialize(few, "quality-sample")
    # Slices of whole texts, those with the least hashes of (id, slice number) until the sample is full.
    texts = few.filter("for_dictionary").select("y", "r", "h", F.encode("text", "UTF-8").alias("b")).withColumn("bytes", F.sum(F.length("b")).over(Window.partitionBy("y")))
    slices = texts.select("y", "r", "h", "bytes", "b", F.explode(F.sequence(F.lit(0), F.floor((F.length("b") - 1) / SLICE).cast("int"))).alias("i"))
    slices = slices.withColumn("s", F.xxhash64("h", "i")).filter(F.pmod("s", F.lit(1 << 30)) <= F.lit(1.5 * SAMPLE_BYTES * (1 << 30)) / F.col("bytes"))
    slices = slices.select("y", "r", "i", F.pmod("s", F.lit(1 << 30)).alias("s"), F.expr(f"substring(b, i * {SLICE} + 1, {SLICE})").alias("b"))
    room = Window.partitionBy("y").orderBy("s", "r", "i").rowsBetween(Window.unboundedPreceding, 0)
    slices = slices.withColumn("upto", F.sum(F.length("b")).over(room)).filter(F.col("upto") <= SAMPLE_BYTES)
    parts: dict[int, list[bytes]] = {0: [], 1: []}
    for r in slices.orderBy("y", "s", "r", "i").select("y", "b").collect():
        parts[r["y"]].append(bytes(r["b"]))
    size = min(DICTIONARY, min(sum(map(len, p)) for p in parts.values()) // 4)
    model = Model(_dictionary(parts[1], size), _dictionary(parts[0], size), *flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.features(b.column(0))), b.column(1)], ["x", "y"])

    got = few.filter("NOT for_dictionary").select("text", "y").mapInArrow(run, "x double, y int").orderBy("x", "y").toPandas()
    if got["y"].nunique() == 2:
        w = np.where(got["y"] == 1, n1 / (got["y"] == 1).sum(), n0 / (got["y"] == 0).sum()) / (n1 + n0) * len(got)
        model.xs, model.ps = isotonic(got["x"].to_numpy(), got["y"].to_numpy().astype(float), w)
    return model


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the samples' own bytes where they are too few to train on."""
    import zstandard as z

    try:
        return z.train_dictionary(max(size, 256), samples).as_bytes()
    except z.ZstdError:
        return b"".join(samples)[-max(size, 256) :]


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, feature, score for every row."""
    kind = docs.select(F.col(key).alias("k")).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = model.features(b.column(1)) if model.good else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x), pa.array(model.score(x))], ["k", "feature", "score"])

    return docs.select(F.col(key).alias("k"), F.col(text).alias("text")).mapInArrow(run, f"k {kind}, feature double, score double").withColumnRenamed("k", key)

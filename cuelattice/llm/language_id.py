"""Language by nearest centroid: TF-IDF vectors of byte trigrams against several clustered centroids per language.

Letters are lower-cased, everything else is a blank, every text stands between two blanks, and trigrams are hashed to ``DIM`` places. The classifier is fitted on a bounded sample:
``SAMPLE`` texts for each of the ``LANGUAGES`` languages with most texts, chosen by a hash of id and text. IDF is counted and the spherical k-means centroids of a language are fitted on
executors, from one language's vectors at a time; the driver gets the centroids.

A text takes the language of the centroid with the greatest cosine. It is rejected if that cosine is below what texts of its length have: pieces of the sample texts,
from 32 trigrams on in powers of two, give the cosine that one in a hundred stays below, and ``SLACK`` times that is the limit for their length. Shorter texts are not rejected, for
their cosines tell nothing.

Defined cases: a null text or one without letters is ``und``, score 0, rejected; a text without a known trigram has cosine 0 and takes the
language with most sample texts; with no labelled text at all every text is ``und``; rows with equal id and text count once in the sample, null ids like any other; ties give the language
that sorts first; a very long text is worked on whole; an empty table gives an empty result; the input row comes back as ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from cuelattice.llm.arrays import row_pieces, text_buffer
from cuelattice.session import materialize

DIM = 4096
SAMPLE = 300  # texts per language that the classifier is fitted on
CENTROIDS = 4
LANGUAGES = 256
SLACK = 0.75
SHORT = 5  # log2 of the trigrams from which on a text can be rejected
LEVELS = 24
UNKNOWN = "und"


def _letters() -> np.ndarray:
    t = np.full(256, 32, np.uint8)
    t[65:91] = np.arange(97, 123)
    t[97:123] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


def trigram_vectors(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Rows lo to hi and their matrix of log(1 + count)."""
    raw, off = text_buffer(pc.binary_join_element_wise(" ", pc.fill_null(col, ""), " ", ""))
    table = _letters()
    for lo, hi in row_pieces(off, 1 << 20):
        b = table[raw[off[lo] : off[hi]]]
        upper = np.flatnonzero((b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[:-1] == 0xC3)) + 1  # Latin capitals with marks
        b[upper] += 32
        x = b.astype(np.uint32)
        grams = np.zeros(0, np.int64)
        if len(x) > 2:
            blank = (b[:-2] == 32) & (b[1:-1] == 32)
            g = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
            grams = np.where(blank, DIM, g).astype(np.int64)
        for at in range(lo, hi, 256):
            to = min(hi, at + 256)
            m = np.zeros((to - at, DIM), np.float32)
            for i in range(at, to):
                s, e = off[i] - off[lo], off[i + 1] - off[lo] - 2
                if e > s:
                    m[i - at] = np.bincount(grams[s:e], minlength=DIM + 1)[:DIM]
            yield at, to, np.log1p(m, out=m)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts at the texts that lie farthest from the starts before them."""
    starts = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(starts) < min(k, len(x)):
        starts.append(int(np.argmin((x @ x[starts].T).max(axis=1))))
    c = x[starts]
    for _ in range(12):
        own = np.argmax(x @ c.T, axis=1)
        c = _unit(np.stack([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))]))
    return c


class Centroids:
    """The fitted classifier: names per centroid, IDF, unit centroids, and the least cosine that is not rejected, by log2 of a text's trigrams."""

    def __init__(self, langs: list[str], sizes: list[int], parts: list[np.ndarray], idf: np.ndarray):
        order = sorted(range(len(langs)), key=lambda i: langs[i].encode())
        self.langs, self.idf = [langs[i] for i in order], idf
        self.owner = np.repeat(np.arange(len(langs)), [len(parts[i]) for i in order])
        self.matrix = np.concatenate([parts[i] for i in order]).astype(np.float32)
        self.usual = int(np.argmax([sizes[i] for i in order]))
        self.least = np.zeros(LEVELS)

    def cosines(self, m: np.ndarray) -> np.ndarray:
        """Greatest cosine of every language."""
        cos = _unit(m * self.idf) @ self.matrix.T
        return np.stack([cos[:, self.owner == i].max(axis=1) for i in range(len(self.langs))], axis=1)

    def classify(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index, score (a softmax over the languages' best cosines), rejected."""
        best = self.cosines(m)
        lang = np.where(best.max(axis=1) > 0, best.argmax(axis=1), self.usual)
        e = np.exp(20 * (best - best.max(axis=1, keepdims=True)))
        return lang, np.clip(e[np.arange(len(e)), lang] / e.sum(axis=1), 0, 1), best.max(axis=1) < self.least[level_of(m)]


def level_of(m: np.ndarray) -> np.ndarray:
    """log2 of the number of trigrams."""
    n = np.expm1(m).sum(axis=1)
    return np.clip(np.floor(np.log2(np.maximum(n, 1) + 1e-3)), 0, LEVELS - 1).astype(int)


def _pieces(text: str) -> list[str]:
    """Pieces of a text, one for each power of two of its length, from its middle."""
    out, n = [text], 1 << SHORT
    while n < len(text):
        at = (len(text) - n) // 2
        out.append(text[at : at + n])
        n *= 2
    return out


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, languages: int = LANGUAGES) -> Centroids | None:
    """The classifier of the labelled rows, from ``sample`` texts a language at most; None without any."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.lit("language"), F.col(key), F.col(text)).alias("h")).filter("lang IS NOT NULL AND text IS NOT NULL")
    # Written first: its size is known to the planner then, and the texts need no shuffle to meet it. Repeated rows count once.
    sizes = materialize(rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.count(F.lit(1)).alias("all")).orderBy(F.desc("all"), "lang").limit(languages), "language-sizes")
    # About twice the sample by the hash's lower end, then exactly the sample: no language is ordered as a whole.
    few = rows.join(sizes, "lang").filter(F.pmod("h", F.lit(1 << 30)) <= F.lit(2.0 * sample * (1 << 30)) / F.col("n"))
    few = few.groupBy("lang", "h").agg(F.min("text").alias("text"))
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("r") <= sample)
    few = materialize(few.select("lang", "r", "text"), "language-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, m in trigram_vectors(b.column(2)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array([r.tobytes() for r in m], pa.binary()), pa.array([np.flatnonzero(r) for r in m], pa.list_(pa.int64()))], ["lang", "r", "v", "places"])

    vectors = materialize(few.mapInArrow(run, "lang string, r int, v binary, places array<long>"), "language-vectors")
    n = vectors.count()
    if n == 0:
        return None
    seen = np.zeros(DIM)
    for place, c in vectors.select(F.explode("places").alias("p")).groupBy("p").count().collect():  # DIM rows at most
        seen[place] = c
    idf = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _unit(np.stack([np.frombuffer(v, np.float32) for v in pdf.sort_values("r")["v"]]) * idf)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "n": [len(x)], "c": [_clusters(x, CENTROIDS).astype(np.float32).tobytes()]})

    # A group is one language's sample.
    got = vectors.select("lang", "r", "v").groupBy("lang").applyInPandas(cluster, "lang string, n long, c binary").collect()
    model = Centroids([r["lang"] for r in got], [r["n"] for r in got], [np.frombuffer(r["c"], np.float32).reshape(-1, DIM) for r in got], idf)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                for _, _, m in trigram_vectors(pa.array(_pieces(t))):
                    yield pa.RecordBatch.from_arrays([pa.array(level_of(m)), pa.array(model.cosines(m).max(axis=1).astype(np.float64))], ["level", "cos"])

    lows = few.select("text").mapInArrow(measure, "level long, cos double").filter(F.col("level") >= SHORT).groupBy("level").agg(F.percentile("cos", F.lit(0.01)).alias("p")).collect()
    for level, p in sorted((r[0], r[1]) for r in lows):
        model.least[level:] = SLACK * p
    return model


def identify(docs: DataFrame, model: Centroids | None, *, text: str = "text") -> DataFrame:
    """``row`` (the input row), lang_pred, score, rejected."""
    kind = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lettered = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, m in trigram_vectors(b.column(1)):
                if model is None:
                    lang, score, far = [UNKNOWN] * (hi - lo), np.zeros(hi - lo), np.ones(hi - lo, bool)
                else:
                    i, score, far = model.classify(m)
                    known = lettered[lo:hi]
                    lang = [model.langs[k] if ok else UNKNOWN for k, ok in zip(i.tolist(), known.tolist())]
                    score, far = np.where(known, score, 0.0), far | ~known
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score.astype(np.float64)), pa.array(far)], ["row", "lang_pred", "score", "rejected"])

    row: Column = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    lettered = F.coalesce(docs[text].rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    return docs.select(row, docs[text].alias("text"), lettered).mapInArrow(run, f"row {kind}, lang_pred string, score double, rejected boolean")

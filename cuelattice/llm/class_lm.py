"""A Brown class n-gram model: exchange clustering of words, class transitions, word emissions, scores of whole texts.

Words are counted over all training texts. Those with a share of 2^-14 of the tokens or more (so 16,384 at most, whatever the
corpus) are clustered by exchange rounds: in each round, for every word, the counts of the classes before and after it are gathered
from the word bigrams, and the word moves to the class that raises the class-bigram likelihood most; half of the words may move in a
round, so that words do not chase each other, and a round that lowers the likelihood is taken back and half as many may move. Every
other word then takes one exchange step: the counts of the clustered words' classes before and after all its occurrences are gathered
by Spark, and it goes to the class where they raise the likelihood most.

P(word | history) = (1 - u) * P(class | class of the word before) * count(word) / count(class). Transitions are counted over all
adjacent tokens, the start (the end of the text before) included, and smoothed with the class shares; after a word not seen in
training the class shares stand alone. ``u``, the share of words seen once, is the probability of a word not seen in training.

Words with a share of 2^-20 or more (1,048,576 at most) are looked up in a broadcast table; the classes and counts of all others
come from joins: one row per occurrence with the classes beside it, and what lies between two such words is settled after the join.
Words are 64-bit hashes.

Defined cases: null and empty texts hold the end token alone; repeated rows are scored alike; a very long text is one row of a task
and many rows of the join; equal gains go to the smaller class; without training tokens every
token is unknown and has probability 1 in the base and in the model; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from cuelattice.llm.arrays import row_pieces, text_buffer, word_hashes
from cuelattice.session import materialize

CLASSES = 32
ROUNDS = 6
CLUSTERED = 2.0**-14
LOOKED_UP = 2.0**-20
SMOOTH = 50.0
END = np.uint64(0x656E64206F662074)
_COMPACT = 1 << 21


def _tokens(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi, their token hashes with the end of each, and tokens per row."""
    raw, off = text_buffer(col)
    for lo, hi in row_pieces(off, 1 << 20):
        h, n = word_hashes(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        yield lo, hi, np.insert(h, np.cumsum(n), END), n + 1


class _Tally:
    """Counts per key, compacted when the parts grow."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        k, inverse, c = np.unique(keys, return_inverse=True, return_counts=True)
        self.keys.append(k)
        self.counts.append(c if counts is None else np.bincount(inverse, counts).astype(np.int64))
        self.size += len(k)
        if self.size > _COMPACT:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > 1:
            k, inverse = np.unique(np.concatenate(self.keys), return_inverse=True)
            c = np.bincount(inverse, np.concatenate(self.counts)).astype(np.int64)
            # Double the bound when little was saved, so compaction stays rare.
            self.keys, self.counts, self.size = [k], [c], len(k) if len(k) < _COMPACT // 2 else 0
        return (self.keys[0], self.counts[0]) if self.keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _tallied(texts: DataFrame, keys_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(k, n): how often ``keys_of`` a piece's tokens gives each key, task by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for b in batches:
            for _, _, h, _ in _tokens(b.column(0)):
                tally.add(keys_of(h))
        k, n = tally.total()
        for lo in range(0, len(k), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(k[lo : lo + (1 << 16)].view(np.int64)), pa.array(n[lo : lo + (1 << 16)])], ["k", "n"])

    return texts.mapInArrow(run, "k long, n long")


def _counted(texts: DataFrame, keys_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(k, n): the same over all texts."""
    return _tallied(texts, keys_of).groupBy("k").agg(F.sum("n").alias("n"))


@dataclass
class Lookup:
    """Sorted hashes with a value each."""

    hashes: np.ndarray
    values: np.ndarray

    def find(self, h: np.ndarray, missing: int) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(h), missing, self.values.dtype)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.values[at], missing)


def _before(marks: np.ndarray, start: int) -> np.ndarray:
    """For every token the nearest mark (>= 0) before it; ``start`` where there is none."""
    at = np.where(marks >= 0, np.arange(len(marks)), -1)
    last = np.concatenate([[-1], np.maximum.accumulate(at)[:-1]]) if len(at) else at
    return np.where(last >= 0, marks[np.maximum(last, 0)], start)


def _after(marks: np.ndarray, stop: int) -> np.ndarray:
    return _before(marks[::-1], stop)[::-1]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def exchange_round(cls: np.ndarray, right: np.ndarray, left: np.ndarray, movable: np.ndarray, classes: int) -> tuple[np.ndarray, float]:
    """New classes, and the class-bigram log likelihood of the old ones.

    ``right`` and ``left`` hold, per word, counts of the classes after and before it; class ``classes`` is the start/end and stays.
    """
    k = classes + 1
    n = np.zeros((k, k))
    np.add.at(n, cls, right)
    rows, cols = n.sum(axis=1), n.sum(axis=0)
    likelihood = float(_xlogx(n).sum() - _xlogx(rows).sum() - _xlogx(cols).sum())
    new = cls.copy()
    turn = np.flatnonzero(movable)
    for lo in range(0, len(turn), 256):
        w = turn[lo : lo + 256]
        r, l, a = right[w][:, None, :], left[w][:, None, :], cls[w]
        to, fro = n[None, :classes, :], n.T[None, :classes, :]
        gain = (_xlogx(to + r) - _xlogx(to) + _xlogx(fro + l) - _xlogx(fro)).sum(axis=2)
        rs, ls = right[w].sum(axis=1)[:, None], left[w].sum(axis=1)[:, None]
        gain -= _xlogx(rows[None, :classes] + rs) - _xlogx(rows[None, :classes]) + _xlogx(cols[None, :classes] + ls) - _xlogx(cols[None, :classes])
        # Staying is worth what leaving would lose.
        own_r, own_l = n[a], n.T[a]
        stay = (_xlogx(own_r) - _xlogx(np.maximum(own_r - right[w], 0)) + _xlogx(own_l) - _xlogx(np.maximum(own_l - left[w], 0))).sum(axis=1)
        stay -= _xlogx(rows[a]) - _xlogx(rows[a] - rs[:, 0]) + _xlogx(cols[a]) - _xlogx(cols[a] - ls[:, 0])
        gain[np.arange(len(w)), a] = stay
        best = gain.argmax(axis=1)
        new[w] = np.where(gain[np.arange(len(w)), best] > stay + 1e-9, best, a)
    return new, likelihood


def best_classes(starts: np.ndarray, before: np.ndarray, after: np.ndarray, n: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The exchange step of words outside ``table``: per word the class where its counts raise the likelihood most.

    The occurrences ``n`` between the classes ``before`` and ``after`` of word i begin at ``starts[i]``; the last class stays as it is.
    """
    classes = len(table) - 1
    words = len(starts)
    word = np.repeat(np.arange(words), np.diff(np.append(starts, len(n))))
    # Counts of one word with one class add up before they meet the table.
    gain = np.zeros((words, classes))
    for other, lines in ((after, table[:classes].T), (before, table[:, :classes])):
        key, inverse = np.unique(word * (classes + 1) + other, return_inverse=True)
        x = np.bincount(inverse, n)[:, None]
        old = lines[key % (classes + 1)]
        at = key // (classes + 1)
        gain += np.add.reduceat(_xlogx(old + x) - _xlogx(old), np.flatnonzero(np.diff(at, prepend=-1)), axis=0)
    total = np.bincount(word, n)[:, None]
    for side in (table[:classes].sum(axis=1), table[:, :classes].sum(axis=0)):
        gain -= _xlogx(side + total) - _xlogx(side)
    return gain.argmax(axis=1)


@dataclass
class ClassModel:
    n: int  # training tokens
    v: int  # distinct training tokens
    unseen: float
    log_transition: np.ndarray  # history class x class, log10, with 1 - unseen; the last row follows an unknown word
    log_class: np.ndarray  # log10 of the classes' token counts
    bigrams: np.ndarray  # counts of adjacent classes over all tokens
    known: Lookup  # looked-up words: count * 64 + class
    rest: DataFrame  # w, c, cls of all other words
    likelihoods: list[float]

    @property
    def base_floor(self) -> float:
        return self.n + 0.1 * (self.v + 1)


def fit(texts: DataFrame, *, text: str = "text", classes: int = CLASSES, rounds: int = ROUNDS) -> ClassModel:
    texts = texts.select(F.col(text).alias("text"))
    spark = texts.sparkSession
    vocab = materialize(_counted(texts, lambda h: h).withColumnsRenamed({"k": "w", "n": "c"}), "lm-vocab")
    n, v, once = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum((F.col("c") == 1).cast("long")), F.lit(0))).first()
    end_key = int(np.array(END).view(np.int64))
    empty = Lookup(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if n == 0:
        k = classes + 1
        return ClassModel(0, 0, 1.0, np.zeros((k + 1, k)), np.zeros(k), np.zeros((k, k)), empty, vocab.withColumn("cls", F.lit(0)), [])
    # At most 1 / CLUSTERED rows and one.
    top = vocab.filter((F.col("c") >= F.lit(n * CLUSTERED)) | (F.col("w") == end_key)).toPandas()
    order = np.argsort(-top["c"].to_numpy(), kind="stable")
    h, c = top["w"].to_numpy()[order].view(np.uint64), top["c"].to_numpy()[order]
    # Equal counts are ordered by hash, so a rerun starts alike.
    order = np.lexsort((h, -c))
    h, c = h[order], c[order]
    words = len(h)
    ids = Lookup(np.sort(h), np.argsort(h).astype(np.int64))
    end_id = int(np.flatnonzero(h == END)[0])

    def pairs_of(tokens: np.ndarray) -> np.ndarray:
        i = ids.find(tokens, -1)
        prev = _before(i, end_id)
        return (prev[i >= 0] * words + i[i >= 0]).astype(np.uint64)

    pairs = _counted(texts, pairs_of).select(F.floor(F.col("k") / words).alias("a"), (F.col("k") % words).alias("b"), "n")
    sides = pairs.select(F.col("a").alias("w"), F.lit(True).alias("after"), F.col("b").alias("o"), "n").unionByName(pairs.select(F.col("b").alias("w"), F.lit(False).alias("after"), F.col("a").alias("o"), "n"))
    # A word's row holds 2 / CLUSTERED neighbours at most.
    lists = sides.groupBy("w").agg(*[F.collect_list(F.when(F.col("after") == flag, F.col(col))).alias(name) for flag, tag in ((True, "r"), (False, "l")) for col, name in (("o", tag + "o"), ("n", tag + "n"))])
    lists = materialize(lists.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "w"), "lm-neighbours")
    cls = np.arange(words) % classes
    cls[end_id] = classes
    k = classes + 1

    def histograms(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [b.column(0)]
                for o, m in ((1, 2), (3, 4)):
                    rows = []
                    for x, y in zip(b.column(o), b.column(m)):
                        rows.append(np.bincount(cls[x.values.to_numpy()], y.values.to_numpy(), minlength=k).astype(np.float64).tobytes())
                    out.append(pa.array(rows, pa.binary()))
                yield pa.RecordBatch.from_arrays(out, ["w", "r", "l"])

        right, left = np.zeros((words, k)), np.zeros((words, k))
        for w, r, l in lists.select("w", "ro", "rn", "lo", "ln").mapInArrow(run, "w long, r binary, l binary").collect():
            right[w], left[w] = np.frombuffer(r), np.frombuffer(l)
        return right, left

    likelihoods: list[float] = []
    best, mask = cls, 1
    for turn in range(rounds + 1):
        right, left = histograms(cls)
        movable = ((h >> np.uint64(11)) & np.uint64(mask)).astype(int) == turn & mask
        movable[end_id] = False
        new, value = exchange_round(cls, right, left, movable, classes)
        if likelihoods and value < max(likelihoods):
            # Moving together made it worse: go back, and let half as many move at a time.
            cls, mask = best, 2 * mask + 1
            continue
        likelihoods.append(value)
        best, cls = cls, new
    cls = best
    right, left = histograms(cls)
    n2 = np.zeros((k, k))
    np.add.at(n2, cls, right)

    marks = Lookup(ids.hashes, cls[ids.values].astype(np.int64))

    def occurrences_of(tokens: np.ndarray) -> np.ndarray:
        m = marks.find(tokens, -1)
        at = m < 0
        between = (_before(m, classes)[at] * k + _after(m, classes)[at]).astype(np.uint64)
        return (tokens[at] & np.uint64(0xFFFFFFFFFFFFF800)) | between

    # The classes take the place of the hash's last 11 bits, so that an occurrence is one number; words that share the rest share the class.
    # None of these words has more than CLUSTERED of the tokens, so that one shuffle by word is even.
    around = _tallied(texts, occurrences_of).select(F.shiftright("k", 11).alias("w53"), F.col("k").bitwiseAND(F.lit(2047)).alias("at"), "n").repartition("w53")
    around = around.groupBy("w53", "at").agg(F.sum("n").alias("n")).groupBy("w53").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))
    clustered = spark.createDataFrame([(int(x), int(y)) for x, y in zip(h.view(np.int64), cls)], "w long, own int")
    lists_of = vocab.withColumn("w53", F.shiftright("w", 11)).join(around, "w53", "left").join(clustered, "w", "left").select("w", "c", "own", "at", "n")

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = b.column(2).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
            at, m = b.column(3), b.column(4)
            size = at.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            code, count = at.flatten().to_numpy(), m.flatten().to_numpy()
            ends = np.cumsum(size)
            todo = np.flatnonzero((out < 0) & (size > 0))
            first = 0
            while first < len(todo):
                last = first + max(1, int(np.searchsorted(np.cumsum(size[todo[first:]]), 1 << 15, side="right")))
                w = todo[first:last]
                pick = np.concatenate([np.arange(ends[i] - size[i], ends[i]) for i in w])
                out[w] = best_classes(np.cumsum(size[w]) - size[w], code[pick] // k, code[pick] % k, count[pick], n2)
                first = last
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.maximum(out, 0))], ["w", "c", "cls"])

    all_words = materialize(lists_of.mapInArrow(assigned, "w long, c long, cls int"), "lm-words")
    looked_up = (F.col("c") >= F.lit(n * LOOKED_UP)) | (F.col("w") == end_key)
    top = all_words.filter(looked_up).toPandas()
    kh = top["w"].to_numpy().view(np.uint64)
    order = np.argsort(kh)
    known = Lookup(kh[order], (top["c"].to_numpy() * 64 + top["cls"].to_numpy())[order])
    rest = all_words.filter(~looked_up)
    bigrams = _class_bigrams(texts, known, rest, k)
    share = (bigrams.sum(axis=0) + 1) / (bigrams.sum() + k)
    forward = (bigrams + SMOOTH * share) / (bigrams.sum(axis=1, keepdims=True) + SMOOTH)
    unseen = min(max(once, 0.5) / n, 0.5)
    transition = (1 - unseen) * np.vstack([forward, share])
    # Every token follows one other, so that the columns add up to the classes' tokens.
    return ClassModel(n, v, unseen, np.log10(transition), np.log10(np.maximum(bigrams.sum(axis=0), 1e-9)), bigrams, known, rest, likelihoods)


def _class_bigrams(texts: DataFrame, known: Lookup, rest: DataFrame, k: int) -> np.ndarray:
    """How often each class follows each, over all adjacent tokens; the start counts as the last class."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = np.zeros(64 * 64, np.int64)
        for b in batches:
            for _, _, h, sizes in _tokens(b.column(0)):
                _, cls, before, after, _ = _beside(shared.value, h, sizes, k - 1)
                both = (cls >= 0) & (before >= 0)
                local += np.bincount(before[both] * 64 + cls[both], minlength=64 * 64)
                rare = cls < 0
                # A looked-up class is one more than itself; 0 stands for a class that is not known here.
                yield _rows(1, h[rare].view(np.int64), (before[rare] + 1) * 64 + after[rare] + 1)
                at = np.flatnonzero(rare[1:] & rare[:-1] & (before[1:] < 0))
                yield _rows(2, h[at].view(np.int64), h[at + 1].view(np.int64))
        at = np.flatnonzero(local)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(at), np.int32)), pa.array(at), pa.array(at), pa.array(local[at])], ["kind", "w", "b", "n"])

    def _rows(kind: int, w: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(w), kind, np.int32)), pa.array(w), pa.array(b), pa.array(np.ones(len(w), np.int64))], ["kind", "w", "b", "n"])

    classes_of = rest.select("w", "cls")
    met = texts.mapInArrow(run, "kind int, w long, b long, n long").join(classes_of, "w", "left")
    high, low, none = F.shiftright("b", 6).cast("int"), F.col("b").bitwiseAND(F.lit(63)).cast("int"), F.lit(None).cast("long")
    # From class f to class t, or to the class of the word o.
    link = lambda f, t, o=none: F.struct(f.cast("int").alias("f"), t.cast("int").alias("t"), o.alias("o"))
    links = (
        F.when(F.col("kind") == 0, F.array(link(high, low)))
        .when(F.col("kind") == 1, F.array(link(high - 1, F.col("cls")), link(F.col("cls"), low - 1)))
        .otherwise(F.array(link(F.col("cls"), F.lit(-1), F.col("b"))))
    )
    met = met.select("n", F.inline(links)).filter((F.col("f") >= 0) & ((F.col("t") >= 0) | F.col("o").isNotNull()))
    met = met.groupBy("f", "t", "o").agg(F.sum("n").alias("n")).join(classes_of.withColumnRenamed("w", "o"), "o", "left")
    out = np.zeros((k, k))
    for f, t, n in met.groupBy("f", F.when(F.col("o").isNull(), F.col("t")).otherwise(F.col("cls")).alias("to")).agg(F.sum("n")).collect():
        out[f, t] = n
    return out


def _beside(known: Lookup, h: np.ndarray, sizes: np.ndarray, start: int) -> tuple[np.ndarray, ...]:
    """Per token: its count, its class, the classes before and after it (-1: not looked up, or none), its place in its text."""
    value = known.find(h, -1)
    cls = np.where(value >= 0, value & 63, -1)
    ends = np.cumsum(sizes)
    first = ends - sizes
    before = np.concatenate([[start], cls[:-1]])
    before[first] = start
    after = np.concatenate([cls[1:], [-1]])
    after[ends - 1] = -1
    return np.where(value >= 0, value >> 6, 0), cls, before, after, np.arange(len(h)) - np.repeat(first, sizes)


def score(docs: DataFrame, model: ClassModel, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_tokens, n_known, base_score, score (log10) for every row."""
    spark = docs.sparkSession
    k = len(model.log_class)
    start, n, v = k - 1, model.n, model.v
    floor_ = math.log10(model.base_floor)
    shared = spark.sparkContext.broadcast((model.known, model.log_transition, model.log_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, trans, log_class = shared.value
        # Copies of a row that lie in other partitions have groups of their own.
        part = TaskContext.get().partitionId()
        for b in batches:
            for lo, hi, h, sizes in _tokens(b.column(2)):
                rows = hi - lo
                row = np.repeat(np.arange(rows), sizes)
                c, cls, before, after, place = _beside(known, h, sizes, start)
                there = cls >= 0
                base = np.bincount(row[there], np.log10(c[there] + 0.1) - floor_, minlength=rows).astype(np.float64)  # integers where nothing is known
                lp = np.bincount(row[there], np.log10(c[there]) - log_class[cls[there]], minlength=rows).astype(np.float64)
                follows = there & (before >= 0)
                lp += np.bincount(row[follows], trans[before[follows], cls[follows]], minlength=rows)
                hits = np.bincount(row[there], minlength=rows)
                # One row per document for what is settled here, under a key of its own that no word join can gather on.
                ids, ths = b.column(0).slice(lo, rows), b.column(1).slice(lo, rows)
                yield _rows(ids, ths, part, ths, np.full(rows, -10), np.full(rows, -1), np.full(rows, -1), sizes, hits, base, lp)
                rest = np.flatnonzero(~there)
                if len(rest):
                    pick, none, zero = pa.array(row[rest]), np.zeros(len(rest), np.int64), np.zeros(len(rest))
                    yield _rows(ids.take(pick), ths.take(pick), part, pa.array(h[rest].view(np.int64)), place[rest], before[rest], after[rest], none, none, zero, zero)

    def _rows(ids, ths, part, w, place, before, after, sizes, hits, base, lp) -> pa.RecordBatch:
        narrow = [pa.array(x.astype(np.int32)) for x in (before, after)]
        return pa.RecordBatch.from_arrays([ids, ths, pa.array(np.full(len(ids), part, np.int32)), w, pa.array(place), *narrow, *[pa.array(x) for x in (sizes, hits, base, lp)]], names)

    names = ["id", "th", "part", "w", "place", "before", "after", "n_tokens", "n_known", "base", "lp"]
    kind = docs.select(F.col(key).alias("id")).schema[0].dataType.simpleString()
    source = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    parts = source.mapInArrow(run, f"id {kind}, th long, part int, w long, place long, before int, after int, n_tokens long, n_known long, base double, lp double")
    met = parts.join(model.rest, "w", "left")
    local = F.col("place") < 0
    met = met.withColumn("own", F.when(~local, F.coalesce("cls", F.lit(k))))
    # The word just before, where it was not looked up either; copies of a row share their places.
    just_before = Window.partitionBy("id", "th", "part").orderBy("place").rangeBetween(-1, -1)
    met = met.withColumn("history", F.when(F.col("before") >= 0, F.col("before")).otherwise(F.max("own").over(just_before)))
    trans: Column = F.lit([float(x) for x in model.log_transition.ravel()])
    emit: Column = F.lit([float(x) for x in model.log_class])
    step = lambda f, t: F.element_at(trans, (f * k + t + 1).cast("int"))
    word = F.when(F.col("c").isNotNull(), step(F.col("history"), F.col("cls")) + F.log10("c") - F.element_at(emit, F.col("cls") + 1)).otherwise(math.log10(model.unseen))
    word = word + F.when(F.col("after") >= 0, step(F.col("own"), F.col("after"))).otherwise(0.0)
    met = met.select(
        "id", "th", "part", local.cast("long").alias("copies"), "n_tokens",
        F.when(local, F.col("n_known")).otherwise(F.col("c").isNotNull().cast("long")).alias("n_known"),
        F.when(local, F.col("base")).otherwise(F.log10(F.coalesce("c", F.lit(0)) + 0.1) - floor_).alias("base"),
        F.when(local, F.col("lp")).otherwise(word).alias("lp"),
    )
    sums = met.groupBy("id", "th", "part").agg(*[F.sum(x).alias(x) for x in ("copies", "n_tokens", "n_known", "base", "lp")])
    each = sums.select(F.col("id").alias(key), "copies", *[(F.col(x) / F.col("copies")).alias(x) for x in ("n_tokens", "n_known", "base", "lp")])
    each = each.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select(key, F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_known").cast("long").alias("n_known"), F.col("base").alias("base_score"), F.col("lp").alias("score"))

"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and union-find.

SuperMinHash gives an element the ranks of a random permutation of the signature's positions plus a fraction, so a position
prefers elements for which it comes early. The ranks are visited round by round for all elements of a batch at once:
what a later round offers is larger, so a document is done when each position has met an element (early stopping).

Links: documents whose sets of word shingles have 100 * intersection >= threshold * union. Equal sets are one class from
the start. A class pair becomes a candidate by sharing a band and is confirmed on the full sets, which are cut again from
the texts of candidates only. Within a bucket every member is first held against the bucket's first member; what those
links join needs no further comparison. The other pairs of a bucket are compared in blocks of ``BLOCK`` classes per side,
each pair of blocks in a task of its own, which returns a spanning forest, not the pairs. No bucket is capped.

Defined cases: null, empty and blank texts have an empty set, are linked with nothing and are kept; repeated rows of one
doc_id and text give one row each; a null doc_id is passed through as its own component; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cuelattice.llm.arrays import mix64, row_pieces, shingle_sets, text_buffer, word_hashes
from cuelattice.session import materialize

POSITIONS = 128
BANDS, ROWS = 25, 5  # a pair at 0.85 shares no band with probability 4e-7, one at 0.8 with 6e-5
BLOCK = 512
_UNSET = np.uint64(0xFFFFFFFFFFFFFFFF)


def _permuted(keys: np.ndarray, j: int) -> np.ndarray:
    """Position of rank ``j`` in each element's own permutation of 0..127: odd multiplications and shifts, keyed by the hash."""
    x = (keys + np.uint64(j)) & np.uint64(127)
    x = (x * (((keys >> np.uint64(7)) << np.uint64(1)) | np.uint64(1))) & np.uint64(127)
    x ^= x >> np.uint64(4)
    x = (x * (((keys >> np.uint64(13)) << np.uint64(1)) | np.uint64(1)) + (keys >> np.uint64(20))) & np.uint64(127)
    x ^= x >> np.uint64(3)
    return (x * (((keys >> np.uint64(27)) << np.uint64(1)) | np.uint64(1))) & np.uint64(127)


def signatures(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One signature per document: rank in the upper, fraction in the lower 32 bits; all ones where the set is empty."""
    docs = len(sizes)
    sig = np.full(docs * POSITIONS, _UNSET, np.uint64)
    owner = np.repeat(np.arange(docs), sizes)
    keys = mix64(elements ^ np.uint64(0x5851F42D4C957F2D))
    for j in range(POSITIONS):
        if not len(elements):
            break
        fraction = mix64(elements + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(32)
        slot = owner * POSITIONS + _permuted(keys, j).astype(np.int64)
        np.minimum.at(sig, slot, fraction | np.uint64(j << 32))
        open_ = (sig.reshape(docs, POSITIONS) == _UNSET).any(axis=1)[owner]
        elements, owner, keys = elements[open_], owner[open_], keys[open_]
    return sig.reshape(docs, POSITIONS)


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.empty((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        k = np.full(len(sig), np.uint64(b + 1))
        for r in range(ROWS):
            k = mix64(k + sig[:, b * ROWS + r])
        keys[:, b] = k
    return keys


def _sets_of(col: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, off = text_buffer(col)
    for lo, hi in row_pieces(off):
        h, counts = word_hashes(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        yield lo, hi, *shingle_sets(h, counts, width)


def sketch(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """key, n (size of the set), a1 and a2 (128 bits that tell the set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, sets, sizes in _sets_of(b.column(1), width):
                sig = signatures(sets, sizes)
                keys = band_keys(sig).view(np.int64)
                full = np.flatnonzero(sizes)
                at = (np.cumsum(sizes) - sizes)[full]
                a1, a2 = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
                if len(full):
                    a1[full], a2[full] = np.add.reduceat(mix64(sets + np.uint64(1)), at), np.add.reduceat(mix64(sets ^ np.uint64(0xD1342543DE82EF95)), at)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(a1.view(np.int64)), pa.array(a2.view(np.int64)), bands], ["id", "n", "a1", "a2", "bands"]
                )

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n long, a1 long, a2 long, bands array<long>")


def cut_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, text) to (id, elements): the sorted shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, sets, sizes in _sets_of(b.column(1), width):
                off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(off), pa.array(sets.view(np.int64)))], ["id", "elements"])

    return docs.select("id", "text").mapInArrow(run, "id long, elements array<long>")


def linked(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of the two lists of sets reach the threshold, by exact intersection sizes.

    Only elements that occur twice or more matter; they become columns of two 0/1 matrices, some thousand at a time.
    """
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    flat = np.concatenate([*a, *b]) if len(a) + len(b) else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(a) + len(b)), np.concatenate([na, nb]))
    _, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times[inverse] > 1
    cols = (np.cumsum(times > 1) - 1)[inverse[keep]]
    rows = rows[keep]
    common = np.zeros((len(a), len(b)), np.int64)
    order = np.argsort(cols, kind="stable")
    cols, rows = cols[order], rows[order]
    step = 4096
    for lo in range(0, int(cols[-1]) + 1 if len(cols) else 0, step):
        i, k = np.searchsorted(cols, [lo, lo + step])
        m = np.zeros((len(a) + len(b), step), np.float32)
        m[rows[i:k], cols[i:k] - lo] = 1
        common += np.rint(m[: len(a)] @ m[len(a) :].T).astype(np.int64)
    return 100 * common >= percent * (na[:, None] + nb[None, :] - common)


def components(edges: DataFrame) -> DataFrame:
    """(id, c): the smallest id reachable over edges (u, v), by star contraction until nothing changes.

    In turn every vertex hands the smallest of its neighbours to the larger ones and to the smaller ones; paths shrink by a
    constant factor, so rounds grow with the logarithm of the longest one. Each round is a written table.
    """
    both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    cur = materialize(both, "cc")
    last = None
    while True:
        wide = cur.union(cur.select("v", "u"))
        low = wide.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = wide.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        cur = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "cc")
        state = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            return cur.groupBy("u").agg(F.min("v").alias("c")).select(F.col("u").alias("id"), "c")
        last = tuple(state)


def _forest(a: pd.DataFrame, b: pd.DataFrame | None, percent: int) -> pd.DataFrame:
    """Links of one pair of blocks (or of one block with itself) that join parts not joined yet."""
    rows = a if b is None else pd.concat([a, b], ignore_index=True)
    names = {c: i for i, c in enumerate(dict.fromkeys(rows["c"]))}
    root = list(range(len(names)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out: list[tuple[int, int]] = []
    left, right = a, a if b is None else b
    hit = linked(list(left["elements"]), list(right["elements"]), percent)
    lc, rc = [names[c] for c in left["c"]], [names[c] for c in right["c"]]
    for i, k in zip(*(x.tolist() for x in np.nonzero(hit))):
        x, y = find(lc[i]), find(rc[k])
        if x != y:
            root[x] = y
            out.append((int(left["id"].iloc[i]), int(right["id"].iloc[k])))
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``key``, n_shingles, component_id, kept."""
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sketched = materialize(sketch(source, "id", "text", width), "smh-sketch")
    some = sketched.filter("n > 0 AND id IS NOT NULL")
    classes = some.groupBy("a1", "a2", "n").agg(F.min("id").alias("rep"))
    reps = some.join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id", "a1", "a2"])
    member = reps.select("id", F.posexplode("bands").alias("band", "bucket"))
    crowded = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("first")).filter("k > 1")
    member = materialize(member.join(crowded.select("bucket", "first"), "bucket"), "smh-members")
    wanted = member.select("id").distinct()
    # A doc_id with several texts has a set per text; the class keeps them apart by the join on its own row's set below.
    texts = source.join(wanted, "id", "left_semi")
    sets = materialize(cut_sets(texts, width).dropDuplicates(["id", "elements"]), "smh-sets")

    # Every member against the first of its bucket.
    pairs = member.filter("id != first").select("id", F.col("first").alias("v")).distinct()
    star = pairs.join(sets, "id").join(sets.select(F.col("id").alias("v"), F.col("elements").alias("other")), "v")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, firsts = b.column(0), b.column(1)
            good = np.zeros(b.num_rows, bool)
            mine, theirs = b.column(2), b.column(3)
            for i in range(b.num_rows):
                x, y = mine[i].values.to_numpy(), theirs[i].values.to_numpy()
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                same = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = 100 * same >= percent * (len(x) + len(y) - same)
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([ids.filter(mask), firsts.filter(mask)], ["u", "v"])

    found = materialize(star.select("id", "v", "elements", "other").mapInArrow(verify, "u long, v long"), "smh-star")
    joined = materialize(components(found), "smh-joined")

    # What the stars did not join, in blocks.
    state = member.select("bucket", "id").join(joined, "id", "left").select("bucket", "id", F.coalesce("c", "id").alias("c"))
    mixed = state.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("id").alias("first")).filter("c0 != c1")
    pivot = joined.select(F.col("id").alias("first"), F.col("c").alias("main"))
    mixed = materialize(mixed.join(pivot, "first", "left").select("bucket", "k", F.coalesce("main", "first").alias("main")), "smh-mixed")
    state = state.join(mixed, "bucket").withColumn("apart", F.col("c") != F.col("main"))
    # Blocks by a hash of the member, so a large bucket needs no ordering; members in the main part only meet others.
    blocks = F.greatest(F.lit(1), F.ceil(F.col("k") / BLOCK)).cast("int")
    state = state.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id", "bucket"), F.col("blocks")).cast("int"))
    rest = state.filter("apart").select("bucket", "id", "c", "block", "blocks")
    # Each row of the rest meets all blocks: as the left side of (its block, j) for all j.
    sides = rest.select("bucket", "id", "c", F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("left"))
    holding = rest.groupBy("bucket").agg(F.collect_set("block").alias("is"))
    others = state.join(holding, "bucket").select("bucket", "id", "c", F.explode("is").alias("i"), F.col("block").alias("j"), F.lit(False).alias("left"))
    tasks = sides.unionByName(others).join(sets, "id")

    def compare(_key, pdf: pd.DataFrame) -> pd.DataFrame:
        return _forest(pdf[pdf["left"]], pdf[~pdf["left"]], percent)

    more = materialize(tasks.groupBy("bucket", "i", "j").applyInPandas(compare, "u long, v long"), "smh-blocks")
    comp = materialize(components(found.union(more)), "smh-components")
    classes = classes.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("a1", "a2", F.col("n").alias("cn"), F.coalesce("c", "rep").alias("c"))
    out = sketched.join(classes, (sketched["a1"] == classes["a1"]) & (sketched["a2"] == classes["a2"]) & (sketched["n"] == classes["cn"]) & sketched["id"].isNotNull(), "left")
    cid = F.coalesce("c", "id")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), cid.alias("component_id"), F.coalesce(F.col("id") == cid, F.lit(True)).alias("kept"))

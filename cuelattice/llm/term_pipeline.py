"""Ranked search over a term-partitioned index: item bundles visit the owners of their terms in turn.

The index keeps, per document, its number of terms and the counts of those terms that occur in items (told by a bit map of fixed size, then
by a join). Terms have four owners by document frequency, the rarest first. An item is a bundle: its terms and weights, and a sparse list of accumulators. Stage k
brings the bundles of every block of ``BLOCK`` documents together with the postings that owner k holds for this block (a cogroup), adds the
integer contributions, and hands the bundles on. After each stage the 20th best partial score of an item over all blocks is a floor for its
result; since contributions are never negative, a document whose score and all that later owners could add stay below the floor is dropped,
and new documents are only taken in while later owners alone could reach it. Both tests keep ties, so the result is exact.

Blocks bound every group: postings of ``BLOCK`` documents for the terms of ``ITEMS`` items, whatever a term's frequency. Every
block sees every item, as a search must; bundles without accumulators are not passed on. Terms are told apart by 64-bit hashes.

Defined cases: a null text has no terms and is never found; an item without terms has no result; a repeated item gives its rows once per
copy; repeated documents are ranked each; equal scores go by ascending ``key``, nulls last, then by row; an empty table gives an empty result; very long texts are read whole;
other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from cuelattice.llm.arrays import row_pieces, text_buffer, word_hashes, worker_memo
from cuelattice.session import materialize, scratch_dir, spread

TOP = 20
BLOCK = 4096  # documents
ITEMS = 512
MAP_BITS = 24
OWNER_SHARES = (2.0**-9, 2.0**-6, 2.0**-3)  # document frequency below these shares: owner 0, 1, 2; above: 3


def _parting() -> np.ndarray:
    """Bytes that part terms: ASCII other than digits and letters."""
    b = np.arange(256)
    return (b < 128) & ~((b >= 48) & (b <= 57) | (b >= 65) & (b <= 90) | (b >= 97) & (b <= 122))


def _rows_of_terms(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi, their term hashes in order, and terms per row."""
    raw, off = text_buffer(col)
    parting = worker_memo(("term bytes",), _parting)
    for lo, hi in row_pieces(off, 1 << 20):
        h, n = word_hashes(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], blank=parting)
        yield lo, hi, h, n


def _tallied(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of every row with their counts, flat, and list offsets."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(first)
    return h[at], np.diff(np.append(at, len(h))), np.concatenate([[0], np.cumsum(np.bincount(row[at], minlength=rows))])


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def item_terms(items: DataFrame, *, item: str, text: str) -> DataFrame:
    """(qid, item, h, q): the terms of every item and how often it repeats them."""
    kind = items.schema[item].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, h, n in _rows_of_terms(b.column(2)):
                terms, q, off = _tallied(np.repeat(np.arange(hi - lo), n), h, hi - lo)
                own = pa.array(np.repeat(np.arange(lo, hi), np.diff(off)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), pa.array(terms.view(np.int64)), pa.array(q.astype(np.int64))], ["qid", "item", "h", "q"])

    rows = items.select(F.monotonically_increasing_id().alias("qid"), F.col(item).alias("item"), F.col(text).alias("text"))
    return materialize(rows.mapInArrow(run, f"qid long, item {kind}, h long, q long"), "search-items")


def term_map(terms: DataFrame, bits: int = MAP_BITS) -> np.ndarray:
    """A flag per value of the hashes' upper ``bits`` bits: set where a term of the items has it. Its size is fixed."""
    place = F.shiftrightunsigned("h", 64 - bits)
    words = terms.select(F.shiftright(place, 6).alias("w"), F.expr("shiftleft(1L, cast(%s as int))" % f"pmod(shiftrightunsigned(h, {64 - bits}), 64)").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    got = words.toPandas()  # 2^(bits - 6) rows at most
    flags = np.zeros(1 << (bits - 6), np.int64)
    flags[got["w"].to_numpy().astype(np.int64)] = got["b"].to_numpy()
    return flags


def index(docs: DataFrame, flags: np.ndarray, *, key: str, text: str, bits: int = MAP_BITS) -> DataFrame:
    """(nid, key, n, hs, tfs): every document with terms, their number, and the counts of those that ``flags`` lets pass."""
    shared = docs.sparkSession.sparkContext.broadcast(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for b in batches:
            for lo, hi, h, n in _rows_of_terms(b.column(2)):
                row = np.repeat(np.arange(hi - lo), n)
                place = h >> np.uint64(64 - bits)
                asked = (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)).astype(np.int64)) & 1 == 1
                terms, tf, off = _tallied(row[asked], h[asked], hi - lo)
                out = [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(n.astype(np.int64)), _lists(off, pa.array(terms.view(np.int64))), _lists(off, pa.array(tf.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays(out, ["nid", "key", "n", "hs", "tfs"]).filter(pa.array(n > 0))

    rows = docs.select(F.monotonically_increasing_id().alias("nid"), F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return materialize(rows.mapInArrow(run, "nid long, key long, n long, hs array<long>, tfs array<long>"), "search-index")


def _flat(col: pa.ChunkedArray | pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All values of a list column, and how many each row has."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    return pc.list_flatten(col), sizes


BUNDLE = "block long, part long, qid long, nids array<long>, keys array<long>, scores array<long>, best array<long>"


def _visit(last: bool, top: int):
    """One stop of the bundles of a block at the owner whose postings are ``right``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        grid = left.filter(pc.is_valid(left["hs"]))
        carried = left.filter(pc.is_null(left["hs"]))
        c_nid, c_size = _flat(carried["nids"])
        c_key, c_score = _flat(carried["keys"])[0], _flat(carried["scores"])[0].to_numpy()
        r_h, r_c = right["h"].to_numpy(), right["c"].to_numpy()
        order = np.argsort(r_h, kind="stable")
        r_h, r_c = r_h[order], r_c[order]
        nids, place = np.unique(np.concatenate([c_nid.to_numpy(), right["nid"].to_numpy()[order]]), return_inverse=True)
        c_at, r_at = place[: len(c_nid)], place[len(c_nid) :]
        keys = pa.concat_arrays([c_key.cast(pa.int64()), right["key"].combine_chunks().take(pa.array(order)).cast(pa.int64())])
        # The key of every document of the block, and its place in the order of keys, nulls last.
        spot = np.zeros(len(nids), np.int64)
        spot[place] = np.arange(len(place))
        keys = keys.take(pa.array(spot))
        key_order = np.lexsort((nids, keys.fill_null(0).to_numpy(), keys.is_null().to_numpy(zero_copy_only=False)))
        key_rank = np.empty(len(nids), np.int64)
        key_rank[key_order] = np.arange(len(nids))
        spans: dict[int, tuple[int, int]] = {}
        end = 0
        for q, n in zip(carried["qid"].to_pylist(), c_size.tolist()):
            spans[q] = (end, end + n)
            end += n
        out: dict[str, list] = {c: [] for c in ("qid", "at", "scores", "best")}
        g_h, g_size = _flat(grid["hs"])
        g_h, g_w = g_h.to_numpy(), _flat(grid["qs"])[0].to_numpy()
        los, his = np.searchsorted(r_h, g_h, side="left"), np.searchsorted(r_h, g_h, side="right")
        ends = np.cumsum(g_size)
        for i, (q, floor, ahead, rest) in enumerate(zip(*(grid[c].to_pylist() for c in ("qid", "floor", "ahead", "rest")))):
            acc = np.zeros(len(nids), np.int64)
            known = np.zeros(len(nids), bool)
            if q in spans:
                lo, hi = spans[q]
                acc[c_at[lo:hi]] = c_score[lo:hi]
                known[c_at[lo:hi]] = True
            for t in range(ends[i] - g_size[i], ends[i]):
                s = slice(los[t], his[t])  # a term occurs once per document
                acc[r_at[s]] += r_c[s] * g_w[t]
            # A document without an accumulator can gain ``ahead`` at most, all its terms lying with this owner and later ones.
            keep = (acc > 0) & (acc + rest >= floor)
            if ahead < floor:
                keep &= known
            at = np.flatnonzero(keep)
            if not len(at):
                continue
            if last and len(at) > top:
                at = at[np.lexsort((key_rank[at], -acc[at]))[:top]]
            best = acc[at]
            out["qid"].append(q)
            out["at"].append(at)
            out["scores"].append(best)
            out["best"].append(np.sort(best)[::-1][:top])
        n = len(out["qid"])
        at = np.concatenate(out["at"]) if n else np.zeros(0, np.int64)
        off = np.concatenate([[0], np.cumsum([len(x) for x in out["at"]])]) if n else np.zeros(1, np.int64)
        b_off = np.concatenate([[0], np.cumsum([len(x) for x in out["best"]])]) if n else np.zeros(1, np.int64)
        flat = lambda name: pa.array(np.concatenate(out[name]) if n else np.zeros(0, np.int64))
        block, part = (left["block"][0].as_py(), left["part"][0].as_py()) if left.num_rows else (0, 0)
        return pa.table({
            "block": pa.array([block] * n, pa.int64()), "part": pa.array([part] * n, pa.int64()), "qid": pa.array(out["qid"], pa.int64()),
            "nids": _lists(off, pa.array(nids[at])), "keys": _lists(off, keys.take(pa.array(at))), "scores": _lists(off, flat("scores")), "best": _lists(b_off, flat("best")),
        })

    return run


def search(
    docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = TOP, block: int = BLOCK, items_a_part: int = ITEMS, bits: int = MAP_BITS,
) -> DataFrame:
    """item, rank, key, score: every item's ``top`` documents."""
    spark = docs.sparkSession
    asked = item_terms(items, item=item, text=item_text)
    store = index(docs, term_map(asked, bits), key=key, text=text, bits=bits)
    n_docs, n_terms = store.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_items = asked.agg(F.countDistinct("qid")).first()[0]
    blocks, parts = max(1, -(-n_docs // block)), max(1, -(-n_items // items_a_part))

    def part_of(qid: Column) -> Column:
        return F.pmod(F.xxhash64(qid), F.lit(parts))

    # Decimals, because 25 * n * N of a very long document can pass 64 bits.
    m = F.expr(f"cast(75 + (cast(25 * n as decimal(20,0)) * cast({n_docs} as decimal(17,0))) div cast({max(n_terms, 1)} as decimal(20,0)) as long)")
    postings = store.select("nid", "key", m.alias("m"), F.explode(F.arrays_zip("hs", "tfs")).alias("p")).select("nid", "key", "m", F.col("p.hs").alias("h"), F.col("p.tfs").alias("tf"))
    gain = F.expr("(1000000000 * tf) div (1000 * tf + 12 * m)")
    # The map lets other terms pass too; they end at the join with the items' terms.
    seen = postings.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.max(gain).alias("most"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    owner = sum(((F.col("df") >= F.lit(n_docs * s)).cast("int") for s in OWNER_SHARES), F.lit(0))
    owned = asked.select("h").distinct().join(seen, "h").select("h", weight.alias("w"), "most", owner.alias("owner")).filter("w > 0")
    bundles = materialize(asked.join(owned, "h").withColumn("part", part_of(F.col("qid"))), "search-bundles")
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/search-postings-{uuid.uuid4().hex}"
    places = materialize(bundles.select("h", "part", "w", "owner").distinct(), "search-terms")
    hits = postings.join(places, "h").select("owner", F.pmod(F.xxhash64("nid"), F.lit(blocks)).alias("block"), "part", "nid", "key", "h", (F.col("w") * gain).alias("c"))
    hits.write.partitionBy("owner").parquet(path)
    hits = spark.read.schema(hits.schema).parquet(path)
    worth = F.col("q") * F.col("w") * F.col("most")
    owners = len(OWNER_SHARES) + 1
    carried = spark.createDataFrame([], BUNDLE)
    floors = spark.createDataFrame([], "qid long, floor long")
    for k in range(owners):
        grid = bundles.groupBy("qid", "part").agg(
            F.collect_list(F.when(F.col("owner") == k, F.col("h"))).alias("hs"), F.collect_list(F.when(F.col("owner") == k, F.col("q"))).alias("qs"),
            F.sum(F.when(F.col("owner") >= k, worth).otherwise(0)).alias("ahead"), F.sum(F.when(F.col("owner") > k, worth).otherwise(0)).alias("rest"),
        )
        grid = grid.join(floors, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(0))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        left = grid.unionByName(carried.drop("best"), allowMissingColumns=True)
        right = hits.filter(F.col("owner") == k).drop("owner")
        met = spread(left, "block", "part").groupBy("block", "part").cogroup(spread(right, "block", "part").groupBy("block", "part"))
        carried = materialize(met.applyInArrow(_visit(k == owners - 1, top), BUNDLE), f"search-stage-{k}")
        if k < owners - 1:
            best = carried.select("qid", F.explode("best").alias("s")).withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s")))).filter(F.col("r") <= top)
            floors = materialize(best.groupBy("qid").agg(F.min("s").alias("floor"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == top).drop("n"), f"search-floor-{k}")
    found = carried.select("qid", F.explode(F.arrays_zip("nids", "keys", "scores")).alias("d")).select("qid", "d.*")
    order = Window.partitionBy("qid").orderBy(F.desc("scores"), F.col("keys").asc_nulls_last(), "nids")
    found = found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= top)
    names = asked.select("qid", "item").distinct()
    return found.join(names, "qid").select(F.col("item").alias(item), "rank", F.col("keys").alias(key), F.col("scores").alias("score"))

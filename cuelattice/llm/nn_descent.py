"""Approximate nearest neighbours: an NN-descent graph built by Spark joins, searched greedily.

Equal vectors are one node (the least id stands for them). The graph is over directions: each vector is divided by its own
norm, which is kept beside it. Nodes fall into bands of norms, from the longest down, each ending at a quarter of its longest
norm; every band has a graph of its own, in which near directions are large inner products, and every query searches all of them.
A graph starts from exact neighbours within a few groupings by random hyperplanes, and in every round each node introduces its
neighbours (forward and backward, those not introduced before) to each other: edges meet the vectors, a node's neighbours meet
in one row, and better pairs go back to both ends. Rounds end when few edges change.

A search keeps the ``beam`` best nodes per query and band, by norm times the inner product with the direction; it starts at the
query's own node and, in other bands, at ``ENTRIES`` nodes that a hash picks (all nodes of a band that has no more). In each round the ones not expanded yet are joined with the neighbour lists (a
bucketed table with the neighbours' vectors beside their ids), and what beats the worst of the beam comes in. It ends when all of
a beam is expanded. The best of each band are scored again; the final scores are inner products in double precision of the original vectors.

Neighbour lists are bounded because that is the method; every row is indexed and recall is tested against brute force.

Defined cases: vectors that are null, zero, or hold a null or a non-finite component, or whose length is not the table's most
frequent one, take no part; ties go to the smaller id; with fewer candidates than asked for all are returned; an empty table gives
an empty result; other columns are not read. Ids are taken to be unique; a repeated row counts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cuelattice.session import materialize, materialize_bucketed

NEIGHBOURS = 24
GROUPINGS = 4
GROUP_ROWS = 384
ROUNDS = 6
ENOUGH = 0.01  # share of edges that still change when the rounds end
OFFERS = 6  # introductions that one meeting makes for one node
BEAM = 192
RESCORED = 64
BAND_OCTAVES = 2.0  # longest to shortest norm of a band, as a power of 2
ENTRIES = 192
PIECE_ROWS = 512
_HALF = np.float16


@dataclass
class Graph:
    nodes: DataFrame  # node, vec (original), half (direction), lg (log2 of the norm), band
    members: DataFrame  # node, ids (the least ``k + 1`` of the equal vectors)
    lists: DataFrame  # node, out (neighbour ids, their directions and lg)
    bands: int
    dim: int


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """id and vec of the rows that take part; an id with several vectors has the least of them, whoever asks."""
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).filter("id IS NOT NULL AND vec IS NOT NULL")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    rows = rows.filter(fine)
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("vec") == (common["d"] if common else 0)).groupBy("id").agg(F.min("vec").alias("vec"))


def collapse(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (node, vec), and the least ``most`` ids of each. Large groups are first cut to size in 64 parts."""
    nodes = rows.groupBy("vec").agg(F.min("id").alias("node"))
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    few = rows.withColumn("h", F.xxhash64("vec")).withColumn("r", F.row_number().over(Window.partitionBy("h", "vec", part).orderBy("id"))).filter(F.col("r") <= most)
    members = few.groupBy("vec").agg(F.slice(F.array_sort(F.collect_list("id")), 1, most).alias("ids"))
    return nodes.select("node", "vec"), members.select(F.element_at("ids", 1).alias("node"), "ids")


def _directions(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(b.num_rows, -1)
                # By the largest component first, so that squares neither overflow nor vanish.
                most = np.abs(x).max(axis=1, keepdims=True)
                x = x / most
                norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
                lg = np.minimum(np.log2(most) + np.log2(norm), 1023.0)[:, 0]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in (x / norm).astype(_HALF)], pa.binary()), pa.array(lg)], ["node", "vec", "half", "lg"])

    return nodes.mapInArrow(run, "node long, vec array<double>, half binary, lg double")


def _banded(nodes: DataFrame) -> tuple[DataFrame, list[int]]:
    """``nodes`` with their band, and the number of nodes of each band. A band begins at the longest norm left, in 64ths of an octave."""
    step = F.floor(F.col("lg") * 64).cast("int")
    steps = sorted(nodes.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"])
    tops, sizes = [], []
    for r in steps:
        if not tops or r["s"] < tops[-1] - BAND_OCTAVES * 64:
            tops.append(r["s"])
            sizes.append(0)
        sizes[-1] += r["count"]
    band = F.size(F.filter(F.array(*[F.lit(t) for t in tops]), lambda t: t >= F.col("s"))) - 1 if tops else F.lit(0)
    return nodes.withColumn("s", step).withColumn("band", band).drop("s"), sizes


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """A binary column of half precision vectors."""
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], _HALF, count=(off[-1] - off[0]) // 2, offset=int(off[0])).reshape(len(col), dim).astype(np.float32)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``PIECE_ROWS`` rows: a row holds its neighbours' vectors, which a worker widens to single precision."""
    for b in batches:
        for lo in range(0, b.num_rows, PIECE_ROWS):
            yield b.slice(lo, PIECE_ROWS)


def _first_edges(nodes: DataFrame, sizes: list[int], dim: int, k: int) -> DataFrame:
    """Exact neighbours within groups of about ``GROUP_ROWS`` nodes of a band on the same sides of random hyperplanes."""
    each = np.array([max(0, int(np.ceil(np.log2(max(n, 1) / GROUP_ROWS)))) for n in sizes] or [0])
    bits = int(each.max())
    planes = np.random.default_rng(11).standard_normal((GROUPINGS, bits, dim)).astype(np.float32)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dim)
            for t in range(GROUPINGS if bits else 1):
                side = x @ planes[t].T > 0
                band = b.column(2).to_numpy()
                key = (side << np.arange(bits)).sum(axis=1).astype(np.int64) & ((1 << each[band]) - 1)
                key = (key * GROUPINGS + t) * len(each) + band
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(key.astype(np.int64))], ["node", "half", "g"])

    dealt = nodes.select("node", "half", "band").mapInArrow(keys, "node long, half binary, g long")
    sizes = dealt.groupBy("g").count().withColumn("parts", F.ceil(F.col("count") / (2 * GROUP_ROWS)))
    dealt = dealt.join(sizes.select("g", "parts"), "g").withColumn("p", F.pmod(F.xxhash64("node", "g"), F.col("parts")))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["half"]), _HALF).reshape(len(pdf), dim).astype(np.float32)
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        m = min(k, len(pdf) - 1)
        if m < 1:
            return pd.DataFrame({"node": [], "to": [], "sim": []}).astype({"node": "int64", "to": "int64", "sim": "float32"})
        at = np.argpartition(-s, m - 1, axis=1)[:, :m]
        ids = pdf["node"].to_numpy()
        return pd.DataFrame({"node": np.repeat(ids, m), "to": ids[at].ravel(), "sim": np.take_along_axis(s, at, 1).ravel()})

    return dealt.groupBy("g", "p").applyInPandas(near, "node long, to long, sim float")


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each node; an edge that was there before stays old."""
    one = edges.groupBy("node", "to").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    w = Window.partitionBy("node").orderBy(F.desc("sim"), "to")
    return one.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def _both_ways(edges: DataFrame, k: int) -> DataFrame:
    """(node, to, new): forward edges, and ``k`` backward ones by hash so that hubs stay bounded."""
    back = edges.select(F.col("to").alias("node"), F.col("node").alias("to"), "new")
    w = Window.partitionBy("node").orderBy(F.desc("new"), F.xxhash64("to", "node"))
    back = back.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")
    return edges.select("node", "to", "new").unionByName(back).groupBy("node", "to").agg(F.max("new").alias("new"))


def _introduced(met: DataFrame, dim: int) -> DataFrame:
    """Every pair of neighbours of a node of which one is new, where it beats the worst edge of the end it is for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            col = b.column(0)
            ends = col.offsets.to_numpy() - col.offsets[0].as_py()
            flat = col.flatten()
            ids, new = flat.field(0).to_numpy(), flat.field(1).to_numpy(zero_copy_only=False)
            least, x = flat.field(2).to_numpy(), _matrix(flat.field(3), dim)
            a, c, s = [], [], []
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
                sim = x[lo:hi] @ x[lo:hi].T
                sim[~(new[lo:hi, None] | new[None, lo:hi])] = -np.inf
                np.fill_diagonal(sim, -np.inf)
                sim[sim <= least[lo:hi, None]] = -np.inf
                m = min(OFFERS, hi - lo)
                at = np.argpartition(-sim, m - 1, axis=1)[:, :m]
                got = np.take_along_axis(sim, at, 1)
                row, place = np.nonzero(got > -np.inf)
                a.append(ids[lo + row])
                c.append(ids[lo + at[row, place]])
                s.append(got[row, place])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (a, c)] + [pa.array(np.concatenate(s).astype(np.float32))], ["node", "to", "sim"])

    return met.mapInArrow(run, "node long, to long, sim float")


def build(table: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, rounds: int = ROUNDS, copies: int = 21) -> Graph:
    rows = materialize(usable(table, key, vector), "nnd-rows")
    nodes, members = collapse(rows, copies)
    members = materialize(members, "nnd-members")
    nodes, sizes = _banded(materialize(_directions(nodes), "nnd-nodes"))
    n, dim = sum(sizes), nodes.agg(F.max(F.size("vec"))).first()[0] or 1
    edges = materialize(_best(_first_edges(nodes, sizes, dim, k).withColumn("new", F.lit(True)), k), "nnd-edges")
    for _ in range(rounds):
        least = edges.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.min("sim").alias("least")).select("node", F.when(F.col("c") >= k, F.col("least")).otherwise(F.lit(float("-inf"))).cast("float").alias("least"))
        ends = nodes.select("node", "half").join(least, "node", "left").select(F.col("node").alias("to"), F.coalesce("least", F.lit(float("-inf")).cast("float")).alias("least"), "half")
        pairs = _both_ways(edges, k)
        busy = pairs.groupBy("node").agg(F.max("new").alias("any")).filter("any").select("node")
        met = pairs.join(busy, "node", "left_semi").join(ends, "to").groupBy("node").agg(F.collect_list(F.struct("to", "new", "least", "half")).alias("met"))
        offers = _introduced(met.select("met"), dim).withColumn("new", F.lit(True))
        # What was introduced in this round is old from now on.
        edges = materialize(_best(edges.withColumn("new", F.lit(False)).unionByName(offers), k), "nnd-edges")
        if edges.filter("new").count() <= ENOUGH * max(n, 1) * k:
            break
    links = _both_ways(edges, k).select("node", "to")
    buckets = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = links.join(nodes.select(F.col("node").alias("to"), "half", "lg"), "to").groupBy("node").agg(F.collect_list(F.struct("to", "half", "lg")).alias("out"))
    lists = materialize_bucketed(lists, "nnd_lists", ["node"], ["node"], buckets)
    return Graph(nodes, members, lists, len(sizes), dim)


def entries(graph: Graph, queries: DataFrame) -> DataFrame:
    """(q, band) to (q, band, node): nodes of all other bands to start from."""
    if graph.bands < 2:
        return queries.select("q", "band", F.lit(0).cast("long").alias("node")).limit(0)
    # A part's first ones by hash, then the first of all parts: no band is ordered in one task.
    h = F.xxhash64("node")
    few = graph.nodes.select("node", "band", h.alias("h"), F.pmod(F.xxhash64("node", "band"), F.lit(64)).alias("part"))
    for by in (["band", "part"], ["band"]):
        few = few.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h", "node"))).filter(F.col("r") <= ENTRIES)
    few = few.groupBy(F.col("band").alias("other")).agg(F.collect_list("node").alias("ids"))
    return queries.select("q", "band").join(few, F.col("band") != F.col("other")).select("q", F.col("other").alias("band"), F.explode("ids").alias("node"))


def search(graph: Graph, queries: DataFrame, starts: DataFrame, *, k: int = 20, beam: int = BEAM) -> DataFrame:
    """(q, vec) and their starting nodes (q, band, node) to (q, node, score): the nodes found, scored in double precision."""
    dim = graph.dim
    queries = materialize(queries.select("q", "vec"), "nnd-queries")

    def ranked(found: DataFrame) -> DataFrame:
        one = found.groupBy("q", "band", "node").agg(F.max("score").alias("score"), F.max("done").alias("done"))
        w = Window.partitionBy("q", "band").orderBy(F.desc("score"), "node")
        return one.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= beam)

    low = F.lit(float("-inf"))
    state = materialize(starts.select("q", "band", "node", low.alias("score"), F.lit(False).alias("done"), F.lit(1).alias("r")), "nnd-beam")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            lists = b.column(4)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten()
            to, x, lg = flat.field(0).to_numpy(), _matrix(flat.field(1), dim), flat.field(2).to_numpy()
            q, band, least = (b.column(i).to_numpy() for i in (0, 1, 2))
            v = b.column(3).flatten().to_numpy().reshape(b.num_rows, -1)
            v = (v / np.abs(v).max(axis=1, keepdims=True)).astype(np.float32)
            row = np.repeat(np.arange(b.num_rows), np.diff(ends))
            s = np.einsum("ij,ij->i", x, v[row]).astype(np.float64) * np.exp2(lg)
            good = s > least[row]
            yield pa.RecordBatch.from_arrays([pa.array(q[row[good]]), pa.array(band[row[good]]), pa.array(to[good]), pa.array(s[good])], ["q", "band", "node", "score"])

    while True:
        full = state.groupBy("q", "band").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("m")).select("q", "band", F.when(F.col("c") >= beam, F.col("m")).otherwise(low).alias("least"))
        front = state.filter("NOT done").select("q", "band", "node").join(full, ["q", "band"]).join(queries, "q")
        if front.isEmpty():
            break
        offers = front.hint("shuffle_hash").join(graph.lists, "node").select("q", "band", "least", "vec", "out").mapInArrow(expand, "q long, band int, node long, score double")
        state = materialize(ranked(state.select("q", "band", "node", "score", F.lit(True).alias("done")).unionByName(offers.withColumn("done", F.lit(False)))), "nnd-beam")
    # Starting nodes that no list led to have no score yet: all are scored in double precision.
    w = Window.partitionBy("q", "band").orderBy(F.desc("score"), "node")
    found = state.select("q", "band", "node", "score").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= max(RESCORED, 2 * k)).select("q", "node")
    found = found.unionByName(starts.select("q", "node")).distinct()
    pairs = found.join(queries, "q").join(graph.nodes.select("node", F.col("vec").alias("other")), "node")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (b.column(i).values.to_numpy().reshape(b.num_rows, -1) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((x * y).sum(axis=1))], ["q", "node", "score"])

    return pairs.select("q", "node", "vec", "other").mapInArrow(exact, "q long, node long, score double")


def nearest(table: DataFrame, *, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id is divisible by ``every`` the ``k`` nearest other rows found."""
    graph = build(table, key=key, vector=vector, copies=k + 1)
    rows = usable(table, key, vector).filter(F.col("id") % every == 0)
    # A query is a row of the index, so its search starts at its own node.
    queries = rows.join(graph.nodes.select("node", "vec", "band"), "vec").select(F.col("id").alias("q"), "vec", "node", "band")
    queries = materialize(queries, "nnd-asked")
    found = search(graph, queries, queries.select("q", "band", "node").unionByName(entries(graph, queries)), k=k)
    each = found.join(graph.members, "node").select("q", "score", F.explode("ids").alias("id")).filter("id != q")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    out = each.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return out.select(F.col("q").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")

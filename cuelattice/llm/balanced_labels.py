"""Sharding by balanced label propagation, with DataFrame functions only.

Every document starts in a shard that its row number's hash decides. In every round the linked documents count their neighbours per
shard (one join of links and labels) and ask for the shard that holds most of them, if it holds more than their own. Requests are summed
per pair of shards: opposite requests are swapped byte for byte, the rest is let in as far as the shard has room below its quota, and the
share that is let in is drawn by a hash per document. Half of the documents may ask in a round, so that two neighbours do not trade
places. Documents larger than a 64th of a shard, of which there are fewer than 64 per shard, are placed first, the largest first, each in the emptiest
shard, or with its copies while they fit; what is left of the shards is the quota of the rest. Afterwards every shard is brought to its quota: it keeps its linked and its larger documents first, and what lies beyond the
quota fills the shards below theirs, along one running sum of bytes. So loads differ by no more than about one small document.

Links: equal texts, as trees with ``FAN`` branches at most, so that a text with a third of all copies is no hot node and can be spread
over several shards subtree by subtree; further links between keys may be given. Text hashes choose links: a false one costs nothing but a place.

Running sums are taken in cells of about ``CELL_ROWS`` rows: sums per cell, then inside the cell. No task holds a shard or a group.

Defined cases: a null text is an empty one (size 1, no bytes); repeated rows are documents of their own with equal texts; null keys are
kept and cannot be reached by given links; ties go to the lower shard; very long texts count by their bytes, and one that is larger than an even share has its shard
alone; an empty table gives an empty result; other columns are carried only if ``carry`` names them, inside ``row``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cuelattice.session import materialize

SHARDS = 8
FAN = 512
ROUNDS = 10
CELL_ROWS = 1 << 16
LARGE = 1 / 64  # of a shard's even share
FILE_ROWS = 1 << 21


def _files(rows: int) -> int:
    """Files for a table of at most ``rows`` narrow rows: the rounds write often, and each small file costs its writer and its readers."""
    return max(1, -(-rows // FILE_ROWS))


def group_links(nodes: DataFrame, fan: int = FAN, files: int = 1) -> DataFrame:
    """(a, b): a tree over the nodes ``nid`` of every group ``g``; a node has about ``fan`` children at most on each of its levels."""
    out, level, depth = None, nodes.select("nid", "g"), 0
    while True:
        sizes = level.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        parted = level.join(sizes, "g").withColumn("part", F.pmod(F.xxhash64("nid", F.lit(depth)), F.ceil(F.col("n") / fan)))
        parted = materialize(parted.coalesce(files), f"shard-level-{depth}")
        hubs = materialize(parted.groupBy("g", "part").agg(F.min("nid").alias("hub"), F.max("n").alias("n")).coalesce(files), f"shard-hubs-{depth}")
        links = parted.drop("n").join(hubs.drop("n"), ["g", "part"]).filter("nid != hub").select(F.col("nid").alias("a"), F.col("hub").alias("b"))
        out = links if out is None else out.unionByName(links)
        level = hubs.filter(F.col("n") > fan).select(F.col("hub").alias("nid"), "g")
        if level.isEmpty():
            return out
        depth += 1


def _of_shard(values: Sequence[float], at: str) -> Column:
    return F.element_at(F.lit([float(v) for v in values]), F.col(at) + 1)


def place_large(large: list[tuple[int, int, int]], total: int, shards: int) -> tuple[dict[int, int], list[float]]:
    """Shards of the large ones (nid, size, group), and the bytes that every shard may still take so that all end level."""
    load, where, home = [0] * shards, {}, {}
    for nid, size, g in sorted(large, key=lambda x: (-x[1], x[2], x[0])):
        at = home.get(g)
        if at is None or load[at] + size > total / shards:
            at = home[g] = min(range(shards), key=lambda k: (load[k], k))
        where[nid] = at
        load[at] += size
    # The level to which the lowest shards can be filled with all the rest.
    rest, rise = total - sum(load), sorted(load)
    level = next(lv for k in range(shards, 0, -1) if (lv := (rest + sum(rise[:k])) / k) >= rise[k - 1])
    return where, [max(level - n, 0.0) for n in load]


def _quotas(asked: DataFrame, load: DataFrame, quotas: Sequence[float]) -> DataFrame:
    """(own, want, share): which share of the bytes that ask to go from one shard to another may go; one row per pair of shards."""
    flow = asked.groupBy("own", "want").agg(F.sum("size").alias("bytes"))
    back = flow.select(F.col("own").alias("want"), F.col("want").alias("own"), F.col("bytes").alias("back"))
    flow = flow.join(back, ["own", "want"], "left").withColumn("swap", F.least("bytes", F.coalesce("back", F.lit(0))))
    room = load.select(F.col("shard").alias("want"), F.greatest(_of_shard(quotas, "shard") - F.col("load"), F.lit(0.0)).alias("room"))
    flow = flow.withColumn("more", F.sum(F.col("bytes") - F.col("swap")).over(Window.partitionBy("want"))).join(room, "want", "left")
    let_in = F.when(F.col("more") > 0, F.least(F.lit(1.0), F.coalesce("room", _of_shard(quotas, "want")) / F.col("more"))).otherwise(1.0)
    return flow.select("own", "want", ((F.col("swap") + (F.col("bytes") - F.col("swap")) * let_in) / F.col("bytes")).alias("share"))


def propagate(nodes: DataFrame, links: DataFrame, *, quotas: Sequence[float], rounds: int = ROUNDS, files: int = 1) -> DataFrame:
    """(nid, size, shard) of the linked ones among ``nodes`` (nid, size), after ``rounds`` rounds or when nobody asks any more. ``quotas`` has one per shard."""
    shards = len(quotas)
    both = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(files), "shard-links")
    linked = nodes.select("nid", "size").join(both.select(F.col("a").alias("nid")).distinct(), "nid", "left_semi")
    state = materialize(linked.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "nid"), F.lit(shards)).cast("int")).coalesce(files), "shard-state")
    for turn in range(rounds):
        labels = state.select(F.col("nid").alias("b"), "shard")
        votes = both.join(labels, "b").groupBy("a", "shard").agg(F.count(F.lit(1)).alias("n"))
        # At most one entry per shard.
        tally = votes.groupBy("a").agg(F.max(F.struct("n", (-F.col("shard")).alias("s"))).alias("top"), F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("votes"))
        own = F.coalesce(F.element_at("votes", F.col("own")), F.lit(0))
        asked = tally.join(state.select(F.col("nid").alias("a"), "size", F.col("shard").alias("own")), "a").filter(F.col("top.n") > own)
        asked = materialize(asked.select(F.col("a").alias("nid"), "size", "own", (-F.col("top.s")).alias("want")).coalesce(files), f"shard-asked-{turn}")
        if asked.isEmpty():
            break
        may_ask = asked.filter(F.pmod(F.xxhash64(F.lit(turn), "nid"), F.lit(2)) == 0)
        load = state.groupBy("shard").agg(F.sum("size").alias("load"))
        share = _quotas(may_ask, load, quotas)
        share = nodes.sparkSession.createDataFrame(share.collect(), share.schema)  # a row per pair of shards
        draw = F.pmod(F.xxhash64(F.lit(turn), F.lit("draw"), "nid"), F.lit(1 << 30)) / float(1 << 30)
        moved = may_ask.join(share, ["own", "want"]).filter(draw < F.col("share")).select("nid", "want")
        state = materialize(state.join(moved, "nid", "left").select("nid", "size", F.coalesce("want", "shard").alias("shard")).coalesce(files), f"shard-state-{turn}")
    return state


def before(df: DataFrame, value: Column, *, within: list[str], steps: list[str], cells: int) -> DataFrame:
    """``df`` and ``before``: the sum of ``value`` over the rows before it in the order of ``steps``, then of the hash of ``nid``, from 0 in every ``within``.

    ``within`` and ``steps`` have few values together. Their rows are dealt to ``cells`` cells; sums go over steps, over cells, then over the rows of a cell.
    """
    spots = [*within, *steps]
    df = df.withColumn("_v", value).withColumn("_cell", F.pmod(F.xxhash64("nid"), F.lit(cells)))
    cell = df.groupBy(*spots, "_cell").agg(F.sum("_v").alias("_sum"))
    spot = cell.groupBy(*spots).agg(F.sum("_sum").alias("_all"))
    earlier = (Window.unboundedPreceding, -1)
    spot = spot.withColumn("_b1", F.coalesce(F.sum("_all").over(Window.partitionBy(*within).orderBy(*steps, F.lit(0)).rowsBetween(*earlier)), F.lit(0))).drop("_all")
    cell = cell.withColumn("_b2", F.coalesce(F.sum("_sum").over(Window.partitionBy(*spots).orderBy("_cell").rowsBetween(*earlier)), F.lit(0))).drop("_sum")
    starts = cell.join(spot, spots).withColumn("_start", F.col("_b1") + F.col("_b2")).drop("_b1", "_b2")
    inside = Window.partitionBy(*spots, "_cell").orderBy("nid").rowsBetween(*earlier)
    df = df.join(starts, [*spots, "_cell"]).withColumn("before", F.col("_start") + F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return df.drop("_v", "_cell", "_start")


def even_out(placed: DataFrame, *, quotas: Sequence[float], cells: int, files: int = 1) -> DataFrame:
    """``placed`` (nid, size, shard, linked, ...) with ``shard`` changed where a shard holds more than its quota of bytes."""
    # Linked and larger ones are kept first, so small documents without links are what fills gaps.
    df = placed.withColumn("loose", (~F.col("linked")).cast("int")).withColumn("small", -F.floor(F.log2(F.col("size").cast("double"))).cast("int"))
    df = before(df, F.col("size"), within=["shard"], steps=["loose", "small"], cells=cells)
    df = materialize(df.withColumn("stays", F.col("before") + F.col("size") <= _of_shard(quotas, "shard")).drop("before").coalesce(files), "shard-kept")
    kept = {r["shard"]: r["n"] for r in df.filter("stays").groupBy("shard").agg(F.sum("size").alias("n")).collect()}  # a row per shard
    stops, at = [], 0.0
    for s, quota in enumerate(quotas):
        at += max(quota - kept.get(s, 0), 0.0)
        stops.append(at)
    rest = before(df.filter("NOT stays"), F.col("size"), within=[], steps=["loose", "small"], cells=cells)
    to = F.size(F.filter(F.lit(stops[:-1]), lambda x: x <= F.col("before"))).cast("int")
    return df.filter("stays").unionByName(rest.withColumn("shard", to).drop("before")).drop("loose", "small", "stays", "linked")


def shard(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", shards: int = SHARDS, links: DataFrame | None = None, carry: Sequence[str] = (), rounds: int = ROUNDS,
) -> DataFrame:
    """key, size, text_crc32, shard, slot of every row, and ``row`` with the ``carry`` columns. ``links`` (a, b) may link further keys."""
    body = F.coalesce(docs[text], F.lit(""))
    facts = [
        F.monotonically_increasing_id().alias("nid"), docs[key].alias("key"), (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("g"),
    ]
    # Row numbers hold from here on, because the rows are written.
    base = materialize(docs.select(*facts, F.struct(*[docs[c] for c in carry]).alias("row") if carry else F.lit(None).cast("int").alias("row")), "shard-rows")
    rows, total = base.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    large = base.filter(F.col("size") > F.lit(LARGE * total / shards))
    where, quotas = place_large([tuple(r) for r in large.select("nid", "size", "g").collect()], total, shards)  # shards / LARGE rows at most
    free = base.filter(F.col("size") <= F.lit(LARGE * total / shards))
    files = _files(rows)
    near = group_links(free, files=files)
    if links is not None:
        first = base.filter("key IS NOT NULL").groupBy("key").agg(F.min("nid").alias("nid"))
        ends = links.select(F.col("a").alias("key"), F.col("b").alias("_b")).join(first, "key").select(F.col("nid").alias("a"), F.col("_b").alias("key"))
        near = near.unionByName(ends.join(first, "key").filter("a != nid").select("a", F.col("nid").alias("b")))
    state = propagate(free, near, quotas=quotas, rounds=rounds, files=files)
    put = free.join(state.select("nid", F.col("shard").alias("led")), "nid", "left")
    put = put.withColumn("shard", F.coalesce("led", F.pmod(F.xxhash64(F.lit("shard"), "nid"), F.lit(shards)).cast("int"))).withColumn("linked", F.col("led").isNotNull()).drop("led")
    cells = max(1, -(-rows // (shards * CELL_ROWS)))
    out = even_out(put, quotas=quotas, cells=cells, files=files)
    if where:
        out = out.unionByName(large.withColumn("shard", F.element_at(F.create_map(*[F.lit(x) for kv in where.items() for x in kv]), F.col("nid"))))
    out = before(out, F.lit(1), within=["shard"], steps=[], cells=cells).withColumnRenamed("before", "slot")
    cols = [F.col("key").alias(key), "size", "text_crc32", "shard", "slot", *(["row"] if carry else [])]
    return out.select(*cols)


def cut_links(state: DataFrame, links: DataFrame) -> int:
    """How many links have their ends in two shards."""
    a, b = state.select(F.col("nid").alias("a"), F.col("shard").alias("sa")), state.select(F.col("nid").alias("b"), F.col("shard").alias("sb"))
    return links.join(a, "a").join(b, "b").filter("sa != sb").count()

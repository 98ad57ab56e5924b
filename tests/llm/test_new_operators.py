"""Sharding, ranked search and tokenizer alignment on small hard cases, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cuelattice.llm import balanced_labels, term_pipeline, token_alignment
from test_operators import SCHEMA, hard_rows, texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def check_slots(rows, shards):
    for s in range(shards):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_shards(spark, docs, none):
    got = balanced_labels.shard(docs, shards=3, carry=["text", "row"]).collect()
    assert Counter((r["doc_id"], r["row"]["text"]) for r in got) == Counter(texts())
    for r in got:
        raw = (r["row"]["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw)) and r["row"]["row"] == "r"
    check_slots(got, 3)
    # One text is longer than a quota and has its shard to itself; the other two shards are even.
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    long = next(r["shard"] for r in got if r["size"] == 30001)
    a, b = (load[s] for s in range(3) if s != long)
    assert load[long] == 30001 and abs(a - b) <= 2 * sum(load.values()) / 3 / 64
    assert balanced_labels.shard(none).count() == 0


def test_shards_keep_groups_and_split_hot_ones(spark):
    # A third of all rows is one text; 300 texts occur twice to five times; the rest once.
    rows = [(i, "the hot text " * 3) for i in range(2000)]
    rows += [(10000 + i, f"group {i % 300} " * (1 + i % 7)) for i in range(1200)]
    rows = [(d, t if d < 10000 else f"group {d % 300} " * (1 + d % 7)) for d, t in rows]
    rows += [(20000 + i, f"single {i} " * (1 + i % 40)) for i in range(2800)]
    got = balanced_labels.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shards=8).collect()
    assert len(got) == len(rows)
    check_slots(got, 8)
    load = Counter()
    where = defaultdict(Counter)
    by_id = dict(rows)
    for r in got:
        load[r["shard"]] += r["size"]
        where[by_id[r["doc_id"]]][r["shard"]] += 1
    assert max(load.values()) - min(load.values()) <= 200
    groups = [c for t, c in where.items() if t.startswith("group")]
    assert np.mean([len(c) == 1 for c in groups]) > 0.97


def test_propagation_lowers_the_cut_under_quotas(spark):
    # Communities on a ring: dense inside, one link to the next one.
    links = [(c * 20 + i, c * 20 + (i + k) % 20) for c in range(24) for i in range(20) for k in (1, 2, 3)] + [(c * 20, (c * 20 + 20) % 480) for c in range(24)]
    nodes = spark.range(480).select(F.col("id").alias("nid"), F.lit(1).cast("long").alias("size"))
    edges = spark.createDataFrame(links, "a long, b long")
    start = nodes.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "nid"), F.lit(4)).cast("int"))
    state = balanced_labels.propagate(nodes, edges, quotas=[120.0] * 4)
    assert balanced_labels.cut_links(state, edges) < 0.5 * balanced_labels.cut_links(start, edges)
    assert max(r["count"] for r in state.groupBy("shard").count().collect()) <= 150


def test_links_between_keys_and_running_sums(spark):
    rows = [(i, f"text {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 400, 2)] + [(5, None), (None, 7), (9, 9999)], "a long, b long")
    got = {r["doc_id"]: r["shard"] for r in balanced_labels.shard(docs, shards=4, links=links).collect()}
    assert len(got) == 400 and np.mean([got[i] == got[i + 1] for i in range(0, 400, 2)]) > 0.9
    df = spark.range(1000).select(F.col("id").alias("nid"), (F.col("id") % 3).alias("s"), (F.col("id") % 5).alias("k"), (F.col("id") % 11).alias("v"))
    out = balanced_labels.before(df, F.col("v"), within=["s"], steps=["k"], cells=7).collect()
    for s in range(3):
        mine = sorted((r for r in out if r["s"] == s), key=lambda r: r["before"] + (r["v"] > 0) * 0.5)
        at = 0
        for r in sorted(mine, key=lambda r: (r["before"], r["v"])):
            assert r["before"] == at
            at += r["v"]
        assert [r["k"] for r in mine if r["v"]] == sorted(r["k"] for r in mine if r["v"])


def terms(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_search(rows, items, top):
    bags = [(d, Counter(terms(t))) for d, t in rows]
    bags = [(d, b) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = Counter()
    for item, text in items:
        scored = []
        for d, b in bags:
            m = 75 + (25 * sum(b.values()) * n_docs) // n_terms
            s = sum(q * int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df[t] + 1)))) * ((1000000000 * b[t]) // (1000 * b[t] + 12 * m)) for t, q in Counter(terms(text)).items() if t in b)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out.update((item, k + 1, None if z else d, -s) for k, (s, z, d) in enumerate(sorted(scored)[:top]))
    return out


@pytest.mark.parametrize("block, part", [(4096, 512), (7, 2)])
def test_search(spark, docs, none, block, part):
    items = [(0, "hola queso HOLA"), (1, "the house with when"), (2, None), (3, " .. "), (4, "shared3 shared4 w7 unknownword"), (5, "first line"), (5, "first line"), (6, "日本 Σ é́"), (None, "one")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("qid", F.lit(1)).repartition(2)
    got = term_pipeline.search(docs, asked, block=block, items_a_part=part).collect()
    assert Counter(map(tuple, got)) == brute_search(texts(), items, 20)
    assert term_pipeline.search(none, asked).count() == 0
    assert term_pipeline.search(docs, asked.limit(0)).count() == 0


def test_search_with_small_maps_and_many_ties(spark):
    # Frequent words, many equal scores, and a map that lets most words pass.
    rows = [(i, " ".join(f"w{(i * k) % 17}" for k in range(1, 3 + i % 5))) for i in range(300)]
    items = [(i, f"w{i} w{i + 1} w{i}") for i in range(12)]
    got = term_pipeline.search(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), block=16, items_a_part=5, bits=8, top=7)
    assert Counter(map(tuple, got.collect())) == brute_search(rows, items, 7)


def brute_alignment(rows):
    tok = token_alignment.Tokenizers(A, B)
    of_a, of_b = (x.to_pylist() for x in tok.bytes)
    kept, counts = [], Counter()
    for d, t in rows:
        ids = (tok.a.encode(" " + t, add_special_tokens=False).ids, tok.b.encode(t)) if t else ([], [])
        parts = [of_a[i] for i in ids[0]], [of_b[i] for i in ids[1]]
        if not t or any(b"".join(p) != (" " + t).encode() for p in parts):
            kept.append((d, [], [], [], ""))
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        both = sorted(set(ends[0]) & set(ends[1]))
        at = [[e.index(x) + 1 for x in both] for e in ends]
        links = [(ids[0][x - 1], ids[1][y - 1]) for x, y in zip(*at)]
        groups = ["|".join(",".join(str(i) for i in own[(cut[k - 1] if k else 0) : cut[k]]) for own, cut in zip(ids, at)) for k in range(len(both))]
        counts.update(links)
        kept.append((d, *ids, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return Counter((d, len(a), len(b), len(k), len(k), sum(counts[p] == top[p[1]] for p in k), sum(counts[p] for p in k), h) for d, a, b, k, h in kept)


@pytest.mark.parametrize("looked_up", [token_alignment.LOOKED_UP, 0.01, 1.0])
def test_alignment(spark, docs, none, looked_up):
    odd = [(200, "a▁b"), (201, "<|endoftext|> </s> <s>"), (202, "  two  blanks \n\t tab"), (203, "\x00 nul"), (204, "ﬁ ① é é"), (205, " "), (206, "▁")]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("pair", F.lit(1))
    got = token_alignment.align(table, A, B, looked_up=looked_up).collect()
    assert Counter(map(tuple, got)) == brute_alignment(texts() + odd)
    assert {r["n_a"] for r in got if r["doc_id"] in (200, 206)} == {0}
    assert token_alignment.align(none, A, B).count() == 0

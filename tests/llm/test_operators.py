"""The training-data operators on small hard cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuelattice.llm import class_lm, language_id, line_chunks, nn_descent, pareto_mix, prefix_bpe, scaled_sketch, superminhash, token_orc, zstd_quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, id string, n int, w string"
BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PASSAGE = " ".join(f"shared{i}" for i in range(60))


def hard_rows():
    rnd = random.Random(3)
    vocab = {"aa": ["hola", "niño", "queso", "está"], "bb": ["the", "house", "with", "when"]}
    rows = [(0, None), (1, ""), (2, "   \n "), (3, "one"), (4, "One"), (5, "..."), (6, "x" * 30000), (7, "a\nb\nc\nd\ne\nf"), (8, "a\nb\nc\nd\ne\nf"), (None, "no id here")]
    for i in range(10, 70):
        words = [rnd.choice(vocab["aa" if i % 2 else "bb"]) + rnd.choice(["", "s", "ed"]) for _ in range(rnd.randint(3, 90))]
        rows.append((i, "\n".join(" ".join(words[k : k + 7]) for k in range(0, len(words), 7))))
    base = [f"w{k}" for k in range(120)]
    for i in range(70, 90):  # near copies, some of them linked only through others
        w = list(base)
        for k in range(i % 7):
            w[(k * 17 + i) % 120] = f"edit{i}x{k}"
        rows.append((i, " ".join(w)))
    rows += [(90, f"first line\n{PASSAGE}\nlast"), (91, f"other\n{PASSAGE}\nend"), (92, "é́ 日本 😀 Σ")]
    out = [(d, t, None if d is None or d < 10 else "aa" if d % 2 else "bb", [None, "s1", "s2"][(d or 0) % 3], len(t or ""), 5, "r", "i", 1, "w") for d, t in rows]
    return out + [out[12], out[12]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [(r[0], r[1]) for r in hard_rows()]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_language(spark, docs, none):
    model = language_id.fit(docs)
    got = language_id.identify(docs, model).select("row.doc_id", "row.lang", "row.text", "lang_pred", "score", "rejected").collect()
    assert len(got) == len(hard_rows())
    for r in got:
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        else:
            assert r["lang_pred"] in ("aa", "bb") and 0 <= r["score"] <= 1
    sure = [r for r in got if r["lang"] and 10 <= r["doc_id"] < 70 and len(r["text"]) > 60]
    assert np.mean([r["lang"] == r["lang_pred"] for r in sure]) > 0.95
    assert language_id.fit(none) is None
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.identify(none, model).count() == 0


def test_language_of_null_and_repeated_ids_noise_and_short_texts(spark):
    rnd = random.Random(6)
    vocab = {"aa": [f"{a}{b}o" for a in ("hol", "ques", "niñ", "cas") for b in ("it", "ad", "ar", "e")], "bb": [f"{a}{b}" for a in ("th", "wh", "str", "ho") for b in ("ing", "ough", "ed", "use")]}
    say = lambda lang, n: " ".join(rnd.choice(vocab[lang]) for _ in range(n))
    rows = [(None if i % 2 else 7, say("aa" if i % 3 else "bb", rnd.randint(20, 120)), "aa" if i % 3 else "bb") for i in range(600)]
    rows += [(7, "one row again and again " * 20, "aa")] * 3000  # one row that is most of its language
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    letters = "abcdefghijklmnopqrstuvwxyz"
    noise = ["".join(rnd.choice(letters + "    ") for _ in range(2000)) for _ in range(20)]
    asked = [(i, t, "noise") for i, t in enumerate(noise)] + [(100 + i, t, "short") for i, t in enumerate(["holito", "thing", "ok", "El", "quesado casaro"])]
    asked += [(200 + i, say(lang, n), lang) for i, (lang, n) in enumerate((x, n) for x in ("aa", "bb") for n in (5, 20, 100, 2000))]
    got = language_id.identify(spark.createDataFrame(asked, "doc_id long, text string, kind string"), model).select("row.kind", "lang_pred", "rejected").collect()
    for r in got:
        assert r["rejected"] == (r["kind"] == "noise"), r
        assert r["kind"] not in ("aa", "bb") or r["lang_pred"] == r["kind"]


def test_nearest_centroid_against_brute_force(spark, docs):
    model = language_id.fit(docs)
    got = {(r["doc_id"], r["text"]): r for r in language_id.identify(docs, model).select("row.*", "lang_pred", "score").collect()}
    for (_, t), r in got.items():
        if not re.search(r"[^\W\d_]", t or ""):
            continue
        b = re.sub(rb"[^a-z\x80-\xff]", b" ", re.sub("[À-Þ]", lambda x: x[0].lower(), t).encode().lower())
        b = b" " + b + b" "
        grams = [b[i : i + 3] for i in range(len(b) - 2) if b[i : i + 2] != b"  "]
        mult = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
        v = np.zeros(language_id.DIM)
        for g in grams:
            v[(sum(c * k for c, k in zip(g, mult)) & 0xFFFFFFFF) >> 20] += 1
        v = np.log1p(v) * model.idf
        cos = model.matrix @ (v / max(np.linalg.norm(v), 1e-12))
        best = [cos[model.owner == i].max() for i in range(len(model.langs))]
        e = np.exp(20 * (np.array(best) - max(best)))
        if max(best) > 0 and abs(best[0] - best[1]) > 1e-5:
            assert r["lang_pred"] == model.langs[int(np.argmax(best))] and abs(r["score"] - e.max() / e.sum()) < 1e-3


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    path = token_orc.new_path(spark)
    token_orc.write_tokens(docs, path, WORDS, end_id=1)
    got = token_orc.checksums(token_orc.read_tokens(spark, path)).orderBy("start").collect()
    tok = Tokenizer.from_file(WORDS)
    tok.encode_special_tokens = True
    want, start = [], 0
    order = sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0))
    by_id: dict = {}
    for d, t in order:
        by_id.setdefault(d, []).append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    for r in got:
        ids = by_id[r["doc_id"]].pop(0)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert [r["doc_id"] for r in got] == [d for d, _ in order]
    assert sorted(r["doc_id"] for r in token_orc.read_tokens(spark, path, [3, 92]).collect()) == [3, 92]
    empty = token_orc.new_path(spark)
    token_orc.write_tokens(none, empty, WORDS, end_id=1)
    assert token_orc.read_tokens(spark, empty).count() == 0


def test_nearest(spark):
    rnd = np.random.default_rng(5)
    x = rnd.standard_normal((600, 8)) * rnd.uniform(0.5, 2, (600, 1))
    x[100:400] = x[100]  # a third and more are one vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(600, None), (620, [0.0] * 8), (640, [1.0, None, *[0.0] * 6]), (660, [float("nan")] * 8), (680, [1.0]), (700, [float("inf")] * 8), (None, [1.0] * 8)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("node", F.lit(1)).repartition(4)
    got = nn_descent.nearest(table).collect()
    assert {r["query_id"] for r in got} == set(range(0, 600, 20))
    hits = 0
    for q in range(0, 600, 20):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(600), -s))[:20].tolist()
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(abs(r["score"] - s[r["vec_id"]]) < 1e-9 for r in mine)
        hits += len(set(want) & {r["vec_id"] for r in mine})
    assert hits >= 0.9 * 30 * 20
    assert nn_descent.nearest(table.limit(0)).count() == 0
    assert nn_descent.nearest(table.filter("vec_id IN (0, 1, 2)")).count() == 2


@pytest.mark.parametrize("long", [1e3, 1e6])
def test_nearest_with_a_few_long_vectors(spark, long):
    rnd = np.random.default_rng(9)
    x = rnd.standard_normal((4000, 16))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    x[[7, 1000, 2345]] *= [[long], [long / 3], [30.0]]
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = nn_descent.nearest(table, every=100).collect()
    hits = 0
    for q in range(0, 4000, 100):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        want = set(np.lexsort((np.arange(4000), -s))[:20].tolist())
        hits += len(want & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits >= 0.95 * 40 * 20


def test_mix(spark, docs, none):
    got = pareto_mix.mix(docs).select("row.doc_id", "row.source", "row.text", "size", "source_size", "target", "copies", "taken").collect()
    assert len(got) == len(hard_rows())
    total = sum(len(words(t)) for _, t in texts())
    for source in (None, "s1", "s2"):
        rows = [r for r in got if r["source"] == source]
        assert sum(r["size"] for r in rows) == rows[0]["source_size"]
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= max(r["size"] for r in rows)
    assert abs(sum({r["source"]: r["target"] for r in got}.values()) - 1.5 * total) < 1e-6
    assert all(r["size"] == len(words(r["text"])) and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in got)
    again = pareto_mix.mix(docs.repartition(7)).select("row.doc_id", "taken").collect()
    assert Counter(map(tuple, again)) == Counter((r["doc_id"], r["taken"]) for r in got)
    assert pareto_mix.copied(pareto_mix.mix(docs)).count() == sum(r["copies"] for r in got)
    weighed = pareto_mix.mix(docs.withColumn("weight", F.when(F.col("doc_id") % 2 == 0, 3.0).when(F.col("doc_id") == 11, None).when(F.col("doc_id") == 13, -1.0).otherwise(1.0)), weight="weight")
    assert weighed.filter("row.doc_id = 13 AND taken > 0 AND target < 2 * source_size").count() == 0 and weighed.agg(F.sum("taken")).first()[0] > 0
    assert pareto_mix.mix(none).count() == 0


def test_mix_inclusion_frequencies(spark):
    # One source that keeps a part of its words, and one that must double: sizes 1 to 40, three weights, the heaviest over the limit.
    rows = [(i, "w " * (1 + i % 40), "a" if i % 3 else "b", [1.0, 3.0, 30.0][i % 7 % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double").coalesce(1).cache()
    total = {s: sum(len(t.split()) for _, t, x, _ in rows if x == s) for s in "ab"}
    share = (0.6 * total["a"] + 2 * total["b"]) / sum(total.values())
    taken = {r[0]: [] for r in rows}
    for seed in range(16):
        got = pareto_mix.mix(docs, weight="weight", weights=(3, 7), share=share, seed=seed).select("row.doc_id", "row.source", "size", "target", "copies").collect()
        for s in "ab":
            mine = [r for r in got if r["source"] == s]
            assert abs(sum(r["copies"] * r["size"] for r in mine) - mine[0]["target"]) <= 20
        for r in got:
            taken[r["doc_id"]].append(r["copies"])
    target = {r["source"]: r["target"] for r in got}
    for s in "ab":
        mine = [r for r in rows if r[2] == s]
        lo, hi = 0.0, 1e6
        for _ in range(200):  # the level at which the expected words are the target
            c = (lo + hi) / 2
            lo, hi = (lo, c) if sum(len(r[1].split()) * min(2.0, c * r[3]) for r in mine) > target[s] else (c, hi)
        for w in (1.0, 3.0, 30.0):
            same, want = [r[0] for r in mine if r[3] == w], min(2.0, c * w)
            mean = np.mean([np.mean(taken[d]) for d in same])
            assert abs(mean - want) < 0.08, (s, w, mean, want)
            if want in (0.0, 1.0, 2.0):
                assert {k for d in same for k in taken[d]} == {int(want)}


def test_line_chunks(spark, docs, none):
    got = {r["doc_id"]: r for r in line_chunks.dedup_lines(docs).select("row.doc_id", "row.text", "new_text", "n_lines", "n_removed").collect()}
    assert line_chunks.dedup_lines(docs).count() == len(hard_rows())
    assert got[0]["new_text"] is None and got[1]["new_text"] == ""
    assert got[90]["new_text"] == got[90]["text"] and got[91]["new_text"] == "other\nend"
    assert got[7]["new_text"] == got[7]["text"] and len(got[8]["new_text"]) < len(got[8]["text"])
    for r in got.values():
        if r["text"]:
            kept, lines = r["new_text"].split("\n") if r["n_removed"] < r["n_lines"] else [], r["text"].split("\n")
            assert len(kept) == len(lines) - r["n_removed"]
            it = iter(lines)
            assert all(k in it for k in kept)  # a subsequence
    assert line_chunks.dedup_lines(none).count() == 0


def test_line_chunks_resist_shifts(spark):
    lines = [f"line {i} of a passage" for i in range(60)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["new head", *lines[:30], "put in", *lines[30:]]))]
    got = {r["doc_id"]: r for r in line_chunks.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "n_removed").collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] >= 40


@pytest.mark.parametrize("n", range(3, 13))
def test_line_chunks_between_other_neighbours(spark, n):
    passage = [" ".join(f"p{n}x{i}y{j}" for j in range(60 // n + 1)) for i in range(n)]
    rows = []
    for d in range(12):
        inner = passage if n % 2 else [*passage[:2], "", *passage[2:]]
        rows.append((d, "\n".join(["a common line", f"head {d}", *inner, f"tail {d}", "a common line", "x  " * 60 + str(d)])))
    got = {r["doc_id"]: r for r in line_chunks.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("row.*", "new_text", "n_removed").collect()}
    assert got[0]["new_text"] == got[0]["text"]
    for d in range(1, 12):
        assert got[d]["new_text"] == "\n".join(["a common line", f"head {d}", f"tail {d}", "a common line", "x  " * 60 + str(d)])


def test_line_chunks_count_words_and_keep_lone_lines(spark):
    wide = "two" + " " * 80 + "words"
    rows = [(1, f"{wide}\n\nend one"), (2, f"start\n{wide}\n\n"), (3, "la\nla\nla\nother"), (4, "\n\n\nlone\n\n"), (5, "\n\n\nlone too\n\n")]
    got = {r["doc_id"]: r for r in line_chunks.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("row.*", "new_text").collect()}
    assert all(r["new_text"] == r["text"] for r in got.values())


def test_line_chunks_with_one_odd_blank_line(spark):
    rows = [(d, f"own {d}\nfirst line of it\n\nsecond line of it\nlast line of it\nend {d}") for d in range(20)]
    odd = (99, "own 99\nfirst line of it\n \nsecond line of it\nlast line of it\nend 99")
    for table in (rows, [*rows, odd]):
        got = {r["doc_id"]: r for r in line_chunks.dedup_lines(spark.createDataFrame(table, "doc_id long, text string")).select("row.*", "new_text", "n_removed").collect()}
        assert got[0]["n_removed"] == 0 and all(got[d]["new_text"] == f"own {d}\nend {d}" for d in range(1, 20))


def brute_lines(rows, spark, long_words):
    """Lines that stay, by the rules of the module's docstring, on Python lists. Hashes are Spark's, for they choose the borders."""
    lines = {k: t.split("\n") for k, (_, t) in enumerate(rows) if t}
    flat = sorted({x for ls in lines.values() for x in ls})
    num = {x: i for i, x in enumerate(flat)}
    h = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in flat], "x string").select("x", F.xxhash64("x")).collect()}
    spans = {}
    for d, ls in lines.items():
        full = [k for k, x in enumerate(ls) if re.search(r"\S", x)]
        spans[d] = [(a, b - a + 1) for a, b in zip(full, full[1:])]
    bodies = sorted({tuple(lines[d][k : k + n]) for d in spans for k, n in spans[d]})
    hashed = spark.createDataFrame([([h[x] for x in b], list(b)) for b in bodies], "hs array<long>, b array<string>").select("b", F.xxhash64("hs")).collect() if bodies else []
    wh = {tuple(r[0]): r[1] for r in hashed}
    th = {r[0]: r[1] for r in spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "k long, t string").select("k", F.xxhash64("t")).collect()}
    core, single = {}, {}
    for d, ws in spans.items():
        v = [wh[tuple(lines[d][k : k + n])] for k, n in ws]
        for j, (k, n) in enumerate(ws):
            heavy = lines[d][k].count(" ") + lines[d][k + n - 1].count(" ") + 2 >= long_words
            if heavy or len(v) == 1 or (j and v[j] <= v[j - 1]) or (j + 1 < len(v) and v[j] <= v[j + 1]):
                core[d, j] = "\n".join(lines[d][k : k + n])
        for k, x in enumerate(lines[d]):
            if len(x.split()) >= long_words:
                single[d, k] = x
    many = Counter([*core.values(), *single.values()])
    cand = {(d, *spans[d][i]) for (d, j), b in core.items() if many[b] > 1 for i in (j - 1, j, j + 1) if 0 <= i < len(spans[d])}
    cand |= {(d, k, 1) for (d, k), x in single.items() if many[x] > 1}
    groups = {}
    for d, k, n in cand:
        groups.setdefault("\n".join(lines[d][k : k + n]), []).append((rows[d][0] is None, rows[d][0] or 0, th[d], k, d, n))
    gone = set()
    for g in groups.values():
        _, _, _, k0, d0, n0 = min(g)
        gone |= {(d, k + i) for _, _, _, k, d, n in g if not (d == d0 and k < k0 + n0) for i in range(n)}
    assert num
    return [None if t is None else t if k not in lines else "\n".join(x for i, x in enumerate(lines[k]) if (k, i) not in gone) for k, (_, t) in enumerate(rows)]


@pytest.mark.parametrize("seed", range(4))
def test_line_chunks_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    pool = [f"line {i} " + "w " * rnd.randint(0, 12) for i in range(12 if seed % 2 else 60)] + ["", " ", "  "]
    rows = [(d, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 25)))) for d in range(60)] + [(None, "line 1\nline 2"), (70, None), (71, "")]
    passage = "\n".join(f"shared {i}" for i in range(5))
    rows += [(80 + d, f"a{d}\n{passage}\nb{d}\n{passage}") for d in range(4)]
    rows = list(dict(rows).items())
    got = {r["doc_id"]: r["new_text"] for r in line_chunks.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), long_words=12).select("row.doc_id", "new_text").collect()}
    want = brute_lines(rows, spark, 12)
    assert got == {d: w for (d, _), w in zip(rows, want)}


def test_sketch(spark, docs, none):
    got = scaled_sketch.edited_pairs(docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), rows_a_bin=8).orderBy("doc_id").collect()
    rows = sorted({d: t or "" for d, t in texts() if d is not None}.items())
    assert [r["doc_id"] for r in got] == [d for d, _ in rows]
    for k, (r, (_, t)) in enumerate(zip(got, rows)):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + rows[(k + 1) % len(rows)][1][:cut]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        w = t.split()
        shingles = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
        assert len(r["fingerprint"]) % 16 == 0 and len(r["fingerprint"]) // 16 <= len(shingles)
    same = {r["doc_id"]: r["fingerprint"] for r in got}
    assert same[7] == same[8]
    assert scaled_sketch.edited_pairs(docs).count() == len(hard_rows())
    assert scaled_sketch.edited_pairs(none).count() == 0


def test_sketch_against_brute_force(spark, docs):
    rows = sorted({d: t or "" for d, t in texts() if d is not None}.items())
    edited = [(d, t[: len(t) - len(t) // 4] + rows[(k + 1) % len(rows)][1][: len(t) // 4]) for k, (d, t) in enumerate(rows)]
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    shingles = {tuple(w[i : i + 5]) for _, t in rows + edited if (w := split(t)) for i in range(max(len(w) - 4, 1))}
    five = spark.createDataFrame([s for s in shingles if len(s) == 5], "a string, b string, c string, d string, e string").select(F.array("a", "b", "c", "d", "e"), F.xxhash64("a", "b", "c", "d", "e"))
    less = spark.createDataFrame([(list(s),) for s in shingles if len(s) < 5], "w array<string>").select("w", F.xxhash64(F.array_join("w", " ")))
    h = {tuple(r[0]): r[1] for r in [*five.collect(), *less.collect()]}
    limit = -(1 << 63) + (1 << 63)

    def sketch(t):
        w = split(t)
        return sorted({x for i in range(max(len(w) - 4, 1)) if w and (x := h[tuple(w[i : i + 5])]) < limit})

    def like(a, b, same):
        return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else float(same)

    got = {r["doc_id"]: r for r in scaled_sketch.edited_pairs(docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), rows_a_bin=8).collect()}
    as_text = lambda s: "".join(f"{x & (2**64 - 1):016x}" for x in s)
    for k, ((d, t), (_, e)) in enumerate(zip(rows, edited)):
        nxt = rows[(k + 1) % len(rows)][1]
        assert (got[d]["fingerprint"], got[d]["edited_fingerprint"]) == (as_text(sketch(t)), as_text(sketch(e)))
        assert abs(got[d]["near_edited"] - like(sketch(t), sketch(e), t == e)) < 1e-12 and abs(got[d]["near_next"] - like(sketch(t), sketch(nxt), t == nxt)) < 1e-12


def test_nearest_with_repeated_ids_and_ties(spark):
    rnd = np.random.default_rng(3)
    x = np.round(rnd.standard_normal((300, 8)), 1)
    x[50:60] = x[40]  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    # Some ids twice, once with another vector; the least vector counts.
    more = [(i, [9.0, *[0.0] * 7]) for i in (0, 20, 33)] + rows[100:110]
    kept = {i: min(v for j, v in rows + more if j == i) for i in range(300)}
    y = np.array([kept[i] for i in range(300)])
    got = nn_descent.nearest(spark.createDataFrame(rows + more, "vec_id long, embedding array<double>").repartition(3)).collect()
    hits = 0
    for q in range(0, 300, 20):
        s = (y * y[q]).sum(axis=1)
        s[q] = -np.inf
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert len(mine) == 20 and [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        hits += len(set(np.lexsort((np.arange(300), -s))[:20].tolist()) & {r["vec_id"] for r in mine})
    assert hits >= 0.95 * 15 * 20


def test_sketch_estimates(spark):
    long = [f"v{i}" for i in range(4000)]
    df = spark.createDataFrame([(long[:400], long, long[200:600])], "a array<string>, b array<string>, c array<string>")
    s = df.select(*[scaled_sketch.sketch_of(F.col(x)).alias(x) for x in "abc"])
    r = s.select(scaled_sketch.containment(F.col("a"), F.col("b")).alias("ab"), scaled_sketch.containment(F.col("a"), F.col("c")).alias("ac"), (F.size(scaled_sketch.merged(F.col("a"), F.col("c"))) / F.size("a")).alias("m")).first()
    assert r["ab"] == 1.0 and abs(r["ac"] - 0.5) < 0.15 and abs(r["m"] - 1.5) < 0.15


def test_class_model(spark, docs, none):
    model = class_lm.fit(docs.filter("doc_id % 10 != 0"))
    got = class_lm.score(docs, model).collect()
    assert len(got) == len(hard_rows())
    train = Counter(w for d, t in texts() if d is not None and d % 10 for w in [*words(lower(t or "")), None])
    n, v = sum(train.values()), len(train)
    assert (model.n, model.v) == (n, v)
    want = Counter()
    for d, t in texts():
        w = [*words(lower(t or "")), None]
        base = sum(np.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want[d, len(w), sum(train[x] > 0 for x in w), round(base, 6)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    total = (10 ** model.log_transition).sum(axis=1) + model.unseen
    assert np.allclose(total, 1)
    assert model.likelihoods[-1] >= model.likelihoods[0]
    assert model.bigrams.sum() == n
    empty = class_lm.fit(none)
    assert {r["score"] for r in class_lm.score(docs.filter("doc_id = 3"), empty).collect()} == {0.0}
    assert class_lm.score(none, model).count() == 0


def test_class_model_follows_every_word(spark, monkeypatch):
    """Rare words, joined ones and unknown ones: bigrams and scores by the word just before, by brute force."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 40) if x < 5000)) for i in range(60)]
    rows += [(i, "new words here w1 w2 unseen w3") for i in (60, 61, 61)] + [(62, None), (None, "w1 w1 odd odd"), (None, "w1 w1 odd odd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = docs.filter("doc_id < 50")
    monkeypatch.setattr(class_lm, "CLUSTERED", 2.0**-7)
    monkeypatch.setattr(class_lm, "LOOKED_UP", 2.0**-6)
    model = class_lm.fit(train, classes=4)
    assert model.rest.count() > len(model.known.hashes) > 2

    def hashed(t):
        return class_lm.word_hashes(*class_lm.text_buffer(pa.array([t], pa.string())))[0].tolist()

    table = {int(h): (int(v) >> 6, int(v) & 63) for h, v in zip(model.known.hashes, model.known.values)}
    table.update({r["w"] & (2**64 - 1): (r["c"], r["cls"]) for r in model.rest.collect()})
    start, unknown = 4, 5
    bigrams, tokens = np.zeros((5, 5)), Counter()
    for i, t in rows:
        if i is not None and i < 50:
            before = start
            for h in [*hashed(t), int(class_lm.END)]:
                bigrams[before, table[h][1]] += 1
                before = table[h][1]
                tokens[h] += 1
    assert np.array_equal(bigrams, model.bigrams)
    assert {h: c for h, (c, _) in table.items()} == dict(tokens)
    share = (bigrams.sum(axis=0) + 1) / (bigrams.sum() + 5)
    want = Counter()
    for i, t in rows:
        before, total = start, 0.0
        for h in [*hashed(t), int(class_lm.END)]:
            if h in table:
                c, own = table[h]
                p = share[own] if before == unknown else (bigrams[before, own] + class_lm.SMOOTH * share[own]) / (bigrams[before].sum() + class_lm.SMOOTH)
                total += np.log10((1 - model.unseen) * p * c / bigrams[:, own].sum())
                before = own
            else:
                total += np.log10(model.unseen)
                before = unknown
        want[i, round(total, 6)] += 1
    assert Counter((r["doc_id"], round(r["score"], 6)) for r in class_lm.score(docs, model).collect()) == want


def test_exchange_step_of_rare_words():
    """The step takes both sides on their own, as the rounds do, and so comes near the best likelihood of the whole table."""
    rng = np.random.default_rng(9)
    table = rng.integers(1, 40, (6, 6)).astype(float)
    starts, before, after, n = np.array([0, 3, 4]), rng.integers(0, 6, 9), rng.integers(0, 6, 9), rng.integers(1, 9, 9)

    def likelihood(t):
        return (t * np.log(t)).sum() - (t.sum(axis=1) * np.log(t.sum(axis=1))).sum() - (t.sum(axis=0) * np.log(t.sum(axis=0))).sum()

    for i, (lo, hi) in enumerate(zip(starts, [3, 4, 9])):
        values = []
        for to in range(5):
            t = table.copy()
            np.add.at(t, (before[lo:hi], to), n[lo:hi])
            np.add.at(t, (to, after[lo:hi]), n[lo:hi])
            values.append(likelihood(t))
        got = class_lm.best_classes(starts, before, after, n, table)[i]
        assert values[got] >= max(values) - 0.5


def brute_components(rows, width, percent):
    sets = {}
    for d, t in rows:
        w = words(lower(t or ""))
        sets[d] = frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset())
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(d for d in sets if d is not None and sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x = len(sets[a] & sets[b])
            if 100 * x >= percent * (len(sets[a]) + len(sets[b]) - x):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, none, width, percent):
    got = superminhash.near_duplicates(docs, width=width, percent=percent).collect()
    want = brute_components(texts(), width, percent)
    assert len(got) == len(hard_rows())
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert superminhash.near_duplicates(none).count() == 0


def test_near_duplicates_on_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute_components([tuple(r) for r in docs.select("doc_id", "text").collect()], 3, 85)
    got = superminhash.near_duplicates(docs, width=3, percent=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_permutations_and_estimates():
    keys = np.random.default_rng(0).integers(0, 2**63, 500).astype(np.uint64)
    ranks = np.stack([superminhash._permuted(keys, j) for j in range(superminhash.POSITIONS)], 1)
    assert (np.sort(ranks, 1) == np.arange(superminhash.POSITIONS)).all()
    a = np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64)
    b = a.copy()
    b[:100] += np.uint64(1)
    sig = superminhash.signatures(np.concatenate([a, b]), np.array([1000, 1000, 0]))
    assert abs((sig[0] == sig[1]).mean() - 900 / 1100) < 0.12


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(10, 70)] + [(71, None, None), (10, 0, 1)], "doc_id long, quality int, toxic int")
    model = zstd_quality.fit(docs.filter("doc_id % 5 != 0"), labels)
    got = zstd_quality.score(docs, model).collect()
    assert len(got) == len(hard_rows()) and all(0 <= r["score"] <= 1 for r in got)
    held = [(r["score"], r["doc_id"] % 2) for r in got if r["doc_id"] and 10 <= r["doc_id"] < 70 and r["doc_id"] % 5 == 0]
    assert np.mean([s for s, y in held if y]) > np.mean([s for s, y in held if not y])
    assert {r["score"] for r in zstd_quality.score(docs, zstd_quality.fit(none, labels)).collect()} == {0.5}
    assert zstd_quality.score(none, model).count() == 0


def test_quality_features_and_held_out_order(spark):
    import zstandard as z

    rnd = random.Random(11)
    good, bad = ([f"{a}{b}" for a in x for b in ("ing", "ly", "tion", "er")] for x in (("walk", "quiet", "sta", "riv"), ("win", "ca$h", "cl1ck", "fr33")))
    rows = [(i, " ".join(rnd.choice(good if (i % 2) ^ (rnd.random() < 0.15) else bad) for _ in range(rnd.randint(20, 400)))) for i in range(600)] + [(600, ""), (601, None), (602, "x" * 70000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = docs.filter("doc_id < 600").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = zstd_quality.fit(docs.filter("doc_id % 5 != 0"), labels)
    got = {r["doc_id"]: r for r in zstd_quality.score(docs, model).collect()}
    dicts = [z.ZstdCompressionDict(d) for d in (model.good, model.bad)]
    for d in dicts:
        d.precompute_compress(level=zstd_quality.LEVEL)
    makers = [z.ZstdCompressor(level=zstd_quality.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for d in dicts]
    for d, t in rows:
        raw = (t or "").encode()
        g, b = (sum(len(m.compress(raw[i : i + zstd_quality.SLICE])) for i in range(0, len(raw), zstd_quality.SLICE)) for m in makers)
        x = (b - g) / len(raw) if raw else 0.0
        assert abs(got[d]["feature"] - x) < 1e-12 and abs(got[d]["score"] - np.interp(x, model.xs, model.ps)) < 1e-12
    held = [(got[d]["score"], d % 2) for d in range(0, 600, 5)]
    pairs = [(a, b) for a, y in held for b, w in held if y > w]
    assert np.mean([(a > b) + 0.5 * (a == b) for a, b in pairs]) > 0.75  # one text in seven is labelled wrongly on purpose


def test_quality_learns_from_the_ends_of_long_texts(spark):
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice("abcdefghij ") for _ in range(20000)) + f" what marks label {i % 2} comes late" * 400) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = zstd_quality.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("quality")))
    assert b"marks label 1 comes" in model.good and b"marks label 0 comes" in model.bad


@pytest.fixture(scope="module")
def plain():
    import tiktoken

    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=prefix_bpe.read_ranks(BPE), special_tokens={})


def test_bpe(spark, docs, none, plain):
    got = prefix_bpe.encode_decode(docs, BPE, public_tokenizers.PATTERN, with_ids=True).collect()
    want = Counter()
    for d, t in texts():
        ids = np.array(plain.encode_ordinary(t or ""), "<u4")
        want[d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert all(r["same_bytes"] and len(r["ids"]) == r["n_tokens"] for r in got)
    assert prefix_bpe.encode_decode(none, BPE, public_tokenizers.PATTERN).count() == 0


def test_bpe_against_plain_merging(plain):
    enc = prefix_bpe.TextEncoder(BPE, public_tokenizers.PATTERN)
    rnd = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\r\n", "'s", "'re", "é", "ñ", "1", "23", "!!", " ", "　", "\x1c", "\x85", "日本", "ab", "the", "ing", "😀", "é"]
    for k in (11, len(parts)):
        for _ in range(1500):
            s = "".join(rnd.choice(parts[:k]) for _ in range(rnd.randint(0, 40)))
            assert np.frombuffer(enc.encode(s), "<u4").tolist() == plain.encode_ordinary(s)
    for _ in range(200):
        s = bytes(rnd.choice(b"abtheinglo") for _ in range(300))
        e = prefix_bpe.EditablePiece(enc.bpe, s[:100])
        e.append(s[100:])
        assert e.ids() == enc.bpe.encode_piece(s)
        lo = rnd.randint(0, 300)
        hi = min(300, lo + rnd.randint(0, 5))
        e.replace(lo, hi, b"the")
        assert e.piece == s[:lo] + b"the" + s[hi:] and e.ids() == enc.bpe.encode_piece(e.piece)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cols = docs.columns
    seen = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, sf_dir)
        assert sorted(seen.columns) == sorted(cols)
    out = corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    texts_left = {r["doc_id"]: r["text"] for r in seen.select("doc_id", "text").collect()}
    assert {r["doc_id"] for r in out} == set(texts_left)
    for r in out:
        assert r["decoded_sha256"] == hashlib.sha256(texts_left[r["doc_id"]].encode()).hexdigest()
    originals = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert set(texts_left) <= originals and len(texts_left) > 0.5 * len(originals)


def test_pipeline_on_hard_rows(spark, docs, none):
    import corpus_pipeline

    for table in (docs, none):
        seen = table
        for _, stage in corpus_pipeline.STAGES:
            seen = stage(spark, seen, "")
        seen.count()


def test_near_dedup_stage_tells_documents_by_id_and_text(spark):
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (1, "another text with the same id as the first one"), (2, long + " more"), (None, "copied " * 3 + long[50:]), (None, "copied " * 3 + long[50:]), (None, "no id but its own words entirely here"), (3, "row twice in the table, word by word"), (3, "row twice in the table, word by word"), (None, None)]
    docs = spark.createDataFrame([(d, t, None, "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id", "text").collect()]
    assert len(left) == len(set(left)) == 6 and {(1, rows[1][1]), (None, rows[5][1]), rows[6], (None, None)} <= set(left)
    assert sum(t in (rows[0][1], rows[2][1]) for _, t in left) == 1 and sum(t == rows[3][1] for _, t in left) == 1


def test_word_encoder_equals_the_tokenizer_on_odd_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    enc = token_orc.WordEncoder(path)
    odd = ["ªºµ ß ÀÉ ñandú ça", "x́ ﬁ Ǆ", "naïveté’s it's 12ab <|endoftext|> startoftext", "İ É a\u0085b\x1cc", "Ÿÿ", "a" * 5000, "½²³", "", " \t\n", "don't DON'T we'll"]
    want = [e.ids + [1] for e in enc.tokenizer.encode_batch(odd, add_special_tokens=False)]
    for _ in range(2):  # fresh, then from the memo
        assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(odd, 1)] == want

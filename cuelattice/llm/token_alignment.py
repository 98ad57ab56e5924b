"""Alignment of two tokenizers over a corpus: where tokens of both end at one byte, as Arrow pipelines inside Spark tasks.

A batch of texts becomes two flat id columns with list offsets. Texts are cut before spaces, where no token of either tokenizer goes across; each distinct
piece is encoded once while it is kept, and the ids of pieces are taken together again to the ids of texts, the same as those of whole texts. The parent
index of a token is its document; its byte end is the running sum of
token lengths less the sum where its document starts. An Acero hash join on (document, end) finds the places where an A and a B token end
together: the links. They cut both token lists into groups, whose ids are joined to text and digested. ``Table.group_by`` counts id pairs,
first per document, then per task, and Spark merges the partial counts.

Scores need a pair's count in the whole corpus. Pairs with a share of 2^-20 of the links or more (so 1,048,576 at most, whatever the corpus) are looked up by a
broadcast table; all others are joined, one row per document and pair. Both ways give the same numbers.

Defined cases: null and empty texts, and texts whose A or B bytes differ from space and text, have no tokens, zeros and an empty digest;
repeated rows are documents of their own; ties for a B id's highest count all count as highest; null keys are kept; very long texts are worked on whole; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cuelattice.llm.arrays import row_pieces, text_buffer, worker_memo
from cuelattice.session import materialize

LOOKED_UP = 2.0**-20
PIECE = 1 << 20
KEPT_PIECES = 1 << 19
KEPT_BYTES = 1 << 24
_COMPACT = 1 << 21


def byte_of_char() -> dict[str, int]:
    """The byte that a character stands for in a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _a_bytes(path: str) -> list[bytes]:
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    of = byte_of_char()
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    return out


def _b_bytes(model) -> list[bytes]:
    def one(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    return [one(i) for i in range(model.get_piece_size())]


def _cuttable(a_path: str, model, pieces: list[bytes]) -> bool:
    """Whether both tokenizers work on both sides of a cut apart.

    A does if it only parts bytes by its pattern, which has a match begin at a space that a character other than white space follows. B does if it takes
    characters as they are and no piece has a space behind another character.
    """
    from sentencepiece import sentencepiece_model_pb2

    with open(a_path, encoding="utf-8") as f:
        a = json.load(f)
    pre = a["pre_tokenizer"] or {}
    parted = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    plain = a["normalizer"] is None and a["post_processor"] is None and a["truncation"] is None and a["padding"] is None
    plain = plain and not a["model"].get("dropout") and all(t["special"] for t in a["added_tokens"])
    b = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
    # 1 is a normal piece, 4 a user's own, which is matched before all others.
    kinds, spec = {p.type for p in b.pieces}, b.normalizer_spec
    as_is = not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
    as_is = as_is and b.trainer_spec.model_type == 2 and not b.trainer_spec.treat_whitespace_as_suffix and 4 not in kinds
    return bool(parted and plain and as_is and not any(b" " in p.lstrip(b" ") for p in pieces))


def _may_follow() -> np.ndarray:
    """Flags of the bytes that surely do not begin a white space character (U+0085, U+00A0, U+1680, U+2000 to U+205F and U+3000 begin with C2 and E1 to E3)."""
    out = np.zeros(256, bool)
    out[33:127] = out[0xC3:0xE1] = out[0xE4:0xF5] = True
    return out


def cut_pieces(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """Space and text, cut before every space that no space precedes and no white space follows, and each text's first piece (and the end). Each piece begins
    with a space and has more than it; texts have characters."""
    raw = [b" " + t.encode() for t in texts]
    data = b"".join(raw)
    ends = np.cumsum([0, *map(len, raw)])
    b = np.frombuffer(data, np.uint8)
    cut = np.zeros(len(b) + 1, bool)
    if len(b):
        blank = b == 32
        cut[1 : len(b) - 1] = blank[1:-1] & ~blank[:-2] & _may_follow()[b[2:]]
    cut[ends] = True
    at = np.flatnonzero(cut)
    pieces = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))
    return pieces, np.searchsorted(at, ends)


def _id_lists(parts: list[list[int]]) -> pa.ListArray:
    n = np.cumsum([0, *map(len, parts)])
    ids = np.fromiter(chain.from_iterable(parts), np.int32, int(n[-1]))
    return pa.ListArray.from_arrays(pa.array(n.astype(np.int32)), pa.array(ids))


class Tokenizers:
    """Both tokenizers with the bytes of every id and its decimal text, loaded once per worker.

    Texts are cut where neither tokenizer has a token across, and each distinct piece is encoded once while it is kept, at most for one task.
    ``kept_pieces`` and ``kept_bytes`` bound what is kept; beyond them the pieces seen in fewest batches go, to be encoded again when they come again.
    """

    def __init__(self, a_path: str, b_path: str, kept_pieces: int = KEPT_PIECES, kept_bytes: int = KEPT_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        a, b = _a_bytes(a_path), _b_bytes(self.b)
        self.bytes = (pa.array(a, pa.binary()), pa.array(b, pa.binary()))
        self.lengths = tuple(pc.binary_length(x).cast(pa.int64()) for x in self.bytes)
        self.names = pa.array([str(i) for i in range(max(len(a), len(b)))])
        self.cuts = _cuttable(a_path, self.b, b)
        self.kept_pieces, self.kept_bytes = kept_pieces, kept_bytes
        self.forget()

    def forget(self) -> None:
        """Keep no pieces."""
        self.slot: dict[str, int] = {}
        self.ids = (_id_lists([]), _id_lists([]))
        # Of each piece: whether both tokenizers give its bytes back, its size, and the batches it was in.
        self.sound, self.size, self.seen = np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode_whole(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        return _id_lists(a), _id_lists(self.b.encode(texts, num_threads=1))

    def _encode_pieces(self, new: list[str]) -> tuple[list[str], list[pa.ListArray], np.ndarray]:
        """Distinct pieces, ids of both, and whether these give the piece's bytes back.

        Pieces that may meet at a cut are encoded as one text of up to 64, whose ids part at the pieces' ends. If such a text does not come back, its pieces are
        encoded apart.
        """
        raw = [p.encode() for p in new]
        first = np.arange(len(new)) % 64 == 0
        first |= ~_may_follow()[[r[1] for r in raw]]
        first[1:] |= np.array([r[-1] for r in raw[:-1]]) == 32
        at = np.append(np.flatnonzero(first), len(new))
        texts = ["".join(new[s:e])[1:] for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
        ids = self._encode_whole(texts)
        sound = _checked(ids[0], self.bytes[0], texts) & _checked(ids[1], self.bytes[1], texts)
        joined = np.repeat(sound, np.diff(at)).tolist()
        ends = np.cumsum([len(r) for r, j in zip(raw, joined) if j], dtype=np.int64)
        alone = [p for p, j in zip(new, joined) if not j]
        texts = [p[1:] for p in alone]
        apart = self._encode_whole(texts)
        lists = []
        for x, y, lengths in zip(ids, apart, self.lengths):
            flat = pc.list_flatten(x.filter(pa.array(sound)))
            cuts = np.searchsorted(np.cumsum(lengths.take(flat).to_numpy()), ends) + 1
            lists.append(pa.concat_arrays([pa.ListArray.from_arrays(pa.array(np.append(0, cuts).astype(np.int32)), flat), y]))
        back = _checked(apart[0], self.bytes[0], texts) & _checked(apart[1], self.bytes[1], texts)
        return [p for p, j in zip(new, joined) if j] + alone, lists, np.concatenate([np.ones(len(ends), bool), back])

    def _slots(self, pieces: list[str]) -> np.ndarray:
        """The slots of distinct pieces; those not kept are encoded."""
        new = [p for p in pieces if p not in self.slot]
        if new:
            new, ids, sound = self._encode_pieces(new)
            self.slot.update(zip(new, range(len(self.slot), len(self.slot) + len(new))))
            self.ids = tuple(pa.concat_arrays([x, y]) for x, y in zip(self.ids, ids))
            self.sound = np.concatenate([self.sound, sound])
            self.size = np.concatenate([self.size, [len(p) for p in new]])
            self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])
        slots = np.fromiter(map(self.slot.__getitem__, pieces), np.int64, len(pieces))
        self.seen[slots] += 1
        return slots

    def _trim(self) -> None:
        if len(self.slot) <= self.kept_pieces and self.size.sum() <= self.kept_bytes:
            return
        order = np.lexsort((self.size, -self.seen))
        keep = np.zeros(len(order), bool)
        keep[order[: self.kept_pieces // 2][np.cumsum(self.size[order[: self.kept_pieces // 2]]) <= self.kept_bytes // 2]] = True
        names = [p for p, k in zip(self.slot, keep.tolist()) if k]
        self.slot = dict(zip(names, range(len(names))))
        self.ids = tuple(x.filter(pa.array(keep)) for x in self.ids)
        self.sound, self.size, self.seen = self.sound[keep], self.size[keep], self.seen[keep] // 2

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids of space and text, one list per text; a text without characters has none."""
        full = [t for t in texts if t]
        pieces, first = cut_pieces(full if self.cuts else [])
        coded = pieces.dictionary_encode()
        slots = self._slots(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        # A piece whose bytes do not come back may hold a character that B takes for a space: its text is encoded whole.
        unsound = np.concatenate([[0], np.cumsum(~self.sound[slots])])[first]
        whole = np.diff(unsound) > 0 if self.cuts else np.ones(len(full), bool)
        rest = self._encode_whole([t for t, w in zip(full, whole.tolist()) if w])
        # Texts of pieces, then those encoded whole, then an empty list for texts without characters.
        n = len(full) if self.cuts else 0
        of_full = np.arange(len(full))
        of_full[whole] = n + np.arange(int(whole.sum()))
        at = np.full(len(texts), n + len(rest[0]))
        at[[i for i, t in enumerate(texts) if t]] = of_full
        out = []
        for kept, other in zip(self.ids, rest):
            lists = kept.take(pa.array(slots))
            joined = pa.ListArray.from_arrays(lists.offsets.take(pa.array(first)), lists.values) if n else other[:0]
            out.append(pa.concat_arrays([joined, other, _id_lists([[]])]).take(pa.array(at)))
        self._trim()
        return tuple(out)


def _checked(ids: pa.ListArray, table: pa.Array, texts: list[str]) -> np.ndarray:
    """Whether a document's token bytes, put together, are space and text."""
    flat = pc.take(table, pc.list_flatten(ids))
    # The bytes of all tokens lie end to end in one buffer.
    starts = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
    at = starts[ids.offsets.to_numpy()]
    raw = memoryview(flat.buffers()[2] or b"").cast("B")
    return np.array([bool(t) and raw[s:e] == b" " + t.encode() for t, s, e in zip(texts, at[:-1].tolist(), at[1:].tolist())], bool)


def _ends(ids: pa.ListArray, lengths: pa.Array) -> pa.Table:
    """doc, end, at, id of every token: a running sum of lengths that starts anew with each document."""
    flat, doc = pc.list_flatten(ids), pc.list_parent_indices(ids)
    size = pc.take(lengths, flat)
    upto = pc.cumulative_sum(size)
    first = pc.take(ids.offsets, doc)
    base = pc.subtract(pc.take(upto, first), pc.take(size, first))
    return pa.table({"doc": doc.cast(pa.int64()), "end": pc.subtract(upto, base), "at": pa.array(np.arange(len(flat))), "id": flat.cast(pa.int64())})


def _grouped_text(ids: pa.Array, names: pa.Array, cuts: np.ndarray) -> pa.Array:
    """Decimal ids with commas, one text per group; ``cuts`` are the groups' ends in ``ids``."""
    offsets = pa.array(np.concatenate([[0], cuts]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, pc.take(names, ids)), ",")


def aligned(texts: list[str], tok: Tokenizers) -> dict[str, pa.Array]:
    """Per text: n_a, n_b, n_groups, n_links, groups_sha256, and its distinct linked pairs pa, pb with their counts pn."""
    a, b = tok.encode(texts)
    sound = pa.array(_checked(a, tok.bytes[0], texts) & _checked(b, tok.bytes[1], texts))
    lost = pa.scalar(None, a.type)
    a, b = (pc.if_else(sound, x, lost) for x in (a, b))
    docs = len(texts)
    a, b = (pa.ListArray.from_arrays(_offsets(x), pc.list_flatten(x)) for x in (a, b))
    left, right = _ends(a, tok.lengths[0]), _ends(b, tok.lengths[1])
    links = left.join(right, ["doc", "end"], join_type="inner", right_suffix="_b", use_threads=False).sort_by([("doc", "ascending"), ("end", "ascending")])
    doc = links["doc"].to_numpy()
    n_links = np.bincount(doc, minlength=docs)
    # The last tokens of a document end together, so groups never cross documents. A token always has bytes: an end is one token of A, one of B, one group.
    text_a = _grouped_text(pc.list_flatten(a), tok.names, links["at"].to_numpy() + 1)
    text_b = _grouped_text(pc.list_flatten(b), tok.names, links["at_b"].to_numpy() + 1)
    groups = pc.binary_join_element_wise(text_a, text_b, "|")
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_links)]).astype(np.int32)), groups), ";")
    digest = [hashlib.sha256(w.as_buffer()).hexdigest() if n else "" for w, n in zip(whole, n_links.tolist())]
    pairs = links.select(["doc", "id", "id_b"]).group_by(["doc", "id", "id_b"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc")
    cut = pa.array(np.searchsorted(pairs["doc"].to_numpy(), np.arange(docs + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(cut, pairs[c].combine_chunks().cast(pa.int32())) for c in ("id", "id_b", "count_all")]
    sizes = [pc.list_value_length(x).cast(pa.int64()) for x in (a, b)]
    n = pa.array(n_links.astype(np.int64))
    return dict(zip(("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pa", "pb", "pn"), [*sizes, n, n, pa.array(digest, pa.string()), *lists]))


def _offsets(x: pa.ListArray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False))]).astype(np.int32))


def tokenised(docs: DataFrame, a_path: str, b_path: str, *, key: str, text: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = worker_memo(("alignment", a_path, b_path), lambda: Tokenizers(a_path, b_path))
        tok.forget()
        for b in batches:
            _, off = text_buffer(b.column(2))
            for lo, hi in row_pieces(off, PIECE):
                got = aligned([t or "" for t in b.column(2).slice(lo, hi - lo).to_pylist()], tok)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), *got.values()], ["nid", "key", *got])

    rows = docs.select(F.monotonically_increasing_id().alias("nid"), F.col(key).alias("key"), F.col(text).alias("text"))
    lists = ", ".join(f"{c} array<int>" for c in ("pa", "pb", "pn"))
    return rows.mapInArrow(run, f"nid long, key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, {lists}")


def _flat_pairs(b: pa.RecordBatch) -> pa.Table:
    """row, pair and n of every pair of a batch's lists."""
    a = b.column("pa")
    both = pc.bit_wise_or(pc.shift_left(pc.list_flatten(a).cast(pa.int64()), 32), pc.list_flatten(b.column("pb")).cast(pa.int64()))
    return pa.table({"row": pc.list_parent_indices(a).cast(pa.int64()), "pair": both, "n": pc.list_flatten(b.column("pn")).cast(pa.int64())})


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): links of every id pair (A in the upper, B in the lower 32 bits) in the whole corpus, and whether no pair of its B id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, bound = None, _COMPACT
        for b in batches:
            part = _flat_pairs(b).select(["pair", "n"])
            kept = part if kept is None else pa.concat_tables([kept, part])
            if kept.num_rows > bound:
                kept = _summed(kept)
                # Double the bound when little was saved.
                bound = max(bound, 2 * kept.num_rows)
        if kept is not None:
            yield from _summed(kept).to_batches(1 << 16)

    counts = rows.select("pa", "pb", "pn").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialize(counts.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))), "align-counts")
    highest = materialize(counts.groupBy("b").agg(F.max("n").alias("top")), "align-highest")
    return materialize(counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "align-pairs")


def _summed(t: pa.Table) -> pa.Table:
    out = t.group_by("pair", use_threads=False).aggregate([("n", "sum")])
    return pa.table({"pair": out["pair"].combine_chunks(), "n": out["n_sum"].combine_chunks()})


def align(docs: DataFrame, a_path: str, b_path: str, *, key: str = "doc_id", text: str = "text", looked_up: float = LOOKED_UP) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    rows = materialize(tokenised(docs, a_path, b_path, key=key, text=text), "align-rows")
    counts = pair_counts(rows)
    links = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # 1 / looked_up rows at most.
    often = counts.filter(F.col("n") >= F.lit(links * looked_up)).toPandas().sort_values("pair")
    shared = docs.sparkSession.sparkContext.broadcast((often["pair"].to_numpy(np.int64), often["n"].to_numpy(np.int64), often["best"].to_numpy(bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, totals, best = shared.value
        for b in batches:
            t = _flat_pairs(b)
            row, pair, n = (t[c].to_numpy() for c in ("row", "pair", "n"))
            at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            known = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            n_best, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            np.add.at(n_best, row[known], n[known] * best[at[known]])
            np.add.at(total, row[known], n[known] * totals[at[known]])
            rest = ~known
            off = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[rest], minlength=b.num_rows))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(off, pa.array(x[rest])) for x in (pair, n)]
            kept = [b.column(c) for c in _KEPT]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_best), pa.array(total), *lists], [*_KEPT, "n_best", "count_sum", "pairs", "ns"])

    _KEPT = ["nid", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kind = docs.schema[key].dataType.simpleString()
    schema = f"nid long, key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs array<long>, ns array<long>"
    met = materialize(rows.mapInArrow(run, schema), "align-met")
    rest = met.select("nid", F.explode(F.arrays_zip("pairs", "ns")).alias("p")).select("nid", F.col("p.pairs").alias("pair"), F.col("p.ns").alias("k"))
    rest = rest.join(counts.filter(F.col("n") < F.lit(links * looked_up)), "pair")
    rest = rest.groupBy("nid").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("more_best"), F.sum(F.col("k") * F.col("n")).alias("more_sum"))
    out = met.drop("pairs", "ns").join(rest, "nid", "left")
    return out.select(
        F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )

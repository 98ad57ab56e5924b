"""Byte-level BPE encoding by prefix dynamic programming, and decoding.

For every byte prefix of a piece there is one last token with which a valid encoding of that prefix can end; storing it
per prefix gives the encoding of every prefix at once, so bytes can be appended exactly and an edit re-encodes only up to
where the stored tokens agree again. Two neighbouring tokens are valid when merging their joined bytes by rank gives the two
tokens back; an encoding is the ranked one exactly when all its neighbours are valid.

Null and empty texts give no ids. Repeated rows, very long texts and other columns need no care: a row is one text, other
columns are passed by. An empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cuelattice.llm.arrays import worker_memo

# The characters with the White_Space property, which end a word of the public patterns.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# A blank and the word after it, else a run of white space: no match of the public patterns crosses these.
CHUNK = f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
# The letters up to U+00FF.
LATIN = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
MEMO_ENTRIES = 400_000
PAIR_ENTRIES = 300_000
ROWS_AT_ONCE = 256  # rows whose ids are held before they are handed on


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PrefixBpe:
    """Encoder over a rank table. ``ranks`` maps bytes to ids; a lower id merges earlier."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.known_pairs: dict[tuple[int, int], bool] = {}
        for b, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(b) == 1:
                self.parts[i] = None
                continue
            for k in range(1, len(b)):
                left, right = ranks.get(b[:k]), ranks.get(b[k:])
                if left is not None and right is not None and left < i and right < i and left in self.parts and right in self.parts and self.neighbours(left, right):
                    self.parts[i] = (left, right)
                    self.merged[left, right] = i
                    break
        # A token that its own bytes do not merge to can only be met as a whole piece.
        self.tokens = {b: i for b, i in ranks.items() if i in self.parts}
        self.known_pairs.clear()

    def neighbours(self, a: int, b: int) -> bool:
        """True if no merge crosses the border between ``a`` and ``b`` while their bytes are merged by rank.

        Goes back in time: the later formed of the two tokens at the border is taken apart until both are bytes; a pair
        at the border that has a merge of a lower rank than the merges that end it would have been merged. Of equal
        ranks the left one comes first.
        """
        known = self.known_pairs.get((a, b))
        if known is not None:
            return known
        x, y, ends_x, ends_y, good = a, b, 1 << 60, 1 << 60, True
        while True:
            across = self.merged.get((x, y))
            if across is not None and across < ends_x and across <= ends_y:
                good = False
                break
            px, py = self.parts[x], self.parts[y]
            if px is None and py is None:
                break
            if py is None or (px is not None and x > y):
                ends_x, x = x, px[1]
            else:
                ends_y, y = y, py[0]
        if len(self.known_pairs) >= PAIR_ENTRIES:
            self.known_pairs.clear()
        self.known_pairs[a, b] = good
        return good

    def extend(self, piece: bytes, last: list[int], start: int, stop_at: list[int] | None = None, shift: int = 0) -> int:
        """Fill ``last[j]`` (the last token of the prefix of j bytes) for prefixes ending after ``start``.

        With ``stop_at`` (the stored tokens of an older text whose bytes from some place on are the same, ``shift`` bytes
        on) filling ends where a full window of stored tokens agrees; returns the prefix up to which it filled.
        """
        token_of, longest, n = self.tokens.get, self.longest, len(piece)
        pair_of, agreed = self.known_pairs.get, 0
        for j in range(start + 1, n + 1):
            found = -1
            for i in range(max(0, j - longest), j):
                t = token_of(piece[i:j])
                if t is not None:
                    good = i == 0 or pair_of((last[i], t))
                    if good or good is None and self.neighbours(last[i], t):
                        found = t
                        break
            if found < 0:
                raise ValueError("the ranks lack a single byte")
            last[j] = found
            if stop_at is not None:
                k = j - shift
                agreed = agreed + 1 if 0 < k < len(stop_at) and stop_at[k] == found else 0
                if agreed >= longest:
                    return j
        return n

    def walk(self, piece_len: int, last: list[int]) -> list[int]:
        ids, j = [], piece_len
        while j:
            t = last[j]
            ids.append(t)
            j -= len(self.bytes_of[t])
        ids.reverse()
        return ids

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        last = [-1] * (len(piece) + 1)
        self.extend(piece, last, 0)
        return self.walk(len(piece), last)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class EditablePiece:
    """A piece with its prefix table: exact appends, and edits that re-encode only near the change."""

    def __init__(self, bpe: PrefixBpe, piece: bytes = b""):
        self.bpe, self.piece, self.last, self.filled = bpe, b"", [-1], 0
        self.append(piece)

    def append(self, more: bytes) -> None:
        start = len(self.piece)
        self.piece += more
        self.last += [-1] * len(more)
        self.filled = self.bpe.extend(self.piece, self.last, start) - start

    def replace(self, lo: int, hi: int, new: bytes) -> None:
        """Bytes ``lo`` to ``hi`` become ``new``; ``filled`` then holds how many prefixes were computed again."""
        old, shift = self.last, len(new) - (hi - lo)
        tail_from = lo + len(new)
        self.piece = self.piece[:lo] + new + self.piece[hi:]
        self.last = old[: lo + 1] + [-1] * len(new) + old[hi + 1 :]
        stored = [-1] * (hi + 1) + old[hi + 1 :]
        reached = self.bpe.extend(self.piece, self.last, lo, stored, shift)
        self.filled = max(reached, tail_from) - lo

    def ids(self) -> list[int]:
        return self.bpe.encode_piece(self.piece) if self.piece in self.bpe.ranks else self.bpe.walk(len(self.piece), self.last)


class TextEncoder:
    """Splits texts by the pattern and encodes each match; encodings of frequent chunks are kept, up to a bound."""

    def __init__(self, ranks_path: str, pattern: str):
        import re

        import regex

        self.bpe = PrefixBpe(read_ranks(ranks_path))
        self.chunks = re.compile(CHUNK).findall
        # Where all letters are known a word's leading letters are a match of their own.
        self.latin = re.compile(f" ?[{LATIN}]+|{CHUNK}").findall
        self.beyond_latin = re.compile("[^\x00-\xff]").search
        self.matches = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}

    def chunk(self, s: str) -> bytes:
        ids: list[int] = []
        for m in self.matches(s):
            ids += self.bpe.encode_piece(m.encode("utf-8"))
        out = np.array(ids, dtype="<u4").tobytes()
        # A full memo stays as it is: what came early is mostly what comes often.
        if len(s) <= 40 and len(self.memo) < MEMO_ENTRIES:
            self.memo[s] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = (self.chunks if self.beyond_latin(text) else self.latin)(text)
        got = list(map(self.memo.get, parts))
        return b"".join([self.chunk(s) if g is None else g for s, g in zip(parts, got)]) if None in got else b"".join(got)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every text and decode its ids: ``key``, n_tokens, ids_sha256, decoded_sha256, same_bytes, and the ids if asked.

    The rank file must lie at ``ranks_path`` on every executor. A pattern whose matches cross a blank-led word is
    not supported (the public patterns never do).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_memo(("prefix bpe", ranks_path, pattern), lambda: TextEncoder(ranks_path, pattern))
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS_AT_ONCE):
                yield encoded(enc, whole.slice(lo, ROWS_AT_ONCE))

    def encoded(enc: TextEncoder, b: pa.RecordBatch) -> pa.RecordBatch:
        n, digest, back, same, ids = [], [], [], [], []
        for t in b.column(1):
            t = t.as_py() or ""
            raw = enc.encode(t)
            tokens = np.frombuffer(raw, dtype="<u4")
            plain = enc.bpe.decode(tokens.tolist())
            n.append(len(tokens))
            digest.append(hashlib.sha256(raw).hexdigest())
            back.append(hashlib.sha256(plain).hexdigest())
            same.append(plain == t.encode("utf-8"))
            if with_ids:
                ids.append(tokens.astype(np.int32))
        cols = [b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string()), pa.array(same, pa.bool_())]
        names = ["key", "n_tokens", "ids_sha256", "decoded_sha256", "same_bytes"]
        if with_ids:
            cols.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names)

    kind = docs.select(F.col(key).alias("key")).schema[0].dataType.simpleString()
    schema = f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, same_bytes boolean" + ", ids array<int>" * with_ids
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)

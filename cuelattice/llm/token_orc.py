"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are range-partitioned and sorted by id; every task writes one shard. A row holds the id, the number of tokens, the
place within the shard and the ids as an integer list, which ORC stores run-length encoded in stripes that Spark reads in
parallel. Stripe statistics, row indexes and Bloom filters skip stripes and row groups for a filter on the id. A small index
table beside the data has one row per shard; it turns places within a shard into places within the corpus.

Words between white space, cut after their leading letters, are encoded by the tokenizer once per worker while they are
frequent: the tokenizer drops white space and splits at both places itself, so a text's ids are its pieces' ids in a row. A piece
of lower-case letters alone is already what the tokenizer's normaliser and splitter would make of it, so its bytes go to the
tokenizer's model at once.

Defined cases: null and empty texts hold the end id alone; null ids come first; repeated rows follow each other; an empty table
gives an empty data folder that still reads; other columns are not written.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cuelattice.llm.arrays import row_pieces, text_buffer, worker_memo
from cuelattice.session import scratch_dir

SCHEMA = "doc_id long, n_tokens long, place long, shard int, ids array<int>"
WRITER = {
    "compression": "zstd", "orc.stripe.size": str(16 << 20), "orc.create.index": "true", "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
}
MEMO_ENTRIES = 400_000
TEXT_BYTES = 2 << 20  # of the texts whose pieces are looked up together
# The lower-case letters up to U+00FF.
LATIN_LOWER = "a-zªµºß-öø-ÿ"


def shown_bytes() -> dict[int, str]:
    """The character by which byte-level models write each byte: itself where it prints, else the next one from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of texts; encodings of words are kept up to a bound."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words = re.compile(r"[^\t-\r ]+").findall
        self.beyond_latin = re.compile("[^\x00-\xff]").search
        self.latin = re.compile(f"[{LATIN_LOWER}]+|[^\t-\r ]+").findall
        self.letters = re.compile(f"[{LATIN_LOWER}]+").fullmatch
        self.shown = shown_bytes()
        self.memo: dict[str, bytes] = {}

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        plain = [p for p in pieces if self.letters(p)]
        tokenize = self.tokenizer.model.tokenize
        bare = (p if p.isascii() else p.encode().decode("latin-1").translate(self.shown) for p in plain)
        codes = {p: array("I", [t.id for t in tokenize(b)]).tobytes() for p, b in zip(plain, bare)}
        other = [p for p in pieces if p not in codes]
        if other:
            encoded = self.tokenizer.encode_batch_fast(other, add_special_tokens=False)
            codes.update((p, array("I", e.ids).tobytes()) for p, e in zip(other, encoded))
        return codes

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, the end id last."""
        end = array("I", [end_id]).tobytes()
        # Latin-1 texts are composed already and lower-case letter by letter; a leading run of letters is a piece of its own.
        parts = [self.words(t) if self.beyond_latin(t) else self.latin(t.lower()) for t in texts]
        got = [list(map(self.memo.get, p)) for p in parts]
        fresh = list(dict.fromkeys(p for ps, gs in zip(parts, got) if None in gs for p, g in zip(ps, gs) if g is None))
        new = self.encode_pieces(fresh)
        # A full memo stays as it is: what came early is mostly what comes often.
        if len(self.memo) < MEMO_ENTRIES:
            self.memo.update((p, c) for p, c in new.items() if len(p) <= 40)
        return [b"".join([new[p] if g is None else g for p, g in zip(ps, gs)] if None in gs else gs) + end for ps, gs in zip(parts, got)]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Write ``path``/data and ``path``/index. The tokenizer file must lie at ``tokenizer_path`` on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_memo(("word ids", tokenizer_path), lambda: WordEncoder(tokenizer_path))
        place, shard = 0, TaskContext.get().partitionId()
        for b in batches:
            for lo, hi in row_pieces(text_buffer(b.column(1))[1], TEXT_BYTES):
                part = b.slice(lo, hi - lo)
                raw = enc.encode([t or "" for t in part.column(1).to_pylist()], end_id)
                n = np.array([len(r) // 4 for r in raw], np.int64)
                ends = np.concatenate([[0], np.cumsum(n)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.array(ends[:-1] + place), pa.array(np.full(len(n), shard, np.int32)), ids], ["doc_id", "n_tokens", "place", "shard", "ids"]
                )
                place += int(ends[-1])

    spark = docs.sparkSession
    order = [F.col("doc_id").asc_nulls_first(), F.col("th")]
    ranged = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("th", F.xxhash64("text"))
    ranged = ranged.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ranged.mapInArrow(run, SCHEMA).write.options(**WRITER).orc(f"{path}/data")
    shards = spark.read.schema(SCHEMA).orc(f"{path}/data").groupBy("shard").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    # One row per shard; range partitions are numbered in id order.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))).write.orc(f"{path}/index")


def read_tokens(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens, ids. With ``ids`` only stripes that may hold them are read."""
    data = spark.read.schema(SCHEMA).orc(f"{path}/data")
    if ids is not None:
        data = data.filter(F.col("doc_id").isin(ids))
    index = spark.read.schema("shard int, base long").orc(f"{path}/index")
    return data.join(index, "shard").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(3)
            flat = np.ascontiguousarray(col.values.to_numpy(zero_copy_only=False), dtype="<u4")
            ends = col.offsets.to_numpy()
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_path(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"

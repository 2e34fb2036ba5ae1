"""Sequence packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two: as many of `max_length` as fit, then one piece
for each set bit of the rest, longest first. Pieces of one length form a bucket, every sequence is exactly one piece,
so no sequence crosses documents and none needs padding. The work is one pass over the texts, without a shuffle.

Tokenising caches the ids of text between spaces (a byte-level BPE never joins across a space that follows a
non-space), at most `CACHE` short entries, dropped when a task ends; what is not cached goes to the tokenizer. Long
texts are handled span by span, so memory follows the batch's text, not its tokens.

Defined cases: null text counts as empty and gives the end id alone; repeated rows are packed each on their own with
sequence ids of their own; an empty table gives no pieces; only the `keep` columns of the input are carried over.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.words import carried, free

CACHE = 400_000
LONGEST_CACHED = 48
#: The special token of the byte-level vocabulary; it has an id of its own in running text.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, equal to those of the `tokenizers` file of the same vocabulary."""

    def __init__(self, vocabulary: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.raw = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = np.array([SPECIAL_ID], "<u4").tobytes()
        self.cache: dict[str, bytes] = {}

    def _new(self, part: str) -> bytes:
        ids = np.array(self.raw.encode_ordinary(part), "<u4").tobytes()
        if len(part) <= LONGEST_CACHED:
            if len(self.cache) >= CACHE:  # drop the older half
                self.cache = dict(islice(self.cache.items(), CACHE // 2, None))
            self.cache[part] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        # A cut before a space is exact if what precedes it is not white space; else the parts stay together.
        first, *rest = text.split(" ")
        if not rest:
            return self._new(text) if text else b""
        parts, whole = [first], True
        for p in rest:
            if not p or p[-1:].isspace():
                whole = False
                break
        if whole and first and not first[-1].isspace():
            parts += [" " + p for p in rest]
        else:
            parts = [first]
            for p in rest:
                if not parts[-1] or parts[-1][-1].isspace():
                    parts[-1] += " " + p
                else:
                    parts.append(" " + p)
        get = self.cache.get
        return b"".join([get(p) or self._new(p) for p in parts])

    def encode(self, text: str) -> bytes:
        if SPECIAL not in text:
            return self._plain(text)
        return self.special.join(self._plain(x) for x in text.split(SPECIAL))


def piece_lengths(n: int, longest: int) -> list[int]:
    """`longest` as often as it fits, then the binary digits of the rest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1]


_encoders: dict[str, Encoder] = {}


def _encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def pack(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), max_length: int = 2048, end_id: int = 1, vocabulary: str = "byte_bpe_50k", ids: bool = True
) -> DataFrame:
    """One row per piece: start in its document, length (its bucket), the document's tokens, the ids and their CRC-32.

    `sequence_id` numbers the sequences; every piece is a sequence, so `offset` is 0. `max_length` is a power of two.
    """
    if max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    keep = carried(keep, ("start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset"))
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(free("_text", keep)))
    end = np.array([end_id], "<u4").tobytes()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        try:
            for batch in batches:
                yield from packed(encoder, batch)
        finally:
            encoder.cache.clear()

    def packed(encoder: Encoder, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, start, length, crc, total, own = [], [], [], [], [], []
        size = 0
        for i, t in enumerate(batch.columns[-1]):
            raw = encoder.encode(t.as_py()) + end
            n, at = len(raw) // 4, 0
            for k in piece_lengths(n, max_length):
                piece = raw[4 * at : 4 * (at + k)]
                row.append(i)
                start.append(at)
                length.append(k)
                crc.append(zlib.crc32(piece))
                total.append(n)
                if ids:
                    own.append(piece)
                at += k
            size += len(raw)
            if ids and size > 16 << 20:
                yield out(batch, row, start, length, crc, total, own)
                row, start, length, crc, total, own, size = [], [], [], [], [], [], 0
        yield out(batch, row, start, length, crc, total, own)

    def out(batch, row, start, length, crc, total, own) -> pa.RecordBatch:
        kept = batch.select(list(keep)).take(pa.array(row, pa.int64()))
        arrays = [*kept.columns, *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
        names = [*keep, "start", "length", "ids_crc32", "doc_tokens"]
        if ids:
            flat = np.frombuffer(b"".join(own), "<u4").astype(np.int32)
            ends = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names)

    schema = docs.select(*keep).schema
    for name in ("start", "length", "ids_crc32", "doc_tokens"):
        schema = schema.add(name, "long")
    if ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    pieces = rows.mapInArrow(each, schema)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences of equal length in one folder each, so that a batch is read from one bucket."""
    pieces.write.partitionBy("length").parquet(path)


def bucket_report(pieces: DataFrame) -> DataFrame:
    """Sequences and tokens of every bucket (at most log2(max_length) + 1 rows)."""
    return pieces.groupBy("length").agg(F.count("*").alias("sequences"), F.sum("length").alias("tokens"))

"""Words of raw texts as hashes, for the operators that count or compare them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names that operators give to a whole input row, its text and its id while they work on it.
ROW, TEXT, ID = "_row", "text", "doc_id"


def boxed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Whole rows as one column beside their text and id, so that no name of the input meets a helper's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW), F.col(text).alias(TEXT), F.col(doc_id).alias(ID))


def unboxed(rows: DataFrame) -> DataFrame:
    return rows.select(f"{ROW}.*")


def carried(keep: tuple[str, ...], own: tuple[str, ...]) -> tuple[str, ...]:
    """Columns to keep without those that have the name of a result, which stands in their place."""
    return tuple(c for c in keep if c not in own)


def free(name: str, taken) -> str:
    """A helper's name that is not among the taken ones."""
    while name in taken:
        name = f"_{name}"
    return name


LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Texts are handled in runs of about this many bytes, so that memory follows the run and not the batch.
RUN_BYTES = 4 << 20


def runs(column: pa.Array, most: int = RUN_BYTES):
    """(first row, list of texts as bytes, null for null) of runs of rows that hold about `most` bytes together."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = column.cast(pa.binary())
    at, size, out = 0, 0, []
    for i, x in enumerate(raw):
        b = x.as_py()
        out.append(b)
        size += len(b or b"")
        if size >= most:
            yield at, out
            at, size, out = i + 1, 0, []
    if out:
        yield at, out


def by_part(hashes: np.ndarray, bits: int):
    """(part, rows) for each hash range, by one sort."""
    part = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange((1 << bits) + 1))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        yield p, order[cuts[p] : cuts[p + 1]]


SMALLER, LARGER = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays end to end, compressed."""
    return SMALLER.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(blob) -> bytes:
    return LARGER.decompress(blob.as_buffer() if isinstance(blob, pa.Scalar) else bytes(blob))


def sorted_planes(h: np.ndarray) -> np.ndarray:
    """Steps between sorted 64-bit hashes, byte plane by byte plane: the high planes are mostly zeros."""
    return np.diff(h, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T


def unsorted_planes(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def word_hashes(texts: list[bytes | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, text after text, and the number of words of each text.

    bytes.split() cuts at exactly the six ASCII white space characters 0x20 and 0x09-0x0D.
    """
    known: dict[bytes, int] = {}
    ids: list[int] = []
    n = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            words = (t.translate(LOWER) if lower else t).split()
            n[i] = len(words)
            ids += [known.setdefault(w, len(known)) for w in words]
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))
    return hashes[np.array(ids, np.int64)] if ids else np.zeros(0, np.uint64), n


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (finaliser with fixed odd constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several in order."""
    out = mix(parts[0] + np.uint64(len(parts)))
    for p in parts[1:]:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + p)
    return out

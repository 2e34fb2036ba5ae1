"""SentencePiece encoding and decoding in numpy batches.

Texts are cut into units (spaces and the word after them; no piece of the vocabulary spans more), distinct units are
grouped by length, and units of equal length advance together. The hash of every substring comes from prefix hashes
and is looked up in the sorted keys of the pieces, once per batch. On that table of candidates

* `viterbi` finds the segmentation with the greatest sum of scores: for each end position the maximum over piece
  lengths is taken for all units at once and its start is stored as back-pointer. Positions advance in blocks that carry
  the scores of the last few, so that a text without spaces needs no table of its own size. This is the operator's own
  segmentation, and right for unigram models.
* `merges` joins the best-scoring adjacent pair of every unit, round by round, as a byte-pair model of the library
  does. A sum of scores cannot give a byte-pair model's ids, and the public model at hand is one.

Characters without a piece become byte pieces. Decoding is exact but for the sign that stands for a space in pieces
(U+2581), which comes back as a space. Defined cases: null text gives null ids; empty text gives none; units longer
than LONGEST characters are merged by the library itself, whose ids are the same; an empty table gives no rows; rows
that repeat are encoded each; only the `keep` columns are carried over.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.words import carried, free, mix

SPACE = "▁"
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
FACTOR = np.uint64(0x9E3779B97F4A7C15)
SEEN = np.uint64((1 << 21) - 1)
LONGEST = 256
CACHE = 300_000  # units of at most CACHED characters, dropped when a task ends
CACHED = 64
TABLE = 1 << 17  # characters whose candidates are held at once
STEP = 4096  # positions at a time of a unit longer than that
UNKNOWN_PENALTY = 10.0


class Pieces:
    """Sorted keys, ids and scores of a model's pieces, and the bytes of each id."""

    def __init__(self, model: str = "piece_bpe_32k.model"):
        import public_tokenizers
        import sentencepiece

        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        size = sp.get_piece_size()
        kinds = [0 if sp.is_byte(i) else 1 if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else 2 for i in range(size)]
        text = [sp.id_to_piece(i) for i in range(size)]
        self.byte_id = np.zeros(256, np.int32)
        self.raw = [b""] * size
        for i, (kind, piece) in enumerate(zip(kinds, text, strict=True)):
            if kind == 0:
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif kind == 2:
                self.raw[i] = piece.replace(SPACE, " ").encode()
        plain = np.array([i for i in range(size) if kinds[i] == 2], np.int64)
        score = np.array([sp.get_score(int(i)) for i in plain])
        keys = np.array([self._key_of(text[i]) for i in plain], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids, self.scores = keys[order], plain[order].astype(np.int32), score[order]
        self.seen = np.zeros(int(SEEN) + 1, bool)
        self.seen[(self.keys & SEEN).astype(np.int64)] = True
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one key")
        self.longest = max(len(text[i]) for i in plain)
        self.unknown = float(score.min()) - UNKNOWN_PENALTY
        if any(SPACE in text[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece goes on after a space; units would have to be whole texts")

    @staticmethod
    def _key_of(piece: str) -> np.uint64:
        codes = np.array([[ord(c) for c in piece]], np.uint64)
        return substring_keys(codes, len(piece))[0, 0, len(piece) - 1]

    def candidates(self, codes: np.ndarray) -> np.ndarray:
        """Index of the piece at (unit, start, length - 1) in the sorted table, or -1. Few substrings are pieces, so a
        bit of each key is looked at before the binary search."""
        return self._find(substring_keys(codes, self.longest))

    def at(self, codes: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The same for chosen substrings, none longer than a piece."""
        prefix, length = prefix_hashes(codes), end - start
        power = np.array(powers(self.longest), np.uint64)[length]
        return self._find(mix(prefix[row, end] - prefix[row, start] * power + length.astype(np.uint64)))

    def _find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(keys.shape, -1, np.int32)
        maybe = np.nonzero(self.seen[(keys & SEEN).astype(np.int32)])
        probe = keys[maybe]
        place = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
        out[maybe] = np.where(self.keys[place] == probe, place, -1)
        return out


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    n, size = codes.shape
    prefix = np.zeros((n, size + 1), np.uint64)
    for k in range(size):
        prefix[:, k + 1] = prefix[:, k] * FACTOR + codes[:, k].astype(np.uint64) + np.uint64(1)
    return prefix


def powers(longest: int) -> list[np.uint64]:
    """FACTOR to the powers 0 to `longest`, modulo 2**64."""
    out = [1]
    for _ in range(longest):
        out.append(out[-1] * int(FACTOR) % 2**64)
    return [np.uint64(x) for x in out]


def substring_keys(codes: np.ndarray, longest: int) -> np.ndarray:
    """Keys of all substrings, from prefix hashes; those that run over the end are 0."""
    n, size = codes.shape
    prefix = prefix_hashes(codes)
    out = np.zeros((n, size, min(longest, size)), np.uint64)
    for length, power in enumerate(powers(out.shape[2])[1:], 1):
        out[:, : size - length + 1, length - 1] = mix(prefix[:, length:] - prefix[:, : size - length + 1] * power + np.uint64(length))
    return out


Spans = tuple[np.ndarray, np.ndarray, np.ndarray]  # unit, start, end of every piece, in order


def viterbi(codes: np.ndarray, pieces: Pieces, whole: np.ndarray | None = None) -> Spans:
    """Pieces of the best segmentation of every unit; of equal ones that with the longest last piece. `whole` are the
    candidates of all positions; without it they are looked up STEP positions at a time."""
    n, size = codes.shape
    longest = min(pieces.longest, size)
    step = STEP if whole is None else size
    best = np.full((n, size + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((n, size + 1), np.int32)
    row = np.arange(n)
    for first in range(0, size, step):
        # Scores of the pieces that end in this block: they start in it or up to `longest` before it.
        low, high = max(0, first - longest + 1), min(size, first + step)
        found = pieces.candidates(codes[:, low:high]) if whole is None else whole
        value = np.where(found >= 0, pieces.scores[found], -np.inf)
        value[:, :, 0] = np.where(found[:, :, 0] >= 0, value[:, :, 0], pieces.unknown)
        for end in range(first + 1, high + 1):
            starts = np.arange(max(0, end - value.shape[2]), end)
            sums = best[:, starts] + value[:, starts - low, end - 1 - starts]
            pick = sums.argmax(1)
            best[:, end] = sums[row, pick]
            back[:, end] = starts[pick]
    spans, end = [], np.full(n, size)
    while len(row):
        start = back[row, end]
        spans.append((row, start, end))
        row, end = row[start > 0], start[start > 0]
    return _in_order(spans)


def _in_order(spans: list) -> Spans:
    row, start, end = (np.concatenate(x) for x in zip(*spans, strict=True))
    order = np.lexsort((start, row))
    return row[order], start[order], end[order]


def merges(found: np.ndarray, scores: np.ndarray) -> Spans:
    """Pieces after merging the best adjacent pair, leftmost of equals, until none is a piece."""
    n, size, longest = found.shape
    cuts = np.tile(np.arange(size + 1), (n, 1))
    row, spans = np.arange(n), []

    def finish(which: np.ndarray) -> None:
        k = cuts.shape[1] - 1
        spans.append((np.repeat(row[which], k), cuts[which, :-1].ravel(), cuts[which, 1:].ravel()))

    while len(row):
        if cuts.shape[1] < 3:
            finish(np.ones(len(row), bool))
            break
        start, length = cuts[:, :-2], cuts[:, 2:] - cuts[:, :-2]
        piece = np.where(length <= longest, found[row[:, None], start, np.minimum(length, longest) - 1], -1)
        value = np.where(piece >= 0, scores[piece], -np.inf)
        pick = value.argmax(1)
        going = value[np.arange(len(row)), pick] > -np.inf
        finish(~going)
        row, cuts, pick = row[going], cuts[going], pick[going]
        keep = np.ones(cuts.shape, bool)
        keep[np.arange(len(row)), pick + 1] = False
        cuts = cuts[keep].reshape(len(row), cuts.shape[1] - 1)
    return _in_order(spans)


class Encoder:
    """Ids of texts under one model, with distinct units cached."""

    def __init__(self, model: str, ways: tuple[str, ...]):
        self.pieces, self.ways = Pieces(model), ways
        self.cache: dict[str, tuple[bytes, ...]] = {}

    def _learn(self, units: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for u in units:
            by_length.setdefault(len(u), []).append(u)
        for size, same in by_length.items():
            step = max(1, TABLE // size)
            for at in range(0, len(same), step):
                self._batch(same[at : at + step], size)

    def _batch(self, units: list[str], size: int) -> None:
        p = self.pieces
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, size)
        found = p.candidates(codes) if codes.size <= TABLE else None
        ways = []
        for way in self.ways:
            if way == "viterbi":
                ways.append(self._ids(units, codes, viterbi(codes, p, found), found))
            elif size <= LONGEST:
                ways.append(self._ids(units, codes, merges(found, p.scores), found))
            else:
                ways.append([self._library(u) for u in units])
        self.cache.update(zip(units, zip(*ways, strict=True), strict=True))

    def _ids(self, units: list[str], codes: np.ndarray, spans: Spans, found: np.ndarray | None) -> list[bytes]:
        row, start, end = spans
        at = self.pieces.at(codes, row, start, end) if found is None else found[row, start, end - start - 1]
        ids = self.pieces.ids[at]
        code = codes[row, start]
        byte = (at < 0) & (code < 128)  # an ASCII character that is no piece is one byte piece
        ids[byte] = self.pieces.byte_id[code[byte]]
        raw = ids.astype("<i4").tobytes()
        ends = (4 * np.cumsum(np.bincount(row, minlength=len(units)))).tolist()
        out = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for u in np.unique(row[(at < 0) & ~byte]).tolist():  # units with other characters that are no piece
            mine = np.arange(*np.searchsorted(row, [u, u + 1]))
            several: list[int] = []
            for i in mine.tolist():
                piece = units[u][start[i] : end[i]]
                several += [int(self.pieces.ids[at[i]])] if at[i] >= 0 else self.pieces.byte_id[list(piece.encode())].tolist()
            out[u] = np.array(several, "<i4").tobytes()
        return out

    def _library(self, unit: str) -> bytes:
        """A long unit by itself: the library puts one space before a text, which a unit after a space already has."""
        if unit.startswith(SPACE):
            return np.array(self.pieces.library.encode(unit[1:].replace(SPACE, " ")), "<i4").tobytes()
        raise ValueError("units start with a space")

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, ...] | None]:
        """Ids of each text as little-endian 32-bit bytes, one per way."""
        cut = [UNIT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = {u for units in cut for u in units if u not in self.cache}
        if len(self.cache) + len(new) > CACHE:
            self.cache = dict(islice(self.cache.items(), len(self.cache) // 2, None))
            new = {u for units in cut for u in units if u not in self.cache}
        self._learn(list(new))
        out = []
        for t, units in zip(texts, cut, strict=True):
            rows = [self.cache[u] for u in units]
            out.append(None if t is None else tuple(b"".join([r[k] for r in rows]) for k in range(len(self.ways))))
        for u in new:
            if len(u) > CACHED:
                del self.cache[u]
        return out

    def __enter__(self) -> Encoder:
        return self

    def __exit__(self, *_) -> None:
        self.cache.clear()

    def decode(self, ids: bytes) -> str:
        raw = self.pieces.raw
        return b"".join([raw[i] for i in np.frombuffer(ids, "<i4").tolist()])[1:].decode(errors="replace")


_encoders: dict[tuple, Encoder] = {}


def encoder(model: str, ways: tuple[str, ...]) -> Encoder:
    if (model, ways) not in _encoders:
        _encoders[model, ways] = Encoder(model, ways)
    return _encoders[model, ways]


def _text_runs(column: pa.Array, chars: int = 1 << 20):
    at, size, out = 0, 0, []
    for i, x in enumerate(column):
        out.append(x.as_py())
        size += len(out[-1] or "")
        if size >= chars:
            yield at, out
            at, size, out = i + 1, 0, []
    if out:
        yield at, out


def encode(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), model: str = "piece_bpe_32k.model", way: str = "merges") -> DataFrame:
    """`keep` columns and the ids of every text, by `viterbi` for unigram models or by `merges` for byte-pair models."""
    keep = carried(keep, ("ids",))
    rows = docs.select(*keep, F.col(text).alias(free("_text", keep)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(model, (way,)) as enc:
            for batch in batches:
                for at, texts in _text_runs(batch.columns[-1]):
                    ids = [None if r is None else np.frombuffer(r[0], "<i4") for r in enc.encode(texts)]
                    kept = [c.slice(at, len(texts)) for c in batch.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(ids, pa.list_(pa.int32()))], [*keep, "ids"])

    return rows.mapInArrow(each, docs.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType())))


def decode(rows: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), model: str = "piece_bpe_32k.model") -> DataFrame:
    """`keep` columns and the text of every id list; null for null."""
    keep = carried(keep, ("text",))
    chosen = rows.select(*keep, F.col(ids).alias(free("_ids", keep)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model, ("merges",))
        for batch in batches:
            texts = [None if x.as_py() is None else enc.decode(np.array(x.as_py(), "<i4").tobytes()) for x in batch.columns[-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    return chosen.mapInArrow(each, rows.select(*keep).schema.add("text", "string"))


def profile(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), model: str = "piece_bpe_32k.model") -> DataFrame:
    """The segmentation of every whole text, and beside it that of a byte-pair model: number and CRC-32 of the ids, and
    whether both decode to the text."""
    names = ["n_ids", "ids_crc32", "n_merge_ids", "merge_ids_crc32", "exact"]
    keep = carried(keep, tuple(names))
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(free("_text", keep)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(model, ("viterbi", "merges")) as enc:
            for batch in batches:
                for at, texts in _text_runs(batch.columns[-1]):
                    out = []
                    for t, (a, b) in zip(texts, enc.encode(texts), strict=True):
                        back = t.replace(SPACE, " ")
                        out.append((len(a) // 4, zlib.crc32(a), len(b) // 4, zlib.crc32(b), enc.decode(a) == back and enc.decode(b) == back))
                    cols = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.bool_()], strict=True)]
                    yield pa.RecordBatch.from_arrays([*(c.slice(at, len(texts)) for c in batch.columns[:-1]), *cols], [*keep, *names])

    schema = docs.select(*keep).schema
    for name in names[:-1]:
        schema = schema.add(name, "long")
    return rows.mapInArrow(each, schema.add("exact", "boolean"))

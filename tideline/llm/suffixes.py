"""Removal of repeated passages: every byte covered by a string of `length` bytes that also starts earlier.

Difference-cover blockwise construction. In every text the positions whose residue modulo `period` lies in a perfect
difference set are the cover sample: for any two positions i and j exactly one shift d below the period (or, if they
are congruent, one at residue 0) makes i + d and j + d both sampled. So two equal strings of `length` bytes hold
sampled positions at one shift, and the suffixes there share their first length - period + 1 bytes (a gram). Only
suffixes at sampled positions are ever sorted, one bucket at a time; all others follow from their ranks.

1. Gram hashes of the sample are counted by hash range. What occurs at two residues, or twice at residue 0, goes into
   a bit filter that is broadcast while two bits a sample fit in `filter_bytes`. Beyond that every run of texts asks each
   hash range about its own samples and gets a bit for each; the result is the same.
2. Each sampled suffix that passes is sent to its bucket with the bytes that its strings span: `length` to the right,
   period - 1 to the left.
3. A bucket's suffixes are sorted by gram and content, and their left contexts likewise; the sorted order with
   neighbours' common lengths is the rank table. A string that starts p bytes before a sampled position equals another
   one iff their left contexts agree on p bytes and the sampled suffixes on length - p, which is read off the ranks
   without comparing text again. All but the earliest of equal strings are repeats. Memory follows the bucket.
4. Grams with more than `hot` occurrences are not gathered in one task. The strings around them are named by 128-bit
   digests; equal ones are reduced inside each run of texts first, the rest is counted and filtered as in 1, and a
   combining aggregation finds the earliest.

Exact copies of a whole text are found first, by 128-bit digests, so they cost a row each.

Defined cases: doc_id is an integer column (else TypeError); null text is empty; texts under `length` bytes lose
nothing; rows equal in doc_id and text count as one document and get the same result; rows that share a doc_id with
different texts are ordered by a hash of the text; null doc_ids come last; an empty table gives no rows; other columns
are not carried over by `measure` and all are kept by `cleaned`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.words import ID, ROW, TEXT, boxed, by_part, chain, free, pack, runs, unboxed, unpack
from tideline.session import broadcast_if_small, cut

#: Perfect difference sets by period: every residue is the difference of two members. Fixed values.
COVERS = {
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    73: (0, 1, 3, 7, 15, 31, 36, 54, 63),
}
GRAM = 28  # bytes of a gram, where the length allows it
CHUNK = 1 << 18  # sampled positions handled at once
BUCKET = 8192  # suffixes sorted at once in a task
PART_SAMPLES = 1 << 20  # sampled positions counted in one group
PART_BYTES = 12 << 20  # bytes of contexts in one bucket
FILTER_BYTES = 64 << 20
HOT = 50_000
LAST = 2**63 - 1


@dataclass(frozen=True)
class Cover:
    """Sampled positions for strings of `length` bytes."""

    length: int

    def __post_init__(self):
        if self.length < 10:
            raise ValueError("length must be 10 or more")

    @cached_property
    def period(self) -> int:
        return max(v for v in COVERS if v <= max(3, self.length - GRAM + 1))

    @property
    def residues(self) -> np.ndarray:
        return np.array(COVERS[self.period], np.int64)

    @cached_property
    def gram(self) -> int:
        """Bytes that are hashed: what all strings around a sampled position share to its right, 64 at most."""
        return min(64, self.length - self.period + 1)

    def positions(self, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position and residue number of the given numbers in the sample."""
        turn, which = np.divmod(count, len(self.residues))
        return turn * self.period + self.residues[which], which

    def until(self, limit: np.ndarray) -> np.ndarray:
        """How many sampled positions lie under each limit."""
        turn, rest = np.divmod(np.maximum(limit, 0), self.period)
        return turn * len(self.residues) + np.searchsorted(self.residues, rest, "left")


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """id (null last), text, and two digests of the text."""
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise TypeError("doc_id must be an integer column")
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("id"), t.alias("text"))
    return rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), F.col("text"), F.lit(2)), "n": F.octet_length("text").cast("long")})


def hashes(buf: np.ndarray, at: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the `size` bytes from each position; the last word overlaps the one before."""
    words = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    places = [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]
    return chain([np.full(len(at), seed, np.uint64), *(words[at + k] for k in places)])


def sampled(buf: np.ndarray, ends: np.ndarray, cover: Cover, chunk: int = CHUNK):
    """Chunks of (position, text number, residue number, gram hash) of the sample of texts laid end to end."""
    begins = ends - np.diff(ends, prepend=0)
    n = cover.until(ends - begins - cover.length + cover.period)
    stop = np.cumsum(n)
    for c in range(0, int(stop[-1]) if len(n) else 0, chunk):
        number = np.arange(c, min(c + chunk, int(stop[-1])))
        doc = np.searchsorted(stop, number, "right")
        at, residue = cover.positions(number - (stop - n)[doc])
        at += begins[doc]
        yield at, doc, residue, hashes(buf, at, cover.gram)


def _laid_out(texts: list[bytes], length: int):
    """Texts long enough, end to end: their rows, the bytes, and the ends."""
    rows = [i for i, t in enumerate(texts) if t and len(t) >= length]
    buf = np.frombuffer(b"".join(texts[i] for i in rows), np.uint8)
    return np.array(rows, np.int64), buf, np.cumsum([len(texts[i]) for i in rows], dtype=np.int64)


@dataclass(frozen=True)
class Filter:
    """Which hashes repeat. A hash is known by its first part_bits + key_bits bits; a key travels with four bits of
    its residue number in `width` bytes."""

    part_bits: int
    width: int
    segment: int

    @property
    def key_bits(self) -> int:
        return 8 * self.width - 4

    @classmethod
    def of(cls, samples: int, filter_bytes: int) -> Filter:
        part_bits = max(4, (samples // PART_SAMPLES).bit_length())
        # 64 times as many hashes as samples, so that strangers rarely meet; the rest of the hash stays at home.
        bits = (64 * samples + 1).bit_length() - part_bits + 4
        width = min(7, max(2, -(-bits // 8)), (64 - part_bits) // 8)
        segment = 1 << max(6, min(2 * samples, 8 * filter_bytes).bit_length() - 1 - part_bits)
        return cls(part_bits, width, segment)

    def keys(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(64 - self.part_bits - self.key_bits)

    def slots(self, keys: np.ndarray, anywhere: bool) -> np.ndarray:
        """Bit of a hash that occurs at several residues, or (the other one) twice at residue 0."""
        own = keys & np.uint64((1 << self.key_bits) - 1)
        if not anywhere:
            own = own * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
        return (own & np.uint64(self.segment - 1)).astype(np.int64)

    def passes(self, bits: np.ndarray, h: np.ndarray, residue: np.ndarray) -> np.ndarray:
        keys = self.keys(h)
        base = (keys >> np.uint64(self.key_bits)).astype(np.int64) * self.segment

        def seen(anywhere):
            bit = base + self.slots(keys, anywhere)
            return bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1

        return seen(True) | (residue == 0) & seen(False)

    def rows(self, h: np.ndarray, residue: np.ndarray):
        """(part, keys with residues, keys seen oftener, how often): a key and residue is sent twice at most."""
        mask = np.uint64((1 << 8 * self.width) - 1)
        v = np.sort(self.keys(h) << np.uint64(4) | residue.astype(np.uint64))
        third = np.zeros(len(v), bool)
        third[2:] = v[2:] == v[:-2]
        more, times = np.unique(v[third], return_counts=True)
        v = v[~third]
        parts = np.arange((1 << self.part_bits) + 1, dtype=object) << 8 * self.width
        cuts, cuts_more = np.searchsorted(v, np.array(parts[:-1], np.uint64)), np.searchsorted(more, np.array(parts[:-1], np.uint64))
        cuts, cuts_more = np.append(cuts, len(v)), np.append(cuts_more, len(more))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            planes = v[cuts[p] : cuts[p + 1]].view(np.uint8).reshape(-1, 8)[:, : self.width].T
            a, b = cuts_more[p], cuts_more[p + 1]
            yield p, pack(planes), (more[a:b] & mask).tobytes(), times[a:b].astype("<i8").tobytes()

    def read(self, blob: pa.Scalar) -> np.ndarray:
        planes = np.frombuffer(unpack(blob), np.uint8).reshape(self.width, -1)
        out = np.zeros((planes.shape[1], 8), np.uint8)
        out[:, : self.width] = planes.T
        return out.view("<u8").ravel()

    def count(self, table: pa.Table, hot: int) -> pa.Table:
        """One part's filter bits, its keys with more than `hot` occurrences, and how many occurrences pass."""
        part = table["part"][0].as_py()
        v = np.sort(np.concatenate([self.read(b) for b in table["keys"]]))
        keys = v >> np.uint64(4)
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        last = np.concatenate((new[1:], [len(v)])) - 1
        n = last - new + 1
        several = v[new] != v[last]
        twice = ~several & (n > 1) & (v[new] & np.uint64(15) == 0)
        more = np.concatenate([np.frombuffer(b.as_buffer(), "<u8") for b in table["more"]])
        times = np.concatenate([np.frombuffer(b.as_buffer(), "<i8") for b in table["times"]])
        np.add.at(n, np.searchsorted(keys[new], more >> np.uint64(4)), times)
        seen = np.zeros(self.segment, bool)
        seen[self.slots(keys[new[several]], True)] = True
        seen[self.slots(keys[new[twice]], False)] = True
        often = keys[new[(n > hot) & (several | twice)]] | np.uint64(part << self.key_bits)
        row = [[part], [pack(np.packbits(seen, bitorder="little"))], [often.tobytes()], [int(n[several | twice].sum())]]
        return pa.table({"part": pa.array(row[0], pa.int64()), "bits": pa.array(row[1], pa.binary()), "hot": pa.array(row[2], pa.binary()), "n": pa.array(row[3], pa.int64())})

    def gather(self, counted: DataFrame, hot: int) -> tuple[bytes, bytes, int]:
        """The filter (FILTER_BYTES at most), the hot keys and the number of occurrences that pass, on the driver."""
        bits, often, total = np.zeros((1 << self.part_bits) * self.segment // 8, np.uint8), [], 0
        rows = counted.groupBy("part").applyInArrow(lambda t: self.count(t, hot), "part long, bits binary, hot binary, n long")
        for row in rows.collect():
            at = row["part"] * self.segment // 8
            bits[at : at + self.segment // 8] = np.frombuffer(unpack(row["bits"]), np.uint8)
            often.append(bytes(row["hot"]))
            total += row["n"]
        return bits.tobytes(), b"".join(often), total


COUNTED = "part long, keys binary, more binary, times binary"


def _counted(rows) -> pa.RecordBatch:
    part, *blobs = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *(pa.array(b, pa.binary()) for b in blobs)], ["part", "keys", "more", "times"])


def count_samples(work: DataFrame, cover: Cover, kind: Filter) -> DataFrame:
    """Gram hashes of the sample by hash range, one row a range and chunk."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in runs(batch.column(0)):
                _, buf, ends = _laid_out(texts, cover.length)
                for _, _, residue, h in sampled(buf, ends, cover):
                    yield _counted(list(kind.rows(h, residue)))

    return work.select("text").mapInArrow(emit, COUNTED)


OCCURRENCE = (("id", "<i8"), ("h1", "<i8"), ("at", "<i8"), ("left", "<i4"), ("right", "<i4"))


def _contexts(work: DataFrame, cover: Cover, kind: Filter, bits: int, shared) -> DataFrame:
    """(bucket, occurrences, bytes) of the sampled suffixes that pass the filter and are not hot."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, hot = (np.frombuffer(x, t) for x, t in zip(shared.value, (np.uint8, np.uint64), strict=True))
        for batch in batches:
            for first, texts in runs(batch.column(2)):
                rows, buf, ends = _laid_out(texts, cover.length)
                if not len(buf):
                    continue
                ids, h1s = (batch.column(k).slice(first, len(texts)).to_numpy()[rows] for k in (0, 1))
                begins = ends - np.diff(ends, prepend=0)
                for at, doc, residue, h in sampled(buf, ends, cover):
                    ok = kind.passes(raw, h, residue)
                    if len(hot):
                        ok &= ~np.isin(kind.keys(h), hot)
                    yield _sent(at[ok], doc[ok], h[ok], ids, h1s, begins, ends, buf, cover, bits)

    return work.select("id", "h1", "text").mapInArrow(emit, CONTEXTS)


CONTEXTS = "part long, occurrences binary, bytes binary"


def _sent(at, doc, h, ids, h1s, begins, ends, buf: np.ndarray, cover: Cover, bits: int) -> pa.RecordBatch:
    """The chosen suffixes by bucket, with what their strings span."""
    left = np.minimum(at - begins[doc], cover.period - 1)
    right = np.minimum(ends[doc] - at, cover.length)
    columns = (ids[doc], h1s[doc], at - begins[doc], left, right)
    out = []
    for p, mine in by_part(h, bits):
        head = [c[mine].astype(t) for c, (_, t) in zip(columns, OCCURRENCE, strict=True)]
        out.append((p, pack(*head), pack(_gather(buf, at[mine] - left[mine], at[mine] + right[mine]))))
    part, *blobs = zip(*out, strict=True) if out else ((),) * 3
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *(pa.array(b, pa.binary()) for b in blobs)], ["part", "occurrences", "bytes"])


def _asked(work: DataFrame, cover: Cover, kind: Filter, hot: int):
    """For texts whose filter would be too large to broadcast: the same choice without one. Each run of texts asks every
    hash range which of its own samples repeat, and gets a bit for each. Gives the runs, the answers, the hot keys and
    the number of occurrences that pass."""

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in runs(batch.column(2)):
                lists = [pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), c.slice(at, len(texts))) for c in batch.columns]
                yield pa.RecordBatch.from_arrays(lists, ["id", "h1", "text"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, buf, ends = _laid_out(own.values.cast(pa.binary()).to_pylist(), cover.length)
                for chunk, (_, _, residue, h) in enumerate(sampled(buf, ends, cover)):
                    v = kind.keys(h) << np.uint64(4) | residue.astype(np.uint64)
                    rows = [(run, chunk, p, pack(v[mine].view(np.uint8).reshape(-1, 8)[:, : kind.width].T)) for p, mine in by_part(h, kind.part_bits)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(),) * 3 + (pa.binary(),), strict=True)], ["run", "chunk", "part", "keys"])

    def answer(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        blobs = [kind.read(b) for b in table["keys"]]
        v = np.concatenate(blobs)
        order = np.argsort(v, kind="stable")
        keys = v[order] >> np.uint64(4)
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(v)))
        ends = v[order][first], v[order][first + n - 1]
        repeated = (ends[0] != ends[1]) | (n > 1) & (ends[0] & np.uint64(15) == 0)
        often = repeated & (n > hot)
        ok = np.zeros(len(v), bool)
        ok[order] = (repeated & ~often)[np.cumsum(new) - 1]
        cuts = np.cumsum([len(b) for b in blobs])[:-1]
        masks = [(np.packbits(m).tobytes(), int(m.sum())) for m in np.split(ok, cuts)]
        hot_keys = (keys[first[often]] | np.uint64(part << kind.key_bits)).tobytes()
        columns = [table["run"].to_pylist() + [-1], table["chunk"].to_pylist() + [-1], table["part"].to_pylist() + [part], [m for m, _ in masks] + [hot_keys], [k for _, k in masks] + [0]]
        return pa.table({name: pa.array(c, t) for name, c, t in zip(("run", "chunk", "part", "mask", "n"), columns, (pa.int64(),) * 3 + (pa.binary(), pa.int64()), strict=True)})

    texts = work.select("id", "h1", "text").mapInArrow(laid, "id array<long>, h1 array<long>, text array<string>")
    texts = cut(texts.withColumn("run", F.monotonically_increasing_id()))
    asked = texts.select("run", "text").mapInArrow(ask, "run long, chunk long, part long, keys binary")
    answers = cut(asked.groupBy("part").applyInArrow(answer, "run long, chunk long, part long, mask binary, n long"))
    often = b"".join(bytes(r["mask"]) for r in answers.where("run = -1 and octet_length(mask) > 0").select("mask").collect())
    return texts, answers.where("run >= 0"), often, answers.agg(F.sum("n")).first()[0] or 0


def _answered(texts: DataFrame, answers: DataFrame, cover: Cover, kind: Filter, bits: int) -> DataFrame:
    """Contexts of the samples that the answers choose."""

    def emit(own: pa.Table, told: pa.Table) -> pa.Table:
        masks = {key: m for *key_, m in zip(*(told[c].to_pylist() for c in ("chunk", "part", "mask")), strict=True) for key in [tuple(key_)]}
        lists = {c: own[c][0].values for c in ("id", "h1", "text")}
        rows, buf, ends = _laid_out(lists["text"].cast(pa.binary()).to_pylist(), cover.length)
        ids, h1s = (lists[c].to_numpy()[rows] for c in ("id", "h1"))
        begins = ends - np.diff(ends, prepend=0)
        out = []
        for chunk, (at, doc, _, h) in enumerate(sampled(buf, ends, cover)):
            ok = np.zeros(len(at), bool)
            for p, mine in by_part(h, kind.part_bits):
                ok[mine] = np.unpackbits(np.frombuffer(masks[chunk, p], np.uint8), count=len(mine)).astype(bool)
            out.append(_sent(at[ok], doc[ok], h[ok], ids, h1s, begins, ends, buf, cover, bits))
        return pa.Table.from_batches(out)

    return texts.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(emit, CONTEXTS)


def _gather(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """buf[lo:hi] for each pair, end to end."""
    n = hi - lo
    skip = np.repeat(lo - (np.cumsum(n) - n), n)
    return buf[skip + np.arange(n.sum())]


def _load(table: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Occurrences in document order, where the bytes of each begin, and the bytes. A row given twice counts once."""
    columns: dict[str, list] = {name: [] for name, _ in OCCURRENCE}
    size = sum(np.dtype(t).itemsize for _, t in OCCURRENCE)
    for blob in table["occurrences"]:
        raw = unpack(blob)
        count, at = len(raw) // size, 0
        for name, t in OCCURRENCE:
            columns[name].append(np.frombuffer(raw, t, count, at).astype(np.int64))
            at += count * np.dtype(t).itemsize
    found = {name: np.concatenate(parts) for name, parts in columns.items()}
    buf = np.frombuffer(b"".join(map(unpack, table["bytes"])), np.uint8)
    n = found["left"] + found["right"]
    start = np.cumsum(n) - n
    order = np.lexsort((found["at"], found["h1"], found["id"]))
    same = np.zeros(len(order), bool)
    same[1:] = np.all([np.diff(found[name][order]) == 0 for name in ("id", "h1", "at")], axis=0)
    order = order[~same]
    return {name: c[order] for name, c in found.items()}, start[order], buf


def _ranks(group: np.ndarray, buf: np.ndarray, start: np.ndarray, n: np.ndarray, step: int, width: int):
    """Order of the contexts by group and content, and the length each shares with the one before (-1: new group).

    Contexts are n bytes from `start`, read in direction `step`. Shorter ones, padded with zeros, come before their
    extensions, so two that agree on t bytes have only such between them as agree on t bytes too.
    """
    size = -(-width // 8) * 8
    k = np.arange(size)
    text = buf[np.clip(start[:, None] + step * k, 0, len(buf) - 1)] if len(buf) else np.zeros((len(n), size), np.uint8)
    text = np.where(k < n[:, None], text, 0).astype(np.uint8)
    words = text.view(">u8").astype(np.uint64)
    order = np.lexsort((n, *words.T[::-1], group))
    text, m, g = text[order], n[order], group[order]
    differ = text[1:] != text[:-1]
    common = np.where(differ.any(1), differ.argmax(1), size)
    common = np.where(g[1:] == g[:-1], np.minimum(common, np.minimum(m[1:], m[:-1])), -1)
    return order, np.concatenate(([-1], common)) if len(order) else np.zeros(0, np.int64)


def repeats(group: np.ndarray, left: np.ndarray, right: np.ndarray, start: np.ndarray, buf: np.ndarray, cover: Cover) -> tuple[np.ndarray, np.ndarray]:
    """For each occurrence (in document order) the least and the largest p of its repeated strings; -1 if none.

    All strings of an occurrence hold its gram, so the bytes that any of them cover are one range.
    """
    length = cover.length
    lo, hi = np.full(len(group), length), np.full(len(group), -1)
    order_r, common_r = _ranks(group, buf, start + left, right, 1, length)
    order_l, common_l = _ranks(group, buf, start + left - 1, left, -1, cover.period - 1)
    class_r, class_l = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
    for p in range(cover.period):
        live = np.flatnonzero((length - right <= p) & (p <= left))
        if len(live) < 2:
            continue
        class_r[order_r] = np.cumsum(common_r < length - p)
        class_l[order_l] = np.cumsum(common_l < p)
        key = class_r[live] * (len(group) + 1) + class_l[live]
        again = np.ones(len(live), bool)
        again[np.unique(key, return_index=True)[1]] = False
        hit = live[again]
        hi[hit] = p
        lo[hit] = np.minimum(lo[hit], p)
    return lo, hi


def _spans(table: pa.Table, cover: Cover) -> pa.Table:
    """Repeated ranges of one bucket; its suffixes are sorted about BUCKET at a time, whole groups of one gram."""
    found, start, buf = _load(table)
    h = hashes(buf, start + found["left"], cover.gram)
    order = np.argsort(h, kind="stable")
    g = h[order]
    new = np.concatenate(([True], g[1:] != g[:-1]))
    single = new & np.concatenate((new[1:], [True]))
    order, g = order[~single], g[~single]
    new = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
    out, at = [], 0
    while at < len(order):
        later = new[np.searchsorted(new, at + BUCKET) :]
        to = int(later[0]) if len(later) else len(order)
        mine = order[at:to]
        part = {name: c[mine] for name, c in found.items()}
        lo, hi = repeats(g[at:to], part["left"], part["right"], start[mine], buf, cover)
        hit = hi >= 0
        p = part["at"][hit]
        out.append((part["id"][hit], part["h1"][hit], p - hi[hit], p - lo[hit] + cover.length))
        at = to
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
    return _ranges(*columns)


def _ranges(ids: np.ndarray, h1s: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Table:
    """Ranges of each text, with overlapping ones joined."""
    order = np.lexsort((s, h1s, ids))
    ids, h1s, s, e = (x[order] for x in (ids, h1s, s, e))
    if len(s):
        text = np.concatenate(([0], np.cumsum((ids[1:] != ids[:-1]) | (h1s[1:] != h1s[:-1]))))
        wide = int(e.max()) + 1
        reach = np.maximum.accumulate(e + text * wide)
        new = np.concatenate(([True], s[1:] + text[1:] * wide > reach[:-1]))
        last = np.concatenate((np.flatnonzero(new)[1:], [len(s)])) - 1
        ids, h1s, s, e = ids[new], h1s[new], s[new], (reach - text * wide)[last]
    return pa.table({"id": ids, "h1": h1s, "s": s, "e": e})


def _hot_strings(batch: pa.RecordBatch, cover: Cover, kind: Filter, hot: np.ndarray):
    """Chunks of (id, h1, start, two names, place, bytes) of the distinct strings around hot grams, in document order."""
    for first, texts in runs(batch.column(2)):
        ids, h1s = (batch.column(k).slice(first, len(texts)).to_numpy() for k in (0, 1))
        whose = dict.fromkeys(zip(ids.tolist(), h1s.tolist(), strict=True))
        at_row = {key: i for i, key in enumerate(zip(ids.tolist(), h1s.tolist(), strict=True))}
        order = [at_row[key] for key in sorted(whose)]
        rows, buf, ends = _laid_out([texts[i] for i in order], cover.length)
        if not len(buf):
            continue
        ids, h1s = ids[order][rows], h1s[order][rows]
        begins = ends - np.diff(ends, prepend=0)
        for at, doc, _, h in sampled(buf, ends, cover, CHUNK // 4):
            ok = np.isin(kind.keys(h), hot)
            at, doc = at[ok], doc[ok]
            lo, hi = np.maximum(at - cover.period + 1, begins[doc]), np.minimum(at, ends[doc] - cover.length) + 1
            lo[1:] = np.maximum(lo[1:], np.where(doc[1:] == doc[:-1], hi[:-1], 0))
            n = np.maximum(hi - lo, 0)
            starts = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            if len(starts):
                doc = np.repeat(doc, n)
                yield ids[doc], h1s[doc], starts - begins[doc], *(hashes(buf, starts, cover.length, seed) for seed in (1, 2))


def _hot_spans(work: DataFrame, cover: Cover, kind: Filter, shared, samples: int, filter_bytes: int) -> DataFrame:
    """Repeated strings around grams too frequent for one task: reduced in every chunk, counted, and only those left
    that may repeat in another chunk become rows of a combining aggregation."""
    names = Filter.of(samples, filter_bytes)
    texts = work.select("id", "h1", "text")

    def chunks(batches: Iterator[pa.RecordBatch]):
        hot = np.frombuffer(shared.value[1], np.uint64)
        for batch in batches:
            for ids, h1s, starts, a, b in _hot_strings(batch, cover, kind, hot):
                order = np.lexsort((starts, h1s, ids, b, a))
                later = np.zeros(len(order), bool)
                later[1:] = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
                yield [x[order] for x in (ids, h1s, starts, a, b)], later

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, _, a, _), later in chunks(batches):
            yield _counted(list(names.rows(a[~later], np.zeros(int((~later).sum()), np.int64))))

    raw, _, _ = names.gather(texts.mapInArrow(counted, COUNTED), LAST)
    seen = work.sparkSession.sparkContext.broadcast(raw)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(seen.value, np.uint8)
        for (ids, h1s, starts, a, b), later in chunks(batches):
            inside = _ranges(ids[later], h1s[later], starts[later], starts[later] + cover.length)
            left = ~later
            left[left] = names.passes(bits, a[left], np.zeros(int(left.sum()), np.int64))
            k = len(inside)
            columns = [np.concatenate((inside[c].to_numpy(), x[left])) for c, x in (("id", ids), ("h1", h1s), ("s", starts), ("e", starts + cover.length))]
            none = np.arange(k + int(left.sum())) < k
            keys = [pa.array(np.concatenate((np.zeros(k, np.int64), x[left].view(np.int64))), mask=none) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *keys], ["id", "h1", "s", "e", "a", "b"])

    rows = cut(texts.mapInArrow(strings, "id long, h1 long, s long, e long, a long, b long"))
    place = F.struct("id", "h1", "s")
    first = rows.where("a is not null").groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    across = rows.join(broadcast_if_small(first.select("a", "b", "first"), 56), ["a", "b"]).where(place != F.col("first"))
    return rows.where("a is null").select("id", "h1", "s", "e").unionByName(across.select("id", "h1", "s", "e"))


def spans(work: DataFrame, length: int, n_bytes: int, hot: int = HOT, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(id, h1, s, e): repeated byte ranges, overlapping, of distinct texts (rows of `keyed`)."""
    cover = Cover(length)
    samples = n_bytes * len(cover.residues) // cover.period + 1
    kind = Filter.of(samples, filter_bytes)
    # Buckets by the bytes that are sent, so that a task sorts as much at a time at every size.
    parts = lambda passing: max(1, (passing * (length + cover.period) // PART_BYTES).bit_length())
    spark = work.sparkSession
    if 2 * samples <= 8 * filter_bytes:
        raw, often, passing = kind.gather(count_samples(work, cover, kind), hot)
        shared = spark.sparkContext.broadcast((raw, often))
        contexts = _contexts(work, cover, kind, parts(passing), shared)
    else:
        texts, answers, often, passing = _asked(work, cover, kind, hot)
        shared = spark.sparkContext.broadcast((b"", often))
        contexts = _answered(texts, answers, cover, kind, parts(passing))
    found = contexts.groupBy("part").applyInArrow(lambda t: _spans(t, cover), "id long, h1 long, s long, e long")
    if often:
        found = found.unionByName(_hot_spans(work, cover, kind, shared, samples, filter_bytes))
    return found


def _prepared(docs: DataFrame, length: int, text: str, doc_id: str, hot: int, filter_bytes: int):
    """Keyed rows, (id, h1, h2) of later copies of a text, and the repeated ranges of every other text."""
    rows = keyed(docs, text, doc_id)
    light = cut(rows.select("id", "h1", "h2", "n"))
    total = light.agg(F.sum("n")).first()[0] or 0
    copied = light.where(F.col("n") >= length).groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last")
    # One row a text that has copies; broadcast while they are few, so that no task gathers a text's many copies.
    copied = broadcast_if_small(cut(copied.drop("last")), 32)
    copies = cut(light.join(copied, ["h1", "h2"]).where("id <> first").select("id", "h1", "h2").distinct())
    small = broadcast_if_small(copies, 40)
    work = rows.join(small, ["id", "h1", "h2"], "left_anti")
    ranges = spans(work.select("id", "h1", "text"), length, total, hot, filter_bytes)
    merged = cut(ranges.groupBy("id", "h1").agg(F.collect_list(F.struct("s", "e")).alias("spans")))
    return rows, small, merged


def _union(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by ranges."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate(([True], starts[1:] > ends[:-1])))
    last = np.concatenate((new[1:], [len(starts)])) - 1
    return list(zip(starts[new].tolist(), ends[last].tolist(), strict=True))


def _kept(raw: bytes, found: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in found:
        out.append(raw[at:s])
        at = e
    return b"".join(out) + raw[at:]


def measure(docs: DataFrame, length: int = 100, text: str = "text", doc_id: str = "doc_id", hot: int = HOT, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the digest of what is left, for every row."""
    rows, copies, merged = _prepared(docs, length, text, doc_id, hot, filter_bytes)
    keys = broadcast_if_small(merged.select("id", "h1"), 24)
    is_copy = rows.join(copies.withColumn("copy", F.lit(True)), ["id", "h1", "h2"], "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    plain = is_copy.join(keys.withColumn("cut", F.lit(True)), ["id", "h1"], "left").where("copy or cut is null")
    zero = F.lit(0).cast("long")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    simple = plain.select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        F.when(F.col("copy"), F.col("n")).otherwise(zero).alias("n_removed"),
        F.col("copy").cast("long").alias("n_spans"),
        F.sha2(F.when(F.col("copy"), F.lit("")).otherwise(F.col("text")), 256).alias("kept_sha256"),
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, r in zip(batch.column("text").cast(pa.binary()), batch.column("spans"), strict=True):
                raw, found = t.as_py(), _range_arrays(r)
                left = _kept(raw, found)
                out.append((len(raw), len(raw) - len(left), len(found), hashlib.sha256(left).hexdigest()))
            n, removed, count, sha = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())], names
            )

    some = is_copy.where("not copy").join(keys, ["id", "h1"], "left_semi").select("doc_id", "id", "h1", "text")
    changed = some.join(merged, ["id", "h1"]).select("doc_id", "text", "spans").mapInArrow(each, simple.schema)
    return simple.unionByName(changed)


def _range_arrays(scalar) -> list[tuple[int, int]]:
    v = scalar.values
    return _union(v.field("s").to_numpy(), v.field("e").to_numpy())


def cleaned(docs: DataFrame, length: int = 100, text: str = "text", doc_id: str = "doc_id", hot: int = HOT, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """The documents without the repeated bytes; a character that is only partly left goes too. Null texts stay null."""
    columns = docs.columns
    _, copies, merged = _prepared(docs, length, text, doc_id, hot, filter_bytes)
    t = F.coalesce(F.col(TEXT), F.lit(""))
    rows = boxed(docs, text, doc_id).withColumns({"id": F.coalesce(F.col(ID).cast("long"), F.lit(LAST)), "h1": F.xxhash64(t), "h2": F.xxhash64(F.lit(1), t, F.lit(2))})
    rows = rows.join(copies.withColumn("copy", F.lit(True)), ["id", "h1", "h2"], "left")
    keys = broadcast_if_small(merged.select("id", "h1"), 24)
    flagged = rows.join(keys.withColumn("cut", F.lit(True)), ["id", "h1"], "left")
    same = flagged.where("copy is not null or cut is null")
    same = unboxed(same.withColumn(ROW, F.when(F.col("copy"), F.col(ROW).withField(f"`{text}`", F.lit(""))).otherwise(F.col(ROW))))
    place = columns.index(text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [_kept(x.as_py(), _range_arrays(r)).decode(errors="ignore") for x, r in zip(batch.column(place).cast(pa.binary()), batch.columns[-1], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:place], pa.array(left, batch.schema.field(place).type), *batch.columns[place + 1 : -1]], columns
            )

    some = flagged.where("copy is null and cut").select(ROW, "id", "h1")
    changed = some.join(merged, ["id", "h1"]).select(f"{ROW}.*", F.col("spans").alias(free("spans", columns))).mapInArrow(each, docs.schema)
    return same.unionByName(changed)

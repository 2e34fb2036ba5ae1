"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs over all training texts are gathered by hash range. Each count is quantised to a level
on a logarithmic scale and the filter holds (n-gram, 1), (n-gram, 2), ... up to its level, so a count is read back by
probing levels until the first miss. A word or pair seen once is level 1 and has its entry like any other. At
BITS_PER_ENTRY bits and PROBES probes a probe chain errs with probability 0.0005, and errors only raise a count by a
level. Probabilities of a word after another are the filter's pair count backed by the word's own probability
(Dirichlet smoothing); begin and end of a text count as words.

Every hash range has a filter segment of its own. Segments and exact word counts go to the executors as one file that
tasks memory-map, if they stay under `max_bytes`. Beyond that no task needs them all: the distinct n-grams of each run
of texts, with their counts in training, meet those of all other runs at their hash range, which adds them up, makes its
segments, probes them, and sends the levels back to the runs. Both ways probe the same segments with the same hashes and
give the same scores.

Words are identified by 64-bit hashes. Defined cases: null text is empty and has the end token only; a null doc_id
belongs to training; with no training texts every count is 0; an empty table gives no rows; rows that repeat are
scored (and counted) each; other columns are not carried over.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.words import by_part, chain, mix, pack, runs, sorted_planes, unpack, unsorted_planes, word_hashes
from tideline.session import cut

BASE = 1.5
PROBES = 11
BITS_PER_ENTRY = 16
#: Prior weight of the word's own probability in pair probabilities.
MU = 300.0
MAX_BYTES = 256 << 20
PART_BYTES = 2 << 20  # text of one hash range, on average
#: Where ranges answer for themselves: hash ranges of a group as a power of 2, bytes of text in a run, and bytes of
#: training text for each of `max_bytes` beyond which the table is not gathered to see whether it fits.
JOINED, ASKING_BYTES, TEXT_FACTOR = 2, 8 << 20, 4
BEGIN, END = np.uint64(0xB5297A4D3F84D5B5), np.uint64(0x68E31DA4C1D8F2E3)
MASK32 = np.uint64(0xFFFFFFFF)


def word_levels(counts: np.ndarray) -> np.ndarray:
    """Level 1 for a word or pair seen once, and one more for every factor BASE."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


def pair_levels(counts: np.ndarray) -> np.ndarray:
    """The scale that leaves single occurrences out, at level 0. The model does not use it: its pairs have word_levels."""
    return word_levels(counts) - 1


def count_of(level: np.ndarray, first: int) -> np.ndarray:
    """The middle of the counts that share a level; 0 for none. `first` is the level of a single occurrence."""
    low = np.ceil(BASE ** (level - first) - 1e-9)
    high = np.maximum(low, np.ceil(BASE ** (level - first + 1) - 1e-9) - 1)
    return np.where(level > 0, (low + high) / 2, 0.0)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 10 == 0, F.lit(False))


def _tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token and previous token of each position (the end token last in each text), and tokens of each text."""
    words, n = word_hashes(texts)
    total = len(words) + len(texts)
    last = np.cumsum(n + 1) - 1
    token = np.full(total, END, np.uint64)
    inside = np.ones(total, bool)
    inside[last] = False
    token[inside] = words
    previous = np.concatenate(([BEGIN], token[:-1])) if total else token
    previous[last[:-1] + 1] = BEGIN
    return token, previous, n + 1


def pairs_of(previous: np.ndarray, token: np.ndarray) -> np.ndarray:
    return chain([previous, token])


def _merge(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    h = hashes[order]
    new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[new], np.add.reduceat(counts[order], new) if len(h) else counts


def range_bits(n_bytes: int) -> int:
    """Bits of a hash that number its range, for so many bytes of training texts."""
    return max(4, (n_bytes // PART_BYTES).bit_length())


def gather_counts(docs: DataFrame, bits: int, text: str = "text") -> DataFrame:
    """One row per hash range: its tokens and words, its filter segment, and its sorted word hashes with counts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in runs(batch.column(0)):
                token, previous, n = _tokens(texts)
                out = []
                for kind, grams in ((0, np.concatenate((token, np.full(len(n), BEGIN, np.uint64)))), (1, pairs_of(previous, token))):
                    h, c = np.unique(grams, return_counts=True)
                    out += [(p, kind, pack(sorted_planes(h[at])), pack(c[at].astype("<u4"))) for p, at in by_part(h, bits)]
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["part", "kind", "hashes", "counts"])

    def total(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_numpy()
        found = []
        for kind in (0, 1):
            at = np.flatnonzero(kinds == kind).tolist()
            hs = [unsorted_planes(unpack(table["hashes"][i])) for i in at]
            cs = [np.frombuffer(unpack(table["counts"][i]), "<u4").astype(np.int64) for i in at]
            found.append(_merge(np.concatenate(hs), np.concatenate(cs)) if hs else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        (words, times), _ = found
        real = words != BEGIN
        row = (table["part"][0].as_py(), int(times[real].sum()), int(real.sum()), segment_of(found), words.tobytes(), times.tobytes())
        return pa.table({name: pa.array([x], t) for (name, t), x in zip(FIELDS, row, strict=True)})

    emitted = docs.select(text).mapInArrow(emit, "part long, kind int, hashes binary, counts binary")
    return cut(emitted.groupBy("part").applyInArrow(total, SCHEMA).withColumn("bits", F.lit(bits)))


FIELDS = [("part", pa.int64()), ("tokens", pa.int64()), ("words", pa.int64()), ("filter", pa.binary()), ("word_hashes", pa.binary()), ("word_counts", pa.binary())]
SCHEMA = "part long, tokens long, words long, filter binary, word_hashes binary, word_counts binary"


def segment_of(found: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """The filter bits of n-grams with counts, of one hash range."""
    tops = [word_levels(c) for _, c in found]
    size = 64 * -(-sum(int(t.sum()) for t in tops) * BITS_PER_ENTRY // 64)
    seen = np.zeros(size, bool)
    for (h, _), top in zip(found, tops, strict=True):
        for level in range(1, int(top.max(initial=0)) + 1):
            mine = h[top >= level]
            for k in range(PROBES):
                seen[_bit_places(mine, level, np.uint64(size), range(k, k + 1))[0]] = True
    return np.packbits(seen, bitorder="little").tobytes()


def _bit_places(hashes: np.ndarray, level: int, size, probes: range = range(PROBES)) -> np.ndarray:
    """Bit numbers of (n-gram, level) in a segment of `size` bits, one row per probe."""
    a = mix(hashes + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
    low, step = a & MASK32, (a >> np.uint64(32)) | np.uint64(1)
    k = np.array(probes, np.uint64)[:, None]
    return (((low + k * step) & MASK32) * size >> np.uint64(32)).astype(np.int64)


def read_levels(h: np.ndarray, bits: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Probe level after level until the first miss; each hash in the segment of `size` bits that begins at a byte."""
    out = np.zeros(len(h), np.int64)
    live, level = np.flatnonzero(size), 1
    size = size.astype(np.uint64)
    while len(live):
        for probes in (range(1), range(1, PROBES)):  # most misses show at the first bit
            place = _bit_places(h[live], level, size[live], probes) + 8 * begin[live]
            live = live[(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1).all(0)]
        out[live] = level
        level += 1
    return out


def exact_counts(h: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return np.where(hashes[at] == h, counts[at], 0)


#: Word counts in the shipped file: 32 bits where the largest fits.
COUNTS = ("<u4", "<i8")


class Table:
    """The shipped file: sizes, where segments begin, the segments, then word hashes and counts in hash order."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        self.bits, words, self.n, self.v, wide = (int(x) for x in data[:40].view("<i8"))
        at = 40 + 8 * ((1 << self.bits) + 1)
        self.begins = data[40:at].view("<i8")
        self.filter = data[at : at + int(self.begins[-1])]
        at += int(self.begins[-1])
        self.hashes, self.counts = data[at : at + 8 * words].view("<u8"), data[at + 8 * words :].view(COUNTS[wide])

    def exact(self, h: np.ndarray) -> np.ndarray:
        return exact_counts(h, self.hashes, self.counts)

    def level(self, h: np.ndarray) -> np.ndarray:
        part = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        begin = self.begins[part]
        return read_levels(h, self.filter, begin, 8 * (self.begins[part + 1] - begin))


def write_table(counts: DataFrame, path: str, stats: dict) -> None:
    """Lay segments and word counts end to end. What comes to the driver is the table itself, row by row, which the
    caller has checked against its size bound."""
    begins = np.zeros((1 << stats["bits"]) + 1, "<i8")
    first = 40 + begins.nbytes
    wide = int(stats["n"] >= 2**31)
    at, words = first, first + stats["filter"]
    times = words + 8 * stats["stored"]
    with open(path, "wb") as f:
        for row in counts.orderBy("part").toLocalIterator():
            begins[row["part"] + 1] = len(row["filter"])
            counts_ = np.frombuffer(row["word_counts"], "<i8").astype(COUNTS[wide])
            for place, blob in ((at, row["filter"]), (words, row["word_hashes"]), (times, counts_.tobytes())):
                f.seek(place)
                f.write(blob)
            at += len(row["filter"])
            words += len(row["word_hashes"])
            times += counts_.nbytes
        f.seek(0)
        f.write(np.array([stats["bits"], stats["stored"], stats["n"], stats["v"], wide], "<i8").tobytes())
        f.write(np.cumsum(begins).astype("<i8").tobytes())


def _stats(counts: DataFrame) -> dict:
    row = counts.agg(
        F.sum("tokens").alias("n"),
        F.sum("words").alias("v"),
        F.sum(F.octet_length("filter")).alias("filter"),
        (F.sum(F.octet_length("word_hashes")) / 8).cast("long").alias("stored"),
        F.max("bits").alias("bits"),
    ).first()
    return {k: v or 0 for k, v in row.asDict().items()} | {"bits": row["bits"] or 4}


def _log_scores(c_pair, c_previous, c_word, n: int, v: int) -> np.ndarray:
    """log10 of the smoothed probability of a token after another."""
    own = (c_word + 0.1) / (n + 0.1 * (v + 1))
    return np.log10((c_pair + MU * own) / (np.maximum(c_previous, c_pair) + MU))


@dataclass
class Grams:
    """The tokens of a run of texts, and its distinct words (begin included) and pairs in hash order."""

    words: np.ndarray
    pairs: np.ndarray
    word_at: np.ndarray
    pair_at: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes | None]) -> Grams:
        token, previous, n = _tokens(texts)
        words, word_at = np.unique(np.concatenate((token, [BEGIN])), return_inverse=True)
        pairs, pair_at = np.unique(pairs_of(previous, token), return_inverse=True)
        return cls(words, pairs, word_at, pair_at, n)

    def scores(self, exact: np.ndarray, word_level: np.ndarray, pair_level: np.ndarray, n: int, v: int):
        """n_known, base score and model score of every text."""
        about, pair = count_of(word_level, 1), count_of(pair_level, 1)
        token, begin = self.word_at[:-1], about[self.word_at[-1]]
        starts = np.cumsum(self.n) - self.n
        own = about[token]
        before = np.concatenate(([begin], own[:-1]))
        before[starts] = begin
        base = np.log10((exact + 0.1) / (n + 0.1 * (v + 1)))[token]
        log = _log_scores(pair[self.pair_at], before, own, n, v)
        return np.add.reduceat((exact > 0)[token].astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(log, starts)


NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
RESULT = "doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _result(ids: pa.Array, held: pa.Array, grams: Grams, found, n: int) -> pa.RecordBatch:
    known, base, log = found
    return pa.RecordBatch.from_arrays([ids, held, *map(pa.array, (grams.n, known, np.full(len(known), n), base, log))], NAMES)


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_bytes: int = MAX_BYTES) -> DataFrame:
    """Base and model scores of every text; the texts that are not held out are the training texts."""
    spark = docs.sparkSession
    training = docs.where(~held_out(doc_id))
    n_bytes = training.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = range_bits(n_bytes)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    if n_bytes > TEXT_FACTOR * max_bytes:
        return score_by_range(rows, bits)
    counts = gather_counts(training, bits, text)
    stats = _stats(counts)
    if stats["filter"] + 16 * stats["stored"] > max_bytes:
        return score_by_range(rows, bits)
    # In the driver's own folder of shipped files, so that it isn't copied there.
    name = f"lm-{uuid.uuid4().hex}.bin"
    path = os.path.join(SparkFiles.getRootDirectory(), name)
    write_table(counts, path, stats)
    spark.sparkContext.addFile(path)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Table(SparkFiles.get(name))
        for batch in batches:
            for at, texts in runs(batch.column(2)):
                grams = Grams.of(texts)
                found = grams.scores(t.exact(grams.words), t.level(grams.words), t.level(grams.pairs), t.n, t.v)
                yield _result(*(batch.column(k).slice(at, len(texts)) for k in (0, 1)), grams, found, t.n)

    return rows.mapInArrow(each, RESULT.format(kind=rows.schema["doc_id"].dataType.simpleString()))


def answers_of(found: list[tuple[np.ndarray, np.ndarray]], bits: int, group: int, joined: int) -> list[np.ndarray]:
    """Filter levels of the sorted distinct words and pairs of one group of hash ranges, from segments made of those that
    occur in training."""
    first = group << joined
    parts = [(h >> np.uint64(64 - bits)).astype(np.int64) - first for h, _ in found]
    cuts = [np.searchsorted(part, np.arange((1 << joined) + 1)) for part in parts]
    segments = []
    for p in range(1 << joined):
        own = [(h[at[p] : at[p + 1]], c[at[p] : at[p + 1]]) for (h, c), at in zip(found, cuts, strict=True)]
        segments.append(segment_of([(h[c > 0], c[c > 0]) for h, c in own]))
    sizes = np.array([len(x) for x in segments])
    begins = np.cumsum(sizes) - sizes
    filter_ = np.frombuffer(b"".join(segments), np.uint8)
    return [read_levels(h, filter_, begins[part], 8 * sizes[part]) for (h, _), part in zip(found, parts, strict=True)]


def _laid(texts: list[bytes | None]) -> bytes:
    """Lengths and bytes of texts in one compressed value."""
    whole = b"".join(t or b"" for t in texts)
    return pack(np.array([len(t or b"") for t in texts], "<i8"), np.frombuffer(whole, np.uint8))


def _unlaid(blob, n: int) -> list[bytes]:
    raw = unpack(blob)
    ends = 8 * n + np.cumsum(np.frombuffer(raw, "<i8", n))
    return [raw[a:b] for a, b in zip([8 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def score_by_range(rows: DataFrame, bits: int) -> DataFrame:
    """The same scores for a table of any size. Each run of texts sends its n-grams once, with their counts in training,
    to groups of hash ranges; a group's answers to all runs come from the segments it has made, which are not stored."""
    joined = min(JOINED, bits - 1)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in runs(batch.column(2), ASKING_BYTES):
                lists = [pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), batch.column(k).slice(at, len(texts))) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([_laid(texts)], pa.binary())], ["doc_id", "held_out", "texts"])

    texts = rows.mapInArrow(laid, f"doc_id array<{kind}>, held_out array<boolean>, texts binary")
    texts = cut(texts.withColumn("run", F.monotonically_increasing_id()))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, held, blob in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                training = ~held.values.to_numpy(zero_copy_only=False).astype(bool)
                token, previous, n = _tokens(_unlaid(blob, len(training)))
                each = np.repeat(training, n)
                out = []
                for k, grams, counted in ((0, np.concatenate((token, np.full(len(n), BEGIN, np.uint64))), np.concatenate((each, training))), (1, pairs_of(previous, token), each)):
                    h, place = np.unique(grams, return_inverse=True)
                    c = np.bincount(place[counted], minlength=len(h))
                    out += [(run, p, k, pack(sorted_planes(h[at])), pack(c[at].astype("<u4"))) for p, at in by_part(h, bits - joined)]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["run", "part", "kind", "hashes", "counts"])

    def answer(asked: pa.Table) -> pa.Table:
        kinds, blobs, times = asked["kind"].to_numpy(), asked["hashes"].to_pylist(), asked["counts"].to_pylist()
        found, places = [], []
        for k in (0, 1):
            at = np.flatnonzero(kinds == k).tolist()
            hs = [unsorted_planes(unpack(blobs[i])) for i in at]
            h, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *hs]), return_inverse=True)
            counts = np.concatenate([np.zeros(0, "<u4"), *[np.frombuffer(unpack(times[i]), "<u4") for i in at]])
            found.append((h, np.bincount(place, counts, len(h)).astype(np.int64)))  # sums of whole numbers, exact below 2^53
            places.append(zip(at, np.split(place, np.cumsum([len(x) for x in hs])[:-1]) if hs else [], strict=True))
        told = answers_of(found, bits, asked["part"][0].as_py(), joined)
        levels, exact = [b""] * len(kinds), [b""] * len(kinds)
        for k, own in enumerate(places):
            for i, place in own:
                levels[i] = pack(told[k][place].astype(np.uint8))
                if k == 0:
                    exact[i] = pack(found[0][1][place])
        words, times = found[0]
        real = (words != BEGIN) & (times > 0)
        once = lambda x: pa.array([int(x), *[0] * (len(kinds) - 1)], pa.int64())
        columns = [asked["run"], asked["part"], asked["kind"], pa.array(levels, pa.binary()), pa.array(exact, pa.binary()), once(times[real].sum()), once(real.sum())]
        return pa.table(columns, ["run", "part", "kind", "levels", "exact", "tokens", "words"])

    asked = texts.select("run", "held_out", "texts").mapInArrow(ask, "run long, part long, kind int, hashes binary, counts binary")
    answers = cut(asked.groupBy("part").applyInArrow(answer, "run long, part long, kind int, levels binary, exact binary, tokens long, words long"))
    n, v = (x or 0 for x in answers.agg(F.sum("tokens"), F.sum("words")).first())

    def finish(own: pa.Table, told: pa.Table) -> pa.Table:
        told = told.sort_by([("kind", "ascending"), ("part", "ascending")])
        kinds = told["kind"].to_numpy()
        of = lambda name, k: b"".join(unpack(x) for x in told[name].filter(pa.array(kinds == k)))
        levels = [np.frombuffer(of("levels", k), np.uint8).astype(np.int64) for k in (0, 1)]
        exact = np.frombuffer(of("exact", 0), "<i8")
        ids, held = own["doc_id"][0].values, own["held_out"][0].values
        grams = Grams.of(_unlaid(own["texts"][0], len(ids)))
        return pa.Table.from_batches([_result(ids, held, grams, grams.scores(exact, *levels, n, v), n)])

    told = answers.select("run", "part", "kind", "levels", "exact")
    return texts.groupBy("run").cogroup(told.groupBy("run")).applyInArrow(finish, RESULT.format(kind=kind))

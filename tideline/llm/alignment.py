"""Alignment of two tokenizers by divide and conquer at shared cuts.

A document's bytes are cut into tokens by a byte-level vocabulary (A) and by pieces (B). Where tokens of both end, the
document falls into groups. They are found by divide and conquer: in a stretch of tokens that begins and ends together,
the ends of A's tokens are tried from the middle outwards and looked up among B's ends by bisection; the first that both
share cuts the stretch in two, and a stretch without a shared end is a group. All stretches of a level, of all documents
of a run, are looked up together in numpy. Long texts go segment by segment: before a space that follows a character
which is no white space both tokenizers cut.

Tokens that end a group together are linked. Both hold the bytes before their common end, so the shorter is the end of
the longer: the pairs of ids that can ever be linked follow from the vocabularies alone (some hundred thousand for the
public ones), and so does the size of the table of their counts, which alone is broadcast.

Defined cases: null and empty text, and text that the joined bytes of either side don't give back (white space signs of
the pieces in it), have no tokens, no groups and an empty digest; the strings of special tokens are plain text; repeated
rows are aligned each; an empty table gives no rows; only the `keep`
columns are carried over, and one with the name of a result gives way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm import packing, pieces
from tideline.llm.words import carried, pack, unpack
from tideline.session import cut

#: Characters of a segment of a text, and of the segments that are aligned together.
SEGMENT = RUN = 1 << 19


@dataclass
class Run:
    """Tokens of several segments end to end, and where their groups end."""

    a: np.ndarray  # ids
    b: np.ndarray
    a_ends: np.ndarray  # number of tokens up to the end of each group
    b_ends: np.ndarray
    a_cuts: np.ndarray  # number of tokens up to the end of each segment
    b_cuts: np.ndarray


@dataclass
class Document:
    row: int
    n_a: int = 0
    n_b: int = 0
    whole: bool = True
    runs: list = field(default_factory=list)


def shared_cuts(a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens up to the end of every group, on both sides, from the byte ends of the tokens and the ends of segments."""
    low_a, high_a = np.append(0, a_cuts[:-1]), a_cuts
    low_b, high_b = np.append(0, b_cuts[:-1]), b_cuts
    done = []
    while len(low_a):
        # A stretch of one token on either side can't be cut.
        single = (high_a - low_a == 1) | (high_b - low_b == 1)
        done.append((high_a[single], high_b[single]))
        low_a, high_a, low_b, high_b = (x[~single] for x in (low_a, high_a, low_b, high_b))
        middle = (low_a + high_a - 2) >> 1  # the last token that may end a left part is high - 2
        at_a, at_b = np.full(len(low_a), -1), np.zeros(len(low_a), np.int64)
        open_, away = np.arange(len(low_a)), 0
        while len(open_):
            for place in (middle[open_] + away, middle[open_] - away)[: 2 if away else 1]:
                inside = (place >= low_a[open_]) & (place < high_a[open_] - 1) & (at_a[open_] < 0)
                own, place = open_[inside], place[inside]
                end = a[place]
                found = np.searchsorted(b, end)
                hit = b[found] == end
                at_a[own[hit]], at_b[own[hit]] = place[hit] + 1, found[hit] + 1
            away += 1
            more = (at_a[open_] < 0) & ((middle[open_] + away < high_a[open_] - 1) | (middle[open_] - away >= low_a[open_]))
            open_ = open_[more]
        leaf = at_a < 0
        done.append((high_a[leaf], high_b[leaf]))
        low_a, high_a, low_b, high_b, at_a, at_b = (x[~leaf] for x in (low_a, high_a, low_b, high_b, at_a, at_b))
        low_a, high_a = np.concatenate((low_a, at_a)), np.concatenate((at_a, high_a))
        low_b, high_b = np.concatenate((low_b, at_b)), np.concatenate((at_b, high_b))
        order = np.argsort(low_a, kind="stable")  # look-ups in order stay in the cache
        low_a, high_a, low_b, high_b = (x[order] for x in (low_a, high_a, low_b, high_b))
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends_a, ends_b = (np.concatenate(x) for x in zip(*done, strict=True))
    return np.sort(ends_a), np.sort(ends_b)


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """A space and the text, in parts that both tokenizers cut anyway; each begins with a space."""
    text, at = " " + text, 0
    while at < len(text):
        end = at + size
        while 0 < (end := text.find(" ", end)) and text[end - 1].isspace():
            end += 1
        end = len(text) if end < 0 or end == len(text) - 1 else end  # a space alone would be no text
        yield text[at:end]
        at = end


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the id pairs that can be linked."""

    def __init__(self, vocabulary: str, model: str):
        self.first = packing.Encoder(vocabulary)
        self.second = pieces.encoder(model, ("merges",))
        raw = self.first.raw
        self.a_raw = [raw.decode_single_token_bytes(i) for i in range(raw.max_token_value + 1)]
        self.b_raw = self.second.pieces.raw
        self.a_size, self.b_size = (np.array([len(x) for x in raw], np.int64) for raw in (self.a_raw, self.b_raw))
        self.pairs = possible_pairs(self.a_raw, self.b_raw)
        # The text of every id with the sign after it: , within a side, | after A's last, ; after B's last.
        self.text = [f"{i}{sign}".encode() for n, signs in ((len(self.a_raw), ",|"), (len(self.b_raw), ",;")) for i in range(n) for sign in signs]

    def tokens(self, segments: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Ids of both sides of every segment, and whether both give it back."""
        b_raw = self.b_raw
        for segment, (raw,) in zip(segments, self.second.encode([s[1:] for s in segments]), strict=True):
            a, b = np.frombuffer(self.first._plain(segment), "<u4").astype(np.int64), np.frombuffer(raw, "<i4").astype(np.int64)
            source = segment.encode()
            yield a, b, int(self.a_size[a].sum()) == len(source) and b"".join([b_raw[i] for i in b.tolist()]) == source

    def align(self, tokens: list[tuple[np.ndarray, np.ndarray]]) -> Run:
        a, b = (np.concatenate(x) for x in zip(*tokens, strict=True))
        a_cuts, b_cuts = (np.cumsum([len(t[k]) for t in tokens]) for k in (0, 1))
        ends = shared_cuts(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), a_cuts, b_cuts)
        return Run(a, b, *ends, a_cuts, b_cuts)

    def links(self, run: Run) -> np.ndarray:
        """Place of every group's linked pair among the possible ones."""
        key = run.a[run.a_ends - 1] * len(self.b_raw) + run.b[run.b_ends - 1]
        return np.searchsorted(self.pairs, key).astype(np.uint32)

    def spelled(self, run: Run) -> list[bytes]:
        """Texts of all ids in the order of the groups, A's before B's, with the signs between them."""
        n_a, n_b = np.diff(run.a_ends, prepend=0), np.diff(run.b_ends, prepend=0)
        code_a, code_b = 2 * run.a, 2 * (run.b + len(self.a_raw))
        code_a[run.a_ends - 1] += 1
        code_b[run.b_ends - 1] += 1
        codes = np.empty(len(run.a) + len(run.b), np.int64)
        codes[np.arange(len(run.a)) + np.repeat(run.b_ends - n_b, n_a)] = code_a
        codes[np.arange(len(run.b)) + np.repeat(run.a_ends, n_b)] = code_b
        text = self.text
        return [text[c] for c in codes.tolist()]


def possible_pairs(a_raw: list[bytes], b_raw: list[bytes]) -> np.ndarray:
    """Sorted a * (number of B ids) + b of all pairs of which one is the end of the other."""
    out, n = [], len(b_raw)
    by_a, by_b = {}, {}
    for raw, by in ((a_raw, by_a), (b_raw, by_b)):
        for i, x in enumerate(raw):
            if x:
                by.setdefault(x, []).append(i)
    for x, ids in by_a.items():
        out += [a * n + b for k in range(len(x)) for b in by_b.get(x[k:], ()) for a in ids]
    for x, ids in by_b.items():
        out += [a * n + b for k in range(1, len(x)) for a in by_a.get(x[k:], ()) for b in ids]
    return np.unique(np.array(out, np.int64))


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(vocabulary: str, model: str) -> Aligner:
    if (vocabulary, model) not in _aligners:
        _aligners[vocabulary, model] = Aligner(vocabulary, model)
    return _aligners[vocabulary, model]


def _runs(column: pa.Array, own: Aligner) -> Iterator[tuple[list[tuple[int, bool | None]], Run | None]]:
    """Runs of segments: (row, whether it is the row's last) of each, and their alignment. A row without tokens has an
    entry (row, None), which comes after those of its segments if a later one is not given back."""
    held: list[tuple[int, bool | None, str]] = []
    failed: set[int] = set()

    def run() -> tuple[list[tuple[int, bool | None]], Run | None]:
        owners, tokens = [], []
        found = own.tokens([part for _, last, part in held if last is not None])
        for row, last, _ in held:
            if last is None:
                owners.append((row, None))
                continue
            a, b, whole = next(found)
            if row in failed:
                continue
            if whole:
                tokens.append((a, b))
            else:
                failed.add(row)
            owners.append((row, last if whole else None))
        held.clear()
        return owners, own.align(tokens) if tokens else None

    size = 0
    for row, x in enumerate(column):
        text = x.as_py()
        if not text:
            held.append((row, None, ""))
            continue
        parts = segments(text)
        part = next(parts)
        while part is not None:
            following = next(parts, None)
            held.append((row, following is None, part))
            size += len(part)
            if size >= RUN:
                yield run()
                size = 0
            part = following
    if held:
        yield run()


SUMMARY = ("n_a", "n_b", "n_groups")


def _documents(batch: pa.RecordBatch, own: Aligner) -> Iterator[tuple[int, list[int], bytes, str]]:
    """(row, number of A's tokens, B's tokens and groups, packed links, digest) of every row of a batch."""
    digest, n, links = hashlib.sha256(), [0, 0, 0], []
    for owners, run in _runs(batch.column("_text"), own):
        if run is not None:
            places, spelled = own.links(run), own.spelled(run)
            g_cuts = np.searchsorted(run.a_ends, run.a_cuts, side="right").tolist()
            a_cuts, b_cuts = run.a_cuts.tolist(), run.b_cuts.tolist()
        k = a0 = b0 = g0 = 0
        for row, last in owners:
            if last is None:
                digest, n, links = hashlib.sha256(), [0, 0, 0], []
                yield row, n, pack(np.zeros(0, np.uint32)), ""
                continue
            a1, b1, g1 = a_cuts[k], b_cuts[k], g_cuts[k]
            text = b"".join(spelled[a0 + b0 : a1 + b1])
            digest.update(text[:-1] if last else text)
            links.append(places[g0:g1])
            n = [n[0] + a1 - a0, n[1] + b1 - b0, n[2] + g1 - g0]
            k, a0, b0, g0 = k + 1, a1, b1, g1
            if last:
                yield row, n, pack(np.concatenate(links)), digest.hexdigest()
                digest, n, links = hashlib.sha256(), [0, 0, 0], []


def _texts(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    names = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    return docs.select(*names, F.col(text).alias("_text"))


def _schema(docs: DataFrame, keep: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)])


def aligned(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = "byte_bpe_50k", model: str = "piece_bpe_32k.model") -> DataFrame:
    """One row per group: its place in the document and the ids of both sides; documents without tokens have none."""
    keep = carried(keep, ("place", "a_ids", "b_ids"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(vocabulary, model)
        ids = lambda x, ends: pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(x.astype(np.int32)))
        for batch in batches:
            # A row that fails may do so after some of its segments; only rows that are whole count.
            failed = {row for owners, _ in _runs(batch.column("_text"), own) for row, last in owners if last is None}
            place = 0
            for owners, run in _runs(batch.column("_text"), own):
                if run is None:
                    continue
                groups = np.diff(np.searchsorted(run.a_ends, run.a_cuts, side="right"), prepend=0).tolist()
                rows, places = [], []
                for (row, last), g in zip([x for x in owners if x[1] is not None], groups, strict=True):
                    rows += [row] * g
                    places += range(place, place + g)
                    place = 0 if last else place + g
                ok = pa.array([r not in failed for r in rows])
                kept = batch.select(batch.schema.names[:-1]).take(pa.array(rows, pa.int64()))
                whole = pa.RecordBatch.from_arrays([*kept.columns, pa.array(places, pa.int32()), ids(run.a, run.a_ends), ids(run.b, run.b_ends)], [*kept.schema.names, "place", "a_ids", "b_ids"])
                yield whole.filter(ok)
            own.first.cache.clear()

    ids_type = T.ArrayType(T.IntegerType())
    schema = _schema(docs, keep).add("place", T.IntegerType()).add("a_ids", ids_type).add("b_ids", ids_type)
    return _texts(docs, text, keep).mapInArrow(each, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def profile(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = "byte_bpe_50k", model: str = "piece_bpe_32k.model") -> DataFrame:
    """Tokens, groups and links of every document, how common its links are in all documents, and its groups' digest."""
    spark, keep = docs.sparkSession, carried(keep, (*SUMMARY, "n_links", "n_best", "count_sum", "groups_sha256"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(vocabulary, model)
        with own.second:
            try:
                for batch in batches:
                    rows, n, links, digests = zip(*_documents(batch, own), strict=True) if batch.num_rows else ((), (), (), ())
                    kept = batch.select(batch.schema.names[:-1]).take(pa.array(rows, pa.int64()))
                    numbers = [pa.array([x[k] for x in n], pa.int64()) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([*kept.columns, *numbers, pa.array(links, pa.binary()), pa.array(digests, pa.string())], [*kept.schema.names, *SUMMARY, "links", "groups_sha256"])
            finally:
                own.first.cache.clear()

    schema = _schema(docs, keep)
    for name in SUMMARY:
        schema = schema.add(name, "long")
    table = cut(_texts(docs, text, keep).mapInArrow(each, schema.add("links", "binary").add("groups_sha256", "string")))
    shared = spark.sparkContext.broadcast(link_counts(table, vocabulary, model))

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = shared.value
        for batch in batches:
            own = [np.frombuffer(unpack(x), np.uint32) for x in batch.column("links")]
            figures = [[len(x) for x in own], [int(best[x].sum()) for x in own], [int(counts[x].sum()) for x in own]]
            kept = batch.select([c for c in batch.schema.names if c != "links"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(x, pa.int64()) for x in figures)], [*kept.schema.names, "n_links", "n_best", "count_sum"])

    out = T.StructType([f for f in table.schema.fields if f.name != "links"])
    for name in ("n_links", "n_best", "count_sum"):
        out = out.add(name, "long")
    done = table.mapInArrow(rated, out).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})
    return done.select(*keep, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def link_counts(table: DataFrame, vocabulary: str, model: str) -> tuple[np.ndarray, np.ndarray]:
    """How many links hold each possible pair, over all documents, and whether that is its B id's highest. Both arrays
    are as long as the list of possible pairs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(aligner(vocabulary, model).pairs), np.int64)
        for batch in batches:
            for x in batch.column(0):
                links = np.frombuffer(unpack(x), np.uint32)
                np.add.at(total, links, 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])

    found = table.select("links").mapInArrow(each, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = aligner(vocabulary, model)
    counts = np.zeros(len(pairs.pairs), np.int64)
    counts[found["pair"].to_numpy()] = found["n"].to_numpy()
    b = pairs.pairs % len(pairs.b_raw)
    most = np.zeros(len(pairs.b_raw), np.int64)
    np.maximum.at(most, b, counts)
    return counts, counts == most[b]

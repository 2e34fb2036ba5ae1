"""SimHash near-duplicates by a binary trie joined with itself.

A fingerprint has a bit set where over half the hashes of a text's word shingles (repeats counted) have it set. Distinct
fingerprints are the leaves of a binary trie, and the trie is joined with itself: pairs of nodes are visited together
from the root down, the bits in which the two paths differ are added up, and a pair is dropped with all below it once
they exceed the budget. Copies have one fingerprint and are one leaf.

To share the work out, the trie is planted once for each of budget + 1 rotations of the fingerprints. Two that differ in
at most `budget` bits agree in one of budget + 1 disjoint stretches, so each trie only keeps the node pairs whose first
stretch agrees, and the others are left to another rotation: a fingerprint is sent once per rotation and not once per
neighbour of its prefix. Nodes with more than LEAF leaves are split on Spark, STEP bits at a time, by the same rule:
counted children are paired, their differing bits added, and pairs beyond the budget dropped. What remains are pairs of
nodes that fit a task, where numpy carries on the descent, a batch of node pairs at a time. A task joins its links to
stars before it emits them, at most one a leaf.

Defined cases: null text and text without words have fingerprint zero, which links like any other; fewer words than the
shingle width count as one shingle; rows that repeat a doc_id, or have none, are each judged on their own text; a null
doc_id never names a component unless all its members are null; an empty table gives no rows; other columns are not
carried over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.neardup import components
from tideline.llm.words import LOWER
from tideline.session import broadcast_if_small, cut

BITS = 64
SEED = 42
#: Most leaves of a node that goes to a task whole, and the levels that a split on Spark goes down at once.
LEAF, STEP = 16384, 4
#: Leaves that a task gathers before it joins them, node pairs that go down together, and compared pairs at a time.
CHUNK, FRONTIER, PAIRS = 1 << 16, 1 << 16, 1 << 20
#: Node pairs with at most so many pairs of leaves are compared leaf by leaf.
DIRECT = 64
BLOCK = 1 << 20
GAP = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of a text, block by block, so that a long text is never all words at once."""
    digest, carry, at, found = xxhash.xxh64_intdigest, [], 0, False
    while at < len(text):
        end = len(text)
        if end - at > BLOCK and (gap := GAP.search(text, at + BLOCK)):
            end = gap.start()
        words = carry + text[at:end].translate(LOWER).split()
        at = end
        if len(words) < width:
            carry = words
            continue
        joined, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
        spans = zip([0, *ends], ends[width - 1 :])
        yield np.array([digest(joined[a : b - 1], SEED) for a, b in spans], np.uint64)
        found, carry = True, words[len(words) - width + 1 :]
    if carry and not found:
        yield np.array([digest(b" ".join(carry), SEED)], np.uint64)


def fingerprint_of(text: bytes | None, width: int) -> bytes:
    """The 64 majority bits, most significant first, as 8 bytes."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text or b"", width):
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(h)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and node, the fingerprint as 8 bytes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [fingerprint_of(t.as_py(), width) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary())], ["doc_id", "node"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(each, f"doc_id {kind}, node binary")


# Within a task


def turned(values: np.ndarray, left: np.ndarray | int) -> np.ndarray:
    """Rotation to the left."""
    left = np.asarray(left, np.uint64)
    return values << left | values >> (np.uint64(BITS) - left) % np.uint64(BITS)


def split(leaves: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """First leaf of each node [low, high) with the bit set; the leaves of a node are sorted and agree above it."""
    low, high = low.copy(), high.copy()
    while len(open_ := np.flatnonzero(low < high)):
        mid = (low[open_] + high[open_]) >> 1
        one = (leaves[mid] >> bit[open_]) & np.uint64(1) == 1
        high[open_[one]] = mid[one]
        low[open_[~one]] = mid[~one] + 1
    return low


def products(na: np.ndarray, nb: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, i, j) of all leaves i < na and j < nb of every pair, about PAIRS at a time."""
    size = na * nb
    ends = np.cumsum(size)
    first = 0
    while first < len(size):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
        own = np.repeat(np.arange(first, last), size[first:last])
        k = np.arange(len(own)) - np.repeat(ends[first:last] - size[first:last] - before, size[first:last])
        yield own, k // nb[own], k % nb[own]
        first = last


def near_pairs(leaves: np.ndarray, pairs: tuple[np.ndarray, ...], budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of leaves within the budget, below node pairs (low, high, low, high, level, differing bits).

    A node paired with itself has the same ends twice. Pairs wait on a stack and go down FRONTIER at a time, so the
    memory is that of the levels and not of the trie."""
    waiting = [pairs]
    while waiting:
        la, ha, lb, hb, level, diff = waiting.pop()
        if len(la) > FRONTIER:
            waiting.append(tuple(x[FRONTIER:] for x in (la, ha, lb, hb, level, diff)))
            la, ha, lb, hb, level, diff = (x[:FRONTIER] for x in (la, ha, lb, hb, level, diff))
        few = ((ha - la) * (hb - lb) <= DIRECT) | (level >= BITS)
        if few.any():
            a, b = la[few], lb[few]
            for own, i, j in products(ha[few] - a, hb[few] - b):
                x, y = a[own] + i, b[own] + j
                near = (x != y) & (np.bitwise_count(leaves[x] ^ leaves[y]) <= budget)
                yield x[near], y[near]
        la, ha, lb, hb, level, diff = (x[~few] for x in (la, ha, lb, hb, level, diff))
        if not len(la):
            continue
        bit = (BITS - 1 - level).astype(np.uint64)
        ma, mb = split(leaves, la, ha, bit), split(leaves, lb, hb, bit)
        self_ = la == lb
        children = [(la, ma, lb, mb, 0, None), (ma, ha, mb, hb, 0, None), (la, ma, mb, hb, 1, None), (ma, ha, lb, mb, 1, self_)]
        parts = []
        for a0, a1, b0, b1, more, without in children:
            ok = (a0 < a1) & (b0 < b1) & (diff + more <= budget)
            if without is not None:
                ok &= ~without
            parts.append((a0[ok], a1[ok], b0[ok], b1[ok], level[ok] + 1, diff[ok] + more))
        waiting.append(tuple(np.concatenate(x) for x in zip(*parts, strict=True)))


def join_labels(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after linking positions: every label is the least position that it reaches."""
    while len(x):
        a, b = label[x], label[y]
        open_ = a != b
        x, y, a, b = x[open_], y[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (further := label[label]).tobytes() != label.tobytes():
            label = further
    return label


def _stars_of(rows: pa.Table, budget: int, stretch: int) -> pa.RecordBatch:
    """Links of whole units, rows sorted by unit, side and leaf, as stars between fingerprints."""
    turn, level, a, b, side, diff = (rows[c].to_numpy() for c in ("turn", "level", "a", "b", "side", "diff"))
    leaves = rows["leaf"].to_numpy().view(np.uint64)
    new = np.ones(len(rows), bool)
    new[1:] = (turn[1:] != turn[:-1]) | (level[1:] != level[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows))
    middle = first + np.add.reduceat(side == 0, first)
    whole = a[first] == b[first]
    pairs = (first, np.where(whole, last, middle), np.where(whole, first, middle), last, level[first].astype(np.int64), diff[first].astype(np.int64))
    # One leaf is many rows where its node is in many pairs; it has one label.
    own = turned(leaves, (BITS - turn * stretch) % BITS)
    names, position = np.unique(own, return_inverse=True)
    label = np.arange(len(names))
    for x, y in near_pairs(leaves, pairs, budget):
        label = join_labels(label, position[x], position[y])
    moved = np.flatnonzero(label != np.arange(len(names)))
    raw = lambda at: pa.Array.from_buffers(pa.binary(8), len(at), [None, pa.py_buffer(names[at].astype(">u8").tobytes())]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([raw(label[moved]), raw(moved)], ["a", "b"])


# On Spark


def _prefix(level: int) -> Column:
    return F.shiftrightunsigned("leaf", BITS - level)


def units(leaves: DataFrame, budget: int, stretch: int, leaf: int = LEAF) -> DataFrame:
    """Rows (turn, level, a, b, diff, side, leaf): the leaves of every pair of nodes a <= b that a task joins.

    Level by level: children of crowded nodes are counted, paired below the pairs of their parents, and dropped once
    they differ in too many bits.
    """
    pair = ["turn", "a", "b", "diff"]
    nodes = leaves.withColumn("a", _prefix(stretch))
    counts = nodes.groupBy("turn", "a").count()
    crowded = cut(counts.where(F.col("count") > leaf).select("turn", "a", F.col("a").alias("b"), F.lit(0).alias("diff")))
    small = broadcast_if_small(crowded.select("turn", "a"), 16)
    plain = nodes.join(small, ["turn", "a"], "left_anti")
    found = plain.select("turn", F.lit(stretch).alias("level"), "a", F.col("a").alias("b"), F.lit(0).alias("diff"), F.lit(0).alias("side"), "leaf")
    level = stretch
    while not crowded.isEmpty():
        either = crowded.select("turn", F.explode(F.array("a", "b")).alias("a")).distinct()
        inside = leaves.withColumn("a", _prefix(level)).join(broadcast_if_small(cut(either), 16), ["turn", "a"], "left_semi")
        step = min(STEP, BITS - level)
        children = cut(inside.groupBy("turn", "a", _prefix(level + step).alias("child")).agg(F.count("*").alias("n")))
        left = children.select("turn", "a", F.col("child").alias("ca"), F.col("n").alias("na"))
        right = children.select("turn", F.col("a").alias("b"), F.col("child").alias("cb"), F.col("n").alias("nb"))
        more = F.bit_count(F.col("ca").bitwiseXOR(F.col("cb")).bitwiseAND(F.lit((1 << step) - 1).cast("long")))
        below = crowded.join(left, ["turn", "a"]).join(right, ["turn", "b"]).where((F.col("a") != F.col("b")) | (F.col("ca") <= F.col("cb")))
        below = below.withColumn("diff", F.col("diff") + more).where(F.col("diff") <= budget)
        below = cut(below.select("turn", F.col("ca").alias("a"), F.col("cb").alias("b"), "diff", F.greatest("na", "nb").alias("n")))
        level += step
        big = (F.col("n") > leaf) & F.lit(level < BITS)
        crowded = cut(below.where(big).select(*pair))
        ready = broadcast_if_small(cut(below.where(~big).select(*pair)), 32)
        at = leaves.withColumn("at", _prefix(level))
        for side, end in enumerate("ab"):
            own = ready if end == "a" else ready.where("a <> b")
            rows = at.join(own, (at["turn"] == own["turn"]) & (at["at"] == own[end]))
            found = found.unionByName(rows.select(at["turn"], F.lit(level).alias("level"), "a", "b", "diff", F.lit(side).alias("side"), "leaf"))
    return found


def trie_links(nodes: DataFrame, budget: int = 3, leaf: int = LEAF) -> DataFrame:
    """(a, b): links between distinct fingerprints `node` that join all that differ in at most `budget` bits; not every
    pair, but enough to connect what pairs connect."""
    turns = budget + 1
    stretch = BITS // turns

    def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u8").astype(np.uint64)
            turn = np.repeat(np.arange(turns), len(values))
            rows = turned(np.tile(values, turns), turn * stretch).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(turn, pa.int32()), pa.array(rows)], ["turn", "leaf"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < CHUNK:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            last = [table[c].to_numpy() for c in ("turn", "level", "a", "b")]
            same = np.logical_and.reduce([x == x[-1] for x in last])
            done = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last unit may go on
            if done:
                yield _stars_of(table.slice(0, done), budget, stretch)
            held = table.slice(done).to_batches()
            size = table.num_rows - done
        if size:
            yield _stars_of(pa.Table.from_batches(held).combine_chunks(), budget, stretch)

    leaves = cut(nodes.select("node").mapInArrow(planted, "turn int, leaf long"))
    unit = ["turn", "level", "a", "b"]
    rows = units(leaves, budget, stretch, leaf).repartition(*unit).sortWithinPartitions(*unit, "side", "leaf")
    return rows.mapInArrow(joined, "a binary, b binary")


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id that links reach)."""
    prints = cut(fingerprints(docs, width, text, doc_id))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    nodes = cut(prints.groupBy("node").agg(first))
    labels = components(cut(trie_links(nodes, budget)))
    named = nodes.join(broadcast_if_small(labels, 48), "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = named.groupBy("label").agg(F.min("first").alias("least")).select("label", F.col("least.doc_id").alias("component_id"))
    whose = cut(named.join(names, "label").select("node", "component_id"))
    out = prints.join(broadcast_if_small(whose, 32), "node")
    return out.select("doc_id", F.lower(F.hex("node")).alias("fingerprint"), "component_id")

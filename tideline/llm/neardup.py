"""Near-duplicates: fast similarity sketches, banding, and confirmation on full shingle sets.

A document's set holds the hashes of its distinct word shingles. Its sketch has one coordinate per bin. In round i
every shingle falls into one hashed bin with value (i, hash) and a bin keeps its least value; after as many rounds as
there are bins, round i sends every shingle to bin i instead, so each coordinate is filled for certain. Almost always
two or three rounds do, whatever the set's size, which makes the sketch cost its set's size and not set times sketch.

Documents with equal sets are one node, so copies cost one row each. Coordinates are grouped into bands; nodes that
agree in a band share a bucket. The number of bands follows from the threshold: a pair at the threshold is missed with
probability `MISS` at most. Buckets are not expanded into pairs: in each round one hub per bucket is compared with the
members that are not in its component yet, links are confirmed on the full sets, and components are rebuilt. Buckets
that still hold several components after `STARS` rounds compare the members outside their largest component with all
others, so every candidate pair is either confirmed, refuted, or already connected.

Defined cases: null or wordless text is an empty set, linked with nothing; fewer words than the shingle width count
as one shingle; rows that repeat a doc_id are each given their set's component; a null doc_id never names a
component unless all its members are null; an empty table gives no rows; other columns are not carried over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.words import ID, TEXT, boxed, chain, mix, runs, unboxed, word_hashes
from tideline.session import broadcast_if_small, cut

ROWS = 5
MISS = 1e-7
STARS = 2
LINKS_PER_TASK = 250_000


def bands_for(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log1p(-(similarity**rows)))


def shingle_sets(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes, set after set, and the size of each set."""
    hashes, n = word_hashes(texts)
    ends = np.cumsum(n)
    starts = ends - n
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(texts)), count)
    first = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts, count)
    short = (n < width) & (n > 0)
    out = np.zeros(len(doc), np.uint64)
    long_rows = ~short[doc]
    at = first[long_rows]
    if len(at):
        out[long_rows] = chain([hashes[at + k] for k in range(width)])
    for i in np.flatnonzero(short):
        out[doc == i] = chain([hashes[starts[i] + k : starts[i] + k + 1] for k in range(n[i])])
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[new], np.bincount(doc[new], minlength=len(texts))


def sketches(flat: np.ndarray, sizes: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketches of several sets at once: rows of `bins` coordinates; empty sets stay unfilled."""
    n = len(sizes)
    empty = np.uint64(2**64 - 1)
    out = np.full(n * bins, empty, np.uint64)
    doc = np.repeat(np.arange(n), sizes)
    for i in range(2 * bins):
        h = mix(flat + np.uint64((i * 0x9E3779B97F4A7C15 + 0x1234567) % 2**64))
        low = (h & np.uint64(2**40 - 1)) | np.uint64(i << 40)
        bin_ = ((h >> np.uint64(40)) * np.uint64(bins) >> np.uint64(24)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(out, doc * bins + bin_, low)
        open_ = (out.reshape(n, bins) == empty).any(1)
        rest = open_[doc]
        if not rest.any():
            break
        flat, doc = flat[rest], doc[rest]
    return out.reshape(n, bins)


def band_keys(coordinates: np.ndarray, rows: int) -> np.ndarray:
    n, bins = coordinates.shape
    parts = coordinates.reshape(n, bins // rows, rows)
    return chain([parts[:, :, k] for k in range(rows)] + [np.broadcast_to(np.arange(bins // rows, dtype=np.uint64), parts.shape[:2])])


def digests(flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes)
    return [xxhash.xxh3_128_digest(flat[e - s : e].tobytes()) for s, e in zip(sizes, ends, strict=True)]


def signatures(docs: DataFrame, width: int, similarity: float, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, a hash of the text, size of the shingle set, its 128-bit digest `node` (null if empty) and band keys."""
    bands = bands_for(similarity)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in runs(batch.column(1)):
                flat, sizes = shingle_sets(texts, width)
                keys = band_keys(sketches(flat, sizes, bands * ROWS), ROWS).astype(np.int64)
                nodes = [d if s else None for d, s in zip(digests(flat, sizes), sizes, strict=True)]
                offsets = pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        batch.column(2).slice(at, len(texts)),
                        pa.array(sizes),
                        pa.array(nodes, pa.binary()),
                        pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
                    ],
                    ["doc_id", "h", "n", "node", "bands"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h")).mapInArrow(
        each, f"doc_id {kind}, h long, n long, node binary, bands array<long>"
    )


def full_sets(docs: DataFrame, nodes: DataFrame, width: int, text: str, doc_id: str) -> DataFrame:
    """The shingle sets of the given nodes, read again from one document of each."""
    ids = broadcast_if_small(nodes.select(F.col("first_doc").alias("_id")), 16)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    few = own.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in runs(batch.column(0)):
                flat, sizes = shingle_sets(texts, width)
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                sets = pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(digests(flat, sizes), pa.binary()), sets], ["node", "shingles"])

    sets = few.mapInArrow(each, "node binary, shingles array<long>")
    return sets.join(broadcast_if_small(nodes.select("node"), 24), "node", "left_semi").dropDuplicates(["node"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one partition as links to the least node that they reach within it: the same components, and at most
    one link per node, before anything is shuffled."""
    parent: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    out = [(x, find(x)) for x in list(parent)]
    a, b = zip(*out, strict=True) if out else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node with a link. Each round every node moves to the neighbour (or itself) that is least
    in a random order of that round (in the first, least by name, which settles stars), and links between moved nodes
    stay; a constant share of nodes goes each time."""
    spark = links.sparkSession
    steps: list[DataFrame] = []
    edges, count = links.select("a", "b"), links.count()
    while count:
        # Few links lie in few partitions, where one pass joins most of them; many stay spread out.
        edges = cut(edges.coalesce(1 + count // LINKS_PER_TASK).mapInArrow(_stars, "a binary, b binary"))
        order = F.xxhash64("u", F.lit(len(steps))) if steps else F.lit(0)
        ends = edges.select(F.explode(F.array(*[F.struct(F.col(v).alias("v"), F.col(u).alias("u")) for v in "ab" for u in "ab"])).alias("e")).select("e.*")
        step = cut(ends.groupBy("v").agg(F.min(F.struct(order.alias("o"), "u")).alias("least")).select("v", F.col("least.u").alias("p")))
        steps.append(step)
        a = broadcast_if_small(step.select(F.col("v").alias("a"), F.col("p").alias("pa")), 48)
        b = broadcast_if_small(step.select(F.col("v").alias("b"), F.col("p").alias("pb")), 48)
        edges = edges.join(a, "a").join(b, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        edges = cut(edges)
        count = edges.count()
    if not steps:
        return spark.createDataFrame([], "node binary, label binary")
    labels = steps[0].select(F.col("v").alias("node"), F.col("p").alias("label"))
    for step in steps[1:]:
        labels = labels.join(broadcast_if_small(step.withColumnRenamed("v", "label"), 48), "label", "left").select("node", F.coalesce("p", "label").alias("label"))
    return cut(labels)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough: 100 * intersection >= percent * union."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    both = pairs.join(b, "b").join(a, "a").select("a", "b", shared.alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
    return both.where(F.lit(100) * F.col("i") >= F.lit(percent) * (F.col("n") - F.col("i"))).select("a", "b")


def linked(nodes: DataFrame, docs: DataFrame, width: int, percent: int, text: str, doc_id: str) -> DataFrame:
    """(node, label): the component of every node that has a link."""
    spark = nodes.sparkSession
    rows = nodes.select("node", "n", "first_doc", F.explode("bands").alias("key"))
    # One row a bucket, broadcast while buckets are few, so that no task gathers a crowded bucket.
    busy = broadcast_if_small(cut(rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")), 8)
    members = cut(rows.join(busy, "key"))
    wanted = cut(members.select("node", "first_doc").distinct())
    members = members.drop("first_doc")
    sets = cut(full_sets(docs, wanted, width, text, doc_id))
    close = F.lit(100) * F.least("n", "hub.n") >= F.lit(percent) * F.greatest("n", "hub.n")
    ordered = F.struct(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))
    links, labels = spark.createDataFrame([], "a binary, b binary"), None
    for star in range(STARS):
        at = _labelled(members, labels)
        hub = F.min(F.struct(F.xxhash64("node", F.lit(star)).alias("o"), "node", "n", "label")).alias("hub")
        hubs = at.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), hub).where("lo <> hi").select("key", "hub")
        hubs = broadcast_if_small(cut(hubs), 72)
        pairs = at.join(hubs, "key").where((F.col("label") != F.col("hub.label")) & close).select(ordered.alias("p")).select("p.*").distinct()
        found = cut(confirmed(pairs, sets, percent))
        if found.isEmpty():
            continue
        links = links.union(found)
        labels = components(links)
    at = _labelled(members, labels)
    mixed = at.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    at = cut(at.join(broadcast_if_small(cut(mixed), 8), "key"))
    if not at.isEmpty():
        found = cut(across(at, sets, percent))
        if not found.isEmpty():
            labels = components(links.union(found))
    return labels if labels is not None else spark.createDataFrame([], "node binary, label binary")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("node"))
    return members.join(broadcast_if_small(labels, 48), "node", "left").withColumn("label", F.coalesce("label", "node"))


BLOCK = 1024


def across(at: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components that share a bucket, one per pair of components and block at most.

    Buckets that share nodes form a family, so that a pair is looked at once and not once per band. The members outside
    a family's largest component are a query set against all its members, block by block; pairs are counted inside a
    task and never emitted.
    """
    # A bucket is a node of its own here, named by its key in decimal digits.
    families = components(at.select(F.col("node").alias("a"), F.encode(F.col("key").cast("string"), "utf-8").alias("b")))
    families = broadcast_if_small(families.withColumnRenamed("label", "family"), 48)
    rows = cut(at.select("node", "label").distinct().join(families, "node"))
    main = rows.groupBy("family", "label").agg(F.count("*").alias("c")).groupBy("family")
    main = main.agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("size")).select("family", F.col("m.label").alias("main"), F.ceil(F.col("size") / BLOCK).alias("blocks"), F.ceil((F.col("size") - F.col("m.c")) / BLOCK).alias("asks"))
    rows = rows.join(broadcast_if_small(cut(main), 64), "family").withColumn("ask", F.col("label") != F.col("main")).join(sets, "node")
    place = lambda n: F.pmod(F.xxhash64("node"), n)
    to_all = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    kept = ["family", "node", "label", "shingles"]
    asked = rows.select(*kept, place(F.col("blocks")).alias("block"), to_all(F.col("asks")).alias("part"), F.lit(False).alias("ask"))
    asking = rows.where("ask").select(*kept, to_all(F.col("blocks")).alias("block"), place(F.col("asks")).alias("part"), F.lit(True).alias("ask"))

    def compare(table: pa.Table) -> pa.Table:
        ask = table["ask"].to_numpy(zero_copy_only=False)
        nodes, labels = table["node"].to_pylist(), table["label"].to_pylist()
        sizes = np.array([len(x) for x in table["shingles"]], np.int64)
        flat = np.concatenate([c.flatten().to_numpy() for c in table["shingles"].chunks])
        row = np.repeat(np.arange(len(nodes)), sizes)
        slot = np.where(ask, np.cumsum(ask) - 1, np.cumsum(~ask) - 1)
        shared = np.zeros((int(ask.sum()), int((~ask).sum())), np.int32)
        order = np.argsort(flat, kind="stable")
        flat, row = flat[order], row[order]
        new = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        asks = np.concatenate(([0], np.cumsum(ask[row])))
        ends = np.concatenate((new[1:], [len(flat)]))
        count = asks[ends] - asks[new]
        for i in np.flatnonzero((count > 0) & (count < ends - new)).tolist():
            mine = row[new[i] : ends[i]]
            is_ask = ask[mine]
            shared[np.ix_(slot[mine[is_ask]], slot[mine[~is_ask]])] += 1
        x, y = np.flatnonzero(ask), np.flatnonzero(~ask)
        union = sizes[x][:, None] + sizes[y][None, :] - shared
        out = {}
        for i, j in zip(*np.nonzero(100 * shared >= percent * union), strict=True):
            la, lb = labels[x[i]], labels[y[j]]
            if la != lb:
                out.setdefault((min(la, lb), max(la, lb)), (nodes[x[i]], nodes[y[j]]))
        a, b = zip(*out.values(), strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return asked.unionByName(asking).groupBy("family", "block", "part").applyInArrow(compare, "a binary, b binary")


def _marked(docs: DataFrame, width: int, percent: int, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, n, node) of every row, and (node, first_doc, label) of every distinct set."""
    marks = cut(signatures(docs, width, percent / 100, text, doc_id))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n", "bands")).alias("f")
    nodes = marks.where("n > 0").groupBy("node").agg(first)
    nodes = cut(nodes.select("node", F.col("f.doc_id").alias("first_doc"), F.col("f.n").alias("n"), F.col("f.bands").alias("bands")))
    labels = linked(nodes, docs, width, percent, text, doc_id)
    return marks, nodes.select("node", "first_doc").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id that links reach) and kept (it is its component's name)."""
    marks, named = _marked(docs, width, percent, text, doc_id)
    names = named.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    whose = named.join(names, "label").select("node", "component_id")
    out = marks.where("n > 0").select("doc_id", "n", "node").join(whose, "node").select("doc_id", "n", "component_id")
    out = out.unionByName(marks.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def survivors(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents with one of each component left: that of the least doc_id, of equal ids that of the least text hash.

    A row is told by doc_id and text, null ids after all others, so texts that share an id are judged each on its own.
    Repeated rows stay once if they have words; documents without words are linked with nothing and all stay.
    """
    marks, named = _marked(docs, width, percent, text, doc_id)
    rows = marks.where("n > 0").join(named.select("node", "label"), "node").select("label", "doc_id", "h")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    best = cut(rows.groupBy("label").agg(F.min(order).alias("best"), F.max(order).alias("last"), F.count("*").alias("rows")).where("rows > 1"))
    several = rows.join(broadcast_if_small(best.where("best <> last").select("label", "best"), 64), "label")
    gone = cut(several.where(order != F.col("best")).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct())
    same = lambda side: F.col(ID).eqNullSafe(side["_id"]) & (F.xxhash64(TEXT) == side["_h"])
    small = broadcast_if_small(gone, 24)
    left = boxed(docs, text, doc_id).join(small, same(small), "left_anti")
    # Rows given several times are found by their counts, so that only these are brought together.
    twice = best.select(F.col("best.doc_id").alias("doc_id"), F.col("best.h").alias("h"), "label")
    twice = rows.join(broadcast_if_small(twice, 64), ["label", "h"]).where(rows["doc_id"].eqNullSafe(twice["doc_id"])).groupBy(rows["doc_id"], "h").count().where("count > 1")
    twice = cut(twice.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")))
    if twice.isEmpty():
        return unboxed(left)
    small = broadcast_if_small(twice, 24)
    once = left.join(small, same(small), "left_semi").dropDuplicates([ID, TEXT])
    return unboxed(left.join(small, same(small), "left_anti").unionByName(once))

"""URL filters over a sorted digest array.

The rules' 64-bit xxhash keys lie sorted in one file that Spark ships to every executor (`addFile`); tasks memory-map
it, so that all Python workers of a machine share its pages. A batch of urls is turned into the strings that could
name a rule (every host suffix with every path prefix of a length that some rule has), the distinct ones are hashed
and looked up by one vectorised binary search, and hits count only if the stored string is equal.

The file is bounded by `max_index_bytes`; a larger rule table is joined instead (`judge_by_join`), with the same
result. Defined cases: null urls and urls without `://` have an empty host and path and fit no rule; an empty rule
table leaves everything to the default verdict; of two rules of equal length the one with the longer host wins;
a rule given twice counts with the verdict that sorts first; only A-Z are lower-cased; a kept column with the name of a
result gives way to it.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.words import carried

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_INDEX_BYTES = 256 << 20
RESULTS = ("host", "path", "rule", "verdict")


class Rule(NamedTuple):
    """`rule` is host and path in one, like `net/` or `example.net/en/`."""

    rule: str
    verdict: str


def parts(url) -> tuple:
    """Columns host and path of a url column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def split_rule(rule: str) -> tuple[str, str]:
    host, _, path = rule.partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)), "/" + path if "/" in rule else ""


def write_index(rules: Iterable[Rule], path: str) -> None:
    """One file: count and text size, then keys, string offsets, verdicts, the path lengths in use, and the strings."""
    best: dict[str, str] = {}
    for r in sorted(rules, key=lambda r: r.verdict):
        host, tail = split_rule(r.rule)
        best.setdefault(host + tail, r.verdict)
    names = sorted(best, key=lambda s: xxhash.xxh64_intdigest(s.encode()))
    raw = [s.encode() for s in names]
    verdicts = sorted(set(best.values()))
    lengths = np.array(sorted({len(split_rule(s)[1]) for s in names}), "<i8")
    said = "\0".join(verdicts).encode()
    head = np.array([len(raw), len(lengths), len(verdicts), len(said)], "<i8")
    with open(path, "wb") as f:
        f.write(head.tobytes())
        f.write(lengths.tobytes())
        f.write(np.array([xxhash.xxh64_intdigest(b) for b in raw], "<u8").tobytes())
        f.write(np.cumsum([0, *map(len, raw)], dtype="<i8").tobytes())
        f.write(np.array([verdicts.index(best[s]) for s in names], "<i8").tobytes())
        f.write(said)
        f.write(b"".join(raw) or b"\0")


class Index:
    """The memory-mapped file."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        n, k, v, said = (int(x) for x in data[:32].view("<i8"))
        at = 32
        self.lengths = data[at : at + 8 * k].view("<i8").tolist()
        at += 8 * k
        self.keys = data[at : at + 8 * n].view("<u8")
        at += 8 * n
        self.ends = data[at : at + 8 * (n + 1)].view("<i8")
        at += 8 * (n + 1)
        self.verdict = data[at : at + 8 * n].view("<i8")
        at += 8 * n
        self.verdicts = bytes(data[at : at + said]).decode().split("\0")[:v]
        self.text = data[at + said :]

    def find(self, names: list[str]) -> np.ndarray:
        """The rule of each name, or -1. Equal keys lie side by side; each is tried until its string is the name."""
        raw = [s.encode() for s in names]
        keys = np.fromiter((xxhash.xxh64_intdigest(b) for b in raw), np.uint64, len(raw))
        at = np.searchsorted(self.keys, keys)
        out = np.full(len(raw), -1, np.int64)
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys) if len(self.keys) else []):
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:
                if self.text[self.ends[j] : self.ends[j + 1]].tobytes() == raw[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def candidates(self, host: str, path: str) -> list[str]:
        """Names of rules that would fit, the winner first: by length, then by the host's."""
        suffixes = [host]
        while (dot := host.find(".")) >= 0:
            host = host[dot + 1 :]
            suffixes.append(host)
        tails = [path[:k] for k in self.lengths if k <= len(path)]
        return sorted((s + p for s in suffixes for p in tails), key=len, reverse=True)


_open: dict[str, Index] = {}


def _index(name: str) -> Index:
    if name not in _open:
        _open.clear()
        _open[name] = Index(SparkFiles.get(name))
    return _open[name]


def judge_urls(
    urls: DataFrame, rules: Iterable[Rule], url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow", max_index_bytes: int = MAX_INDEX_BYTES
) -> DataFrame:
    """`keep` columns with host, path, rule and verdict of every row."""
    rules, keep = list(rules), carried(keep, RESULTS)
    if sum(len(r.rule.encode()) + 24 for r in rules) > max_index_bytes:
        return judge_by_join(urls, urls.sparkSession.createDataFrame(rules, "rule string, verdict string"), url, keep, default)
    name = _ship(urls.sparkSession, rules)
    host, path = parts(F.col(url))
    base = urls.select(*keep, host.alias("host"), path.alias("path"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name)
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            distinct: dict[tuple[str, str], int] = {}
            which = [distinct.setdefault(x, len(distinct)) for x in zip(hosts, paths, strict=True)]
            tried = [index.candidates(*x) for x in distinct]
            names: dict[str, int] = {}
            for row in tried:
                for s in row:
                    names.setdefault(s, len(names))
            hit = index.find(list(names))
            verdicts = [default] * len(tried)
            found: list[str | None] = [None] * len(tried)
            for i, row in enumerate(tried):
                for s in row:
                    if (j := hit[names[s]]) >= 0:
                        found[i], verdicts[i] = s, index.verdicts[index.verdict[j]]
                        break
            extra = [pa.array([found[i] for i in which], pa.string()), pa.array([verdicts[i] for i in which], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "rule", "verdict"])

    schema = urls.select(*keep, host.alias("host"), path.alias("path")).schema.add("rule", "string").add("verdict", "string")
    return base.mapInArrow(judge, schema)


def _ship(spark: SparkSession, rules: list[Rule]) -> str:
    """Write the index once and have Spark copy it to every executor."""
    digest = xxhash.xxh64_hexdigest("2" + repr(sorted(rules)))
    name = f"url-rules-{digest}.bin"
    path = os.path.join(tempfile.gettempdir(), name)
    if not os.path.exists(path):  # written aside and moved, so that no other process sees half a file
        fd, aside = tempfile.mkstemp(prefix=name)
        os.close(fd)
        write_index(rules, aside)
        os.replace(aside, path)
    spark.sparkContext.addFile(path)
    return name


def judge_by_join(urls: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """The same verdicts for rule tables too large to ship: distinct candidate names meet the rules in an equi-join."""
    keep = carried(keep, RESULTS)
    host, path = parts(F.col(url))
    base = urls.select(*keep, host.alias("host"), path.alias("path"))
    full = F.concat(F.translate(F.regexp_extract("rule", r"^([^/]*)", 1), UPPER, LOWER), F.regexp_extract("rule", r"^[^/]*(.*)$", 1))
    known = rules.select(full.alias("rule"), "verdict").groupBy("rule").agg(F.min("verdict").alias("verdict"))
    pairs = base.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # Only lengths that some rule's path has; k of them take rules of k * k / 2 characters, so they are few.
    tail = F.length(F.regexp_extract("rule", r"^[^/]*(.*)$", 1)).alias("n")
    lengths = F.array(*[F.lit(r.n) for r in known.select(tail).distinct().collect()]).cast("array<int>")
    tails = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    tried = pairs.withColumn("suffix", F.explode(suffixes)).withColumn("tail", F.explode(tails))
    tried = tried.select("host", "path", F.concat("suffix", "tail").alias("rule"), F.length("suffix").alias("host_length"))
    best = (
        tried.join(known, "rule")
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.col("host_length"))).alias("best"))
    )
    return base.join(best, ["host", "path"], "left").select(
        *keep, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )

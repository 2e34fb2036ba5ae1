"""Secret scans: fixed patterns, and a likelihood ratio of two character models.

The patterns find assignments, access keys and long hexadecimal runs. The method adds other tokens that look random:
first-order character Markov models of random strings and of ordinary identifiers are trained from labelled samples,
and the log-likelihood ratio of the two decides.

Training reads all documents: values that the patterns find are the random samples, all other tokens the ordinary
ones. Samples of a few formats say nothing of keys in another alphabet, so strings drawn evenly from each alphabet are
a second kind of random sample, whose model is known without drawing them; the better of both explains a token. All
models are taken over the classes of letters that the token has (small, capital, digit), so the order of its letters
decides and not its alphabet. Signs, and a capital after a small letter, begin a word, as they do in identifiers.
One letter in twenty of ordinary text may be anything (`noise`), so a strange name weighs little at any corpus size. Only transition counts leave the tasks, at most alphabet squared per model.
`sample_docs` bounds the rows read where that is wanted (those with the least hash of id and text).

A token is reported if the mean ratio of its distinct transitions is over `threshold` and their sum over `evidence`,
which is the log of the odds against a secret. Repeated transitions add nothing, so rules of one letter are not random.
Tokens of less than `LEAST` letters can't reach the evidence and are not looked at. A run of digits can't be told
from an ordinary number and has a ratio near 0.

Defined cases: null text counts as empty; spans are in code points, end exclusive; repeated rows are scanned each on
their own; an empty table gives an empty result; only the `keep` columns of the input are carried over.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.words import carried, free

# Fixed patterns of the base scan.
ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "model")

#: What the models look at: long runs of the letters that keys are written in.
LEAST = 12
TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
CODE = np.full(128, len(ALPHABET), np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
SIDE = len(ALPHABET) + 1  # the last code is of signs and starts a word
#: The class of each letter as one bit, and the letters of each set of classes.
BIT = np.array([1 if c.islower() else 2 if c.isupper() else 4 for c in ALPHABET])
WITHIN = (np.arange(8)[:, None] & BIT) > 0
WORD = re.compile(r"[A-Za-z0-9+/_=-]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def transitions(text: str) -> np.ndarray:
    """From each letter's predecessor, or the start of a word, to the letter."""
    codes = CODE[np.frombuffer(text.encode("ascii"), np.uint8)]
    last = np.concatenate(([SIDE - 1], codes[:-1]))
    last[(codes < 26) & (last >= 26) & (last < 52)] = SIDE - 1
    inside = codes < SIDE - 1
    return last[inside] * SIDE + codes[inside]


@dataclass(frozen=True)
class Model:
    """Log-ratio of each transition, by set of classes: strings drawn evenly, and those of the samples, against ordinary ones."""

    ratios: tuple[np.ndarray, ...]
    threshold: float
    evidence: float

    def total(self, token: str) -> tuple[float, int]:
        """The ratio summed over distinct transitions, for the random model that explains the token better, and their number."""
        at = np.unique(transitions(token))
        if not len(at):
            return 0.0, 1
        classes = int(np.bitwise_or.reduce(BIT[at % SIDE]))
        return max(float(r[classes, at].sum()) for r in self.ratios), len(at)

    def score(self, token: str) -> float:
        total, n = self.total(token)
        return total / n

    def random(self, token: str) -> bool:
        total, n = self.total(token)
        return total / n > self.threshold and total > self.evidence


def within(weights: np.ndarray) -> np.ndarray:
    """Log-probability of each transition among the letters of each set of classes, from weights of all transitions."""
    inside = np.where(WITHIN[:, None, :], weights[None, :, : SIDE - 1], 0.0)
    total = inside.sum(2, keepdims=True)
    log = np.log(np.where(inside > 0, inside / np.where(total > 0, total, 1.0), 1.0))
    return np.concatenate((log, np.zeros((8, SIDE, 1))), 2).reshape(8, SIDE * SIDE)


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_docs: int | None = None, threshold: float = 0.35, smoothing: float = 0.5, evidence: float = 9.0, noise: float = 0.05) -> Model:
    """Count transitions of random and ordinary tokens, in all documents or in a bounded sample."""
    sample = docs.select(F.col(text).alias("text"))
    if sample_docs is not None:
        sample = docs.select(F.xxhash64(doc_id, text).alias("_key"), F.col(text).alias("text")).orderBy("_key").limit(sample_docs).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SIDE * SIDE), np.int64)
        for batch in batches:
            for t in batch.column("text").to_pylist():
                taken = []
                for start, kind, end in base_spans(t or ""):
                    value = t[start:end]
                    if kind == 0:
                        value = ASSIGN.match(t, start).group(1)
                    if not taken or start >= taken[-1][1]:
                        taken.append((start, end))
                        for token in WORD.findall(value):
                            if len(token) >= LEAST:
                                np.add.at(total[0], transitions(token), 1)
                kept, at = [], 0
                for start, end in taken:
                    kept.append((t or "")[at:start])
                    at = end
                kept.append((t or "")[at:])
                joined = WORD.findall(" ".join(kept))
                if joined:
                    total[1] += np.bincount(transitions(" ".join(joined)), minlength=SIDE * SIDE)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "n"])

    counted = sample.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(2 * SIDE * SIDE)
    for row in counted:  # at most two full tables of transitions
        total[row["at"]] = row["n"]
    random, ordinary = total.reshape(2, SIDE, SIDE)
    even = within(np.ones((SIDE, SIDE)))
    ordinary = np.logaddexp(np.log1p(-noise) + within(ordinary + smoothing), np.log(noise) + even)
    ratios = [even - ordinary]
    if random.sum():
        # Random strings draw their letters independently: their model is backed by the letters' own frequencies.
        letters = random.sum(0) + smoothing
        ratios.append(within(random + 20 * letters / letters.sum()) - ordinary)
    return Model(tuple(ratios), threshold, evidence)


def model_spans(text: str, model: Model, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Random-looking tokens, or the parts of tokens that pattern matches leave."""
    found = []
    for m in TOKEN.finditer(text):
        at = m.start()
        for s, _, e in [*(x for x in taken if x[0] < m.end() and m.start() < x[2]), (m.end(), 3, m.end())]:
            if s - at >= LEAST and model.random(text[at:s]):
                found.append((at, 3, s))
            at = max(at, e)
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts by kind, the digest of the pattern spans, and all spans of every text."""
    keep = carried(keep, ("n_assign", "n_access", "n_hex", "base_sha256", "spans"))
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(free("_text", keep)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, spans = [], [], []
            for t in batch.columns[-1].to_pylist():
                base = base_spans(t)
                kinds = [k for _, k, _ in base]
                n.append([kinds.count(k) for k in range(3)])
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(sorted(base + model_spans(t, model, base))))
            counts = np.array(n, np.int64).reshape(-1, 3)
            arrays = [*batch.columns[:-1], *(pa.array(counts[:, k]) for k in range(3)), pa.array(sha, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = docs.select(*keep).schema
    for name, kind in (("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"), ("spans", "string")):
        schema = schema.add(name, kind)
    return rows.mapInArrow(each, schema)


def redact(docs: DataFrame, model: Model, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by `mark`; texts without one, and null texts, stay as they are."""
    column = docs.columns.index(text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(column).to_pylist():
                if t:
                    base = base_spans(t)
                    kept, at = [], 0
                    for start, _, end in sorted(base + model_spans(t, model, base)):
                        if start >= at:
                            kept += [t[at:start], mark]
                        at = max(at, end)
                    t = "".join(kept) + t[at:] if at else t
                out.append(t)
            yield batch.set_column(column, batch.schema.field(column), pa.array(out, batch.schema.field(column).type))

    return docs.mapInArrow(each, docs.schema)

"""Alignment of tokenizers against the libraries' own ids and a plain merge of byte ends."""

import hashlib
import json
import random
import re
from collections import Counter

import numpy as np
import pytest

from tideline.llm import alignment


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    names = {i: t for t, i in json.load(open(P.path("byte_bpe_50k.json"), encoding="utf-8"))["model"]["vocab"].items()}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    sign = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    second = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))

    def piece(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    def tokens(text):
        a = [(i, bytes(sign[c] for c in names[i])) for i in first.encode(" " + text, add_special_tokens=False).ids]
        return a, [(i, piece(i)) for i in second.encode(text)]

    return tokens


def plain_groups(tokens, text):
    """Groups of ids, or none."""
    if not text:
        return []
    a, b = tokens(text)
    if any(b"".join(x for _, x in side) != (" " + text).encode() for side in (a, b)):
        return []
    out, i, j, at, bt = [], 0, 0, 0, 0
    own = ([], [])
    while i < len(a) or j < len(b):
        if at <= bt and i < len(a) and not (at == bt and own != ([], [])):
            own[0].append(a[i][0])
            at += len(a[i][1])
            i += 1
        else:
            own[1].append(b[j][0])
            bt += len(b[j][1])
            j += 1
        if at == bt:
            out.append(own)
            own = ([], [])
    return out


def expected(tokens, rows):
    groups = [plain_groups(tokens, t) for _, t in rows]
    count = Counter((a[-1], b[-1]) for g in groups for a, b in g)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for (doc, _), g in zip(rows, groups, strict=True):
        links = [(a[-1], b[-1]) for a, b in g]
        digest = hashlib.sha256(";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g).encode()).hexdigest() if g else ""
        out.append((doc, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), digest))
    return out


HARD = [None, "", " ", "  ", "a ", " a", "\n", "x▁y", "▁", "<|endoftext|> and </s>", "a  b", "　 x", "tab\t next  line \n\n end ", "é ﬁ ½", "\x00\x01", "😀 😀", "=" * 700, "word " * 900, "日本語" * 200]


def test_documents(spark, docs, rows, libraries, monkeypatch):
    plain = [(r[0], r[1]) for r in rows]
    got = [tuple(r) for r in alignment.profile(docs).collect()]
    assert sorted(got, key=str) == sorted(expected(libraries, plain), key=str)


def test_hard_texts_and_clashing_names(spark, libraries):
    rows = [(k // 2 if k else None, t) for k, t in enumerate(HARD)] + [(3, "  "), (3, "  ")]
    schema = "doc_id long, text string, _text string, links string, n_a string, k0 string, groups_sha256 string"
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], schema)
    got = [tuple(r) for r in alignment.profile(docs).collect()]
    assert sorted(got, key=str) == sorted(expected(libraries, rows), key=str)
    kept = alignment.profile(docs, keep=("doc_id", "_text", "links"))
    assert {(r["_text"], r["links"]) for r in kept.collect()} == {("x", "x")}


def test_groups_are_given_out(spark, docs, rows, libraries):
    got = {}
    for r in alignment.aligned(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["place"], list(r["a_ids"]), list(r["b_ids"])))
    want = {doc: plain_groups(libraries, t) for doc, t in {r[0]: r[1] for r in rows}.items()}
    single = {d for d in want if sum(r[0] == d for r in rows) == 1}
    assert len(single) > 50
    for d in single:
        assert [x[1:] for x in sorted(got.get(d, []))] == want[d]


def test_empty_table(none):
    assert alignment.profile(none).collect() == [] and alignment.aligned(none).collect() == []


@pytest.mark.parametrize("size", [3, 40])
def test_texts_go_segment_by_segment(libraries, monkeypatch, size):
    monkeypatch.setattr(alignment, "RUN", 7)
    own = alignment.aligner("byte_bpe_50k", "piece_bpe_32k.model")
    texts = [t for t in HARD if t] + ["one two  three \n four " * 9]
    for t in texts:
        parts = list(alignment.segments(t, size))
        assert "".join(parts) == " " + t
        a, b = libraries(t)
        found = list(own.tokens(parts))
        if b"".join(x for _, x in b) == (" " + t).encode():
            assert np.concatenate([f[0] for f in found]).tolist() == [i for i, _ in a]
            assert np.concatenate([f[1] for f in found]).tolist() == [i for i, _ in b]
            assert all(f[2] for f in found)
        else:
            assert not all(f[2] for f in found)


def test_a_text_may_fail_late(libraries, monkeypatch):
    """Segments before the one that isn't given back don't count either."""
    import pyarrow as pa

    monkeypatch.setattr(alignment, "RUN", 30)
    monkeypatch.setattr(alignment.segments, "__defaults__", (10,))
    own = alignment.aligner("byte_bpe_50k", "piece_bpe_32k.model")
    texts = ["fine words here", "some good words and then ▁ more words here", "fine again, words", None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["_text"])
    got = list(alignment._documents(batch, own))
    want = [plain_groups(libraries, t) for t in texts]
    assert [(r, n[2]) for r, n, _, _ in got] == [(k, len(g)) for k, g in enumerate(want)]


def test_shared_cuts_of_any_ends():
    rng = random.Random(2)
    for _ in range(300):
        total, a, b, a_cuts, b_cuts = 0, [], [], [], []
        for _ in range(rng.randint(1, 4)):
            size = rng.randint(1, 40)
            for ends in (a, b):
                chance = rng.choice([0.05, 0.5, 0.9])
                ends += [total + k for k in range(1, size) if rng.random() < chance] + [total + size]
            total += size
            a_cuts.append(len(a))
            b_cuts.append(len(b))
        ends_a, ends_b = alignment.shared_cuts(*(np.array(x, np.int64) for x in (a, b, a_cuts, b_cuts)))
        common = sorted(set(a) & set(b))
        assert ends_a.tolist() == [a.index(x) + 1 for x in common]
        assert ends_b.tolist() == [b.index(x) + 1 for x in common]


def test_linked_pairs_are_possible_ones(libraries, rows):
    own = alignment.aligner("byte_bpe_50k", "piece_bpe_32k.model")
    possible = set(own.pairs.tolist())
    for _, t in [(r[0], r[1]) for r in rows][:60]:
        assert all(a[-1] * len(own.b_raw) + b[-1] in possible for a, b in plain_groups(libraries, t))

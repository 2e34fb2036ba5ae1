"""Operators over the whole corpus against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tideline.llm import lm, neardup, quality, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def components(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t, *_ in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        least[find(x)] = min(least.get(find(x), i), i)
    return Counter((i, len(s), least[find(x)], i == least[find(x)]) for x, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, width, percent):
    got = Counter(tuple(r) for r in neardup.near_duplicates(docs, width, percent).collect())
    assert got == components(rows, width, percent)


def test_survivors_are_told_by_id_and_text(spark):
    """Texts that share an id, texts without one, repeated rows, null and wordless texts."""
    from tideline.session import ship

    say = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    near = say(1) + " end"
    rows = [(1, say(1)), (1, near), (2, near), (3, say(3)), (3, say(4)), (4, say(4)), (5, say(5)), (5, say(5)), (None, say(6)), (None, say(6)), (None, near), (7, None), (7, None), (8, " \n"), (None, "")]
    df = ship(spark).createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, h string, label string").repartition(4)
    got = Counter((r.doc_id, r.text) for r in neardup.survivors(df).collect())
    kept = [(3, say(3)), (3, say(4)), (5, say(5)), (None, say(6)), (7, None), (7, None), (8, " \n"), (None, "")]
    one = got - Counter(kept)
    assert got & Counter(kept) == Counter(kept) and len(one) == 1 and set(one) <= {(1, say(1)), (1, near)} and sum(one.values()) == 1
    assert neardup.survivors(df.limit(0)).count() == 0


def test_family_blocks_lose_no_link(docs, rows, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 2)
    monkeypatch.setattr(neardup, "STARS", 1)
    assert Counter(tuple(r) for r in neardup.near_duplicates(docs, 3, 60).collect()) == components(rows, 3, 60)


def test_near_duplicates_of_nothing(none):
    assert neardup.near_duplicates(none).count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 600).astype(np.uint64)
    b = np.concatenate((a[:500], rng.integers(0, 2**63, 100).astype(np.uint64)))
    flat, sizes = np.concatenate((a, b, a[:1])), np.array([600, 600, 1])
    s = neardup.sketches(flat, sizes, 256)
    assert (s != 2**64 - 1).all()
    assert abs((s[0] == s[1]).mean() - 500 / 700) < 0.12


def removed(rows, length):
    """Size, removed bytes, runs and the digest of what is left, of each (doc_id, text)."""
    out = {}
    for key, (b, gone) in repeated_bytes(rows, length).items():
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[key] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeated_bytes(rows, length):
    """Bytes of each (doc_id, text), and which are covered by a string that starts earlier."""
    order = sorted({(i, t or "") for i, t, *_ in rows}, key=lambda x: x[0])
    seen, out = set(), {}
    for i, t in order:
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(b[k : k + length])
        out[i, t] = b, gone
    return out


@pytest.mark.parametrize(("length", "hot", "filter_bytes"), [(100, 50_000, 1 << 20), (100, 2, 1 << 20), (100, 50_000, 0), (37, 5, 0), (10, 50_000, 1 << 20)])
def test_suffix_dedup(docs, rows, length, hot, filter_bytes):
    """With a broadcast filter and without, with every repeated gram hot, and with other covers."""
    want = removed(rows, length)
    got = Counter(tuple(r) for r in suffixes.measure(docs, length, hot=hot, filter_bytes=filter_bytes).collect())
    assert got == Counter((i, *want[i, t or ""]) for i, t, *_ in rows)


def test_suffix_dedup_takes_whole_ids_only(docs):
    with pytest.raises(TypeError):
        suffixes.measure(docs.withColumn("doc_id", docs.id))


def test_every_pair_of_positions_meets_in_the_cover():
    for period, residues in suffixes.COVERS.items():
        assert {(a - b) % period for a in residues for b in residues} == set(range(period))
    cover = suffixes.Cover(100)
    at = cover.positions(np.arange(500))[0]
    assert (np.diff(at) > 0).all() and all((at < x).sum() == cover.until(np.array([x]))[0] for x in range(200))


def test_suffix_dedup_keeps_columns(docs, none):
    out = suffixes.cleaned(docs, 100)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert suffixes.measure(none).count() == 0 and suffixes.cleaned(none).count() == 0


def test_lm_scores(docs, rows, none):
    token = {id(r): [*WORD.findall((r[1] or "").translate(LOWER)), None] for r in rows}
    out = {r[0]: zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows}
    c = Counter(t for r in rows if not out[r[0]] for t in token[id(r)])
    n, v = sum(c.values()), len(c)
    want = {}
    for r in rows:
        w = token[id(r)]
        want.setdefault(r[0], []).append((out[r[0]], len(w), sum(c[t] > 0 for t in w), n, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w)))
    for most in (lm.MAX_BYTES, 0):
        found = {}
        for r in lm.score(docs, max_bytes=most).collect():
            found.setdefault(r.doc_id, []).append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score))
            assert r.score < 0
        assert found.keys() == want.keys()
        for i in want:
            for a, b in zip(sorted(found[i]), sorted(want[i]), strict=True):
                assert a[:4] == b[:4] and a[4] == pytest.approx(b[4])
    assert lm.score(none).count() == 0


def test_lm_model_score_has_single_pairs(docs, rows):
    """`score` against brute force with exact counts and the same quantisation: equal but for the filter's false hits,
    and the same at both sizes."""

    def about(c):
        level = math.floor(math.log(c) / math.log(lm.BASE) + 1e-9) if c else 0
        low = math.ceil(lm.BASE**level - 1e-9)
        return (low + max(low, math.ceil(lm.BASE ** (level + 1) - 1e-9) - 1)) / 2 if c else 0

    token = [[*WORD.findall((r[1] or "").translate(LOWER)), None] for r in rows]
    training = [t for r, t in zip(rows, token, strict=True) if zlib.crc32(str(r[0]).encode()) % 10]
    words = Counter(t for ts in training for t in ts)
    pairs = Counter(p for ts in training for p in zip(["<s>", *ts], ts))
    assert sum(c == 1 for c in pairs.values()) > 1000
    n, v = sum(words.values()), len(words)

    def want(ts):
        out = 0
        for a, b in zip(["<s>", *ts], ts):
            own = (about(words[b]) + 0.1) / (n + 0.1 * (v + 1))
            pair, before = about(pairs[a, b]), about(len(training)) if a == "<s>" else about(words[a])
            out += math.log10((pair + lm.MU * own) / (max(before, pair) + lm.MU))
        return out

    right = sorted(((r[0], len(ts), want(ts)) for r, ts in zip(rows, token, strict=True)))
    # The model on exact counts: no difference at all.
    raw = [(r[1] or "").encode() for r in rows if zlib.crc32(str(r[0]).encode()) % 10]
    token_, previous, _ = lm._tokens(raw)
    counts = [Counter(x.tolist()) for x in (np.concatenate((token_, np.full(len(raw), lm.BEGIN))), lm.pairs_of(previous, token_))]
    levels = lambda h, c: np.where(c > 0, lm.word_levels(c), 0)
    for r, ts in zip(rows, token, strict=True):
        grams = lm.Grams.of([(r[1] or "").encode()])
        own = [np.array([c[x] for x in h.tolist()]) for h, c in zip((grams.words, grams.pairs), counts, strict=True)]
        assert abs(grams.scores(own[0], levels(grams.words, own[0]), levels(grams.pairs, own[1]), n, v)[2][0] - want(ts)) < 1e-9 * len(ts)
    got, same = (sorted((r.doc_id, r.n_tokens, r.score) for r in lm.score(docs, max_bytes=most).collect()) for most in (lm.MAX_BYTES, 0))
    assert got == same
    assert [g[:2] for g in got] == [w[:2] for w in right]
    assert sum(abs(g[2] - w[2]) for g, w in zip(got, right, strict=True)) < 0.002 * sum(w[1] for w in right)


def test_filter_errs_as_seldom_as_stated():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**63, 40_000).astype(np.uint64) * np.uint64(2)
    counts = rng.integers(1, 30, len(h))
    bits = np.frombuffer(lm.segment_of([(h, counts)]), np.uint8)
    read = lambda x: lm.read_levels(x, bits, np.zeros(len(x), np.int64), np.full(len(x), 8 * len(bits)))
    assert (read(h) >= lm.word_levels(counts)).all() and (read(h) > lm.word_levels(counts)).mean() < 0.002
    assert (read(rng.integers(0, 2**63, 200_000).astype(np.uint64) * np.uint64(2) + np.uint64(1)) > 0).mean() < 0.001
    assert len(lm.segment_of([])) == 0 and (lm.read_levels(h, bits[:0], np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)) == 0).all()


def test_filter_reads_levels_back():
    counts = np.array([1, 2, 3, 10, 1000])
    about = lm.count_of(lm.word_levels(counts), 1)
    assert about[0] == 1 and (abs(np.log(about / counts)) < math.log(lm.BASE)).all()
    assert lm.count_of(lm.pair_levels(counts), 0)[0] == 0


def test_pipeline(spark, docs, rows, none, tmp_path):
    out = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"{k}")
        stage(spark, out, "").write.parquet(path)
        before, out = out, spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            assert out.count() <= before.count()
        if name == "quality_rules":
            kept = quality.apply_policy(quality.ledger(docs)).where("kept").select("doc_id").distinct().count()
            assert out.select("doc_id").distinct().count() == kept
        if name == "near_duplicates":
            names = {(r.doc_id) for r in neardup.near_duplicates(before).where("kept").collect()}
            assert sorted(r.doc_id for r in out.collect()) == sorted(names)
        if name == "repeated_passages":
            left = {i: bytes(c for c, g in zip(b, gone, strict=True) if not g).decode(errors="ignore") for (i, _), (b, gone) in repeated_bytes([(r.doc_id, r.text) for r in before.collect()], 100).items()}
            assert {r.doc_id: r.text for r in out.collect()} == left and out.where("n_chars <> length(text)").count() == 0
        if name == "packing":
            import public_tokenizers
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            whole = {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1] for r in before.collect()}
            found: dict = {}
            for r in out.orderBy("doc_id", "start").collect():
                found.setdefault(r.doc_id, []).extend(r.ids)
            assert found == whole
        if name == "secret_scan":
            assert out.where("text like '%24be64439e3e49cf%'").count() == 0
    assert out.where("offset <> 0").count() == 0 and out.agg({"length": "sum"}).first()[0] > 0
    empty = none
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0


def test_hash_ranges_answer_what_they_are_sent_once(docs, monkeypatch):
    """Many runs and many ranges in groups give the scores of the shipped table; n-grams are not sent again to be answered."""
    monkeypatch.setattr(lm, "PART_BYTES", 500)
    want = sorted(tuple(r) for r in lm.score(docs).collect())
    monkeypatch.setattr(lm, "ASKING_BYTES", 2000)
    out = lm.score(docs, max_bytes=0)
    assert sorted(tuple(r) for r in out.collect()) == want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroups") == 1

"""SimHash: fingerprints bit by bit, and components against all pairs of fingerprints."""

import random

import pytest
import xxhash

from tideline.llm import simhash

SPACE = b" \t\n\v\f\r"


def plain_fingerprint(text, width=3):
    lowered = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = lowered.split()
    grams = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(values, budget=3):
    """Least position that links reach, for each value."""
    own = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= budget:
                a, b = own[i], own[j]
                own = [min(a, b) if x in (a, b) else x for x in own]
    return own


def expected(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    own = plain_components([prints[i] for i in order])
    out = [None] * len(rows)
    for place, i in enumerate(order):
        out[i] = (rows[i][0], f"{prints[i]:016x}", rows[order[own[place]]][0])
    return out


def key(row):
    return (row[0] is None, row[0] or 0, row[1], str(row[2]))


def test_documents(spark, docs, rows):
    got = simhash.near_duplicates(docs).collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected([(r[0], r[1]) for r in rows]), key=key)


def test_empty_table(none):
    assert simhash.near_duplicates(none).collect() == []


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(None, "a b c d"), (None, None), (5, ""), (5, "a b c d"), (5, "a b c d"), (6, "A\tB\nC d")]
    schema = "doc_id long, text string, node string, label string, turn int, leaf int, a int, b int, side int, diff int, n int, first string, component_id long, fingerprint string"
    docs = spark.createDataFrame([(*r, *("x", "x", 1, 1, 1, 1, 1, 1, 1, "x", 1, "x")) for r in rows], schema)
    got = simhash.near_duplicates(docs).collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected(rows), key=key)


def test_a_long_text_goes_block_by_block(monkeypatch):
    rng = random.Random(1)
    text = " ".join(f"W{rng.randrange(500)}" for _ in range(3000)) + " \n x"
    monkeypatch.setattr(simhash, "BLOCK", 50)
    for t in (text, "a b", "   a   ", " " * 200, "y" * 300, "a " + " " * 300 + "b"):
        assert simhash.fingerprint_of(t.encode(), 3) == plain_fingerprint(t).to_bytes(8, "big")


def crowd(seed, n):
    """Fingerprints in tight clusters, with two thirds of them below one prefix."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(12)]
    out = set()
    while len(out) < n:
        x = centres[0] if rng.random() < 0.6 else rng.choice(centres)
        for _ in range(rng.randint(0, 9)):
            x ^= 1 << rng.randrange(40 if rng.random() < 0.7 else 64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("leaf,budget", [(simhash.LEAF, 3), (20, 3), (7, 2), (30, 0)])
def test_trie_joins_what_pairs_join(spark, leaf, budget, monkeypatch):
    monkeypatch.setattr(simhash, "DIRECT", 4)
    values = crowd(leaf, 700)
    nodes = spark.createDataFrame([(x.to_bytes(8, "big"),) for x in values], "node binary").repartition(3)
    links = [(int.from_bytes(a, "big"), int.from_bytes(b, "big")) for a, b in simhash.trie_links(nodes, budget, leaf).collect()]
    place = {x: i for i, x in enumerate(values)}
    own = list(range(len(values)))
    for a, b in links:
        x, y = own[place[a]], own[place[b]]
        own = [min(x, y) if v in (x, y) else v for v in own]
    assert own == plain_components(values, budget)


def test_no_task_gets_a_crowded_node(spark):
    """Units stay under the bound although most leaves share a prefix."""
    values = crowd(5, 900)
    leaves = spark.createDataFrame([(0, x - (1 << 64) if x >> 63 else x) for x in values], "turn int, leaf long")
    rows = simhash.units(leaves, 3, 16, 25)
    assert max(r["count"] for r in rows.groupBy("turn", "level", "a", "b", "side").count().collect()) <= 25

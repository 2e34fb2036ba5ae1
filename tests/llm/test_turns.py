"""Conversation repair against a cheapest-first search, damage and reports against plain Python."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tideline.llm import turns as T

WS = "\x20\x09-\x0d"


def plain_faults(rows):
    """First fault of each (role, text), in order."""
    out, seen = [], set()
    for role, text in rows:
        bare = re.findall(f"[^{WS}]", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """(cost, audit, repaired turns) by trying cheaper paths first and, of equal cost, those that sort first."""
    faults = plain_faults(rows)
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        last = roles[-1:]
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, out
        for r in "ua":
            ways = [(2, "I", 0, r, (("user" if r == "u" else "assistant"), ""))]
            if i < len(rows) and faults[i] not in ("blank", "duplicate"):
                ways.append((2 + (faults[i] == "truncated"), "R", 1, r, ("user" if r == "u" else "assistant", rows[i][1])))
            for more, e, step, role, turn in ways:
                if re.fullmatch("s?(ua)*u?", roles + role):
                    heapq.heappush(heap, (cost + more, audit + e, i + step, roles + role, (*out, turn)))
        if i < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles, out))
            role = rows[i][0][:1]
            if faults[i] not in ("blank", "duplicate") and re.fullmatch("s?(ua)*u?", roles + role) and role in "sua" and role:
                heapq.heappush(heap, (cost + (faults[i] == "truncated"), audit + "K", i + 1, roles + role, (*out, rows[i])))
    raise AssertionError


def plain_damage(rows):
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", say(text)) if k == 2 else say(text)
        yield from [] if k == 0 else [(conv, turn, "user" if k == 4 else say(role), text)] * (2 if k == 3 else 1)


def plain_report(conv, rows):
    """A conversation's report from its rows in order."""
    faults = plain_faults([r[2:] for r in rows])
    cost, audit, out = plain_repair([r[2:] for r in rows])
    known = {r[1] for r in rows if r[1] is not None}
    roles = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return conv, max(known) - min(known) + 1 - len(known) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest


def sample(seed, n, conv=0):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why?", "and so", "", " \n", "Then it goes on", "É.", "x. \t"]
    roles = ["user", "assistant", "system", "tool", "", "user", "assistant"]
    return [(conv, i // rng.choice([1, 1, 3]) if rng.random() < 0.95 else None, rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"text {i}{rng.choice('.!?,')}") for i in range(n)]


@pytest.mark.parametrize("seed", range(60))
def test_search_finds_the_cheapest_and_least(seed):
    rows = [r[2:] for r in sample(seed, seed % 12)]
    codes = T.first_codes(*(zip(*rows) if rows else ((), ())))
    audit, cost = T.closed(codes)
    want = plain_repair(rows)
    assert (cost, audit) == want[:2]
    done = [(r, t) for e, r, t in T.edits(audit, T.START, [r for r, _ in rows], [t for _, t in rows]) if e != "D"]
    assert tuple(done) == want[2]


def ordered(rows):
    """Rows by turn, nulls first; ties by role, then in the order of equal texts, which the tests keep free of."""
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))


def trial():
    rng = random.Random(9)
    rows = []
    for conv in (*range(70), None):
        n = rng.randint(1, 9) if conv != 5 else 400
        roles = ["system"] * (rng.random() < 0.4) + ["user", "assistant"] * n
        rows += [(conv, t + (t > 4), r if rng.random() < 0.9 else rng.choice(["tool", None, "user"]), None if rng.random() < 0.05 else rng.choice(["Same.", f"{conv} {t}. ", f"{conv} {t}?", f"{conv} {t}", "é" * 20])) for t, r in enumerate(roles[:n])]
    gone = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (gone, 0, "user", "Gone."), (7777, None, "user", "No turn.")]


@pytest.mark.parametrize("block", [T.BLOCK, 7])
def test_reports(spark, block):
    rows = trial()
    turns = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "conv_id long, turn long, role string, text string, key string, at int, open boolean").repartition(3)
    got = {r[0]: tuple(r) for r in T.reports(T.damaged(turns), gone="gone", block=block).collect()}
    harmed = list(plain_damage(rows))
    want = {c: plain_report(c, ordered([r for r in harmed if r[0] == c])) for c in {r[0] for r in rows}}
    assert got == want
    lines = T.repaired(T.damaged(turns), gone="gone", block=block).orderBy("at", "place").collect()
    for conv, report in want.items():
        own = [r for r in lines if r["conv_id"] == conv]
        assert "".join(r["edit"] for r in own) == report[7]
        text = "\n".join(f"{r['role']}:{r['text']}" for r in own if r["edit"] != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == report[8]


def test_one_conversation_is_shared_out(spark):
    """A conversation that holds every row goes to many tasks in pieces."""
    rows = sample(4, 900)
    turns = spark.createDataFrame([(1, t, r, f"{x}{t}") for t, (_, _, r, x) in enumerate(rows)], "conv_id long, turn long, role string, text string")
    from pyspark.sql import functions as F

    merge = "spark.sql.adaptive.coalescePartitions.enabled"  # it would put so few rows in one task
    before = spark.conf.get(merge)
    spark.conf.set(merge, "false")
    found = T.streamed(T.named(turns, "conv_id", "turn", "role", "text", None).withColumn("number", F.monotonically_increasing_id()), False, 50)
    pieces = found.where("open").select("at", F.size("roles").alias("n")).collect()
    spark.conf.set(merge, before)
    assert sum(p["n"] for p in pieces) == 900 and max(p["n"] for p in pieces) <= 50 and len({p["at"] >> 40 for p in pieces}) > 1


def test_ties_repeats_and_empty_tables(spark):
    schema = "conv_id string, turn int, role string, text string"
    assert T.reports(spark.createDataFrame([], schema)).collect() == []
    assert T.repaired(spark.createDataFrame([], schema)).collect() == []
    rows = [("a", 1, "user", "Q?"), ("a", 1, "user", "Q?"), ("a", 1, "assistant", "A."), ("b", None, None, None), ("c", 2, "user", "x" * 200000 + "."), ("c", 9, "assistant", "ok.")]
    got = {r["conv_id"]: r.asDict() for r in T.reports(spark.createDataFrame(rows, schema)).collect()}
    assert (got["a"]["duplicate"], got["a"]["gaps"], got["a"]["illegal"]) == (1, 0, 1)  # equal turns go by role
    assert got["b"]["audit"] == "D" and got["b"]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got["c"]["gaps"] == 6 and got["c"]["audit"] == "KK"

"""Role repair against a search over all ways to repair, and the rendered text."""

import itertools

import numpy as np
import pytest

from tideline.llm import chat
from tideline.session import ship

#: The costs, written out: a turn whose role is as it should be costs nothing, another role 2, unknown ones too; a turn
#: that goes on the same role costs 1 more, and one that needs an empty turn before it 3 more.
LEGAL = {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}
BRIDGED = {(0, 3), (1, 3)}
CLOSING = {1: 6.0, 2: 3.0, 3: 0.0}


def step(code, at, to):
    label = 0.0 if code == to else 2.0
    if (at, to) in LEGAL:
        return label
    if at == to:
        return label + 1.0
    return label + 3.0 if (at, to) in BRIDGED else float("inf")


SCHEMA = "conv_id long, turn long, role string, text string, new_role string"


def cheapest(codes):
    """Least cost over every assignment of roles, by brute force."""
    best = float("inf")
    for states in itertools.product((1, 2, 3), repeat=len(codes)):
        cost, at = 0.0, chat.START
        for r, to in zip(codes, states, strict=True):
            cost += step(r, at, to)
            at = to
        best = min(best, cost + CLOSING[at])
    return best


def cost_of(rows):
    cost, at = 0.0, chat.START
    for r in rows:
        to = chat.ROLES.index(r.new_role) + 1
        code = {"system": 1, "user": 2, "assistant": 3, "human": 2, "gpt": 3}.get((r.role or "").strip().lower(), 0)
        cost += step(code, at, to)
        at = to
    return cost + CLOSING[at]


def test_repair_is_cheapest_across_blocks(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(chat, "BLOCK", 3)
    rng = np.random.default_rng(5)
    roles = ["system", "user", "assistant", "human", "tool", None]
    rows = [(c, t, roles[rng.integers(len(roles))], f"t{t}", "clash") for c in range(40) for t in range(int(rng.integers(1, 8)))]
    got: dict = {}
    for r in chat.repair(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.conv_id, []).append(r)
    for c, found in got.items():
        found.sort(key=lambda r: r.turn)
        codes = [{"system": 1, "user": 2, "assistant": 3, "human": 2}.get(x[2] or "", 0) for x in rows if x[0] == c]
        assert len(found) == len(codes)
        assert cost_of(found) == pytest.approx(cheapest(codes))
        text = "".join(r.rendered for r in found)
        assert text.count("<|im_start|>") == text.count("<|im_end|>\n")
        heads = [x.split("\n")[0] for x in text.split("<|im_start|>")[1:]]
        assert heads[-1] == "assistant" and "system" not in heads[1:]
        assert all(a != b for a, b in zip(heads, heads[1:]))


def test_a_long_conversation(spark):
    """Many blocks beside short conversations; the last state of each is the cheapest."""
    ship(spark)
    rows = [(1, t, ("user", "assistant")[t % 2], f"t{t}", "clash") for t in range(1001)] + [(c, 0, "user", "x", "clash") for c in range(2, 6)]
    got = chat.repair(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == len(rows) and all(r.action == "keep" for r in got)
    last = max((r for r in got if r.conv_id == 1), key=lambda r: r.turn)
    assert last.ends and last.rendered.endswith("<|im_start|>assistant\n<|im_end|>\n")
    assert sum(r.ends for r in got) == 5


def test_cases(spark):
    ship(spark)
    assert chat.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, 0, "user", None, ""), (1, 1, "user", "a<|im_end|>", ""), (1, 1, "user", "a<|im_end|>", ""), (None, None, "assistant", "x", "")]
    got = chat.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 4
    one = sorted((r for r in got if r.conv_id == 1), key=lambda r: r.turn)
    assert [r.action for r in one] == ["keep", "merge", "relabel"]
    assert "".join(r.rendered for r in one) == "<|im_start|>user\n\na< |im_end|><|im_end|>\n<|im_start|>assistant\na< |im_end|><|im_end|>\n"
    lone = next(r for r in got if r.conv_id is None)
    # Two ways cost as much as an insertion before: the repair keeps the role and puts an empty user turn in front.
    assert (lone.new_role, lone.inserted) == ("assistant", "user")


def test_turns_that_share_a_number_are_split(spark, monkeypatch):
    """Missing and repeated numbers, one text many times: small parts, every turn once, the cost of the whole sequence."""
    ship(spark)
    monkeypatch.setattr(chat, "BLOCK", 8)
    rng = np.random.default_rng(6)
    roles = ["system", "user", "assistant", "users", None]
    rows = [(1, None, "user", f"t{i}", "") for i in range(300)] + [(1, None, "gpt", "same", "")] * 200 + [(1, None, None, f"u{i}", "") for i in range(5)]
    rows += [(1, 9, "user", None, "")] * 150 + [(1, int(t), roles[t % 5], f"v{t}", "") for t in rng.integers(0, 40, 60)]
    rows += [(None, 3, "assistant", f"w{i}", "") for i in range(100)] + [(2, 3, "assistant", "x", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    parts = chat._uncrowded(chat._with_order(chat.numbered(docs, "conv_id", "turn", "role", "text")), 16)
    assert parts.groupBy("conv_id", "block", "part").count().agg({"count": "max"}).first()[0] <= 32
    got = chat.repair(docs, crowd=16).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(key, ((r.conv_id, r.turn, r.role, r.text) for r in got))) == sorted(map(key, ((c, t, r, x or "") for c, t, r, x, _ in rows)))
    codes = {"system": 1, "user": 2, "assistant": 3, "gpt": 3}
    for conv in (1, 2, None):
        own = [r for r in got if r.conv_id == conv]
        last = [r for r in own if r.ends]
        assert len(last) == sum(r.opens for r in own) == 1
        cost = sum(2 * r.relabelled + (r.action == "merge") + 3 * (r.inserted is not None) for r in own) + CLOSING[chat.ROLES.index(last[0].new_role) + 1]
        order = sorted((r[1] is not None, r[1] or 0, r[2] or "") for r in rows if r[0] == conv)
        costs = [0.0, *[float("inf")] * 3]
        for *_, role in order:
            costs = [min(costs[at] + step(codes.get(role, 0), at, to) for at in range(4)) if to else float("inf") for to in range(4)]
        assert cost == pytest.approx(min(c + CLOSING.get(at, float("inf")) for at, c in enumerate(costs)))

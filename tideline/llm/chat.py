"""Chat formatting with minimum-cost role repair.

A repaired conversation is an optional system turn, then user and assistant in turn, ending with the assistant. For
every turn dynamic programming chooses to keep it, relabel it, merge it into the turn before, or put an empty turn in
front, at least total cost. The automaton has few states, so a stretch of turns is a small matrix of least costs from
state to state, and stretches combine by the (min, +) product. Conversations are therefore cut into blocks of BLOCK
turns: blocks are reduced to matrices in parallel, the matrices of a conversation (one per block) fix the state at
every block border, and each block then picks its own path. No task holds the turns of a long conversation, and a
conversation of one block, as nearly all are, needs no pass over borders.

A block is a range of turn numbers. Where over `CROWD` turns share number and role (missing numbers are one number),
the range is cut further: by turn and role, and those turns by ranges of the hash of their text. Their roles are equal,
so their order does not change the costs; it only says which text opens the merged turn. A text that is itself
repeated over `CROWD` times is dealt out evenly, since its turns are alike.

Of equal costs the path with the smaller states wins (system, user, assistant), read from the last turn back.

Defined cases: null text is empty; null or unknown roles may become any role at the relabelling cost; turns are
ordered by turn number, nulls first, then by role and text (over `CROWD` turns of equal number and role: by hash range
and text, texts repeated over `CROWD` times last), and repeated rows are separate turns; an empty table gives
no rows; other columns are not carried over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import broadcast_if_small, cut

BLOCK = 256
CROWD = 4 * BLOCK
ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)  # states: the last role written, or none yet
STATES = 4
ALIASES = {"human": USER, "prompter": USER, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT}
MERGE, RELABEL, INSERT = 1.0, 2.0, 3.0
#: Which role may follow a state.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: The empty turn that makes a role legal after a state, where one does.
BRIDGE = {(START, ASSISTANT): USER, (SYSTEM, ASSISTANT): USER}


def step_costs() -> np.ndarray:
    """Cost of writing a turn of role r (0: unknown) as state `to` after state `at`."""
    cost = np.full((STATES, STATES, STATES), np.inf)
    for r in range(STATES):
        for at in range(STATES):
            for to in (SYSTEM, USER, ASSISTANT):
                label = 0.0 if r == to else RELABEL
                if to in LEGAL[at]:
                    cost[r, at, to] = label
                elif to == at:
                    cost[r, at, to] = label + MERGE
                elif (at, to) in BRIDGE:
                    cost[r, at, to] = label + INSERT
    return cost


COSTS = step_costs()
#: An empty assistant turn closes a conversation that ends otherwise.
FINAL = np.array([np.inf, 2 * INSERT, INSERT, 0.0])


def product(roles: np.ndarray) -> np.ndarray:
    """Least costs from state to state over a stretch of turns."""
    out = np.where(np.eye(STATES, dtype=bool), 0.0, np.inf)
    for r in roles:
        out = (out[:, :, None] + COSTS[r][None]).min(1)
    return out


def path(roles: np.ndarray, first: int, last: int) -> list[int]:
    """The states of the cheapest path between two fixed ends."""
    costs = [np.where(np.arange(STATES) == first, 0.0, np.inf)]
    for r in roles:
        costs.append((costs[-1][:, None] + COSTS[r]).min(0))
    states = [last]
    for k in range(len(roles) - 1, 0, -1):
        states.append(int((costs[k] + COSTS[roles[k]][:, states[-1]]).argmin()))
    return states[::-1]


def role_code(role: Column) -> Column:
    named = F.lower(F.trim(role))
    known = {r: k + 1 for k, r in enumerate(ROLES)} | ALIASES
    pairs = [F.lit(x) for item in known.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.coalesce(named, F.lit(""))), F.lit(0))


def numbered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, text, code and block. The block is of the turn number, so that it needs no sort."""
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.withColumns({"code": role_code(F.col("role")), "block": F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62)))})


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by([("turn_known", "ascending"), ("turn", "ascending"), ("role_text", "ascending"), ("text", "ascending")])


def _with_order(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"turn_known": F.col("turn").isNotNull(), "role_text": F.coalesce("role", F.lit(""))})


def _uncrowded(rows: DataFrame, crowd: int) -> DataFrame:
    """Rows with `part`: the order of a row's part inside its block; empty where no turns crowd the block."""
    group = ["conv_id", "turn", "role_text"]

    def matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        named = broadcast_if_small(right.select(*[F.col(c).alias(f"own_{c}" if c in keys else c) for c in right.columns]), 200)
        return left.join(named, [F.col(k).eqNullSafe(F.col(f"own_{k}")) for k in keys], "left").drop(*[f"own_{k}" for k in keys])

    crowds = cut(rows.groupBy(*group, "block").agg(F.count("*").alias("rows")).where(F.col("rows") > crowd))
    if crowds.isEmpty():
        return rows.withColumn("part", F.lit(""))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    blocks = crowds.select("conv_id", "block").distinct().withColumn("crowded", F.lit(True))
    rows = matched(matched(rows, blocks, ["conv_id", "block"]), crowds.drop("block"), group)
    copies = rows.where("rows is not null").groupBy(*group, "tie").agg(F.count("*").alias("copies")).where(F.col("copies") > crowd)
    rows = matched(rows, cut(copies), [*group, "tie"])
    digits = lambda c, n: F.lpad(c.cast("string"), n, "0")
    shares = lambda c: F.ceil(F.col(c) / BLOCK)
    unsigned = F.shiftrightunsigned("tie", 1)
    cold = F.concat(F.lit("a"), digits(F.floor(unsigned / float(2**63) * shares("rows")), 12))
    hot = F.concat(F.lit("b"), F.lpad(F.hex("tie"), 16, "0"), digits(F.pmod(F.xxhash64(F.monotonically_increasing_id()), shares("copies")), 12))
    # The dot is less than any digit, so a role sorts before those that it begins.
    at = F.concat(digits(F.coalesce(F.pmod(F.col("turn"), F.lit(BLOCK)), F.lit(0)), 3), F.hex("role_text"), F.lit("."))
    part = F.concat(at, F.when(F.col("copies").isNotNull(), hot).when(F.col("rows").isNotNull(), cold).otherwise(F.lit("")))
    # Written, so that both passes see every copy in one part.
    return cut(rows.withColumn("part", F.when(F.col("crowded"), part).otherwise(F.lit(""))).drop("tie", "crowded", "rows", "copies"))


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row per turn: its new role, what was done, the empty turn put before or after it, and its rendered piece.

    The pieces of a conversation, in order of `turn`, make up its rendered text.
    """
    rows = _uncrowded(cut(_with_order(numbered(turns, conv, turn, role, text))), crowd)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def reduce(table: pa.Table) -> pa.Table:
        roles = table.sort_by([("turn_known", "ascending"), ("turn", "ascending"), ("role_text", "ascending")])["code"].to_numpy()
        return pa.table({"conv_id": table["conv_id"][:1], "block": table["block"][:1], "part": table["part"][:1], "costs": pa.array([product(roles).ravel().tolist()])})

    # Equal number and role mean equal codes, so texts need not travel here.
    light = rows.select("conv_id", "block", "part", "code", "turn", "turn_known", "role_text")
    matrices = light.groupBy("conv_id", "block", "part").applyInArrow(reduce, f"conv_id {kind}, block long, part string, costs array<double>")

    def borders(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("part", "ascending")])
        steps = np.array(table["costs"].to_pylist()).reshape(-1, STATES, STATES)
        costs = [np.where(np.arange(STATES) == START, 0.0, np.inf)]
        for m in steps:
            costs.append((costs[-1][:, None] + m).min(0))
        states = [int((costs[-1] + FINAL).argmin())]
        for k in range(len(steps) - 1, 0, -1):
            states.append(int((costs[k] + steps[k][:, states[-1]]).argmin()))
        states = [START, *states[::-1]]
        closing = [False] * (len(steps) - 1) + [True]
        return pa.table({"conv_id": table["conv_id"], "block": table["block"], "part": table["part"], "first": states[:-1], "last": states[1:], "closes": closing})

    counted = matrices.withColumn("blocks", F.count("*").over(Window.partitionBy("conv_id")))
    # The first state of least cost: the start's row of the matrix and what closing costs.
    closing = [F.struct((F.col("costs")[k] + float(FINAL[k])).alias("cost"), F.lit(k).cast("long").alias("state")) for k in (SYSTEM, USER, ASSISTANT)]
    alone = counted.where("blocks = 1").select("conv_id", "block", "part", F.lit(START).cast("long").alias("first"), F.array_min(F.array(*closing))["state"].alias("last"), F.lit(True).alias("closes"))
    several = counted.where("blocks > 1").drop("blocks").groupBy("conv_id")
    ends = alone.unionByName(several.applyInArrow(borders, f"conv_id {kind}, block long, part string, first long, last long, closes boolean"))

    def walk(table: pa.Table) -> pa.Table:
        table = _ordered(table)
        first, last = table["first"][0].as_py(), table["last"][0].as_py()
        roles = table["code"].to_numpy()
        states = path(roles, first, last)
        out = []
        before = first
        for r, to in zip(roles.tolist(), states, strict=True):
            inserted = ROLES[BRIDGE[before, to] - 1] if (before, to) in BRIDGE else None
            action = "merge" if to == before else "keep" if r == to else "relabel"
            out.append((ROLES[to - 1], action, r != to, inserted, before == START))
            before = to
        kinds = (pa.string(), pa.string(), pa.bool_(), pa.string(), pa.bool_())
        cols = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]
        ends_here = pa.array([False] * (len(out) - 1) + [bool(table["closes"][0].as_py())])
        names = ["conv_id", "turn", "role", "text", "new_role", "action", "relabelled", "inserted", "opens", "ends"]
        return pa.table([table["conv_id"], table["turn"], table["role"], table["text"], *cols, ends_here], names=names)

    joined = rows.join(ends, (rows["conv_id"].eqNullSafe(ends["conv_id"])) & (rows["block"] == ends["block"]) & (rows["part"] == ends["part"]))
    joined = joined.select(*[rows[c] for c in rows.columns], "first", "last", "closes")
    done = joined.groupBy("conv_id", "block", "part").applyInArrow(
        walk, f"conv_id {kind}, turn long, role string, text string, new_role string, action string, relabelled boolean, inserted string, opens boolean, ends boolean"
    )
    return done.withColumn("rendered", rendered())


def rendered(open_: str = "<|im_start|>", close: str = "<|im_end|>\n") -> Column:
    """A turn's piece of the rendered text: it closes the turn before unless it is merged into it, and the last one
    closes itself and adds the empty turns that end the conversation with the assistant. Markers inside a text are
    broken up, so that they can't end a turn."""
    clean = F.replace(F.col("text"), F.lit("<|"), F.lit("< |"))
    empty = lambda r: F.concat(F.lit(open_), r, F.lit("\n"), F.lit(close))
    none = F.lit("")
    start = F.concat(
        F.when(F.col("opens"), none).otherwise(F.lit(close)),
        F.coalesce(empty(F.col("inserted")), none),
        F.concat(F.lit(open_), F.col("new_role"), F.lit("\n"), clean),
    )
    piece = F.when(F.col("action") == "merge", F.concat(F.lit("\n"), clean)).otherwise(start)
    missing = F.when(F.col("new_role") == "system", F.concat(empty(F.lit("user")), empty(F.lit("assistant"))))
    missing = missing.when(F.col("new_role") == "user", empty(F.lit("assistant"))).otherwise(none)
    return F.concat(piece, F.when(F.col("ends"), F.concat(F.lit(close), missing)).otherwise(none))

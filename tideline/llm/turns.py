"""Conversation structure repair by iterative-deepening A*.

A row may be kept (cost 0), given another role (2) or deleted (3), and an empty turn may be inserted anywhere (2); blank
and repeated rows must go, and a truncated row that stays adds 1. The repaired roles read: nothing, or an optional
system turn and then user and assistant in turn. Edits are searched depth first in ASCII order of their initials (Delete,
Insert, Keep, Rerole) under a bound on the cost; the bound grows to the least cost that went beyond it, and a table
holds, for every state that failed, how much it needs at least. The first path within the bound is the answer: no
cheaper one exists, and of equal ones it is the ASCII-least. What rows must cost at least guides the search.

Rows are dealt to tasks by ranges of (conversation, turn), so that a conversation that holds a third of all rows has
many tasks. One that lies within a task, as nearly all do, is repaired as it streams by. Others are left as pieces of at
most BLOCK rows: each piece is reduced to a (min, +) matrix from state to state, one pass over a conversation's
matrices gives what the rest costs after each piece, with that every piece is searched on its own from every state it
may be entered in, and one pass over the exits tells which. The last pass streams the edits of a conversation in order
and holds no more than its audit, which is a result, and the state of its hash.

Defined cases: a null role or text is one space; null turns come first; rows of equal turn are ordered by role and
text digest; repeated rows are rows of their own; a null conversation is one conversation; rows marked as gone only name
theirs; an empty table gives no rows; other columns are not carried over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.session import broadcast_if_small, cut

SPACE = " \t\n\v\f\r"
BLOCK, BYTES = 512, 4 << 20
START, SYSTEM, USER, ASSISTANT = range(4)  # states: the last role written, or none yet
NAMES = {USER: "user", ASSISTANT: "assistant"}
NEXT = (USER, USER, ASSISTANT, USER)  # the role that insertions and reroles write after a state
RELABEL, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
CUT, MUST_GO = 4, 8  # flags of a row's code beside its role
#: What closing costs from each state: empty turns up to the assistant's.
CLOSING = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 40


def moves_of(code: int) -> tuple[tuple[tuple[str, int, int, int], ...], ...]:
    """For each state (initial, rows taken, next state, cost) of every edit, in ASCII order."""
    role, extra = code & 3, TRUNCATED if code & CUT else 0
    out = []
    for at in range(4):
        moves = [("D", 1, at, DELETE), ("I", 0, NEXT[at], INSERT)]
        if not code & MUST_GO:
            if (at, role) in LEGAL:
                moves.append(("K", 1, role, extra))
            moves.append(("R", 1, NEXT[at], RELABEL + extra))
        out.append(tuple(moves))
    return tuple(out)


MOVES = tuple(moves_of(code) for code in range(16))
LEAST = tuple(DELETE if code & MUST_GO else TRUNCATED if code & CUT else 0 for code in range(16))


def search(codes: bytes, entry: int, after: tuple[int, ...]) -> tuple[str, int, int]:
    """(initials of the edits, last state, cost with what comes after) of rows entered in a state; `after` is what each
    last state costs from there on."""
    n = len(codes)
    if not n:
        return "", entry, after[entry]
    rest = [min(after)] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + LEAST[codes[i]]
    needs: dict[int, int] = {}  # failed states, and what they cost at least
    bound = rest[0]
    while True:
        frames, path, beyond = [[0, entry, bound, 0, FAR]], [], FAR
        while frames:
            frame = frames[-1]
            i, state, budget, k, over = frame
            moves = MOVES[codes[i]][state]
            if k == len(moves):
                needs[4 * i + state] = budget + over
                frames.pop()
                if frames:
                    path.pop()
                    frames[-1][4] = min(frames[-1][4], over)
                else:
                    beyond = over
                continue
            frame[3] += 1
            initial, taken, to, cost = moves[k]
            j, left = i + taken, budget - cost
            need = after[to] if j == n else max(rest[j], needs.get(4 * j + to, 0))
            if need > left:
                frame[4] = min(over, need - left)
                continue
            path.append(initial)
            if j == n:
                return "".join(path), to, bound
            frames.append([j, to, left, 0, FAR])
        bound += beyond


def matrix_of(code: int) -> np.ndarray:
    """Least costs from state to state over insertions and one row."""
    out = np.full((4, 4), FAR)
    for at in range(4):
        state, spent = at, 0
        for _ in range(4):
            for initial, taken, to, cost in MOVES[code][state]:
                if taken:
                    out[at, to] = min(out[at, to], spent + cost)
            state, spent = NEXT[state], spent + INSERT
    return out


MATRICES = tuple(matrix_of(code) for code in range(16))


def matrix(codes: bytes) -> np.ndarray:
    out = np.where(np.eye(4, dtype=bool), 0, FAR)
    for code in codes:
        out = (out[:, :, None] + MATRICES[code][None]).min(1)
    return np.minimum(out, FAR)


def code_of(role: str, text: str, repeated: bool) -> int:
    bare = text.rstrip(SPACE)
    flag = MUST_GO if not bare or repeated else CUT if bare[-1] not in ".!?" else 0
    return INITIALS.get(role[:1], START) | flag


def follows(role: int, other: int) -> bool:
    return role != START and (role, other) in LEGAL


def edits(audit: str, entry: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str | None, str | None]]:
    """(initial, role, text) of every edit; role and text are those of the repaired turn, null for a deletion."""
    state, i = entry, 0
    for e in audit:
        if e == "D":
            yield e, None, None
        elif e == "I":
            state = NEXT[state]
            yield e, NAMES[state], ""
        else:
            state = INITIALS[roles[i][:1]] if e == "K" else NEXT[state]
            yield e, roles[i] if e == "K" else NAMES[state], texts[i]
        i += e != "I"


FIELDS = ("blank", "duplicate", "truncated", "illegal", "turns", "first_role", "last_role", "first_turn", "last_turn")


def counts(codes: bytes, texts: list[str], turns: list[int | None]) -> dict[str, int | None]:
    """Faults and ends of a run of rows, in a form that runs can be joined by."""
    known = [t for t in turns if t is not None]
    roles = [c & 3 for c in codes]
    blank = sum(not t.strip(SPACE) for t in texts)
    return {
        "blank": blank,
        "duplicate": sum(c & MUST_GO > 0 for c in codes) - blank,
        "truncated": sum(c & CUT > 0 for c in codes),
        "illegal": sum(not follows(*p) for p in zip(roles, roles[1:])),
        "turns": len(set(known)),
        "first_role": roles[0] if roles else None,
        "last_role": roles[-1] if roles else None,
        "first_turn": known[0] if known else None,
        "last_turn": known[-1] if known else None,
    }


class Tally:
    """Runs of one conversation, in order."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.cost = 0
        self.role = self.low = self.high = None
        self.audit: list[str] = []
        self.hash, self.begun = hashlib.sha256(), False

    def add(self, run: dict) -> None:
        for k in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, k, getattr(self, k) + run[k])
        if run["first_role"] is not None:
            if self.role is not None:
                self.illegal += not follows(self.role, run["first_role"])
            self.role = run["last_role"]
        if run["first_turn"] is not None:
            self.turns -= run["first_turn"] == self.high
            self.low = run["first_turn"] if self.low is None else self.low
            self.high = run["last_turn"]

    def write(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode())
        self.begun = True

    def report(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
REPORT_TYPE = ", ".join(f"{c} {'string' if c in REPORT[-2:] else 'long'}" for c in REPORT)
LINE_TYPE = "edit string, role string, text string"


def closed(codes: bytes) -> tuple[str, int]:
    """Edits of a whole conversation, with the empty turns that close it, and their cost."""
    audit, last, cost = search(codes, START, CLOSING)
    return audit + "I" * (CLOSING[last] // INSERT), cost


def first_codes(roles: list[str], texts: list[str]) -> bytes:
    """Codes of rows that nothing comes before."""
    seen: set[tuple[str, str]] = set()
    out = bytearray()
    for pair in zip(roles, texts, strict=True):
        out.append(code_of(*pair, pair in seen))
        seen.add(pair)
    return bytes(out)


def named(turns: DataFrame, conv: str, turn: str, role: str, text: str, gone: str | None) -> DataFrame:
    none = F.lit(" ")
    return turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), none).alias("role"), F.coalesce(F.col(text), none).alias("text"),
        (F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)).alias("gone"),
    )


def key_of(conv: Column) -> Column:
    """A conversation's name as text that is never null."""
    return F.coalesce(F.concat(F.lit("c"), conv.cast("string")), F.lit(""))


def streamed(rows: DataFrame, lines: bool, block: int) -> DataFrame:
    """Conversations that lie within a task, repaired, and the others as pieces (open)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    arrow = pa.schema([("conv_id", _arrow(rows)), ("open", pa.bool_()), ("at", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
                       *((c, pa.string() if c in REPORT[-2:] else pa.int64()) for c in REPORT), ("lines", pa.list_(pa.struct([(c, pa.string()) for c in ("edit", "role", "text")])))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        state = {"first": True, "open": False, "piece": 0, "bytes": 0}
        turns, roles, texts = [], [], []

        def piece(conv) -> None:
            out.append((conv, True, part + state["piece"], list(turns), list(roles), list(texts), *[None] * len(REPORT), None))
            state["piece"] += 1
            state["open"] = True
            clear()

        def clear() -> None:
            turns.clear()
            roles.clear()
            texts.clear()
            state["bytes"] = 0

        def end(conv, last: bool) -> None:
            if state["first"] or last or state["open"]:
                piece(conv)
            else:
                codes, tally = first_codes(roles, texts), Tally()
                audit, tally.cost = closed(codes)
                tally.add(counts(codes, texts, turns))
                tally.audit.append(audit)
                done = list(edits(audit, START, roles, texts))
                for e, r, t in done:
                    if e != "D":
                        tally.write(r, t)
                own = [{"edit": e, "role": r, "text": t} for e, r, t in done] if lines else None
                out.append((conv, False, part, None, None, None, *tally.report(), own))
                clear()
            state["first"] = state["open"] = False

        def flush() -> pa.RecordBatch:
            cols = [pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)] if out else [pa.array([], f.type) for f in arrow]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, schema=arrow)

        current, begun, size = None, False, 0
        for batch in batches:
            for conv, turn, role, text, gone in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone")), strict=True):
                if begun and conv != current:
                    end(current, False)
                current, begun = conv, True
                if gone:
                    continue
                if len(roles) >= block or state["bytes"] >= BYTES:
                    piece(current)
                turns.append(turn)
                roles.append(role)
                texts.append(text)
                state["bytes"] += len(text)
                size += len(text)
                if size > 16 << 20 and out:
                    size = 0
                    yield flush()
            yield flush()
        if begun:
            end(current, True)
            yield flush()

    report = f"conv_id {kind}, open boolean, at long, turns array<long>, roles array<string>, texts array<string>, {REPORT_TYPE}, lines array<struct<edit: string, role: string, text: string>>"
    # Rows that are alike but for their place could not be told apart by range; their number in the table can.
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64("text"), F.col("number")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(each, report)


def _arrow(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["conv_id"].dataType)


def pieced(pieces: DataFrame) -> DataFrame:
    """(key, at, entry, final, audits of four entries, costs, codes) of every piece of the open conversations: see the
    head of this file."""
    pieces = pieces.withColumn("key", key_of(F.col("conv_id")))
    inside = pieces.select("key", "at", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "row"))
    inside = inside.select("key", "at", "i", F.md5(F.concat(F.octet_length("row.roles").cast("string"), F.lit(":"), "row.roles", "row.texts")).alias("digest"))
    first = inside.groupBy("key", "digest").agg(F.min(F.struct("at", "i")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = inside.join(broadcast_if_small(cut(first), 80), ["key", "digest"]).where(F.struct("at", "i") != F.col("first"))
    again = again.groupBy("key", "at").agg(F.collect_list("i").alias("again"))  # at most a piece's rows
    known = pieces.join(broadcast_if_small(cut(again), 64), ["key", "at"], "left")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, at, roles, texts, again_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                gone = set(again_ or ())
                codes = bytes(code_of(r, t, i in gone) for i, (r, t) in enumerate(zip(roles, texts, strict=True)))
                out.append((key, at, codes, matrix(codes).ravel().tolist()))
            cols = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)], ["key", "at", "codes", "costs"])

    codes = cut(known.select("key", "at", "roles", "texts", "again").mapInArrow(coded, "key string, at long, codes binary, costs array<long>"))

    def backward(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        steps = np.array(table["costs"].to_pylist(), np.int64).reshape(-1, 4, 4)
        after = [np.array(CLOSING, np.int64)]
        for m in steps[:0:-1]:
            after.append((m + after[-1][None]).min(1))
        final = [False] * (len(steps) - 1) + [True]
        return pa.table({"key": table["key"], "at": table["at"], "after": pa.array([x.tolist() for x in after[::-1]], pa.list_(pa.int64())), "final": final})

    after = codes.select("key", "at", "costs").groupBy("key").applyInArrow(backward, "key string, at long, after array<long>, final boolean")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, at, own, rest, final in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = [search(own, entry, tuple(rest)) for entry in range(4)]
                tail = ["I" * (CLOSING[last] // INSERT) if final else "" for _, last, _ in found]
                out.append((key, at, [a + t for (a, _, _), t in zip(found, tail, strict=True)], [x[1] for x in found], [x[2] for x in found]))
            cols = zip(*out, strict=True) if out else [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], ["key", "at", "audits", "exits", "totals"])

    audits = codes.select("key", "at", "codes").join(after, ["key", "at"]).select("key", "at", "codes", "after", "final")
    audits = cut(audits.mapInArrow(searched, "key string, at long, audits array<string>, exits array<long>, totals array<long>"))

    def forward(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        entries, state = [], START
        for exits in table["exits"].to_pylist():
            entries.append(state)
            state = exits[state]
        cost = table["totals"][0].as_py()[START]
        return pa.table({"key": table["key"], "at": table["at"], "entry": entries, "cost": [cost] + [0] * (len(entries) - 1)})

    entries = audits.select("key", "at", "exits", "totals").groupBy("key").applyInArrow(forward, "key string, at long, entry long, cost long")
    told = audits.join(entries, ["key", "at"]).select("key", "at", "entry", "cost", F.element_at("audits", (F.col("entry") + 1).cast("int")).alias("audit"))
    return pieces.join(codes.drop("costs"), ["key", "at"]).join(told, ["key", "at"])


def laid_out(pieces: DataFrame) -> DataFrame:
    """(key, conv_id, at, place, run, codes of a piece's edits): place 0 tells a piece's counts, cost and audit, the
    others are its edits."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    conv_type = _arrow(pieces)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, conv, at, turns, roles, texts, codes, entry, cost, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                run = counts(codes, texts, turns)
                done = list(edits(audit, entry, roles, texts))
                n = len(done)
                e, r, t = zip(*done, strict=True) if done else ((), (), ())
                rows = [pa.array([key] * (n + 1)), pa.array([conv] * (n + 1), conv_type), pa.array([at] * (n + 1)), pa.array(range(n + 1), pa.int32()),
                        pa.array([[*(run[f] for f in FIELDS), cost]] + [None] * n, pa.list_(pa.int64())), pa.array([audit, *e]), pa.array([None, *r], pa.string()), pa.array([None, *t], pa.string())]
                yield pa.RecordBatch.from_arrays(rows, ["key", "conv_id", "at", "place", "run", "edit", "role", "text"])

    chosen = pieces.select("key", "conv_id", "at", "turns", "roles", "texts", "codes", "entry", "cost", "audit")
    return chosen.mapInArrow(each, f"key string, conv_id {kind}, at long, place int, run array<long>, {LINE_TYPE}")


def told(parts: DataFrame) -> DataFrame:
    """The reports of open conversations, from their parts streamed in order."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    conv_type = _arrow(parts)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, conv, tally = None, None, None

        def out() -> pa.RecordBatch:
            cols = [pa.array([conv], conv_type), *(pa.array([x]) for x in tally.report())]
            return pa.RecordBatch.from_arrays(cols, ["conv_id", *REPORT])

        for batch in batches:
            for key, conv_id, run, edit, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id", "run", "edit", "role", "text")), strict=True):
                if tally is None or key != current:
                    if tally is not None:
                        yield out()
                    current, conv, tally = key, conv_id, Tally()
                if run is not None:
                    tally.add(dict(zip(FIELDS, run, strict=False)))
                    tally.cost += run[-1]
                    tally.audit.append(edit)
                elif edit != "D":
                    tally.write(role, text)
        if tally is not None:
            yield out()

    rows = parts.repartition("key").sortWithinPartitions("key", "at", "place")
    return rows.mapInArrow(each, f"conv_id {kind}, {REPORT_TYPE}")


def _numbered(turns: DataFrame, *names) -> DataFrame:
    return cut(named(turns, *names).withColumn("number", F.monotonically_increasing_id()))


def reports(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None, block: int = BLOCK) -> DataFrame:
    """One row per conversation: gaps in its turns, blank, repeated and truncated rows, illegal neighbours, the cost of
    the repair, the initials of its edits, and the hash of what it leaves."""
    found = cut(streamed(_numbered(turns, conv, turn, role, text, gone), False, block))
    whole = found.where("not open").select("conv_id", *REPORT)
    return whole.unionByName(told(laid_out(pieced(found.where("open").select("conv_id", "at", "turns", "roles", "texts")))))


def repaired(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None, block: int = BLOCK) -> DataFrame:
    """One row per edit, in the order of at and place: its initial, and role and text of the turn it leaves."""
    found = cut(streamed(_numbered(turns, conv, turn, role, text, gone), True, block))
    whole = found.where("not open").select("conv_id", "at", F.posexplode("lines").alias("place", "line")).select("conv_id", "at", (F.col("place") + 1).alias("place"), "line.*")
    pieces = pieced(found.where("open").select("conv_id", "at", "turns", "roles", "texts"))
    return whole.unionByName(laid_out(pieces).where("place > 0").select(*whole.columns))


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows harmed by a hash of their place, for trials of the repair: dropped (marked as gone), emptied, robbed of their
    full stops, repeated, or given to the user."""
    none = F.lit(" ")
    label = lambda c: F.coalesce(F.col(c).cast("string"), none)
    kind = F.crc32(F.concat(label(conv), F.lit(":"), label(turn))) % 20
    said = F.coalesce(F.col(text), none)
    said = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said)
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(F.col(role), none)).alias("role"), said.alias("text"), (kind == 0).alias("gone"), kind.alias("kind"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("copy", twice).select("conv_id", "turn", "role", "text", "gone")

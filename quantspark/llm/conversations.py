"""Conversation repair: the cheapest edits that give each conversation well-formed turns.

Role initials must spell nothing, or an optional system turn and pairs of user and assistant turns. An automaton of four
states accepts that; keeping, renaming, deleting and inserting rows give its arcs costs. It is determinised lazily:
the costs of reaching the four states, less the smallest, are one state of a table, whose transitions are computed when
a symbol first meets them and then looked up. States that can no longer be on a cheapest path are struck out, so the
table stays small for conversations of any length. A scan of the table gives the cost; going back over tight arcs marks
the states on cheapest paths, and a walk along marked states takes the least letter at each step.

Rows are spread by ranges of conversation and turn, so a conversation that holds much of the table lies in many tasks.
One that a task sees whole is repaired there. Pieces of the others give the cheapest costs between any two states at
their ends; these small tables, one for a block of rows, are combined per conversation, and the pieces are then traced
in order with a carried state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.llm.common import Scratch

SPACES = " \t\n\x0b\x0c\r"
STOPS = ".!?"
DELETE, INSERT, RENAME, CUT_OFF = 4, 3, 3, 3
FAR = 1 << 60
#: States: nothing yet, after system, after user, after assistant. Costs of reaching an end from each by inserts.
TO_END = (0, 2 * INSERT, INSERT, 0)
START = (0, FAR, FAR, FAR)
TURN_OF = {0: 2, 1: 2, 2: 3, 3: 2}
NAMES = {2: "user", 3: "assistant"}
#: Symbols: 0 must go; else 1 + 2 * (s, u, a, other) + (1 if cut off).
INITIALS = "sua"
BLANK, REPEATED, TRUNCATED = 1, 2, 3
#: Rows and characters of text that one block holds.
MAX_ROWS = 2048
MAX_CHARS = 1 << 20
PREFIX = 64


def closed(costs: tuple[int, ...]) -> tuple[int, ...]:
    """The costs with rows inserted where that is cheaper."""
    zero, one, two, three = costs
    two = min(two, min(zero, one, three) + INSERT)
    three = min(three, two + INSERT)
    return zero, one, min(two, FAR), min(three, FAR)


def _needed(costs: tuple[int, ...]) -> tuple[int, ...]:
    """The costs without states that no cheapest path can pass: whatever follows costs at most one deletion more from after
    an assistant turn than from the start, and no more than from after a system turn."""
    after = closed(costs)
    keep = (costs[0] <= after[3] + DELETE, costs[1] <= after[3], costs[2] <= after[2], costs[3] <= after[3])
    return tuple(c if k and c < FAR else FAR for c, k in zip(costs, keep, strict=True))


def row_arcs(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, next state, cost) of what may be done with a row."""
    arcs = [("D", state, DELETE)]
    if symbol:
        initial, cut = divmod(symbol - 1, 2)
        into = {0: 1 if state == 0 else None, 1: 2 if state != 2 else None, 2: 3 if state == 2 else None}.get(initial)
        if into is not None:
            arcs.append(("K", into, CUT_OFF * cut))
        arcs.append(("R", TURN_OF[state], RENAME + CUT_OFF * cut))
    return arcs


class Automaton:
    """The determinised automaton, as far as conversations have asked for it."""

    def __init__(self) -> None:
        self.number: dict[tuple[int, ...], int] = {}
        self.costs: list[tuple[int, ...]] = []
        self.after: list[tuple[int, ...]] = []
        self.table: dict[tuple[int, int], tuple[int, int]] = {}
        self.marked: dict[tuple[int, int, int], int] = {}
        self.walked: dict[tuple[int, int, int, int, int], tuple[str, int]] = {}

    def state(self, costs: tuple[int, ...]) -> tuple[int, int]:
        """The number of the state of these costs, and the smallest cost, which it leaves out."""
        low = min(costs)
        rest = _needed(tuple(c - low if c < FAR else FAR for c in costs))
        if rest not in self.number:
            self.number[rest] = len(self.costs)
            self.costs.append(rest)
            self.after.append(closed(rest))
        return self.number[rest], low

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, weight) by the table."""
        found = self.table.get((state, symbol))
        if found is None:
            reached = [FAR] * 4
            for p, cost in enumerate(self.after[state]):
                for _, q, more in row_arcs(symbol, p):
                    reached[q] = min(reached[q], cost + more, FAR)
            found = self.table[state, symbol] = self.state(tuple(reached))
        return found

    def _with_inserts(self, state: int, marks: int) -> int:
        after = self.after[state]
        # After user first: its insert may follow one that the others need.
        for p in (2, 3, 0, 1):
            q = TURN_OF[p]
            if marks >> q & 1 and after[p] < FAR and after[p] + INSERT == after[q]:
                marks |= 1 << p
        return marks

    def end_marks(self, state: int) -> int:
        """The states of the last column on cheapest paths."""
        after = self.after[state]
        best = min(after[0], after[3])
        return self._with_inserts(state, sum(1 << q for q in (0, 3) if after[q] == best))

    def back(self, state: int, symbol: int, marks: int) -> int:
        """The marked states before a row, given those after it: where tight arcs start."""
        key = (state, symbol, marks)
        found = self.marked.get(key)
        if found is None:
            then, weight = self.step(state, symbol)
            now, later = self.after[state], self.after[then]
            found = 0
            for p in range(4):
                if now[p] < FAR and any(marks >> q & 1 and now[p] + cost == later[q] + weight for _, q, cost in row_arcs(symbol, p)):
                    found |= 1 << p
            found = self.marked[key] = self._with_inserts(state, found)
        return found

    def walk(self, state: int, symbol: int, at: int, marks: int, next_marks: int) -> tuple[str, int]:
        """(letters, state after the row): the least letters along marked states up to and with a row's own."""
        key = (state, symbol, at, marks, next_marks)
        found = self.walked.get(key)
        if found is None:
            then, weight = self.step(state, symbol)
            now, later, letters = self.after[state], self.after[then], ""
            while True:
                tight = {a: q for a, q, cost in row_arcs(symbol, at) if next_marks >> q & 1 and now[at] + cost == later[q] + weight}
                if marks >> (q := TURN_OF[at]) & 1 and now[at] + INSERT == now[q]:
                    tight["I"] = q
                letter = min(tight)
                letters, at = letters + letter, tight[letter]
                if letter != "I":
                    break
            found = self.walked[key] = (letters, at)
        return found

    def finish(self, state: int, at: int) -> str:
        """The inserts that the end still needs."""
        best = min(self.after[state][0], self.after[state][3])
        letters = ""
        while at not in (0, 3) or self.after[state][at] != best:
            letters, at = letters + "I", TURN_OF[at]
        return letters

    def between(self, items: list[Item]) -> list[int]:
        """The cheapest costs from each state before the rows to each state after them, 16 in all."""
        out: list[int] = []
        for p in range(4):
            state, total = self.state(tuple(0 if q == p else FAR for q in range(4)))
            for item in items:
                state, weight = self.step(state, item.symbol)
                total += weight + DELETE * item.spare
            out += [c + total if c < FAR else FAR for c in self.costs[state]]
        return out


@dataclass
class Item:
    """Equal rows of a turn: one to judge and so many that can only go."""

    symbol: int
    spare: int
    role: str
    text: str
    turn: int | None = None


@dataclass
class Piece:
    """A run of rows of one conversation, with the counts that do not depend on the others."""

    items: list[Item] = field(default_factory=list)
    chars: int = 0
    rows: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    first_role: str | None = None
    last_role: str | None = None

    def add(self, turn: int | None, role: str, text: str, n: int, fault: int) -> None:
        if not n:
            return
        initial = role[:1]
        if self.rows:
            self.illegal += self.last_role + initial not in ("su", "ua", "au")
        else:
            self.first_role = initial
        self.illegal += n - 1
        self.last_role = initial
        self.rows += n
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        forced = fault in (BLANK, REPEATED)
        self.blank += n if fault == BLANK else 0
        self.duplicate += n if fault == REPEATED else n - 1 if fault != BLANK else 0
        self.truncated += fault == TRUNCATED
        place = INITIALS.find(initial) if initial else -1
        symbol = 0 if forced else 1 + 2 * (place if place >= 0 else 3) + (fault == TRUNCATED)
        self.items.append(Item(symbol, n - 1, role, text, turn))
        self.chars += len(role) + len(text)

    def summary(self) -> dict[str, Any]:
        return {c: getattr(self, c) for c in COUNTED}


COUNTED = ("rows", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first_role", "last_role")
COUNTED_TYPE = "rows long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_role string, last_role string"


@dataclass
class Told:
    """What a traced conversation gives: its edits and the repaired rows, or their hash."""

    keep_rows: bool
    letters: list[str] = field(default_factory=list)
    digest: Any = field(default_factory=hashlib.sha256)
    place: int = 0
    rows: list[dict[str, Any]] = field(default_factory=list)

    def edit(self, letters: str, at: int, item: Item | None) -> None:
        """Takes the letters of one step that starts in state at."""
        self.letters.append(letters)
        for letter in letters:
            if letter == "D":
                continue
            at = TURN_OF[at] if letter != "K" else {"s": 1, "u": 2, "a": 3}[item.role[:1]]
            role = item.role if letter == "K" else NAMES[at]
            text = "" if letter == "I" else item.text
            if self.keep_rows:
                self.rows.append({"place": self.place, "edit": letter, "turn": None if letter == "I" else item.turn, "role": role, "text": text})
            else:
                self.digest.update(f"{'' if not self.place else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.place += 1


def trace(automaton: Automaton, items: list[Item], start: tuple[int, ...], at: int, end_marks: int | None, told: Told) -> tuple[int, int]:
    """Walks a run of rows from state at along cheapest paths and tells the edits; (state reached, cost of the rows).

    start: the costs of reaching the states before the run. end_marks: the states behind it on cheapest paths, or None
    if the conversation ends there; the inserts of its end are told then too.
    """
    state, total = automaton.state(start)
    states = [state]
    for item in items:
        state, weight = automaton.step(state, item.symbol)
        total += weight + DELETE * item.spare
        states.append(state)
    marks = [automaton.end_marks(state) if end_marks is None else end_marks]
    for item, before in zip(reversed(items), reversed(states[:-1]), strict=True):
        marks.append(automaton.back(before, item.symbol, marks[-1]))
    marks.reverse()
    for i, item in enumerate(items):
        letters, then = automaton.walk(states[i], item.symbol, at, marks[i], marks[i + 1])
        told.edit(letters + "D" * item.spare, at, item)
        at = then
    if end_marks is None:
        told.edit(automaton.finish(state, at), at, None)
        total += min(automaton.after[state][0], automaton.after[state][3])
    return at, total


def _gaps(turns: int, first: int | None, last: int | None) -> int:
    return int(last) - int(first) + 1 - int(turns) if turns else 0


DIGEST_TYPE = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS_TYPE = "conv_id long, place long, edit string, turn long, role string, text string"
_DIGEST = pa.schema([("conv_id", pa.int64())] + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())])
_ROWS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_ITEMS = pa.list_(pa.struct([("symbol", pa.int32()), ("spare", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("turn", pa.int64())]))
_COUNTS = [(c, pa.string() if c.endswith("role") else pa.int64()) for c in COUNTED]
_BLOCK = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int64()), ("items", _ITEMS), ("between", pa.list_(pa.int64())), *_COUNTS])
BLOCK_TYPE = f"conv_id long, part int, block long, items array<struct<symbol:int,spare:long,role:string,text:string,turn:long>>, between array<long>, {COUNTED_TYPE}"


def _result(conv_id: int | None, counts: dict[str, Any], cost: int, told: Told) -> list[dict[str, Any]]:
    if told.keep_rows:
        return [{"conv_id": conv_id, **r} for r in told.rows]
    base = {c: counts[c] for c in ("blank", "duplicate", "truncated", "illegal")}
    return [{"conv_id": conv_id, "gaps": _gaps(counts["turns"], counts["first_turn"], counts["last_turn"]), **base, "cost": cost, "audit": "".join(told.letters), "repaired_sha256": told.digest.hexdigest()}]


def _batched(rows: Iterator[dict[str, Any]], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    """Rows in record batches of bounded text."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        told = row.get("done") or row.get("block") or row
        chars += sum(len(v) for v in told.values() if isinstance(v, str)) + sum(len(i["text"]) for i in told.get("items") or ())
        if len(held) == size or chars > MAX_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "fault")), strict=True)


def _pieces(keep_rows: bool, max_rows: int = MAX_ROWS):
    """What a sorted partition gives: results of the conversations that lie in it whole, and blocks of the two at its ends
    and of long ones. A result comes in the columns of its kind, in a field of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, automaton = TaskContext.get().partitionId(), Automaton()

        def told() -> Iterator[dict[str, Any]]:
            current, piece, cut, block, first = None, None, True, 0, True

            def flush(edge: bool) -> Iterator[dict[str, Any]]:
                nonlocal block
                if edge:
                    items = [vars(i) for i in piece.items]
                    yield {"block": {"conv_id": current, "part": part, "block": block, "items": items, "between": automaton.between(piece.items), **piece.summary()}}
                    block += 1
                else:
                    out = Told(keep_rows)
                    _, cost = trace(automaton, piece.items, START, 0, None, out)
                    for row in _result(current, piece.summary(), cost, out):
                        yield {"done": row}

            for conv_id, turn, role, text, n, fault in _sorted_rows(batches):
                if piece is None or conv_id != current:
                    if piece is not None:
                        yield from flush(cut)
                        first = False
                    current, piece, cut = conv_id, Piece(), first
                elif len(piece.items) >= max_rows or piece.chars >= MAX_CHARS:
                    cut = True
                    yield from flush(True)
                    piece = Piece()
                piece.add(turn, role, text, n, fault)
            if piece is not None:
                yield from flush(True)

        kind = pa.struct(list(_ROWS if keep_rows else _DIGEST))
        return _batched(told(), pa.schema([("done", kind), ("block", pa.struct(list(_BLOCK)))]))

    return run


def _times(costs: list[int], table: list[int]) -> list[int]:
    return [min(min(c + table[4 * p + q] for p, c in enumerate(costs)), FAR) for q in range(4)]


SLIM_TYPE = "part int, block long, start array<long>, marks int, last boolean, cost long, gaps long, blank long, duplicate long, truncated long, illegal long"


def _combined(pieces: pd.DataFrame) -> pd.DataFrame:
    """Start costs and end marks of the blocks of one conversation, from the cost tables of all its blocks."""
    pieces = pieces.sort_values(["part", "block"], kind="stable")
    tables = [list(map(int, t)) for t in pieces["between"]]
    starts = [list(START)]
    for t in tables:
        starts.append(_times(starts[-1], t))
    whole = closed(tuple(starts[-1]))
    cost = min(whole[0], whole[3])
    left = list(TO_END)
    marks = []
    for start, t in zip(reversed(starts[1:]), reversed(tables), strict=True):
        marks.append(sum(1 << q for q, c in enumerate(closed(tuple(start))) if c + left[q] == cost))
        # Closed, because a block starts with the inserts before its first row.
        left = [min(t[4 * p + q] + left[q] for q in range(4)) for p in range(4)]
    marks.reverse()
    illegal, turns, first, last, role = int(pieces["illegal"].sum()), int(pieces["turns"].sum()), None, None, None
    for p in pieces.itertuples():
        if p.rows:
            if role is not None:
                illegal += role + p.first_role not in ("su", "ua", "au")
            role = p.last_role
        if p.turns:
            turns -= int(last is not None and last == p.first_turn)
            first, last = p.first_turn if first is None else first, p.last_turn
    lowest = [[c - min(s) if c < FAR else FAR for c in s] for s in starts[:-1]]
    same = {"cost": cost, "gaps": _gaps(turns, first, last), "illegal": illegal, **{c: int(pieces[c].sum()) for c in ("blank", "duplicate", "truncated")}}
    out = pd.DataFrame({"part": pieces["part"].to_numpy(), "block": pieces["block"].to_numpy(), "start": lowest, "marks": marks, "last": [False] * (len(tables) - 1) + [True]})
    return out.assign(**same)[[c.split()[0] for c in SLIM_TYPE.split(", ")]]


def _joined_pieces(keep_rows: bool):
    """Traces the blocks of each conversation in order; the state, the hash and the letters are carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()

        def told() -> Iterator[dict[str, Any]]:
            at, out = 0, Told(keep_rows)
            for batch in batches:
                for r in range(batch.num_rows):
                    row = batch.slice(r, 1).to_pylist()[0]
                    items = [Item(**i) for i in row["items"]]
                    at, _ = trace(automaton, items, tuple(row["start"]), at, None if row["last"] else row["marks"], out)
                    if keep_rows or row["last"]:
                        counts = row | {"turns": 0, "first_turn": None, "last_turn": None}
                        for result in _result(row["conv_id"], counts, row["cost"], out):
                            yield result if keep_rows else result | {"gaps": row["gaps"]}
                        out.rows = []
                    if row["last"]:
                        at, out = 0, Told(keep_rows)

        return _batched(told(), _ROWS if keep_rows else _DIGEST)

    return run


def repair(rows: DataFrame, keep_rows: bool = True, partitions: int | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """Repairs conversations (conv_id, turn, role, text, n): n is how often a row stands, 0 for a conversation's rows that
    count no more; role and text are not null.

    keep_rows: the repaired rows (conv_id, place, edit, turn, role, text), where edit is K, R or I and an inserted row has
    no turn. Else one row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    Rows of a turn stand in the order of role and text; all copies of a row but the first are duplicates.
    """
    scratch = Scratch(rows.sparkSession, "conversations")
    text = F.col("text")
    blank = F.btrim(text, F.lit(SPACES)) == ""
    cut_off = ~F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1)).isin(*STOPS)
    words = F.sha2(text, 256)
    said = rows.where((F.col("n") > 0) & ~blank).groupBy("conv_id", "role", words.alias("said"))
    early = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    repeated = said.agg(early.alias("early"), F.count(F.lit(1)).alias("times")).where("times > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), "said", F.col("early.turn").alias("first_turn"), F.lit(True).alias("again"))
    # Equal rows become one before any shuffle that a group could fill.
    distinct = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    met = distinct.join(repeated, distinct["conv_id"].eqNullSafe(repeated["c"]) & (distinct["role"] == repeated["r"]) & (words == repeated["said"]), "left")
    later = F.col("again").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    fault = F.when(blank, BLANK).when(later, REPEATED).when(cut_off, TRUNCATED).otherwise(0)
    slim = met.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))
    ranges = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.left(text, F.lit(PREFIX))]
    spread = slim.repartitionByRange(partitions, *ranges) if partitions else slim.repartitionByRange(*ranges)
    ordered = spread.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    out_type = ROWS_TYPE if keep_rows else DIGEST_TYPE
    as_struct = lambda t: "struct<" + ", ".join(c.replace(" ", ":", 1) for c in t.split(", ")) + ">"
    found = scratch.save(ordered.mapInArrow(_pieces(keep_rows, max_rows), f"done {as_struct(out_type)}, block {as_struct(BLOCK_TYPE)}"), "found")
    done = found.where("done IS NOT NULL").select("done.*")
    blocks = found.where("block IS NOT NULL").select("block.*")
    slim_blocks = blocks.select("conv_id", "part", "block", "between", *COUNTED)
    solved = slim_blocks.groupBy("conv_id").applyInPandas(_combined, SLIM_TYPE)
    full = blocks.select("conv_id", "part", "block", "items").join(solved, ["part", "block"])
    in_order = full.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "block")
    return done.unionByName(in_order.mapInArrow(_joined_pieces(keep_rows), out_type))


def as_rows(conversations: DataFrame) -> DataFrame:
    """Conversations as repair() takes them: null roles and texts are one space."""
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).cast("long").alias("n"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows changed by the CRC of `conv_id:turn` modulo 20, nulls written as one space. A row that is dropped stays with
    n = 0 and no text, so that its conversation is not lost."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text = F.when(kind <= 1, "").when(kind == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    n = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long")
    return as_rows(conversations).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), n.alias("n"))


def repair_digest(conversations: DataFrame) -> DataFrame:
    """One row per conv_id after damage and repair: gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.

    A null conv_id is a conversation. Null turns come first; rows of one turn are ordered by role and text. Null roles
    and texts are one space, so such a text is blank. A role without an s, u or a at its start cannot be kept. Repeated
    rows are duplicates of the first, texts of any length are read whole, other columns are not read. A conversation
    whose rows are all dropped has zeros, no edits and the hash of the empty string; an empty table gives an empty
    result. The hash of a conversation is one stream: its pieces are traced one after the other in one task, in blocks.
    """
    return repair(damaged(conversations), keep_rows=False)

"""Repair of conversation structure by weighted interval parsing, bottom-up by span length.

Kept roles must spell ``(s?(ua)+)?``. In Chomsky normal form the repair grammar
has a nonterminal for each way from one point of that pattern to another: p-q
derives the edited rows of a span that lead from p to q, by a rule p-q -> p-r
r-q for every r between, or by a terminal, which is one row kept, given another
role, or deleted. A row's cell is closed under insertion on both sides. A cell
holds for each nonterminal the least cost and, among these, the least audit.
Joining such cells is exact: edits of equal cost over the same rows never spell
one audit that begins another, since what is longer has more insertions and
costs more, so the lesser left part gives the lesser whole. All splits of a span
give the same cell, as p-q is made from every r; so spans of 1, 2, 4, ... rows
are built from two halves each, and n rows need n - 1 joins instead of n cubed.

Rows are sorted by conversation and turn over all tasks. A conversation that
lies inside one task is parsed there. One that may go on in another task is
parsed in chunks, whose cells are few and are joined per conversation; its first
of equal rows come from a grouping of their hashes. A repeated row is one row
with its number of copies. So a conversation with a third of all rows is spread
over tasks; only its edits, one letter a row, and the digest of its repaired
text, which no one can work out in parts, pass through one task in order, rows
streamed.

Odd rows: null keys are a conversation of their own; null roles and texts count
as one space; null turns come first. Rows of one turn stand by the first 64
characters of role and text, then a hash. A role counts by its first character,
so ``""`` and unknown roles must be given another or go. An empty table gives an
empty result. Only the four named columns are read, so others may have any name.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.llm.common import marks, stored

SPACES = " \t\n\v\f\r"
ROLE = {"u": "user", "a": "assistant"}
#: Points of the pattern: start, after system, after user, after assistant.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
LEGAL = ("su", "ua", "au")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

Cell = tuple[tuple[int, str] | None, ...]


def _reachable() -> list[tuple[int, int]]:
    pairs = {(p, p) for p in range(4)}
    while True:
        more = pairs | {(p, q) for p, r in pairs for (s, _), q in MOVES.items() if r == s}
        if more == pairs:
            return sorted(pairs)
        pairs = more


#: Nonterminals, and the rules p-q -> p-r r-q by their numbers.
PAIRS = _reachable()
RULES = [(PAIRS.index((p, q)), PAIRS.index((p, r)), i) for p, r in PAIRS for i, (s, q) in enumerate(PAIRS) if r == s]


def joined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: list[tuple[int, str] | None] = [None] * len(PAIRS)
    for goal, one, two in RULES:
        a, b = left[one], right[two]
        if a is None or b is None:
            continue
        cost, best = a[0] + b[0], out[goal]
        if best is None or cost < best[0]:
            out[goal] = (cost, a[1] + b[1])
        elif cost == best[0] and (audit := a[1] + b[1]) < best[1]:
            out[goal] = (cost, audit)
    return tuple(out)


def _cell(ways: Iterable[tuple[int, int, int, str]]) -> Cell:
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for p, q, cost, audit in ways:
        best[p, q] = min(best.get((p, q), (cost, audit)), (cost, audit))
    return tuple(best.get(pair) for pair in PAIRS)


#: Insertions alone: no rows, every way on the pattern by users and assistants.
EMPTY = _cell((p, p, 0, "") for p in range(4))
_STEP = _cell([(p, p, 0, "") for p in range(4)] + [(p, q, INSERT, "I") for (p, c), q in MOVES.items() if c in ROLE])
CLOSURE = joined(joined(_STEP, _STEP), _STEP)


@functools.cache
def terminal(initial: str, fault: str) -> Cell:
    """The closed cell of one row."""
    ways = [(p, p, DELETE, "D") for p in range(4)]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        for (p, c), q in MOVES.items():
            if c == initial:
                ways.append((p, q, KEEP + more, "K"))
            if c in ROLE:
                ways.append((p, q, REROLE + more, "R"))
    return joined(joined(CLOSURE, _cell(ways)), CLOSURE)


def deletions(n: int) -> Cell:
    """The cell of ``n`` rows that must go, by doubling."""
    if n == 1:
        return terminal("", "duplicate")
    half = deletions(n // 2)
    return joined(joined(half, half), terminal("", "duplicate")) if n % 2 else joined(half, half)


def fault_of(text: str, earlier: bool) -> str:
    """The first fault of a row, if any."""
    end = text.rstrip(SPACES)
    if not end:
        return "blank"
    return "duplicate" if earlier else "truncated" if end[-1] not in ".!?" else ""


@dataclass
class Span:
    """What is known of neighbouring rows: their faults, turns, roles at both ends, and cells of spans of doubling length."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    distinct: int = 0
    low: int | None = None
    high: int | None = None
    first: str | None = None
    last: str | None = None
    size: int = 0
    cells: list[tuple[int, Cell]] = field(default_factory=list)

    def push(self, rows: int, cell: Cell) -> None:
        self.cells.append((rows, cell))
        while len(self.cells) > 1 and self.cells[-2][0] <= self.cells[-1][0]:
            (m, right), (n, left) = self.cells.pop(), self.cells.pop()
            self.cells.append((m + n, joined(left, right)))

    def cell(self) -> Cell:
        out = EMPTY
        for _, left in reversed(self.cells):
            out = joined(left, out)
        return out

    def row(self, turn: int | None, role: str, text: str, n: int, earlier: bool) -> None:
        fault, initial = fault_of(text, earlier), role[:1]
        cell = terminal(initial if initial in ("s", "u", "a") else "", fault)
        span = Span(first=initial, last=initial, low=turn, high=turn, distinct=int(turn is not None), size=n, illegal=n - 1)
        again = "blank" if fault == "blank" else "duplicate"
        setattr(span, again, n - 1)
        if fault:
            setattr(span, fault, getattr(span, fault) + 1)
        span.cells = [(n, joined(cell, deletions(n - 1)) if n > 1 else cell)]
        self.add(span)

    def add(self, other: Span) -> None:
        """Append the rows of ``other``."""
        if self.size and other.size:
            self.illegal += self.last + other.first not in LEGAL
        for name in ("blank", "duplicate", "truncated", "illegal", "distinct"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        # turns ascend, so one turn at most lies on both sides
        self.distinct -= self.high is not None and self.high == other.low
        self.low = other.low if self.low is None else self.low
        self.high = self.high if other.high is None else other.high
        self.first = self.first if self.size else other.first
        self.last = other.last if other.size else self.last
        self.size += other.size
        for rows, cell in other.cells:
            self.push(rows, cell)

    def found(self) -> dict:
        """The result columns that need no texts."""
        cost, audit = min(way for pair, way in zip(PAIRS, self.cell(), strict=True) if pair[0] == 0 and pair[1] in ENDS and way is not None)
        gaps = self.high - self.low + 1 - self.distinct if self.high is not None else 0
        counts = {name: getattr(self, name) for name in ("blank", "duplicate", "truncated", "illegal")}
        return {"gaps": gaps, **counts, "cost": cost, "audit": audit}


class Edits:
    """Turns rows in order, with the letters of their audit, into the repaired rows."""

    def __init__(self, audit: str):
        self.audit, self.at, self.point = audit, 0, 0

    def _move(self, role: str | None) -> str:
        if role is None:
            role = ROLE["u" if (self.point, "u") in MOVES else "a"]
        self.point = MOVES[self.point, role[:1]]
        return role

    def _inserted(self) -> Iterator[tuple[str, None, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield "I", None, self._move(None), ""

    def row(self, turn: int | None, role: str, text: str, n: int) -> Iterator[tuple[str, int | None, str, str]]:
        """(edit, turn, role, text) of insertions before these ``n`` equal rows, and of them."""
        for _ in range(n):
            yield from self._inserted()
            letter = self.audit[self.at]
            self.at += 1
            yield letter, turn, role if letter == "D" else self._move(role if letter == "K" else None), text

    def end(self) -> Iterator[tuple[str, None, str, str]]:
        yield from self._inserted()


class _Digest:
    """Digest of the repaired text, row by row."""

    def __init__(self) -> None:
        self.sha, self.begun = hashlib.sha256(), False

    def add(self, edits: Iterable[tuple[str, int | None, str, str]]) -> None:
        for letter, _, role, text in edits:
            if letter != "D":
                self.sha.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode())
                self.begun = True


FOUND = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
ROWS = "_part int, _seq bigint, _turn bigint, _role string, _text string, _n bigint"
EDITS = "place bigint, edit string, turn bigint, role string, text string"
#: Characters of one conversation that a task holds before it takes it for one that goes on elsewhere.
HELD = 1 << 25
ROWS_OUT = 2000


def _schema(key: T.DataType, *parts: str) -> T.StructType:
    fields = [field for part in parts for field in T.StructType.fromDDL(part).fields]
    return T.StructType([T.StructField("_key", key), *fields])


class _Out:
    """Rows as Arrow batches of one schema; missing columns are null."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.weight = schema, [], 0

    def add(self, row: dict) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.weight += len(row.get("_text") or row.get("text") or row.get("audit") or "")
        if len(self.rows) >= ROWS_OUT or self.weight > HELD // 4:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_pylist(self.rows, schema=self.schema)
        self.rows, self.weight = [], 0


def _input(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_OUT):
            yield from zip(*[c.to_pylist() for c in batch.slice(start, ROWS_OUT).columns], strict=True)


def _closed(key: object, held: list[tuple], turns: bool) -> Iterator[dict]:
    """The result of a conversation of which all rows are at hand."""
    span, seen = Span(), set()
    for turn, role, text, n in held:
        span.row(turn, role, text, n, (role, text) in seen)
        seen.add((role, text))
    found = span.found()
    edits, digest, place = Edits(found["audit"]), _Digest(), 0
    for part in [edits.row(*row) for row in held] + [edits.end()]:
        if turns:
            for letter, turn, role, text in part:
                yield {"_key": key, "place": place, "edit": letter, "turn": turn, "role": role, "text": text}
                place += 1
        else:
            digest.add(part)
    if not turns:
        yield {"_key": key, **found, "repaired_sha256": digest.sha.hexdigest()}


def _first_pass(schema: pa.Schema, turns: bool) -> Callable:
    """Results of conversations inside this task; rows of those that may go on in another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part = _Out(schema), TaskContext.get().partitionId()
        key: object = None
        held: list[tuple] = []
        weight = seq = 0
        begun, whole = False, False

        def opened() -> Iterator[pa.RecordBatch]:
            nonlocal held, seq, weight
            for turn, role, text, n in held:
                yield from out.add({"_key": key, "_part": part, "_seq": seq, "_turn": turn, "_role": role, "_text": text, "_n": n})
                seq += 1
            held, weight = [], 0

        for row in _input(batches):
            if not begun or row[0] != key:
                # the first conversation of a task may have begun in another
                if begun and whole:
                    for result in _closed(key, held, turns):
                        yield from out.add(result)
                elif begun:
                    yield from opened()
                key, held, weight, seq, whole, begun = row[0], [], 0, 0, begun, True
            held.append(row[1:])
            weight += len(row[2]) + len(row[3])
            if not whole or weight > HELD:
                whole = False
                yield from opened()
        if begun:
            yield from opened()
        yield from out.flush()

    return run


def _groups(rows: Iterator[tuple], width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Neighbouring rows that agree in their first ``width`` columns, streamed."""
    rest = iter(rows)
    row = next(rest, None)
    while row is not None:
        lead = row[:width]

        def members() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[:width] == lead:
                yield row
                row = next(rest, None)

        inside = members()
        yield lead, inside
        for _ in inside:
            pass


SPAN = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, distinct bigint, low bigint, high bigint, first string, last string, size bigint"
COUNTS = [c.split()[0] for c in SPAN.split(", ")]


def _chunks(schema: pa.Schema) -> Callable:
    """One span for each chunk of a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(schema)
        for (key, part), rows in _groups(_input(batches), 2):
            span = Span()
            for _, _, turn, role, text, n, first in rows:
                span.row(turn, role, text, n, not first)
            cell = span.cell()
            known = {name: getattr(span, name) for name in COUNTS}
            costs, audits = [w and w[0] for w in cell], [w and w[1] for w in cell]
            yield from out.add({"_key": key, "_part": part, **known, "costs": costs, "audits": audits})
        yield from out.flush()

    return run


def _whole(schema: pa.Schema) -> Callable:
    """Spans of a conversation's chunks joined: its row of results, to stand before its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(schema)
        for (key,), chunks in _groups(_input(batches), 1):
            span = Span()
            for _, _, *known, costs, audits in chunks:
                cell = tuple(None if c is None else (c, a) for c, a in zip(costs, audits, strict=True))
                span.add(Span(**dict(zip(COUNTS, known, strict=True)), cells=[(known[-1], cell)]))
            yield from out.add({"_key": key, "_part": -1, "_seq": -1, **span.found()})
        yield from out.flush()

    return run


def _second_pass(schema: pa.Schema, turns: bool) -> Callable:
    """Results of conversations whose row of results stands before their rows."""
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(schema)
        for (key,), rows in _groups(_input(batches), 1):
            head = next(rows)
            found = dict(zip(names, head[7:], strict=True))
            edits, digest, place = Edits(found["audit"]), _Digest(), 0

            def parts(rows=rows, edits=edits):
                for row in rows:
                    yield edits.row(*row[3:7])
                yield edits.end()

            for part in parts():
                if not turns:
                    digest.add(part)
                    continue
                for letter, turn, role, text in part:
                    yield from out.add({"_key": key, "place": place, "edit": letter, "turn": turn, "role": role, "text": text})
                    place += 1
            if not turns:
                yield from out.add({"_key": key, **found, "repaired_sha256": digest.sha.hexdigest()})
        yield from out.flush()

    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def _repaired(rows: DataFrame, key: str, turn: str, role: str, text: str, turns: bool) -> DataFrame:
    kind = rows.schema[key].dataType
    named = rows.select(F.col(key).alias("_key"), F.col(turn).cast("bigint").alias("_turn"), _text(role).alias("_role"), _text(text).alias("_text"))
    # equal rows combine before they move, so that no number of copies makes a large task
    merged = named.groupBy("_key", "_turn", "_role", "_text").agg(F.count(F.lit(1)).alias("_n"))
    place = [F.substring("_role", 1, 64).alias("_r"), F.substring("_text", 1, 64).alias("_t"), F.xxhash64("_role", "_text").alias("_h")]
    order = ["_key", "_turn", "_r", "_t", "_h"]
    ranged = merged.select("*", *place).repartitionByRange(*order).sortWithinPartitions(*order).select("_key", "_turn", "_role", "_text", "_n")
    result = EDITS if turns else f"{FOUND}, repaired_sha256 string"
    shape = _schema(kind, ROWS, result)
    parsed = stored(ranged.mapInArrow(_first_pass(_arrow(shape), turns), shape), "conversations")
    wanted = [c.split()[0] for c in result.split(", ")]
    done = parsed.filter(F.col("_part").isNull()).select("_key", *wanted)

    going_on = parsed.filter(F.col("_part").isNotNull()).select("_key", *[c.split()[0] for c in ROWS.split(", ")])
    place_of = F.struct("_part", "_seq")
    firsts = (
        going_on.groupBy("_key", "_role", *[m.alias(f"_m{i}") for i, m in enumerate(marks(F.col("_text")))])
        .agg(F.min(place_of).alias("_at"))
        .select(F.col("_key").alias("_k"), F.col("_at._part").alias("_p"), F.col("_at._seq").alias("_s"))
    )
    met = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")) & (F.col("_seq") == F.col("_s"))
    flagged = going_on.join(firsts, met, "left").withColumn("_first", F.col("_p").isNotNull()).drop("_k", "_p", "_s")
    spans = _schema(kind, "_part int", SPAN, "costs array<bigint>, audits array<string>")
    chunks = flagged.repartition("_key", "_part").sortWithinPartitions("_key", "_part", "_seq").drop("_seq").mapInArrow(_chunks(_arrow(spans)), spans)
    heads = _schema(kind, "_part int, _seq bigint", FOUND)
    headed = stored(chunks.repartition("_key").sortWithinPartitions("_key", "_part").mapInArrow(_whole(_arrow(heads)), heads), "audits")
    both = going_on.unionByName(headed, allowMissingColumns=True).repartition("_key").sortWithinPartitions("_key", "_part", "_seq")
    last = _schema(kind, result)
    return done.unionByName(both.mapInArrow(_second_pass(_arrow(last), turns), last)).withColumnRenamed("_key", key)


def repairs(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: ``key``, faults, least ``cost`` and ``audit`` of its repair, and the digest of the repaired text."""
    return _repaired(rows, key, turn, role, text, False)


def repaired_turns(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: ``key, place, edit, turn, role, text`` of every row and insertion in order, deleted ones included."""
    return _repaired(rows, key, turn, role, text, True)


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with a twentieth of all turns each dropped, emptied, cut, repeated and given to the user."""
    named = F.concat_ws(":", _text("conv_id"), _text("turn"))
    kind = F.crc32(named) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(_text("text"), "[.!?]", "")).otherwise(_text("text"))
    role = F.when(kind == 4, "user").otherwise(_text("role"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    left = rows.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
    return left.select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy")).drop("copy")

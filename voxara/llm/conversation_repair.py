"""Conversation repair: the cheapest edits that give a conversation's roles the form (s?(ua)+)?, by a lazily determinised weighted automaton.

The edits of a row (keep, rerole, delete, insertions before it) are arcs between four states of the form. Rows are
scanned from the last to the first: the costs of finishing from every state, less the least of them, are one state of the
determinised automaton, whose steps are computed when first met and then read from a table. The scan gives the cost; a
trace back over the scanned states, along arcs whose costs are tight, gives the edits, least in ASCII order, and steps of
the trace are kept in a table too.

Rows move to ranges of (conversation, turn, role, text), so that a conversation of any length is dealt over many tasks.
Conversations that lie whole within a task and have at most BLOCK_ROWS rows are repaired there; of the others, blocks of
rows are stored, their symbols (one byte a row, no more than the audit that is asked for) meet in one task, and texts are
joined by blocks and hashed as they stream by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby, pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voxara.llm.common import Batches, join_hot, read_table, stash, tidy

KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 3, 4, 3, 3
#: Rows and characters of a block of a conversation that isn't repaired within one task.
BLOCK_ROWS, BLOCK_CHARS = 2_000, 4_000_000
_SPACE = " \t\n\x0b\x0c\r"
#: States of the form: nothing yet, after s, after u, after a; and where each initial leads.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Rows' symbols: 0 must go; else 1 + 2 * (s, u, a or another initial) + (truncated).
GONE, INITIALS = 0, "sua"
SYMBOLS = 9
_FAR = 1 << 40
#: Pairs of initials that may follow each other, and the columns that are sums over a conversation's rows.
LEGAL = ("su", "ua", "au")
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def symbol(initial: str, truncated: bool) -> int:
    return 1 + 2 * (INITIALS.index(initial) if initial and initial in INITIALS else 3) + truncated


def _inserted(costs: list[int]) -> tuple[int, ...]:
    """Costs of finishing from each state where insertions may come first."""
    out = list(costs)
    out[USER] = min(costs[USER], INSERT + costs[ASSISTANT])
    out[ASSISTANT] = min(costs[ASSISTANT], INSERT + costs[USER])
    for q in (START, SYSTEM):
        out[q] = min(costs[q], INSERT + out[USER])
    return tuple(out)


def _arcs(q: int, what: int) -> Iterator[tuple[str, int, int]]:
    """(initial of the edit, cost, next state) of a row's edits from q."""
    if what == GONE:
        yield "D", DELETE, q
        return
    kind, truncated = divmod(what - 1, 2)
    yield "D", DELETE, q
    if kind < 3 and (q, INITIALS[kind]) in STEPS:
        yield "K", KEEP + BROKEN * truncated, STEPS[q, INITIALS[kind]]
    for role in "ua":
        if (q, role) in STEPS:
            yield "R", REROLE + BROKEN * truncated, STEPS[q, role]


@dataclass
class Automaton:
    """The determinised automaton, as far as rows have led through it."""

    vectors: list[tuple[int, ...]] = field(default_factory=list)
    ids: dict[tuple[int, ...], int] = field(default_factory=dict)
    #: (state after the row) * SYMBOLS + symbol: the state before it and what the least cost grows by; None where not met.
    table: list[tuple[int, int] | None] = field(default_factory=list)
    #: (NFA states as bits, symbol, state after the row): (edits, NFA states after them).
    traced: dict[tuple[int, int, int], tuple[str, int]] = field(default_factory=dict)

    def state(self, costs: tuple[int, ...]) -> tuple[int, int]:
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.ids:
            self.ids[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.table += [None] * SYMBOLS
        return self.ids[vector], least

    def step(self, after: int, what: int) -> tuple[int, int]:
        found = self.table[after * SYMBOLS + what]
        if found is None:
            ends = self.vectors[after]
            found = self.state(_inserted([min(c + ends[to] for _, c, to in _arcs(q, what)) for q in range(4)]))
            self.table[after * SYMBOLS + what] = found
        return found

    def scan(self, symbols: bytes) -> tuple[int, list[int]]:
        """The least cost and the automaton's state before every row and after the last."""
        now, cost = self.state(_inserted([0, _FAR, _FAR, 0]))
        states = [now]
        for what in reversed(symbols):
            now, grown = self.step(now, what)
            cost += grown
            states.append(now)
        states.reverse()
        return cost + self.vectors[now][START], states

    def segment(self, at: int, what: int, after: int) -> tuple[str, int]:
        """The least edits up to and with a row that tight arcs allow from the NFA states of at, and the states they lead to."""
        key = at, what, after
        if key not in self.traced:
            before, grown = self.step(after, what)
            costs, ends = self.vectors[before], self.vectors[after]
            edits, now = "", {q for q in range(4) if at >> q & 1}
            while True:
                tight: dict[str, set[int]] = {}
                for q in now:
                    for name, c, to in _arcs(q, what):
                        if c + ends[to] == costs[q] + grown:
                            tight.setdefault(name, set()).add(to)
                    for role in "ua":
                        to = STEPS.get((q, role))
                        if to is not None and INSERT + costs[to] == costs[q]:
                            tight.setdefault("I", set()).add(to)
                name = min(tight)
                edits, now = edits + name, tight[name]
                if name != "I":
                    break
            self.traced[key] = edits, sum(1 << q for q in now)
        return self.traced[key]

    def repair(self, symbols: bytes) -> tuple[int, list[str]]:
        """The least cost, and the least edits of it: those up to each row, and the insertions after the last."""
        cost, states = self.scan(symbols)
        out, at = [], 1 << START
        for what, after in zip(symbols, states[1:], strict=True):
            edits, at = self.segment(at, what, after)
            out.append(edits)
        q = next(q for q in range(4) if at >> q & 1)
        return cost, [*out, "I" * (self.vectors[states[-1]][q] // INSERT)]


def repaired(edits: str, length: int, first: int, rows: list[tuple[str, str]]) -> list[str]:
    """The lines role:text that edits make of rows, which are those that aren't deleted.

    length: all lines of the conversation, first: the number of the first of these. Of an odd number the first is s; the
    others are u and a in turn, so edits alone tell the roles.
    """
    lines, left = [], iter(rows)
    for e in edits:
        if e == "D":
            continue
        if e == "I":
            role, text = "", ""
        else:
            role, text = next(left)
        if e != "K":
            role = "user" if (first + length) % 2 == 0 else "assistant"
        lines.append(f"{role}:{text}")
        first += 1
    return lines


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text, there, k of the rows after damage; a dropped row stays without role and text, there false.

    Null roles and texts, and null ids and turns within the hashed name, are one space. A repeated row comes twice.
    """
    space = lambda c, kind: F.coalesce(F.col(c).cast(kind).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(space("conv_id", "bigint"), F.lit(":"), space("turn", "bigint"))) % 20
    text, role = space("text", "string"), space("role", "string")
    df = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv"),
        F.col("turn").cast("bigint").alias("turn"),
        F.when(harm == 4, "user").otherwise(role).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (harm != 0).alias("there"),
        F.explode(F.array_repeat(F.lit(0), F.when(harm == 3, 2).otherwise(1))).alias("_"),
    )
    k = F.when(F.col("there"), F.sha2(F.concat(F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.lit(":"), F.length("role"), F.lit(":"), "role", "text"), 256))
    return df.select("conv", "turn", F.when(F.col("there"), F.col("role")).alias("role"), F.when(F.col("there"), F.col("text")).alias("text"), "there", F.unhex(k).alias("k"))


def faulty(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, there, copy, blank, truncated of damaged rows; copy: an equal row has a lesser turn.

    Equal rows of one turn are neighbours in order and are told there. A conversation that is said again and again has one
    entry in the table of copies, which doesn't move its rows (see join_hot).
    """
    named = rows.select("*", F.coalesce("turn", F.lit(-(1 << 63))).alias("_turn"))
    again = named.filter("k is not null").groupBy("k").agg(F.min("_turn").alias("least"), F.max("_turn").alias("most"), F.count("*").alias("copies")).filter("least < most")
    known = join_hot(named, stash(again.select("k", "least", "copies"), "said", packed=True)[0], "k", "copies", "left")
    last = F.right(F.rtrim("text", F.lit(_SPACE)), F.lit(1))
    return known.select("conv", "turn", "role", "text", "there", F.coalesce(F.col("least") < F.col("_turn"), F.lit(False)).alias("copy"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))


def _schema(columns: str) -> T.StructType:
    """Columns of "name type, ..." without a session, which workers lack."""
    kinds = {"bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "string": T.StringType(), "binary": T.BinaryType(), "array<string>": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(n, kinds[t]) for n, t in (c.split() for c in columns.split(", "))])


#: A conversation's part within a task: done ones have cost and the rest, blocks of others have symbols and rows.
PART = _schema(
    "conv bigint, task int, number int, done boolean, mint bigint, maxt bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, before string, after string, cost bigint, audit string, sha string, "
    "symbols binary, roles array<string>, texts array<string>"
)


class _Part:
    """A run of a conversation's rows in order."""

    def __init__(self, task: int, number: int, conv: int | None):
        self.task, self.number, self.conv = task, number, conv
        self.symbols, self.kept, self.chars = bytearray(), [], 0
        self.mint = self.maxt = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before = self.after = None

    def add(self, turn: int | None, role: str, copy: bool, blank: bool, truncated: bool, text: str) -> None:
        initial = role[:1]
        if self.before is None:
            self.before = initial
        elif self.after + initial not in LEGAL:
            self.illegal += 1
        self.after = initial
        if turn is not None:
            self.turns += turn != self.maxt
            self.mint, self.maxt = turn if self.mint is None else self.mint, turn
        self.blank += blank
        self.duplicate += copy and not blank
        cut = truncated and not copy and not blank
        self.truncated += cut
        if blank or copy:
            self.symbols.append(GONE)
        else:
            self.symbols.append(symbol(initial, cut))
            self.kept.append((role, text))
            self.chars += len(text)

    def row(self, machine: Automaton | None) -> dict:
        """The part as a row of PART, repaired where machine is given."""
        out = {n: getattr(self, n) for n in ("conv", "task", "number", *COUNTS, "mint", "maxt", "turns", "before", "after")}
        out["done"] = machine is not None
        if machine is None:
            return out | {"symbols": bytes(self.symbols), "roles": [r for r, _ in self.kept], "texts": [t for _, t in self.kept]}
        cost, segments = machine.repair(bytes(self.symbols))
        audit = "".join(segments)
        lines = repaired(audit, len(audit) - audit.count("D"), 0, edited(self.symbols, audit, self.kept))
        return out | {"cost": cost, "audit": audit, "sha": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def edited(symbols: bytes, edits: str, kept: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The rows of kept (which lacks those that must go) that edits keep or rerole."""
    left, out = iter(kept), []
    for what, e in zip(symbols, edits.replace("I", ""), strict=True):
        row = next(left) if what != GONE else None
        if e != "D":
            out.append(row)
    return out


def packer(block_rows: int) -> Batches:
    """A function of a task's sorted rows that returns PART rows. The task's first and last conversation may go on in other tasks and are not repaired there."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, machine = TaskContext.get().partitionId(), Automaton()
        part, previous, split = None, None, True
        out: list[dict] = []
        size = 0
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("conv", "turn", "role", "text", "there", "copy", "blank", "truncated")]
            for conv, turn, role, text, there, copy, blank, truncated in zip(*columns, strict=True):
                if part is None or part.conv != conv:
                    if part is not None:
                        out.append(part.row(None if split else machine))
                        size += len(part.symbols) + part.chars * split
                        split = False
                    part, previous = _Part(task, 0, conv), None
                if there:
                    same = (turn, role, text) == previous
                    if (len(part.symbols) >= block_rows or part.chars >= BLOCK_CHARS) and not same:
                        out.append(part.row(None))
                        size += len(part.symbols) + part.chars
                        part, split = _Part(task, part.number + 1, conv), True
                    part.add(turn, role, copy or same, blank, truncated, text)
                    previous = turn, role, text
                if size > BLOCK_CHARS:
                    yield _rows(out, PART)
                    out, size = [], 0
        if part is not None:
            out.append(part.row(None))
        if out:
            yield _rows(out, PART)

    return pack


#: A part's edits; the last part of a conversation has what is known of the whole.
SOLVED = _schema("conv bigint, task int, number int, edits string, first bigint, length bigint, last boolean, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SOLVED rows of conversations in parts, which come in order."""
    machine = Automaton()
    rows = (row for batch in batches for row in batch.to_pylist())
    for conv, group in groupby(rows, key=lambda r: r["conv"]):
        parts = list(group)
        cost, segments = machine.repair(b"".join(p["symbols"] for p in parts))
        audit = "".join(segments)
        whole = {n: sum(p[n] for p in parts) for n in COUNTS}
        said = [p for p in parts if p["before"] is not None]
        whole["illegal"] += sum(a["after"] + b["before"] not in LEGAL for a, b in pairwise(said))
        timed = [p for p in parts if p["mint"] is not None]
        shared = sum(a["maxt"] == b["mint"] for a, b in pairwise(timed))
        gaps = timed[-1]["maxt"] - timed[0]["mint"] + 1 - sum(p["turns"] for p in timed) + shared if timed else 0
        out, at, line = [], 0, 0
        for i, p in enumerate(parts):
            stop, last = at + len(p["symbols"]), i + 1 == len(parts)
            edits = "".join(segments[at : None if last else stop])
            out.append({"conv": conv, "task": p["task"], "number": p["number"], "edits": edits, "first": line, "length": len(audit) - audit.count("D"), "last": last})
            at, line = stop, line + len(edits) - edits.count("D")
        out[-1] |= whole | {"gaps": gaps, "cost": cost, "audit": audit}
        yield _rows(out, SOLVED)


#: The rows of the result; conv is the conversation's id.
RESULT = _schema("conv bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, sha string")


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """solved parts with symbols, roles and texts, as they are with piece: the lines that a part has in the repaired text."""
    for batch in batches:
        for row in batch.to_pylist():
            kept = list(zip(row.pop("roles"), row.pop("texts"), strict=True))
            lines = repaired(row["edits"], row["length"], row["first"], edited(row.pop("symbols"), row["edits"], kept))
            piece = ("\n" if lines and row["first"] else "") + "\n".join(lines)
            yield _rows([{n: row[n] for n in PIECE.names if n != "piece"} | {"piece": piece}], PIECE)


PIECE = T.StructType([f for f in SOLVED.fields if f.name not in ("edits", "first", "length")] + [T.StructField("piece", T.StringType())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RESULT rows of conversations whose pieces come in order; none is held longer than it takes to hash it."""
    sha = hashlib.sha256()
    for batch in batches:
        for row in batch.to_pylist():
            sha.update(row["piece"].encode())
            if row["last"]:
                yield _rows([{n: row.get(n) for n in RESULT.names} | {"sha": sha.hexdigest()}], RESULT)
                sha = hashlib.sha256()


def _rows(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, to_arrow_schema(schema))


def repairs(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, after damage.

    Nulls: see damaged; rows without an id are one conversation. Rows of one turn are ordered by role and text. A
    conversation whose rows were all dropped has zeros, no audit and the hash of the empty text. Other columns are
    ignored, and an empty table gives no rows.
    """
    order = ["conv", "turn", "role", "text"]
    rows = faulty(damaged(conversations)).repartitionByRange(*order).sortWithinPartitions(*order)
    parts, _ = stash(rows.mapInArrow(tidy(packer(block_rows)), PART), "parts")
    done = parts.filter("done").select("conv", F.when(F.col("mint").isNull(), 0).otherwise(F.col("maxt") - F.col("mint") + 1 - F.col("turns")).alias("gaps"), *COUNTS, "cost", "audit", "sha")
    open_ = parts.filter("not done")
    in_order = lambda df: df.repartition("conv").sortWithinPartitions("conv", "task", "number")
    solved = in_order(open_.select("conv", "task", "number", *COUNTS, "mint", "maxt", "turns", "before", "after", "symbols")).mapInArrow(_solve, SOLVED)
    texts = open_.select(F.col("task").alias("_task"), F.col("number").alias("_number"), F.col("conv").alias("_conv"), "symbols", "roles", "texts")
    both = solved.join(texts, (F.col("task") == F.col("_task")) & (F.col("number") == F.col("_number")) & F.col("conv").eqNullSafe(F.col("_conv")))
    pieces = both.drop("_task", "_number", "_conv").mapInArrow(_write, PIECE)
    result = done.select(*RESULT.names).union(in_order(pieces).mapInArrow(_digest, RESULT))
    return result.select(F.col("conv").alias("conv_id"), *RESULT.names[1:-1], F.col("sha").alias("repaired_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repairs of all conversations; see repairs for nulls, ties and empty conversations."""
    return repairs(read_table(spark, sf_dir, "conversations"))

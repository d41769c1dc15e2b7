"""Repair of damaged conversations: cheapest edits by Hirschberg's divide and conquer.

A repaired conversation reads system (or not), then user and assistant in turn, assistant last. Four states tell what
has been read: nothing, a system message, a user's, an assistant's. A cost vector over the states goes forward through
the rows, another goes back from the end; where they meet in the middle the cheapest crossing is chosen, of equals the
one whose edits so far come first in ASCII order, and both halves are solved alike. Only vectors are kept, so a
conversation takes memory for its rows and nothing for a table of rows by states.

Equal rows of one turn are folded to one with a count, and all but the first of them are sure to go. A range sort puts
rows in order; a conversation of any length is cut into *blocks* of bounded size. A block that holds a whole
conversation is solved where it is. The others send a 4 x 4 table of costs (how dear it is to come from one state to
another through them), the crossings between blocks are chosen from these tables, and then every block is solved on its
own. Blocks are stored, so both steps see the same ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.plans.session import scratch_path

# What an edit costs, the states, which message leads from a state to which.
RELABEL, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
LEADS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NAMES = {USER: "user", ASSISTANT: "assistant"}
ENDS = (START, ASSISTANT)
#: Rows and text bytes of a block; a longer row comes alone.
BLOCK_ROWS, BLOCK_BYTES = 1 << 16, 8 << 20

Cell = tuple[int, tuple]  # cost, and what orders equal costs
Vector = list[Cell | None]


# --- one conversation, or a block of one -----------------------------------------------------------------------------


def _next(state: int) -> int:
    """Where a user's or an assistant's message, whichever fits, leads to."""
    return ASSISTANT if state == USER else USER


@lru_cache(maxsize=None)
def steps(initial: str, cut_off: bool) -> tuple[tuple[tuple[int, int, str], ...], ...]:
    """For each state before a row, (state after it, cost, edits): messages put in before the row, then its own edit.

    More than two messages put in at one place never pay: two lead back to the same state, and from the first two
    states all others are reached.
    """
    rows = []
    for before in range(4):
        found, state = [], before
        for put_in in range(3):
            own = [(state, DELETE, "D"), (_next(state), RELABEL + CUT_OFF * cut_off, "R")]
            if initial in LEADS and state in LEADS[initial]:
                own.append((LEADS[initial][state], CUT_OFF * cut_off, "K"))
            found += [(after, cost + INSERT * put_in, "I" * put_in + edit) for after, cost, edit in own]
            state = _next(state)
        rows.append(tuple(found))
    return tuple(rows)


def _ranked(vector: list[tuple | None]) -> Vector:
    """The same cells with small numbers that order them like the edits that they stand for."""
    order = sorted(v[1] for v in vector if v is not None)
    return [None if v is None else (v[0], order.index(v[1])) for v in vector]


def forward(codes: list[tuple[str, bool]], start: Vector) -> Vector:
    """Costs of coming to each state through the rows, with ranks: of two ways that cost the same, the lower rank has
    the edits that come first in ASCII order. Edits up to a row end with that row's edit, so neither is a beginning of
    the other, and comparing the ways to the row before and then the row's own edits compares the whole."""
    for code in codes:
        after: list[tuple | None] = [None] * 4
        for cell, options in zip(start, steps(*code)):
            if cell is not None:
                for state, cost, edits in options:
                    new = (cell[0] + cost, (cell[1], edits))
                    if after[state] is None or new < after[state]:
                        after[state] = new
        start = _ranked(after)
    return start


def backward(codes: list[tuple[str, bool]], end: list[int | None]) -> list[int | None]:
    """Costs of coming from each state through the rows to the end."""
    for code in reversed(codes):
        end = [
            min((cost + end[after] for after, cost, _ in options if end[after] is not None), default=None)
            for options in steps(*code)
        ]
    return end


def _single(state: int) -> Vector:
    return [(0, 0) if s == state else None for s in range(4)]


def closing(state: int) -> int | None:
    """How many messages have to be put in at the end for a whole conversation."""
    return 0 if state in ENDS else 1 if state == USER else 2


def solve(codes: tuple[tuple[str, bool], ...], before: int, after: int) -> list[str]:
    """Each row's edits on the cheapest way between two states; of equals the first in ASCII order."""
    edits, todo = [""] * len(codes), [(0, len(codes), before, after)]
    while todo:
        low, high, start, end = todo.pop()
        if high - low == 1:
            edits[low] = min((cost, own) for state, cost, own in steps(*codes[low])[start] if state == end)[1]
        elif high > low:
            middle = (low + high) // 2
            left = forward(codes[low:middle], _single(start))
            right = backward(codes[middle:high], [0 if s == end else None for s in range(4)])
            crossing = min((cell[0] + rest, cell[1], s) for s, (cell, rest) in enumerate(zip(left, right)) if cell and rest is not None)[2]
            todo += [(low, middle, start, crossing), (middle, high, crossing, end)]
    return edits


def last_state(costs: Vector) -> int:
    """The state after the last row of a whole conversation."""
    return min((cell[0] + INSERT * closing(s), cell[1], s) for s, cell in enumerate(costs) if cell)[2]


@lru_cache(maxsize=1 << 14)
def solve_whole(codes: tuple[tuple[str, bool], ...]) -> tuple[list[str], int]:
    """Edits of a short whole conversation, and its state after the last row; conversations repeat their patterns."""
    end = last_state(forward(codes, _single(START)))
    return solve(codes, START, end), end


def rewrite(edits: list[str], before: int, roles: list[str], texts: list[str]) -> Iterator[str]:
    """``role:text`` of the messages that the edits leave or put in."""
    state = before
    for own, role, text in zip(edits, roles, texts):
        for edit in own:
            if edit == "K":
                yield f"{role}:{text}"
                state = LEADS[role[0]][state]
            elif edit != "D":
                state = _next(state)
                yield f"{NAMES[state]}:{text if edit == 'R' else ''}"


def audit_of(edits: list[str], gone: np.ndarray) -> str:
    """Initials of all edits: before each row's own those of the rows that had to go, and of those after the last."""
    if not gone.any():
        return "".join(edits)
    return "".join("D" * int(n) + own for n, own in zip(gone, [*edits, ""]))


def cost_of(audit: str, edits: list[str], codes) -> int:
    kept = sum(cut_off for own, (_, cut_off) in zip(edits, codes) if own[-1] != "D")
    return DELETE * audit.count("D") + RELABEL * audit.count("R") + INSERT * audit.count("I") + CUT_OFF * kept


# --- rows --------------------------------------------------------------------------------------------------------------


def _spaced(column: Column | str) -> Column:
    return F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column, F.lit(" "))


def damage(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conversation, turn, role, text) damaged by crc32("conversation:turn") % 20: 0 drops the row, 1 empties its
    text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's. A null counts as one space, but a turn
    stays null."""
    kind = F.crc32(F.concat_ws(":", _spaced(conversation), _spaced(turn)).cast("binary")) % 20
    rows = df.select(
        F.col(conversation).alias("conversation"),
        F.col(turn).alias("turn"),
        F.when(kind == 4, "user").otherwise(_spaced(role)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(_spaced(text), ".!?", "")).otherwise(_spaced(text)).alias("text"),
        kind.alias("kind"),
    )
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.where("kind <> 0").withColumn("copy", F.explode(copies)).drop("kind", "copy")


def faults(rows: DataFrame) -> DataFrame:
    """Folded rows (conversation, turn, role, text, n) with their fault: blank, cut_off, and first, which tells whether
    no row before them says the same in the same role."""
    folded = rows.groupBy("conversation", "turn", "role", "text").agg(F.count("*").alias("n"))
    said = folded.withColumn("said", F.sha2("text", 256))
    # nulls come first in a struct's order too
    firsts = said.groupBy("conversation", "role", "said").agg(F.min(F.struct("turn")).alias("at"))
    firsts = firsts.select(
        F.col("conversation").alias("c"), F.col("at.turn").alias("t"), F.col("role").alias("r"), F.col("said").alias("s")
    )
    same = (
        F.col("conversation").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")) & (F.col("said") == F.col("s"))
    )
    marked = said.join(firsts, same, "left")
    end = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return marked.select(
        "conversation", "turn", "role", "text", "n", (end == "").alias("blank"), F.col("s").isNotNull().alias("first"),
        (~end.isin(".", "!", "?")).alias("cut_off"),
    )


#: What is counted in a block, in this order; turns are distinct ones that are not null.
TALLIES = ("blank", "duplicate", "truncated", "illegal", "turns", "least", "greatest")
_TALLIES = ", ".join(f"{name} long" for name in TALLIES)
BLOCK = (
    "conversation {kind}, partition int, block int, whole boolean, roles array<string>, texts array<string>, cut_off array<boolean>, "
    "gone binary, costs binary, first_initial string, last_initial string, " + _TALLIES
)
PIECE = (
    "conversation {kind}, partition int, block int, audit string, repaired array<string>, cost long, "
    "first_initial string, last_initial string, " + _TALLIES
)
SUMMARY = "conversation {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ARROW = {
    "int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<string>": pa.list_(pa.string()), "array<boolean>": pa.list_(pa.bool_()),
}


def _batch(rows: list[tuple], schema: str, conversation: pa.DataType) -> pa.RecordBatch:
    fields = [field.split() for field in schema.split(", ")]
    arrow = pa.schema([(name, _ARROW.get(kind, conversation)) for name, kind in fields])
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)


def _legal(before: str | None, initial: str) -> bool:
    return before is None or before + initial in ("su", "ua", "au")


class _Open:
    """A block that is being filled with rows of one conversation."""

    def __init__(self, conversation):
        self.conversation = conversation
        self.roles, self.texts, self.cut_off, self.gone = [], [], [], [0]
        self.first = self.last = self.least = self.greatest = None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.size = 0

    def add(self, row: dict) -> None:
        initial, n = row["role"][:1], row["n"]
        if self.first is None:
            self.first = initial
        self.illegal += n - 1 + (not _legal(self.last, initial))  # no role may follow itself
        self.last = initial
        if row["turn"] is not None and row["turn"] != self.greatest:
            self.least = row["turn"] if self.least is None else self.least
            self.greatest = row["turn"]
            self.turns += 1
        stays = row["first"] and not row["blank"]
        if stays:
            self.roles.append(row["role"])
            self.texts.append(row["text"])
            self.cut_off.append(row["cut_off"])
            self.gone.append(0)
            self.size += len(row["text"])
            self.truncated += row["cut_off"]
        self.gone[-1] += n - stays
        if row["blank"]:
            self.blank += n
        else:
            self.duplicate += n - stays

    @property
    def full(self) -> bool:
        return len(self.roles) >= BLOCK_ROWS or self.size >= BLOCK_BYTES

    def row(self, partition: int, block: int, whole: bool) -> tuple:
        costs = None if whole else pack_table([forward(codes_of(self.roles, self.cut_off), _single(s)) for s in range(4)])
        return (
            self.conversation, partition, block, whole, self.roles, self.texts, self.cut_off,
            np.array(self.gone, np.int64).tobytes(), costs, self.first, self.last, *(getattr(self, t) for t in TALLIES),
        )


def codes_of(roles: list[str], cut_off: list[bool]) -> tuple[tuple[str, bool], ...]:
    """What the edits of rows depend on: the initial, if a role may keep it, and whether the text is cut off."""
    return tuple((r[0] if r and r[0] in LEADS else "", c) for r, c in zip(roles, cut_off))


def pack_table(vectors: list[Vector]) -> bytes:
    """Costs and ranks of coming from each state to each; -1 where there is no way."""
    return np.array([[cell or (-1, -1) for cell in v] for v in vectors], np.int64).tobytes()


def unpack_table(data: bytes) -> list[Vector]:
    table = np.frombuffer(data, np.int64).reshape(4, 4, 2).tolist()
    return [[tuple(cell) if cell[0] >= 0 else None for cell in row] for row in table]


def blocks(marked: DataFrame) -> DataFrame:
    """Blocks in the order of their rows. A conversation that lies inside one block and is not the first or last of its
    partition is whole there."""
    # text too: a conversation's rows of one turn spread as well
    spread = marked.repartitionByRange("conversation", "turn", "role", "text").sortWithinPartitions("conversation", "turn", "role", "text")
    spread = spread.withColumn("partition", F.spark_partition_id())
    schema = BLOCK.format(kind=marked.schema["conversation"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number, begun, ready, size = None, 0, True, [], 0
        for batch in batches:
            kind = batch.schema.field("conversation").type
            for row in batch.to_pylist():
                partition = row["partition"]
                other = block is not None and row["conversation"] != block.conversation
                if other or block is not None and block.full:
                    # begun: rows of it may lie in the partition or the block before
                    ready.append(block.row(partition, number, other and not begun))
                    size, number, begun, block = size + block.size, number + 1, not other, None
                if block is None:
                    block = _Open(row["conversation"])
                block.add(row)
                if len(ready) >= 4096 or size >= BLOCK_BYTES:
                    yield _batch(ready, BLOCK, kind)
                    ready, size = [], 0
        if block is not None:
            yield _batch([*ready, block.row(partition, number, False)], BLOCK, kind)

    names = ["conversation", "turn", "role", "text", "n", "blank", "first", "cut_off", "partition"]
    return spread.select(*names).mapInArrow(run, schema)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit, messages and cost of each block: whole conversations, or blocks whose states before and after are known."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            codes, gone = codes_of(r["roles"], r["cut_off"]), np.frombuffer(r["gone"], np.int64)
            if r["whole"]:
                edits, after = solve_whole(codes) if len(codes) <= 64 else solve_whole.__wrapped__(codes)
                before, put_in = START, closing(after)
            else:
                before, after, put_in = r["before"], r["after"], r["put_in"]
                edits = solve(codes, before, after)
            lines, state = list(rewrite(edits, before, r["roles"], r["texts"])), after
            for _ in range(put_in):
                state = _next(state)
                lines.append(f"{NAMES[state]}:")
            audit = audit_of(edits, gone) + "I" * put_in
            out.append(
                (r["conversation"], r["partition"], r["block"], audit, lines, cost_of(audit, edits, codes), r["first_initial"],
                 r["last_initial"], *(r[t] for t in TALLIES))
            )
        yield _batch(out, PIECE, batch.schema.field("conversation").type)


def _crossings(tables: pa.Table) -> pa.Table:
    """States before and after each block of one conversation: the same divide and conquer, over the blocks' tables."""
    rows = tables.sort_by([("partition", "ascending"), ("block", "ascending")])
    steps_of = [unpack_table(t) for t in rows["costs"].to_pylist()]
    start = _single(START)
    for table in steps_of:
        start = through(start, table)
    end = last_state(start)
    states, todo = [START] + [end] * len(steps_of), [(0, len(steps_of), START, end)]
    while todo:
        low, high, before, after = todo.pop()
        if high - low > 1:
            middle = (low + high) // 2
            left, right = _single(before), [0 if s == after else None for s in range(4)]
            for table in steps_of[low:middle]:
                left = through(left, table)
            for table in reversed(steps_of[middle:high]):
                right = [
                    min((cell[0] + rest for cell, rest in zip(row, right) if cell and rest is not None), default=None) for row in table
                ]
            states[middle] = min((c[0] + r, c[1], s) for s, (c, r) in enumerate(zip(left, right)) if c and r is not None)[2]
            todo += [(low, middle, before, states[middle]), (middle, high, states[middle], after)]
    put_in = [0] * (len(steps_of) - 1) + [closing(end)]
    return pa.table(
        {
            "c": rows["conversation"], "p": rows["partition"], "b": rows["block"],
            "before": pa.array(states[:-1], pa.int32()), "after": pa.array(states[1:], pa.int32()), "put_in": pa.array(put_in, pa.int32()),
        }
    )


def through(start: Vector, table: list[Vector]) -> Vector:
    """A cost vector after a block."""
    after: list[tuple | None] = [None] * 4
    for cell, row in zip(start, table):
        for state, step in enumerate(row):
            if cell and step:
                new = (cell[0] + step[0], (cell[1], step[1]))
                if after[state] is None or new < after[state]:
                    after[state] = new
    return _ranked(after)


def repair(rows: DataFrame) -> DataFrame:
    """Pieces of repaired conversations from rows (conversation, turn, role, text) without nulls but in the first two:
    audit, messages and cost of each block, in the order of (partition, block)."""
    spark = rows.sparkSession
    folder = scratch_path(spark, "turn-blocks")
    blocks(faults(rows)).write.parquet(folder)
    stored, again = spark.read.parquet(folder), spark.read.parquet(folder)
    kind = rows.schema["conversation"].dataType.simpleString()
    found = again.where("NOT whole").select("conversation", "partition", "block", "costs").groupBy("conversation")
    states = found.applyInArrow(_crossings, f"c {kind}, p int, b int, before int, after int, put_in int")
    here = (F.col("partition") == F.col("p")) & (F.col("block") == F.col("b"))
    told = stored.where("NOT whole").join(states, here).drop("c", "p", "b")
    none = {name: F.lit(None).cast("int") for name in ("before", "after", "put_in")}
    return stored.where("whole").withColumns(none).unionByName(told).mapInArrow(_pieces, PIECE.format(kind=kind))


class _Summary:
    """A conversation whose pieces come one after the other."""

    def __init__(self, conversation):
        self.conversation, self.digest, self.audit = conversation, hashlib.sha256(), []
        self.lines = self.cost = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.greatest = self.last = None

    def add(self, piece: dict) -> None:
        self.illegal += piece["illegal"] + (not _legal(self.last, piece["first_initial"]))
        self.last = piece["last_initial"]
        for name in ("cost", "blank", "duplicate", "truncated"):
            setattr(self, name, getattr(self, name) + piece[name])
        if piece["turns"]:
            self.turns += piece["turns"] - (piece["least"] == self.greatest)
            self.least = piece["least"] if self.least is None else self.least
            self.greatest = piece["greatest"]
        self.audit.append(piece["audit"])
        for line in piece["repaired"]:
            self.digest.update(f"\n{line}".encode() if self.lines else line.encode())
            self.lines += 1

    def row(self) -> tuple:
        gaps = self.greatest - self.least + 1 - self.turns if self.turns else 0
        return (
            self.conversation, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit),
            self.digest.hexdigest(),
        )


def summaries(pieces: DataFrame) -> DataFrame:
    """One row for each conversation: counts, cost, audit and digest. Pieces stream past in order; only the audit, which
    is one value, is held as a whole."""
    kind = pieces.schema["conversation"].dataType.simpleString()
    ordered = pieces.repartition("conversation").sortWithinPartitions("conversation", "partition", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            kind_of, done = batch.schema.field("conversation").type, []
            for piece in batch.to_pylist():
                if held is None or held.conversation != piece["conversation"]:
                    if held is not None:
                        done.append(held.row())
                    held = _Summary(piece["conversation"])
                held.add(piece)
            yield _batch(done, SUMMARY, kind_of)
        if held is not None:
            yield _batch([held.row()], SUMMARY, kind_of)

    return ordered.mapInArrow(run, SUMMARY.format(kind=kind))


def check(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Damages the rows of every conversation and repairs them: one row for each conversation of the table.

    Rows of one turn are in the order of role and text, because a table has no other. A null role or text is one space,
    so the row is blank or its role can't be kept; rows without a conversation id are one conversation; null turns come
    first. A role's initial is its first character; an empty role has none and can't be kept. A conversation without rows
    after the damage has zeros, an empty audit and the digest of nothing. An empty table gives no rows; other columns
    are not read.
    """
    found = summaries(repair(damage(df, conversation, turn, role, text))).withColumnRenamed("conversation", "c")
    every = df.select(F.col(conversation).alias("conv_id")).distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    counts = [F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )

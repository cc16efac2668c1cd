"""Conversation structure repair: the cheapest edits after which roles read system?, then user and assistant in turn.

Four states are enough: nothing yet, after the system turn, after a user turn, after an assistant turn.  A row moves between
them by a few edits (insertions, then keep, rerole or delete), so a run of rows is a 4 x 4 table of costs.  Reconstruction is
Hirschberg's: a forward cost vector over the first half and a backward vector over the second meet in the middle, the crossing
state is chosen, and both halves are solved the same way; nothing but vectors is held besides the answer.  Crossings lie right
behind a row's own edit.  No edit string that ends there is the beginning of another, so of equally cheap crossings the one
with the ASCII-least edits so far is right, and a vector carries the order of its four edit strings beside the costs.  Vectors
take few distinct values up to a constant; steps between them are remembered.

Rows are dealt by ranges of conversation and turn.  A conversation inside one task is solved there; of longer ones each block
of rows is solved for every pair of end states, and where the blocks of a conversation meet, the same divide and conquer runs
over their tables.  Only the texts that stay, one edit letter a row and the running digest pass through one task then.

Order: by turn, nulls first, then role, then text.  Equal rows are counted before they are dealt; all but the first are
duplicates.  Defined results: a null conversation is a conversation, null roles and texts are one space; empty texts are blank
and texts of any length count whole; an empty table gives an empty result; conversations without rows have an empty audit.
Roles are compared by their first letter, as they stand.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, stage_table

# Costs and roles of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {2: "user", 3: "assistant"}
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 60
# Cost of closing a conversation from each state, and the insertions that do it.
CLOSING = (0, 2 * INSERT, INSERT, 0)
_TRIM = " \t\n\x0b\f\r"

BLOCK_ROWS = 1024
BLOCK_CHARS = 1 << 18


class Table(tuple):
    """For every state before a row (or block) and every state behind it: cost, order among the targets, edits.  Compared by
    identity, so that steps are found again without a look inside."""

    __hash__ = object.__hash__
    __eq__ = object.__eq__


# ---------------------------------------------------------------- tables of single rows

def _next_insert(state: int) -> int:
    return ASSISTANT if state == USER else USER


@cache
def row_table(initial: str, truncated: bool, forced: bool) -> Table:
    """For every state before a row: cost, order and edits of the way to every state behind it."""
    out = []
    for start in range(4):
        found: dict[int, tuple[int, str]] = {}

        def offer(state: int, cost: int, edits: str, found=found) -> None:
            if (cost, edits) < found.get(state, (NEVER, "")):
                found[state] = (cost, edits)

        state, extra = start, TRUNCATED * truncated
        for n in range(3):
            paid, before = INSERT * n, "I" * n
            offer(state, paid + DELETE, before + "D")
            if not forced:
                target = _next_insert(state)
                if initial == "s" and state == NOTHING:
                    offer(SYSTEM, paid + extra, before + "K")
                if initial == ("a" if target == ASSISTANT else "u"):
                    offer(target, paid + extra, before + "K")
                offer(target, paid + extra + REROLE, before + "R")
            state = _next_insert(state)
        ordered = sorted(edits for _, edits in found.values())
        out.append(tuple((found[t][0], ordered.index(found[t][1]), found[t][1]) if t in found else (NEVER, 4, "") for t in range(4)))
    return Table(out)


# ---------------------------------------------------------------- vectors

Forward = tuple[tuple[int, ...], tuple[int, ...]]  # costs above the least, order of the edit strings


@cache
def _forward(vector: Forward, table: Table) -> tuple[Forward, int]:
    """The vector behind a row (or block), its least cost apart."""
    costs, order = vector
    best: list[tuple[int, int, int]] = []
    for target in range(4):
        ways = [(costs[s] + table[s][target][0], order[s], table[s][target][1]) for s in range(4)
                if costs[s] < NEVER and table[s][target][0] < NEVER]
        best.append(min(ways, default=(NEVER, 4, 4)))
    least = min(b[0] for b in best)
    ranks = sorted({b[1:] for b in best if b[0] < NEVER})
    return (tuple(b[0] - least if b[0] < NEVER else NEVER for b in best),
            tuple(ranks.index(b[1:]) if b[0] < NEVER else 4 for b in best)), least


@cache
def _backward(vector: tuple[int, ...], table: Table) -> tuple[int, ...]:
    costs = [min((table[s][t][0] + vector[t] for t in range(4) if table[s][t][0] < NEVER and vector[t] < NEVER), default=NEVER)
             for s in range(4)]
    least = min(costs)
    return tuple(c - least if c < NEVER else NEVER for c in costs)


def _only(state: int) -> tuple[int, ...]:
    return tuple(0 if s == state else NEVER for s in range(4))


def crossings(tables: list[Table], low: int, high: int, start: int, end: tuple[int, ...], out: list[int]) -> int:
    """States behind the rows low..high-1 of the cheapest, ASCII-least way from ``start``, appended to ``out``; the last one.

    ``end`` is the cost of going on from each state behind the last row.
    """
    if high - low == 1:
        ways = [(cost + end[t], order, t) for t, (cost, order, _) in enumerate(tables[low][start]) if cost < NEVER and end[t] < NEVER]
        state = min(ways)[2]
        out.append(state)
        return state
    middle = (low + high) // 2
    vector: Forward = (_only(start), tuple(0 if s == start else 4 for s in range(4)))
    for i in range(low, middle):
        vector, _ = _forward(vector, tables[i])
    behind = end
    for i in range(high - 1, middle - 1, -1):
        behind = _backward(behind, tables[i])
    _, _, state = min((vector[0][t] + behind[t], vector[1][t], t) for t in range(4) if vector[0][t] < NEVER and behind[t] < NEVER)
    crossings(tables, low, middle, start, _only(state), out)
    return crossings(tables, middle, high, state, end, out)


def solve(tables: list[Table], start: int, end: tuple[int, ...]) -> tuple[int, list[str], int]:
    """Cost, edits by row and last state of the cheapest, ASCII-least way."""
    if not tables:
        return 0, [], start
    states: list[int] = []
    crossings(tables, 0, len(tables), start, end, states)
    cost, edits = 0, []
    for table, before, after in zip(tables, [start, *states], states, strict=False):
        cost += table[before][after][0]
        edits.append(table[before][after][2])
    return cost, edits, states[-1]


def block_table(tables: list[Table]) -> tuple[list[list[tuple[int, int]]], list[list[str | None]]]:
    """Costs and orders between all pairs of states over a run of rows, and the edits of each pair."""
    values, edits = [], []
    for start in range(4):
        vector: Forward = (_only(start), tuple(0 if s == start else 4 for s in range(4)))
        total = 0
        for table in tables:
            vector, least = _forward(vector, table)
            total += least
        values.append([(c + total if c < NEVER else NEVER, o) for c, o in zip(*vector, strict=True)])
        edits.append(["".join(solve(tables, start, _only(t))[1]) if vector[0][t] < NEVER else None for t in range(4)])
    return values, edits


def apply(edits: str, state: int, kept: list[tuple[int, str, str]]) -> list[tuple[str, str]]:
    """Role and text of what a run of rows becomes; ``kept`` has (place, role, text) of all rows that need not go."""
    texts = {place: (role, text) for place, role, text in kept}
    out, place = [], 0
    for edit in edits:
        if edit != "D":
            if edit == "K" and texts[place][0][:1] == "s":
                state = SYSTEM
            else:
                state = _next_insert(state)
            role, text = texts[place] if edit != "I" else ("", "")
            out.append((role if edit == "K" else ROLES[state], text))
        place += edit != "I"
    return out


# ---------------------------------------------------------------- damage

def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times: rows with faults drawn by a checksum of ``conv_id:turn``; dropped ones have times 0."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = spaced("text")
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").when(kind == 0, "").otherwise(spaced("role")).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"))


def _turn_order(c: str = "turn") -> Column:
    return F.struct(F.col(c).isNotNull().alias("given"), F.col(c).alias("turn"))


def faults(rows: DataFrame) -> DataFrame:
    """Equal rows once, with their ``times``, and whether they are blank, said at an earlier turn, or truncated."""
    core = F.rtrim("text", F.lit(_TRIM))
    marked = rows.withColumn("blank", core == "")
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    said = F.md5(F.concat_ws("|", F.col("conv_id").isNull().cast("string"), F.length(conv).cast("string"), conv,
                             F.length("role").cast("string"), "role", "text"))
    firsts = (marked.where(~F.col("blank") & (F.col("times") > 0)).groupBy(said.alias("said"))
              .agg(F.min(_turn_order()).alias("first"), F.max(_turn_order()).alias("last"))
              .where("first <> last").select("said", "first"))
    firsts = stage_table(firsts, "repair-firsts")
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    once = once.withColumns({"blank": core == "", "said": said})
    return attach(once, firsts, "said", F.xxhash64("turn")).select(
        "conv_id", "turn", "role", F.col("text"), "times", "blank",
        F.coalesce(_turn_order() > F.col("first"), F.lit(False)).alias("again"),
        (~F.right(core, F.lit(1)).isin(".", "!", "?")).alias("cut"))


# ---------------------------------------------------------------- blocks

_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_LEGAL = {"su", "ua", "au"}


class _Block:
    """Rows of one conversation in a row, as they are gathered in a task."""

    def __init__(self) -> None:
        self.tables: list[Table] = []
        self.kept: list[tuple[int, str, str]] = []
        self.chars = 0
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.first_initial = self.last_initial = None
        self.first_turn = self.last_turn = None

    def add(self, turn, role: str, text: str, blank: bool, again: bool, cut: bool) -> None:
        initial, forced = role[:1], blank or again
        self.counts["blank"] += blank
        self.counts["duplicate"] += again and not blank
        self.counts["truncated"] += cut and not forced
        if self.last_initial is None:
            self.first_initial = initial
        else:
            self.counts["illegal"] += self.last_initial + initial not in _LEGAL
        self.last_initial = initial
        if turn is not None and turn != self.last_turn:
            self.counts["turns"] += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if not forced:
            self.kept.append((len(self.tables), role, text))
            self.chars += len(text)
        shown = initial if initial and initial in "sua" else ""
        self.tables.append(row_table("" if forced else shown, cut and not forced, forced))

    def full(self, rows: int) -> bool:
        return len(self.tables) >= rows or self.chars >= BLOCK_CHARS


_REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
_TURNS = "array<struct<role:string,text:string>>"
_PIECE = ("conv_id {key}, part int, block bigint, whole boolean, " + _REPORT
          + ", audit string, repaired " + _TURNS + ", turns bigint, first_initial string, last_initial string, first_turn {turn}, "
          "last_turn {turn}, costs array<bigint>, orders array<int>, edits array<string>, kept array<struct<place:int,role:string,text:string>>")


def _gaps(first, last, turns: int) -> int:
    return 0 if first is None else last - first + 1 - turns


def _finished(conv, block: _Block, part: int) -> dict:
    cost, edits, state = solve(block.tables, NOTHING, CLOSING)
    cost, audit = cost + CLOSING[state], "".join(edits) + "I" * (CLOSING[state] // INSERT)
    return {"conv_id": conv, "part": part, "block": 0, "whole": True, "audit": audit, "cost": cost,
            "gaps": _gaps(block.first_turn, block.last_turn, block.counts["turns"]),
            **{c: block.counts[c] for c in _COUNTS[:4]},
            "repaired": [{"role": r, "text": t} for r, t in apply(audit, NOTHING, block.kept)]}


def _open(conv, block: _Block, part: int, number: int) -> dict:
    values, edits = block_table(block.tables) if block.tables else (
        [[(0, 0) if s == t else (NEVER, 4) for t in range(4)] for s in range(4)], [["" if s == t else None for t in range(4)] for s in range(4)])
    return {"conv_id": conv, "part": part, "block": number, "whole": False, **block.counts,
            "first_initial": block.first_initial, "last_initial": block.last_initial,
            "first_turn": block.first_turn, "last_turn": block.last_turn,
            "costs": [c for line in values for c, _ in line], "orders": [o for line in values for _, o in line],
            "edits": [e for line in edits for e in line],
            "kept": [{"place": p, "role": r, "text": t} for p, r, t in block.kept]}


def _same(a, b) -> bool:
    return a == b and (a is None) == (b is None)


def _pieces(rows: Iterator, part: int, block_rows: int) -> Iterator[dict]:
    """Sorted rows of a task as finished conversations and blocks.  The first and the last conversation of a task may go on
    in another task, so they stay open."""
    first, conv, block, number = True, None, None, 0
    for row in rows:
        now, turn, role, text, times, blank, again, cut = row
        if block is None or not _same(now, conv):
            if block is not None:
                yield _open(conv, block, part, number) if first or number else _finished(conv, block, part)
                first = False
            conv, block, number = now, _Block(), 0
        for i in range(times):
            if block.full(block_rows):
                yield _open(conv, block, part, number)
                block, number = _Block(), number + 1
            block.add(turn, role, text, blank, again or i > 0, cut)
    if block is not None:
        yield _open(conv, block, part, number)


def _arrow_rows(batches: Iterator, columns: list[str]) -> Iterator[tuple]:
    """Rows in slices, so that Python holds few of an Arrow batch's texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            yield from zip(*[piece.column(c).to_pylist() for c in columns], strict=True)


def _arrow_out(pieces: Iterator[dict], schema) -> Iterator:
    import pyarrow as pa

    held, chars = [], 0
    for piece in pieces:
        held.append(piece)
        chars += sum(len(t["text"]) for c in ("repaired", "kept") for t in piece.get(c) or ())
        if len(held) >= 512 or chars >= 4 << 20:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _schema(ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


_FIELDS = ["conv_id", "turn", "role", "text", "times", "blank", "again", "cut"]


def pieces(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Written table of finished conversations and of blocks of the conversations that no task held alone."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ddl = _PIECE.format(key=kinds["conv_id"], turn=kinds["turn"])
    schema = _schema(ddl)

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        yield from _arrow_out(_pieces(_arrow_rows(batches, _FIELDS), TaskContext.get().partitionId(), block_rows), schema)

    # Equal keys up to the first letters of the text stay together; a task sorts by the whole text.
    dealt = (faults(rows).repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(64)))
             .sortWithinPartitions("conv_id", "turn", "role", "text").select(*_FIELDS))
    return stage_table(dealt.mapInArrow(run, ddl), "repair-pieces")


# ---------------------------------------------------------------- conversations of several blocks

_PART = "conv_id {key}, part int, block bigint, last boolean, " + _REPORT + ", audit string, repaired " + _TURNS
_SUMMARY = ["blank", "duplicate", "truncated", "illegal", "turns", "first_initial", "last_initial", "first_turn", "last_turn",
            "costs", "orders"]


def _table_of(costs: list[int], orders: list[int]) -> Table:
    return Table(tuple((costs[4 * s + t], orders[4 * s + t], "") for t in range(4)) for s in range(4))


def _joined_report(blocks: list[dict]) -> dict:
    report = {c: sum(b[c] for b in blocks) for c in _COUNTS}
    initial = turn = first = None
    for b in blocks:
        if b["first_initial"] is not None:
            report["illegal"] += initial is not None and initial + b["first_initial"] not in _LEGAL
            initial = b["last_initial"]
        if b["first_turn"] is not None:
            report["turns"] -= turn is not None and turn == b["first_turn"]
            first, turn = b["first_turn"] if first is None else first, b["last_turn"]
    report["gaps"] = _gaps(first, turn, report.pop("turns"))
    return report


def _chained(rows: Iterator[dict]) -> Iterator[dict]:
    """Blocks of a conversation follow their summaries; each gets the way that the whole conversation takes through it."""
    conv, summaries, ways, report, at = None, [], None, {}, 0
    for row in rows:
        if not row["content"]:
            if ways is not None or (summaries and not _same(conv, row["conv_id"])):
                summaries, ways = [], None
            conv = row["conv_id"]
            summaries.append(row)
            continue
        if ways is None:
            tables = [_table_of(s["costs"], s["orders"]) for s in summaries]
            states: list[int] = []
            crossings(tables, 0, len(tables), NOTHING, CLOSING, states)
            _forward.cache_clear()
            _backward.cache_clear()
            ways, at, report = list(zip([NOTHING, *states], states, strict=False)), 0, _joined_report(summaries)
            report["cost"] = sum(t[a][b][0] for t, (a, b) in zip(tables, ways, strict=True)) + CLOSING[states[-1]]
        start, end = ways[at]
        at += 1
        last = at == len(ways)
        edits = row["edits"][4 * start + end] + ("I" * (CLOSING[end] // INSERT) if last else "")
        kept = [(k["place"], k["role"], k["text"]) for k in row["kept"]]
        yield {"conv_id": conv, "part": row["part"], "block": row["block"], "last": last, **(report if last else {}), "audit": edits,
               "repaired": [{"role": r, "text": t} for r, t in apply(edits, start, kept)]}


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Repaired conversations in parts: conv_id, part, block, last, the report (with the last part), audit, repaired turns.

    ``rows`` are conv_id, turn, role, text and times (how often the row stands there).  Parts of a conversation follow each
    other in a partition.
    """
    found = pieces(rows, block_rows)
    key = found.schema["conv_id"].dataType.simpleString()
    ddl = _PART.format(key=key)
    schema = _schema(ddl)
    whole = found.where("whole").withColumn("last", F.lit(True)).select(*schema.names)
    blocks = found.where("NOT whole")
    content = blocks.select("conv_id", "part", "block", F.lit(True).alias("content"), "edits", "kept")
    ahead = blocks.select("conv_id", "part", "block", F.lit(False).alias("content"), *_SUMMARY)
    both = ahead.unionByName(content, allowMissingColumns=True)
    columns = both.columns

    def run(batches: Iterator) -> Iterator:
        # A row at a time: a block's texts may be large.
        rows = (row for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).select(columns).to_pylist())
        yield from _arrow_out(_chained(rows), schema)

    chained = both.repartition("conv_id").sortWithinPartitions("conv_id", "content", "part", "block").mapInArrow(run, ddl)
    return whole.unionByName(chained)


def digest(parts: DataFrame) -> DataFrame:
    """One row per conversation: the report, the whole audit, and the digest of the repaired turns."""
    ddl = (f"conv_id {parts.schema['conv_id'].dataType.simpleString()}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, "
           "illegal bigint, cost bigint, audit string, repaired_sha256 string")
    schema = _schema(ddl)

    def rows_of(batches: Iterator) -> Iterator[dict]:
        sha, audit, first = hashlib.sha256(), [], True
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1).to_pylist()[0]
                for turn in part["repaired"]:
                    sha.update(("" if first else "\n").encode() + f"{turn['role']}:{turn['text']}".encode())
                    first = False
                audit.append(part["audit"])
                if part["last"]:
                    yield {**{n: part[n] for n in schema.names[:-2]}, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}
                    sha, audit, first = hashlib.sha256(), [], True

    return parts.mapInArrow(lambda batches: _arrow_out(rows_of(batches), schema), ddl)


def repaired(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The digest of ``conversations`` (conv_id, turn, role, text), damaged and repaired."""
    return digest(repair(damage(conversations), block_rows))

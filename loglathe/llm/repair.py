"""Repair of conversation structure by the cheapest edits, found with the auction algorithm for shortest paths.

The rows of a conversation, in order of turn (nulls first, then role and text), become the steps of a lattice whose states
are what the role initials so far allow: nothing, s, u or a. An edit is an arc: keep (0), rerole to user or assistant (3),
delete (4, the only choice for blank and repeated rows), insert an empty user or assistant row (3); a truncated row that
stays costs 3 more. A cheapest path to an end with initials `(s?(ua)+)?` is found by auction: a path grows from the start
along its best arc, or raises the price of its last node to that of the best arc and draws back, until it reaches the end.
Every arc of every cheapest path is then tight (its cost is the difference of its prices), and the tight arcs are followed
in the order of their letters (D, I, K, R), which gives the audit that is least in ASCII.

A conversation of any length is cut into chunks of rows by a range partitioning, so one that holds a third of all rows is
spread. A chunk gives the cheapest cost from each state to each state, a scan over the chunks of a conversation adds these
up from its end, another one follows the edits from its start: both hold one chunk at a time. Equal rows of one turn are
one row with a number of copies from the start. Only what is one value by definition, audit and digest, is put together in
one task, and the digest as a stream.

Cases: null roles and texts are one space; a null conversation is one conversation, null turns come first and count for no
gap. Rows of one turn that differ are ordered by role and text. A role whose first character is not s, u or a can only be
changed or deleted; so can an empty one. Empty texts are blank. Extra columns are dropped. Empty in, empty out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglathe.llm import linking

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
CHUNK_STEPS = 32
CHUNK_BYTES = 1 << 20

_WHITE = " \t\n\x0b\x0c\r"
_ROLES = "sua"
FORCED = 8  # kind of a step that must be deleted; else role (0-2, 3 is another) + 4 if truncated
Step = tuple[int, int]  # kind, copies
Costs = tuple[int | None, ...]  # by state: 0 nothing yet, 1 after s, 2 after u, 3 after a
ACCEPTED: Costs = (0, None, None, 0)
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


# --- the lattice of a chunk -------------------------------------------------------------------------------------------


def _kept(state: int, role: int) -> int | None:
    """State after a row of this role, if it may stand there."""
    if role == 0:
        return 1 if state == 0 else None
    if role == 1:
        return 2 if state != 2 else None
    return 3 if role == 2 and state == 2 else None


def _made(state: int) -> int:
    """State after the only row that may be made here: a user row, or an assistant row after one."""
    return 3 if state == 2 else 2


def _arcs(steps: tuple[Step, ...], leave: Costs, last: bool) -> list[list[tuple[str, int, int]]]:
    """(letter, cost, to) from every node 4 * step + state, in order of letters; the end is node 4 * len(steps) + 4.

    Rows are inserted in front of a step, and behind all steps only in the last chunk.
    """
    size = len(steps)
    arcs: list[list[tuple[str, int, int]]] = []
    for i in range(size + 1):
        for state in range(4):
            here = []
            if i < size:
                kind, copies = steps[i]
                here.append(("D", DELETE * copies, 4 * i + 4 + state))
            if i < size or last:
                here.append(("I", INSERT, 4 * i + _made(state)))
            if i < size and kind < FORCED:
                more = TRUNCATED if kind >= 4 else 0
                to = _kept(state, kind % 4)
                if to is not None:
                    here.append(("K", more, 4 * i + 4 + to))
                here.append(("R", REROLE + more, 4 * i + 4 + _made(state)))
            if i == size and leave[state] is not None:
                here.append(("", leave[state], 4 * size + 4))
            arcs.append(here)
    return arcs


def _least(kind: int, copies: int) -> int:
    """What every path pays for the step at least."""
    if kind == FORCED:
        return DELETE * copies
    return min(DELETE, (TRUNCATED if kind >= 4 else 0) + (REROLE if kind % 4 == 3 else 0))


def _auction(arcs: list[list[tuple[str, int, int]]], price: list[float], start: int) -> None:
    """Raise the prices until a path from `start` has reached the end; they stay under the costs of every arc."""
    end, path = len(arcs), [start]
    while path[-1] != end:
        node = path[-1]
        low, to = min(((cost + price[j], j) for _, cost, j in arcs[node]), default=(float("inf"), end))
        if price[node] < low:
            price[node] = low
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)


def _prices(steps: tuple[Step, ...], leave: Costs) -> list[float]:
    """Prices to begin with: what every path must pay from there on at least."""
    total, back = min(c for c in leave if c is not None), []
    for step in (None, *reversed(steps)):
        total += _least(*step) if step else 0
        back += [total] * 4
    return [*reversed(back), 0]


@lru_cache(1 << 15)
def cheapest(steps: tuple[Step, ...], start: int, leave: Costs, last: bool) -> tuple[int, str]:
    """Cost of the cheapest edits from state `start`, and their letters (one for all copies of a step)."""
    arcs, price = _arcs(steps, leave, last), _prices(steps, leave)
    _auction(arcs, price, start)
    # a tight arc may lead to a node whose price is below its distance: then its own arcs end, and the way goes back
    path, letters, dead = [(start, iter(arcs[start]))], [], set()
    while path[-1][0] != len(arcs):
        node, rest = path[-1]
        for letter, cost, to in rest:
            if price[node] == cost + price[to] and to not in dead:
                path.append((to, iter(arcs[to]) if to < len(arcs) else iter(())))
                letters.append(letter)
                break
        else:
            dead.add(node)
            path.pop()
            letters.pop()
    return int(price[start]), "".join(letters)


@lru_cache(1 << 13)
def transfer(steps: tuple[Step, ...]) -> tuple[int | None, ...]:
    """Cheapest cost of a chunk that is not the last, from each state to each state (None: no way), 16 values by row."""
    out: list[int | None] = [None] * 16
    for to in range(4):
        leave = tuple(0 if s == to else None for s in range(4))
        arcs, price = _arcs(steps, leave, False), _prices(steps, leave)
        for state in range(4):  # the prices of one end serve all starts
            ways = to >= 2 or state == to or (state, to) == (0, 1) and any(k < FORCED and k % 4 == 0 for k, _ in steps)
            if ways:
                _auction(arcs, price, state)
                out[4 * state + to] = int(price[state])
    return tuple(out)


# --- rows -------------------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) with one of five faults put into some, by the hash of conversation and turn."""
    space = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))
    fault = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return conversations.where(fault != 0).select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def labelled(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv_id, turn, role, text) with their copies, and flags: blank, again (stands earlier too), truncated."""
    space = F.lit(" ")
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), copies.alias("copies"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies"))
    bare = F.rtrim(F.col("text"), F.lit(_WHITE))
    rows = rows.select(
        "*",
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        F.struct(F.col("turn").isNotNull().alias("has"), "turn").alias("place"),
        (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    rows = linking.stored(rows, "turns")
    first = rows.where("not blank").groupBy("conv_id", "role", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "digest")], "first")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("conv_id", "role", "digest")]
    again = F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    return rows.join(first, same, "left").select("conv_id", "turn", "role", "text", "copies", "blank", again.alias("again"), "truncated")


CHUNK = (
    "part int, no int, kinds array<int>, copies array<bigint>, roles array<string>, texts array<string>, low bigint, "
    "high bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, "
    "costs array<int>"
)


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


class _Chunk:
    def __init__(self, no: int):
        self.row = {"no": no, "kinds": [], "copies": [], "roles": [], "texts": [], "low": None, "high": None, "turns": 0}
        self.row |= {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "head": None, "tail": None, "costs": None}
        self.bytes = 0

    def _step(self, kind: int, copies: int, role: str | None, text: str | None) -> None:
        r = self.row
        if kind == FORCED and r["kinds"][-1:] == [FORCED]:
            r["copies"][-1] += copies
            return
        for c, v in (("kinds", kind), ("copies", copies), ("roles", role), ("texts", text)):
            r[c].append(v)

    def add(self, turn, role: str, text: str, copies: int, blank: bool, again: bool, truncated: bool) -> None:
        r, initial = self.row, role[:1]
        if r["head"] is None:
            r["head"] = initial
        else:
            r["illegal"] += not _legal(r["tail"], initial)
        r["illegal"] += copies - 1
        r["tail"] = initial
        if turn is not None:
            r["turns"] += r["high"] != turn
            r["low"], r["high"] = turn if r["low"] is None else r["low"], turn
        if blank or again:
            r["blank" if blank else "duplicate"] += copies
            self._step(FORCED, copies, None, None)
            return
        r["duplicate"] += copies - 1
        r["truncated"] += truncated
        self._step((_ROLES.index(initial) if initial and initial in _ROLES else 3) + 4 * truncated, 1, role, text)
        if copies > 1:
            self._step(FORCED, copies - 1, None, None)
        self.bytes += len(text)

    @property
    def full(self) -> bool:
        return len(self.row["kinds"]) >= CHUNK_STEPS or self.bytes >= CHUNK_BYTES


def _steps(row: dict) -> tuple[Step, ...]:
    return tuple(zip(row["kinds"], row["copies"]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            yield from batch.slice(start, 256).to_pylist()


def _batched(rows: Iterator[dict], schema: pa.Schema, limit: int = 256) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= limit:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _mapped(df: DataFrame, fields: str, make) -> DataFrame:
    """`make` turns the rows of a partition, in their order, into rows of `fields`, which conv_id comes before."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("conv_id", df.schema["conv_id"].dataType), *T.DataType.fromDDL(fields).fields])
    arrow = to_arrow_schema(schema)
    return df.mapInArrow(lambda batches: _batched(make(_rows(batches)), arrow), schema)


def chunks(rows: DataFrame) -> DataFrame:
    """Chunks of the rows of `labelled`, in order of (part, no) inside a conversation.

    A chunk that may have another one after it gets its costs from state to state.
    """

    def cut(rows: Iterator[dict]) -> Iterator[dict]:
        part, chunk, conv = TaskContext.get().partitionId(), None, None
        for row in rows:
            new = chunk is None or row["conv_id"] != conv
            if new or chunk.full:
                if chunk is not None:
                    if not new:
                        chunk.row["costs"] = transfer(_steps(chunk.row))
                    yield chunk.row | {"conv_id": conv, "part": part}
                conv = row.pop("conv_id")
                chunk = _Chunk(0 if new else chunk.row["no"] + 1)
            else:
                row.pop("conv_id")
            chunk.add(**row)
        if chunk is not None:  # the conversation may go on in the next partition
            chunk.row["costs"] = transfer(_steps(chunk.row))
            yield chunk.row | {"conv_id": conv, "part": part}

    by = ["conv_id", "turn", "role", "text"]
    return _mapped(rows.repartitionByRange(*by).sortWithinPartitions(*by), CHUNK, cut)


def _ahead(row: dict, leave: Costs) -> Costs:
    """Cheapest cost from each state in front of a chunk to the end of its conversation, given that behind it."""
    steps = _steps(row)
    if leave == ACCEPTED:
        return tuple(cheapest(steps, s, ACCEPTED, True)[0] for s in range(4))
    costs = row["costs"]
    ways = [[costs[4 * s + e] + leave[e] for e in range(4) if costs[4 * s + e] is not None and leave[e] is not None] for s in range(4)]
    return tuple(min(w, default=None) for w in ways)


def traced(rows: DataFrame) -> DataFrame:
    """The chunks of every conversation in order, with the edits of their rows and the rows that they leave.

    `cost` is that of the edits from this chunk on; `final` marks the last chunk.
    """

    def from_the_end(rows: Iterator[dict]) -> Iterator[dict]:
        behind, leave = None, ACCEPTED  # the chunk before this one in the table, which comes after it in the conversation
        for row in rows:
            final = behind is None or row["conv_id"] != behind["conv_id"]
            leave = ACCEPTED if final else _ahead(behind, leave)
            behind = row
            yield {c: v for c, v in row.items() if c != "costs"} | {"leave": list(leave), "final": final}

    def from_the_start(rows: Iterator[dict]) -> Iterator[dict]:
        state = 0
        for row in rows:
            leave = row.pop("leave")
            low = min(c for c in leave if c is not None)
            cost, letters = cheapest(_steps(row), state, tuple(None if c is None else c - low for c in leave), row["final"])
            edits, made, at = [], [], 0
            for letter in letters:
                if letter == "I":
                    edits.append("I")
                    made.append(("assistant" if state == 2 else "user", ""))
                    state = _made(state)
                    continue
                kind, copies, role, text = (row[c][at] for c in ("kinds", "copies", "roles", "texts"))
                at += 1
                edits.append(letter * copies)
                if letter == "K":
                    made.append((role, text))
                    state = _kept(state, kind % 4)
                elif letter == "R":
                    made.append(("assistant" if state == 2 else "user", text))
                    state = _made(state)
            for c in ("kinds", "copies", "roles", "texts"):
                row.pop(c)
            yield row | {"cost": cost + low, "audit": "".join(edits), "rows": [{"role": r, "text": t} for r, t in made]}
            state = 0 if row["final"] else state

    facts = CHUNK.replace(", costs array<int>", "")
    back = chunks(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("no"))
    back = _mapped(back, facts + ", leave array<bigint>, final boolean", from_the_end)
    # still one partition per conversation: sorting again needs no shuffle
    forth = back.sortWithinPartitions("conv_id", "part", "no")
    kept = ", ".join(x for x in facts.split(", ") if x.split()[0] not in ("kinds", "copies", "roles", "texts"))
    return _mapped(forth, kept + ", final boolean, cost bigint, audit string, rows array<struct<role:string,text:string>>", from_the_start)


def repaired_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, no, place, role, text): the rows that are left, in order of part, no and place."""
    found = traced(labelled(conversations))
    return found.select("conv_id", "part", "no", F.posexplode("rows").alias("place", "x")).select(
        "conv_id", "part", "no", "place", "x.role", "x.text"
    )


def summaries(conversations: DataFrame) -> DataFrame:
    """Per conversation: COUNTS, cost, audit, and the digest of its repaired rows (`role:text`, joined by newlines)."""

    def sum_up(rows: Iterator[dict]) -> Iterator[dict]:
        done = None
        for row in rows:
            if done is None:
                done = {c: 0 for c in ("turns", *COUNTS[1:])} | {"conv_id": row["conv_id"], "cost": row["cost"]}
                low = high = tail = None
                audit, digest, written = [], hashlib.sha256(), False
            for c in COUNTS[1:]:
                done[c] += row[c]
            if tail is not None:
                done["illegal"] += not _legal(tail, row["head"])
            done["turns"] += row["turns"] - (row["low"] is not None and row["low"] == high)
            low = row["low"] if low is None else low
            high = high if row["high"] is None else row["high"]
            tail = row["tail"]
            audit.append(row["audit"])
            for x in row["rows"]:
                digest.update((("\n" if written else "") + f"{x['role']}:{x['text']}").encode())
                written = True
            if row["final"]:
                turns = done.pop("turns")
                done["gaps"] = 0 if low is None else high - low + 1 - turns
                yield done | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
                done = None

    fields = ", ".join(f"{c} bigint" for c in COUNTS) + ", cost bigint, audit string, repaired_sha256 string"
    return _mapped(traced(labelled(conversations)), fields, sum_up)

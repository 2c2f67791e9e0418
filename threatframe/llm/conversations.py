"""Operator 11: conversation structure repair by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows read, what the repaired conversation ends with so far: nothing, system, user, assistant).
Keep, Rerole and Delete read a row, Insert reads none. A forward heap from the start and a reverse heap from the accepting
ends settle nodes by cost, each with the ASCII-least audit among its cheapest; when the two tops together exceed the best
meeting, every cheapest path crosses from a settled forward node to a settled reverse one, and the least concatenation wins.
(Two cheapest audits of one node never are prefixes of each other, since equal rows cost equally and an insert costs more;
so least parts make the least whole.)

Conversations are dealt by a range sort, so one that holds much of the table lies across tasks. Those that lie within a task
and are not long are repaired there, in one pass. Of the others, each task hands on its rows: they are cut into segments,
each segment gets its cheapest audits between every pair of states (the same search), and segments are folded, 64 at a time,
until one is left for each conversation.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threatframe.llm.common import read, small_batches, staged

LONG_ROWS = 1024  #: rows of a segment; a longer conversation is cut
LONG_BYTES = 8 << 20  #: text bytes that a task holds of one conversation
FAN_IN = 64

START, SYSTEM, USER, ASSISTANT = range(4)
WANTS = "uuau"  #: by state: the initial that may follow (a system turn may, besides, come first)
FOLLOWS = (USER, USER, ASSISTANT, USER)
ROLE = {"u": "user", "a": "assistant"}
ENDS = (START, ASSISTANT)
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5


class Step(NamedTuple):
    """Rows as the lattice sees them: a run of rows that must go, or one row with its initial and its extra cost if it stays."""

    rows: int
    must_go: bool
    initial: str = ""
    extra: int = 0


def _onward(steps: list[Step], i: int, q: int):
    """(cost, letters, row, state) of the edges out of a node."""
    yield INSERT, "I", i, FOLLOWS[q]
    if i < len(steps):
        s = steps[i]
        yield DELETE * s.rows, "D" * s.rows, i + 1, q
        if not s.must_go:
            if s.initial == WANTS[q]:
                yield s.extra, "K", i + 1, FOLLOWS[q]
            else:
                yield REROLE + s.extra, "R", i + 1, FOLLOWS[q]
            if s.initial == "s" and q == START:
                yield s.extra, "K", i + 1, SYSTEM


BEFORE = tuple(tuple(p for p in range(4) if FOLLOWS[p] == q) for q in range(4))


def _back(steps: list[Step], i: int, q: int):
    """(cost, letters, row, state) of the edges into a node."""
    for p in BEFORE[q]:
        yield INSERT, "I", i, p
    if i:
        s = steps[i - 1]
        yield DELETE * s.rows, "D" * s.rows, i - 1, q
        if not s.must_go:
            for p in BEFORE[q]:
                if s.initial == WANTS[p]:
                    yield s.extra, "K", i - 1, p
                else:
                    yield REROLE + s.extra, "R", i - 1, p
            if s.initial == "s" and q == SYSTEM:
                yield s.extra, "K", i - 1, START


class _Side:
    """One direction of the search: heap, cost and least audit of nodes reached, and nodes settled."""

    def __init__(self, steps: list[Step], roots: list[tuple[int, int]], reverse: bool):
        self.edges, self.reverse, self.steps = _back if reverse else _onward, reverse, steps
        self.best: dict[tuple[int, int], tuple[int, str]] = {r: (0, "") for r in roots}
        self.heap = [(0, -r[0] if reverse else r[0], r[1]) for r in roots]
        self.settled: set[tuple[int, int]] = set()
        heapq.heapify(self.heap)

    def top(self) -> float:
        while self.heap and (abs(self.heap[0][1]), self.heap[0][2]) in self.settled:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def settle(self) -> tuple[int, int]:
        """Settle the cheapest node. Among equal costs rows go in reading order: a free edge leads to a later one."""
        cost, at, q = heapq.heappop(self.heap)
        node = (abs(at), q)
        self.settled.add(node)
        audit = self.best[node][1]
        for more, letters, i, p in self.edges(self.steps, *node):
            if (i, p) in self.settled:
                continue
            found = (cost + more, letters + audit if self.reverse else audit + letters)
            known = self.best.get((i, p))
            if known is None or found < known:
                self.best[i, p] = found
                if known is None or found[0] < known[0]:
                    heapq.heappush(self.heap, (found[0], -i if self.reverse else i, p))
        return node


def cheapest(steps: list[Step], entry: int = START, exits: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """(cost, ASCII-least audit) of the cheapest edits from a state to one of the exits; None if there are none."""
    n = len(steps)
    ahead, behind = _Side(steps, [(0, entry)], False), _Side(steps, [(n, q) for q in exits], True)
    meeting = 0 if (0, entry) in behind.best else float("inf")
    while (a := ahead.top()) + (b := behind.top()) <= meeting and a + b < float("inf"):
        side, other = (ahead, behind) if a <= b else (behind, ahead)
        node = side.settle()
        for near in (node, *((i, p) for _, _, i, p in side.edges(steps, *node))):
            if near in side.best and near in other.best:
                meeting = min(meeting, side.best[near][0] + other.best[near][0])
    if meeting == float("inf"):
        return None
    audits = [ahead.best[v][1] + behind.best[v][1] for v in ahead.best.keys() & behind.best.keys() if ahead.best[v][0] + behind.best[v][0] == meeting]
    for v in ahead.settled:
        cost, audit = ahead.best[v]
        for more, letters, i, p in _onward(steps, *v):
            if (i, p) in behind.settled and cost + more + behind.best[i, p][0] == meeting:
                audits.append(audit + letters + behind.best[i, p][1])
    return int(meeting), min(audits)


def steps_of(rows: list[tuple[str, bool, bool, int]]) -> list[Step]:
    """Lattice steps of rows (initial, must go, truncated, copies): neighbours that must go make one step, since an insert
    among them costs the same after them, where the audit is less."""
    out: list[Step] = []
    for initial, must_go, truncated, copies in rows:
        stay = 0 if must_go else 1
        if stay:
            out.append(Step(1, False, initial, TRUNCATED if truncated else 0))
        if gone := copies - stay:
            if out and out[-1].must_go:
                gone += out.pop().rows
            out.append(Step(gone, True))
    return out


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """The lines role:text that an audit makes of rows (role, text)."""
    state = START
    rows = iter(rows)
    for letter in audit:
        role, text = next(rows) if letter != "I" else (None, "")
        if letter == "D":
            continue
        to = SYSTEM if letter == "K" and role[:1] == "s" else FOLLOWS[state]
        yield f"{role if letter == 'K' else ROLE[WANTS[state]]}:{text}"
        state = to


# What a segment contributes to its conversation's figures, and how neighbours add up.


class Figures(NamedTuple):
    rows: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0  #: different ones
    first_turn: int | None = None
    last_turn: int | None = None
    first: str | None = None  #: initial of the first row
    last: str | None = None

    def __add__(self, b: Figures) -> Figures:
        if not self.rows or not b.rows:
            return self if self.rows else b
        border = (self.last or "") + (b.first or "") not in ("su", "ua", "au")
        same = self.last_turn is not None and self.last_turn == b.first_turn
        return Figures(
            *(x + y for x, y in zip(self[:4], b[:4], strict=True)),
            self.illegal + b.illegal + border,
            self.turns + b.turns - same,
            b.first_turn if self.first_turn is None else self.first_turn,
            self.last_turn if b.last_turn is None else b.last_turn,
            self.first,
            b.last,
        )

    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns


def figures(turn: int | None, initial: str, blank: bool, duplicate: bool, truncated: bool, copies: int) -> Figures:
    """Of one row and its copies right after it, which are duplicates unless blank."""
    first = (copies if blank else 0, copies if duplicate else 0 if blank else copies - 1, int(truncated and not blank and not duplicate))
    same = (copies - 1) * (initial + initial not in ("su", "ua", "au"))
    return Figures(copies, *first, same, 0 if turn is None else 1, turn, turn, initial, initial)


# Rows.

SPACES = r"\x20\x09-\x0D"
SHORT = "conv_id", "turn", "role", "text", "copies", "blank", "truncated"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies (0 dropped, 1, 2 repeated), blank, truncated, tie: the rows that the contract damages.

    A null role or text counts as one space. tie orders the rows of one turn: by role, then by the text's SHA-256.
    """
    space = F.lit(" ")
    rows = conversations.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("kind", F.crc32(F.encode(key, "UTF-8")) % 20)
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").when(F.col("kind") == 0, "").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))
    return _judged(rows).withColumn("tie", F.unhex(F.sha2("text", 256)))


def _judged(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"blank": ~F.col("text").rlike(f"[^{SPACES}]"), "truncated": ~F.col("text").rlike(rf"[.!?][{SPACES}]*\z")})


def _order() -> list[Column]:
    return [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("tie")]


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RESULT_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def _result(total: Figures, cost: int, audit: str, digest: str | None) -> tuple:
    return total.gaps(), total.blank, total.duplicate, total.truncated, total.illegal, cost, audit, digest


def _repair_held(rows: list[tuple]) -> tuple:
    """Result of one conversation whose rows (SHORT, in order) a task holds."""
    merged: list[list] = []
    for r in rows:
        if not r[4]:
            continue
        if merged and merged[-1][1:4] == list(r[1:4]):
            merged[-1][4] += r[4]
        else:
            merged.append(list(r))
    seen: set[tuple[str, str]] = set()
    total, lattice = Figures(), []
    for _, turn, role, text, copies, blank, truncated in merged:
        again = not blank and (role, text) in seen
        seen.add((role, text))
        total += figures(turn, role[:1], blank, again, truncated, copies)
        lattice.append((role[:1], blank or again, truncated, copies))
    cost, audit = cheapest(steps_of(lattice))
    each = ((r[2], r[3]) for r in merged for _ in range(r[4]))
    return _result(total, cost, audit, hashlib.sha256("\n".join(repaired(audit, each)).encode()).hexdigest())


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _result_fields(conv: pa.DataType, prefix: str = "") -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return [("conv_id", conv), *((prefix + x.split()[0], kinds[x.split()[1]]) for x in RESULT.split(", "))]


def _short_pass(batches: Iterator[pa.RecordBatch], long_rows: int, long_bytes: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows to results of the conversations that this task holds whole, and the rows of the others as they are.

    The first and the last conversation of a task may go on in its neighbours; a long one is passed on as soon as it is.
    """
    held: list[tuple] = []
    out: list[tuple] = []
    schema, here, first, passing, size, out_size = None, None, True, False, 0, 0
    no_result, no_row = (None,) * len(_RESULT_NAMES), (None,) * (len(SHORT) - 1)

    def close(last: bool = False) -> None:
        nonlocal first, passing, size, out_size
        if first or last or passing:
            out.extend((*r, *no_result) for r in held)
            out_size += size
        else:
            out.append((here, *no_row, *_repair_held(held)))
            out_size += len(held)
        held.clear()
        first, passing, size = False, False, 0

    for batch in batches:
        if schema is None:
            schema = pa.schema([*batch.schema, *_result_fields(batch.schema.field("conv_id").type, "r_")[1:]])
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and r[0] != here:
                close()
            elif passing and r[0] != here:
                passing, first = False, False
            here = r[0]
            held.append(r)
            size += len(r[3])
            if len(held) > long_rows or size > long_bytes:
                close(last=True)
                passing = True
            if len(out) > 2000 or out_size > long_bytes:
                yield _batch(out, schema)
                out, out_size = [], 0
    if held:
        close(last=True)
    if out:
        yield _batch(out, schema)


# Long conversations.

_PAIRS = [(p, q) for p in range(4) for q in range(4)]
_FIGURE_NAMES = Figures._fields
_SEGMENT = "part long, rows long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first string, last string, costs array<long>, audits array<string>"


def _matrix(lattice: list[tuple]) -> tuple[list[int | None], list[str | None]]:
    steps = steps_of(lattice)
    found = [cheapest(steps, p, (q,)) for p, q in _PAIRS]
    return [f and f[0] for f in found], [f and f[1] for f in found]


def _join_matrices(a: tuple[list, list], b: tuple[list, list]) -> tuple[list, list]:
    """Cheapest and least audits through two segments, for every entry and exit."""
    costs, audits = [], []
    for p, q in _PAIRS:
        ways = [(a[0][4 * p + m] + b[0][4 * m + q], a[1][4 * p + m], b[1][4 * m + q]) for m in range(4) if a[0][4 * p + m] is not None and b[0][4 * m + q] is not None]
        least = min((w[0] for w in ways), default=None)
        costs.append(least)
        audits.append(min((x + y for c, x, y in ways if c == least), default=None))
    return costs, audits


def _segment_fields(conv: pa.DataType) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([("conv_id", conv), *((x.split()[0], kinds[x.split()[1]]) for x in _SEGMENT.split(", "))])


def _segment_pass(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, place, turn, initial, copies, blank, duplicate, truncated) to segments of at most `most` rows.

    The upper bits of a place number the task that sorted it; a segment ends there too, as other tasks' rows may lie between.
    """
    here, total, lattice, part, schema = None, Figures(), [], 0, None
    done: list[tuple] = []

    def close() -> None:
        nonlocal total, lattice
        if lattice:
            done.append((here, part, *total, *_matrix(lattice)))
        total, lattice = Figures(), []

    for batch in batches:
        schema = schema or _segment_fields(batch.schema.field("conv_id").type)
        for conv, place, turn, initial, copies, blank, duplicate, truncated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not lattice or conv != here or len(lattice) >= most or place >> 33 != part >> 33:
                close()
                here, part = conv, place
            total += figures(turn, initial, blank, duplicate, truncated, copies)
            lattice.append((initial, blank or duplicate, truncated, copies))
        if len(done) > 8:
            yield _batch(done, schema)
            done = []
    close()
    if done:
        yield _batch(done, schema)


def _folded(table: pa.Table) -> pa.Table:
    """Neighbouring segments of one conversation, as one."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    total, matrix = Figures(), None
    for r in rows:
        total += Figures(*(r[n] for n in _FIGURE_NAMES))
        own = (r["costs"], r["audits"])
        matrix = own if matrix is None else _join_matrices(matrix, own)
    one = (rows[0]["conv_id"], rows[0]["part"], *total, *matrix)
    return pa.Table.from_batches([_batch([one], _segment_fields(table.schema.field("conv_id").type))])


def _long(rows: DataFrame, segment: int, kind: str) -> DataFrame:
    """conv_id and RESULT of conversations of any length, from their rows (SHORT and tie).

    Equal rows are counted together first. A row is a duplicate if an equal role and text has a smaller turn. Texts take
    part in that count and in the last pass, which hashes each conversation's repaired lines as they stream by in order; the
    hash is sequential by definition, so that pass has one task for a conversation, though it holds only one batch of it.
    """
    rows = rows.groupBy("conv_id", "turn", "role", "text", "blank", "truncated", "tie").agg(F.sum("copies").alias("copies"))
    rows = staged(rows, "long")
    lasting = rows.filter("copies > 0")
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = lasting.groupBy("conv_id", "role", "tie").agg(F.min(when).alias("first"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("tie").alias("t"), "first")
    light = lasting.select("conv_id", "turn", "role", "tie", "copies", "blank", "truncated")
    light = light.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("tie") == F.col("t")))
    light = staged(light.withColumn("duplicate", ~F.col("blank") & (when > F.col("first"))).drop("c", "r", "t", "first"), "light")
    light = staged(light.orderBy(*_order()).withColumn("place", F.monotonically_increasing_id()), "sorted")  # places rise along the order
    light = light.select("conv_id", "place", "turn", F.substring("role", 1, 1).alias("initial"), "copies", "blank", "duplicate", "truncated")
    tasks = F.shiftright("place", 33)  # each task's rows again in one task, in their order
    light = light.repartition(tasks).sortWithinPartitions("place")
    segments = staged(light.mapInArrow(partial(_segment_pass, most=segment), f"conv_id {kind}, {_SEGMENT}"), "segments")
    while (segments.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0) > 1:
        rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("part"))  # of segments, without their audits
        fold = segments.select("conv_id", "part").select("part", F.floor((rank - 1) / FAN_IN).alias("fold"))
        names = segments.columns
        segments = segments.join(fold, "part").select(*names, "fold").groupBy("conv_id", "fold").applyInArrow(lambda t: _folded(t.drop_columns(["fold"])), segments.schema)
        segments = staged(segments, "segments")
    ended = segments.withColumn("way", F.array_min(F.array(*(F.when(F.get("costs", F.lit(q)).isNotNull(), F.struct(F.get("costs", F.lit(q)).alias("cost"), F.get("audits", F.lit(q)).alias("audit"))) for q in ENDS))))
    gaps = F.when(F.col("first_turn").isNull(), 0).otherwise(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"))
    ended = ended.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("way.cost").alias("cost"), F.col("way.audit").alias("audit"))
    every = rows.groupBy("conv_id").agg(F.max("copies").alias("most")).select(F.col("conv_id").alias("c"), "most")
    zero = [F.coalesce(F.col(n), F.lit(0)).alias(n) for n in _RESULT_NAMES[:6]]
    ended = staged(every.join(ended, F.col("c").eqNullSafe(F.col("conv_id")), "left").select(F.col("c").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit")), "audits")
    none = F.lit(None)
    lines = lasting.select("conv_id", F.lit(1).alias("part"), "turn", "role", "tie", "text", "copies", *(none.cast("string" if n == "audit" else "long").alias(n) for n in _RESULT_NAMES[:7]))
    heads = ended.select("conv_id", F.lit(0).alias("part"), none.cast("long").alias("turn"), F.lit("").alias("role"), none.cast("binary").alias("tie"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"), *_RESULT_NAMES[:7])
    both = heads.unionByName(lines).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "part", *_order()[1:])
    return both.select("part", "role", "text", "copies", "conv_id", *_RESULT_NAMES[:7]).mapInArrow(_hash_pass, f"conv_id {kind}, {RESULT}")


def _hash_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A head row with an audit, then the conversation's rows in order: results with the repaired text's SHA-256."""
    head, left, at, state, sha, lines, schema = None, "", 0, START, None, 0, None

    def add(line: str) -> None:
        nonlocal lines
        sha.update((("\n" if lines else "") + line).encode())
        lines += 1

    def inserts() -> None:
        nonlocal at, state
        while at < len(left) and left[at] == "I":
            add(f"{ROLE[WANTS[state]]}:")
            at, state = at + 1, FOLLOWS[state]

    def close() -> list[tuple]:
        if head is None:
            return []
        inserts()
        return [(*head, sha.hexdigest())]

    for batch in batches:
        out: list[tuple] = []
        schema = schema or pa.schema(_result_fields(batch.schema.field("conv_id").type))
        for part, role, text, copies, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part == 0:
                out += close()
                head, left, at, state, sha, lines = rest, rest[-1], 0, START, hashlib.sha256(), 0
                continue
            while copies:
                inserts()
                letter = left[at]
                if letter != "D":
                    add(f"{role if letter == 'K' else ROLE[WANTS[state]]}:{text}")
                    state = SYSTEM if letter == "K" and role[:1] == "s" else FOLLOWS[state]
                at, copies = at + 1, copies - 1
        if out:
            yield _batch(out, schema)
    if out := close():
        yield _batch(out, schema)


def repair(conversations: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """Damages and repairs (conv_id, turn, role, text) as the contract says: conv_id and RESULT, one row per conversation.

    Nulls: a null conv_id is a conversation of its own, null turns come first, a null role or text is one space, so such a
    text is blank. Rows of one turn are ordered by role, then by SHA-256 of the text; repeated rows stand together, the
    first of them is judged and the others are duplicates. A role whose first character is not s, u or a, or an empty one,
    cannot be kept. Texts may have any length. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    small_batches(conversations.sparkSession)
    rows = damaged(conversations)
    kind = rows.schema["conv_id"].dataType.simpleString()
    spread = rows.withColumn("salt", F.monotonically_increasing_id())  # repeated rows, too, are dealt over tasks
    spread = spread.repartitionByRange(*_order(), "salt").sortWithinPartitions(*_order())
    short = f"conv_id {kind}, turn long, role string, text string, copies long, blank boolean, truncated boolean"
    result = ", ".join(f"r_{x}" for x in RESULT.split(", "))
    both = spread.select(*SHORT).mapInArrow(partial(_short_pass, long_rows=long_rows, long_bytes=long_bytes), f"{short}, {result}")
    both = staged(both, "repaired")
    done = both.filter("r_cost IS NOT NULL").select("conv_id", *(F.col(f"r_{n}").alias(n) for n in _RESULT_NAMES))
    rest = both.filter("r_cost IS NULL").select(*SHORT).withColumn("tie", F.unhex(F.sha2("text", 256)))
    return done.unionByName(_long(rest, long_rows, kind))


def op11_bidirectional_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(read(spark, sf_dir, "conversations"))


#: The contract in SQL, row by row: the least (cost, audit) for each state after every row, with up to two inserts before it.
#: States: the initial of the last line, '' at the start.
OP11_SQL = r"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
   lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS steps),
 o AS (SELECT conv_id, dense_rank() OVER (ORDER BY conv_id) AS g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
   xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(unicode(x) AS BIGINT))),
    lambda a, b: xor(a >> 8, steps[1 + (xor(a, b) & 255)]))) % 20 AS kind FROM conversations, crc),
 d AS (SELECT g, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM o WHERE kind <> 0),
 n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k FROM d),
 j AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY g, role, text ORDER BY k) > 1 AS again,
   NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, lag(role[1]) OVER (PARTITION BY g ORDER BY k) || role[1] AS pair FROM n),
 f AS (SELECT *, blank OR again AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS extra FROM j),
 ins AS (SELECT * FROM (VALUES ('', '', 0, '', ''), ('', 'u', 5, 'I', 'user:'), ('', 'a', 10, 'II', 'user:' || chr(10) || 'assistant:'), ('s', 's', 0, '', ''), ('s', 'u', 5, 'I', 'user:'),
   ('s', 'a', 10, 'II', 'user:' || chr(10) || 'assistant:'), ('u', 'u', 0, '', ''), ('u', 'a', 5, 'I', 'assistant:'), ('a', 'a', 0, '', ''), ('a', 'u', 5, 'I', 'user:')) v(q, to_q, cost, audit, lines)),
 w AS (SELECT DISTINCT g, CAST(0 AS BIGINT) AS k, '' AS q, {'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': CAST([] AS VARCHAR[])} AS best FROM o
  UNION ALL SELECT g, k, q, min(best) FROM (
   SELECT w.g, f.k, e.q, {'cost': w.best.cost + ins.cost + e.cost, 'audit': w.best.audit || ins.audit || e.letter,
     'lines': w.best.lines || CASE WHEN ins.lines = '' THEN CAST([] AS VARCHAR[]) ELSE [ins.lines] END || CASE WHEN e.letter = 'D' THEN CAST([] AS VARCHAR[]) ELSE [e.role || ':' || f.text] END} AS best
   FROM w JOIN ins ON ins.q = w.q JOIN f ON f.g = w.g AND f.k = w.k + 1,
    LATERAL (SELECT CASE ins.to_q WHEN 'u' THEN 'a' ELSE 'u' END AS nxt) x,
    LATERAL (SELECT 'D' AS letter, ins.to_q AS q, 2 AS cost, '' AS role
     UNION ALL SELECT 'K', f.role[1], f.extra, f.role WHERE NOT f.gone AND (f.role[1] = x.nxt OR ins.to_q = '' AND f.role[1] = 's')
     UNION ALL SELECT 'R', x.nxt, 1 + f.extra, CASE x.nxt WHEN 'u' THEN 'user' ELSE 'assistant' END WHERE NOT f.gone AND f.role[1] <> x.nxt) e) GROUP BY g, k, q),
 z AS (SELECT g, min({'cost': w.best.cost + ins.cost, 'audit': w.best.audit || ins.audit, 'lines': w.best.lines || CASE WHEN ins.lines = '' THEN CAST([] AS VARCHAR[]) ELSE [ins.lines] END}) AS best
   FROM w JOIN ins ON ins.q = w.q AND ins.to_q IN ('', 'a') WHERE k = (SELECT count(*) FROM f WHERE f.g = w.g) GROUP BY g),
 s AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
   count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY g)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 z.best.cost AS cost, z.best.audit AS audit, sha256(array_to_string(z.best.lines, chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, g FROM o) c JOIN z ON z.g = c.g LEFT JOIN s ON s.g = c.g"""

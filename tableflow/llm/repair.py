"""Repair of the structure of conversations.

A conversation should have the role initials (s?(ua)+)?: perhaps a system turn,
then user and assistant by turns.  Rows may be kept, deleted, given the role
that the structure wants, and empty turns may be put in; the cheapest edits
win, and among equally cheap ones those whose initials (K, D, R, I in the
order of the result) are least in ASCII.

Edits are the edges of a DAG over (rows left, state of the structure).  A
path's weight is one integer: its high digits are the cost, its low digits the
edits' letters, `WIDTH` of them, the first one highest and zeros behind the
last.  The integer minimum over a state's edges then decides cost and letters
at once.  Paths are built from the last row to the first; an edge puts its
letter in front and moves the others down a digit.

Long conversations are read in segments of `SEGMENT` rows.  A segment has the
least weight from every state to every state; every segment but the last ends
with a row's own letter (empty turns stand before the row that wants them), so
no two of its letter sequences are the beginning of one another, and the
segments' minima put together are the whole conversation's.  Work and memory
grow with the rows, not their square.

Two passes: the first sorts narrow rows (no texts) by conversation and turn and
decides the edits; the second sorts the texts behind their conversation's edits
and streams them through the repair.  No conversation's texts are held in
memory.  A conversation is one stream, as its hash is of one stream.

Edge cases: nulls in role and text count as one space (in the conversation's
and turn's crc32 too).  Rows of a conversation are ordered by turn (null
first), then role and text (by md5), so rows that repeat are neighbours.  Null
is a conversation of its own.  A role that begins with none of s, u, a, or is
empty, cannot be kept.  Conversations without rows have zeros, no edits and the
empty text's hash.  An empty table gives no rows.  Only conv_id, turn, role and
text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableflow.llm.common import materialize

#: Costs of the edits, and of leaving a truncated row in.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SEGMENT = 64
WIDTH = 2 * SEGMENT + 2
_BITS = 3 * WIDTH  # a letter is an octal digit
_LETTERS = (1 << _BITS) - 1
_CODE = {"D": 1, "I": 2, "K": 3, "R": 4}  # ascending as in ASCII; 0 is no letter
_NAMES = str.maketrans("1234", "DIKR")

# States of the structure: nothing yet, behind the system turn, behind a user's,
# behind an assistant's.  It may end in the first and the last.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: A row's kind: initial (system, user, assistant, none of them) + 4 * fault.
_SOUND, _CUT, _GONE = range(3)
_SPACES = " \t\n\x0b\x0c\r"


def _next(state: int) -> int:
    """Where the turn that the structure wants leads to."""
    return _ASSISTANT if state == _USER else _USER


def _kept(state: int, initial: int) -> int | None:
    """Where a kept row leads to, if it may be kept."""
    if initial == 0:
        return _SYSTEM if state == _START else None
    return _next(state) if initial in (1, 2) and initial == (2 if state == _USER else 1) else None


def _edits(state: int, kind: int) -> list[tuple[str, int, int]]:
    """(letters, cost, next state) of what may become of a row."""
    initial, fault = kind % 4, kind // 4
    out = [("D", DELETE, state)]
    if fault != _GONE:
        more = TRUNCATED if fault == _CUT else 0
        for before, cost, now in (("", more, state), ("I", more + INSERT, _next(state))):
            if (kept := _kept(now, initial)) is not None:
                out.append((before + "K", cost, kept))
            out.append((before + "R", cost + RENAME, _next(now)))
    return out


_TABLE = [[_edits(state, kind) for kind in range(12)] for state in range(4)]


def _led(letters: str, cost: int, weight: int) -> int:
    """The weight of a path with these letters in front."""
    high, low = (weight >> _BITS) + cost, weight & _LETTERS
    for letter in reversed(letters):
        low = (_CODE[letter] << (_BITS - 3)) | (low >> 3)
    return (high << _BITS) | low


#: Where a conversation ends, the structure is closed with empty turns.
_CLOSED = [0, _led("II", 2 * INSERT, 0), _led("I", INSERT, 0), 0]


def _least(kinds: bytes, ends: list[int | None]) -> list[int | None]:
    """The least weight from each state before the rows to what `ends` has for
    the states behind them."""
    for kind in reversed(kinds):
        ends = [min((_led(letters, cost, ends[to]) for letters, cost, to in row[kind] if ends[to] is not None), default=None) for row in _TABLE]
    return ends


@lru_cache(1 << 13)
def _last(kinds: bytes) -> tuple[int, ...]:
    return tuple(_least(kinds, _CLOSED))


@lru_cache(1 << 12)
def _between(kinds: bytes) -> tuple[tuple[int | None, ...], ...]:
    """[state behind][state before]: the least weight."""
    return tuple(tuple(_least(kinds, [0 if s == end else None for s in range(4)])) for end in range(4))


def _spelled(weight: int) -> str:
    return format(weight & _LETTERS, f"0{WIDTH}o").rstrip("0").translate(_NAMES)


def cheapest(kinds: bytes) -> tuple[int, str]:
    """(cost, letters) of the cheapest edits of rows of these kinds."""
    cuts = list(range(0, len(kinds), SEGMENT)) or [0]
    tail = _last(kinds[cuts[-1] :])
    costs = [w >> _BITS for w in tail]
    chosen: list[list[tuple[int, int]]] = []  # per segment, the last first: (weight, next state) by state
    for at in reversed(cuts[:-1]):
        part = _between(kinds[at : at + SEGMENT])
        here = [min((part[end][s] + (costs[end] << _BITS), end) for end in range(4) if part[end][s] is not None) for s in range(4)]
        costs = [w >> _BITS for w, _ in here]
        chosen.append([(part[end][s], end) for s, (_, end) in enumerate(here)])
    state, out = _START, []
    for step in reversed(chosen):
        weight, state = step[state]
        out.append(_spelled(weight))
    return costs[_START], "".join([*out, _spelled(tail[state])])


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, alive: the rows with planted faults, by the
    crc32 of conversation and turn; rows that are dropped are not alive."""
    own = conversations.select("conv_id", "turn", "role", "text")
    as_text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat_ws(":", *as_text).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    hit = own.select(
        "conv_id",
        "turn",
        F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (fault != 0).alias("alive"),
        F.when(fault == 3, 2).otherwise(1).alias("times"),
    )
    return hit.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")


def _rows(conversations: DataFrame, alive: Column | None) -> DataFrame:
    """conv_id, turn, role, text, alive, digest of the rows, nulls filled."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        (F.lit(True) if alive is None else alive).alias("alive"),
        F.md5(text.cast("binary")).alias("digest"),
    )


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_PLAN = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string())])


class _Seen:
    """What the first pass keeps of a conversation."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.kinds, self.counts = conv, bytearray(), [0, 0, 0, 0]  # sound, blank, duplicate, truncated
        self.low = self.high = None
        self.turns = self.illegal = 0
        self.before: int | None = None

    def add(self, turn: int | None, initial: int, fault: int) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        if self.before is not None and (self.before, initial) not in ((0, 1), (1, 2), (2, 1)):
            self.illegal += 1
        self.before = initial
        self.counts[fault] += 1
        self.kinds.append(initial + 4 * (_SOUND, _GONE, _GONE, _CUT)[fault])

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, audit = cheapest(bytes(self.kinds))
        return self.conv, gaps, *self.counts[1:], self.illegal, cost, audit


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, out = None, []
    for batch in batches:
        for conv, turn, initial, fault, alive in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "alive")]):
            if held is None or conv != held.conv:
                if held is not None:
                    out.append(held.row())
                held = _Seen(conv)
            if alive:
                held.add(turn, initial, fault)
        if len(out) >= 1024:
            yield _batch(out, _PLAN)
            out = []
    if held is not None:
        out.append(held.row())
    if out:
        yield _batch(out, _PLAN)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def plan_repairs(rows: DataFrame) -> DataFrame:
    """conv_id, the counts of faults, cost and audit of every conversation of
    rows (as of `_rows`)."""
    trimmed = F.rtrim("text", F.lit(_SPACES))
    ended = F.right(trimmed, F.lit(1)).isin(".", "!", "?")
    first = F.substring("role", 1, 1)
    narrow = rows.select(
        "conv_id", "turn", "role", "digest", "alive",
        F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3).alias("initial"),
        F.when(trimmed == "", 1).when(ended, 0).otherwise(3).alias("fault"),
    )
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "digest", "alive").orderBy(F.col("turn").asc_nulls_first())) > 1
    narrow = narrow.withColumn("fault", F.when((F.col("fault") != 1) & again, 2).otherwise(F.col("fault")))
    dealt = narrow.repartition("conv_id").sortWithinPartitions("conv_id", *_order())
    fields = ", ".join(f"{c} bigint" for c in _COUNTS)
    return dealt.select("conv_id", "turn", "initial", "fault", "alive").mapInArrow(_planned, f"conv_id bigint, {fields}, audit string")


def _behind_plans(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows, in order."""
    texts = rows.where("alive").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text", *[F.lit(None).cast("bigint").alias(c) for c in _COUNTS])
    none = {c: F.lit(None).cast(t) for c, t in (("turn", "bigint"), ("role", "string"), ("digest", "string"))}
    heads = plans.select("conv_id", F.lit(0).alias("kind"), *[none[c].alias(c) for c in none], F.col("audit").alias("text"), *_COUNTS)
    return texts.union(heads).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_order())


class _Replay:
    """A conversation's edits, done row by row."""

    def __init__(self, row: dict) -> None:
        self.head, self.audit, self.at, self.state = row, row["text"], 0, _START

    def _wanted(self) -> str:
        self.state = _next(self.state)
        return "assistant" if self.state == _ASSISTANT else "user"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._wanted(), ""

    def turns(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what the next row becomes, empty turns before
        it included."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield "R", self._wanted(), text
        elif edit == "K":
            self.state = _SYSTEM if self.state == _START and role[:1] == "s" else _next(self.state)
            yield "K", role, text


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Replay, tuple[str, str, str] | None]]:
    """Every conversation's repaired turns, and (None) its end."""
    now = None
    for batch in batches:
        for small in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
            for row in small.to_pylist():
                if row["kind"] == 0:
                    if now is not None:
                        yield from ((now, t) for t in now.inserted())
                        yield now, None
                    now = _Replay(row)
                else:
                    yield from ((now, t) for t in now.turns(row["role"], row["text"]))
    if now is not None:
        yield from ((now, t) for t in now.inserted())
        yield now, None


_DIGEST = pa.schema([*_PLAN, ("repaired_sha256", pa.string())])
_TURN = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, sha, first = [], hashlib.sha256(), True
    for now, turn in _replayed(batches):
        if turn is None:
            out.append((now.head["conv_id"], *[now.head[c] for c in _COUNTS], now.audit, sha.hexdigest()))
            sha, first = hashlib.sha256(), True
            if len(out) == 1024:
                yield _batch(out, _DIGEST)
                out = []
        else:
            sha.update(f"{'' if first else chr(10)}{turn[1]}:{turn[2]}".encode())
            first = False
    if out:
        yield _batch(out, _DIGEST)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, size, position = [], 0, 0
    for now, turn in _replayed(batches):
        if turn is None:
            position = 0
            continue
        out.append((now.head["conv_id"], position, *turn))
        size, position = size + len(turn[2]), position + 1
        if len(out) == 1024 or size > 1 << 22:
            yield _batch(out, _TURN)
            out, size = [], 0
    if out:
        yield _batch(out, _TURN)


def repaired_turns(conversations: DataFrame, alive: Column | None = None) -> DataFrame:
    """conv_id, position, edit, role, text of the repaired conversations."""
    rows = _rows(conversations, alive)
    plans = materialize(plan_repairs(rows), "repair-plans")
    return _behind_plans(rows, plans).mapInArrow(_turns, "conv_id bigint, position bigint, edit string, role string, text string")


def repair_report(conversations: DataFrame, alive: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 of every conversation."""
    rows = _rows(conversations, alive)
    plans = materialize(plan_repairs(rows), "repair-plans")
    fields = ", ".join(f"{c} bigint" for c in _COUNTS)
    return _behind_plans(rows, plans).mapInArrow(_digests, f"conv_id bigint, {fields}, audit string, repaired_sha256 string")

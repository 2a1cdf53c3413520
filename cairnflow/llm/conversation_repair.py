"""Conversation structure repair: the cheapest edits that turn a conversation into ``(s?(ua)+)?``.

Rows are streamed by conversation in the order of their turns, twice, with a small state carried from one Arrow batch to
the next, so memory does not grow with a conversation:

1. Backwards, over compact rows (no text): ``costs`` holds, for each of the four states of the pattern, what the rest of
   the conversation costs from there. Each row leaves one byte, its best edit in every state. These backpointers are
   spilled to the shared folder in chunks of at most ``CHUNK`` bytes that carry the place of their first row.
2. Forwards, over the rows with their text: a chunk sorts right before its first row, so one chunk is held at a time. The
   state walks through the bytes, which gives the edits; of equally cheap ones the walk takes the least letter at
   every step, so the audit is the least in ASCII order.

Before that, copies of a row (same turn, role and text) are folded to one with a count, and the first occurrence of a
role and text in a conversation is found by aggregation; no conversation or group of copies is collected. The rows of
one conversation do meet in one task, as a stream: the digest of its repaired text can only be computed in order.

Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (required for blank and duplicate rows), Insert an empty user or
assistant turn 5; a truncated row that is not deleted adds 5.

Defined cases: a null conversation id is one conversation of its own; null turns come first; a null role or text is one
space; rows of one turn are ordered by role and digest of their text; a role whose first letter is not s, u or a (an
empty one too) cannot be kept; a conversation without rows has no edits; an empty table gives no rows. Gaps beyond 64
bits are reported as the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from cairnflow.llm.common import Stages

#: Backpointers that travel together: one byte per row.
CHUNK = 1 << 15
#: ASCII whitespace of the word rule.
SPACES = " \t\n\x0b\x0c\r"
DELETE, INSERT, KEEP, REROLE = range(4)
LETTERS = "DIKR"
COST = {"keep": 0, "rerole": 1, "delete": 2, "insert": 5, "truncated": 5}
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The turn that each state may be followed by, besides a system turn at the start, and the state after it.
EXPECTED = ["user", "user", "assistant", "user"]
AFTER = [USER, USER, ASSISTANT, USER]
#: What is still to be inserted when the rows end in a state.
END_COSTS = (0, 2 * COST["insert"], COST["insert"], 0)
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
MARKER, BACK, ROW = range(3)
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
LARGEST = (1 << 63) - 1


# --- damage and compact rows --------------------------------------------------------------------


def plain(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text alone, nulls of the last two as one space."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"))


def damage(conversations: DataFrame) -> DataFrame:
    """Drop, empty, cut, repeat or rerole rows by a hash of conversation and turn; the others stay as they are."""
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = plain(conversations).withColumn("code", code).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def digested(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def compact(rows: DataFrame, stages: Stages) -> DataFrame:
    """One row per distinct (conv_id, turn, role, text): its digest, faults and number of copies, and if it is the first."""
    core = F.rtrim("text", F.lit(SPACES))
    blank = F.length(core) == 0
    cut = ~F.substring(core, -1, 1).isin(".", "!", "?")
    marked = digested(rows).select("conv_id", "turn", "role", "digest", blank.alias("blank"), cut.alias("cut"))
    folded = stages(marked.groupBy(*marked.columns).agg(F.count("*").alias("copies")), "conversation-rows")
    earliest = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("e")
    first = folded.groupBy("conv_id", "role", "digest").agg(earliest).select(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("e.turn").alias("t"), F.lit(True).alias("first")
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")) & F.col("turn").eqNullSafe(F.col("t"))
    found = folded.join(first, same, "left")
    return found.select(*folded.columns, F.coalesce("first", F.lit(False)).alias("first"))


# --- backwards: costs and backpointers ------------------------------------------------------------


@cache
def step(costs: tuple[int, ...], initial: str, truncated: bool) -> tuple[tuple[int, ...], int, int]:
    """Costs before a row that need not be deleted, less their least; that least; and its byte."""
    extra = COST["truncated"] if truncated else 0
    ways: list[dict[int, int]] = []
    for state in range(4):
        edits = {DELETE: COST["delete"] + costs[state], REROLE: COST["rerole"] + extra + costs[AFTER[state]]}
        if state == START and initial == "s":
            edits[KEEP] = COST["keep"] + extra + costs[SYSTEM]
        elif initial == EXPECTED[state][0]:
            edits[KEEP] = COST["keep"] + extra + costs[AFTER[state]]
        ways.append(edits)
    best = [min(edits.values()) for edits in ways]
    for _ in range(3):
        best = [min(best[s], COST["insert"] + best[AFTER[s]]) for s in range(4)]
    byte = 0
    for state, edits in enumerate(ways):
        edits[INSERT] = COST["insert"] + best[AFTER[state]]
        byte |= min(e for e, cost in edits.items() if cost == best[state]) << (2 * state)
    least = min(best)
    return tuple(b - least for b in best), least, byte


#: In every state the row is deleted.
DELETED = 0


class Backward:
    """The rows of one conversation, last turn first."""

    def __init__(self):
        self.costs, self.base = END_COSTS, 0
        self.bytes, self.key = bytearray(), None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.high = self.low = self.after = None

    def add(self, turn, role, digest, blank, cut, copies, first) -> None:
        initial = role[:1]
        forced = blank or not first
        copies_deleted = copies if forced else copies - 1
        self.base += COST["delete"] * copies_deleted
        if blank:
            self.blank += copies
        else:
            self.duplicate += copies_deleted
        if forced:
            self.bytes.append(DELETED)
        else:
            self.truncated += cut
            self.costs, least, byte = step(self.costs, initial, cut)
            self.base += least
            self.bytes.append(byte)
        self.illegal += copies - 1 + (self.after is not None and (initial, self.after) not in LEGAL)
        self.after = initial
        if turn is not None:
            self.turns += turn != self.low
            self.high = turn if self.high is None else self.high
            self.low = turn
        self.key = (turn, role, digest)

    def counts(self) -> list[int]:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, LARGEST)
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.base + self.costs[START]]

    def chunk(self) -> bytes:
        """The bytes so far, first row first."""
        found = bytes(reversed(self.bytes))
        self.bytes.clear()
        return found


def backwards(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Backpointers in chunks at the place of their first row; the first chunk of a conversation carries its counts."""
    conv = rows.schema["conv_id"]
    schema = StructType([
        conv, StructField("turn", LongType()), StructField("role", StringType()), StructField("digest", BinaryType()),
        StructField("back", BinaryType()), *[StructField(c, LongType()) for c in COUNTS],
    ])

    def run(batches):
        state, current = None, None
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "digest", "blank", "cut", "copies", "first")]
            for conv_id, *row in zip(*columns):
                if state is None or conv_id != current:
                    if state is not None:
                        out.append((current, *state.key, state.chunk(), *state.counts()))
                    state, current = Backward(), conv_id
                elif len(state.bytes) >= chunk:
                    out.append((current, *state.key, state.chunk(), *[None] * len(COUNTS)))
                state.add(*row)
            yield from as_batch(out, schema, batch)
        if state is not None:
            yield from as_batch([(current, *state.key, state.chunk(), *state.counts())], schema, batch)

    ordered = rows.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("digest").desc()
    )
    return ordered.select("conv_id", "turn", "role", "digest", "blank", "cut", "copies", "first").mapInArrow(run, schema)


ARROW = {LongType(): pa.int64(), StringType(): pa.string(), BinaryType(): pa.binary(), IntegerType(): pa.int32()}


def as_batch(rows: list[tuple], schema: StructType, like: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows as a batch; the conversation id keeps the type it came with."""
    if rows:
        types = [like.schema.field("conv_id").type, *[ARROW[f.dataType] for f in schema.fields[1:]]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema.names)


# --- forwards: edits and repaired rows --------------------------------------------------------------


class Forward:
    """The rows of one conversation, first turn first, on their way through the backpointers."""

    def __init__(self):
        self.state, self.bytes, self.at, self.key = START, b"", 0, None
        self.counts = [0] * len(COUNTS)

    def edits(self, key: tuple, role: str, text: str) -> Iterator[tuple[int, str | None, str | None]]:
        """(edit, role, text) of the inserted turns before a row, then of the row; a deleted one has neither."""
        if key == self.key:
            yield DELETE, None, None
            return
        self.key = key
        byte = self.bytes[self.at]
        self.at += 1
        while True:
            edit = byte >> (2 * self.state) & 3
            expected = EXPECTED[self.state]
            if edit == DELETE:
                yield DELETE, None, None
                return
            if edit == KEEP and self.state == START and role[0] == "s":
                self.state = SYSTEM
            else:
                self.state = AFTER[self.state]
            if edit == INSERT:
                yield INSERT, expected, ""
                continue
            yield edit, role if edit == KEEP else expected, text
            return

    def rest(self) -> Iterator[tuple[int, str, str]]:
        while self.state in (SYSTEM, USER):
            yield INSERT, EXPECTED[self.state], ""
            self.state = AFTER[self.state]


class Digest:
    """Audit and hash of a conversation: one row at its end."""

    FIELDS = [*[StructField(c, LongType()) for c in COUNTS], StructField("audit", StringType()), StructField("repaired_sha256", StringType())]

    def __init__(self, conv_id):
        self.conv_id, self.audit, self.hash, self.parts = conv_id, bytearray(), hashlib.sha256(), 0

    def add(self, edit, role, text) -> list[tuple]:
        self.audit += LETTERS[edit].encode()
        if role is not None:
            self.hash.update(f"{chr(10) if self.parts else ''}{role}:{text}".encode())
            self.parts += 1
        return []

    def end(self, counts) -> list[tuple]:
        return [(self.conv_id, *counts, self.audit.decode(), self.hash.hexdigest())]


class Turns:
    """The repaired turns themselves, one row each."""

    FIELDS = [StructField("turn", LongType()), StructField("role", StringType()), StructField("text", StringType()), StructField("edit", StringType())]

    def __init__(self, conv_id):
        self.conv_id, self.turn = conv_id, 0

    def add(self, edit, role, text) -> list[tuple]:
        if role is None:
            return []
        self.turn += 1
        return [(self.conv_id, self.turn - 1, role, text, LETTERS[edit])]

    def end(self, counts) -> list[tuple]:
        return []


def forwards(conv_ids: DataFrame, backs: DataFrame, rows: DataFrame, reader: type) -> DataFrame:
    """Stream markers of all conversations, chunks and rows in one order through ``reader``."""
    nothing = lambda name, kind: F.lit(None).cast(kind).alias(name)
    counts = [nothing(c, "long") for c in COUNTS]
    key = [nothing("turn", "long"), nothing("role", "string"), nothing("digest", "binary")]
    markers = conv_ids.select("conv_id", F.lit(MARKER).alias("kind"), *key, nothing("text", "string"), nothing("back", "binary"), *counts)
    chunks = backs.select("conv_id", F.lit(BACK).alias("kind"), "turn", "role", "digest", nothing("text", "string"), "back", *COUNTS)
    told = digested(rows).select("conv_id", F.lit(ROW).alias("kind"), "turn", "role", "digest", "text", nothing("back", "binary"), *counts)
    stream = markers.unionByName(chunks).unionByName(told).repartition("conv_id")
    # A marker comes before all, a chunk before its first row.
    stream = stream.sortWithinPartitions("conv_id", F.col("kind") != MARKER, "turn", "role", "digest", "kind")
    schema = StructType([rows.schema["conv_id"], *reader.FIELDS])

    def run(batches):
        state, out_of, current = None, None, None
        for batch in batches:
            found: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "digest", "text", "back", *COUNTS)]
            for conv_id, kind, turn, role, digest, text, back, *numbers in zip(*columns):
                if state is None or conv_id != current:
                    if state is not None:
                        found += finish(state, out_of)
                    state, out_of, current = Forward(), reader(conv_id), conv_id
                if kind == BACK:
                    state.bytes, state.at = back, 0
                    if numbers[0] is not None:
                        state.counts = numbers
                elif kind == ROW:
                    for edit in state.edits((turn, role, digest), role, text):
                        found += out_of.add(*edit)
            yield from as_batch(found, schema, batch)
        if state is not None:
            yield from as_batch(finish(state, out_of), schema, batch)

    return stream.mapInArrow(run, schema)


def finish(state: Forward, out_of) -> list[tuple]:
    found = [row for edit in state.rest() for row in out_of.add(*edit)]
    return found + out_of.end(state.counts)


# --- the operator -----------------------------------------------------------------------------


def stream(conv_ids: DataFrame, rows: DataFrame, reader: type, name: str, chunk: int = CHUNK) -> DataFrame:
    stages = Stages()
    backs = stages(backwards(compact(rows, stages), chunk), "conversation-backs")
    return stages.result(forwards(conv_ids.select("conv_id").distinct(), backs, rows, reader), name)


def repair(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The repaired turns: conv_id, turn (numbered from 0), role, text and the edit that made it (K, R or I)."""
    return stream(conversations.limit(0), plain(conversations), Turns, "repaired-turns", chunk)


def inspect(conversations: DataFrame, rows: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    ``rows`` are the turns to judge (those of ``conversations`` themselves by default); a conversation that has none there
    gets zeros, an empty audit and the hash of nothing.
    """
    return stream(conversations, plain(conversations if rows is None else rows), Digest, "repaired-digests", chunk)

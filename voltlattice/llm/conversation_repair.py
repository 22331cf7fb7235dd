"""Cheapest repair of conversations into well-formed role sequences, streamed in sorted order.

A conversation is well-formed when its role initials are ``(s?(ua)+)?`` with no blank, repeated or
truncated turn left unpaid. Edits in order: Keep 0, Rerole to user or assistant 1, Delete 2, Insert an
empty turn 5; a truncated turn that isn't deleted adds 5; blank turns and repeats must be deleted. The
cheapest edits are found, ties by the least string of their initials.

1. Rows are repartitioned by conversation and sorted within it by turn, last turn first.
2. ``mapInArrow`` reads the sorted rows. Its state is the cost to finish from each of the four
   states of the pattern's automaton, carried from batch to batch; each row leaves one byte, two bits
   of the least best edit for each state. What a conversation has left behind is written to the
   task's own spill file beyond ``SPILL_BYTES``, so a giant conversation takes no more memory.
3. At the conversation's first turn the bytes are walked back, from the first turn to the last. As
   the automaton is deterministic, taking the least best edit at each step gives the least string.

Repeats of turns far apart need no memory in the stream: groups of equal role and text that span
several turns are found by an aggregation over digests, and their later turns come into the stream
as marks sorted beside their rows.

Cases: a null role or text is one space. Null turns come first. Rows with equal turns are ordered by
role, then by the digest of role and text; equal rows are interchangeable, and all but one are repeats.
A null conversation id is a conversation of its own. An empty text is blank. An empty table gives an
empty result. One very long text is held by one task; the edits of a conversation are one string, which
must fit a row. Columns other than the four are not looked at.
"""

from __future__ import annotations

import hashlib
import marshal
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from voltlattice.llm.common import partitions

#: What counts as white space.
SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Bytes that a conversation keeps in memory before they are spilled.
SPILL_BYTES = 4 << 20
#: Fixed costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: The automaton: 0 start, 1 after s, 2 after u, 3 after a; it accepts in 0 and 3.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEEDS = ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
NEXT = tuple(STEP[q, r] for q, r in enumerate(NEEDS))
EDITS = "DIKR"
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60
SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def last_character(text: Column) -> Column:
    """The last character that isn't white space; empty if there is none."""
    return F.substring(F.rtrim(text, F.lit(SPACES)), -1, 1)


def _rows(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    base = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
                        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    last = last_character(F.col("text"))
    fault = F.when(last == "", 1).when(last.isin(*ENDS), 0).otherwise(2)
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), F.col("role"), F.col("text")).cast("binary"), 256))
    return base.select("*", digest.alias("digest"), fault.cast("int").alias("fault"))


def _marks(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, digest) of turns whose role and text stand in an earlier turn too."""
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    narrow = rows.filter("fault <> 1").select("conv", "turn", "role", "digest", place.alias("place"))
    groups = narrow.groupBy("conv", "digest").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first < last")
    groups = groups.select(F.col("conv").alias("_conv"), F.col("digest").alias("_digest"), "first")
    found = narrow.join(groups, narrow["conv"].eqNullSafe(groups["_conv"]) & (narrow["digest"] == groups["_digest"]))
    return found.filter("place > first").select("conv", "turn", "role", "digest").distinct()


def _stream(turns: DataFrame, names: tuple[str, str, str, str]) -> DataFrame:
    rows = _rows(turns, *names)
    marks = _marks(rows).withColumns({"text": F.lit(None).cast("string"), "fault": F.lit(-1)})
    order = [F.asc("conv"), F.desc_nulls_last("turn"), F.desc("role"), F.desc("digest"), F.asc("fault")]
    return rows.unionByName(marks).repartition(partitions(turns.sparkSession), "conv").sortWithinPartitions(*order)


class _Spill:
    """Records of a conversation, last in first out: (edits of the four states, role, text)."""

    def __init__(self):
        self.edits, self.roles, self.texts, self.size = bytearray(), [], [], 0
        self.file, self.chunks = None, []

    def push(self, edits: int, role: str, text: str) -> None:
        self.edits.append(edits)
        self.roles.append(role)
        self.texts.append(text)
        self.size += 64 + len(text)
        if self.size > SPILL_BYTES:
            self.file = self.file or tempfile.TemporaryFile()
            start = self.file.seek(0, 2)
            self.file.write(marshal.dumps((bytes(self.edits), self.roles, self.texts)))
            self.chunks.append((start, self.file.tell() - start))
            self.edits, self.roles, self.texts, self.size = bytearray(), [], [], 0

    def __iter__(self) -> Iterator[tuple[int, str, str]]:
        yield from zip(reversed(self.edits), reversed(self.roles), reversed(self.texts))
        for start, size in reversed(self.chunks):
            self.file.seek(start)
            yield from zip(*map(reversed, marshal.loads(self.file.read(size))))
        if self.file:
            self.file.close()


def _finish(costs: list[int]) -> list[int]:
    """Costs when empty turns may be inserted first."""
    for _ in range(2):
        costs = [min(costs[q], INSERT + costs[NEXT[q]]) for q in range(4)]
    return costs


END = tuple(_finish([0, FAR, FAR, 0]))


def _back(after: tuple[int, ...], initial: str, fault: int) -> tuple[tuple[int, ...], int, int]:
    """(costs before the row less the least of them, that least, the best edits): ``fault`` 1 must be deleted, 2 is truncated."""
    paid = TRUNCATED if fault == 2 else 0
    told = []
    for q in range(4):
        ways = {"D": DELETE + after[q]}
        if fault != 1:
            if (q, initial) in STEP:
                ways["K"] = KEEP + paid + after[STEP[q, initial]]
            ways["R"] = REROLE + paid + after[NEXT[q]]
        told.append(ways)
    costs = _finish([min(ways.values()) for ways in told])
    edits = 0
    for q, ways in enumerate(told):
        ways["I"] = INSERT + costs[NEXT[q]]
        edits |= EDITS.index(min(e for e, cost in ways.items() if cost == costs[q])) << 2 * q
    least = min(costs)
    return tuple(c - least for c in costs), least, edits


class _Conversation:
    """The state carried through one conversation, last turn first."""

    known: dict = {}

    def __init__(self, conv):
        self.conv, self.spill = conv, _Spill()
        self.costs, self.base = END, 0
        self.faults = [0, 0, 0]
        self.illegal, self.following = 0, None
        self.high = self.low = None
        self.turns = 0

    def add(self, turn, role: str, text: str, fault: int, repeat: bool) -> None:
        initial = role[:1]
        if fault == 1:
            self.faults[0] += 1
        elif repeat:
            self.faults[1] += 1
            fault = 1
        elif fault == 2:
            self.faults[2] += 1
        if self.following is not None and initial + self.following not in LEGAL:
            self.illegal += 1
        self.following = initial
        if turn is not None and turn != self.low:
            self.high = turn if self.high is None else self.high
            self.low, self.turns = turn, self.turns + 1
        key = (self.costs, initial if initial in ("s", "u", "a") else "", fault)
        step = self.known.get(key)
        if step is None:
            step = self.known[key] = _back(*key)
        self.costs, least, edits = step
        self.base += least
        self.spill.push(edits, role, text)

    @property
    def gaps(self) -> int:
        return 0 if self.high is None else self.high - self.low + 1 - self.turns

    def repaired(self) -> Iterator[tuple[str, str | None, str | None]]:
        """(edit, role, text) from the first turn on; a deleted turn has neither role nor text."""
        q = 0
        for edits, role, text in self.spill:
            while (edit := EDITS[edits >> 2 * q & 3]) == "I":
                yield "I", NAMES[NEEDS[q]], ""
                q = NEXT[q]
            if edit == "D":
                yield "D", None, None
            elif edit == "K":
                yield "K", role, text
                q = STEP[q, role[:1]]
            else:
                yield "R", NAMES[NEEDS[q]], text
                q = NEXT[q]
        while q in (1, 2):
            yield "I", NAMES[NEEDS[q]], ""
            q = NEXT[q]

    def summary(self) -> tuple:
        audit, digest, first = bytearray(), hashlib.sha256(), True
        for edit, role, text in self.repaired():
            audit += edit.encode()
            if role is not None:
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        return (self.gaps, *self.faults, self.illegal, self.base + self.costs[0], audit.decode(), digest.hexdigest())


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[_Conversation | None]:
    """Conversations as their last row has been read; None after each batch.

    A row is held until the next one shows whether it stands there once more.
    """
    now = held = marked = None
    for batch in batches:
        columns = {name: batch.column(name) for name in ("conv", "turn", "role", "text", "digest", "fault")}
        for conv, turn, role, text, digest, fault in zip(*(columns[c].to_pylist() for c in columns)):
            if now is None or conv != now.conv:
                if held:
                    now.add(*held[:4], held[:2] + held[4:] == marked)
                if now is not None:
                    yield now
                now, held, marked = _Conversation(conv), None, None
            key = (turn, role, digest)
            if held:
                now.add(*held[:4], held[:2] + held[4:] in (marked, key))
                held = None
            if fault == -1:
                marked = key
            else:
                held = (turn, role, text, fault, digest)
        yield None
    if now is not None:
        if held:
            now.add(*held[:4], held[:2] + held[4:] == marked)
        yield now


def _table(kind: pa.DataType, rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * (len(kinds) + 1)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, *kinds])], names=names)


def summaries(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: its faults, the cost, the edits' initials and the digest of the repair."""
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, kind = [], None

        def watched():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv").type
                yield batch

        for c in _conversations(watched()):
            if c is not None:
                rows.append((c.conv, *c.summary()))
            elif rows:
                yield _table(kind, rows, kinds, [conv, *SUMMARY])
                rows = []
        if rows:
            yield _table(kind, rows, kinds, [conv, *SUMMARY])

    stream = _stream(turns, (conv, turn, role, text))
    kind = turns.schema[conv].dataType.simpleString()
    return stream.mapInArrow(run, ", ".join([f"`{conv}` {kind}", *(f"{c} long" for c in SUMMARY[:6]), "audit string", "repaired_sha256 string"]))


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, position, role, text, edit): the turns of the repaired conversations, positions from 0."""
    names, kinds = [conv, "position", role, text, "edit"], [pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, rows, size = None, [], 0

        def watched():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv").type
                yield batch

        for c in _conversations(watched()):
            kept = ((role, text, edit) for edit, role, text in c.repaired() if role is not None) if c else ()
            for position, (said_by, said, edit) in enumerate(kept):
                rows.append((c.conv, position, said_by, said, edit))
                size += len(said)
                if len(rows) == 4096 or size > SPILL_BYTES:
                    yield _table(kind, rows, kinds, names)
                    rows, size = [], 0
        if rows:
            yield _table(kind, rows, kinds, names)

    stream = _stream(turns, (conv, turn, role, text))
    kind = turns.schema[conv].dataType.simpleString()
    return stream.mapInArrow(run, f"`{conv}` {kind}, position long, `{role}` string, `{text}` string, edit string")


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows damaged by a hash of conversation and turn: dropped, emptied, without ends of sentences, twice, or said by the user.

    Nulls of the four columns are one space in the hash and, for role and text, in the row.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(part(conv), F.lit(":"), part(turn)).cast("binary")) % 20
    rows = turns.select(F.col(conv).alias(conv), F.col(turn).alias(turn), part(role).alias(role), part(text).alias(text), way.alias("way")).filter("way <> 0")
    said = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(F.col(text))
    by = F.when(F.col("way") == 4, "user").otherwise(F.col(role))
    copies = F.explode(F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select(conv, turn, by.alias(role), said.alias(text), copies.alias("copy")).drop("copy")


def repair_damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The summary of every conversation of the table after damage; zeros where no row is left."""
    every = conversations.select(F.col(conv).alias("_conv")).distinct()
    told = summaries(damage(conversations, conv, turn, role, text), conv, turn, role, text)
    joined = every.join(told, every["_conv"].eqNullSafe(told[conv]), "left")
    empty = {**{c: F.lit(0).cast("long") for c in SUMMARY[:6]}, "audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return joined.select(F.col("_conv").alias(conv), *(F.coalesce(told[c], empty[c]).alias(c) for c in SUMMARY))

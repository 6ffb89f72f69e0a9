"""Repair of the turn structure of conversations by alignment with their grammar.

A sound conversation is empty or an optional system turn and then pairs of
user and assistant: role initials ``(s?(ua)+)?``. The turns of a conversation
are aligned with the grammar's string of every feasible length by a
Wagner-Fischer table. Seen from their ends all those strings agree (``…uaua``),
so one table serves all lengths: column r stands for the last r letters, and a
second sheet for these letters behind a leading ``s``. Ukkonen's band leaves
out the cells that cannot be part of an alignment as cheap as the incumbent, a
greedy one. Every length of least cost is traced back, and the least audit
counts.

Edits: Keep 0, Rerole (to user or assistant) 2, Delete 3, Insert (an empty
turn of user or assistant) 2; a truncated turn that stays adds 1. Blank and
repeated turns are always deleted.

Only one byte per turn is held in a task, and every few hundredth row of the
table; texts stream by in order. The turns of one conversation are read by one
task, since an alignment is sequential.

Cases: a null role or text is one space; null turns come first; turns of one
number are ordered by role and by the hash of their text; rows repeated whole
are turns of their own (all but the first are duplicates); a null conv_id is a
conversation of its own; a conversation without turns has counts of zero and
an empty audit; an empty table gives an empty result. Other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ripplemark.session import stage

#: Characters that leave a turn blank, and ends of a turn that is whole.
BLANKS, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Codes of a turn: initial of its role, plus four times its fault.
S, U, A = 1, 2, 3
BLANK, DUPLICATE, CUT = 1, 2, 3
NEVER = 1 << 29
#: Rows of the table at least that are computed anew together when traced.
BLOCK = 64
#: Audits of short conversations that a task remembers.
REMEMBERED, SHORT = 20_000, 64
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text`` without null roles and texts."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text")
    )


def mark(text: str = "text") -> Column:
    return F.unhex(F.sha2(text, 256))


def incumbent(initials: list[int], cut: list[int]) -> int:
    """Cost of a greedy alignment of turns that need not go."""
    cost, want = 0, U
    for n, (initial, truncated) in enumerate(zip(initials, cut)):
        cost += truncated * TRUNCATED
        if n == 0 and initial == S:
            cost += 2 * INSERT * (len(initials) == 1)
        elif initial == want:
            want = U + A - want
        elif initial in (U, A):
            cost += INSERT
        else:
            cost += REROLE
            want = U + A - want
    return cost + INSERT * (want == A)


class Table:
    """Costs of what is left, ``E[i][r]``: turns from i on against the last r letters; ``G[i][r]``: an ``s`` before these."""

    def __init__(self, initials: list[int], cut: list[int]):
        self.initials, self.cut, self.size = initials, cut, len(initials)
        limit = incumbent(initials, cut)
        self.low, high = limit // DELETE + 1, limit // INSERT + 1
        self.places = np.arange(self.low + high + 1)
        self.block = max(BLOCK, isqrt(self.size))
        self.held = {}
        row = self.last()
        for end in range(self.size, 0, -self.block):
            start = max(0, end - self.block)
            self.held[start] = (end, row)
            row = self.rows(start, end, row)[0]
        self.first = row

    def last(self):
        r = self.places - self.low
        return np.where(r < 0, NEVER, INSERT * r), np.full(len(r), NEVER)

    def rows(self, start: int, end: int, after) -> list:
        """Rows start to end - 1, from the row ``after`` them."""
        found = []
        for i in range(end - 1, start - 1, -1):
            e, g = after
            r = self.size - i - self.low + self.places
            skipped, skipped_g = (np.append(x[1:], NEVER) for x in (e, g))
            own = TRUNCATED * self.cut[i]
            fits = (r % 2 == 1) if self.initials[i] == A else (r % 2 == 0) if self.initials[i] == U else False
            best = np.minimum(skipped + DELETE, e + own + np.where(fits, 0, REROLE))
            best = np.where(r < 0, NEVER, best)
            best = np.minimum.accumulate(best - INSERT * self.places) + INSERT * self.places
            led = np.minimum(skipped_g + DELETE, skipped + own) if self.initials[i] == S else skipped_g + DELETE
            after = np.where(r < 0, NEVER, best), np.where(r < 0, NEVER, led)
            found.append(after)
        return found[::-1]

    def at(self, row: np.ndarray, i: int, r: int) -> int:
        place = r - (self.size - i) + self.low
        return int(row[place]) if 0 <= place < len(row) and r >= 0 else NEVER

    def audits(self) -> tuple[int, list[str]]:
        """The least cost, and the least audit of each length that has it, but for lengths that are beaten on the way."""
        e, g = self.first
        r = self.places + (self.size - self.low)
        costs = np.concatenate((np.where((r % 2 == 0) & (r >= 0), e, NEVER), np.where((r % 2 == 0) & (r >= 2), g, NEVER)))
        least = int(costs.min())
        traces = [(n >= len(r), int(r[n % len(r)]), bytearray()) for n in np.nonzero(costs == least)[0]]
        for start in sorted(self.held):
            end, after = self.held[start]
            rows = [*self.rows(start, end, after), after]
            traces = [self.trace(rows, start, end, *t) for t in traces]
            best = min(out for _, _, out in traces)
            traces = [t for t in traces if t[2][: len(best)] <= best[: len(t[2])]]
        return least, [out.decode() + "I" * left for _, left, out in traces]

    def trace(self, rows: list, start: int, end: int, led: bool, r: int, out: bytearray):
        i = start
        while i < end:
            (e, g), (later, later_g) = rows[i - start], rows[i - start + 1]
            if led:
                skip = self.at(g, i, r) == self.at(later_g, i + 1, r) + DELETE
                out += b"D" if skip else b"K"
                led, i = skip, i + 1
                continue
            cost, own = self.at(e, i, r), TRUNCATED * self.cut[i]
            if cost == self.at(later, i + 1, r) + DELETE:
                out += b"D"
                i += 1
            elif cost == self.at(e, i, r - 1) + INSERT:
                out += b"I"
                r -= 1
            else:
                out += b"K" if self.initials[i] == (A if r % 2 else U) and cost == self.at(later, i + 1, r - 1) + own else b"R"
                i, r = i + 1, r - 1
        return led, r, out


def mend(codes: bytes) -> tuple[int, str]:
    """Least cost and audit of a conversation's codes. A deletion comes before other edits at its place."""
    stays = [c for c in codes if c >> 2 not in (BLANK, DUPLICATE)]
    cost, audits = Table([c & 3 for c in stays], [int(c >> 2 == CUT) for c in stays]).audits()
    gone = len(codes) - len(stays)
    if not gone:
        return cost, min(audits)
    whole = []
    for audit in audits:
        out, place = [], 0
        for c in codes:
            if c >> 2 in (BLANK, DUPLICATE):
                out.append("D")
                continue
            while audit[place] == "I":
                out.append("I")
                place += 1
            out.append(audit[place])
            place += 1
        whole.append("".join(out) + audit[place:])
    return cost + DELETE * gone, min(whole)


def in_order(turns: DataFrame) -> DataFrame:
    """Rows within each partition by conversation: its head, then its turns."""
    return turns.sortWithinPartitions("conv_id", F.desc("head"), "turn", "role", "mark")


def alignments(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``.

    ``turns`` as of :func:`turns_of`; ``ids`` names further conversations
    (column ``conv_id``), which may have no turns.
    """
    body = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(body == "", BLANK).when(~F.right(body, F.lit(1)).isin(*ENDS), CUT).otherwise(0)
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", S).when(initial == "u", U).when(initial == "a", A).otherwise(0)
    each = turns.select("conv_id", "turn", "role", mark().alias("mark"), code.alias("code"), fault.alias("fault"), F.lit(False).alias("head"))
    if ids is not None:
        heads = ids.select("conv_id").distinct()
        each = each.unionByName(heads.withColumn("head", F.lit(True)), allowMissingColumns=True)
    seen = Window.partitionBy("conv_id", "head", "role", "mark").orderBy("turn")
    again = (F.row_number().over(seen) > 1) & (F.col("fault") != BLANK)
    each = each.repartition("conv_id").withColumn("fault", F.when(again, DUPLICATE).otherwise(F.col("fault")))
    rows = in_order(each).select("conv_id", "turn", "head", (F.col("code") + F.col("fault") * 4).alias("code"))
    id_type = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {id_type}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
    names = [part.split()[0] for part in schema.split(", ")]
    types = arrow_types(turns, "conv_id") + [pa.int64()] * 6 + [pa.string()]

    def read(batches):
        known: dict[bytes, tuple[int, str]] = {}

        def told(conv, codes, lowest, highest, distinct):
            codes = bytes(codes)
            if (found := known.get(codes)) is None:
                found = mend(codes)
                if len(codes) <= SHORT:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[codes] = found
            faults = [sum(c >> 2 == kind for c in codes) for kind in (BLANK, DUPLICATE, CUT)]
            illegal = sum((a & 3, b & 3) not in ((S, U), (U, A), (A, U)) for a, b in zip(codes, codes[1:]))
            gaps = highest - lowest + 1 - distinct if distinct else 0
            return (conv, gaps, *faults, illegal, *found)

        def conversations():
            current, codes, lowest, highest, distinct, begun = None, bytearray(), 0, 0, 0, False
            for batch in batches:
                for conv, turn, head, code in zip(*(c.to_pylist() for c in batch.columns)):
                    if not begun or conv != current:
                        if begun:
                            yield told(current, codes, lowest, highest, distinct)
                        current, codes, distinct, begun = conv, bytearray(), 0, True
                    if head:
                        continue
                    codes.append(code)
                    if turn is not None:
                        if not distinct:
                            lowest, distinct = turn, 1
                        elif turn != highest:
                            distinct += 1
                        highest = turn
            if begun:
                yield told(current, codes, lowest, highest, distinct)

        yield from in_batches(conversations(), types, names)

    return rows.mapInArrow(read, schema)


def arrow_types(df: DataFrame, *columns: str) -> list[pa.DataType]:
    return [to_arrow_type(df.schema[c].dataType) for c in columns]


def in_batches(rows, types: list[pa.DataType], names: list[str]):
    """Tuples as Arrow batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) if row[-1] is not None else 0
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def repaired(turns: DataFrame, aligned: DataFrame) -> DataFrame:
    """The turns after repair: ``conv_id, place, edit, role, text``; rows of a conversation side by side and in order.

    ``aligned``: ``conv_id, audit`` of :func:`alignments` over the same turns.
    """
    each = turns.select("conv_id", "turn", "role", mark().alias("mark"), "text", F.lit(False).alias("head"))
    heads = aligned.select("conv_id", F.col("audit").alias("text"), F.lit(True).alias("head"))
    each = in_order(each.unionByName(heads, allowMissingColumns=True).repartition("conv_id")).select("conv_id", "head", "role", "text")
    names = ["conv_id", "place", "edit", "role", "text"]
    types = arrow_types(turns, "conv_id") + [pa.int64(), pa.string(), pa.string(), pa.string()]

    def read(batches):
        def inserted(conv, audit, at, place, length):
            while at < len(audit) and audit[at] == "I":
                yield conv, place, "I", "assistant" if (length - place) % 2 else "user", ""
                at, place = at + 1, place + 1

        def turns_left():
            conv, audit, at, place, length = None, "", 0, 0, 0
            for batch in batches:
                for own, head, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if head:
                        yield from inserted(conv, audit, at, place, length)
                        conv, audit, at, place, length = own, text, 0, 0, len(text) - text.count("D")
                        continue
                    for row in inserted(conv, audit, at, place, length):
                        yield row
                        at, place = at + 1, place + 1
                    edit, at = audit[at], at + 1
                    if edit != "D":
                        if edit == "R":
                            role = "assistant" if (length - place) % 2 else "user"
                        yield conv, place, edit, role, text
                        place += 1
            yield from inserted(conv, audit, at, place, length)

        yield from in_batches(turns_left(), types, names)

    id_type = turns.schema["conv_id"].dataType.simpleString()
    return each.mapInArrow(read, f"conv_id {id_type}, place bigint, edit string, role string, text string")


def digests(mended: DataFrame) -> DataFrame:
    """``conv_id, sha256`` of the lines ``role:text`` of each conversation of :func:`repaired`, read as they come."""
    types, names = arrow_types(mended, "conv_id") + [pa.string()], ["conv_id", "sha256"]

    def read(batches):
        def hashed():
            current, state = None, None
            for batch in batches:
                for conv, place, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if place == 0:
                        if state is not None:
                            yield current, state.hexdigest()
                        current, state = conv, hashlib.sha256()
                    state.update((f"\n{role}:{text}" if place else f"{role}:{text}").encode())
            if state is not None:
                yield current, state.hexdigest()

        yield from in_batches(hashed(), types, names)

    id_type = mended.schema["conv_id"].dataType.simpleString()
    return mended.select("conv_id", "place", "role", "text").mapInArrow(read, f"conv_id {id_type}, sha256 string")


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired turns of ``conversations`` (``conv_id, turn, role, text``): ``conv_id, place, edit, role, text``."""
    turns = turns_of(conversations)
    return repaired(turns, stage(alignments(turns), "alignments").select("conv_id", "audit"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with the faults that the checks plant by the CRC-32 of ``conv_id:turn`` modulo 20."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    rows = turns_of(conversations).withColumn("fate", fate).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    rows = rows.withColumns({"text": text, "role": role})
    return rows.withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy", "fate")


def repair_report(conversations: DataFrame) -> DataFrame:
    """The alignment of every conversation after planted damage, with the digest of its repaired turns."""
    turns = damaged(conversations)
    aligned = stage(alignments(turns, conversations.select("conv_id")), "alignments")
    hashed = stage(digests(repaired(turns, aligned.select("conv_id", "audit"))), "digests")
    hashed = hashed.select(F.col("conv_id").alias("named"), "sha256")
    both = aligned.join(hashed, F.col("conv_id").eqNullSafe(F.col("named")), "left").drop("named")
    empty = hashlib.sha256(b"").hexdigest()
    return both.select(*aligned.columns, F.coalesce("sha256", F.lit(empty)).alias("repaired_sha256"))

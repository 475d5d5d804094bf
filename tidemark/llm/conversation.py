"""Conversation structure repair by secondary-sorted streaming.

A conversation should read ``(s?(ua)+)?`` in its roles' initials: an optional system
turn, then user and assistant in turns, or nothing at all. ``audits`` and ``repaired_rows`` find the cheapest
edits that make it so: Keep (0), Rerole to user or assistant (2), Delete (3, required for
blank and duplicate rows), Insert an empty user or assistant turn (2); a truncated row
that stays costs 1 more. Of equally cheap edits the audit string (the edits' initials in order)
that is least in ASCII wins.

Method: rows are repartitioned by conversation and sorted; ``mapInPandas`` carries the state of a
dynamic program (the least cost from each of the four states of the grammar) across
Arrow batches. A conversation comes twice in its partition: first backwards without texts, a byte of
role and faults a row, when the program runs from the last row to the first and writes a byte of
back pointers a row (two bits for each state); then forwards with texts, when the pointers are read
back from the end and the edits applied. So the cost of the rest is known at each row, and taking the least
initial among the cheapest edits gives the least audit. Pointers beyond ``SPILL_BYTES`` go to an
unnamed file of the task's own, as a sort's spill does: nothing else reads it, and a task that is run again writes its own.

Scale: one shuffle, by conversation; the sorts (Spark's, which spill) keep its partitioning. A conversation is
streamed, never held: a worker's memory is one Arrow batch, the pointers up to the spill bound, and, in
``audits``, the audit string, which is a column of the result. A conversation with a third of all rows is one task's
stream: the hash of its repaired text is one chain over all its rows in order, which no second task can
continue; other conversations are not held up. The duplicates in it are found by Spark's sort, not in a set.

Order and cases: rows go by turn, null turns first, then role, then text (both by UTF-8 bytes), so ties and
repeated rows have one order. A null role or text counts as one space. A role's initial is its first character; an
empty role has none, fits nowhere and is rerolled or deleted. A null conversation id is a conversation
like any other. Very long texts are streamed whole. An empty table gives an empty result; other
columns are not read. Turns are whole numbers. Ids come back through their text form.
"""

from __future__ import annotations

import hashlib
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import need, only, ship

BLANKS = "\t\n\x0b\x0c\r "
STOPS = ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPILL_BYTES = 1 << 20  # back pointers of a conversation in memory, one byte a row
BATCH_BYTES = 4 << 20  # texts in an output batch, about

START, SYSTEM, USER, ASSISTANT = range(4)  # the states: what the last row was
_NEXT = (USER, USER, ASSISTANT, USER)  # what an inserted or rerolled row is, after each state
_NAME = {USER: "user", ASSISTANT: "assistant"}
#: a kept row's state by (state before, initial); missing: it does not fit
_KEEP = {(START, 1): SYSTEM, (START, 2): USER, (SYSTEM, 2): USER, (USER, 3): ASSISTANT, (ASSISTANT, 2): USER}
_EDITS = "DIKR"  # in ASCII order; a back pointer is the place in here
_AT_END = (0, 2 * INSERT, INSERT, 0)  # least cost of ending from each state: what is missing is inserted


def step(after: list[int], code: int) -> tuple[list[int], int]:
    """The least costs before a row from those after it, and its byte of back pointers.
    ``code``: initial (0 other, 1 s, 2 u, 3 a) + 4 if it must go + 8 if it is truncated."""
    initial, must_go, cut = code & 3, code & 4, TRUNCATED if code & 8 else 0
    cost, edit = [], []
    for s in range(4):
        best, e = DELETE + after[s], 0
        if not must_go:
            to = _KEEP.get((s, initial))
            if to is not None and cut + after[to] < best:
                best, e = cut + after[to], 2
            if REROLE + cut + after[_NEXT[s]] < best:
                best, e = REROLE + cut + after[_NEXT[s]], 3
        cost.append(best)
        edit.append(e)
    out = list(cost)
    for s in range(4):  # an insert before the row; two in succession lead back at a cost
        least = min(cost[_NEXT[s]], INSERT + cost[_NEXT[_NEXT[s]]])
        if INSERT + least < cost[s] or (INSERT + least == cost[s] and edit[s] > 1):
            out[s], edit[s] = INSERT + least, 1
    return out, edit[0] | edit[1] << 2 | edit[2] << 4 | edit[3] << 6


class Pointers:
    """Bytes that come back in the opposite order; beyond a bound they wait in a file of this task's own."""

    def __init__(self, bound: int = SPILL_BYTES):
        self.bound, self.tail, self.file, self.written = bound, bytearray(), None, 0

    def push(self, byte: int) -> None:
        self.tail.append(byte)
        if len(self.tail) >= 2 * self.bound:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.file.seek(self.written)
            self.file.write(self.tail[:self.bound])
            self.written += self.bound
            del self.tail[:self.bound]

    def pop(self) -> int:
        if not self.tail:
            self.written -= self.bound
            self.file.seek(self.written)
            self.tail += self.file.read(self.bound)
        return self.tail.pop()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Conversation:
    """One conversation on its way through a task: backwards ``see`` for each row, forwards ``apply``."""

    def __init__(self, key: str, bound: int):
        self.key, self.costs, self.pointers, self.state = key, list(_AT_END), Pointers(bound), START
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = self.before = None
        self.turns = 0

    def see(self, code: int) -> None:
        self.costs, byte = step(self.costs, code)
        self.pointers.push(byte)

    def apply(self, code: int, role: str, text: str):
        """Yields the (edit, role, text) of this row and of the inserts before it."""
        byte = self.pointers.pop()
        while (edit := _EDITS[byte >> 2 * self.state & 3]) == "I":
            yield self.insert()
        if edit == "D":
            yield "D", role, text
        elif edit == "K":
            self.state = _KEEP[self.state, code & 3]
            yield "K", role, text
        else:
            self.state = _NEXT[self.state]
            yield "R", _NAME[self.state], text

    def insert(self):
        self.state = _NEXT[self.state]
        return "I", _NAME[self.state], ""

    def end(self):
        while self.state in (SYSTEM, USER):
            yield self.insert()
        self.pointers.close()

    def count(self, fault: int, turn, role: str) -> None:
        """Faults and gaps, for the forward rows in order."""
        self.blank += fault == 1
        self.duplicate += fault == 2
        self.truncated += fault == 3
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if turn is not None:
            turn = int(turn)
            if self.first is None:
                self.first = turn
            if turn != self.last:
                self.turns += 1
            self.last = turn

    @property
    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.turns


def _streamed(rows: DataFrame, conv: str, turn: str, role: str, text: str, gone: str | None) -> DataFrame:
    """Each conversation's rows twice in one partition: backwards with their codes, then forwards with all."""
    need(rows, conv, turn, role, text, *([gone] if gone else []))
    ship(rows.sparkSession)
    named = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(f"`{conv}`").cast("string")), F.lit("")).alias("key"),
        F.col(f"`{turn}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"), (F.coalesce(F.col(f"`{gone}`"), F.lit(False)) if gone else F.lit(False)).alias("gone"))
    order = ("gone", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == 2)  # of equal rows the first is no duplicate
    again = F.row_number().over(W.partitionBy("key", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    body = F.rtrim("text", F.lit(BLANKS))
    fault = (F.when(F.length(body) == 0, 1).when(again, 2)
             .when(~F.right(body, F.lit(1)).isin(*STOPS), 3).otherwise(0))
    initial = F.substring("role", 1, 1)
    first = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    # one shuffle: the windows below and the last sort keep the partitioning by conversation
    marked = named.repartition("key").withColumn("fault", fault)
    marked = marked.withColumn("code", first + F.when(F.col("fault").isin(1, 2), 4).when(F.col("fault") == 3, 8).otherwise(0))
    marked = marked.withColumn("pos", F.row_number().over(W.partitionBy("key").orderBy(*order)).cast("long"))
    forward = F.col("phase") == 1
    twice = marked.withColumn("phase", F.explode(F.when(F.col("gone"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))))
    return twice.select("key", "phase", F.when(forward, F.col("pos")).otherwise(-F.col("pos")).alias("pos"), "code", "fault",
                        F.when(forward, F.col("turn").cast("string")).alias("turn"), F.when(forward, F.col("role")).alias("role"),
                        F.when(forward, F.col("text")).alias("text"), "gone").sortWithinPartitions("key", "phase", "pos")


def _walk(batches, bound: int):
    """(event, conversation, row) in order over all batches: "row" for each forward row, "end" after the last one."""
    now = None
    for b in batches:
        for key, phase, code, fault, turn, role, text, gone in zip(
                *(b[c].tolist() for c in ("key", "phase", "code", "fault", "turn", "role", "text", "gone"))):
            if now is None or key != now.key:
                if now is not None:
                    yield "end", now, None
                now = _Conversation(key, bound)
            if gone:
                continue
            if phase == 0:
                now.see(code)
            else:
                yield "row", now, (code, fault, turn, role, text)
    if now is not None:
        yield "end", now, None


def _back(kind: str, conv: str) -> Column:
    return F.when(F.col("key") != "", F.expr("substring(key, 2)")).cast(kind).alias(conv)


def audits(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           gone_col: str | None = None, spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """One row per conversation: ``conv_col``, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 (of the repaired ``role:text``, newline-joined). Rows marked in ``gone_col`` count
    for nothing, but their conversation is returned."""

    def run(batches):
        out, size = [], 0
        audit, digest, some = [], hashlib.sha256(), False
        for event, c, row in _walk(batches, spill_bytes):
            if event == "row":
                code, fault, turn, role, text = row
                c.count(fault, turn, role)
                edits = c.apply(code, role, text)
            else:
                edits = c.end()
            for edit, role, text in edits:
                audit.append(edit)
                if edit != "D":
                    digest.update(f"\n{role}:{text}".encode()[0 if some else 1:])
                    some = True
            if event == "end":
                out.append((c.key, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, c.costs[START], "".join(audit), digest.hexdigest()))
                size += len(audit) + 200
                audit, digest, some = [], hashlib.sha256(), False
                if size > BATCH_BYTES:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=names)

    names = ["key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = _streamed(rows, conv_col, turn_col, role_col, text_col, gone_col).mapInPandas(
        run, "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return found.select(_back(dict(rows.dtypes)[conv_col], conv_col), *names[1:])


def repaired_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                  gone_col: str | None = None, spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """The edits themselves: ``conv_col``, ``at`` (place in the audit, from 0), ``edit`` (D, I, K or R), the row's
    turn (null for an insert) and its role and text after the edit. Without the rows of edit D this is the repaired conversation."""

    def run(batches):
        out, size, at = [], 0, 0
        for event, c, row in _walk(batches, spill_bytes):
            edits, turn = (c.apply(row[0], *row[3:]), row[2]) if event == "row" else (c.end(), None)
            for edit, role, text in edits:
                out.append((c.key, at, edit, None if edit == "I" else turn, role, text))
                at += 1
                size += len(text) + 100
                if size > BATCH_BYTES:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
            if event == "end":
                at = 0
        if out:
            yield pd.DataFrame(out, columns=names)

    names = ["key", "at", "edit", "turn", "role", "text"]
    found = _streamed(rows, conv_col, turn_col, role_col, text_col, gone_col).mapInPandas(
        run, "key string, at long, edit string, turn string, role string, text string")
    return found.select(_back(dict(rows.dtypes)[conv_col], conv_col), "at", "edit", F.col("turn").cast("long").alias(turn_col),
                        F.col("role").alias(role_col), F.col("text").alias(text_col))


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Test damage by crc32(``conv:turn``) % 20 (nulls: one space): 0 marks the row ``gone``, 1 empties its text,
    2 removes ``.!?`` from it, 3 repeats the row, 4 makes its role user."""
    rows = only(conversations, conv_col, turn_col, role_col, text_col)
    conv, turn, role, text = (F.col(f"`{c}`") for c in (conv_col, turn_col, role_col, text_col))
    blank = F.lit(" ")
    name = F.concat(F.coalesce(conv.cast("string"), blank), F.lit(":"), F.coalesce(turn.cast("string"), blank))
    kind = F.crc32(name.cast("binary")) % 20
    words = F.coalesce(text, blank)
    return rows.select(
        conv, turn, F.when(kind == 4, "user").otherwise(F.coalesce(role, blank)).alias(role_col),
        F.when(kind == 1, "").when(kind == 2, F.translate(words, STOPS, "")).otherwise(words).alias(text_col),
        (kind == 0).alias("gone"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")

"""Conversation repair: the cheapest edits that turn a conversation into system?, (user, assistant)+.

Spark deals rows by conversation, marks what was said before, and sorts each task's rows from
the last turn to the first. A task walks through them batch by batch and carries the dynamic
programme with it: what the rest of the conversation costs from each of four places in the grammar.
These costs differ by no more than a few edits, so few different vectors of them exist, and a step
is a look-up by vector and kind of row. A step leaves one byte behind: the edit to choose, two
bits for each place. At a conversation's first row the walk back is the repaired conversation in
its order. Bytes and texts of a giant conversation go to a file of the task; only a
block of them is in memory. The hash of a conversation runs over its text in order, which is why one
conversation is one task's work however long it is.
"""

from __future__ import annotations

import hashlib
import itertools
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Edits in the order of their letters: delete, insert, keep, rerole; and what they cost.
EDITS = "DIKR"
DELETE, INSERT, REROLE, CUT_OFF = 2, 5, 1, 5
#: Places in the grammar: nothing yet, after system, after user, after assistant. A conversation may end at the first and last.
PLACES, ENDS = 4, (0, 3)
#: What a user or assistant row is at each place, and where it leads.
TURN = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
_STEPS = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "": (0, 1, 2, 3)}
#: Kinds of role, by initial.
_KINDS = ("s", "u", "a", "", "other")
#: Faults of a row, by the first that holds.
FAULTS = ("none", "blank", "duplicate", "truncated")
#: Characters that do not count: space, and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
#: Bytes of a conversation held in memory.
HELD = 8 << 20

_NEVER = 1 << 20

SUMMARY = (
    "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, "
    "cost long, audit string, repaired_sha256 string, repaired_turns long"
)
ROWS = "conv_id string, position long, role string, text string, edit string"


class Program:
    """Steps of the dynamic programme, worked out as they are met.

    A vector of costs is kept less its least; ``known`` lists the vectors, ``steps[vector][kind]``
    is the vector a row further to the front, what the least grew by, and the edits to choose.
    """

    def __init__(self) -> None:
        self.known: list[tuple[int, ...]] = []
        self.steps: list[dict[int, tuple[int, int, int]]] = []
        self.ids: dict[tuple[int, ...], int] = {}
        rest = [0 if p in ENDS else _NEVER for p in range(PLACES)]
        self.last, base, self.last_edits = self._settled([[(cost, None)] for cost in rest])
        assert base == 0

    def _settled(self, options: list[list[tuple[int, int | None]]]) -> tuple[int, int, int]:
        """Vector, least and edits, from what each place can do without inserting first."""
        costs = [min(cost for cost, _ in o) for o in options]
        for _ in range(PLACES):
            costs = [min(costs[p], INSERT + costs[TURN[p][1]]) for p in range(PLACES)]
        edits = 0
        for p in range(PLACES):
            best = [e for cost, e in options[p] if cost == costs[p] and e is not None]
            if INSERT + costs[TURN[p][1]] == costs[p]:
                best.append(1)
            edits |= min(best, default=0) << 2 * p
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.ids:
            self.ids[vector] = len(self.known)
            self.known.append(vector)
            self.steps.append({})
        return self.ids[vector], least, edits

    def step(self, vector: int, kind: int) -> tuple[int, int, int]:
        found = self.steps[vector].get(kind)
        if found is None:
            rest, options = self.known[vector], []
            initial, cut_off, must_go = kind >> 2, kind & 1, kind & 2
            for p in range(PLACES):
                can = [(DELETE + rest[p], 0)]
                if not must_go:
                    to = _STEPS.get(_KINDS[initial], (None,) * PLACES)[p]
                    if to is not None:
                        can.append((cut_off * CUT_OFF + rest[to], 2))
                    can.append((REROLE + cut_off * CUT_OFF + rest[TURN[p][1]], 3))
                options.append(can)
            found = self.steps[vector][kind] = self._settled(options)
        return found


class Tape:
    """Rows put on from the last to the first, and read back from the first to the last."""

    def __init__(self, held: int) -> None:
        self.limit, self.held, self.rows, self.blocks, self.file = held, 0, [], [], None

    def put(self, edits: int, role: str, text: str) -> None:
        self.rows.append((edits, role, text))
        self.held += len(text) + len(role) + 64
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        fields = [x.encode() for _, role, text in self.rows for x in (role, text)]
        edits = bytes(e for e, _, _ in self.rows)
        self.file.seek(0, 2)
        self.blocks.append((self.file.tell(), edits, [len(f) for f in fields]))
        self.file.write(b"".join(fields))
        self.rows, self.held = [], 0

    def back(self) -> Iterator[tuple[int, str, str]]:
        yield from reversed(self.rows)
        for at, edits, sizes in reversed(self.blocks):
            self.file.seek(at)
            data = self.file.read(sum(sizes))
            ends = len(data)
            for i in range(len(edits) - 1, -1, -1):
                middle = ends - sizes[2 * i + 1]
                start = middle - sizes[2 * i]
                yield edits[i], data[start:middle].decode(), data[middle:ends].decode()
                ends = start

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Conversation:
    """One conversation on its way from the last row to the first."""

    def __init__(self, key: str | None, program: Program, held: int) -> None:
        self.key, self.program, self.tape = key, program, Tape(held)
        self.vector, self.cost = program.last, 0
        self.faults, self.illegal, self.turns = [0] * len(FAULTS), 0, 0
        self.last_turn = self.turn = self.next = None

    def put(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.last_turn = turn if self.last_turn is None else self.last_turn
            self.turn = turn
        self.faults[fault] += 1
        initial = role[:1]
        if self.next is not None and initial + self.next not in ("su", "ua", "au"):
            self.illegal += 1
        self.next = initial
        kind = _KINDS.index(initial) if initial in _STEPS else len(_KINDS) - 1
        must_go = fault in (1, 2)
        self.vector, more, edits = self.program.step(self.vector, kind << 2 | must_go << 1 | (fault == 3))
        self.cost += more
        # a row that has to go never shows its text again
        self.tape.put(edits, "" if must_go else role, "" if must_go else text)

    def repaired(self) -> Iterator[tuple[str, str, str]]:
        """Edit, role and text from the first row to the last, deletions too."""
        place = 0
        ends = (self.program.last_edits, None, None)
        for edits, role, text in itertools.chain(self.tape.back(), [ends]):
            while True:
                at_end = role is None
                edit = edits >> 2 * place & 3
                if at_end and place in ENDS:
                    return
                if edit == 1:
                    name, place = TURN[place]
                    yield "I", name, ""
                    continue
                if edit == 0:
                    yield "D", role, text
                elif edit == 2:
                    place = _STEPS[role[:1]][place]
                    yield "K", role, text
                else:
                    name, place = TURN[place]
                    yield "R", name, text
                break

    def summary(self) -> tuple:
        audit, digest, turns = [], hashlib.sha256(), 0
        for edit, role, text in self.repaired():
            audit.append(edit)
            if edit != "D":
                digest.update(("\n" * (turns > 0) + f"{role}:{text}").encode())
                turns += 1
        gaps = 0 if self.turn is None else self.last_turn - self.turn + 1 - self.turns
        cost = self.cost + self.program.known[self.vector][0]
        return self.key, gaps, *self.faults[1:], self.illegal, cost, "".join(audit), digest.hexdigest(), turns


def _walked(held: int, as_rows: bool):
    heads = [c.split()[0] for c in (ROWS if as_rows else SUMMARY).split(", ")]
    at_once = 1000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        program, now, out = Program(), None, []

        def done(conversation: Conversation) -> Iterator[pd.DataFrame]:
            nonlocal out
            if as_rows:
                position = 0
                for edit, role, text in conversation.repaired():
                    if edit != "D":
                        out.append((conversation.key, position, role, text, edit))
                        position += 1
                        if len(out) >= at_once:
                            yield pd.DataFrame(out, columns=heads)
                            out = []
            else:
                out.append(conversation.summary())
            conversation.tape.close()

        for batch in batches:
            columns = (batch[c].tolist() for c in ("conv", "nameless", "turn", "timeless", "role", "text", "fault"))
            for conv, nameless, turn, timeless, role, text, fault in zip(*columns, strict=True):
                key = None if nameless else conv
                if now is None or now.key != key:
                    if now is not None:
                        yield from done(now)
                    now = Conversation(key, program, held)
                now.put(None if timeless else turn, role, text, fault)
            if len(out) >= at_once:
                yield pd.DataFrame(out, columns=heads)
                out = []
        if now is not None:
            yield from done(now)
        if out:
            yield pd.DataFrame(out, columns=heads)

    return run


def repair(rows: DataFrame, held: int = HELD, as_rows: bool = False) -> DataFrame:
    """A row for each conversation of ``rows`` (conv_id, turn, role, text): its faults and its cheapest repair.

    Or, ``as_rows``, the repaired rows themselves (conv_id, position, role, text, edit).

    Turns are taken in order, null first; rows of one turn by role and text. Null roles and texts are one space.
    A row's first fault counts: blank (nothing but white space), duplicate (role and text stood before), truncated
    (the last character that counts is none of ``.!?``). Blank and duplicate rows have to go (2); a row may be
    kept, given the role user or assistant (1), or deleted (2), an empty one put anywhere (5); a truncated one that stays
    costs 5. Of equally cheap repairs that with the least letters (D, I, K, R) is taken. A role counts by its initial;
    an empty role stands for nothing and may be kept anywhere. ``gaps`` are turns missing between the first and last.
    Null conv_ids are one conversation. An empty table has no rows; other columns are not looked at.
    """
    kind = rows.schema["conv_id"].dataType
    clean = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
        F.col("conv_id").isNull().alias("nameless"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.col("turn").isNull().alias("timeless"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    told = W.partitionBy("conv", "nameless", "said", "role", "text").orderBy(F.desc("timeless"), "turn")
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = (
        F.when(end == "", 1)
        .when(F.row_number().over(told) > 1, 2)
        .when(~F.right(end, F.lit(1)).isin(".", "!", "?"), 3)
        .otherwise(0)
    )
    marked = clean.repartition("conv", "nameless").withColumn("said", F.xxhash64("role", "text")).withColumn("fault", fault).drop("said")
    # of equal rows the first is no duplicate
    order = ["conv", "nameless", "timeless", F.desc("turn"), F.desc("role"), F.desc("text"), F.desc(F.col("fault") == 2)]
    walked = marked.sortWithinPartitions(*order).mapInPandas(_walked(held, as_rows), ROWS if as_rows else SUMMARY)
    return walked.withColumn("conv_id", F.col("conv_id").cast(kind))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with one row in four damaged, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes its full stops and marks out, 3 repeats it, 4 makes it the user's.
    Nulls are one space; conv_id and turn keep theirs.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    number = F.pmod(F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")), F.lit(20))
    text = F.coalesce("text", F.lit(" "))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), number.alias("_n")).filter("_n <> 0")
    times = F.when(F.col("_n") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_copy", F.explode(times)).select(
        "conv_id",
        "turn",
        F.when(F.col("_n") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_n") == 1, "").when(F.col("_n") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
    )

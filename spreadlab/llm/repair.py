"""Repair of conversations: one sorted pass over their rows with the cheapest edits carried along."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadlab.llm.common import Scratch

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: Rows of a conversation whose backpointers a task holds; every further so many go out as a row of their own.
SPILL_ROWS = 1 << 18

# What stands before: nothing, a system row, a user row, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What an inserted or rerolled row becomes after each of them.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = {"u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "s": {START: SYSTEM}}
#: What a row may get, least string first. Any further insertion belongs before a later row or to the end: D first is the lesser string.
BLOCKS = ("D", "IK", "IR", "K", "R")
#: Insertions that complete the conversation: none after nothing or an assistant, one after a user, two after a system row.
ENDS = ("", "II", "I", "")

RESULT = "conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, repaired_sha256 string, audit string, chunk int, state int, pointers binary"


def moves() -> dict[tuple[str, bool], list[tuple[int, int, int, int]]]:
    """(state before, block, state after, cost) by the row's role initial and whether it must go."""
    out = {}
    for initial in ("s", "u", "a", ""):
        for must_go in (False, True):
            found = []
            for state in range(4):
                for k, block in enumerate(BLOCKS):
                    at, cost = (NEXT[state], INSERT) if block[0] == "I" else (state, 0)
                    if block[-1] == "D":
                        found.append((state, k, state, cost + DELETE))
                    elif not must_go and block[-1] == "K" and at in KEPT.get(initial, {}):
                        found.append((state, k, KEPT[initial][at], cost + KEEP))
                    elif not must_go and block[-1] == "R":
                        found.append((state, k, NEXT[at], cost + REROLE))
            out[(initial, must_go)] = found
    return out


MOVES = moves()


class Path:
    """The cheapest edits that lead to one state: cost, place among the states' edit strings, digest of the repaired rows."""

    __slots__ = ("cost", "rank", "digest", "empty")

    def __init__(self, cost: int, rank: int, digest, empty: bool):
        self.cost, self.rank, self.digest, self.empty = cost, rank, digest, empty

    def said(self, cost: int, lines: list[str]) -> Path:
        if not lines:
            return Path(cost, self.rank, self.digest, self.empty)
        digest = self.digest.copy()
        digest.update((("" if self.empty else "\n") + "\n".join(lines)).encode("utf-8", "surrogatepass"))
        return Path(cost, self.rank, digest, False)


class Conversation:
    """What is carried from row to row and from batch to batch.

    All edit strings after a row consist of as many blocks, and no block starts another, so
    two strings compare like their lists of blocks: by the rank of the paths they extend, then
    by the last block. A path needs its cost, its rank and a running digest; which path a
    state came from, and by which block, are one byte a state and row.
    """

    def __init__(self, conv):
        self.conv, self.paths = conv, {START: Path(0, 0, hashlib.sha256(), True)}
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.before = None
        self.pointers, self.chunk = bytearray(), 0

    def add(self, turn, role: str, text: str, fault: int) -> None:
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most, self.turns = turn, self.turns + 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        self.blank += fault == 1
        self.duplicate += fault == 2
        self.truncated += fault == 3
        must_go, more = fault in (1, 2), CUT if fault == 3 else 0
        best: dict[int, tuple[int, int, int, int]] = {}
        for state, k, after, cost in MOVES[(initial if initial in ("s", "u", "a") else "", must_go)]:
            path = self.paths.get(state)
            if path is not None:
                found = (path.cost + cost + (more if k else 0), path.rank, k, state)
                if after not in best or found < best[after]:
                    best[after] = found
        paths = {}
        for place, (after, (cost, _, k, state)) in enumerate(sorted(best.items(), key=lambda x: (x[1][1], x[1][2]))):
            block, lines, at = BLOCKS[k], [], state
            if block[0] == "I":
                at = NEXT[state]
                lines.append(f"{ROLE[at]}:")
            if block[-1] == "K":
                lines.append(f"{role}:{text}")
            elif block[-1] == "R":
                lines.append(f"{ROLE[NEXT[at]]}:{text}")
            paths[after] = self.paths[state].said(cost, lines)
            paths[after].rank = place
        self.pointers += bytes(best[s][3] * 8 + best[s][2] if s in best else 255 for s in range(4))
        self.paths = paths

    def spilled(self) -> tuple:
        """The pointers so far as a row of the output; memory starts anew."""
        row = (self.conv, *[None] * 8, self.chunk, None, bytes(self.pointers))
        self.pointers, self.chunk = bytearray(), self.chunk + 1
        return row

    def closed(self) -> tuple:
        """The conversation's row; the audit is written out if no pointers were spilled, else they go along."""
        cost, _, state = min((p.cost + INSERT * len(ENDS[s]), p.rank, s) for s, p in self.paths.items())
        digest = self.paths[state].said(cost, [f"{ROLE[r]}:" for r in ((USER, ASSISTANT) if ENDS[state] == "II" else (ASSISTANT,) if ENDS[state] else ())]).digest
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        facts = (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, digest.hexdigest())
        if self.chunk:
            return (*facts, None, self.chunk, state, bytes(self.pointers))
        return (*facts, traced(bytes(self.pointers), state)[0] + ENDS[state], None, None, None)


def traced(pointers: bytes, state: int) -> tuple[str, int]:
    """The edits that led to the state, and the state before them."""
    found = []
    for at in range(len(pointers) - 4, -1, -4):
        came = pointers[at + state]
        found.append(BLOCKS[came & 7])
        state = came >> 3
    return "".join(reversed(found)), state


def stream(spill_rows: int):
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "repaired_sha256", "audit", "chunk", "state", "pointers"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = []
            for conv, is_null, turn, no_turn, role, text, fault in zip(*(batch[c].tolist() for c in ("conv", "no_conv", "turn", "no_turn", "role", "text", "fault"))):
                key = None if is_null else conv
                if held is None or key != held.conv:
                    if held is not None:
                        rows.append(held.closed())
                    held = Conversation(key)
                if fault >= 0:
                    held.add(None if no_turn else turn, role, text, fault)
                    if len(held.pointers) >= 4 * spill_rows:
                        rows.append(held.spilled())
            if rows:
                yield frame(rows, columns)
        if held is not None:
            yield frame([held.closed()], columns)

    return run


def frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=object) for k, c in enumerate(columns)})


def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edits of spilled chunks, from rows sorted by conversation and falling chunk; the last one knows the final state."""
    state = None
    for batch in batches:
        out = []
        for conv, chunk, final, pointers in zip(*(batch[c].tolist() for c in ("conv_id", "chunk", "state", "pointers"))):
            ending = final is not None and final == final
            state = int(final) if ending else state
            tail = ENDS[state] if ending else ""
            edits, state = traced(bytes(pointers), state)
            out.append((conv, int(chunk), edits + tail))
        yield frame(out, ["conv_id", "chunk", "edits"])


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None, spill_rows: int = SPILL_ROWS) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows stand by turn, null turns first, then role and text; repeated rows stay and are
    duplicates. Null roles and texts are one space. Rows of a null conversation form one.
    A row is blank without a character other than blanks, else a duplicate if its role and
    text occur earlier, else truncated if its last such character is none of `.!?`. The
    repaired roles are an optional system row and then user and assistant in turn, or nothing.
    Edits: keep 0, rerole to user or assistant 2, delete 3 (blank and duplicate rows have to
    go), insert an empty user or assistant row 2; truncated rows that stay add 1. Of the
    cheapest edits the least string of initials counts. Rows with `gone` true only name their
    conversation; one without other rows has zeros, an empty audit and the empty text's hash.
    An empty table has no rows; other columns are not read.

    Rows are dealt by conversation and sorted; batches stream through a task that carries four
    paths, whatever a conversation's length. Backpointers beyond `spill_rows` rows leave the
    task as rows of the shared table and are traced from their end in a second sorted pass.
    """
    scratch = Scratch(rows.sparkSession, "repair")
    space = F.lit(" ")
    said = rows.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), space).alias("role"),
        F.coalesce(F.col(text), space).alias("text"),
        (F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)).alias("gone"),
    )
    dealt = said.repartition("conv")
    nth = F.row_number().over(Window.partitionBy("conv", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    blank = F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")) == 0
    ended = F.regexp_like(F.col("text"), F.lit(r"[.!?][\x20\x09-\x0D]*\z"))
    fault = F.when(F.col("gone"), -1).when(blank, 1).when(F.col("nth") > 1, 2).when(~ended, 3).otherwise(0)
    order = ("conv", F.col("turn").asc_nulls_first(), "role", "text", "nth")
    sorted_ = dealt.withColumn("nth", nth).withColumn("fault", fault).sortWithinPartitions(*order)
    streamed = sorted_.select("conv", F.col("conv").isNull().alias("no_conv"), F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNull().alias("no_turn"), "role", "text", F.col("fault").cast("int").alias("fault"))
    conv_type = rows.schema[conv].dataType.simpleString()
    found = scratch.keep(streamed.mapInPandas(stream(spill_rows), RESULT.format(conv=conv_type)), "streamed")

    chunks = found.where("chunk is not null").select("conv_id", "chunk", "state", "pointers")
    edits = chunks.repartition("conv_id").sortWithinPartitions("conv_id", F.col("chunk").desc()).mapInPandas(trace, f"conv_id {conv_type}, chunk int, edits string")
    # The audit is one value of a conversation's row, so its pieces meet there.
    whole = edits.groupBy(F.col("conv_id").alias("long_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "edits"))), lambda x: x["edits"]), "").alias("long_audit"))
    ends = found.where("cost is not null")
    out = ends.join(whole, ends["conv_id"].eqNullSafe(whole["long_id"]) & F.col("chunk").isNotNull(), "left")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.coalesce("audit", "long_audit").alias("audit"), "repaired_sha256")


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text and gone of rows after the damage that crc32(`conv:turn`) % 20 gives them.

    0 drops the row (it stays here as `gone`), 1 empties its text, 2 removes its `.!?`, 3
    repeats it and 4 sets its role to user. Nulls are one space.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    hurt = rows.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), space).alias("role"),
        F.coalesce(F.col(text), space).alias("text"),
        F.pmod(F.crc32(key.cast("binary")), F.lit(20)).cast("int").alias("hurt"),
    )
    kind: Column = F.col("hurt")
    return hurt.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")

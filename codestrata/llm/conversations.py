"""Repair of conversations by the cheapest edits, in one pass over their turns in order."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from codestrata.llm.storage import ship

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1  # costs
STOPS = ".!?"
SPACE = " \t\n\x0b\x0c\r"
HELD_BYTES = 4 << 20  # backpointers of one conversation that stay in memory
ACTIONS = "DKR"
# States of a repaired conversation: nothing yet, a system turn, a user turn last, an assistant turn last.
NEXT = (2, 2, 3, 2)
TURN = (None, "system", "user", "assistant")
LEGAL = ("su", "ua", "au")

SUMMARY = "_conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with a fault in some, and `copies`: 0 for a dropped row, 2 for a repeated one.

    crc32 of "conv_id:turn" modulo 20 decides: 0 drops the row, 1 empties its text, 2 removes its stops,
    3 repeats it, 4 makes it the user's. Nulls count as one space."""
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), fault.alias("_fault"))
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    copies = F.when(F.col("_fault") == 0, 0).when(F.col("_fault") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


@lru_cache(100_000)
def _step(front: tuple, role: str, forced: bool, cut: bool) -> tuple[tuple, int, tuple]:
    """One row of the shortest path: (front after it, cost taken out, how each state was reached).

    A front has (cost, rank of the edits so far) or None for each state; ranks order the edits by their
    text. Two states' edits end with a row's edit each and count the same rows, so neither begins
    with the other and ranks settle ties for good. A state is reached by (state before, inserts, action).
    """
    best: list = [None] * 4
    for before, inserts in product(range(4), range(3)):
        if front[before] is None:
            continue
        cost, rank = front[before]
        state = before
        for _ in range(inserts):
            cost, state = cost + INSERT, NEXT[state]
        ways = [(DELETE, state, "D")]
        if not forced:
            if role == "s" and state == 0:
                ways.append((KEEP + CUT_OFF * cut, 1, "K"))
            elif role in ("u", "a") and TURN[NEXT[state]][0] == role:
                ways.append((KEEP + CUT_OFF * cut, NEXT[state], "K"))
            ways.append((REROLE + CUT_OFF * cut, NEXT[state], "R"))
        for price, after, action in ways:
            way = (cost + price, rank, "I" * inserts + action, before)
            if best[after] is None or way < best[after]:
                best[after] = way
    least = min(way[0] for way in best if way)
    order = sorted(way[1:3] for way in best if way)
    front = tuple(way and (way[0] - least, order.index(way[1:3])) for way in best)
    return front, least, tuple(way and (way[3], len(way[2]) - 1, way[2][-1]) for way in best)


def _packed(reached: tuple) -> bytes:
    """How the four states were reached, one byte each."""
    return bytes(0 if way is None else way[0] | way[1] << 2 | ACTIONS.index(way[2]) << 4 for way in reached)


class _Conversation:
    """What one conversation's rows so far leave behind: counts, the front, a running hash of the repaired
    text for each of its states, and backpointers of 4 bytes a row (in memory up to HELD_BYTES, then in a
    file of this task's own that ends with it, as a sort's spill does)."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.role = None
        self.front = ((0, 0), None, None, None)
        self.hashes = [hashlib.sha256(), None, None, None]
        self.back = bytearray()
        self.spill = None
        self.marked = None

    def number(self, turn) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1

    def add(self, role: str, text: str, repeated: bool) -> None:
        inner = text.strip(SPACE)
        cut = False
        if not inner:
            self.blank += 1
        elif repeated:
            self.duplicate += 1
        else:
            cut = inner[-1] not in STOPS
            self.truncated += cut
        if self.role is not None and self.role[:1] + role[:1] not in LEGAL:
            self.illegal += 1
        self.role = role
        self.front, least, reached = _step(self.front, role[:1], not inner or repeated, cut)
        self.cost += least
        hashes: list = [None] * 4
        for after, way in enumerate(reached):
            if way:
                before, inserts, action = way
                state, parts = before, []
                for _ in range(inserts):
                    state = NEXT[state]
                    parts.append(TURN[state] + ":")
                if action != "D":
                    parts.append(f"{role if action == 'K' else TURN[after]}:{text}")
                hashes[after] = self.hashed(before, parts)
        self.hashes = hashes
        self.back += _packed(reached)
        if len(self.back) >= HELD_BYTES:
            self.spill = self.spill or tempfile.TemporaryFile()
            self.spill.write(self.back)
            self.back.clear()

    def hashed(self, state: int, parts: list[str]):
        if not parts:
            return self.hashes[state]
        own = self.hashes[state].copy()
        own.update((("\n" if state else "") + "\n".join(parts)).encode("utf-8", "surrogatepass"))
        return own

    def steps_back(self) -> Iterator[bytes]:
        """Backpointers from the last row to the first."""
        held = bytes(self.back)
        for k in range(len(held) - 4, -1, -4):
            yield held[k : k + 4]
        if self.spill:
            left = self.spill.tell()
            while left:
                size = min(HELD_BYTES, left)
                left -= size
                self.spill.seek(left)
                held = self.spill.read(size)
                for k in range(size - 4, -1, -4):
                    yield held[k : k + 4]
            self.spill.close()

    def summary(self) -> tuple:
        ends = []
        for state, inserts in ((0, 0), (1, 2), (2, 1), (3, 0)):
            if self.front[state]:
                cost, rank = self.front[state]
                ends.append((cost + INSERT * inserts, rank, "I" * inserts, state))
        cost, _, tail, state = min(ends)
        parts = [TURN[s] + ":" for s in ((2, 3) if state == 1 else (3,))][: len(tail)]
        digest = self.hashed(state, parts).hexdigest()
        audit = bytearray(tail.encode())
        for step in self.steps_back():
            way = step[state]
            state, inserts, action = way & 3, way >> 2 & 3, way >> 4
            audit += ACTIONS[action].encode() + b"I" * inserts
        audit.reverse()
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + cost, audit.decode(), digest)


def _repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Summaries of the conversations, whose rows come in order and may go on over many batches."""
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    now = None
    for batch in batches:
        done = []
        marks = batch["_mark"].to_list()
        known, turns = batch["_known"].to_list(), batch["_turn"].to_list()
        for k, conv_id in enumerate(batch["_conv"].to_list()):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    done.append(now.summary())
                now = _Conversation(conv_id)
            copies = batch["copies"].iat[k]
            if copies < 0:
                now.marked = marks[k]
            elif copies:
                now.number(turns[k] if known[k] else None)
                for _ in range(copies):
                    now.add(batch["role"].iat[k], batch["text"].iat[k], now.marked != marks[k])
                    now.marked = None
        if done:
            yield pd.DataFrame(done, columns=names)
    if now is not None:
        yield pd.DataFrame([now.summary()], columns=names)


def _ordered(turns: DataFrame) -> DataFrame:
    """The rows with their place: null turns first, rows of one turn by a digest of role and text. `_conv` tells
    a null conv_id from an empty one."""
    shown = lambda name: F.coalesce(F.col(name), F.lit(" ")).alias(name)
    conv = F.concat(F.when(F.col("conv_id").isNull(), " ").otherwise("="), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    rows = turns.select(conv.alias("_conv"), "turn", shown("role"), shown("text"), F.col("copies").cast("int").alias("copies"))
    digest = F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")))
    known: Column = F.col("turn").isNotNull()
    return rows.select("_conv", known.alias("_known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("_turn"), digest.alias("_mark"), "role", "text", "copies")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """The faults of each conversation and its cheapest repair.

    turns: conv_id, turn, role, text, copies (so many equal rows in a place; 0: a dropped row, of which only
    the conv_id counts); other columns are not read. One row for each conv_id, a null one too:

    * gaps: numbers missing between the least and the largest turn;
    * blank, duplicate (role and text seen earlier), truncated (no stop at the end): rows by their first fault;
      illegal: neighbours whose roles may not follow each other;
    * cost and audit of the cheapest edits (Delete, Insert, Keep, Rerole; ties: least text) that leave
      no turn at all or user and assistant in turns after at most one system turn, each pair complete;
    * repaired_sha256 of the lines "role:text" that are left.

    Null role or text: one space. A conversation without rows: zeros, an empty audit, the hash of nothing. An
    empty table: no rows. Rows of one turn are taken in the order of a digest, so equal rows are neighbours.

    The first place of each text comes from one grouping (combined before the shuffle) as a marker row.
    Rows and markers are dealt by conversation and sorted by turn; a task then reads them as a stream and
    holds one conversation's front, four hashes and a bounded part of its backpointers, never its texts. A
    conversation is one stream, since its hash can only be taken in order.
    """
    ship(turns.sparkSession)
    rows = _ordered(turns)
    first = rows.where("copies > 0").groupBy("_conv", "_mark").agg(F.min(F.struct("_known", "_turn")).alias("_at"))
    nothing = F.lit(None).cast("string")
    markers = first.select("_conv", "_at._known", "_at._turn", "_mark", nothing.alias("role"), nothing.alias("text"), F.lit(-1).alias("copies"))
    stream = rows.union(markers).repartition("_conv").sortWithinPartitions("_conv", "_known", "_turn", "_mark", "copies")
    found = stream.mapInPandas(_repair, SUMMARY)
    own = F.when(F.col("_conv").startswith("="), F.substring("_conv", F.lit(2), F.char_length("_conv")))
    return found.select(own.cast(turns.schema["conv_id"].dataType).alias("conv_id"), *found.columns[1:])


def repaired_turns(turns: DataFrame, summary: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, place (from 0), role, text, edit (K, R or I).

    turns and summary as `repair_conversations` takes and gives them. An audit falls into one piece for each row, the
    inserts before it and the row's own edit, and inserts at the end; a piece is joined to its row by the row's number.
    """
    conv = F.concat(F.when(F.col("conv_id").isNull(), " ").otherwise("="), F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).alias("_conv")
    along = Window.partitionBy("_conv").orderBy("_known", "_turn", "_mark", "_copy")
    rows = _ordered(turns).where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies")))
    rows = rows.select("_conv", (F.row_number().over(along) - 1).alias("_row"), "role", "text")
    pieces = F.regexp_extract_all("audit", F.lit("(I*[DKR]|I+$)"))
    edits = summary.select(conv, "conv_id", F.posexplode(pieces).alias("_row", "_piece"))
    inserts = F.char_length(F.regexp_replace("_piece", "[DKR]", ""))
    action = F.regexp_replace("_piece", "I", "")
    edits = edits.join(rows, ["_conv", "_row"], "left").withColumns({"_inserts": inserts, "_action": action})
    edits = edits.withColumn("_n", F.col("_inserts") + F.col("_action").isin("K", "R").cast("int"))
    before = Window.partitionBy("_conv").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    edits = edits.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    opens = (F.col("_start") == 0) & (F.col("_piece") == "K") & F.col("role").startswith("s")
    edits = edits.withColumn("_system", F.max(opens.cast("int")).over(Window.partitionBy("_conv")))
    items = edits.where("_n > 0").withColumn("_item", F.explode(F.sequence(F.lit(1), "_n")))
    place = F.col("_start") + F.col("_item") - 1
    edit = F.when(F.col("_item") <= F.col("_inserts"), "I").otherwise(F.col("_action"))
    due = F.when((place - F.col("_system")) % 2 == 0, "user").otherwise("assistant")
    return items.select(
        "conv_id", place.alias("place"), F.when(edit == "K", F.col("role")).otherwise(due).alias("role"), F.when(edit == "I", "").otherwise(F.col("text")).alias("text"), edit.alias("edit")
    )

"""Conversation repair against a search over all edits."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from codestrata.llm import conversations
from codestrata.llm.conversations import damaged, repair_conversations, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string, copies string, _conv int"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, repaired lines): all edits that end well, by dynamic programming over whole texts from the end."""
    best = {"": (0, "", ()), "a": (0, "", ()), "u": (2, "I", (("assistant", ""),)), "s": (4, "II", (("user", ""), ("assistant", "")))}
    for role, text, forced, cut in reversed(rows):
        after = best

        def ways(state, depth=0):
            cost, audit, lines = after[state]
            yield cost + 3, "D" + audit, lines
            due = NEXT[state]
            if not forced:
                cost, audit, lines = after[due]
                yield cost + 2 + cut, "R" + audit, ((NAMES[due], text), *lines)
                if role[:1] == due or (role[:1] == "s" and state == ""):
                    cost, audit, lines = after[role[:1]]
                    yield cost + cut, "K" + audit, ((role, text), *lines)
            if depth < 3:
                for cost, audit, lines in ways(due, depth + 1):
                    yield cost + 2, "I" + audit, ((NAMES[due], ""), *lines)

        best = {state: min(ways(state)) for state in best}
    return best[""]


def brute(turns):
    shown = lambda v: " " if v is None else str(v)
    convs = {}
    for conv, turn, role, text in turns:
        own = convs.setdefault(conv, [])
        fault = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if fault == 0:
            continue
        text = "" if fault == 1 else text.translate({ord(c): None for c in ".!?"}) if fault == 2 else text
        role = "user" if fault == 4 else role
        mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
        own += [((turn is not None, turn or 0, mark), role, text)] * (2 if fault == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: r[0])
        seen, rows, counts = set(), [], [0, 0, 0]
        for _, role, text in own:
            inner = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not inner else 1 if (role, text) in seen else 2 if inner[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            rows.append((role, text, fault in (0, 1), int(fault == 2)))
        known = [k[1] for k, _, _ in own if k[0]]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest(rows)
        text = "\n".join(f"{r}:{t}" for r, t in lines)
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def talk(seed, n):
    rng = random.Random(seed)
    for conv in [*range(n), None]:
        for turn in range(rng.randint(0, 9)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""])
            yield conv, rng.choice([turn, turn, turn, 2, None]), role, rng.choice(["Yes.", "No", "What is it?", "", None, "a.\nb! ", "ünd", "Yes.", f"{turn}."])


@pytest.fixture
def turns(spark):
    return lambda data: spark.createDataFrame([(*r, "x", 1) for r in data], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_a_search_over_all_edits(turns, seed, monkeypatch):
    monkeypatch.setattr(conversations, "HELD_BYTES", 8 if seed == 2 else conversations.HELD_BYTES)
    data = list(talk(seed, 300))
    found = repair_conversations(damaged(turns(data)))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(data)


def test_a_conversation_longer_than_a_batch_with_little_memory(spark, turns, monkeypatch):
    monkeypatch.setattr(conversations, "HELD_BYTES", 64)
    rng = random.Random(3)
    data = [(7, t, rng.choice(["user", "assistant"]), rng.choice([f"Turn {t}.", "again.", f"no end {t}"])) for t in range(3000)] + [(8, 1, "user", "Hi.")]
    rng.shuffle(data)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = repair_conversations(damaged(turns(data))).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert sorted((tuple(r) for r in found), key=str) == brute(data)


def test_the_repaired_turns_give_the_hash_and_the_order_of_roles(turns):
    broken = damaged(turns(list(talk(5, 200))))
    summary = repair_conversations(broken)
    lines = F.array_sort(F.collect_list(F.struct("place", "role", "text")))
    text = F.array_join(F.transform("rows", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    whole = repaired_turns(broken, summary).groupBy("conv_id").agg(lines.alias("rows")).select(F.col("conv_id").alias("c"), F.sha2(text.cast("binary"), 256).alias("h"))
    both = summary.join(whole, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    assert both.where(F.coalesce("h", F.lit(nothing)) != F.col("repaired_sha256")).count() == 0
    assert both.where("h is not null").count() > 50


def test_an_empty_table(turns):
    assert repair_conversations(damaged(turns([]))).collect() == []

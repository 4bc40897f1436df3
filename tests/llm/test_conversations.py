from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.llm.conversations import damaged, repair
from tickloom.llm.queries import all_queries

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def order(row):
    return (row[0] is not None, row[0] or 0, row[1], row[2])


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        n = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if n == 0:
            continue
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        out += [(conv, turn, "user" if n == 4 else role, text)] * (2 if n == 3 else 1)
    return out


def cheapest(rows):
    """Least (cost, audit) over all edits, by searching whole strings of edits."""
    faults, seen = [], set()
    for _, role, text in rows:
        end = text.rstrip(SPACE)
        fault = 1 if not end else 2 if (role, text) in seen else 3 if end[-1] not in ".!?" else 0
        seen.add((role, text))
        faults.append(fault)
    # initials so far as s?(ua)* with an optional open part: place in the grammar
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, made, kept = heapq.heappop(heap)
        if not re.fullmatch("(s?((ua)*u?)?)", made):
            continue
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", made):
            return faults, cost, audit, kept
        place = (i, made[-1:] if made[-1:] else "")
        if (place, audit, cost) in done:
            continue
        done.add((place, audit, cost))
        short = made if len(made) < 4 else made[-4:] if made[-1] == "a" else made[-3:]
        short = short if re.fullmatch("(s?((ua)*u?)?)", short) else made
        for role in ("user", "assistant"):
            if audit[-4:] != "IIII":
                heapq.heappush(heap, (cost + 5, audit + "I", i, short + role[0], (*kept, role + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, short, kept))
            if faults[i] not in (1, 2):
                extra = 5 * (faults[i] == 3)
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, short + role[:1], (*kept, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, short + name[0], (*kept, f"{name}:{text}")))
    raise AssertionError


def brute(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, group in groups.items():
        group.sort(key=order)
        faults, cost, audit, kept = cheapest(group)
        turns = [t for t, _, _ in group if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(group, group[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in (1, 2, 3)), illegal, cost, audit, sha)
    return out


def got(df):
    heads = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[h] for h in heads) for r in df.collect()}


def some_rows(seed, conversations=60):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"]
    texts = ["Hi.", "No", "Why?", " \t", "", None, "So! ", "x.\n", "ü", "a:b\nc."]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(0, 7)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(roles), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_repair_is_the_cheapest(spark, seed):
    rows = some_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(repair(df)) == brute(rows)
    # a tape that spills after each row gives the same
    assert got(repair(df, held=0)) == brute(rows)


def test_the_repaired_rows_are_those_of_the_summary(spark):
    rows = some_rows(9)
    df = spark.createDataFrame(rows, SCHEMA)
    texts = defaultdict(list)
    for r in sorted(repair(df, held=50, as_rows=True).collect(), key=lambda r: (r["conv_id"], r["position"])):
        texts[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for conv, want in brute(rows).items():
        assert hashlib.sha256("\n".join(texts[conv]).encode()).hexdigest() == want[-1]


def test_damage(spark):
    rows = [(c, t, "system", "a.b!c?") for c in range(30) for t in range(5)] + [(None, None, None, None), (3, None, "user", None)]
    want = sorted(map(repr, hurt(rows)))
    assert sorted(repr(tuple(r)) for r in damaged(spark.createDataFrame(rows, SCHEMA)).collect()) == want


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(hurt(rows))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(all_queries()["op11_conversation_repair"](spark, sf)) == {c: want.get(c, empty) for c in {r[0] for r in rows}}


def test_a_giant_conversation_goes_through_batches(spark):
    n = 30_000
    df = spark.range(n).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 7 == 3, "user").when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("x"), "id", F.when(F.col("id") % 11 == 5, "").otherwise(".")).alias("text"),
    )
    one, small = (got(repair(df, held=h)) for h in (1 << 30, 2000))
    assert one == small and len(one[1][-2]) >= n


def test_edges(spark):
    assert repair(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame(
        [(None, 1, "user", "Hi.", "x", 1), (None, 1, "user", "Hi.", "y", 2), (None, 2, "assistant", "z" * 3_000_000 + ".", None, None)],
        SCHEMA + ", fault string, audit int",
    )
    found = got(repair(clash))
    assert list(found) == [None] and found[None][:7] == (0, 0, 1, 0, 1, 2, "KDK")
    named = spark.createDataFrame([("a", 1, "user", "Hi."), ("", 1, "system", None)], "conv_id string, turn int, role string, text string")
    assert {k: v[6] for k, v in got(repair(named)).items()} == {"a": "D", "": "D"}

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from threatframe.llm import conversations as c

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def least(rows, inserts=2):
    """(cost, audit, lines) by trying every row's edits in turn, keeping the least of (cost, audit) for what is said last."""
    ways = {"": (0, "", [])}

    def grow(found, way, to):
        if to not in found or way[:2] < found[to][:2]:
            found[to] = way

    for k in range(len(rows) + 1):
        for _ in range(inserts):
            for end, (cost, audit, lines) in list(ways.items()):
                role = NEXT[end]
                grow(ways, (cost + 5, audit + "I", [*lines, ("user" if role == "u" else "assistant") + ":"]), role)
        if k == len(rows):
            break
        role, text, gone, cut = rows[k]
        found = {}
        for end, (cost, audit, lines) in ways.items():
            grow(found, (cost + 2, audit + "D", lines), end)
            if not gone:
                extra, to = 5 * cut, NEXT[end]
                if role[:1] == to or end == "" and role[:1] == "s":
                    grow(found, (cost + extra, audit + "K", [*lines, f"{role}:{text}"]), role[:1])
                grow(found, (cost + 1 + extra, audit + "R", [*lines, ("user" if to == "u" else "assistant") + f":{text}"]), to)
        ways = found
    return min(ways[e] for e in ("", "a") if e in ways)


def every_way(rows):
    """As least, for few rows, from all strings of edits."""
    best = None
    for n in range(len(rows) + 4):
        for audit in itertools.product("DIKR", repeat=n):
            if sum(x != "I" for x in audit) != len(rows):
                continue
            left, end, cost, said = iter(rows), "", 0, ""
            for x in audit:
                if x == "I":
                    cost, end = cost + 5, NEXT[end]
                    said += end
                    continue
                role, _, gone, cut = next(left)
                if x == "D":
                    cost += 2
                    continue
                if gone:
                    break
                end = role[:1] or "?" if x == "K" else NEXT[end]
                said += end
                cost += 5 * cut + (x == "R")
                if end not in NEXT:
                    break
            else:
                if re.fullmatch("(s?(ua)+)?", said) and (best is None or (cost, "".join(audit)) < best):
                    best = (cost, "".join(audit))
    return best


def brute(rows):
    """Rows (conv_id, turn, role, text) to results, as the contract reads."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else str(x)
        role, text = space(role), space(text)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        convs[conv] += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, judged, faults = set(), [], [0, 0, 0]
        for _, role, text in own:
            said = re.sub(r"[\x20\x09-\x0D]+", "", text)
            fault = 0 if not said else 1 if (role, text) in seen else 2 if said[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            judged.append((role, text, fault in (0, 1), fault == 2))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, lines = least(judged)
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def rows_at_random(rng, convs, longest):
    texts = ["One.", "Two!", "three", "", "  \t", "Four? ", "five", None, "six.", "seven\x0b"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "s"]
    return [(conv, rng.choice([None, *range(longest)]), rng.choice(roles), rng.choice(texts)) for conv in [None, *range(convs)] for _ in range(rng.randint(1, longest))]


def results(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_search_equals_trying_everything():
    rng = random.Random(1)
    for _ in range(150):
        rows = [(rng.choice(["user", "assistant", "system", "x", ""]), "t", rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 4))]
        got = c.cheapest(c.steps_of([(r[0][:1], r[2], r[3], 1) for r in rows]))
        assert got == every_way(rows) == least(rows)[:2]


def test_long_searches_equal_stepwise_ones():
    rng = random.Random(2)
    for n in (30, 200, 900):
        rows = [(rng.choice(["user", "assistant", "user", "assistant", "system", "x"]), str(i), rng.random() < 0.2, rng.random() < 0.3) for i in range(n)]
        assert c.cheapest(c.steps_of([(r[0][:1], r[2], r[3], 1) for r in rows])) == least(rows)[:2]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("long_rows", [3, 1024])
def test_repair_equals_brute_force(spark, long_rows):
    rows = rows_at_random(random.Random(3), 60, 14)
    rows += rows_at_random(random.Random(4), 0, 300) + [(7, 3, "user", "again.")] * 50 + [(99, 1, "user", "x" * 300_000)]
    df = spark.createDataFrame([(*r, "c", "d", "e") for r in rows], SCHEMA + ", copies string, tie string, place string").repartition(5)
    assert results(c.repair(df, long_rows)) == brute(rows)


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "no", f"{t}."])) for t in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert results(c.repair(df, 16)) == brute(rows)  # 4 tasks, some 190 segments, two rounds of folding


def test_empty_and_all_dropped(spark):
    assert c.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    dropped = [(conv, 0, "user", "x.") for conv in range(300) if zlib.crc32(f"{conv}:0".encode()) % 20 == 0]
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert dropped and results(c.repair(spark.createDataFrame(dropped, SCHEMA))) == {r[0]: empty for r in dropped}


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(c.op11_bidirectional_repair(spark, sf)) == brute(rows)

"""Conversation repair against a search over all edits, cheapest first."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from gridstat.llm import conversations as cv


def plain_damage(rows):
    out = defaultdict(list)
    shown = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn, "user" if kind == 4 else role, text)
        out[conv] += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    heap, done = [(0, "", 0, ())], set()
    while True:
        cost, audit, i, out = heapq.heappop(heap)
        now = "".join(r[:1] for r, _ in out)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", now):
            break
        key = (i, "S" if now == "s" else now[-1:])
        if key in done:
            continue
        done.add(key)

        def push(more, letter, at, add, cost=cost, audit=audit, out=out, now=now):
            if re.fullmatch("(s?(ua)*u?)?", now + "".join(r[:1] for r, _ in add)) and all(r for r, _ in add):
                heapq.heappush(heap, (cost + more, audit + letter, at, out + add))

        for role in ("user", "assistant"):
            push(3, "I", i, ((role, ""),))
        if i < len(rows):
            _, role, text = rows[i]
            push(4, "D", i + 1, ())
            if faults[i] not in ("blank", "duplicate"):
                cut = 3 if faults[i] == "truncated" else 0
                push(cut, "K", i + 1, ((role, text),))
                for other in ("user", "assistant"):
                    push(3 + cut, "R", i + 1, ((other, text),))
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    }


def conversations(n, seed, most=9):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "assistant", "user", "tool", "", None, "uncle", "Über"]
    texts = ["Yes.", "No", "Yes.", "", " \n", "what?  ", "a\nb.", "ends with : newline.\n", "tab\t!", None, "日本語", "\x85", "long " * 50 + "."]
    rows = []
    for c in range(n):
        for k in range(r.randint(1, most)):
            rows.append((c if c else None, r.choice([k, k, k, None, 3, 10 * k]), r.choice(roles), r.choice(texts)))
    return rows


def records(df):
    return {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    # conversation 10000 has its only row dropped
    lost = next(c for c in range(10_000, 20_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return conversations(120, 1) + [(lost, 0, "user", "Gone.")]


@pytest.fixture(scope="module")
def want(rows):
    damaged = plain_damage(rows)
    return {c: plain_repair(damaged[c]) for c in {r[0] for r in rows}}


def test_repair(spark, rows, want):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, chunk int, lost string").repartition(3)
    assert records(cv.digests(cv.repair(cv.damage(df)))) == want


@pytest.mark.parametrize(("long", "span", "fan"), [(1, 2, 2), (3, 4, 3)])
def test_repair_of_long_conversations(spark, rows, want, monkeypatch, long, span, fan):
    """Chunks of two turns or of one, or of one text, and products in several levels, give the same."""
    for name, value in (("LONG", long), ("SPAN", span), ("FAN", fan)):
        monkeypatch.setattr(cv, name, value)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert records(cv.digests(cv.repair(cv.damage(df), long))) == want


def test_one_long_conversation(spark):
    """Of 9,000 rows and the production limits, among short ones; its repaired text is what its pieces are."""
    r = random.Random(2)
    rows = [(1, t, r.choice(["user", "assistant"]), r.choice(["A.", "B?", f"text {t}.", ""])) for t in range(9000)] + conversations(5, 3)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = cv.repair(cv.undamaged(df))
    assert out.pieces.select("part").distinct().count() > 30
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, " " if role is None else role, " " if text is None else text))
    assert records(cv.digests(out)) == {c: plain_repair(v) for c, v in by.items()}


def test_ids_turns_and_empty_tables(spark):
    """Ids that are no numbers, turns that are none, turns at the ends of their range, and no rows."""
    rows = [("a", "x", "user", "Hi."), ("a", "2", "assistant", "Yes."), (None, None, "assistant", "Yes."), ("b", str(2**63 - 1), "user", "Hi."), ("b", str(-(2**63)), "system", "Be.")]
    got = records(cv.digests(cv.repair(cv.undamaged(spark.createDataFrame(rows, "conv_id string, turn string, role string, text string")))))
    assert {k: (v["gaps"], v["audit"]) for k, v in got.items()} == {"a": (0, "KK"), None: (0, "IK"), "b": (0, "KKI")}
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert records(cv.digests(cv.repair(cv.damage(empty)))) == {}

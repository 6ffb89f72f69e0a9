"""Conversation repair against enumeration of all alignments."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from ripplemark.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, head boolean, mark string, audit string"


def plain_mend(codes):
    """Least cost and audit over every feasible target, by plain recursion."""
    found = []
    for length in range(0, 3 * len(codes) + 4):
        target = ("s" if length % 2 else "") + "ua" * (length // 2)
        if length == 1:
            continue

        @lru_cache(None)
        def best(i, j, target=target):
            if i == len(codes) and j == len(target):
                return 0, ""
            options = []
            if i < len(codes):
                initial, fault = " sua"[codes[i] & 3], codes[i] >> 2
                cost, rest = best(i + 1, j)
                options.append((cost + 3, "D" + rest))
                if fault not in (1, 2) and j < len(target):
                    cost, rest = best(i + 1, j + 1)
                    cost += fault == 3
                    if initial == target[j]:
                        options.append((cost, "K" + rest))
                    if target[j] != "s":
                        options.append((cost + 2, "R" + rest))
            if j < len(target) and target[j] != "s":
                cost, rest = best(i, j + 1)
                options.append((cost + 2, "I" + rest))
            return min(options) if options else (10**9, "")

        found.append(best(0, 0))
    return min(found)


def test_alignment_of_random_codes():
    r = random.Random(4)
    for _ in range(400):
        codes = bytes(r.choice([1, 2, 2, 3, 3, 0]) + 4 * r.choice([0, 0, 0, 0, 1, 2, 3]) for _ in range(r.randint(0, 9)))
        assert conversations.mend(codes) == plain_mend(codes), codes


def test_alignment_in_blocks(monkeypatch):
    """Blocks of the table change nothing, however many there are."""
    r = random.Random(6)
    monkeypatch.setattr(conversations, "BLOCK", 1)
    for _ in range(150):
        codes = bytes(r.choice([1, 2, 3, 2, 3, 0]) + 4 * r.choice([0, 0, 0, 3]) for _ in range(r.randint(0, 12)))
        assert conversations.mend(codes) == plain_mend(codes), codes


def test_long_conversation():
    r = random.Random(7)
    codes = bytes(r.choice([2, 3]) + 4 * (r.random() < 0.05) for _ in range(3000))
    cost, audit = conversations.mend(codes)
    assert len(audit) - audit.count("I") == 3000
    price = {"K": 0, "R": 2, "D": 3, "I": 2}
    assert cost == sum(price[e] for e in audit)
    assert re.fullmatch("(ua)*", "".join("u" if n % 2 == 0 else "a" for n in range(len(audit) - audit.count("D"))))


def plain_report(rows):
    """The contract of the query, row by row."""
    convs = defaultdict(list)
    text_of = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        convs[conv]
        role, text = text_of(role), text_of(text)
        fate = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        if fate == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fate, text)
        convs[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).digest()))
        seen, codes = set(), []
        for _, role, text in turns:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 1 if not body else 2 if (role, text) in seen else 0 if body[-1] in ".!?" else 3
            seen.add((role, text))
            codes.append(" sua".find(role[:1] or "?") % 4 * (role[:1] != " ") + 4 * fault if role[:1] in "sua" and role else 4 * fault)
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        faults = [sum(c >> 2 == k for c in codes) for k in (1, 2, 3)]
        initials = [t[1][:1] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = plain_mend(bytes(codes))
        length = len(audit) - audit.count("D")
        target = ("s" if length % 2 else "") + "ua" * (length // 2)
        lines, left, place = [], iter(turns), 0
        for edit in audit:
            own = {"u": "user", "a": "assistant", "s": "system"}[target[place]] if edit != "D" else None
            if edit == "I":
                lines.append(f"{own}:")
            else:
                _, role, text = next(left)
                if edit == "D":
                    continue
                lines.append(f"{own if edit == 'R' else role}:{text}")
            place += 1
        out.append((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def some_rows(seed):
    r = random.Random(seed)
    rows = []
    for conv in list(range(60)) + [None]:
        for turn in range(r.randint(1, 9)):
            role = r.choice(["user", "assistant"]) if r.random() < 0.2 else ("user", "assistant")[turn % 2]
            if turn == 0 and r.random() < 0.3:
                role = "system"
            text = r.choice(["Yes.", "No!", "Why?", "cut off", "  \n", "Ünï. \t", "a\nb."]) + (str(turn) + "." if r.random() < 0.7 else "")
            rows.append((conv, turn, role, text))
    rows += [(900, None, "user", "x."), (900, None, "user", "x."), (900, 3, "assistant", None), (901, 1, None, "y."), (901, 2, "", "z"), (902, 5, "tool", "t.")]
    rows += [(903, t, "assistant" if t % 2 else "user", "word " * 30000 + ".") for t in range(2)] + rows[:3]
    return rows + [(1000 + n, 0, "user", "only.") for n in range(25)]


@pytest.mark.parametrize("seed", [1, 2])
def test_report(spark, seed):
    rows = some_rows(seed)
    docs = spark.createDataFrame([(*r, True, "m", "KD") for r in rows], SCHEMA)
    got = conversations.repair_report(docs)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_report(rows)
    assert any(r[7] == "" for r in plain_report(rows))


def test_repaired_turns(spark):
    docs = spark.createDataFrame([(1, 0, "user", "Hi.", True, "", ""), (1, 1, "user", "Hi.", True, "", ""), (1, 2, "tool", "Done.", True, "", ""), (1, 3, "user", "More?", True, "", "")], SCHEMA)
    got = [tuple(r) for r in conversations.repair(docs).orderBy("place").collect()]
    assert got == [(1, 0, "K", "user", "Hi."), (1, 1, "R", "assistant", "Done."), (1, 2, "K", "user", "More?"), (1, 3, "I", "assistant", "")]
    nothing = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(nothing).count() == 0 and conversations.repair_report(nothing).count() == 0

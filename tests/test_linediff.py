"""The line diff against a plain table of longest common subsequences, and its time on texts that are hard."""

import random
import time

import pytest

from ripplemark.functions import linediff


def plain_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def check(a, b):
    stay, come = linediff.kept(a, b)
    assert [x for x, s in zip(a, stay) if s] == [y for y, s in zip(b, come) if s]
    return sum(stay)


@pytest.mark.parametrize("frequent", [64, 0])
def test_small_texts(monkeypatch, frequent):
    monkeypatch.setattr(linediff, "FREQUENT", frequent)
    r = random.Random(1)
    for _ in range(600):
        a, b = ([r.choice("abcde"[: r.randint(1, 5)]) for _ in range(r.randint(0, 14))] for _ in range(2))
        assert check(a, b) == plain_length(a, b)


def test_cut_texts(monkeypatch):
    """Texts beyond the table's bound keep an order, and lines that occur once are found again."""
    monkeypatch.setattr(linediff, "TABLE", 12)
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.choice("abcdefghij") for _ in range(r.randint(0, 20))] for _ in range(2))
        assert check(a, b) <= plain_length(a, b)
    a = list(range(60))
    assert check(a, [*a[:20], "x", *a[25:]]) == 55


@pytest.mark.parametrize(
    "old, new",
    [
        ([x for i in range(50_000) for x in (f"old {i}", "")], [x for i in range(50_000) for x in (f"new {i}", "")]),
        ([f"{i % 7}" for i in range(30_000)], [f"{i % 5}" for i in range(30_000)]),
        ([str(i) for i in range(30_000)], [str(i) for i in random.Random(3).sample(range(30_000), 30_000)]),
    ],
)
def test_hard_texts_are_done_in_seconds(old, new):
    begun = time.perf_counter()
    check(old, new)
    assert time.perf_counter() - begun < 5

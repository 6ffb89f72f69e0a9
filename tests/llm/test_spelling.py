"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from ripplemark.llm import spelling

DOCS = "doc_id long, text string, word string, path long, n long"


def one_apart(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


def plain_variants(counts):
    near = {w: [o for o in counts if one_apart(w, o)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def plain_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def random_counts(seed):
    r = random.Random(seed)
    counts = {}
    for _ in range(40):
        word = "".join(r.choice("eaionté×Àgpk") for _ in range(r.randint(7, 12)))
        counts[word] = r.choice([2, 30, 30, 500, 4000])
        for _ in range(12):
            at, kind, letter = r.randrange(len(word)), r.randrange(3), r.choice("eaiontzé")
            other = word[:at] + (letter if kind < 2 else "") + word[at + (kind > 0) :]
            if len(other) >= 7:
                counts[other] = r.choice([2, 3, 40, 300])
            if r.random() < 0.3 and len(other) >= 7:
                word = other
    # Long runs, whose counts wrap around, and words of equal counts.
    counts |= {"e" * n: n for n in (14, 15, 16, 17, 31, 32, 33)} | {"ea" * 500: 3, "ea" * 500 + "k": 90, "aeaeaeaeae": 3}
    return counts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_variants_of_words(spark, seed):
    counts = random_counts(seed)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(map(tuple, spelling.variants(words).collect())) == plain_variants(counts)


def test_report(spark):
    r = random.Random(8)
    base = ["".join(r.choice("eaiontrsulhdcmgpéÉ") for _ in range(r.randint(5, 11))) for _ in range(60)]
    rows = []
    for doc in range(150):
        words = [r.choice(base[: r.choice([3, 60])]) for _ in range(r.randint(0, 60))]
        text = r.choice([" ", "\n", "-", "1"]).join(w.title() if r.random() < 0.2 else w for w in words)
        rows.append((doc, text))
    rows += [(None, "Ananansh ananansh " * 5), (900, None), (901, ""), (902, "12 -- 3"), rows[3], rows[3], (903, "longword " * 30000), (904, "x" * 100000)]
    counts = plain_words(rows)
    docs = spark.createDataFrame([(*row, "w", 1, 2) for row in rows], DOCS)
    got = spelling.variants_report(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == plain_variants(counts)
    assert any(form for _, form, *_ in plain_variants(counts))
    assert spelling.spelling_variants(spark.createDataFrame([], DOCS)).count() == 0

"""Syncmer fingerprints against a plain version."""

import hashlib
import random
import re
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from ripplemark.llm import fingerprints

DOCS = "doc_id long, text string, id string, h long, body string, size string"
WORD = regex.compile(re.sub(r"\\x\{(\w+)\}", lambda m: rf"\U{m[1]:0>8}", fingerprints.WORDS), regex.ASCII)


@pytest.fixture(scope="module")
def hashes(spark):
    """XXH64 of Spark, seed 42, of strings and of sequences of numbers."""

    def of_words(words):
        words = sorted(set(words))
        return {r.w: r.x for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("x")).collect()}

    def of_rows(rows, n):
        schema = ", ".join(f"c{i} long" for i in range(n))
        got = spark.createDataFrame(sorted(set(rows)), schema).select("*", F.xxhash64(*[f"c{i}" for i in range(n)]).alias("x")).collect()
        return {tuple(r)[:-1]: r.x for r in got}

    return of_words, of_rows


def plain_anchors(texts, hashes):
    """Every k-mer looked at by itself."""
    of_words, of_rows = hashes
    words = {t: WORD.findall(t) for t in texts}
    known = of_words([w for ws in words.values() for w in ws])
    padded = {t: [0] * 3 + [known[w] for w in ws] + [0] * 3 if ws else [] for t, ws in words.items()}
    inner = of_rows([tuple(p[i : i + 2]) for p in padded.values() for i in range(len(p) - 1)], 2)
    whole = of_rows([tuple(p[i : i + 5]) for p in padded.values() for i in range(len(p) - 4)], 5)
    out = {}
    for t, p in padded.items():
        out[t] = []
        for i in range(len(p) - 4):
            parts = [inner[tuple(p[j : j + 2])] for j in range(i, i + 4)]
            if min(parts) in (parts[0], parts[-1]):
                out[t].append((i - 3, whole[tuple(p[i : i + 5])] & 0xFFFFFF))
    return out


def dice(a, b):
    a, b = Counter(h for _, h in a), Counter(h for _, h in b)
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 1.0


def some_rows():
    r = random.Random(2)
    words = ["the", "of", "Über", "señal", "x1", "данные", "語", "漢字", "a\u00a0b", "ไทย", "𠀋", "-", "a.b", "𝒳𝒴", "naïve", "?"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 2, 5, 30, 200])))) for i in range(40)]
    rows += [(500, None), (501, ""), (502, " \n "), (503, "one"), (504, "ab"), (505, "same " * 900), (507, "w " * 30000 + "end"), (-4, rows[3][1])]
    return rows + [(600, "repeated row of words"), (600, "repeated row of words"), (600, "repeated row of words"), (600, "other text of that id"), (None, "no id here"), (None, "nor here at all")]


def test_report(spark, hashes):
    rows = some_rows()
    texts = [t or "" for _, t in rows]
    known = {t: h for t, h in zip(texts, [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()])}
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), known[x[1]]))
    edited = []
    for (_, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        cut = len(t) // 3
        edited.append(t[: len(t) - cut] + after[:cut])
    anchors = plain_anchors(set(texts) | set(edited), hashes)
    want = []
    for n, ((i, t), e) in enumerate(zip(ordered, edited)):
        after = ordered[(n + 1) % len(ordered)][1]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), len(anchors[t]), len(anchors[e]), dice(anchors[t], anchors[e]), dice(anchors[t], anchors[after])))
    docs = spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], DOCS).repartition(3)
    report = fingerprints.edit_report(docs)
    assert report.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = [(r[0], r[1], r[2], len(r[3]) // 4, len(r[4]) // 4, r[5], r[6]) for r in report.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_anchors(spark, hashes):
    rows = some_rows()
    anchors = plain_anchors({t or "" for _, t in rows}, hashes)
    got = fingerprints.fingerprints(spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], DOCS)).collect()
    assert sorted((str(r.doc_id), [tuple(a) for a in r.anchors]) for r in got) == sorted((str(i), anchors[t or ""]) for i, t in rows)
    assert all(len(r.fingerprint) == 4 * len(r.anchors) for r in got)


def test_no_and_one_document(spark):
    assert fingerprints.edit_report(spark.createDataFrame([], DOCS)).count() == 0
    one = fingerprints.edit_report(spark.createDataFrame([(3, "a lonely text", "", 0, "", "")], DOCS)).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(3, 1.0)]


def test_edits_are_local(spark):
    """A changed word takes the anchors around it, no others."""
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words), " ".join(["new", *words[:150], "changed", *words[151:]])]
    got = fingerprints.fingerprints(spark.createDataFrame([(i, t, "", 0, "", "") for i, t in enumerate(texts)], DOCS)).orderBy("doc_id").collect()
    one, two = ({a.code: a.place for a in r.anchors} for r in got)
    shared = one.keys() & two.keys()
    assert len(shared) >= len(one) - 10 and {two[h] - one[h] for h in shared} == {1}

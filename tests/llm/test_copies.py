"""Exact and near duplicates and boilerplate lines against plain versions."""

import hashlib
import random
from pathlib import Path
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ripplemark.llm import exact_dedup, line_dedup, shingles, simhash
from ripplemark.llm.common import connected
from ripplemark.session import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, fp string, row string"


def docs_of(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    full = [(i, t, "en", s, len(t) if t else None, 7, "x", "y") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


def sample_rows(seed=3, n=120):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        text = "\n".join(" ".join(r.choice(words) for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 4)))
        if r.random() < 0.3 and rows:
            text = r.choice(rows)[1]
        rows.append((i, text, r.choice(["a", "b", "b", None])))
    rows += [(900, None, "a"), (901, "", "a"), (None, "w1 w2", "b"), (902, "w1 w2", "b"), (903, " \t ", None), (904, "word " * 40000, "a")]
    return rows + [rows[3], rows[3]]


def test_exact_groups(spark):
    rows = sample_rows()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    want = []
    for i, t, _ in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        want.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_dedup(docs_of(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_exact_groups_of_nothing(spark):
    assert exact_dedup.exact_dedup(docs_of(spark, [])).count() == 0
    # Equal length and prefix, different ends.
    rows = [(1, "a" * 200 + "x", "s"), (2, "a" * 200 + "y", "s"), (3, "b" * 201, "s")]
    assert [r.group_size for r in exact_dedup.exact_dedup(docs_of(spark, rows)).collect()] == [1, 1, 1]


def plain_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "a b c", "a b c d", "É Ab\tcd\x0bef gh ij k", "x y z w " * 500])
def test_fingerprint(text):
    got = simhash.fingerprint((text or "").encode())
    assert got % 2**64 == plain_fingerprint(text)


def plain_components(fps):
    """Label propagation over all pairs."""
    label = {f: f for f in fps}
    moved = True
    while moved:
        moved = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 4 and label[b] < label[a]:
                    label[a], moved = label[b], True
    return label


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def test_links_of_fingerprints(spark, monkeypatch):
    """Random points with neighbours at each distance; crowded cells are forced."""
    monkeypatch.setattr(simhash, "CROWDED", 3)
    r = random.Random(5)
    fps = set()
    for _ in range(60):
        f = r.getrandbits(64)
        fps.add(f)
        for d in (1, 3, 4, 5, 6):
            g = f
            for b in r.sample(range(64), d):
                g ^= 1 << b
            fps.add(g)
    hub = r.getrandbits(64)
    fps |= {hub ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)} | {0, 1, 2**64 - 1}
    want = plain_components(sorted(fps))
    groups = defaultdict(set)
    for f, root in want.items():
        groups[root].add(signed(f))
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = defaultdict(set)
    for node, root in simhash.linked(nodes).collect():
        found[root].add(node)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))


def test_lower_bound():
    """The Manhattan distance of the bit counts is never above the Hamming distance."""
    low, r = simhash.LOW_BITS, random.Random(9)
    code = lambda x: ((x & x >> 1 & low) << 1) | ((x | x >> 1) & low)
    for _ in range(500):
        a, b = r.getrandbits(64), r.getrandbits(64)
        counts = [[(x >> 2 * s & 3).bit_count() for s in range(32)] for x in (a, b)]
        manhattan = sum(abs(p - q) for p, q in zip(*counts))
        assert manhattan == (code(a) ^ code(b)).bit_count() <= (a ^ b).bit_count()


def test_near_duplicates(spark):
    rows = sample_rows()
    base = " ".join(f"t{i}" for i in range(400))
    rows += [(2000 + k, base.replace(f"t{17 * k} ", "new "), "a") for k in range(8)]
    fps = [(i, plain_fingerprint(t)) for i, t, _ in rows]
    label = plain_components(sorted({f for _, f in fps}))
    least = defaultdict(list)
    for i, f in fps:
        least[label[f]].append(i)
    want = sorted([(i, f"{f:016x}", min([x for x in least[label[f]] if x is not None])) for i, f in fps], key=str)
    docs = docs_of(spark, rows)
    got = [tuple(r) for r in simhash.with_hex(simhash.near_duplicates(docs)).collect()]
    assert sorted(got, key=str) == want
    # One document of each component stays, with all its columns.
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted({c for _, _, c in want})
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    assert simhash.one_of_each(docs_of(spark, [])).count() == 0


def test_rows_without_ids(spark):
    docs = docs_of(spark, [(None, "a b c d e", "s"), (None, "a b c d e", "s"), (None, "other words of another text", "s"), (5, None, "s"), (4, "", "s")])
    assert sorted((r.doc_id, r.text) for r in simhash.one_of_each(docs).collect() if r.doc_id) == [(4, "")]
    assert simhash.one_of_each(docs).count() == 3


def test_connected(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = dict(map(tuple, connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for x in linked}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_lines(rows, ratio, support):
    key = lambda x: x.strip(" \t\r")
    pages, total = Counter(), Counter()
    for _, t, s in rows:
        total[s] += 1
        pages.update({(s, key(x)) for x in (t or "").split("\n") if key(x)})
    drop = {k for k, n in pages.items() if n >= support and n > total[k[0]] * ratio}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (s, key(x)) not in drop) for _, t, s in rows]


def test_boilerplate(spark):
    rows = [(i, f"own line {i}\nMenu\n  Menu \t\n\nshared {i % 3}\r", "a") for i in range(40)]
    rows += [(100 + i, "Menu\nbody", None) for i in range(2)] + [(200, None, "a"), (201, "", None), (202, "\n\n", "b"), (203, "Menu", "b")]
    rows += [(300, "x", None)] * 4
    docs = docs_of(spark, rows)
    done = line_dedup.drop_boilerplate(docs, ratio=0.2, support=3)
    assert done.columns == docs.columns
    want = sorted(zip([r[0] for r in rows], plain_lines(rows, 0.2, 3)), key=str)
    assert sorted([(r.doc_id, r.text) for r in done.collect()], key=str) == want
    report = {r.doc_id: r for r in line_dedup.line_report(docs, ratio=0.2, support=3).where("doc_id < 40").collect()}
    assert report[1].n_lines == 5 and report[1].text == "own line 1\n"
    assert line_dedup.line_report(docs_of(spark, [])).count() == 0


def test_ties_at_the_ratio_stay(spark):
    """The ratio must be exceeded, not reached."""
    rows = [(i, "seldom" if i < 4 else f"line {i}", "a") for i in range(20)]
    kept = line_dedup.drop_boilerplate(docs_of(spark, rows), ratio=0.2, support=3).where(F.col("text") == "seldom")
    assert kept.count() == 4


def plain_near_copies(rows, words=5, similarity=0.8):
    """Ids that stay, by brute-force Jaccard over all pairs."""
    sets = []
    for _, t, _ in rows:
        parts = (t or "").lower().split()
        n = min(words, len(parts))
        sets.append({tuple(parts[i : i + n]) for i in range(len(parts) - n + 1)} if parts else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or a and b and len(a & b) / len(a | b) >= similarity:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (doc, _, _) in enumerate(rows):
        groups[find(i)].append(doc)
    return sorted(map(min, groups.values()))


@pytest.mark.parametrize("crowded,often", [(64, 20), (3, 2)])
def test_pipeline_near_copies(spark, monkeypatch, crowded, often):
    """Copies with few to many changed words, around the limit of 0.8; small limits force representatives and an order."""
    monkeypatch.setattr(shingles, "CROWDED", crowded)
    monkeypatch.setattr(shingles, "OFTEN", often)
    r = random.Random(21)
    rows, notice = [], " ".join(f"notice{i}" for i in range(12))
    for family in range(14):
        base = [f"f{family}w{r.randrange(900)}" for _ in range(r.choice([4, 9, 40, 120, 300]))]
        for changed in (0, 0, 1, 2, 3, 4, 5, 7, 9):
            text = list(base)
            for at in r.sample(range(len(text)), min(len(text), changed)):
                text[at] = f"new{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(text) + (" " + notice if family % 3 == 0 else ""), "a"))
    rows += [(900, None, "a"), (901, "", "a"), (902, " \n", "a"), (903, "One", "a"), (904, "one ", "a"), (905, "a b c d e f g h i", "a"), (906, "a b c d e f g h", "a")]
    r.shuffle(rows)
    docs = docs_of(spark, rows)
    kept = corpus_pipeline.one_of_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == plain_near_copies(rows)
    assert corpus_pipeline.one_of_near_copies(spark, docs_of(spark, []), "").count() == 0


def test_pipeline_copies_are_one_page(spark):
    """A third of a host's pages are copies, and they keep their lines; lines of different pages go."""
    rows = [(i, f"Menu\nown line {i}", "a") for i in range(20)] + [(100 + i, "Menu\nof the copies\nand more", "a") for i in range(10)]
    rows += [(200 + i, "small host", "b") for i in range(3)] + [(300 + i, "no host", None) for i in range(4)] + [(400, None, "a"), (401, "", "a")]
    done = {x.doc_id: x.text for x in corpus_pipeline.without_boilerplate(spark, docs_of(spark, rows), "").collect()}
    assert done == {i: None if t is None else t.removeprefix("Menu\n") for i, t, _ in rows}


def joined_rows(spark, texts, monkeypatch):
    """Rows of all pairs that near_copies looks at, counted where they are verified, and its result."""
    seen = []
    both_ends = shingles.both_ends
    monkeypatch.setattr(shingles, "both_ends", lambda pairs, sets: (seen.append(pairs.count()), both_ends(pairs, sets))[1])
    docs = docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)])
    kept = sorted(r.doc_id for r in shingles.one_of_each(docs).collect())
    return sum(seen), kept


def test_near_copies_come_by_simhash_and_its_tables_go(spark, monkeypatch):
    """Links of the grid, verified; only similar ones, and with the exact rest all; tables on the way are deleted."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base), " ".join([*base[:149], "new"]), " ".join(base[::-1]), " ".join([*base[:75], "x", "y", *base[77:]])]
    texts += [" ".join(f"v{r.randrange(10**6)}" for _ in range(40)) for _ in range(30)]
    found, exact = [], shingles.exact_rest
    monkeypatch.setattr(shingles, "exact_rest", lambda rows, bodies, alike, *a: (found.extend(map(tuple, alike.collect())), exact(rows, bodies, alike, *a))[1])
    kept = sorted(x.doc_id for x in corpus_pipeline.one_of_near_copies(spark, docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)]), "").collect())
    assert kept == plain_near_copies([(i, t, "a") for i, t in enumerate(texts)]) == [0, 2, *range(4, 34)]
    nodes = [shingles.node_of(shingles.shingle_set(t.encode())) for t in texts]
    prints = [simhash.set_fingerprint(shingles.shingle_set(t.encode()), simhash.byte_bits()) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 4 and {nodes[0], nodes[1]} in [set(pair) for pair in found]
    folder = Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    assert not list(folder.glob("passing-*"))


def test_candidates_of_a_large_group(spark, monkeypatch):
    """Copies of one text with one word changed: as many comparisons for each, however many they are."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rates = []
    for n in (400, 1600):
        texts = []
        for _ in range(n):
            text = list(base)
            text[r.randrange(60)] = f"new{r.randrange(10**9)}"
            texts.append(" ".join(text))
        looked, kept = joined_rows(spark, texts, monkeypatch)
        monkeypatch.undo()
        rates.append(looked / n)
        if n == 400:
            assert kept == plain_near_copies([(i, t, "a") for i, t in enumerate(texts)])
    assert rates[1] <= 1.3 * rates[0] + 0.5


def test_pages_of_one_template(spark, monkeypatch):
    """Pages that share most of their words but are no near copies are hardly ever compared."""
    r = random.Random(4)
    template = [f"t{i}" for i in range(200)]
    texts = [" ".join([*template[:100], *(f"own{r.randrange(10**9)}" for _ in range(32)), *template[100:]]) for _ in range(600)]
    looked, kept = joined_rows(spark, texts, monkeypatch)
    assert kept == list(range(600)) and looked <= 3 * 600


def test_sketches_lose_no_similar_pair():
    """Sketches of any two lengths differ at no more places than the sets have shingles apart."""
    r = random.Random(12)
    for n in (0, 1, 5, 255, 256, 257, 1020, 1030, 3000):
        full = np.unique(np.array([r.getrandbits(64) - (1 << 63) for _ in range(n)], dtype=np.int64))
        some = full[[r.random() < 0.9 for _ in full]] if n else full
        own, other = shingles.sketch(full), shingles.sketch(some)
        for length in (4, min(len(own), len(other))):
            p, q = (shingles.folded(x, length).tobytes() for x in (own, other))
            assert sum((a ^ b).bit_count() for a, b in zip(p, q)) <= len(full) - len(some)


def test_pages_with_a_common_passage_do_not_meet(spark, monkeypatch):
    """Pairs that share a rare passage and no more are dropped in the join, before they are shuffled; long texts right after."""
    r = random.Random(13)
    passage = [f"p{i}" for i in range(12)]
    own = lambda n: " ".join([*passage, *(f"own{r.randrange(10**9)}" for _ in range(n))])
    texts = [own(200) for _ in range(30)] + [own(1500) for _ in range(8)]
    texts += [f"{texts[0]} end", f"{texts[33]} end"]
    counts, written = {}, shingles.stage
    monkeypatch.setattr(shingles, "stage", lambda df, label: (df := written(df, label), counts.update({label: df.count()}))[0])
    monkeypatch.setattr(shingles, "simhash_links", lambda rows, *a: rows.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    docs = docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)])
    assert sorted(x.doc_id for x in shingles.one_of_each(docs).collect()) == list(range(38))
    assert 2 <= counts["meeting"] <= 2 + 9 * 8 / 2 and counts["candidates"] == 2

"""Lines that two texts keep in order, by bit-parallel longest common subsequences.

Runs within one task on one pair of texts. A row of the table of all pairs of
lines is one number with a bit per line, so a row costs a few operations on
long numbers; a table is never kept, its middle row tells where to cut it in
two. Time is bounded by lines x lines / 64 words, and by ``TABLE`` for texts
beyond that: these are first cut at lines that occur once on either side, then
into parts of bounded size.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np

#: Pairs of lines at most that are looked at in one table.
TABLE = 10**10
#: Positions beyond which a line's bits are kept.
FREQUENT = 64


def kept(before: list, after: list) -> tuple[bytearray, bytearray]:
    """Flags of the lines of either side that stay, as many as can; beyond ``TABLE`` pairs maybe fewer."""
    flags = bytearray(len(before)), bytearray(len(after))
    shared = set(before) & set(after)
    # A line of one side only matches nothing.
    a = [(i, x) for i, x in enumerate(before) if x in shared]
    b = [(j, x) for j, x in enumerate(after) if x in shared]
    codes = {x: n for n, x in enumerate(dict.fromkeys(x for _, x in a))}
    one, two = [codes[x] for _, x in a], [codes[x] for _, x in b]
    for i, j in _matches(one, two):
        flags[0][a[i][0]] = flags[1][b[j][0]] = 1
    return flags


def _matches(one: list[int], two: list[int]):
    todo = [(0, len(one), 0, len(two))]
    while todo:
        a, a_end, b, b_end = todo.pop()
        while a < a_end and b < b_end and one[a] == two[b]:
            yield a, b
            a, b = a + 1, b + 1
        while a < a_end and b < b_end and one[a_end - 1] == two[b_end - 1]:
            a_end, b_end = a_end - 1, b_end - 1
            yield a_end, b_end
        if a == a_end or b == b_end:
            continue
        if (a_end - a) * (b_end - b) > TABLE:
            cuts = _anchors(one, two, a, a_end, b, b_end) or [((a + a_end) // 2, (b + b_end) // 2)]
            yield from ((i, j) for i, j in cuts if one[i] == two[j])
            ends = [(i + (one[i] == two[j]), j + (one[i] == two[j])) for i, j in cuts]
            todo.extend((p, i, q, j) for (p, q), (i, j) in zip([(a, b), *ends], [*cuts, (a_end, b_end)]))
        elif a_end - a == 1:
            if one[a] in two[b:b_end]:
                yield a, two.index(one[a], b, b_end)
        else:
            middle = (a + a_end) // 2
            above = _row(one[a:middle], two[b:b_end])
            below = _row(one[middle:a_end][::-1], two[b:b_end][::-1])[::-1]
            cut = b + int(np.argmax(above + below))
            todo += [(a, middle, b, cut), (middle, a_end, cut, b_end)]


def _row(one: list[int], two: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``one`` and the first 0, 1, … of ``two``."""
    size = len(two)
    places = defaultdict(list)
    for j, x in enumerate(two):
        places[x].append(j)
    bits: dict[int, int] = {}
    full = row = (1 << size) - 1
    for x in one:
        at = places.get(x)
        if at is None:
            continue
        if (mask := bits.get(x)) is None:
            flags = np.zeros(size, dtype=np.uint8)
            flags[at] = 1
            mask = 1 << at[0] if len(at) == 1 else int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
            if len(at) > FREQUENT:
                bits[x] = mask
        met = row & mask
        row = ((row + met) | (row - met)) & full
    left = np.unpackbits(np.frombuffer(row.to_bytes((size + 7) // 8, "little"), dtype=np.uint8), bitorder="little")[:size]
    return np.concatenate(([0], np.cumsum(left == 0)))


def _anchors(one: list[int], two: list[int], a: int, a_end: int, b: int, b_end: int) -> list[tuple[int, int]]:
    """Lines that occur once on either side, as many as are in one order."""
    counts, others = Counter(one[a:a_end]), Counter(two[b:b_end])
    place = {x: j for j, x in enumerate(two[b:b_end], b) if others[x] == 1}
    pairs = [(i, place[one[i]]) for i in range(a, a_end) if counts[one[i]] == 1 and one[i] in place]
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before.append(ends[at - 1] if at else -1)
        tails[at : at + 1] = [j]
        ends[at : at + 1] = [n]
    chain, n = [], ends[-1] if ends else -1
    while n >= 0:
        chain.append(pairs[n])
        n = before[n]
    return chain[::-1]

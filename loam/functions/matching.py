"""Matching runs of two sequences: the longest common one, and the same again before and after it."""

from __future__ import annotations

import numpy as np

#: Diagonals looked at together, so that a slab of them stays in the processor's cache.
SLAB = 128
#: A run is long from here on.
LONG = 4
#: Pieces of so many characters are looked up to find long runs of texts, unless this gives more than so many pairs a character.
PIECE, PAIRS = 5, 64


def common_runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offset, start, end) of every longest run along a diagonal: a[i] == b[i + offset] for i from start to before end.

    For small alphabets: all diagonals are looked at. a and b hold codes from 1 on.
    """
    n, m = len(a), len(b)
    padded = np.zeros(2 * n + m, a.dtype)
    padded[n : n + m] = b
    diagonals = np.lib.stride_tricks.sliding_window_view(padded, n)
    equal = np.zeros((SLAB, n + 1), bool)  # a row is a diagonal, ended by a column of no match
    flat, found = equal.ravel(), []
    for at in range(0, n + m, SLAB):
        rows = min(SLAB, n + m - at)
        np.equal(diagonals[at : at + rows], a, out=equal[:rows, :n])
        used = flat[: rows * (n + 1)]
        turns = np.flatnonzero(used[1:] != used[:-1]) + 1
        turns = np.concatenate([[0], turns]) if used[0] else turns
        found.append(turns + at * (n + 1))
    turns = np.concatenate(found)
    first, end = turns[::2], turns[1::2]
    start = first % (n + 1)
    return first // (n + 1) - n, start, start + end - first


def common_runs_by_value(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for sequences whose values seldom repeat, such as lines: only equal pairs are looked at."""
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    often = high - low
    i = np.repeat(np.arange(len(a)), often)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(often) - often, often) + np.repeat(low, often)]
    place = np.sort((j - i + len(a)) * (len(a) + 1) + i)
    if not len(place):
        return place, place, place
    begins = np.flatnonzero(np.diff(place, prepend=place[0] - 2) != 1)
    size = np.diff(np.append(begins, len(place)))
    start = place[begins] % (len(a) + 1)
    return place[begins] // (len(a) + 1) - len(a), start, start + size


def matching_blocks(n: int, m: int, runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[tuple[int, int, int]]:
    """(i, j, size) in order: the longest run inside the two sequences (of equal ones the first in a, then in b), and the
    blocks before and after it. ``runs`` are by ascending offset.

    Short runs are many, and don't count where a long one is left: they are looked up, by their diagonals, only in the small
    stretches that have none.
    """
    every, kept = runs, runs[2] - runs[1] >= LONG
    found, todo = [], [(0, n, 0, m, *(r[kept] for r in runs), True)]
    while todo:
        a0, a1, b0, b1, offset, start, end, long_only = todo.pop()
        low, high = np.maximum(np.maximum(start, a0), b0 - offset), np.minimum(np.minimum(end, a1), b1 - offset)
        size = high - low
        top = int(size.max()) if len(size) else 0
        if long_only and top < LONG:
            part = slice(*np.searchsorted(every[0], (b0 - a1 + 1, b1 - a0)))
            todo.append((a0, a1, b0, b1, *(r[part] for r in every), False))
            continue
        if top < 1:
            continue
        best = np.flatnonzero(size == top)
        best = best[np.lexsort((offset[best], low[best]))[0]]
        i = int(low[best])
        j = i + int(offset[best])
        found.append((i, j, top))
        inside = size > 0
        offset, start, end = offset[inside], start[inside], end[inside]
        if i > a0 and j > b0:
            todo.append((a0, i, b0, j, offset, start, end, long_only))
        if i + top < a1 and j + top < b1:
            todo.append((i + top, a1, j + top, b1, offset, start, end, long_only))
    return sorted(found)


def long_runs(a: np.ndarray, b: np.ndarray, values: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``common_runs``, those of at least ``PIECE`` codes alone; there are codes below ``values``. Only equal pieces are looked at,
    all diagonals where a piece is so common, or there are so many values, that these are no fewer."""
    if min(len(a), len(b)) >= PIECE and values**PIECE < 2**63:
        power = np.array([values**i for i in range(PIECE)], np.int64)
        left, right = (np.lib.stride_tricks.sliding_window_view(x.astype(np.int64), PIECE) @ power for x in (a, b))
        if pairs_of(left, right) <= PAIRS * (len(a) + len(b)):
            offset, start, end = common_runs_by_value(left, right)
            # offsets are those of the pieces; the last piece of a run ends later
            return offset, start, end + PIECE - 1
    offset, start, end = common_runs(a, b)
    kept = end - start >= PIECE
    return offset[kept], start[kept], end[kept]


def pairs_of(a: np.ndarray, b: np.ndarray) -> int:
    """How many pairs of equal values there are."""
    ordered = np.sort(b)
    return int((np.searchsorted(ordered, a, "right") - np.searchsorted(ordered, a, "left")).sum())


def _short_characters(a: str, b: str, stretches: list[tuple[int, int, int, int]]) -> int:
    """Characters in matching blocks of stretches (a0, a1, b0, b1) without a common run of ``PIECE`` characters.

    Of equal runs the first in a counts, so before it there is none as long: runs of one length are found by going through a once, and
    what lies between them is left for shorter ones.
    """
    total = 0
    for size in range(PIECE - 1, 0, -1):
        left = []
        for a0, a1, b0, b1 in stretches:
            i = a0
            while i + size <= a1 and b0 + size <= b1:
                j = b.find(a[i : i + size], b0, b1)
                if j < 0:
                    i += 1
                    continue
                total += size
                if i > a0 and j > b0:
                    left.append((a0, i, b0, j))
                a0 = i = i + size
                b0 = j + size
            if a1 > a0 and b1 > b0:
                left.append((a0, a1, b0, b1))
        stretches = left
    return total


def matching_characters(a: str, b: str) -> int:
    """Characters of two texts that stand in matching blocks: of long runs by their list, in the stretches between them by looking
    up short ones in the text."""
    if not a or not b:
        return 0
    known, code = np.unique(np.frombuffer((a + b).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    code = (code + 1).astype(np.uint8 if len(known) < 255 else np.uint32)
    total, stretches, todo = 0, [], [(0, len(a), 0, len(b), *long_runs(code[: len(a)], code[len(a) :], len(known) + 1))]
    while todo:
        a0, a1, b0, b1, offset, start, end = todo.pop()
        low, high = np.maximum(np.maximum(start, a0), b0 - offset), np.minimum(np.minimum(end, a1), b1 - offset)
        size = high - low
        top = int(size.max()) if len(size) else 0
        if top < PIECE:
            stretches.append((a0, a1, b0, b1))
            continue
        best = np.flatnonzero(size == top)
        best = best[np.lexsort((offset[best], low[best]))[0]]
        i = int(low[best])
        j = i + int(offset[best])
        total += top
        inside = size >= PIECE
        offset, start, end = offset[inside], start[inside], end[inside]
        if i > a0 and j > b0:
            todo.append((a0, i, b0, j, offset, start, end))
        if i + top < a1 and j + top < b1:
            todo.append((i + top, a1, j + top, b1, offset, start, end))
    return total + _short_characters(a, b, stretches)


def changed_lines(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """(i0, i1, j0, j1): lines a[i0:i1] that b[j0:j1] stands for, between the matching blocks."""
    numbers: dict[str, int] = {}
    left, right = (np.array([numbers.setdefault(x, len(numbers)) for x in lines], np.int64) for lines in (a, b))
    out, i0, j0 = [], 0, 0
    for i, j, size in [*matching_blocks(len(a), len(b), common_runs_by_value(left, right)), (len(a), len(b), 0)]:
        if i > i0 or j > j0:
            out.append((i0, i, j0, j))
        i0, j0 = i + size, j + size
    return out

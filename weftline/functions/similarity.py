"""String scorers. Plain functions for use inside Arrow UDFs, and UDFs over columns.

Ratios run from 0 to 100. Two empty strings are equal (ratio 100, Jaro-Winkler 1); an empty string against another scores 0. Nulls give null.
Longest common subsequences are bit-parallel on Python integers (Hyyrö 2004), so a pair costs one integer step per character.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for ch in b:
        met = rows & at.get(ch, 0)
        rows = ((rows + met) | (rows - met)) & full
    return len(a) - rows.bit_count()


def ratio(a: str, b: str) -> float:
    both = len(a) + len(b)
    return 200.0 * lcs(a, b) / both if both else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best of the common words against common and own words of either side, and of those two sides."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, own_x, own_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if common and (not own_x or not own_y):
        return 100.0
    full_x, full_y = " ".join(filter(None, (common, own_x))), " ".join(filter(None, (common, own_y)))
    best = ratio(full_x, full_y)
    return max(best, ratio(common, full_x), ratio(common, full_y)) if common else best


def partial_ratio(a: str, b: str) -> float:
    """The shorter string against its best window in the longer one, windows over the ends included."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    starts = range(1 - n, len(long))
    return max(ratio(short, long[max(0, i) : i + n]) for i in starts)


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    mine: list[str] = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                mine.append(ch)
                break
    if not mine:
        return 0.0
    theirs = [ch for ch, u in zip(b, used) if u]
    swapped = sum(x != y for x, y in zip(mine, theirs)) // 2
    m = len(mine)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str, b: str, weight: float = 0.1, boost_from: float = 0.7) -> float:
    """Jaro, raised by up to four equal leading characters where it exceeds ``boost_from``."""
    j = jaro(a, b)
    if j <= boost_from:
        return j
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return j + same * weight * (1 - j)


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, changes and swaps of neighbours between two strings; ``most + 1`` where more are needed."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, above = above, row
    return min(above[-1], most + 1)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length, with built-ins only; 1 for two empty strings."""
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def scorer(f: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    """An Arrow UDF over two string columns."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype="float64")

    return score


SCORES: dict[str, Callable[[str, str], float]] = {
    "ratio": ratio,
    "token_sort": token_sort_ratio,
    "token_set": token_set_ratio,
    "partial": partial_ratio,
    "jaro_winkler": jaro_winkler,
}


BITS = 64
_BELOW = np.array([(1 << i) - 1 for i in range(BITS + 1)], dtype=np.uint64)
_ONE = np.uint64(1)


class _Letters:
    """Strings as columns of letter numbers, one string a column; 0 stands behind the end."""

    def __init__(self, *sides: list[str]):
        every = [s for side in sides for s in side]
        points = np.frombuffer("".join(every).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        known, number = np.unique(points, return_inverse=True)
        self.size = len(known) + 1
        lengths = np.array([len(s) for s in every], dtype=np.int64)
        at = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        table = np.zeros((int(lengths.max(initial=0)) + 1, len(every)), dtype=np.int64)
        table[at, np.repeat(np.arange(len(every)), lengths)] = number + 1
        ends = np.cumsum([len(s) for s in sides])
        self.text = [table[:, e - len(s) : e] for e, s in zip(ends, sides)]
        self.length = [lengths[e - len(s) : e] for e, s in zip(ends, sides)]

    def masks(self, text: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Of each string and letter the places where it stands, as bits; string by string."""
        n = text.shape[1]
        out = np.zeros(n * self.size, dtype=np.uint64)
        base = np.arange(n) * self.size
        for i in range(int(length.max(initial=0))):
            out[base + text[i]] |= _ONE << np.uint64(i)
        out[base] = 0
        return out


def _reversed(text: np.ndarray, length: np.ndarray) -> np.ndarray:
    place = length[None, :] - 1 - np.arange(text.shape[0])[:, None]
    return np.where(place >= 0, np.take_along_axis(text, np.maximum(place, 0), axis=0), 0)


def _step(rows: np.ndarray, met: np.ndarray) -> np.ndarray:
    met = rows & met
    return (rows + met) | (rows - met)


def _common(rows: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.bitwise_count(~rows & _BELOW[length]).astype(np.int64)


def _by_block(f: Callable, xs: list[str], ys: list[str], block: int = 2048) -> np.ndarray:
    """f over blocks of pairs of like length, so that few steps run past the ends."""
    out = np.zeros(len(xs))
    order = sorted(range(len(xs)), key=lambda i: (len(ys[i]) - len(xs[i]), len(ys[i])))
    for at in range(0, len(order), block):
        some = order[at : at + block]
        out[some] = f([xs[i] for i in some], [ys[i] for i in some])
    return out


def _lcs_block(xs: list[str], ys: list[str]) -> np.ndarray:
    letters = _Letters(xs, ys)
    (a, b), (la, lb) = letters.text, letters.length
    masks, base = letters.masks(a, la), np.arange(len(xs)) * letters.size
    rows = np.full(len(xs), ~np.uint64(0))
    for j in range(int(lb.max(initial=0))):
        rows = _step(rows, masks[base + b[j]])
    return _common(rows, la)


def _partial_block(xs: list[str], ys: list[str]) -> np.ndarray:
    """Of non-empty xs, none longer than its y."""
    letters = _Letters(xs, ys)
    (a, b), (la, lb) = letters.text, letters.length
    n, base = len(xs), np.arange(len(xs)) * letters.size
    best = np.zeros(n)
    # Windows over the ends are beginnings of the strings or, read backwards, of their mirror images: one run gives them all.
    for p, t in ((a, b), (_reversed(a, la), _reversed(b, lb))):
        masks, rows = letters.masks(p, la), np.full(n, ~np.uint64(0))
        for j in range(int(la.max()) - 1):
            rows = _step(rows, masks[base + t[j]])
            best = np.where(j + 1 < la, np.maximum(best, 200.0 * _common(rows, la) / (la + j + 1)), best)
    masks, room = letters.masks(a, la), lb - la
    for start in range(int(room.max()) + 1):
        mine = np.flatnonzero(room >= start)
        own, length = base[mine], la[mine]
        rows = np.full(len(mine), ~np.uint64(0))
        for j in range(int(length.max())):
            rows = _step(rows, masks[own + np.where(j < length, b[start + j if start + j < len(b) else -1, mine], 0)])
        best[mine] = np.maximum(best[mine], 200.0 * _common(rows, length) / (2 * length))
    return best


def _jaro_block(xs: list[str], ys: list[str]) -> np.ndarray:
    """Of non-empty strings."""
    letters = _Letters(xs, ys)
    (a, b), (la, lb) = letters.text, letters.length
    masks, base = letters.masks(b, lb), np.arange(len(xs)) * letters.size
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    used = np.zeros(len(xs), dtype=np.uint64)
    steps = range(int(la.max()))
    took = []
    for i in steps:
        near = _BELOW[np.clip(i + reach + 1, 0, lb)] & ~_BELOW[np.clip(i - reach, 0, lb)]
        free = masks[base + a[i]] & near & ~used
        first = free & (~free + _ONE)
        used |= first
        took.append(first != 0)
    m = np.bitwise_count(used).astype(np.int64)
    rest, apart = used.copy(), np.zeros(len(xs), dtype=np.int64)
    for i in steps:
        first = np.where(took[i], rest & (~rest + _ONE), np.uint64(0))
        rest ^= first
        apart += took[i] & ((masks[base + a[i]] & first) == 0)
    some = np.maximum(m, 1)
    return np.where(m > 0, (m / la + m / lb + (m - apart // 2) / some) / 3, 0.0)


def _where(f: Callable, slow: Callable, xs: list[str], ys: list[str], fits: Callable[[str, str], bool]) -> np.ndarray:
    """f on the pairs that fit into the bits of a machine word, ``slow`` on the others."""
    near = [i for i, (x, y) in enumerate(zip(xs, ys)) if fits(x, y)]
    out = np.zeros(len(xs))
    out[near] = _by_block(f, [xs[i] for i in near], [ys[i] for i in near])
    for i in set(range(len(xs))).difference(near):
        out[i] = slow(xs[i], ys[i])
    return out


def ratios(xs: list[str], ys: list[str]) -> np.ndarray:
    """:func:`ratio` of each pair."""
    short, long = ([f(x, y, key=len) for x, y in zip(xs, ys)] for f in (min, lambda x, y, key: max(y, x, key=key)))
    both = np.array([len(x) + len(y) for x, y in zip(xs, ys)], dtype=np.int64)
    common = _where(_lcs_block, lcs, short, long, lambda x, y: len(x) <= BITS)
    return np.where(both > 0, 200.0 * common / np.maximum(both, 1), 100.0)


def partial_ratios(xs: list[str], ys: list[str]) -> np.ndarray:
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(xs, ys)]
    return _where(_partial_block, partial_ratio, [p[0] for p in pairs], [p[1] for p in pairs], lambda x, y: 0 < len(x) <= BITS)


def jaro_winklers(xs: list[str], ys: list[str], weight: float = 0.1, boost_from: float = 0.7) -> np.ndarray:
    j = _where(_jaro_block, jaro, xs, ys, lambda x, y: x != y and 0 < len(x) and 0 < len(y) <= BITS)
    same = np.array([len(os.path.commonprefix((x[:4], y[:4]))) for x, y in zip(xs, ys)], dtype=float)
    return np.where(j > boost_from, j + same * weight * (1 - j), j)


def token_set_ratios(xs: list[str], ys: list[str]) -> np.ndarray:
    out = np.zeros(len(xs))
    at: list[int] = []
    asked: list[tuple[str, str]] = []
    for i, (a, b) in enumerate(zip(xs, ys)):
        x, y = set(a.split()), set(b.split())
        if not x or not y:
            continue
        common, own_x, own_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
        if common and (not own_x or not own_y):
            out[i] = 100.0
            continue
        full_x, full_y = " ".join(filter(None, (common, own_x))), " ".join(filter(None, (common, own_y)))
        each = [(full_x, full_y), (common, full_x), (common, full_y)] if common else [(full_x, full_y)]
        at += [i] * len(each)
        asked += each
    if asked:
        np.maximum.at(out, at, ratios([p[0] for p in asked], [p[1] for p in asked]))
    return out


def scores_of(xs: list[str], ys: list[str]) -> np.ndarray:
    """A column for each of SCORES, the same numbers, all pairs at once."""
    sort = lambda side: [" ".join(sorted(s.split())) for s in side]
    return np.column_stack([ratios(xs, ys), ratios(sort(xs), sort(ys)), token_set_ratios(xs, ys), partial_ratios(xs, ys), jaro_winklers(xs, ys)])


def all_scores(a: Column, b: Column) -> Column:
    """A struct of every score; the strings cross to Python once and are scored together."""

    @F.pandas_udf(", ".join(f"{n} double" for n in SCORES))
    def score(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        known = np.flatnonzero(x.notna().to_numpy() & y.notna().to_numpy())
        rows = np.full((len(x), len(SCORES)), np.nan)
        rows[known] = scores_of(x.iloc[known].tolist(), y.iloc[known].tolist())
        return pd.DataFrame(rows, columns=list(SCORES)).astype("Float64" if len(known) < len(x) else "float64")

    return score(a, b)

"""Passages of evaluation items inside corpus documents.

Texts are words (case, accents, punctuation, spacing and look-alikes folded). Every window of ``window`` words of an item, and of a
document, is embedded ``repeats`` times by the CGK random walk: at step j the word under the pointer is written out, and the
pointer moves on if the j-th random function of that word is 1. Windows a few edits apart fall back into step, so edit distance becomes
Hamming distance; ``samples`` places of the walk form the key of a repeat, and equal keys make a candidate pair of windows. Pairs of windows within
``window_edits`` of each other, by their longest common subsequence, stay; near those an alignment of the whole item verifies the passage exactly.

Windows with more than ``window_edits`` words that occur in no item are left out before the walk: no alignment within the edits could hold them.
Which walks the repeats take depends on ``seed`` alone.

A passage counts if a stretch of neighbouring words of the item (``min_words`` of them or more, in steps of ``words_per_edit``, or the whole item) is in the text within one edit (word changed,
dropped or added) per ``words_per_edit`` words. Items of fewer than ``least_words`` words are never found: quotations that short don't count.

Windows are of ``window`` words, not item-sized as in the method's usual form, because a part of an item counts too: a passage of 12 words with two edits holds a window of 8 with two at most, and item-sized windows
would miss it. 
Items are broadcast: they are a held-out set of fixed size, checked against ``max_item_words``. Null and empty texts hold nothing. Repeated rows of
documents give equal rows. Long texts are walked in chunks of windows and aligned only near candidates.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.words import WordFolder

_CHUNK = 200_000


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each row of ``a`` with that of ``b``."""
    w = a.shape[1]
    above = np.zeros((w + 1, len(a)), dtype=np.int8)
    for i in range(w):
        row = np.zeros_like(above)
        for j in range(w):
            row[j + 1] = np.where(a[:, i] == b[:, j], above[j] + 1, np.maximum(above[j + 1], row[j]))
        above = row
    return above[w]


class Walks:
    """The shared randomness: bits per repeat, step and word, and the sampled places."""

    def __init__(self, vocabulary: int, window: int, repeats: int, samples: int, seed: int):
        rng = np.random.default_rng(seed)
        self.window, self.repeats = window, repeats
        self.steps = 2 * window
        self.bits = rng.integers(0, 2, size=(repeats, self.steps, vocabulary + 2), dtype=np.int8)
        # One place from each stretch of the walk, as neighbouring steps often write the same word.
        stretch = self.steps // samples
        self.places = [np.arange(samples) * stretch + rng.integers(0, stretch, size=samples) for _ in range(repeats)]
        self.factors = rng.integers(1, 2**62, size=(repeats, samples), dtype=np.int64) | 1

    def keys(self, windows: np.ndarray, repeat: int) -> np.ndarray:
        """One key per row of ``windows`` (word numbers from 1; 0 for other words); numbers past the end read as the last symbol."""
        n, pad = windows.shape[0], self.bits.shape[2] - 1
        padded = np.concatenate([windows, np.full((n, 1), pad, dtype=windows.dtype)], axis=1)
        at, rows = np.zeros(n, dtype=np.int64), np.arange(n)
        key, taken, places = np.zeros(n, dtype=np.int64), 0, self.places[repeat]
        for step in range(places[-1] + 1):
            symbol = padded[rows, at]
            if step == places[taken]:
                key = key * np.int64(1_000_003) + (symbol.astype(np.int64) + 7) * self.factors[repeat, taken]
                taken += 1
            at = np.minimum(at + self.bits[repeat, step][symbol], self.window)
        return key


class Matcher:
    def __init__(self, items: list[tuple[int, str]], window: int, window_edits: int, repeats: int, samples: int, min_words: int, words_per_edit: int, seed: int, least_words: int = 7):
        self.fold, self.window, self.window_edits = WordFolder(), window, window_edits
        self.min_words, self.words_per_edit = min_words, words_per_edit
        listed = [(k, self.fold.words(t)) for k, t in items]
        self.number: dict[str, int] = {}
        for _, words in listed:
            for w in words:
                self.number.setdefault(w, len(self.number) + 1)
        self.items = [(k, np.array([self.number[w] for w in words], dtype=np.int32)) for k, words in listed if len(words) >= least_words]
        self.walks = Walks(len(self.number), window, repeats, samples, seed)
        grams, owner = [], []
        for at, (_, words) in enumerate(self.items):
            padded = words if len(words) >= window else np.concatenate([words, np.zeros(window - len(words), dtype=np.int32)])
            for i in range(len(padded) - window + 1):
                grams.append(padded[i : i + window])
                owner.append(at)
        self.tables = []
        if grams:
            stacked, owners = np.stack(grams), np.array(owner)
            for r in range(repeats):
                keys = self.walks.keys(stacked, r)
                order = np.argsort(keys, kind="stable")
                self.tables.append((keys[order], order))
            self.grams, self.owners = stacked, owners

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, 0) for w in self.fold.words(text)], dtype=np.int32)

    def batch(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(place of the text, place of the item, words of the item in the passage, edits, first word) of each passage."""
        if not self.tables:
            return
        w, docs = self.window, [self.numbers(t) for t in texts]
        # Every text is followed by words of no item, so that a short or ending passage has its windows as well.
        gap = np.zeros(w, dtype=np.int32)
        flat = np.concatenate([x for d in docs for x in (d, gap)] or [gap])
        starts = np.cumsum([0] + [len(d) + w for d in docs])
        if len(flat) < w:
            return
        known = np.concatenate([[0], np.cumsum(flat > 0)])
        first = np.flatnonzero((known[w:] - known[:-w]) >= w - self.window_edits)
        hits: dict[tuple[int, int], list[int]] = {}
        for lo in range(0, len(first), _CHUNK):
            at = first[lo : lo + _CHUNK]
            windows = np.lib.stride_tricks.sliding_window_view(flat, w)[at]
            for r, (keys, owners) in enumerate(self.tables):
                mine = self.walks.keys(windows, r)
                left, right = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
                many = right - left
                which = np.repeat(np.arange(len(at)), many)
                gram = owners[np.repeat(left, many) + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)]
                near = _common(windows[which], self.grams[gram]) >= w - self.window_edits
                which, owner = which[near], self.owners[gram[near]]
                doc = np.searchsorted(starts, at[which], "right") - 1
                for pair in set(zip(doc.tolist(), owner.tolist(), (at[which] - starts[doc]).tolist())):
                    hits.setdefault(pair[:2], []).append(pair[2])
        for (doc, owner), places in sorted(hits.items()):
            best = self._verify(docs[doc], self.items[owner][1], sorted(set(places)))
            if best:
                yield (doc, owner, *best)

    def _verify(self, doc: np.ndarray, item: np.ndarray, places: list[int]) -> tuple[int, int, int] | None:
        reach, regions = 2 * len(item) + self.window, []
        for p in places:
            lo, hi = max(0, p - reach), min(len(doc), p + self.window + reach)
            if regions and lo <= regions[-1][1]:
                regions[-1][1] = max(hi, regions[-1][1])
            else:
                regions.append([lo, hi])
        best = None
        for lo, hi in regions:
            found = self._align(doc[lo:hi].tolist(), item.tolist())
            if found and (best is None or found[0] - found[1] > best[0] - best[1]):
                best = (found[0], found[1], found[2] + lo)
        return best

    def _align(self, doc: list[int], item: list[int]) -> tuple[int, int, int] | None:
        """Of a text that counts the best local alignment at match 2, edit -3: (item words spanned, edits, first word)."""
        n = len(item)
        least, step = min(self.min_words, n), self.words_per_edit
        if (Counter(doc) & Counter(item)).total() < least - least // step:
            return None
        # A stretch of more words may hold more edits, and not every part of it within its own share of them.
        stretches = sorted({*range(least, n + 1, step), n})
        if not any(holds(doc, item[a : a + m], m // step) for m in stretches for a in range(n - m + 1)):
            return None
        # A cell: score, item words spanned, edits, first document word.
        zero = (0, 0, 0, 0)
        above, best = [zero] * (n + 1), zero
        for i, word in enumerate(doc):
            row = [zero]
            left = zero
            for j in range(n):
                d = above[j]
                if word == item[j]:
                    cell = (d[0] + 2, d[1] + 1, d[2], d[3] if d[0] else i)
                else:
                    u = above[j + 1]
                    cell = max((d[0] - 3, d[1] + 1, d[2] + 1, d[3]), (u[0] - 3, u[1], u[2] + 1, u[3]), (left[0] - 3, left[1] + 1, left[2] + 1, left[3]))
                    if cell[0] <= 0:
                        cell = zero
                row.append(cell)
                left = cell
                if cell[0] > best[0]:
                    best = cell
            above = row
        return best[1:]


def holds(text: list[int], pattern: list[int], most: int) -> bool:
    """Does any part of the text come within ``most`` edits of the pattern? Bit-parallel (Myers 1999), one step per word of the text."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    at: dict[int, int] = {}
    for i, word in enumerate(pattern):
        at[word] = at.get(word, 0) | 1 << i
    plus, minus, distance = full, 0, m
    for word in text:
        equal = at.get(word, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | ~(horizontal | plus) & full, plus & horizontal
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(vertical | up) & full, up & vertical
        if distance <= most:
            return True
    return False


def passages(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, window: int = 8, window_edits: int = 2, repeats: int = 20, samples: int = 4, min_words: int = 12, words_per_edit: int = 6, seed: int = 5, max_item_words: int = 2_000_000) -> DataFrame:
    """(document key, item key, n_words, n_edits, first_word) of each document with a passage of an item, at its best place."""
    spark = docs.sparkSession
    listed = [(r[0], r[1]) for r in items.select(item_key, item_text).where(F.col(item_text).isNotNull()).distinct().limit(max_item_words + 1).collect()]
    if sum(len(t.split()) for _, t in listed) > max_item_words:
        raise ValueError(f"the items hold more than {max_item_words} words")
    held = spark.sparkContext.broadcast(sorted(listed))
    doc_kind, item_kind = dict(docs.dtypes)[key], dict(items.dtypes)[item_key]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher(held.value, window, window_edits, repeats, samples, min_words, words_per_edit, seed)
        for batch in batches:
            ids, texts = batch["d"].tolist(), batch["t"].tolist()
            rows = [(ids[d], m.items[o][0], span, edits, start) for d, o, span, edits, start in m.batch(texts)]
            yield pd.DataFrame(rows, columns=["doc", "item", "n_words", "n_edits", "first_word"])

    out = docs.select(F.col(key).alias("d"), F.col(text).alias("t")).where("t is not null").mapInPandas(find, f"doc {doc_kind}, item {item_kind}, n_words int, n_edits int, first_word int")
    return out.withColumnRenamed("doc", key).withColumnRenamed("item", item_key)

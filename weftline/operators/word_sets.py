"""Codes of the words and 4-grams of plain names and addresses, for whole Arrow batches at once: what ``retrieval`` searches, without a row or a string per feature.

Texts are folded (``normalise.fold_latin``): lower-case ASCII. A word is a run of letters and digits. 4-grams are those of a name's distinct words joined, between marks, as ``normalise.grams`` cuts them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

PART = 50_000
_WORD = np.zeros(256, dtype=bool)
_WORD[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = True
_MARK = ord("#")
# Increment and multipliers of SplitMix64.
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def word_codes(channels: list[str]) -> Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]:
    """A function from rows with ``names`` and ``addresses``, arrays of folded texts, to the distinct codes of the rows' words (nw, ad) and 4-grams (nc), with the row of each; in the lowest two bits
    the number of the channel, in the order of rows and channels."""
    assert len(channels) <= 4 and set(channels) <= {"nw", "nc", "ad"}

    def coded(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        parts = [_part(rows.slice(lo, PART), channels) for lo in range(0, len(rows), PART)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] + i * PART for i, p in enumerate(parts)])

    return coded


def _part(rows: pa.Table, channels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    code, owner, ch = [], [], []

    def add(channel: str, values: np.ndarray, at: np.ndarray) -> None:
        number = channels.index(channel)
        code.append((values & ~np.uint64(3)) | np.uint64(number))
        owner.append(at)
        ch.append(np.full(len(at), number))

    if "nw" in channels or "nc" in channels:
        of, words = _texts(rows["names"])
        letters, long, text, hashed = _words(words)
        if "nw" in channels:
            add("nw", hashed, of[text])
        if "nc" in channels:
            grams, at = _grams(letters, long, text, hashed, len(words))
            # Whole numbers of 32 bits spread over 62: different grams have different codes.
            add("nc", grams * _STEP << np.uint64(2), of[at])
    if "ad" in channels:
        of, words = _texts(rows["addresses"])
        _, _, text, hashed = _words(words)
        add("ad", hashed, of[text])
    code, owner, ch = np.concatenate(code).view(np.int64), np.concatenate(owner), np.concatenate(ch)
    order = np.argsort((owner << 46) | (ch << 44) | (_mixed(code.view(np.uint64)) >> np.uint64(20)).view(np.int64))
    code, owner = code[order], owner[order]
    new = np.ones(len(code), dtype=bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    return code[new], owner[new]


def _texts(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The row of each text, and the texts."""
    one = column.combine_chunks()
    one = one if isinstance(one, pa.Array) else pa.concat_arrays(one.chunks)
    return np.repeat(np.arange(len(one)), one.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)), one.flatten()


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all words, and of each word its length, text and hash."""
    none = np.zeros(0, np.int64)
    if not len(texts):
        return np.zeros(0, np.uint8), none, none, none.view(np.uint64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    offsets -= offsets[0]
    inside = np.zeros(len(bytes_) + 2, dtype=bool)
    inside[1:-1] = _WORD[bytes_]
    # A text begins a word of its own, whatever the one before ends with.
    fresh = np.zeros(len(bytes_) + 1, dtype=bool)
    fresh[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | fresh[:-1]))
    if not len(start):
        return np.zeros(0, np.uint8), none, none, none.view(np.uint64)
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | fresh[1:])) + 1
    long = end - start
    letters = bytes_[inside[1:-1]]
    begin = np.cumsum(long) - long
    at = np.arange(len(letters)) - np.repeat(begin, long)
    factor = _mixed(np.arange(1, int(long.max()) + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    hashed = np.add.reduceat(letters.astype(np.uint64) * factor[at], begin)
    return letters, long, np.searchsorted(offsets, start, "right") - 1, hashed


def _grams(letters: np.ndarray, long: np.ndarray, text: np.ndarray, hashed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """4-grams as numbers, and the text of each."""
    order = np.lexsort((hashed, text))
    again = np.zeros(len(text), dtype=bool)
    again[order[1:]] = (hashed[order[1:]] == hashed[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    letters, text, long = letters[np.repeat(~again, long)], text[~again], long[~again]
    size = np.bincount(text, long, minlength=n).astype(np.int64)
    begin = np.cumsum(size + 2) - (size + 2)
    marked = np.full(int((size + 2).sum()) + 3, _MARK, dtype=np.uint8)
    marked[np.arange(len(letters)) + 2 * np.repeat(np.arange(n), size) + 1] = letters
    wide = marked.astype(np.uint64)
    number = wide[:-3] | (wide[1:-2] << np.uint64(8)) | (wide[2:-1] << np.uint64(16)) | (wide[3:] << np.uint64(24))
    # A text of one letter has one gram of three characters, one without letters none.
    many = np.where(size == 0, 0, np.maximum(size - 1, 1))
    at = np.repeat(np.arange(n), many)
    grams = number[np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(len(at))]
    return np.where(size[at] == 1, grams & np.uint64(0xFFFFFF), grams), at

"""One consistent form for text that looks the same.

1. Compatibility normalisation (NFKC) folds width forms, joined letters and ways to store an accent.
2. Ignorable characters (format controls, soft hyphens, variation selectors) are deleted, hyphens of the same shape become
   ``-``, runs of blanks of any kind become one space, outer blanks go.
3. Each token with letters is read as a lattice: at every place the letters that share the shape of the stored one, and for letters
   that look alike in some faces only (Greek alpha and a, Cyrillic te and t) the Latin letter at the price ``loose``. Viterbi picks
   the path with the best character bigram score, a change of script inside a token costing ``switch``. So "P\u03b1rk" becomes "Park", as
   its other letters have no Greek reading, and a Greek or Russian word keeps its letters.

The lattice is built from shape classes, never from the stored letters. Tokens of equal look therefore have equal lattices and
equal results; letters that differ in every face never meet in a class. Case, accents and ASCII digits for letters are part of the look.

Bigram counts come from the tokens written in one script, over the whole input; a table of them is bounded by the alphabets
(``max_bigrams`` is a check of that bound, not a cut: crossing it fails). Results: null stays null, blank text becomes ''.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts with the shape of a Latin letter, by Latin letter (Unicode confusables).
SHAPES = {
    "A": "ΑАᎪ", "B": "ΒВᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ΕЕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "ΗНᎻ", "I": "ΙІӀ", "J": "ЈᎫ", "K": "ΚКᏦ", "L": "Ꮮ",
    "M": "ΜМᎷ", "N": "ΝՆ", "O": "ΟОՕ", "P": "ΡРᏢ", "Q": "Ԛ", "R": "Ꭱ", "S": "ЅᏚ", "T": "ΤТᎢ", "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ΧХ", "Y": "ΥҮУ", "Z": "ΖᏃ",
    "a": "ɑαа", "b": "Ь", "c": "сϲ", "d": "ԁ", "e": "еҽ", "f": "ſ", "g": "ɡց", "h": "һհ", "i": "іɩι", "j": "јϳ", "k": "κ", "l": "ӏ", "m": "м", "n": "ո",
    "o": "οоօ", "p": "ρр", "q": "ԛզ", "r": "г", "s": "ѕ", "t": "т", "u": "υս", "v": "νѵ", "w": "ԝա", "x": "хχ", "y": "уүγ", "z": "ᴢ",
    "æ": "ӕ", "Æ": "Ӕ", "ə": "ә",
}
# Shapes that are alike only in some faces: the context decides whether they stand for a Latin letter.
_LOOSE = set("αιɩгмтκզγνυЬρſ")
# Characters with the shape of a hyphen.
HYPHENS = "‐‑‒﹣⁃˗−－"

STRICT = {other: latin for latin, others in SHAPES.items() for other in others if other not in _LOOSE}
LOOSE = {other: latin for latin, others in SHAPES.items() for other in others}
_CLASSES: dict[str, tuple[str, ...]] = {}
for _other, _latin in STRICT.items():
    _CLASSES[_latin] = (*_CLASSES.get(_latin, (_latin,)), _other)
_HYPHEN_MAP = {ord(h): "-" for h in HYPHENS}
_IGNORED_EXTRA = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x180F), *range(0xFE00, 0xFE10)}


def _ignorable(ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" or ord(ch) in _IGNORED_EXTRA


def _compat(text: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFKC", text))


def plain(text: str) -> str:
    """Steps 1 and 2."""
    if text.isascii():
        return " ".join(text.split())
    kept = "".join(" " if c.isspace() else c for c in text if c.isspace() or not _ignorable(c))
    return " ".join(_compat(kept).translate(_HYPHEN_MAP).split())


def script(ch: str) -> str:
    if ch.isascii():
        return "L" if ch.isalpha() else ""
    if not ch.isalpha():
        return ""
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "L"
    if 0x250 <= o < 0x2B0:
        return "P"
    if 0x370 <= o < 0x400:
        return "G"
    if 0x400 <= o < 0x530:
        return "C"
    return "X"


def shape_of(token: str) -> str:
    """The class of every letter, accents kept: decomposed, mapped, composed again."""
    if token.isascii():
        return token
    parts = unicodedata.normalize("NFD", token)
    return unicodedata.normalize("NFC", "".join(STRICT.get(c, c) for c in parts))


def single_script_bigrams(text: str) -> Iterator[str]:
    """Bigrams, with a blank at both ends, of the tokens whose letters are of one script."""
    for token in text.split():
        found = {s for s in map(script, token) if s}
        if len(found) == 1 and found != {"P"}:
            padded = f" {token} "
            yield from (padded[i : i + 2] for i in range(len(padded) - 1))


class Reader:
    """Viterbi over look-alike lattices under given bigram counts; remembers tokens, up to a bound."""

    def __init__(self, counts: dict[str, int], switch: float = 12.0, loose: float = 10.0):
        first: dict[str, int] = {}
        for pair, n in counts.items():
            first[pair[0]] = first.get(pair[0], 0) + n
        self.cost = {p: -math.log((n + 0.5) / (first[p[0]] + 500.0)) for p, n in counts.items()}
        self.unseen = {c: -math.log(0.5 / (n + 500.0)) for c, n in first.items()}
        self.worst = -math.log(0.5 / 500.0)
        self.switch, self.loose = switch, loose
        self.known: dict[str, str] = {}

    def _step(self, a: str, b: str) -> float:
        c = self.cost.get(a + b)
        return c if c is not None else self.unseen.get(a, self.worst)

    def token(self, shape: str) -> str:
        got = self.known.get(shape)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[shape] = self._viterbi(shape)
        return got

    def _viterbi(self, shape: str) -> str:
        # A state is a letter and the script the token has so far; letters without script keep it.
        paths: dict[tuple[str, str], tuple[float, str]] = {(" ", ""): (0.0, "")}
        for ch in shape:
            nxt: dict[tuple[str, str], tuple[float, str]] = {}
            latin = LOOSE.get(ch) if ch in _LOOSE else None
            for letter in (*_CLASSES.get(ch, (ch,)), *((latin,) if latin else ())):
                s = script(letter)
                price = self.loose if letter == latin else 0.0
                best: dict[str, tuple[float, str]] = {}
                for (prev, had), (cost, path) in paths.items():
                    c = cost + price + self._step(prev, letter) + (self.switch if s and had and s != had else 0.0) + (self.switch if s == "P" else 0.0)
                    to = s or had
                    if to not in best or (c, path) < best[to]:
                        best[to] = (c, path)
                for to, (c, path) in best.items():
                    nxt[(letter, to)] = (c, path + letter)
            paths = nxt
        return min((c + self._step(letter, " "), path) for (letter, _), (c, path) in paths.items())[1]

    def text(self, raw: str) -> str:
        return " ".join(self.token(shape_of(t)) if any(map(str.isalpha, t)) else t for t in plain(raw).split(" "))


def bigram_counts(texts: DataFrame, columns: list[str]) -> DataFrame:
    """(pair, n) over every text of the columns."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, int] = {}
        for batch in batches:
            for column in columns:
                for text in batch[column].dropna():
                    for pair in single_script_bigrams(plain(text)):
                        total[pair] = total.get(pair, 0) + 1
        yield pd.DataFrame({"pair": list(total), "n": list(total.values())}, columns=["pair", "n"])

    return texts.select(*columns).mapInPandas(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def consistent(texts: DataFrame, columns: list[str], suffix: str = "_form", max_bigrams: int = 2_000_000) -> DataFrame:
    """``texts`` with the consistent form of each column under its name and ``suffix``."""
    table = bigram_counts(texts, columns).limit(max_bigrams + 1).collect()
    if len(table) > max_bigrams:
        raise ValueError(f"more than {max_bigrams} different character pairs")
    counts = texts.sparkSession.sparkContext.broadcast({r["pair"]: r["n"] for r in table})

    @F.pandas_udf("string")
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(counts.value)
        for batch in batches:
            yield batch.map(lambda t: None if t is None else reader.text(t))

    return texts.withColumns({c + suffix: form(F.col(c)) for c in columns})


def alike_pairs(records: DataFrame, key: str, columns: list[str], a: str, b: str) -> DataFrame:
    """Pairs of different keys, smaller first, whose forms agree in all columns while a stored text differs; blank texts are in no pair.

    Keys and stored texts are hashed into groups by the forms; records stored alike never meet, as the join asks for another
    stored hash. Repeated rows count once.
    """
    forms = consistent(records.select(key, *columns), columns)
    full = forms
    for c in columns:
        full = full.where(F.col(c + "_form") != "")
    state = full.select(F.sha2(F.concat_ws("\x1f", *[c + "_form" for c in columns]), 256).alias("look"), F.sha2(F.concat_ws("\x1f", *columns), 256).alias("stored"), F.col(key).alias("k")).distinct()
    from weftline.session import cut

    state = cut(state)
    shared = state.groupBy("look").agg(F.min("stored").alias("x"), F.max("stored").alias("y")).where("x <> y").select("look")
    state = state.join(shared, "look", "left_semi")
    left, right = state.select("look", F.col("stored").alias("sa"), F.col("k").alias(a)), state.select("look", F.col("stored").alias("sb"), F.col("k").alias(b))
    return left.join(right, "look").where((F.col("sa") != F.col("sb")) & (F.col(a) < F.col(b))).select(a, b).distinct()


_FOLD = {**{ord(o): latin for o, latin in LOOSE.items()}}


def folded(text: str) -> str:
    """For comparisons only: plain text in lower case without accents, look-alikes as Latin letters inside tokens that hold Latin ones."""
    t = plain(text)
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFD", _latinised(t)) if not unicodedata.combining(c))
    return t.lower()


def _latinised(text: str) -> str:
    out = []
    for token in text.split(" "):
        if token.isascii():
            out.append(token)
            continue
        mapped = unicodedata.normalize("NFD", token).translate(_FOLD)
        rest = {script(c) for c in mapped} - {"", "L"}
        out.append(token if rest else mapped)
    return " ".join(out)

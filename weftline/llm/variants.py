"""Variant spellings of names typed by people.

1. Every name is taken apart (``names``): given name with its nicknames, proper names in order of the alphabet, trade. Trades beyond a fixed table are learned from the input (``trades``). Entries alike
   in all parts are one form.
2. Forms meet in blocks. A block key is the phonetic code of one proper name with the first two, the last two or, for partial forms, the first letter
   of the other; a typo in one name leaves one of these keys as it was. Keys of the outer letters of both catch typos in both. Names written as one word are tried at every place where they may have been
   joined. Forms of one trade and forms without a trade meet, forms of different trades don't (``blocks``): nothing else is left out, however large a block.
3. Pairs of a block are compared: proper names by Jaro-Winkler and edits, given names by the nickname table, trades by class.
4. Full forms (no part missing or shortened) are clustered by connected components. A partial form joins the one cluster it fits, of several the one with
   most rows, of equal ones that of the least name; so a name without a trade never links two trades. Partial forms that fit no cluster
   are clustered among themselves.

Null, empty and blank names, and names without any proper name, are in no cluster. Repeated rows of one key with one name count once; rows of
one key with different names all count. Ties are broken by the order of the forms' keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.similarity import edits, jaro_winkler
from weftline.llm.blocks import BARE, BOTH, WHOLE, every_pair
from weftline.llm.names import Name, NameReader, sound
from weftline.llm.trades import learned_trades
from weftline.operators.components import components, pairs_within
from weftline.session import cut


def block_keys(n: Name) -> list[str]:
    p = n.proper
    if len(p) >= 2:
        keys = set()
        for x in p:
            for y in p:
                if x != y:
                    keys |= {f"{sound(x)}<{y[:2]}", f"{sound(x)}>{y[-2:]}", f"{sound(x)}.{y[:1]}", f"{x[:3]}~{y[-3:]}"}
                    if x < y:
                        keys |= {f"{a}^{b}" for a, b in [sorted((x[:3], y[:3]))]} | {f"{a}${b}" for a, b in [sorted((x[-3:], y[-3:]))]}
        return sorted(keys)
    if not p:
        return []
    x = p[0]
    if n.proper_initial:
        return [f"{sound(x)}.{n.proper_initial}"]
    keys = {f"{sound(x)}<", f"{sound(x)}>"}
    if len(x) >= 9:
        for i in range(4, len(x) - 3):
            a, b = x[:i], x[i:]
            keys |= {f"{sound(a)}<{b[:2]}", f"{sound(b)}>{a[-2:]}"}
    return sorted(keys)


def _alike(x: str, y: str) -> bool:
    if x == y:
        return True
    most = 1 if min(len(x), len(y)) < 6 else 2
    return edits(x, y, most) <= most and jaro_winkler(x, y) >= 0.84


def same_proper(a: Name, b: Name) -> bool:
    p, q = (a.proper, b.proper) if len(a.proper) >= len(b.proper) else (b.proper, a.proper)
    short = b if p is a.proper else a
    if len(p) >= 2 and len(q) >= 2:
        if len(p) != len(q):
            return False
        if len(p) == 2:
            return (_alike(p[0], q[0]) and _alike(p[1], q[1])) or (_alike(p[0], q[1]) and _alike(p[1], q[0]))
        return all(any(_alike(x, y) for y in q) for x in p) and all(any(_alike(x, y) for x in p) for y in q)
    if len(p) == 2 and len(q) == 1:
        if short.proper_initial:
            return any(_alike(p[i], q[0]) and p[1 - i][:1] == short.proper_initial for i in (0, 1))
        return any(edits(j, q[0], 2) <= 2 for j in (p[0] + p[1], p[1] + p[0]))
    if len(p) == 1 and len(q) == 1:
        return _alike(p[0], q[0]) and (not a.proper_initial or not b.proper_initial or a.proper_initial == b.proper_initial) and bool(a.proper_initial) == bool(b.proper_initial)
    return False


def same_given(a: Name, b: Name) -> bool:
    if a.given and b.given:
        return bool(set(a.given) & set(b.given))
    if a.given or b.given:
        full, other = (a, b) if a.given else (b, a)
        return bool(other.initial) and any(g.startswith(other.initial) for g in full.given)
    return a.initial == b.initial


def same_trade(a: Name, b: Name) -> bool:
    return a.trade == b.trade or not a.trade or not b.trade


def is_full(n: Name) -> bool:
    return bool(n.trade) and not n.initial and not n.proper_initial


def same(a: Name, b: Name) -> bool:
    return same_trade(a, b) and same_given(a, b) and same_proper(a, b)


def forms_of(entries: DataFrame, key: str, name: str, country: str | None = None) -> DataFrame:
    """(key, form) of every different (key, name) with a name; the form is the text of :meth:`Name.key`."""

    @F.pandas_udf("words array<string>, web string")
    def taken_apart(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([NameReader.words(n) for n in names], columns=["words", "web"])

    where = F.coalesce(F.col(country), F.lit("")) if country else F.lit("")
    rows = entries.select(F.col(key).alias("k"), F.col(name).alias("n"), where.alias("c")).where(F.col("k").isNotNull() & F.col("n").isNotNull())
    rows = rows.groupBy("k", "n").agg(F.max("c").alias("c"))
    read = cut(rows.select("k", "c", taken_apart("n").alias("r")).select("k", "c", "r.*"))
    trades = entries.sparkSession.sparkContext.broadcast(learned_trades(read.select("words")))

    @F.pandas_udf("string")
    def form(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        reader = NameReader(trades=trades.value)
        for words, webs, countries in batches:
            found = (reader.name(list(w), x, c) for w, x, c in zip(words, webs, countries))
            yield pd.Series([None if r is None or not r.proper else r.key() for r in found], dtype=object)

    return read.select("k", form("words", "web", "c").alias("form")).where("form is not null").distinct()


def _may(x: Column, y: Column) -> Column:
    """What :func:`same_given` asks of written given names and, in terms of Levenshtein edits, :func:`same_proper` of two proper names each; on the texts of forms."""
    a, b = F.split(x, "\\|"), F.split(y, "\\|")
    given = (a[0] == "") | (b[0] == "") | F.arrays_overlap(F.split(a[0], ","), F.split(b[0], ","))
    # Two swaps of neighbours are two edits there and four here.
    p, q = F.split(a[2], ","), F.split(b[2], ",")
    near = lambda i, j: F.levenshtein(F.get(p, F.lit(i)), F.get(q, F.lit(j)), 4) >= 0
    both = (F.size(p) == 2) & (F.size(q) == 2)
    return given & (~both | (near(0, 0) & near(1, 1)) | (near(0, 1) & near(1, 0)))


def candidate_pairs(forms: DataFrame) -> DataFrame:
    """(x, y) different forms of a block whose trades and given names agree, x < y in spelling."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f in batch["form"]:
                n = Name.of(f)
                for k in block_keys(n):
                    rows += [(f"{k}|{n.trade}", f, BOTH), (k, f, WHOLE)] if n.trade else [(k, f, BARE)]
            yield pd.DataFrame(rows, columns=["key", "form", "role"])

    return every_pair(forms.select("form").mapInPandas(keyed, "key string, form string, role int"), _may)


def clusters(entries: DataFrame, key: str, name: str, country: str | None = None) -> DataFrame:
    """(key, entity) of every entry with a name; the entity is named by the least form of its full forms."""
    typed = cut(forms_of(entries, key, name, country))
    forms = cut(typed.groupBy("form").agg(F.count("*").alias("n")))

    @F.pandas_udf("string")
    def link(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(xs, ys):
            a, b = Name.of(x), Name.of(y)
            out.append((("f" if is_full(a) else "p") + ("f" if is_full(b) else "p")) if same(a, b) else None)
        return pd.Series(out, dtype=object)

    links = cut(candidate_pairs(forms).withColumn("kind", link("x", "y")).where("kind is not null"))
    full = components(links.where("kind = 'ff'"), "x", "y").withColumnRenamed("node", "form")

    @F.pandas_udf("boolean")
    def full_form(fs: pd.Series) -> pd.Series:
        return fs.map(lambda f: is_full(Name.of(f)))

    whole = forms.where(full_form("form")).join(full, "form", "left").select("form", "n", F.coalesce("component", "form").alias("entity"))
    whole = cut(whole.join(whole.groupBy("entity").agg(F.sum("n").alias("rows")), "entity"))
    one = links.where("kind = 'pf'").select(F.col("x").alias("part"), F.col("y").alias("form")).unionByName(links.where("kind = 'fp'").select(F.col("y").alias("part"), F.col("x").alias("form")))
    fits = one.join(whole, "form").groupBy("part").agg(F.min(F.struct(-F.col("rows"), F.col("entity"))).alias("best")).select(F.col("part").alias("form"), F.col("best.entity").alias("entity"))
    fits = cut(fits)
    rest = links.where("kind = 'pp'").join(fits.select(F.col("form").alias("x")), "x", "left_anti").join(fits.select(F.col("form").alias("y")), "y", "left_anti")
    loose = components(rest, "x", "y").select(F.col("node").alias("form"), F.col("component").alias("entity"))
    named = whole.select("form", "entity").unionByName(fits).unionByName(loose)
    return typed.join(named, "form", "left").select(F.col("k").alias(key), F.coalesce("entity", "form").alias("entity")).distinct()


def same_name_pairs(entries: DataFrame, key: str, name: str, country: str | None, a: str, b: str) -> DataFrame:
    return pairs_within(clusters(entries, key, name, country), "entity", key, a, b)

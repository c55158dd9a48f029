"""Same postal address written differently.

Addresses are taken apart (``places``) and forms alike in all parts taken together. A missing town or postcode is filled from the other, by the pair of both that is most frequent
in the input. Forms meet in blocks of the house number with the postcode, or with the phonetic code or outer letters of the street and outer letters of the town; a form without town and postcode meets
every form of its number and street (``blocks``: no block is cut). They are compared part by part into levels of agreement, and the weights of the levels come from expectation-maximisation over all
compared pairs (``linkage``), a missing part having a level of its own. A pair with a match probability of ``threshold`` or more is the same building: nothing else decides.

Number, street, kind, direction and town define a building. That enters as classes of the estimation, not as a rule: pairs that differ in one defining part and agree elsewhere are neighbours, a class of
their own for each such part. Without them EM would take neighbours for matches.

Forms with a town or postcode and a kind of street are clustered by connected components. Other forms join the one cluster they fit, of several
the one of most rows, of equal ones that of the least name; those that fit none are clustered among themselves.

Null, blank and filler texts are in no cluster. Addresses without a house number or street are buildings of their own. Repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.similarity import edits, jaro_winkler
from weftline.llm.blocks import BARE, BOTH, SCHEMA, WHOLE, every_pair
from weftline.llm.linkage import MISSING, Weights, estimate, pattern_counts
from weftline.llm.names import sound
from weftline.llm.places import Place, read_place
from weftline.operators.components import components, pairs_within
from weftline.session import cut

FIELDS = ["street", "kind", "way", "town", "postcode", "state"]
# Fields that define a building.
DEFINING = {"street", "kind", "way", "town"}


def spelling(a: str, b: str) -> int:
    """MISSING, 0 apart, 1 close, 2 one edit, 3 equal."""
    if not a or not b:
        return MISSING
    if a == b:
        return 3
    n = min(len(a), len(b))
    most = 1 if n < 5 else 2 if n < 12 else 3
    e = edits(a, b, most)
    if e > most or jaro_winkler(a, b) < 0.84:
        return 0
    return 2 if e == 1 else 1


def _equal(a: str, b: str) -> int:
    return MISSING if not a or not b else int(a == b)


def compare(a: Place, b: Place) -> tuple[int, ...]:
    """Levels of FIELDS."""
    street = spelling(a.street, b.street)
    if street == 0:
        # Street and town written without a mark between them.
        for x, y in ((a, b), (b, a)):
            if not x.town and y.town and edits(x.street, y.street + y.town, 2) <= 2:
                street = 1
    return (street, _equal(a.kind, b.kind), int(a.way == b.way), spelling(a.town, b.town), _equal(a.postcode, b.postcode), _equal(a.state, b.state))


def is_full(p: Place) -> bool:
    return bool(p.town or p.postcode) and bool(p.kind)


def keys(p: Place) -> list[tuple[str, int]]:
    """Block keys with the role in them."""
    if not p.number or not p.street:
        return []
    streets = {f"{p.number}~{sound(p.street)}", f"{p.number}^{p.street[:3]}", f"{p.number}${p.street[-3:]}"}
    if not p.town and not p.postcode:
        return sorted((k, BARE) for k in streets)
    out = {(k, WHOLE) for k in streets} | {(f"{k}<{p.town[:2]}", BOTH) for k in streets if p.town} | {(f"{k}>{p.town[-2:]}", BOTH) for k in streets if p.town}
    if p.postcode:
        out.add((f"{p.number}#{p.postcode}", BOTH))
    return sorted(out)


def forms_of(entries: DataFrame, key: str, address: str, country: str | None = None) -> DataFrame:
    """(k, form) of every different (key, address)."""

    @F.pandas_udf("string")
    def form(addresses: pd.Series, countries: pd.Series) -> pd.Series:
        read = (read_place(a, c) for a, c in zip(addresses, countries))
        return pd.Series([None if r is None else r.key() for r in read], dtype=object)

    where = F.coalesce(F.col(country), F.lit("")) if country else F.lit("")
    rows = entries.select(F.col(key).alias("k"), F.col(address).alias("a"), where.alias("c")).where(F.col("k").isNotNull() & F.col("a").isNotNull())
    rows = rows.groupBy("k", "a").agg(F.max("c").alias("c"))
    return rows.select("k", form("a", "c").alias("form")).where("form is not null").distinct()


def filled(typed: DataFrame) -> DataFrame:
    """(k, form) with town or postcode filled where one of them is missing."""
    p = F.split("form", "\\|")
    parts = typed.withColumns({"land": p[0], "town": p[5], "postcode": p[6]})
    both = parts.where("town <> '' and postcode <> ''").groupBy("land", "town", "postcode").agg(F.count("*").alias("n"))
    town_of = both.groupBy("land", "postcode").agg(F.max(F.struct("n", "town")).alias("b")).select("land", "postcode", F.col("b.town").alias("t"))
    code_of = both.groupBy("land", "town").agg(F.max(F.struct("n", "postcode")).alias("b")).select("land", "town", F.col("b.postcode").alias("c"))
    whole = parts.where("(town = '') = (postcode = '')").select("k", "form")
    put = F.concat_ws("|", p[0], p[1], p[2], p[3], p[4], F.coalesce("t", "town"), F.coalesce("c", "postcode"), p[7])
    no_town = parts.where("town = '' and postcode <> ''").join(town_of, ["land", "postcode"], "left").withColumn("c", F.lit(None).cast("string"))
    no_code = parts.where("town <> '' and postcode = ''").join(code_of, ["land", "town"], "left").withColumn("t", F.lit(None).cast("string"))
    return whole.unionByName(no_town.select("k", put.alias("form"))).unionByName(no_code.select("k", put.alias("form")))


def compared(forms: DataFrame) -> DataFrame:
    """(x, y, FIELDS) of every pair of forms that share a block."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(k, f, role) for f in batch["form"] for k, role in keys(Place.of(f))], columns=["key", "form", "role"])

    pairs = every_pair(forms.select("form").mapInPandas(keyed, SCHEMA))

    @F.pandas_udf(", ".join(f"{f} int" for f in FIELDS))
    def levels(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([compare(Place.of(x), Place.of(y)) for x, y in zip(xs, ys)], columns=FIELDS, dtype="int32")

    return cut(pairs.select("x", "y", levels("x", "y").alias("l")).select("x", "y", "l.*"))


def weigh(counts: dict[tuple[int, ...], int]) -> Weights:
    """The weights of the levels of FIELDS."""
    return estimate(counts, [at for at, f in enumerate(FIELDS) if f in DEFINING])


def clusters(entries: DataFrame, key: str, address: str, country: str | None = None, threshold: float = 0.5) -> DataFrame:
    """(key, place) of every entry with an address."""
    typed = cut(filled(cut(forms_of(entries, key, address, country))))
    forms = cut(typed.groupBy("form").agg(F.count("*").alias("n")))
    pairs = compared(forms)
    weights = weigh(pattern_counts(pairs, FIELDS))
    known: dict[tuple[int, ...], bool] = {}

    def accepted(p: tuple[int, ...]) -> bool:
        if p not in known:
            known[p] = weights.probability(p) >= threshold
        return known[p]

    @F.pandas_udf("string")
    def kind(xs: pd.Series, ys: pd.Series, levels: pd.DataFrame) -> pd.Series:
        out = []
        for x, y, p in zip(xs, ys, levels[FIELDS].itertuples(index=False, name=None)):
            a, b = Place.of(x), Place.of(y)
            out.append((("f" if is_full(a) else "p") + ("f" if is_full(b) else "p")) if a.number == b.number and accepted(tuple(p)) else None)
        return pd.Series(out, dtype=object)

    links = cut(pairs.select("x", "y", kind("x", "y", F.struct(*FIELDS)).alias("kind")).where("kind is not null"))
    full = components(links.where("kind = 'ff'"), "x", "y").withColumnRenamed("node", "form")
    p = F.split("form", "\\|")
    whole = forms.where((p[4] != "") & ((p[5] != "") | (p[6] != ""))).join(full, "form", "left").select("form", "n", F.coalesce("component", "form").alias("place"))
    whole = cut(whole.join(whole.groupBy("place").agg(F.sum("n").alias("rows")), "place"))
    one = links.where("kind = 'pf'").select(F.col("x").alias("part"), F.col("y").alias("form")).unionByName(links.where("kind = 'fp'").select(F.col("y").alias("part"), F.col("x").alias("form")))
    fits = cut(one.join(whole, "form").groupBy("part").agg(F.min(F.struct(-F.col("rows"), F.col("place"))).alias("best")).select(F.col("part").alias("form"), F.col("best.place").alias("place")))
    rest = links.where("kind = 'pp'").join(fits.select(F.col("form").alias("x")), "x", "left_anti").join(fits.select(F.col("form").alias("y")), "y", "left_anti")
    loose = components(rest, "x", "y").select(F.col("node").alias("form"), F.col("component").alias("place"))
    named = whole.select("form", "place").unionByName(fits).unionByName(loose)
    return typed.join(named, "form", "left").select(F.col("k").alias(key), F.coalesce("place", "form").alias("place")).distinct()


def same_place_pairs(entries: DataFrame, key: str, address: str, country: str | None, a: str, b: str) -> DataFrame:
    return pairs_within(clusters(entries, key, address, country), "place", key, a, b)

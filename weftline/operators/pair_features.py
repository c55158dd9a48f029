"""Features of a pair from the token and number arrays of both sides. Missing sides give the conventional values: -1, or -99 for a maximum over no tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extra_tokens(a: Column, b: Column) -> Column:
    """Tokens of a that b lacks, duplicates kept."""
    return F.filter(a, lambda t: ~F.array_contains(b, t))


def token_weights(records: DataFrame, vocab: DataFrame, tokens: str, out: str) -> DataFrame:
    """(id, out) with out an array of struct(t, idf, df) of the record's distinct tokens, in order of the alphabet."""
    each = records.select("id", "country", F.explode(F.array_distinct(tokens)).alias("t"))
    met = each.join(vocab, ["country", "t"], "left")
    return met.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("t", "idf", "df"))).alias(out))


def overlap(q: Column, s: Column, prefix: str) -> dict[str, Column]:
    """IDF-weighted overlap of two arrays of struct(t, idf): shares both ways, shared mass and count, largest extra and missing, lengths."""
    ts = lambda xs: F.transform(xs, lambda x: x["t"])
    mass = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x["idf"])
    shared = F.filter(q, lambda x: F.array_contains(ts(s), x["t"]))
    extra, missing = F.filter(q, lambda x: ~F.array_contains(ts(s), x["t"])), F.filter(s, lambda x: ~F.array_contains(ts(q), x["t"]))
    some = (F.size(q) > 0) & (F.size(s) > 0)
    top = lambda xs: F.coalesce(F.array_max(F.transform(xs, lambda x: x["idf"])), F.lit(0.0))
    part = lambda a, b: F.when(some, F.round(F.try_divide(mass(a), mass(b)), 6)).otherwise(-1.0)
    return {
        f"{prefix}_q_cover": part(shared, q), f"{prefix}_s_cover": part(shared, s), f"{prefix}_mass": F.round(mass(shared), 6), f"{prefix}_shared": F.size(shared),
        f"{prefix}_max_extra": F.round(top(extra), 6), f"{prefix}_max_missing": F.round(top(missing), 6), f"{prefix}_q_len": F.size(q), f"{prefix}_s_len": F.size(s),
    }


def unseen_share(weights: Column) -> dict[str, Column]:
    """Tokens that occur in no index record: share and number; -1 without tokens."""
    unseen = F.size(F.filter(weights, lambda x: F.coalesce(x["df"], F.lit(0)) == 0))
    return {"oov_share": F.when(F.size(weights) > 0, F.round(unseen / F.size(weights), 6)).otherwise(-1.0), "oov_n": unseen}


def number_features(q: Column, s: Column) -> dict[str, Column]:
    """House numbers of q against the first of s. -1 unless both sides have numbers; counts excepted. Repeated numbers count each time. Of numbers beyond 64-bit integers the leading 18 digits count."""
    as_long = lambda xs: F.transform(xs, lambda n: F.substring(n, 1, 18).cast("long"))
    qn, sn = as_long(q), as_long(s)
    both = (F.size(q) > 0) & (F.size(s) > 0)
    first = F.try_element_at(sn, F.lit(1))
    text = first.cast("string")
    when = lambda c: F.when(both, c).otherwise(-1)
    met = F.size(F.filter(sn, lambda n: F.array_contains(qn, n)))
    return {
        "num_q": F.size(q), "num_s": F.size(s),
        "num_s0_in_q": when(F.array_contains(qn, first).cast("int")),
        "num_first_eq": when((F.try_element_at(qn, F.lit(1)) == first).cast("int")),
        "num_best_ed": when(F.array_min(F.transform(qn, lambda n: F.levenshtein(n.cast("string"), text)))),
        "num_best_rel": F.when(both, F.round(F.array_min(F.transform(qn, lambda n: F.abs(n - first) / F.greatest(F.lit(1.0), first.cast("double")))), 6)).otherwise(-1.0),
        "num_first_abs": F.when(both, F.round(F.log1p(F.abs(F.try_element_at(qn, F.lit(1)) - first).cast("double")), 6)).otherwise(-1.0),
        "num_min_diff": F.when(both, F.round(F.log1p(F.array_min(F.transform(qn, lambda n: F.abs(n - first))).cast("double")), 6)).otherwise(-1.0),
        "num_prefix": when(F.exists(qn, lambda n: (n != first) & (text.startswith(n.cast("string")) | n.cast("string").startswith(text))).cast("int")),
        "num_jacc": F.when(both, F.round(met / (F.size(q) + F.size(s) - met), 6)).otherwise(-1.0),
        "num_len_diff": F.when(both, F.length(text) - F.length(F.try_element_at(qn, F.lit(1)).cast("string"))).otherwise(-1),
    }


# Legal forms by rank; 0 is none.
LEGAL_RANK = "inc corp co ltd pvt llc llp lp pc pllc plc pa sarl sas sasu eurl sci sa snc selarl scop scp ei".split()


def legal_code(tokens: Column) -> Column:
    table = F.create_map(*[F.lit(x) for i, w in enumerate(LEGAL_RANK, 1) for x in (w, i)])
    return F.coalesce(F.array_min(F.transform(tokens, lambda t: F.try_element_at(table, t))), F.lit(0))


def legal_relation(q: Column, s: Column) -> Column:
    """0 neither, 1 only q, 2 only s, 3 the same form, 4 different forms."""
    return F.when((q == 0) & (s == 0), 0).when(s == 0, 1).when(q == 0, 2).when(q == s, 3).otherwise(4)

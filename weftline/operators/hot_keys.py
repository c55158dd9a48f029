"""Per-key results where a few keys hold most rows: eager aggregation through joins.

Both inputs are aggregated by join key (and group columns) before they meet, so the join sees one compact state per
distinct key instead of the rows. Counts multiply, sums are scaled by the other side's count, minima and maxima pass
through, and the roll-up merges states by group. Map-side partial aggregation does the first step inside each
input split; a key with a third of all rows therefore sends one state per task to its reducer.

Exact distinct counts go through the pair (key, value). Keys that the counts, which come first, show to be hot are spread by a salt of the value, so one exchange serves both levels of
the distinct count and no task holds the rows of one key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut


def unpivot_keys(rows: DataFrame, keys: list[str], carry: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row per row and key column, null keys left out; ``columns`` are the columns that hold the keys, if they go by other names."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("key_column"), F.col(c).cast("string").alias("key_value")) for k, c in zip(keys, columns or keys)]))
    return rows.select(each.alias("k"), *carry).select("k.key_column", "k.key_value", *carry).where(F.col("key_value").isNotNull())


def key_table(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(key_column, key_value), each non-null value of a key column once: the keys to report on."""
    return unpivot_keys(rows, keys, []).distinct()


def per_key_states(rows: DataFrame, keys: list[str], score: str, asked: DataFrame | None = None) -> DataFrame:
    """(key_column, key_value, n_rows, best) of each key value of ``asked`` (:func:`key_table` of the rows where None): both sides are reduced to a state per key, and the states joined."""
    long = unpivot_keys(rows, keys, [score])
    out = eager_join_aggregate(long, key_table(rows, keys) if asked is None else asked, ["key_column", "key_value"], ["key_column", "key_value"], left_maxima=[score])
    return out.select("key_column", "key_value", F.col("n_joined").alias("n_rows"), F.col(f"max_{score}").alias("best"))


def per_key(rows: DataFrame, keys: list[str], value: str, score: str, hot_share: float = 0.01, salts: int = 64) -> DataFrame:
    """(key_column, key_value, n_rows, n_values, best): rows, different non-null values and the highest score of each key value.

    Ties need no rule, as only values come out; a key whose scores are all null has a null best. Empty input gives no row. Repeated rows count each time.
    """
    states = cut(per_key_states(rows, keys, score))
    # At most one key in 1 / hot_share of each column is hot.
    total = rows.agg(F.count("*").alias("total"))
    hot = states.join(F.broadcast(total), F.col("n_rows") > F.lit(hot_share) * F.col("total")).select("key_column", "key_value", F.lit(salts).alias("__salts"))
    long = unpivot_keys(rows.select(*keys, F.col(value).alias("__v")), keys, ["__v"]).where("__v is not null").join(F.broadcast(hot), ["key_column", "key_value"], "left")
    salted = long.withColumn("__salt", F.coalesce(F.pmod(F.xxhash64("__v"), "__salts"), F.lit(0)).cast("int")).repartition("key_column", "key_value", "__salt")
    distinct = salted.groupBy("key_column", "key_value", "__salt", "__v").agg(F.lit(1).alias("__one")).groupBy("key_column", "key_value", "__salt").agg(F.count("*").alias("m"))
    counts = distinct.groupBy("key_column", "key_value").agg(F.sum("m").alias("n_values"))
    return states.join(counts, ["key_column", "key_value"], "left").select("key_column", "key_value", "n_rows", F.coalesce("n_values", F.lit(0)).cast("long").alias("n_values"), "best")


def hot_keys(rows: DataFrame, keys: list[str], score: str, share: float) -> DataFrame:
    """The rows of :func:`per_key_states` that hold more than ``share`` of all rows, null keys counted in the total. Counts alone decide, so no value is ever exchanged."""
    states = per_key_states(rows, keys, score)
    total = rows.agg(F.count("*").alias("total"))
    return states.join(F.broadcast(total), F.col("n_rows") > F.lit(share) * F.col("total")).drop("total")


def eager_join_aggregate(left: DataFrame, right: DataFrame, on: str | list[str], by: list[str], left_sums: list[str] | None = None, right_sums: list[str] | None = None, left_maxima: list[str] | None = None) -> DataFrame:
    """``left JOIN right USING (on) GROUP BY by`` with count(*), sums and maxima, never joining rows with rows.

    ``by`` are columns of ``left`` (they may include ``on``). Columns of the result: ``by``, n_joined, sum_<c>, max_<c>.
    Null keys join nothing, as in SQL; sums of only nulls are null. Names of ``right`` that clash with ``left`` are no matter, as it is reduced to ``on`` and its sums.
    """
    on = [on] if isinstance(on, str) else on
    ls, rs, lm = left_sums or [], right_sums or [], left_maxima or []
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    l_state = left.where(present).groupBy(*dict.fromkeys([*on, *by])).agg(
        F.count("*").alias("__ln"), *[F.sum(c).alias(f"__ls_{c}") for c in ls], *[F.max(c).alias(f"__lm_{c}") for c in lm])
    r_state = right.where(present).groupBy(*on).agg(F.count("*").alias("__rn"), *[F.sum(c).alias(f"__rs_{c}") for c in rs])
    met = l_state.join(r_state, on)
    return met.groupBy(*by).agg(
        F.sum(F.col("__ln") * F.col("__rn")).alias("n_joined"),
        *[F.sum(F.col(f"__ls_{c}") * F.col("__rn")).alias(f"sum_{c}") for c in ls],
        *[F.sum(F.col(f"__rs_{c}") * F.col("__ln")).alias(f"sum_{c}") for c in rs],
        *[F.max(f"__lm_{c}").alias(f"max_{c}") for c in lm],
    )

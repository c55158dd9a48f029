"""Learned statistics: how much a token or legal form that only one side has speaks against a match. Counts come from one half and serve the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.pair_features import extra_tokens


def log_odds(pos: Column, neg: Column, n_pos: Column, n_neg: Column) -> Column:
    """ln of the share among other pairs over the share among matches, with one added to each count."""
    return F.log(((neg + 1) / (n_neg + 2)) / ((pos + 1) / (n_pos + 2)))


def token_risk(pairs: DataFrame, q_tokens: str, s_tokens: str, label: str, country: str = "country") -> DataFrame:
    """(country, t, n_extra_pos, n_extra_neg, n_miss_pos, n_miss_neg, r_extra, r_miss). Repeated tokens count each time."""
    side = lambda a, b: pairs.select(F.col(country).alias("country"), F.col(label).alias("y"), F.explode(extra_tokens(F.col(a), F.col(b))).alias("t"))
    counted = lambda df, n: df.groupBy("country", "t").agg(F.count_if(F.col("y") == 1).alias(f"n_{n}_pos"), F.count_if(F.col("y") == 0).alias(f"n_{n}_neg"))
    both = counted(side(q_tokens, s_tokens), "extra").join(counted(side(s_tokens, q_tokens), "miss"), ["country", "t"], "full").fillna(0)
    totals = pairs.groupBy(F.col(country).alias("country")).agg(F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))
    # One row per country: a small table, but only as small as the data says; the planner decides by its size.
    met = both.join(totals, "country")
    risk = lambda n: F.when(F.col(f"n_{n}_pos") + F.col(f"n_{n}_neg") > 0, log_odds(F.col(f"n_{n}_pos"), F.col(f"n_{n}_neg"), F.col("n_pos"), F.col("n_neg"))).otherwise(0.0)
    return met.withColumns({"r_extra": F.round(risk("extra"), 6), "r_miss": F.round(risk("miss"), 6)}).drop("n_pos", "n_neg")


def pair_risk(pairs: DataFrame, risks: DataFrame, q_tokens: str, s_tokens: str, keys: list[str], country: str = "country") -> DataFrame:
    """Per pair: largest and summed risk of extra and of missing tokens (-99 and 0 without any), number of extra tokens."""
    def side(a: str, b: str, risk: str, name: str) -> DataFrame:
        each = pairs.select(*keys, F.col(country).alias("country"), F.explode(extra_tokens(F.col(a), F.col(b))).alias("t"))
        met = each.join(risks.select("country", "t", F.col(risk).alias("r")), ["country", "t"], "left")
        return met.groupBy(*keys).agg(F.max(F.coalesce("r", F.lit(0.0))).alias(f"max_{name}"), F.round(F.sum(F.coalesce("r", F.lit(0.0))), 6).alias(f"sum_{name}"), F.count("*").alias(f"n_{name}"))

    out = pairs.select(*keys).join(side(q_tokens, s_tokens, "r_extra", "extra"), keys, "left").join(side(s_tokens, q_tokens, "r_miss", "miss"), keys, "left")
    return out.select(*keys, F.coalesce("max_extra", F.lit(-99.0)).alias("max_extra"), F.coalesce("sum_extra", F.lit(0.0)).alias("sum_extra"), F.coalesce("n_extra", F.lit(0)).alias("n_extra"),
                      F.coalesce("max_miss", F.lit(-99.0)).alias("max_miss"), F.coalesce("sum_miss", F.lit(0.0)).alias("sum_miss"))


def legal_risk(pairs: DataFrame, lq: str, ls: str, relation: str, label: str, least: int = 20) -> DataFrame:
    """(lq, ls, relation, n, risk): the cell's log odds, or its relation's where the cell has fewer than ``least`` pairs."""
    count = lambda keys: pairs.groupBy(*keys).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    cell, pooled = count([lq, ls, relation]), count([relation]).select(relation, F.col("pos").alias("rp"), F.col("neg").alias("rn"))
    met = cell.join(pooled, relation)
    own, wide = F.log((F.col("neg") + 1) / (F.col("pos") + 1)), F.log((F.col("rn") + 1) / (F.col("rp") + 1))
    return met.select(F.col(lq).alias("lq"), F.col(ls).alias("ls"), F.col(relation).alias("relation"), (F.col("pos") + F.col("neg")).alias("n"), F.round(F.when(F.col("pos") + F.col("neg") >= least, own).otherwise(wide), 6).alias("risk"))


def back_off(vocab: DataFrame, risks: DataFrame, least: int = 20, median_least: int = 100) -> DataFrame:
    """Risks for every (country, t) of ``vocab`` (country, t, df): the country's own; for a country without any, the mean over the others where
    df >= ``least``, else the median over tokens of df >= ``median_least``; a known country's unseen token gets 0."""
    known = risks.select("country").distinct().withColumn("known", F.lit(True))
    base = vocab.join(risks.select("country", "t", "r_extra"), ["country", "t"], "left").join(known, "country", "left")
    learned = vocab.join(risks.select("country", "t", "r_extra"), ["country", "t"])
    pooled = learned.where(F.col("df") >= least).groupBy("t").agg(F.avg("r_extra").alias("mean"))
    middle = learned.where(F.col("df") >= median_least).agg(F.median("r_extra").alias("middle"))
    met = base.join(pooled, "t", "left").join(F.broadcast(middle))
    value = F.when(F.col("known"), F.coalesce("r_extra", F.lit(0.0))).otherwise(F.coalesce("mean", "middle", F.lit(0.0)))
    return met.select("country", "t", "df", F.round(value, 6).alias("risk"))


def shrunk_rate(rows: DataFrame, keys: list[str], hit: Column, prior: float = 20.0) -> DataFrame:
    """(keys, n, rate): hits per key shrunk to the overall rate by ``prior`` rows."""
    overall = rows.agg(F.avg(hit.cast("double")).alias("mu"))
    per = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(hit.cast("long")).alias("hits"))
    return per.join(F.broadcast(overall)).select(*keys, "n", F.round((F.col("hits") + prior * F.col("mu")) / (F.col("n") + prior), 6).alias("rate"))

"""Macro F0.5 over entities, sweeps of a threshold, recall of a blocking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entity_scores(predicted: DataFrame, truth: DataFrame, entities: DataFrame, beta2: float = 0.25) -> DataFrame:
    """(s, f) per entity; an entity without true links scores 1 if nothing is predicted, else 0. ``predicted`` and ``truth`` have distinct (q, s)."""
    hit = predicted.join(truth, ["q", "s"]).groupBy("s").agg(F.count("*").alias("hit"))
    n_pred = predicted.groupBy("s").agg(F.count("*").alias("n_pred"))
    n_true = truth.groupBy("s").agg(F.count("*").alias("n_true"))
    met = entities.join(n_true, "s", "left").join(n_pred, "s", "left").join(hit, "s", "left").fillna(0, ["n_true", "n_pred", "hit"])
    f = F.when(F.col("n_true") == 0, (F.col("n_pred") == 0).cast("double")).when(F.col("hit") == 0, 0.0).otherwise((1 + beta2) * F.col("hit") / (beta2 * F.col("n_true") + F.col("n_pred")))
    return met.withColumn("f", f)


def macro_f(predicted: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    return entity_scores(predicted, truth, entities).agg(F.count("*").alias("n_entities"), F.round(F.avg("f"), 6).alias("macro_f05"))


def threshold_sweep(best: DataFrame, truth: DataFrame, entities: DataFrame, thresholds: list[float], country: str = "country") -> DataFrame:
    """(thr, country or null for all, n, macro_f05): every entity under every threshold, rolled up with grouping sets."""
    spark = best.sparkSession
    thr = F.broadcast(spark.createDataFrame([(t,) for t in thresholds], "thr double"))
    flagged = best.join(truth.withColumn("hit", F.lit(1)), ["q", "s"], "left")
    per = flagged.join(thr, F.col("p") >= F.col("thr")).groupBy("thr", "s").agg(F.count("*").alias("n_pred"), F.count("hit").alias("hit"))
    n_true = truth.groupBy("s").agg(F.count("*").alias("n_true"))
    grid = entities.join(n_true, "s", "left").join(thr)
    met = grid.join(per, ["thr", "s"], "left").fillna(0, ["n_true", "n_pred", "hit"])
    f = F.when(F.col("n_true") == 0, (F.col("n_pred") == 0).cast("double")).when(F.col("hit") == 0, 0.0).otherwise(1.25 * F.col("hit") / (0.25 * F.col("n_true") + F.col("n_pred")))
    return met.withColumn("f", f).groupingSets([["thr"], ["thr", country]], "thr", country).agg(F.count("*").alias("n"), F.round(F.avg("f"), 6).alias("macro_f05"))


def blocking_recall(pairs: DataFrame, truth: DataFrame, rank: str, ks: list[int]) -> DataFrame:
    """(k, n_true, n_found, recall) of true links among candidates of rank below k."""
    spark = pairs.sparkSession
    k = F.broadcast(spark.createDataFrame([(x,) for x in ks], "k int"))
    at = truth.join(pairs.groupBy("q", "s").agg(F.min(rank).alias("r")), ["q", "s"], "left")
    return at.join(k).groupBy("k").agg(F.count("*").alias("n_true"), F.count_if(F.col("r") < F.col("k")).alias("n_found")).withColumn("recall", F.round(F.col("n_found") / F.col("n_true"), 6))

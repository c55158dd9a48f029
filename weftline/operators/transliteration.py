"""A dictionary of words in scripts of India learned from labelled pairs of names, and one spelling for variants of the same word.

Names with equally many words are aligned by position. A word maps to its most frequent partner, ties to the first of the alphabet. Spellings that share a word (each with at
least ``share`` of it) are joined by connected components and take the first spelling of the alphabet. Legal words are never joined. Null names align with nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.components import components

_INDIC = "[\\u0900-\\u0DFF]"
# Words never taken as variants of each other.
NEVER_JOINED = "limited ltd private pvt al all".split()


def aligned_words(pairs: DataFrame, latin: str, indic: str) -> DataFrame:
    """(word, partner, n)."""
    a, b = F.split(F.lower(F.trim(latin)), "(?U)\\s+"), F.split(F.trim(indic), "(?U)\\s+")
    met = pairs.where(F.col(indic).rlike(_INDIC)).select(a.alias("a"), b.alias("b")).where(F.size("a") == F.size("b"))
    each = met.select(F.explode(F.arrays_zip("a", "b")).alias("z")).select(F.regexp_replace("z.a", "[^a-z0-9&]", "").alias("partner"), F.col("z.b").alias("word"))
    return each.where(F.col("word").rlike(_INDIC) & (F.col("partner") != "")).groupBy("word", "partner").agg(F.count("*").alias("n"))


def learn(pairs: DataFrame, latin: str, indic: str, share: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(word, canon): the word map, and (spelling, canon) of variants whose spelling isn't the canonical one."""
    counted = aligned_words(pairs, latin, indic)
    per = counted.groupBy("word").agg(F.sum("n").alias("total"), F.min(F.struct(-F.col("n"), F.col("partner"))).alias("best"))
    words = per.select("word", F.col("best.partner").alias("canon"))
    often = counted.join(per, "word").where(F.col("n") >= share * F.col("total")).select(F.col("best.partner").alias("a"), F.col("partner").alias("b"))
    links = often.where((F.col("a") != F.col("b")) & ~F.col("a").isin(*NEVER_JOINED) & ~F.col("b").isin(*NEVER_JOINED))
    variants = components(links).where("node <> component").select(F.col("node").alias("spelling"), F.col("component").alias("canon"))
    return words, variants

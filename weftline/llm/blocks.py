"""Pairs of forms that share a block key: all of them, whatever the size of a block.

A form stands in a block with a role. ``BOTH`` forms meet each other. A form that lacks a part (``BARE``) stands in the wide block of its key and meets every form there, while forms with the part
(``WHOLE``) stand in the wide block to be met and meet each other in a narrow block of their own, whose key holds the part. So the forms of one trade are compared with those of that trade and with
those of no trade, and a block is as small as the condition on its pairs allows.

A block is dealt to parts by hash, and each pair of parts is a group of its own: no task meets a whole block, and none is cut, ranked or sampled. What is left is work quadratic in the forms
(different spellings, not rows) of a narrow block; ``may`` drops pairs in the join itself, before anything is exchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import cut

SCHEMA = "key string, form string, role int"
BOTH, BARE, WHOLE = 0, 1, 2


def every_pair(rows: DataFrame, may: Callable[[Column, Column], Column] | None = None, part: int = 256) -> DataFrame:
    """(x, y) with x < y, each once, of rows of SCHEMA that meet in a block; of those only where ``may`` holds. Repeated rows count once; without rows there is no pair."""
    asks = F.col("role") <= BARE
    sizes = rows.groupBy("key").agg(F.count_if(asks).alias("n_ask"), F.count("*").alias("n_all")).where("n_ask > 0 and n_all > 1")
    parts = sizes.select("key", F.ceil(F.col("n_ask") / part).cast("int").alias("pa"), F.ceil(F.col("n_all") / part).cast("int").alias("pb"))
    dealt = cut(rows.join(parts, "key").withColumn("h", F.xxhash64("form")))
    # The group (i, j) holds part i of those who ask and part j of all.
    left = dealt.where(asks).select("key", F.pmod("h", "pa").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("pb") - 1)).alias("j"), F.col("form").alias("a"), F.col("role").alias("ra"))
    right = dealt.select("key", F.explode(F.sequence(F.lit(0), F.col("pa") - 1)).alias("i"), F.pmod("h", "pb").cast("int").alias("j"), F.col("form").alias("b"), F.col("role").alias("rb"))
    met = left.join(right, ["key", "i", "j"]).where("case when ra = rb then a < b else a <> b and ra = 1 and rb = 2 end")
    if may is not None:
        met = met.where(may(F.col("a"), F.col("b")))
    return met.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()

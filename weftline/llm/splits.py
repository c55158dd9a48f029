"""Train, validation and test splits that keep related records together.

Rows that share a key or a listed value, directly or through others, form a component (hooking and shortcutting over parent tables). The
splits are chosen over the histogram of component sizes: for every size its multiplicity is cut into powers of two, a bitset of reachable
row totals is shifted by each part, and the reachable total closest to the wanted one is traced back to a number of components per size.
The smaller splits are chosen first, each from what the others left; the largest split gets the rest.

The histogram has at most sqrt(2 * rows) sizes. Bitsets reach to the wanted total of a split only; where that is
above ``max_bits`` rows, whole batches of components of each size are first given in proportion, which leaves a remainder that
the bitset decides exactly.

Within one size components are taken in the order of a hash, counted by hash prefix first, so that no task ranks all components of size 1.
Rows with a null key are in no component. Repeated rows count as rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.operators.components import components
from weftline.session import cut


def linked(rows: DataFrame, key: str, pairs: DataFrame, pair_key: str, pair_value: str) -> DataFrame:
    """(key, component) of every distinct non-null key; keys are joined by equal values of ``pairs``."""
    edges = pairs.select(F.concat(F.lit("k"), pair_key).alias("a"), F.concat(F.lit("v"), pair_value).alias("b"))
    comp = components(edges).where(F.col("node").startswith("k")).select(F.expr("substring(node, 2)").alias(key), F.col("component").alias("__c"))
    keys = rows.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull()).distinct()
    return keys.join(comp, key, "left").select(key, F.coalesce(F.substring("__c", 2, 1_000_000), F.col(key)).alias("component"))


def closest(sizes: dict[int, int], target: int) -> dict[int, int]:
    """How many components of each size come closest to ``target`` rows together; of two equally close totals the lower one."""
    limit = target + max(sizes, default=0)
    mask = (1 << (limit + 1)) - 1
    reach, steps = 1, []
    for size, many in sorted(sizes.items(), reverse=True):
        part = 1
        while many > 0:
            take = min(part, many)
            steps.append((size, take, reach))
            reach |= (reach << (size * take)) & mask
            many -= take
            part *= 2
    best = next(t for d in range(limit + 1) for t in (target - d, target + d) if 0 <= t <= limit and reach >> t & 1)
    chosen: dict[int, int] = {}
    for size, take, before in reversed(steps):
        if not before >> best & 1:
            chosen[size] = chosen.get(size, 0) + take
            best -= size * take
    return chosen


def plan(sizes: dict[int, int], shares: dict[str, float], max_bits: int = 50_000_000) -> dict[str, dict[int, int]]:
    """Components per split and size; the split of the largest share takes what is left."""
    left, total, out = dict(sizes), sum(s * n for s, n in sizes.items()), {}
    order = sorted(shares, key=lambda k: (shares[k], k))
    for name in order[:-1]:
        target, given = round(total * shares[name]), {}
        if target > max_bits:
            part = (target - max_bits // 2) / total
            given = {s: min(left[s], int(n * part)) for s, n in sizes.items()}
            target -= sum(s * n for s, n in given.items())
        rest = {s: n - given.get(s, 0) for s, n in left.items()}
        exact = closest(rest, target)
        out[name] = {s: given.get(s, 0) + exact.get(s, 0) for s in left}
        left = {s: n - out[name][s] for s, n in left.items()}
    out[order[-1]] = left
    return out


def assign(rows: DataFrame, key: str, groups: DataFrame, shares: dict[str, float], prefix_bits: int = 8) -> DataFrame:
    """(key, component, split) of every key of ``groups``, sized by the rows of ``rows``."""
    spark = rows.sparkSession
    per_key = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias(key)).agg(F.count("*").alias("n"))
    sized = groups.join(per_key, key).groupBy("component").agg(F.sum("n").alias("size"))
    place = F.xxhash64("component")
    sized = cut(sized.select("component", "size", place.alias("h"), F.shiftrightunsigned(place, 64 - prefix_bits).alias("bucket")))
    counts = sized.groupBy("size", "bucket").agg(F.count("*").alias("n")).collect()
    histogram: dict[int, int] = {}
    for r in counts:
        histogram[r["size"]] = histogram.get(r["size"], 0) + r["n"]
    chosen = plan(histogram, shares)
    names = sorted(shares, key=lambda k: (shares[k], k))
    bounds, seen = [], {}
    for r in sorted(counts, key=lambda r: (r["size"], r["bucket"])):
        before = seen.get(r["size"], 0)
        seen[r["size"]] = before + r["n"]
        bounds.append((r["size"], r["bucket"], before))
    starts = spark.createDataFrame(bounds, "size long, bucket long, before long")
    cuts = []
    for size in histogram:
        at = 0
        for name in names:
            n = chosen[name].get(size, 0)
            if n:
                cuts.append((size, at, at + n, name))
            at += n
    limits = spark.createDataFrame(cuts, T.StructType([T.StructField(c, T.LongType()) for c in ("csize", "low", "high")] + [T.StructField("split", T.StringType())]))
    within = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("h", "component"))
    ranked = sized.withColumn("r", within - 1).join(F.broadcast(starts), ["size", "bucket"]).withColumn("r", F.col("r") + F.col("before"))
    given = ranked.join(F.broadcast(limits), (F.col("size") == F.col("csize")) & (F.col("r") >= F.col("low")) & (F.col("r") < F.col("high")))
    return groups.join(given.select("component", "split"), "component").select(key, "component", "split")

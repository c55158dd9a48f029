"""Connected components by hooking and shortcutting over parent tables.

Each round joins the edges to the parents of their ends, hooks every root that has an edge onto its least
neighbouring root, shortcuts the hooks by pointer doubling, and contracts the edges onto the new roots.
Contracted edges are de-duplicated, so the table shrinks at least by half of its roots per round. The node
table is relabelled once per round. Every table of a round is cut by a checkpoint.

Nodes are of any orderable type. The component is named by its least node. Null ends and loops are ignored.
A hub with a third of all edges is met only by joins against unique keys (a split of the hub's rows over tasks
needs no copy of a large side) and by pre-aggregated minima.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut, release


def _shortcut(hooks: DataFrame) -> DataFrame:
    """(node, parent), parent < node, to (node, root)."""
    before: DataFrame | None = None
    while True:
        up = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        longer = hooks.join(up, "parent", "left")
        nxt = cut(longer.select("node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")))
        if before is not None:
            release(before)
        before, hooks = nxt, nxt.select("node", "parent")
        if not nxt.where("moved").limit(1).count():
            return hooks


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge.

    Empty input gives an empty result; repeated edges and edges in both directions count once.
    """
    x, y = F.col(a), F.col(b)
    live = cut(
        edges.where(x.isNotNull() & y.isNotNull() & (x != y))
        .select(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi"))
        .distinct()
    )
    parents: DataFrame | None = None
    while live.limit(1).count():
        hooks = live.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("parent"))
        roots = _shortcut(hooks)
        if parents is None:
            least = live.select(F.col("lo").alias("node")).distinct().join(roots, "node", "left_anti")
            parents = cut(roots.unionByName(least.withColumn("parent", F.col("node"))))
        else:
            onto = roots.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
            parents = cut(parents.join(onto, "parent", "left").select("node", F.coalesce("root", "parent").alias("parent")))
        lo = roots.select(F.col("node").alias("lo"), F.col("parent").alias("lo_root"))
        hi = roots.select(F.col("node").alias("hi"), F.col("parent").alias("hi_root"))
        moved = live.join(hi, "hi").join(lo, "lo", "left").select(F.coalesce("lo_root", "lo").alias("p"), F.col("hi_root").alias("q"))
        live = cut(moved.where("p <> q").select(F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi")).distinct())
    if parents is None:
        return live.select(F.col("lo").alias("node"), F.col("hi").alias("component"))
    return parents.select("node", F.col("parent").alias("component"))


def pairs_within(members: DataFrame, group: str, item: str, a: str, b: str) -> DataFrame:
    """Each pair of different items of one group, the smaller first.

    Asked of result tables whose definition is all pairs; groups of one item never reach the join.
    """
    m = members.select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    left, right = m.withColumnRenamed("i", a), m.withColumnRenamed("i", b)
    return left.join(right, "g").where(F.col(a) < F.col(b)).select(a, b)

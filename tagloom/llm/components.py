"""Connected components by stars, for links of any number and hubs of any degree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) of every node of `edges` (a, b).

    Rounds of large and small stars: every node links its neighbours to the least of them. Hubs
    are combined before the shuffle and joined, never gathered. Each round is checkpointed; the
    end is reached when a round changes nothing.
    """
    tidy = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = checkpointed(tidy.distinct())
    before = _state(now)
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("b", "m").where("b <> m").toDF("a", "b")
        now = checkpointed(small.union(least).toDF("a", "b").distinct())
        after = _state(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.toDF("node", "root").union(roots)


def _state(edges: DataFrame) -> tuple:
    # Exact sums, so that equal sets of edges give equal states.
    hashed = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(hashed)).first())

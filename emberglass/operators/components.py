"""Connected components of a link table, by large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

SALTS = 8


def _min_per_hub(pairs: DataFrame, keep) -> DataFrame:
    """``(a, b, m)`` for the kept ``pairs``: m is the least neighbour of a (or a itself).

    A hub may hold most pairs, so its minimum comes from a pre-aggregated table and meets the pairs over
    (hub, salt): no task gets a whole hub.
    """
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pairs.where(keep).withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(salted, ["a", "salt"]).select("a", "b", "m")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, rep)`` for every node of ``links(u, v)``; rep is the least node of its component.

    Null ends and loops add nothing; repeated links count once; an empty link table gives an empty result.
    The number of rounds grows with the logarithm of the nodes, each round is written to the checkpoint
    folder, and only a count and a hash come to the driver. Fails when ``max_rounds`` do not suffice.
    """
    edges = cut(links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(edges)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _min_per_hub(both, F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # a hub that is itself the least of its neighbourhood keeps no link to itself; its neighbours link to it
        small = _min_per_hub(large, F.lit(True))
        ends = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        edges = cut(ends.where("a <> b").distinct())
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components: not settled")
    reps = edges.select(F.col("a").alias("node"), F.col("b").alias("rep"))
    return reps.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("rep")).distinct())

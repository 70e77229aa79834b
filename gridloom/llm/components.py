"""Connected components of a link table, by alternating large-star and small-star.

Each round is a few aggregates and joins; results of a round are written to
the shared folder, so lineage stays short and lost executors cost one round.
A hub with very many links is a hot key of a join only, never of a window or a
collected group, so adaptive execution can split it.  Nothing is collected.
Rounds go on until one changes nothing (some log n of them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import drop_written, written


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
    return int(r[0]), int(r[1] or 0)


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` (the smallest node reachable) for every node of ``edges(u, v)``.

    Repeated links, both directions and links of a node to itself are fine (a
    node with none but the latter has no row); rows with a null end are no
    links; an empty table gives an empty result.
    """
    links = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = written(links.distinct(), "cc")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc")
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc")
        smallest = written(large.groupBy("u").agg(F.min("v").alias("m")), "cc")
        joined = large.join(smallest, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(smallest.select("u", F.col("m").alias("v")))
        after = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
        for done in (now, least, large, smallest):
            drop_written(done)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    roots = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

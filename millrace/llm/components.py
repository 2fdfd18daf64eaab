"""Connected components of an edge table, without gathering anything on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import staged


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(``node``, ``component``) for every node of an edge; the component is its smallest node.

    Alternates two contractions until nothing changes: every node hands its larger neighbours,
    then its smaller ones, to its smallest neighbour. Both are one aggregate and one join, and the
    number of rounds grows with the logarithm of the number of nodes. Rounds are written to the
    shared folder, so that a lost executor repeats at most one of them.
    """
    pairs = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct()
    current, state = staged(pairs, "edges"), None
    while True:
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            current.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi")
        current = staged(
            small.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(down.select("hi", F.col("m").alias("lo")))
            .where("lo < hi")
            .distinct(),
            "edges",
        )
        found = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)")).alias("h")).first()
        if (found["n"], found["h"]) == state:
            break
        state = (found["n"], found["h"])
    roots = current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return roots.unionByName(current.select(F.col("hi").alias("node"), F.col("lo").alias("component")))

"""Connected components of an edge table, without links or labels on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datagauge.llm.frames import discard, stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component_id) of every id in an edge: the smallest id that its links reach.

    edges has columns a and b. Rounds alternate: each node's larger neighbours are linked to its smallest
    neighbour, then each node's links to smaller ones are; both sums are partial, the
    table of a round is written to the shared folder, and it ends when the links are stars.
    Null ends and loops are ignored; repeated links count once.
    """
    links = edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x <> y").distinct()
    links, before = stored(links, "links"), None
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        # large star: neighbours greater than a node get its smallest neighbour
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        # small star: a node's smaller neighbours get the smallest of them
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(F.explode(F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e")).select("e.*").where("x <> y").distinct()
        after = stored(small, "links")
        same = after.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        old, links = links, after
        discard(old)
        if before is not None and tuple(same) == before:
            break
        before = tuple(same)
    else:
        raise RuntimeError("links did not become stars")
    return links.select(F.col("x").alias("id"), F.col("y").alias("component_id")).unionByName(links.select(F.col("y").alias("id"), F.col("y").alias("component_id")).distinct())

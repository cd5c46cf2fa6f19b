"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import free, settle


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b), written; the component is its smallest node.

    Each step sends every node's neighbours to its smallest neighbour; partial aggregation absorbs nodes with very many links. The links are
    written to the shared folder after each pair of steps, so the lineage stays short, and the loop ends when a pair changes nothing. Components
    with a few nodes end in two or three rounds, and long chains halve in each.
    """
    now = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    state = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        before, now = now, settle(small, "links")
        free(before)
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (row[0], row[1]) == state:
            break
        state = (row[0], row[1])
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component")))
    joined = settle(out, "joined")
    free(now)
    return joined

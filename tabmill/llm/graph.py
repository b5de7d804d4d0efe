"""Connected components of a large graph, by alternating star operations on a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabmill.llm.text import shared_table


def components(edges: DataFrame) -> DataFrame:
    """v, root for every vertex of edges (x, y); root is the smallest vertex of v's component.

    Edges are kept as (u, v) with v < u. In the large-star step each vertex ties its larger neighbours to the smallest one it
    knows; in the small-star step, its smaller neighbours and itself. Both keep components as they are and end in stars. No
    step gathers a vertex's neighbours: minima are aggregated and joined back. Every round is written to the shared folder.
    """
    e = edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct()
    e = shared_table(e, "edges")
    before = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or now[0] == 0:
            break
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = shared_table(tied.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return e.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(e.select("v", F.col("v").alias("root")).distinct())

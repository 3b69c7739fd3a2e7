"""Connected components over an edge table.

Alternates two star contractions until the edges form one star per component.
Each half step is two shuffles with partial aggregation; hubs are never
gathered, since a neighbourhood enters only as its minimum, and the joins read
written tables on both sides, so that adaptive execution can split a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.runtime import drop_tables, write_table


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Columns ``node`` and ``component`` (the smallest node reachable) for every node with an edge, as a written table.

    Null ends, loops and repeated edges are ignored; an empty input gives no rows.
    """
    a, b = F.col(src), F.col(dst)
    links = write_table(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "edges",
    )
    before, state = None, _digest(links)
    while state != before and state[0]:
        both = links.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(links.select(F.col("v").alias("a"), F.col("u").alias("b")))
        low = write_table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = write_table(both.where("b > a").join(low, "a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = write_table(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        done = write_table(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        drop_tables(low, large, least, links)
        links, before, state = done, state, _digest(done)
    members = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = write_table(members.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    drop_tables(links)
    return found

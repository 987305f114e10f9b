"""Connected components of links, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.work import forget, new_path, write_to


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches.

    edges has two columns of one orderable type. Rounds of large-star and
    small-star leave a forest of stars after about log n rounds; each round is
    aggregations with map-side combination and a join that adaptive execution
    can split, then a table in the shared folder that cuts the lineage; the
    table of the round before goes. Rows with a null, loops and repeated
    rows change nothing; an empty table gives an empty one. A node without a
    link to another has no row.
    """
    a, b = edges.columns[:2]
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    spark = edges.sparkSession
    last = new_path(spark, "links")
    now = write_to(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), last)
    state = None
    for _ in range(max_rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not seen[0] or tuple(seen) == state:
            break
        state, path = tuple(seen), new_path(spark, "links")
        now = write_to(_small_star(_large_star(now)), path)
        forget(spark, last)
        last = path
    else:
        raise RuntimeError("the components didn't settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

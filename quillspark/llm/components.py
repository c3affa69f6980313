"""Connected components by alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond")."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_kept, keep


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("dst", "src")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("src"), F.col("m").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges come as (larger, smaller)."""
    least = edges.groupBy("src").agg(F.min("dst").alias("m"))
    moved = edges.join(least, "src").filter("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.union(least.select("src", F.col("m").alias("dst")))


def connected_components(links: DataFrame) -> DataFrame:
    """`links`: src and dst, two comparable columns of one type. Returns (node, root) for every node but the roots themselves, root being the smallest node reachable.

    Each round is two shuffles on node ids, written to the shared folder; the edges in flight never exceed the links. A hub's edges
    stand in a sort-merge join that adaptive execution can split. Rounds grow with the logarithm of a component's size.
    Self-links and links with a null end are ignored; no links give no rows.
    """
    edges = (
        links.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    )
    edges = keep(edges, "links")
    state = None
    while True:
        moved = keep(_small_star(_large_star(edges).distinct()).distinct(), "stars")
        now = moved.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        drop_kept(edges)
        edges = moved
        if tuple(now) == state or now[0] == 0:
            out = edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
            out._kept_at = edges._kept_at  # so that drop_kept() can delete it once it has been used
            return out
        state = tuple(now)

"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, join_groups


#: Edges beyond which the centres of large stars are joined apart; fewer fit in any one task.
MANY_EDGES = 1_000_000


def _star(edges: DataFrame, large: bool, many: bool) -> DataFrame:
    """One star step over edges (a > b). Hot nodes: the minimum is pre-aggregated and, of hot nodes, broadcast."""
    if large:
        around = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges
    least = around.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("a", "m"))
    joined = join_groups(around, cut(least), "a") if many else around.join(least.drop("n"), "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
    return out.where("a != b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """The component of each node that has a link: (node, comp), comp being its smallest node.

    Nulls and self-links are no links. Only a checksum of each round's edges reaches the driver. Rounds
    grow with the logarithm of the nodes; each is written to the shared folder, where it replaces the last.
    """
    edges = cut(
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct()
    )
    seen = None
    for _ in range(max_rounds):
        row = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.max("b")
        ).first()
        if row == seen or not row[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
            )
        seen, many, last = row, row[0] > MANY_EDGES, edges
        edges = cut(_star(_star(edges, True, many), False, many))
        drop(last)
    raise RuntimeError("components did not settle")

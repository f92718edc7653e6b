"""Connected components by alternating star contraction, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


#: Graphs of fewer links are contracted without regard to hubs.
SMALL = 10_000


def _with_least(edges: DataFrame, least: DataFrame, hub: int | None) -> DataFrame:
    """``edges`` with ``m`` of their ``u`` from ``least`` (``u, m, n``).

    Nodes of more than ``hub`` links are so few that their rows are broadcast, and
    their links stay where they are; only the others' are joined by node.
    """
    if hub is None:
        return edges.join(least.select("u", "m"), "u")
    big = F.broadcast(least.where(F.col("n") > hub).select("u", "m"))
    rest = edges.join(F.broadcast(least.where(F.col("n") > hub).select("u")), "u", "left_anti")
    return edges.join(big, "u").select("u", "v", "m").unionAll(rest.join(least.where(F.col("n") <= hub).select("u", "m"), "u").select("u", "v", "m"))


def _large_star(edges: DataFrame, hub: int | None) -> DataFrame:
    """Join each larger neighbour of a node to the node's smallest neighbour, itself included."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return _with_least(both, least, hub).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, hub: int | None) -> DataFrame:
    """Join the smaller neighbours of a node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(down, least, hub).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` links to ``(node, root)``: the smallest node of each component.

    Nodes without a link are absent, self-links are ignored, no links give no
    rows. A round contracts stars, so rounds grow with the logarithm of the
    longest path. Every round is written to the shared folder. Minima are
    aggregated before the shuffle. The links of a node with more than a quarter of a
    partition's share are not dealt by node; there are at most eight such nodes for each partition.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(now)
    while state[0]:
        hub = max(1000, state[0] // (4 * parts)) if state[0] > SMALL else None
        after = materialize(_small_star(_large_star(now, hub), hub), "links")
        new = _state(after)
        discard(now)
        now = after
        if new == state:
            break
        state = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

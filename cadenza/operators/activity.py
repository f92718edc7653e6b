"""Stretches of activity in a row of energies: two thresholds, and pauses that are too short to end one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Root mean squares that begin and that keep up activity, and windows of silence that end it (500 ms of 20 ms).
HIGH, LOW, SILENCE = 0.02, 0.01, 25


def islands(windows: DataFrame, low: float, high: float, block: int) -> DataFrame:
    """``file, first, last, loud``: runs of windows of at least ``low``, cut at ``block`` windows; ``loud`` if one reaches ``high``.

    ``windows`` are ``file, window, energy`` with each window once; a missing one is silent. Runs are found
    within a block of a file, so a file of any length is many tasks' work.
    """
    live = windows.where(F.col("energy") >= low).select("file", "window", (F.col("energy") >= high).alias("loud"), F.floor(F.col("window") / block).alias("block"))
    order = Window.partitionBy("file", "block").orderBy("window")
    run = F.col("window") - F.row_number().over(order)  # the same along a run
    return live.withColumn("run", run).groupBy("file", "block", "run").agg(F.min("window").alias("first"), F.max("window").alias("last"), F.max("loud").alias("loud")).select("file", "first", "last", "loud")


def joined(runs: DataFrame, gap: int) -> DataFrame:
    """Runs of a file with fewer than ``gap`` windows between them as one."""
    order = Window.partitionBy("file").orderBy("first")
    new = F.coalesce(F.col("first") - F.lag("last").over(order) > gap, F.lit(True)).cast("int")
    return runs.withColumn("new", new).withColumn("group", F.sum("new").over(order)).groupBy("file", "group").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("loud").alias("loud")).drop("group")


def segments(windows: DataFrame, low: float = LOW, high: float = HIGH, silence: int = SILENCE, block: int = 1 << 14) -> DataFrame:
    """``file, first, last``: active stretches of windows.

    A stretch begins with a run of windows of at least ``low`` that reaches ``high`` somewhere, and goes on over pauses of
    fewer than ``silence`` windows to the next such run. Runs that blocks have cut are put together
    first; windows over a file see its runs, not its windows. Null energies are silent.
    """
    whole = joined(islands(windows, low, high, block), 1)
    return joined(whole.where("loud"), silence).select("file", "first", "last")

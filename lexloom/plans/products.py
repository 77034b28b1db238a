"""Products that are a result's own size, without one key that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row of ``left`` with each of ``right``, for results that hold every such pair.

    The left rows are dealt over as many tasks as a shuffle has, and each task gets the right ones; the smaller side
    belongs on the right.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.withColumn("_part", F.pmod(F.xxhash64(*left.columns), F.lit(tasks)))
    copies = right.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))))
    return dealt.join(copies, "_part").drop("_part")

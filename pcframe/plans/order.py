"""Dense numbers in order, without a window over the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pcframe.plans.search import keep

_PLACE = 33  # bits that monotonically_increasing_id() leaves to a row's place in its partition


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with its rows' numbers, from 0, in order of the keys, which should be unique.

    Rows are range-partitioned and sorted once and kept; each partition numbers its own, and adds
    what the partitions before have, of which there is a row a partition. No key, however many
    rows share it in part, makes one task take them all.
    """
    rows = keep(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", _PLACE)
    sizes = rows.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    sizes = F.broadcast(sizes.select("__p", before.alias("__before")))
    number = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << _PLACE) - 1))
    return rows.join(sizes, part == F.col("__p")).withColumn(name, number).drop("__at", "__p", "__before")

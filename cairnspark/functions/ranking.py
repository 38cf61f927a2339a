"""Places in one order of all rows, without one task that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnspark.functions.reuse import settled


def numbered(df: DataFrame, *order: Column | str, name: str = "rn") -> DataFrame:
    """df with a column `name`: the row's place from 1 in the order given, ties in any order.

    Rows are dealt by ranges of the order and numbered range by range; the sizes of the ranges before, one number a
    range, are added.
    """
    dealt = settled(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a range
    sizes = sizes.select("__range", before.alias("__before"))
    own = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    return dealt.join(F.broadcast(sizes), "__range").withColumn(name, own + F.col("__before")).drop("__range", "__before")

"""Numbers of rows in a total order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored


def numbered(rows: DataFrame, *order, name: str = "place") -> DataFrame:
    """``rows`` with their numbers, from 0, in ``order``.

    Rows are dealt by ranges and numbered in each; what the ranges before hold is
    added. Only the sizes of ranges come to the driver.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = stored(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "numbered")
    before, begins = 0, []
    for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        begins += [F.lit(r["_part"]), F.lit(before).cast("long")]
        before += r["n"]
    begin = F.element_at(F.create_map(*begins), F.col("_part")) if begins else F.lit(0).cast("long")
    return dealt.withColumn(name, F.col("_at") + begin).drop("_part", "_at")

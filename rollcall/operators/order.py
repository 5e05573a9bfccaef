"""One order over all rows of a table, however they are dealt out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, by: list[str], folder: str, start: int = 0, out: str = "ordinal") -> tuple[DataFrame, int]:
    """df with gapless numbers from `start` in the order of `by`, and how many rows there are.

    Rows are dealt out in ranges of `by` and written to `folder`, each with its task and its place there; a task's rows then
    begin where those of the tasks before it end. What is summed up is one count a task. Rows that are equal in `by` should
    be equal altogether, as it isn't set which of them comes first. Null comes first.
    """
    spark = df.sparkSession
    laid = df.repartitionByRange(*[F.col(c) for c in by]).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    laid.write.parquet(folder)
    laid = spark.read.schema(laid.schema).parquet(folder).withColumn("_task", F.shiftright("_at", 33))
    counts = laid.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    n = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    rows = laid.join(F.broadcast(counts), "_task").withColumn(out, F.lit(start) + F.col("_before") + place)
    return rows.select(*df.columns, out), n

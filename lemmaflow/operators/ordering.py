"""Places of rows in a total order, without one task that holds them all, and files in that order."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.session import written_once


def in_ranges(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with _part: the number of the range of ``order`` that a row lies in; written, so that numbers stay."""
    return written_once(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def offsets(ranged: DataFrame, **sums: Column) -> DataFrame:
    """_part, and for each of ``sums`` its total over all earlier parts. One row for each range, few as they are."""
    totals = ranged.groupBy("_part").agg(*[c.alias(n) for n, c in sums.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums])


def positions(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``rows`` with their place, from 0, in ``order``, which must tell rows apart.

    Rows are dealt into ranges; a place is the rank in the range and the count of the ranges before.
    """
    ranged = in_ranges(rows, order)
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    before = F.broadcast(offsets(ranged, _before=F.count(F.lit(1))))  # a row for each range
    return ranged.join(before, "_part").withColumn(name, (F.col("_before") + rank - 1).cast("long")).drop("_part", "_before")


def write_in_order(rows: DataFrame, order: list[Column], path: str) -> None:
    """Text files of JSON lines: read by name, they have the rows in ``order``."""
    lines = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)

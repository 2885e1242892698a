"""Row numbers over a whole table, without a single-task window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.session import checkpointed


def global_row_number(df: DataFrame, order: list, name: str, parts: int | None = None) -> DataFrame:
    """Number the rows 1..n in the given order (which should be unique).

    The rows are range-partitioned and sorted, numbered inside each partition, and shifted by the
    row counts of the partitions before it. Only those counts, one per partition, go through one
    task. The checkpoint fixes the partition bounds, so that both passes see the same ones.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("__at", F.monotonically_increasing_id())
    )
    part = F.shiftright("__at", 33).alias("__part")
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1).cast("bigint"))
    before = F.coalesce(
        F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = placed.groupBy(part).agg(F.count("*").alias("__n")).select("__part", before.alias("__before"))
    return (
        placed.withColumn("__part", F.shiftright("__at", 33))
        .join(offsets, "__part")
        .withColumn(name, inside + F.col("__before") + 1)
        .drop("__at", "__part", "__before")
    )


def global_running_sum(df: DataFrame, order: list, value: str, name: str, parts: int | None = None) -> DataFrame:
    """The sum of ``value`` over all rows before each one, in the given order (which should be unique).

    As ``global_row_number``: sums inside range partitions, shifted by the sums of the partitions before.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = checkpointed(sorted_.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)))
    inside = F.sum(value).over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    earlier = F.sum("__t").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = placed.groupBy("__part").agg(F.sum(value).alias("__t")).select("__part", F.coalesce(earlier, F.lit(0)).alias("__before"))
    summed = placed.withColumn("__in", F.coalesce(inside, F.lit(0))).join(offsets, "__part")
    return summed.withColumn(name, F.col("__in") + F.col("__before")).drop("__at", "__part", "__in", "__before")


def row_number_within(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """Row numbers per key for keys that may be hot: the global number minus the first of the key."""
    numbered = global_row_number(df, [*keys, *order], "__rn")
    first = numbered.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min("__rn").alias("__first"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return numbered.join(first, same).select(*df.columns, (F.col("__rn") - F.col("__first") + 1).alias(name))


def running_totals(df: DataFrame, key: str, block, order: list, values: dict) -> DataFrame:
    """Running sums per key, in two levels, so that a hot key is no single task.

    ``block`` cuts the ordered rows of a key into pieces (a time bucket, a range of ordinals) and
    must not decrease along ``order``. Sums run inside each piece; the totals of the pieces before
    it, one row per piece, are added.
    """
    cut = df.withColumn("__block", block)
    inside = Window.partitionBy(key, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(key, "__block").agg(*[F.sum(v).alias(f"__t_{n}") for n, v in values.items()])
    offsets = totals.select(
        key, "__block", *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in values]
    )
    local = cut.withColumns({f"__l_{n}": F.sum(v).over(inside) for n, v in values.items()})
    joined = local.join(offsets, [key, "__block"])
    return joined.withColumns({n: F.col(f"__l_{n}") + F.col(f"__o_{n}") for n in values}).drop(
        "__block", *[f"__{p}_{n}" for n in values for p in ("l", "o")]
    )

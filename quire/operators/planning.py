"""Study plans and check-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.ranking import global_row_number


def study_plan(nodes: DataFrame, check_ins: DataFrame, exam: Column, as_of: Column) -> DataFrame:
    """Spread all nodes over the days up to the exam, weakest mastery first.

    One row per node, and one row for a day without nodes. A past exam has no days.
    """
    order = F.when(F.col("mastery") == "fuzzy", 1).when(F.col("mastery") == "known", 2).otherwise(0)
    ranked = global_row_number(nodes.withColumn("weight", order), ["weight", "order_index", "node_id"], "position")
    days = F.greatest(F.datediff(exam, as_of) + 1, F.lit(0))
    total = ranked.agg(F.count("*").alias("n")).scalar()
    per_day = F.greatest(F.lit(1), F.ceil(total / days))
    placed = ranked.select(
        F.date_add(as_of, F.floor((F.col("position") - 1) / per_day).cast("int")).alias("date"),
        "position", "node_id", "title", "mastery",
    )
    calendar = (
        nodes.sparkSession.range(1)
        .filter(days > 0)
        .select(F.explode(F.sequence(as_of, exam)).alias("date"))
    )
    # Days without nodes are added, so that the nodes need not be dealt by day.
    empty = calendar.join(placed.select("date").distinct(), "date", "left_anti")
    plan = placed.filter(days > 0).unionByName(empty, allowMissingColumns=True)
    checked = check_ins.select("date").distinct().withColumn("checked", F.lit(1).cast("bigint"))
    return plan.join(checked, "date", "left").withColumn(
        "checked", F.coalesce("checked", F.lit(0).cast("bigint"))
    )


def upsert_check_ins(writes: DataFrame) -> DataFrame:
    """``writes(plan_id, date, content, done, seq)``: the last write per plan and date."""
    return writes.groupBy("plan_id", "date").agg(
        F.max_by("content", "seq").alias("content"), F.max_by("done", "seq").alias("done")
    )

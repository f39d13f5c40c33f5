"""Position trends over report dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridledger.functions.numbers import total_or_0


def latest_n_per_group(
    positions: DataFrame, group: str, n: int, measure: str = "VOLUME_BL"
) -> DataFrame:
    """Totals on the `n + 1` newest report dates of each group (age 1 = newest).

    Positions are summed per (group, date) before they are ranked.
    """
    per_date = (
        positions.filter(F.col(group).isNotNull() & F.col("REPORT_DATE").isNotNull())
        .groupBy(group, "REPORT_DATE")
        .agg(total_or_0(measure).alias(measure))
    )
    newest = W.partitionBy(group).orderBy(F.desc("REPORT_DATE"))
    return per_date.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= n + 1)


def consecutive_trend(
    positions: DataFrame,
    n: int,
    direction: str = "down",
    group: str = "BOOK",
    measure: str = "VOLUME_BL",
) -> DataFrame:
    """Groups whose value strictly fell (rose) on each of their last `n` report dates."""
    if direction not in ("down", "up"):
        raise ValueError("direction is 'down' or 'up'")
    recent = latest_n_per_group(positions, group, n, measure)
    before = F.lag(measure).over(W.partitionBy(group).orderBy("REPORT_DATE"))
    step = F.col(measure) < before if direction == "down" else F.col(measure) > before
    steps = recent.withColumn("moved", step).withColumn("has_before", before.isNotNull())
    return (
        steps.groupBy(group)
        .agg(
            F.count_if(F.col("has_before")).alias("steps"),
            F.count_if(F.col("moved")).alias("moves"),
            F.max("REPORT_DATE").alias("last_date"),
            F.max_by(measure, "REPORT_DATE").alias("last_value"),
            F.min_by(measure, "REPORT_DATE").alias("first_value"),
        )
        .filter((F.col("steps") == n) & (F.col("moves") == n))
        .select(group, "last_date", "first_value", "last_value")
    )


def nop_by_date(
    positions: DataFrame,
    filter_column: str | None = None,
    filter_value: str | None = None,
    monetary: bool = False,
    ascending: bool = False,
) -> DataFrame:
    """Net open position per report date; the value column is prefixed with the filter value."""
    measure = "MKT_VAL_BL" if monetary else "VOLUME_BL"
    name = f"{filter_value}_{measure}" if filter_value is not None else measure
    rows = positions
    if filter_column is not None:
        rows = rows.filter(F.col(filter_column) == filter_value)
    order = F.asc("REPORT_DATE") if ascending else F.desc("REPORT_DATE")
    return rows.groupBy("REPORT_DATE").agg(total_or_0(measure).alias(name)).orderBy(order)


def period_start(frame: DataFrame, months: int, date: str = "REPORT_DATE") -> Column:
    """`months` before the newest date in the data, as a scalar subquery."""
    return frame.agg(F.add_months(F.max(date), -months).alias("start")).scalar()


def last_period(frame: DataFrame, months: int = 6, date: str = "REPORT_DATE") -> DataFrame:
    """Rows dated after `months` before the newest date."""
    return frame.filter(F.col(date) > period_start(frame, months, date))


def filter_report_date(frame: DataFrame, day, date: str = "REPORT_DATE") -> DataFrame:
    """Rows of one report date; all rows when no date was asked for."""
    return frame if day is None else frame.filter(F.col(date) == F.lit(day).cast("date"))

"""Reusable roll-ups over counted or summed frames."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lastseen.functions.numbers import percent, relative_change, round_to_tenth
from lastseen.functions.times import weekday_label


def compared_periods(today: date, days: int = 7) -> dict[str, tuple[date, date]]:
    """First and last day of the last ``days`` full days and of those before."""
    ends = {"current": today - timedelta(days=1), "prior": today - timedelta(days=days + 1)}
    return {name: (last - timedelta(days=days - 1), last) for name, last in ends.items()}


def period_over_period(
    frame: DataFrame, key: str, day: str, measure: str, periods: dict[str, tuple[date, date]]
) -> DataFrame:
    """Sum of ``measure`` in the current period against the prior one.

    Both periods are summed in one pass; a key seen in only one of them counts
    0 in the other.
    """
    in_current = F.col(day) >= F.lit(periods["current"][0])

    def total(condition):
        return F.sum(F.when(condition, F.col(measure)).otherwise(F.lit(0)))

    return (
        frame.filter(F.col(day).between(F.lit(periods["prior"][0]), F.lit(periods["current"][1])))
        .groupBy(key)
        .agg(total(in_current).alias("current"), total(~in_current).alias("prior"))
        .withColumn("abs_delta", F.col("current") - F.col("prior"))
        .withColumn("pct_delta", relative_change(F.col("current"), F.col("prior")))
    )


def share_of_total(frame: DataFrame, within: str, measure: str) -> DataFrame:
    """Add ``share_pct``: the row's part of the sum of ``measure`` in its group.

    Meant for frames already reduced to a few rows per group.
    """
    total = F.sum(measure).over(Window.partitionBy(within))
    return frame.withColumn("share_pct", round_to_tenth(percent(F.col(measure), total)))


def weekday_profile(frame: DataFrame, key: str, day: str, measure: str) -> DataFrame:
    """Mean of ``measure`` per key and weekday over the days that have a row."""
    return (
        frame.groupBy(key, F.weekday(day).alias("dow"))
        .agg(
            round_to_tenth(F.avg(measure)).alias("avg"),
            F.count(F.lit(1)).alias("n_dates"),
        )
        .select(key, "dow", weekday_label(F.col("dow")).alias("dow_label"), "avg", "n_dates")
    )


def top_with_breakdown(
    frame: DataFrame, group: str, part: str, measure: str, k: int
) -> DataFrame:
    """Groups with the ``k`` largest sums, one row per part; ties by group name.

    ``frame`` holds one row per group and part.  The parts of a group meet in one
    row, so ``part`` must be a column of few values, such as the operator.
    Folding the parts into their group gives the total and the breakdown in
    one pass, and the sort keeps only ``k`` groups per task.
    """
    folded = frame.groupBy(group).agg(
        F.sum(measure).alias("total"),
        F.collect_list(F.struct(F.col(part), F.col(measure))).alias("_parts"),
    )
    top = folded.orderBy(F.col("total").desc(), F.col(group).asc()).limit(k)
    return top.select(group, "total", F.inline("_parts"))


def seat_utilization(
    frame: DataFrame, groups: Sequence[str], total: str, available: str
) -> DataFrame:
    """Seat-weighted share of taken seats per group, in percent."""
    free = F.try_divide(F.col("avail_seats").cast("double"), F.col("total_seats").cast("double"))
    return (
        frame.groupBy(*groups)
        .agg(F.sum(total).alias("total_seats"), F.sum(available).alias("avail_seats"))
        .withColumn("util_pct", round_to_tenth((F.lit(1.0) - free) * 100))
    )

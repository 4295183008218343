"""Which scrape days are complete enough to trust."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastseen.sources.archive import scrape_day

# Sightings and days ahead that make a scrape day complete.
COMPLETE_DAY_ROWS = 150_000
COMPLETE_DAY_SPAN = 29


def scrape_day_sizes(sightings: DataFrame) -> DataFrame:
    """Sightings per scrape day; days without any have no row."""
    return sightings.groupBy(scrape_day(sightings).alias("scrape_date")).agg(
        F.count(F.lit(1)).alias("n")
    )


def complete_days(
    sightings: DataFrame,
    min_rows: int = COMPLETE_DAY_ROWS,
    min_span: int = COMPLETE_DAY_SPAN,
) -> DataFrame:
    """Scrape days with enough sightings that also look far enough ahead."""
    ahead = F.date_diff(F.max("departure_date"), F.min("departure_date"))
    return (
        sightings.groupBy(scrape_day(sightings).alias("scrape_date"))
        .agg(F.count(F.lit(1)).alias("day_n"), ahead.alias("day_span"))
        .filter((F.col("day_n") >= min_rows) & (F.col("day_span") >= min_span))
    )


def complete_among(
    sizes: DataFrame,
    min_rows: int = COMPLETE_DAY_ROWS,
    min_span: int = COMPLETE_DAY_SPAN,
) -> DataFrame:
    """:func:`complete_days` from sizes known per day (``layers.day_sizes``)."""
    ahead = F.date_diff("last_departure", "first_departure")
    return sizes.select(
        "scrape_date", F.col("n").alias("day_n"), ahead.alias("day_span")
    ).filter((F.col("day_n") >= min_rows) & (F.col("day_span") >= min_span))


def on_days(sightings: DataFrame, days: DataFrame) -> DataFrame:
    """Sightings scraped on one of ``days``.

    ``days`` has at most one row per day of the scrape window it was computed
    from, so it is broadcast; on stored archives it also prunes partitions.
    """
    tagged = sightings
    if "scrape_date" not in sightings.columns:
        tagged = sightings.withColumn("scrape_date", scrape_day(sightings))
    return tagged.join(F.broadcast(days.select("scrape_date")), "scrape_date", "left_semi")

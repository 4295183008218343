"""Freshness and completeness of the archive, and the routes it covers."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastseen.functions.times import business_minute_text
from lastseen.operators.completeness import scrape_day_sizes
from lastseen.operators.filters import FORWARD_SCRAPE_DAYS, scraped_since
from lastseen.session import require_utc
from lastseen.sources.archive import scrape_day

# Days reported on and sightings a day needs to count as whole.
FRESHNESS_DAYS = 60
PARTIAL_DAY_ROWS = 50_000


def latest_scrape(sightings: DataFrame, newest_day: date | None = None) -> DataFrame:
    """Newest scrape as business-time text, empty when there is none.

    A stored archive knows its newest scrape day (``archive.newest_scrape_day``);
    given that day, only its partition is read.
    """
    require_utc(sightings.sparkSession)
    if newest_day is not None:
        sightings = sightings.filter(scrape_day(sightings) >= F.lit(newest_day))
    text = business_minute_text(F.max("scrape_timestamp"))
    return sightings.agg(F.coalesce(text, F.lit("")).alias("latest"))


def daily_scrape_counts(
    sightings: DataFrame, as_of: datetime, days: int = FRESHNESS_DAYS
) -> DataFrame:
    return scrape_day_sizes(scraped_since(sightings, as_of, days)).orderBy(
        F.col("scrape_date").desc()
    )


def partial_days(daily: DataFrame, min_rows: int = PARTIAL_DAY_ROWS) -> DataFrame:
    """Scrape days with too few sightings, and why they are excluded."""
    reason = F.concat(F.lit("only "), F.format_number("n", 0), F.lit(" rows"))
    return daily.filter(F.col("n") < min_rows).select(
        F.col("scrape_date").alias("date"), F.col("n").alias("rows"), reason.alias("reason")
    )


def clean_day_count(daily: DataFrame, min_rows: int = PARTIAL_DAY_ROWS) -> DataFrame:
    return daily.agg(F.count_if(F.col("n") >= min_rows).alias("history_days"))


def freshness(
    sightings: DataFrame,
    as_of: datetime,
    min_rows: int = PARTIAL_DAY_ROWS,
    newest_day: date | None = None,
    daily: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All freshness results.

    Two of them come from the daily roll-up: pass ``daily_scrape_counts`` as a
    ``shared`` frame to have it computed once.
    """
    daily = daily_scrape_counts(sightings, as_of) if daily is None else daily
    return {
        "latest": latest_scrape(sightings, newest_day),
        "excluded": partial_days(daily, min_rows),
        "history_days": clean_day_count(daily, min_rows),
    }


def relations(
    sightings: DataFrame, as_of: datetime, scrape_days: int = FORWARD_SCRAPE_DAYS
) -> DataFrame:
    """Distinct route names of the last scrapes."""
    recent = scraped_since(sightings, as_of, scrape_days)
    return (
        recent.filter(F.col("relation_name").isNotNull())
        .select("relation_name")
        .distinct()
        .orderBy("relation_name")
    )


def relation_count(
    sightings: DataFrame, as_of: datetime, scrape_days: int = FORWARD_SCRAPE_DAYS
) -> DataFrame:
    return relations(sightings, as_of, scrape_days).agg(F.count(F.lit(1)).alias("count"))

"""Exact distinct counts that merge: bitmaps of numbered values.

A value's number picks a bucket of 32,768 and a bit in it.  Bitmaps of parts (days, routes)
become one of the whole by OR, so a window of any length is counted from its days
without going back to the rows, and only bitmaps are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET, BITS = "bucket", "bits"


def bitmaps_of(frame: DataFrame, number: str, *groups: str) -> DataFrame:
    """One bitmap per group and bucket; rows without a number are left out."""
    place = F.col(number)
    return (
        frame.filter(place.isNotNull())
        .groupBy(*groups, F.bitmap_bucket_number(place).alias(BUCKET))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias(BITS))
    )


def holds_bitmaps(frame: DataFrame) -> bool:
    return {BUCKET, BITS} <= set(frame.columns)


def merged_bitmaps(bitmaps: DataFrame, *groups: str) -> DataFrame:
    """Bitmaps of coarser groups: the OR of those of their parts."""
    return bitmaps.groupBy(*groups, BUCKET).agg(F.bitmap_or_agg(BITS).alias(BITS))


def distinct_counts(bitmaps: DataFrame, *groups: str, name: str = "n") -> DataFrame:
    """Distinct values per group.  Buckets share no value, so their counts add up."""
    merged = merged_bitmaps(bitmaps, *groups)
    return merged.groupBy(*groups).agg(F.sum(F.bitmap_count(BITS)).alias(name))

"""Storage for point lookups: rows of one service or route lie together and can be ruled out.

Within a folder rows follow a curve over departure day and service, so a row group spans
few days *and* few services, whichever of the two a query names.  Bloom filters on service
id and route then tell the scan which row groups cannot hold a value; statistics of
minimum and maximum cannot, as ids of any group spread over the whole range.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrameWriter
from pyspark.sql import functions as F

LOOKED_UP = ("service_id", "relation_name", "relation_key")
#: Bits of each axis of the curve: 32 days of a month, 32 shares of the services.
CURVE_BITS = 5


def _bit(value: Column, place: int) -> Column:
    return F.shiftright(value, place).bitwiseAND(F.lit(1))


def curve() -> Column:
    """Place of a row on the curve: the bits of its day and of its service's share, in turn.

    Rows without a day or service come first on their axis.
    """
    day = F.coalesce(F.dayofmonth("departure_date"), F.lit(0))
    share = F.pmod(F.hash("service_id"), F.lit(1 << CURVE_BITS))
    share = F.when(F.col("service_id").isNull(), F.lit(0)).otherwise(share)
    bits = [
        F.shiftleft(_bit(axis, place), 2 * place + offset)
        for place in range(CURVE_BITS)
        for offset, axis in enumerate((day, share))
    ]
    return reduce(add, bits)


def filtered(writer: DataFrameWriter, services: int) -> DataFrameWriter:
    """Write Bloom filters, sized for ``services`` distinct values in a row group."""
    for name in LOOKED_UP:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true").option(
            f"parquet.bloom.filter.expected.ndv#{name}", str(services)
        )
    return writer

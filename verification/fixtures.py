"""The driver's ``lineitem`` table read as a scrape log (see FIXTURES.md).

The mapping is one SQL text that Spark and DuckDB both run, so the library and
the check queries start from the same rows.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastseen.functions.times import business_date
from lastseen.session import LARGEST_METHOD
from lastseen.sources.archive import (
    read_inventory,
    read_verdicts,
    typed_inventory,
    typed_verdicts,
    write_inventory,
    write_verdicts,
)

AS_OF = datetime(2026, 6, 1, 12, 0, tzinfo=timezone.utc)

# The mapping of FIXTURES.md; {lineitem} is the table to read.
INVENTORY_SQL = """
WITH s AS (
  SELECT l.*,
    CAST(l_partkey % 40 AS int) AS svc,
    CAST(l_quantity AS int) AS q,
    CAST(DATE '2026-06-01' - 46 + CAST(l_orderkey % 78 AS int) AS date) AS dep
  FROM {lineitem} l)
SELECT
  CAST(CASE WHEN dep < DATE '2026-06-01' THEN dep ELSE DATE '2026-06-01' END AS timestamp)
    + INTERVAL '12' HOUR - INTERVAL '1' DAY * (q % 4)
    - INTERVAL '1' HOUR * CAST(l_suppkey % 24 AS int)
    - INTERVAL '1' MINUTE * CAST(l_orderkey % 60 AS int)                AS scrape_timestamp,
  CASE WHEN l_suppkey % 37 = 0 THEN NULL ELSE
    CASE CAST(l_suppkey % 10 AS int)
      WHEN 0 THEN 'Delhi to Jaipur'   WHEN 1 THEN 'jaipur to delhi'
      WHEN 2 THEN 'delhi to lucknow'  WHEN 3 THEN 'Mumbai to Goa'
      WHEN 4 THEN 'goa to mumbai'     WHEN 5 THEN 'bangalore to chennai'
      WHEN 6 THEN 'Hyderabad to Pune' WHEN 7 THEN 'delhi to manali'
      WHEN 8 THEN 'indore to pune'    ELSE 'agra to kanpur' END END      AS relation_name,
  lpad(CAST(day(dep) AS string), 2, '0') || '-' ||
    CASE month(dep) WHEN 4 THEN 'Apr' WHEN 5 THEN 'May' WHEN 6 THEN 'Jun' ELSE 'Jul' END
    || '-' || CAST(year(dep) AS string)                                  AS departure_date,
  CASE WHEN l_linenumber <= 3 THEN lpad(CAST((svc * 5) % 24 AS string), 2, '0') || ':30:00'
       WHEN l_linenumber = 4  THEN '2026-06-01 ' || lpad(CAST((svc * 5) % 24 AS string), 2, '0') || ':45:00'
       WHEN l_linenumber = 5  THEN '6:30'
       WHEN l_linenumber = 6  THEN 'TBD'
       ELSE NULL END                                                     AS departure_time,
  CASE WHEN l_partkey % 53 = 0 THEN '' WHEN l_partkey % 59 = 0 THEN NULL
       WHEN svc % 10 = 0 THEN 'e1fa0e0a-a170-4ed5-b95f-b7f88f252f46-' || CAST(svc AS string)
       WHEN svc % 10 = 1 THEN '4568ed20-be7c-4375-ac36-d901b4315de3-' || CAST(svc AS string)
       ELSE 'svc-' || CAST(svc AS string) END                            AS service_id,
  CASE svc % 10 WHEN 0 THEN 'FlixBus' WHEN 1 THEN 'FLIX India' WHEN 2 THEN 'IntrCity SmartBus'
       WHEN 3 THEN 'Zingbus Plus' WHEN 4 THEN 'Zingbus Maxx' WHEN 5 THEN 'NueGo'
       WHEN 6 THEN 'FreshBus' WHEN 7 THEN 'Laxmi Holidays' WHEN 8 THEN 'Laxmi Holidays Pvt Ltd'
       ELSE NULL END                                                     AS travels_name,
  CASE CAST((l_partkey + l_linenumber) % 9 AS int)
       WHEN 0 THEN 'A/C Sleeper (2+1)' WHEN 1 THEN 'A/C Seater (2+2)' WHEN 2 THEN 'A/C Seater/Sleeper'
       WHEN 3 THEN 'Semi Sleeper + Sleeper' WHEN 4 THEN 'A/C Semi Sleeper (2+2)'
       WHEN 5 THEN 'Volvo Multi-Axle A/C Sleeper' WHEN 6 THEN 'Volvo A/C Seater'
       WHEN 7 THEN 'Electric Coach' ELSE NULL END                        AS bus_type,
  l_returnflag = 'A'                                                     AS is_seater,
  l_returnflag = 'R'                                                     AS is_sleeper,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linestatus = 'O' END       AS is_ac,
  CASE WHEN q = 50 THEN 'x' WHEN q = 49 THEN NULL ELSE CAST(q % 30 AS string) END AS available_seats,
  CASE CAST((svc + l_linenumber) % 8 AS int) WHEN 0 THEN '36' WHEN 1 THEN '40' WHEN 2 THEN '44'
       WHEN 3 THEN '30' WHEN 4 THEN '' WHEN 5 THEN 'n/a' WHEN 6 THEN '0' ELSE NULL END AS total_seats
FROM s
"""

VERDICT_SQL = """
SELECT scrape_timestamp, relation_name, departure_date, service_id,
  CASE WHEN lower(bus_type) LIKE '%seater%' THEN 'seater'
       WHEN lower(bus_type) LIKE '%sleeper%' THEN 'sleeper' END AS bus_product_type
FROM {bus_inventory} WHERE is_seater OR is_sleeper
"""


LINEITEM = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_returnflag string, l_linestatus string"
)


def raw_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Filters are evaluated on the mapping's expressions, in methods of 11,000 bytes and more.
    for key, value in LARGEST_METHOD.items():
        spark.conf.set(key, value)
    sf_dir = getattr(sf_dir, "feed", sf_dir)
    # With its schema given, reading the table starts no job.
    lineitem = spark.read.schema(LINEITEM).parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql(INVENTORY_SQL, lineitem=lineitem)


class ArchiveFolder(str):
    """A folder that holds the driver table as a stored archive (see ``ingest``)."""

    feed: str  # the folder the archive was made from


def ingest(spark: SparkSession, sf_dir: str, folder: str) -> ArchiveFolder:
    """Type and store the driver table below ``folder``, which the caller removes."""
    write_inventory(typed_inventory(raw_inventory(spark, sf_dir)), f"{folder}/inventory", "overwrite")
    write_verdicts(typed_verdicts(raw_verdicts(spark, sf_dir)), f"{folder}/verdicts", "overwrite")
    stored = ArchiveFolder(folder)
    stored.feed = sf_dir
    return stored


def raw_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VERDICT_SQL, bus_inventory=raw_inventory(spark, sf_dir))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver table as typed sightings: a lazy plan, nothing is stored."""
    if isinstance(sf_dir, ArchiveFolder):
        return read_inventory(spark, f"{sf_dir}/inventory")
    typed = typed_inventory(raw_inventory(spark, sf_dir))
    return typed.withColumn("scrape_date", business_date(F.col("scrape_timestamp")))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    if isinstance(sf_dir, ArchiveFolder):
        return read_verdicts(spark, f"{sf_dir}/verdicts")
    return typed_verdicts(raw_verdicts(spark, sf_dir))

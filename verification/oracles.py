"""DuckDB SQL for every query, written out from the semantics.

Product filters are spelled as three-valued SQL here, and rounding uses the
engine's own functions, so the checks do not share rules with the library.  Only
the two constant lookup tables are taken from it.
"""

from __future__ import annotations

from lastseen.sources.dimensions import LINE_CODES, ROUTE_REGIONS
from verification.fixtures import INVENTORY_SQL, VERDICT_SQL

TODAY = "DATE '2026-06-01'"
NOW = "TIMESTAMP '2026-06-01 12:00:00'"
SCRAPE_DAY = "CAST(scrape_timestamp + INTERVAL '330' MINUTE AS date)"
PARSED_DAY = "CAST(try_strptime(departure_date, '%d-%b-%Y') AS date)"

SOURCES = f"""
bus_inventory AS ({INVENTORY_SQL.format(lineitem="lineitem")}),
inv AS (
  SELECT scrape_timestamp, relation_name, {PARSED_DAY} AS departure_date, departure_time,
         service_id, travels_name, bus_type, is_seater, is_sleeper, is_ac,
         TRY_CAST(available_seats AS BIGINT) AS available_seats,
         TRY_CAST(total_seats AS BIGINT) AS total_seats
  FROM bus_inventory),
bus_verdicts AS ({VERDICT_SQL.format(bus_inventory="bus_inventory")}),
enr AS (
  SELECT scrape_timestamp, relation_name, {PARSED_DAY} AS departure_date, service_id,
         bus_product_type
  FROM bus_verdicts)
"""

NAME_RULES = {
    "flix": "lower(travels_name) LIKE '%flix%'",
    "intrcity": "lower(travels_name) LIKE '%intrcity%'",
    "zingbus": "(lower(travels_name) LIKE '%zingbus%' AND NOT lower(travels_name) LIKE '%maxx%')",
    "nuego": "lower(travels_name) LIKE '%nuego%'",
    "freshbus": "lower(travels_name) LIKE '%freshbus%'",
    "laxmi": "(lower(travels_name) LIKE '%laxmi holidays%' AND NOT lower(travels_name) LIKE '%pvt%')",
}
ANY_OPERATOR = "(" + " OR ".join(NAME_RULES.values()) + ")"
OPERATOR = (
    "CASE " + " ".join(f"WHEN {rule} THEN '{name}'" for name, rule in NAME_RULES.items())
)
OPERATOR_OR_OTHER = OPERATOR + " ELSE 'other' END"
OPERATOR_OR_NULL = OPERATOR + " END"

_SL, _SE, _SEMI = (f"lower(bus_type) LIKE '%{w}%'" for w in ("sleeper", "seater", "semi"))
_TWO = "regexp_matches(lower(bus_type), 'sleeper.*sleeper')"
PRODUCT_SQL = {
    "Sleeper": f"(total_seats = 36 OR (NOT total_seats = 36 AND {_SL} AND NOT {_SE} AND NOT {_SEMI}))",
    "Hybrid": f"(NOT total_seats = 36 AND (({_SL} AND {_SE}) OR ({_TWO} AND {_SEMI})))",
    "Seater": f"(NOT total_seats = 36 AND (({_SEMI} AND {_SL} AND NOT {_TWO} AND NOT {_SE})"
    f" OR ({_SE} AND NOT {_SL})))",
    "Volvo": "lower(bus_type) LIKE '%volvo%'",
}
PRODUCT_LABEL = f"""CASE
  WHEN total_seats = 36 THEN 'Sleeper'
  WHEN {_SE} AND {_SL} THEN 'Hybrid'
  WHEN {_TWO} AND {_SEMI} THEN 'Hybrid'
  WHEN {_SEMI} AND {_SL} AND NOT {_TWO} THEN 'Seater'
  WHEN {_SL} AND NOT {_SE} THEN 'Sleeper'
  WHEN {_SE} AND NOT {_SL} THEN 'Seater'
  ELSE 'Unknown' END"""
IS_VOLVO = "COALESCE(lower(bus_type) LIKE '%volvo%', false)"

HOUR = """CASE WHEN strpos(departure_time, ':') >= 3
  THEN TRY_CAST(substr(departure_time, strpos(departure_time, ':') - 2, 2) AS BIGINT) END"""
LEADING_HOUR = "TRY_CAST(substr(departure_time, 1, 2) AS BIGINT)"


def band(hour: str) -> str:
    return f"""CASE WHEN {hour} BETWEEN 0 AND 5 THEN '00:00-05:59'
  WHEN {hour} BETWEEN 6 AND 11 THEN '06:00-11:59'
  WHEN {hour} BETWEEN 12 AND 17 THEN '12:00-17:59'
  WHEN {hour} BETWEEN 18 AND 23 THEN '18:00-23:59' ELSE 'unknown' END"""


def values(pairs: dict[str, str]) -> str:
    return ", ".join(f"('{key}', '{value}')" for key, value in pairs.items())


ROUTES = f"routes(route, region) AS (VALUES {values(ROUTE_REGIONS)})"
LINES = f"lines(line_id, line_number) AS (VALUES {values(LINE_CODES)})"
TIES = ", ".join(
    f"{c} ASC NULLS LAST"
    for c in (
        "travels_name", "bus_type", "total_seats", "available_seats",
        "is_seater", "is_sleeper", "is_ac",
    )
)
IDENTIFIED = "service_id IS NOT NULL AND service_id <> '' AND relation_name IS NOT NULL"
RECENT = f"scrape_timestamp >= {NOW} - INTERVAL '2' DAY"


def newest_slot(source: str, where: str = "true") -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY relation_name, departure_date, service_id, departure_time
    ORDER BY scrape_timestamp DESC NULLS LAST, {TIES}) AS rn
  FROM {source} WHERE {where}) WHERE rn = 1"""


def newest_service(source: str, where: str = "true") -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY relation_name, departure_date, service_id
    ORDER BY scrape_timestamp DESC NULLS LAST, {TIES}, departure_time ASC NULLS LAST) AS rn
  FROM {source} WHERE {IDENTIFIED} AND {where}) WHERE rn = 1"""


NEWEST_VERDICT = f"""SELECT relation_name, departure_date, service_id, bus_product_type
  FROM (SELECT *, row_number() OVER (
    PARTITION BY relation_name, departure_date, service_id
    ORDER BY scrape_timestamp DESC NULLS LAST, bus_product_type ASC NULLS LAST) AS rn
  FROM enr WHERE {IDENTIFIED}) WHERE rn = 1"""


def sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([SOURCES, *ctes]) + "\n" + body


# ---- upcoming departures ----

D0_D30 = f"departure_date BETWEEN {TODAY} AND {TODAY} + 30"


def forward(
    days: str = D0_D30, where: str = "true", after: str = "true", operators: str = ANY_OPERATOR
) -> str:
    newest = newest_slot("inv", f"{RECENT} AND {days} AND {operators} AND {where}")
    return f"""fwd AS (SELECT *, {OPERATOR_OR_OTHER} AS operator, {band(HOUR)} AS hour_band
  FROM ({newest}) WHERE {after})"""


BY_DAY = """SELECT departure_date AS date, operator, count(*) AS departure_count
FROM fwd WHERE operator <> 'other' GROUP BY ALL"""
BY_BAND = """SELECT operator, hour_band, count(*) AS departure_count,
  CAST(COALESCE(sum(total_seats), 0) AS BIGINT) AS seats_offered,
  round_even(avg(1.0::DOUBLE - available_seats::DOUBLE / nullif(total_seats, 0)) * 100, 1)
    AS avg_load_pct
FROM fwd WHERE operator <> 'other' GROUP BY operator, hour_band"""
DETAIL = f"""SELECT departure_date, departure_time, operator, relation_name, service_id,
  CASE WHEN operator = 'flix' THEN line_number END AS line_number, bus_type,
  {PRODUCT_LABEL} AS product, is_ac, {IS_VOLVO} AS is_volvo,
  nullif(total_seats, 0) AS total_seats, available_seats AS avail_seats,
  round_even((1.0::DOUBLE - available_seats::DOUBLE / nullif(total_seats, 0)) * 100, 1)
    AS load_pct
FROM fwd LEFT JOIN lines ON substr(service_id, 1, 36) = line_id WHERE operator <> 'other'"""
DETAIL_ORDER = ", ".join(
    f"{c} ASC NULLS FIRST"
    for c in (
        "departure_date", "departure_time", "operator", "relation_name", "service_id",
        "line_number", "bus_type", "product", "is_ac", "is_volvo", "total_seats",
        "avail_seats", "load_pct",
    )
)


def template(where: str = "true") -> str:
    newest = newest_slot("inv", f"{D0_D30} AND {where}")
    return sql(
        """SELECT operator, hour_band, count(*) AS departure_count,
  CAST(sum(total_seats) AS BIGINT) AS seats_offered,
  round(avg((total_seats - available_seats)::DOUBLE / nullif(total_seats, 0)) * 100, 1)
    AS avg_load_pct
FROM flagged WHERE operator IS NOT NULL GROUP BY operator, hour_band""",
        f"""flagged AS (SELECT *, {OPERATOR_OR_NULL} AS operator,
  {band(LEADING_HOUR)} AS hour_band FROM ({newest}))""",
    )


# ---- past departures ----


def past(days: int, where: str = "true", after: str = "true") -> str:
    window = f"""scrape_timestamp >= {NOW} - INTERVAL '{days + 15}' DAY
    AND departure_date BETWEEN {TODAY} - {days} AND {TODAY} - 1"""
    return _services(f"{window} AND {where}", after)


def _services(where: str, after: str = "true") -> str:
    newest = newest_service("inv", f"{ANY_OPERATOR} AND {where}")
    return f"svc AS (SELECT *, {OPERATOR_OR_OTHER} AS operator FROM ({newest}) WHERE {after})"


DAILY = """daily AS (SELECT departure_date, operator, count(DISTINCT service_id) AS departure_count
  FROM svc WHERE operator <> 'other' GROUP BY departure_date, operator)"""
PER_RELATION = """per_relation AS (
  SELECT relation_name, operator, count(DISTINCT service_id) AS departure_count
  FROM svc WHERE operator <> 'other' GROUP BY relation_name, operator)"""
TOP = """SELECT relation, total, operator, departure_count
FROM (SELECT relation_name AS relation, CAST(sum(departure_count) AS BIGINT) AS total
  FROM per_relation GROUP BY relation_name ORDER BY total DESC, relation LIMIT 3) AS top
JOIN per_relation ON per_relation.relation_name = top.relation"""
RELATION_DAILY = """relation_daily AS (
  SELECT relation_name AS relation, departure_date, count(DISTINCT service_id) AS n
  FROM svc GROUP BY relation_name, departure_date)"""


def weeks(key: str, source: str, measure: str) -> str:
    return f"""changes AS (
  SELECT {key}, current, prior, current - prior AS abs_delta,
    round_even((current - prior)::DOUBLE / nullif(prior, 0) * 100, 1) AS pct_delta
  FROM (SELECT {key},
      CAST(sum(CASE WHEN departure_date >= {TODAY} - 7 THEN {measure} ELSE 0 END) AS BIGINT)
        AS current,
      CAST(sum(CASE WHEN departure_date < {TODAY} - 7 THEN {measure} ELSE 0 END) AS BIGINT)
        AS prior
    FROM {source} GROUP BY {key}))"""


VALID_SEATS = "total_seats IS NOT NULL AND total_seats > 0 AND available_seats IS NOT NULL"
UTILIZATION = """SELECT departure_date,
  CASE WHEN contains(lower(travels_name), 'flix') THEN 'flix' ELSE 'comp' END AS operator_group,
  CAST(sum(total_seats) AS BIGINT) AS total_seats,
  CAST(sum(available_seats) AS BIGINT) AS avail_seats,
  round_even((1.0::DOUBLE - sum(available_seats)::DOUBLE / sum(total_seats)::DOUBLE) * 100, 1)
    AS util_pct
FROM svc GROUP BY 1, 2"""
MOVERS = (past(14), RELATION_DAILY, weeks("relation", "relation_daily", "n"))
GAINERS, LOSERS = (
    f"""SELECT * FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY pct_delta {direction}, relation) AS INTEGER) AS rank
  FROM changes WHERE pct_delta IS NOT NULL) WHERE rank <= 3"""
    for direction in ("DESC", "ASC")
)
TREND = "SELECT departure_date, operator, departure_count FROM daily"

# ---- archive quality ----

SCRAPE_DAYS = f"""days AS (SELECT {SCRAPE_DAY} AS scrape_date, count(*) AS n FROM inv
  WHERE scrape_timestamp >= {NOW} - INTERVAL '60' DAY GROUP BY ALL)"""
CLEAN = f"""clean AS (SELECT {SCRAPE_DAY} AS scrape_date, count(*) AS day_n,
    CAST(max(departure_date) - min(departure_date) AS INTEGER) AS day_span
  FROM inv WHERE scrape_timestamp >= {NOW} - INTERVAL '60' DAY
  GROUP BY ALL HAVING count(*) >= 500 AND max(departure_date) - min(departure_date) >= 29)"""
ON_CLEAN = f"{SCRAPE_DAY} IN (SELECT scrape_date FROM clean)"


def clean_trend(where: str = "true") -> str:
    newest = newest_slot("inv", f"{ON_CLEAN} AND {where}")
    return sql(
        f"""SELECT departure_date, operator, count(*) AS departure_count
FROM (SELECT *, {OPERATOR_OR_NULL} AS operator FROM ({newest}))
WHERE operator IS NOT NULL AND departure_date BETWEEN {TODAY} - 45 AND {TODAY} - 1
GROUP BY departure_date, operator""",
        CLEAN,
    )


ORACLES: dict[str, str] = {
    "typed_inventory": sql(
        """SELECT departure_date, total_seats, available_seats, count(*) AS n,
  CAST(sum(available_seats) AS BIGINT) AS free
FROM inv GROUP BY departure_date, total_seats, available_seats"""
    ),
    "unparsed_text": sql(
        f"""SELECT count(*) AS sightings,
  count(*) FILTER (WHERE departure_date IS NOT NULL AND {PARSED_DAY} IS NULL) AS departure_date,
  count(*) FILTER (WHERE available_seats IS NOT NULL
    AND TRY_CAST(available_seats AS BIGINT) IS NULL) AS available_seats,
  count(*) FILTER (WHERE total_seats IS NOT NULL
    AND TRY_CAST(total_seats AS BIGINT) IS NULL) AS total_seats
FROM bus_inventory"""
    ),
    "route_regions": sql(
        """SELECT relation_name, region, count(*) AS n
FROM inv LEFT JOIN routes ON lower(relation_name) = route GROUP BY relation_name, region""",
        ROUTES,
    ),
    "line_code_lookup": sql(
        f"""SELECT operator, service_id,
  CASE WHEN operator = 'flix' THEN line_number END AS line_number, count(*) AS n
FROM (SELECT *, {OPERATOR_OR_OTHER} AS operator FROM inv)
LEFT JOIN lines ON substr(service_id, 1, 36) = line_id GROUP BY 1, 2, 3""",
        LINES,
    ),
    "departure_hour": sql(
        f"SELECT departure_time, {HOUR} AS departure_hour, count(*) AS n FROM inv GROUP BY 1, 2"
    ),
    "hour_band_counts": sql(
        f"SELECT {band(HOUR)} AS hour_band, count(*) AS n FROM inv GROUP BY 1"
    ),
    "operator_classify": sql(
        f"SELECT travels_name, {OPERATOR_OR_OTHER} AS operator, count(*) AS n FROM inv GROUP BY 1, 2"
    ),
    "product_classify": sql(
        f"""SELECT bus_type, total_seats, {PRODUCT_LABEL} AS product, {IS_VOLVO} AS is_volvo,
  count(*) AS n FROM inv GROUP BY ALL"""
    ),
    "product_classify_flags": sql(
        """SELECT is_seater, is_sleeper,
  CASE WHEN is_seater AND is_sleeper THEN 'Hybrid' WHEN is_seater AND NOT is_sleeper THEN 'Seater'
       WHEN is_sleeper AND NOT is_seater THEN 'Sleeper' ELSE 'Unknown' END AS product,
  count(*) AS n FROM inv GROUP BY ALL"""
    ),
    "days_before_departure": sql(
        f"SELECT CAST(departure_date - {TODAY} AS INTEGER) AS pbd, count(*) AS n FROM inv GROUP BY 1"
    ),
    "latest_sighting_4key": sql(
        f"""SELECT * EXCLUDE (rn, scrape_timestamp),
  strftime(scrape_timestamp, '%Y-%m-%d %H:%M:%S') AS scrape_timestamp
FROM ({newest_slot("inv")})"""
    ),
    "latest_sighting_3key": sql(
        f"""SELECT * EXCLUDE (rn, scrape_timestamp),
  strftime(scrape_timestamp, '%Y-%m-%d %H:%M:%S') AS scrape_timestamp
FROM ({newest_service("inv")})"""
    ),
    "latest_enriched": sql(NEWEST_VERDICT),
    "latest_with_enriched": sql(
        f"""SELECT relation_name, departure_date, service_id, travels_name, bus_product_type
FROM ({newest_service("inv")})
LEFT JOIN ({NEWEST_VERDICT}) USING (relation_name, departure_date, service_id)"""
    ),
    "departures_detail": sql(DETAIL, forward(), LINES),
    "departures_detail_capped": sql(
        f"""SELECT *, CAST(row_number() OVER (ORDER BY {DETAIL_ORDER}) AS INTEGER) AS rank
FROM ({DETAIL}) ORDER BY rank LIMIT 1000""",
        forward(),
        LINES,
    ),
    "departures_row_count": sql("SELECT count(*) AS row_count_raw FROM fwd", forward()),
    "departures_with_enriched": sql(
        f"""SELECT operator, hour_band, bus_product_type, count(*) AS n
FROM fwd LEFT JOIN ({NEWEST_VERDICT}) USING (relation_name, departure_date, service_id)
GROUP BY ALL""",
        forward(),
    ),
    "by_operator_hourband": sql(BY_BAND, forward()),
    "departures_by_day": sql(BY_DAY, forward()),
    "departures_by_day_d0_d4": sql(
        BY_DAY, forward(f"departure_date BETWEEN {TODAY} AND {TODAY} + 4")
    ),
    "departures_by_day_d5_d30": sql(
        BY_DAY, forward(f"departure_date BETWEEN {TODAY} + 5 AND {TODAY} + 30")
    ),
    "by_line": sql(
        """SELECT CASE WHEN service_id IS NULL OR service_id = '' THEN '(no-service)'
    ELSE service_id END AS service_id,
  relation_name AS corridor, operator, count(*) AS departure_count,
  COALESCE(array_to_string(list_sort(list(DISTINCT departure_time)
    FILTER (WHERE departure_time <> '')), '|'), '') AS departure_times
FROM fwd WHERE operator <> 'other' GROUP BY 1, 2, 3""",
        forward(),
    ),
    "by_line_times": sql(
        """SELECT CASE WHEN service_id IS NULL OR service_id = '' THEN '(no-service)'
    ELSE service_id END AS service_id,
  relation_name AS corridor, operator, nullif(departure_time, '') AS departure_time,
  count(*) AS departure_count
FROM fwd WHERE operator <> 'other' GROUP BY 1, 2, 3, 4""",
        forward(),
    ),
    "filter_operator": sql(
        BY_DAY, forward(operators=f"({NAME_RULES['zingbus']} OR {NAME_RULES['laxmi']})")
    ),
    "filter_relation": sql(BY_DAY, forward(where="relation_name = 'Mumbai to Goa'")),
    "filter_region": sql(
        BY_BAND,
        ROUTES,
        forward(where="lower(relation_name) IN (SELECT route FROM routes WHERE region = 'IN01')"),
    ),
    "filter_line_code": sql(
        DETAIL,
        LINES,
        forward(
            where="substr(service_id, 1, 36) ="
            " (SELECT line_id FROM lines WHERE line_number = 'IN0421B')"
        ),
    ),
    "filter_hour_range": sql(BY_BAND, forward(where=f"{HOUR} BETWEEN 6 AND 15")),
    "filter_dep_range": sql(
        BY_DAY, forward("departure_date BETWEEN DATE '2026-05-30' AND DATE '2026-06-09'")
    ),
    "filter_product_forward": sql(
        BY_BAND, forward(after=f"({PRODUCT_SQL['Seater']} OR {PRODUCT_SQL['Volvo']})")
    ),
    "hourband_template": template(),
    "filter_origin_hub": template("starts_with(lower(relation_name), lower('Delhi'))"),
    "product_before_dedup": template(f"({PRODUCT_SQL['Sleeper']} OR {PRODUCT_SQL['Hybrid']})"),
    "trend_daily": sql(
        f"""SELECT *, CAST(row_number() OVER (ORDER BY departure_date, operator) AS INTEGER) AS rank
FROM ({TREND})""",
        past(45),
        DAILY,
    ),
    "trend_by_product": sql(TREND, past(45, after=PRODUCT_SQL["Sleeper"]), DAILY),
    "history_range_trend": sql(
        TREND,
        _services(
            """scrape_timestamp BETWEEN TIMESTAMP '2026-05-04' - INTERVAL '15' DAY
      AND TIMESTAMP '2026-05-24' + INTERVAL '15' DAY
    AND departure_date BETWEEN DATE '2026-05-04' AND DATE '2026-05-24'"""
        ),
        DAILY,
    ),
    "filter_service": sql(TREND, past(45, "service_id = 'svc-12'"), DAILY),
    "past_with_enriched": sql(
        f"""SELECT operator, bus_product_type, count(*) AS n
FROM svc LEFT JOIN ({NEWEST_VERDICT}) USING (relation_name, departure_date, service_id)
GROUP BY ALL""",
        past(45),
    ),
    "trend_by_region": sql(
        TREND,
        ROUTES,
        past(45, "lower(relation_name) IN (SELECT route FROM routes WHERE region = 'IN11')"),
        DAILY,
    ),
    "share": sql(
        """SELECT departure_date, operator, departure_count AS count,
  round_even(100.0::DOUBLE * departure_count
    / sum(departure_count) OVER (PARTITION BY departure_date), 1) AS share_pct
FROM daily""",
        past(45),
        DAILY,
    ),
    "dow_profile": sql(
        """SELECT operator, CAST(isodow - 1 AS INTEGER) AS dow,
  CASE isodow WHEN 1 THEN 'Mon' WHEN 2 THEN 'Tue' WHEN 3 THEN 'Wed' WHEN 4 THEN 'Thu'
    WHEN 5 THEN 'Fri' WHEN 6 THEN 'Sat' ELSE 'Sun' END AS dow_label,
  round_even(avg(departure_count), 1) AS avg, count(*) AS n_dates
FROM (SELECT *, isodow(departure_date) AS isodow FROM daily) GROUP BY operator, isodow""",
        past(45),
        DAILY,
    ),
    "relation_operator_counts": sql("SELECT * FROM per_relation", past(45), PER_RELATION),
    "top_relations": sql(TOP, past(45), PER_RELATION),
    "top_relations_by_product": sql(
        TOP,
        past(45, after=f"({PRODUCT_SQL['Seater']} OR {PRODUCT_SQL['Hybrid']})"),
        PER_RELATION,
    ),
    "wow": sql(
        "SELECT * FROM changes", past(14), DAILY, weeks("operator", "daily", "departure_count")
    ),
    "wow_relation": sql("SELECT * FROM changes", *MOVERS),
    "wow_gainers": sql(GAINERS, *MOVERS),
    "wow_losers": sql(LOSERS, *MOVERS),
    "wow_movers": sql(
        f"""SELECT *, 'gainer' AS direction FROM ({GAINERS})
UNION ALL SELECT *, 'loser' AS direction FROM ({LOSERS})""",
        *MOVERS,
    ),
    "wow_weeks": sql(
        """SELECT CASE WHEN departure_date >= DATE '2026-05-25' THEN 'current' ELSE 'prior' END
    AS period,
  CASE WHEN departure_date >= DATE '2026-05-25' THEN DATE '2026-05-25'
    ELSE DATE '2026-05-18' END AS first_day,
  CASE WHEN departure_date >= DATE '2026-05-25' THEN DATE '2026-05-31'
    ELSE DATE '2026-05-24' END AS last_day,
  operator, CAST(sum(departure_count) AS BIGINT) AS departures
FROM daily GROUP BY 1, 2, 3, 4""",
        past(14),
        DAILY,
    ),
    "wow_by_operator": sql(
        "SELECT * FROM changes",
        past(14, f"({NAME_RULES['intrcity']} OR {NAME_RULES['nuego']})"),
        DAILY,
        weeks("operator", "daily", "departure_count"),
    ),
    "utilization": sql(UTILIZATION, past(45, VALID_SEATS)),
    "utilization_by_product": sql(
        UTILIZATION, past(45, VALID_SEATS, after=f"({PRODUCT_SQL['Volvo']})")
    ),
    "trend_clean_days": clean_trend(),
    "trend_clean_days_by_product": clean_trend(
        f"{PRODUCT_SQL['Hybrid']} AND starts_with(lower(relation_name), 'delhi')"
    ),
    "clean_days": sql("SELECT * FROM clean", CLEAN),
    "clean_day_rows": sql(
        f"""SELECT {SCRAPE_DAY} AS scrape_date, travels_name, count(*) AS n
FROM inv WHERE {ON_CLEAN} GROUP BY ALL""",
        CLEAN,
    ),
    "freshness_latest": sql(
        """SELECT COALESCE(strftime(max(scrape_timestamp) + INTERVAL '330' MINUTE,
  '%Y-%m-%d %H:%M'), '') AS latest FROM inv"""
    ),
    "daily_scrape_counts": sql(
        """SELECT *, CAST(row_number() OVER (ORDER BY scrape_date DESC) AS INTEGER) AS rank
FROM days""",
        SCRAPE_DAYS,
    ),
    "partial_days": sql(
        """SELECT scrape_date AS date, n AS rows, 'only ' || format('{:,}', n) || ' rows' AS reason
FROM days WHERE n < 800""",
        SCRAPE_DAYS,
    ),
    "clean_day_count": sql(
        "SELECT count(*) AS history_days FROM days WHERE n >= 800", SCRAPE_DAYS
    ),
    "relations": sql(
        f"""SELECT *, CAST(row_number() OVER (ORDER BY relation_name) AS INTEGER) AS rank
FROM (SELECT DISTINCT relation_name FROM inv WHERE {RECENT} AND relation_name IS NOT NULL)"""
    ),
    "relation_count": sql(
        f"SELECT count(DISTINCT relation_name) AS count FROM inv WHERE {RECENT}"
    ),
}

# Layers and bitmaps change where results come from, not what they are.
ORACLES |= {
    "layer_latest_4key": ORACLES["latest_sighting_4key"],
    "layer_latest_3key": ORACLES["latest_sighting_3key"],
    "layer_departures_detail": ORACLES["departures_detail"],
    "layer_product_before_dedup": ORACLES["product_before_dedup"],
    "layer_wow_by_operator": ORACLES["wow_by_operator"],
    "layer_utilization": ORACLES["utilization"],
    "bitmap_trend_daily": ORACLES["trend_daily"],
    "bitmap_trend_by_region": ORACLES["trend_by_region"],
    "bitmap_relation_operator_counts": ORACLES["relation_operator_counts"],
    "bitmap_top_relations": ORACLES["top_relations"],
    "bitmap_dow_profile": ORACLES["dow_profile"],
    "freshness_newest_day": ORACLES["freshness_latest"],
}
_WINDOWS = {
    "week": f"{TODAY} - 7 AND {TODAY} - 1",
    "month": f"{TODAY} - 30 AND {TODAY} - 1",
    "range": "DATE '2026-05-04' AND DATE '2026-05-24'",
}
ORACLES["services_of_windows"] = sql(
    "\nUNION ALL ".join(
        f"""SELECT '{name}' AS "window", operator, count(DISTINCT service_id) AS services
FROM svc WHERE operator <> 'other' AND departure_date BETWEEN {days} GROUP BY operator"""
        for name, days in _WINDOWS.items()
    ),
    past(45),
)
_UNPARSED = {
    "available_seats": "TRY_CAST(available_seats AS BIGINT)",
    "departure_date": PARSED_DAY,
    "total_seats": "TRY_CAST(total_seats AS BIGINT)",
}
ORACLES["rejected_rows"] = sql(
    f"""SELECT reason, count(*) AS n FROM (SELECT concat_ws(', ', {", ".join(
        f"CASE WHEN {name} IS NOT NULL AND {value} IS NULL THEN '{name}' END"
        for name, value in _UNPARSED.items()
    )}) AS reason FROM bus_inventory) WHERE reason <> '' GROUP BY reason"""
)

_SERVICE = "CASE WHEN service_id IS NULL OR service_id = '' THEN '(no-service)' ELSE service_id END"
_SEATS = """count(*) AS departure_count,
  CAST(COALESCE(sum(total_seats), 0) AS BIGINT) AS seats_offered,
  round_even(avg(1.0::DOUBLE - available_seats::DOUBLE / nullif(total_seats, 0)) * 100, 1)
    AS avg_load_pct"""
_ONE_PASS_COLUMNS = {
    "operator": "VARCHAR", "hour_band": "VARCHAR", "date": "DATE", "service_id": "VARCHAR",
    "corridor": "VARCHAR", "departure_time": "VARCHAR",
}


def _pass(view: str, where: str, **groups: str) -> str:
    columns = ", ".join(
        f"{groups.get(name, f'CAST(NULL AS {kind})')} AS {name}"
        for name, kind in _ONE_PASS_COLUMNS.items()
    )
    by = f"GROUP BY {', '.join(groups.values())}"
    seats = _SEATS
    if view != "by_operator_hourband":
        seats = """count(*) AS departure_count, CAST(NULL AS BIGINT) AS seats_offered,
  CAST(NULL AS DOUBLE) AS avg_load_pct"""
    return f"SELECT '{view}' AS view, {columns}, {seats} FROM fwd WHERE {where} {by}"


ORACLES["departures_in_one_pass"] = sql(
    "\nUNION ALL ".join(
        [
            # The library keeps departures of unknown operators in a row of their own.
            _pass("row_count", "true", **{}).replace("GROUP BY ", "GROUP BY (operator <> 'other')"),
            _pass("by_operator_hourband", "operator <> 'other'", operator="operator", hour_band="hour_band"),
            _pass("by_day", "operator <> 'other'", date="departure_date", operator="operator"),
            _pass(
                "by_line",
                "operator <> 'other'",
                service_id=_SERVICE,
                corridor="relation_name",
                operator="operator",
                departure_time="nullif(departure_time, '')",
            ),
        ]
    ),
    forward(),
)
_AFTER = """departure_date > DATE '2026-06-10' OR departure_date = DATE '2026-06-10' AND (
  departure_time IS NOT NULL OR operator > 'freshbus' OR operator = 'freshbus' AND (
    relation_name > 'delhi to manali' OR relation_name = 'delhi to manali' AND
      service_id > 'svc-16'))"""
ORACLES["departures_page"] = sql(
    f"""SELECT *, CAST(row_number() OVER (ORDER BY {DETAIL_ORDER}) AS INTEGER) AS rank
FROM ({DETAIL}) WHERE {_AFTER} ORDER BY rank LIMIT 500""",
    forward(),
    LINES,
)


def _lines_of(result: str, query: str, *columns: str) -> str:
    """A result as JSON lines, its columns by name."""
    fields = ", ".join(f"{name} := {name}" for name in sorted(columns))
    return f"""SELECT '{result}' AS result,
  CAST(to_json(struct_pack({fields})) AS VARCHAR) AS row FROM ({query})"""


def _view(*results: str) -> str:
    return "\nUNION ALL ".join(results)


ORACLES["departures_view"] = _view(
    _lines_of(
        "rows", ORACLES["departures_detail"], "departure_date", "departure_time", "operator",
        "relation_name", "service_id", "line_number", "bus_type", "product", "is_ac", "is_volvo",
        "total_seats", "avail_seats", "load_pct",
    ),
    _lines_of("row_count", ORACLES["departures_row_count"], "row_count_raw"),
    _lines_of(
        "by_operator_hourband", ORACLES["by_operator_hourband"], "operator", "hour_band",
        "departure_count", "seats_offered", "avg_load_pct",
    ),
    _lines_of("by_day", ORACLES["departures_by_day"], "date", "operator", "departure_count"),
    _lines_of(
        "by_line",
        f"""SELECT * REPLACE (CASE WHEN departure_times = '' THEN []
  ELSE string_split(departure_times, '|') END AS departure_times) FROM ({ORACLES["by_line"]})""",
        "service_id", "corridor", "operator", "departure_count", "departure_times",
    ),
)
_CHANGES = ("abs_delta", "current", "pct_delta", "prior")
_DELTA = ("relation", *_CHANGES)
_WEEKS = ("period", "first_day", "last_day", "operator", "departures")
ORACLES["history_views"] = _view(
    _lines_of("trend_45 points", ORACLES["trend_daily"], "departure_date", "operator", "departure_count"),
    _lines_of("share points", ORACLES["share"], "departure_date", "operator", "count", "share_pct"),
    _lines_of("dow points", ORACLES["dow_profile"], "operator", "dow", "dow_label", "avg", "n_dates"),
    _lines_of("top_relations rows", ORACLES["top_relations"], "relation", "total", "operator", "departure_count"),
    _lines_of("wow delta", ORACLES["wow"], "operator", *_CHANGES),
    _lines_of("wow weeks", ORACLES["wow_weeks"], *_WEEKS),
    _lines_of("wow_relation gainers", ORACLES["wow_gainers"], *_DELTA),
    _lines_of("wow_relation losers", ORACLES["wow_losers"], *_DELTA),
    _lines_of("wow_relation weeks", ORACLES["wow_weeks"], *_WEEKS),
    _lines_of(
        "util points", ORACLES["utilization"], "departure_date", "operator_group", "total_seats",
        "avail_seats", "util_pct",
    ),
)
ORACLES["freshness_view"] = _view(
    _lines_of("latest", ORACLES["freshness_latest"], "latest"),
    _lines_of("excluded", ORACLES["partial_days"], "date", "rows", "reason"),
    _lines_of("history_days", ORACLES["clean_day_count"], "history_days"),
)

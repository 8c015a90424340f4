"""SQL statements that define what each catalogued query must return.

Written against the given tables for an independent engine: plain joins, window
functions and one UNION branch per check, none of the rewrites the operators use.
``statement(body, *needs)`` puts the named building blocks in front of a body.
"""

from __future__ import annotations

from kerbline.functions.text import DATE_IN_PROSE, FIELD_LABELS, MAX_HEADING_LENGTH, STREET_SEGMENT
from kerbline.operators import rules as r
from kerbline.plans.feeds import AS_OF, BOROUGH_OF_REGION, NOW, ODD_ZONES, PLACES, SECTIONS, TODAY, WINDOW


def rounded(expr: str, digits: int = 2) -> str:
    return f"CAST(ROUND(CAST(({expr}) AS DECIMAL(30,12)), {digits}) AS DOUBLE)"


def exact(column: str) -> str:
    return f"CAST({column} AS DECIMAL(18,2))"


def total(column: str) -> str:
    return rounded(f"CAST(SUM({exact(column)}) AS DOUBLE)")


def mean(column: str) -> str:
    return rounded(f"CAST(SUM({exact(column)}) AS DOUBLE) / NULLIF(COUNT({column}), 0)")


def pick(index: str, values) -> str:
    """The value at a zero-based index of a short fixed list."""
    arms = " ".join(
        f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)
    )
    return f"CASE {index} {arms} END"


def in_list(values) -> str:
    return "(" + ", ".join(repr(v) for v in values) + ")"


def spelled(column: str) -> str:
    """Title case split on blanks."""
    return (
        f"array_to_string(list_transform(string_split(lower(trim({column})), ' '), "
        f"lambda w: upper(w[1:1]) || w[2:]), ' ')"
    )


_MINUTES = "(epoch(lpep_dropoff_datetime) - epoch(lpep_pickup_datetime)) / 60.0"


def hour_key(ts: str) -> str:
    return f"CAST(strftime({ts}, '%Y%m%d%H') AS INTEGER)"


# --- building blocks: name -> (needs, select) -------------------------------------------

BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {}

BLOCKS["ev"] = ((), """
  SELECT event_id, ts, user_id, event_type, value, date_trunc('second', ts) AS t,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents
  FROM events""")

_region_arms = " ".join(f"WHEN '{name}' THEN '{spelling}'" for name, spelling in BOROUGH_OF_REGION.items())
_zone_arms = " ".join(f"WHEN {key} THEN '{name}'" for key, name in ODD_ZONES.items())
BLOCKS["zones_raw"] = ((), f"""
  SELECT CASE WHEN n_nationkey = 23 THEN 'x23' ELSE CAST(n_nationkey + 1 AS VARCHAR) END AS LocationID,
         CASE WHEN n_nationkey = 5 THEN ' ewr ' WHEN n_nationkey <> 24 THEN CASE r_name {_region_arms} END END AS Borough,
         CASE n_nationkey {_zone_arms} ELSE replace(n_name, '_', ' ') END AS Zone,
         CASE WHEN n_nationkey = 9 THEN 'EWR' WHEN n_nationkey = 14 THEN 'N/A' WHEN n_nationkey = 21 THEN 'Night Zone'
              ELSE {pick('n_nationkey % 3', ('boro zone', ' YELLOW zone', 'Airports'))} END AS service_zone
  FROM nation JOIN region ON n_regionkey = r_regionkey""")
BLOCKS["zones"] = (("zones_raw",), f"""
  SELECT TRY_CAST(LocationID AS INTEGER) AS location_id,
         CASE WHEN upper(trim(Borough)) = 'EWR' THEN 'EWR' ELSE {spelled('Borough')} END AS borough,
         CASE upper(trim(Zone)) WHEN 'SOHO' THEN 'SoHo' WHEN 'LAGUARDIA AIRPORT' THEN 'LaGuardia Airport'
              WHEN 'JFK AIRPORT' THEN 'JFK Airport' WHEN 'DUMBO/VINEGAR HILL' THEN 'DUMBO/Vinegar Hill'
              ELSE {spelled('Zone')} END AS zone,
         CASE WHEN upper(trim(service_zone)) = 'EWR' THEN 'EWR' ELSE {spelled('service_zone')} END AS service_zone
  FROM zones_raw""")
BLOCKS["dim_zone"] = (("zones",), "SELECT * FROM zones WHERE location_id IS NOT NULL")

BLOCKS["trips_raw"] = (("ev",), """
  SELECT CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'signup' THEN 7 WHEN 'error' THEN 6 ELSE 2 END AS BIGINT) AS VendorID,
         CASE WHEN k <> 97 THEN t END AS lpep_pickup_datetime,
         CASE WHEN k <> 88 THEN t + to_seconds(CASE k WHEN 99 THEN -3600 WHEN 98 THEN 60 WHEN 96 THEN 59
              WHEN 95 THEN 86400 WHEN 94 THEN 86401 ELSE cents * (k % 5) END) END AS lpep_dropoff_datetime,
         CASE WHEN event_type <> 'error' THEN 'N' END AS store_and_fwd_flag,
         CASE WHEN event_type <> 'error' THEN CASE WHEN k = 89 THEN 99 ELSE k % 8 END END AS RatecodeID,
         CAST(user_id % 26 + 1 AS INTEGER) AS PULocationID,
         CASE WHEN k = 83 THEN 264 ELSE k % 27 + 1 END AS DOLocationID,
         CASE WHEN event_type <> 'error' THEN k % 7 END AS passenger_count,
         CASE WHEN k = 92 THEN CAST(111005.95 AS DOUBLE) WHEN k = 91 THEN NULL WHEN k % 10 = 0 THEN 0 ELSE value END AS trip_distance,
         CASE WHEN k = 90 THEN -value WHEN k = 85 THEN NULL ELSE value * 2 END AS fare_amount,
         CAST(0.5 AS DOUBLE) AS extra, CAST(0.5 AS DOUBLE) AS mta_tax,
         CASE WHEN k = 84 THEN CAST(-1 AS DOUBLE) ELSE value * (k % 4) / 7 END AS tip_amount,
         CASE WHEN k = 82 THEN CAST(6.94 AS DOUBLE) ELSE 0 END AS tolls_amount,
         CAST(NULL AS DOUBLE) AS ehail_fee, CAST(1 AS DOUBLE) AS improvement_surcharge,
         CASE WHEN k = 90 THEN -value WHEN k = 85 THEN NULL ELSE value * 2 END
           + CASE WHEN k = 84 THEN CAST(-1 AS DOUBLE) ELSE value * (k % 4) / 7 END + 2 AS total_amount,
         CASE WHEN event_type <> 'error' THEN k % 7 END AS payment_type,
         CASE WHEN event_type <> 'error' THEN k % 3 END AS trip_type,
         CASE WHEN event_type <> 'error' THEN CAST(2.75 AS DOUBLE) END AS congestion_surcharge,
         CAST(0.75 AS DOUBLE) AS cbd_congestion_fee
  FROM ev""")
_EXCLUDED = (
    f"lpep_pickup_datetime < TIMESTAMP '{WINDOW[0]}' OR lpep_pickup_datetime >= TIMESTAMP '{WINDOW[1]}' "
    "OR lpep_dropoff_datetime < lpep_pickup_datetime OR trip_distance > 100000"
)
BLOCKS["trips_timed"] = (("trips_raw",), f"SELECT *, {_MINUTES} AS minutes FROM trips_raw")
BLOCKS["trips_excluded"] = (("trips_timed",), f"SELECT * FROM trips_timed WHERE {_EXCLUDED}")
# The multiset difference itself, not the filter it is rewritten to.
BLOCKS["trips_kept"] = (("trips_excluded",), "SELECT * FROM trips_timed EXCEPT ALL SELECT * FROM trips_excluded")
_money = ", ".join(f"{rounded(c)} AS {c}" for c in (
    "trip_distance", "fare_amount", "extra", "mta_tax", "tip_amount", "tolls_amount", "ehail_fee",
    "improvement_surcharge", "total_amount", "congestion_surcharge", "cbd_congestion_fee"))
_codes = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in (
    "VendorID", "RatecodeID", "PULocationID", "DOLocationID", "passenger_count", "payment_type", "trip_type"))
BLOCKS["trips_typed"] = (("trips_kept",), f"""
  SELECT {_codes}, lpep_pickup_datetime, lpep_dropoff_datetime, store_and_fwd_flag, {_money},
         CAST(minutes AS DECIMAL(10,2)) AS trip_duration_min
  FROM trips_kept""")
BLOCKS["trips"] = (("trips_typed",), """
  SELECT *,
         coalesce(VendorID = 6 AND RatecodeID IS NULL, false) AS flag_vendor6_incomplete,
         coalesce(trip_duration_min = 0 AND trip_distance <> 0, false) AS flag_zero_duration_nonzero_distance,
         coalesce(trip_duration_min = 0 AND trip_distance = 0 AND fare_amount > 0, false) AS flag_no_real_dropoff,
         coalesce(fare_amount < 0, false) OR coalesce(total_amount < 0, false) AS flag_negative_fare,
         coalesce(tip_amount < 0, false) AS flag_negative_tip,
         coalesce(passenger_count = 0, false) AS flag_zero_passengers
  FROM trips_typed""")
BLOCKS["fact"] = (("trips",), f"""
  SELECT PULocationID AS pu_location_id, DOLocationID AS do_location_id,
         {hour_key('lpep_pickup_datetime')} AS pickup_date_hour_key,
         lpep_pickup_datetime AS pickup_datetime, lpep_dropoff_datetime AS dropoff_datetime,
         CAST(hour(lpep_pickup_datetime) AS INTEGER) AS pickup_hour,
         CAST(hour(lpep_dropoff_datetime) AS INTEGER) AS dropoff_hour,
         passenger_count, trip_distance, {rounded(_MINUTES)} AS trip_duration_min, fare_amount, total_amount
  FROM trips
  WHERE lpep_pickup_datetime IS NOT NULL AND lpep_dropoff_datetime IS NOT NULL AND {_MINUTES} BETWEEN 1.0 AND 1440.0""")
BLOCKS["dim_date"] = (("trips",), f"""
  SELECT DISTINCT {hour_key('lpep_pickup_datetime')} AS date_hour_key,
         CAST(lpep_pickup_datetime AS DATE) AS full_date,
         CAST(hour(lpep_pickup_datetime) AS INTEGER) AS pickup_hour,
         CAST(year(lpep_pickup_datetime) AS INTEGER) AS year, CAST(month(lpep_pickup_datetime) AS INTEGER) AS month,
         CAST(day(lpep_pickup_datetime) AS INTEGER) AS day, dayname(lpep_pickup_datetime) AS day_of_week,
         dayofweek(lpep_pickup_datetime) IN (0, 6) AS is_weekend
  FROM trips WHERE lpep_pickup_datetime IS NOT NULL""")
BLOCKS["order_fact"] = ((), """
  SELECT c_nationkey + 1 AS pu_location_id, s_nationkey + 1 AS do_location_id,
         l_quantity AS trip_distance, l_extendedprice AS total_amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey
  WHERE epoch(l_shipdate) - epoch(o_orderdate) BETWEEN 86400 AND 86400 * 180""")


def _weather(by_place: bool) -> str:
    place = "CAST(user_id % 5 AS INTEGER)" if by_place else "2"
    return f"""
  SELECT CASE WHEN NOT (lo = 7 AND hi = 97) THEN h END AS observation_time,
         {rounded('c / (n * 100) - 40', 1)} AS temperature_2m,
         CASE WHEN lo % 3 = 0 THEN lo / 10 ELSE 0 END AS precipitation,
         CASE WHEN hi % 11 <> 0 THEN (lo % 4 - 1) / 10 END AS rain,
         CASE WHEN lo % 5 = 0 THEN (hi % 7) / 10 WHEN lo % 5 <> 1 THEN 0 END AS snowfall,
         CAST(hi AS BIGINT) AS weather_code, c / 100 AS wind_speed_10m,
         (CAST(403.5 AS DOUBLE) + p * CAST(1.5 AS DOUBLE)) / 10 AS latitude, CAST(-73.95 AS DOUBLE) AS longitude,
         ' America/New_York ' AS timezone, CAST(10 AS DOUBLE) AS elevation, {pick('p', PLACES)} AS borough
  FROM (SELECT date_trunc('hour', ts) AS h, {place} AS p, CAST(SUM(cents) AS BIGINT) AS c, COUNT(*) AS n,
               MIN(k) AS lo, MAX(k) AS hi
        FROM ev GROUP BY 1, 2)"""


BLOCKS["weather_raw"] = (("ev",), _weather(False))
BLOCKS["place_weather_raw"] = (("ev",), _weather(True))
_WEATHER_CLEAN = """
  SELECT DISTINCT elevation, latitude, longitude, observation_time, precipitation, rain, snowfall, temperature_2m,
         trim(timezone) AS timezone, CAST(weather_code AS INTEGER) AS weather_code, wind_speed_10m
  FROM {source} WHERE observation_time IS NOT NULL"""
BLOCKS["weather"] = (("weather_raw",), _WEATHER_CLEAN.format(source="weather_raw"))
BLOCKS["place_weather"] = (("place_weather_raw",), _WEATHER_CLEAN.format(source="place_weather_raw"))
_WEATHER_DIM = f"""
  SELECT {hour_key('observation_time')} AS date_hour_key, CAST(observation_time AS DATE) AS observation_date,
         CAST(hour(observation_time) AS INTEGER) AS observation_hour, {{place}}
         temperature_2m, precipitation, rain, snowfall, weather_code, wind_speed_10m
  FROM {{source}} WHERE observation_time IS NOT NULL"""
BLOCKS["dim_weather"] = (("weather",), _WEATHER_DIM.format(place="", source="weather"))
BLOCKS["dim_place_weather"] = (("place_weather_raw",), _WEATHER_DIM.format(place="borough,", source="place_weather_raw"))

_undated = "event_type IN ('click', 'signup')"
BLOCKS["entries_unkeyed"] = (("ev",), f"""
  SELECT {pick('user_id % 6', [s[0] for s in SECTIONS])} AS section_id,
         {pick('user_id % 6', [s[1] for s in SECTIONS])} AS section_name,
         'Location ' || user_id AS location_name,
         CASE WHEN k = 87 THEN NULL WHEN event_type = 'purchase' THEN 'event' ELSE 'construction' END AS entry_type,
         CASE event_type WHEN 'click' THEN 'Route' WHEN 'signup' THEN 'Formation' END AS detail_label,
         CASE WHEN {_undated} THEN 'Street ' || k % 5 || ' between Avenue ' || k % 5 || ' and Avenue 1' || k % 5
              ELSE event_type || ' work ' || k % 5 END AS advisory_text,
         CASE WHEN {_undated} THEN 'Street ' || k % 5 END AS street_name,
         CASE WHEN {_undated} THEN 'Avenue ' || k % 5 END AS from_street,
         CASE WHEN {_undated} THEN 'Avenue 1' || k % 5 END AS to_street,
         CASE WHEN NOT {_undated} THEN strftime(ts, '%Y-%m-%d') END AS date_first_mentioned,
         CASE WHEN NOT {_undated} THEN strftime(CAST(ts AS DATE) + CASE WHEN k = 86 THEN -1 ELSE k % 4 END, '%Y-%m-%d') END AS date_last_mentioned,
         CASE WHEN {_undated} THEN 0 ELSE 2 END AS n_dates_mentioned,
         strftime(date_trunc('week', ts), '%Y-%m-%d') AS advisory_week_start,
         strftime(CAST(date_trunc('week', ts) AS DATE) + 6, '%Y-%m-%d') AS advisory_week_end,
         '' AS advisory_week_text, 'https://example.org/advisories' AS source_url,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS scraped_at_iso,
         strftime(date_trunc('week', ts), '%Y-%m-%d') AS scrape_date,
         'advisory_feed' AS source_system,
         'batch_' || strftime(date_trunc('week', ts), '%Y-%m-%d') AS batch_id
  FROM ev""")
_BK = "sha256(concat_ws('|', section_id, location_name, coalesce(detail_label, '~'), advisory_text))"
_SK = "sha256(concat_ws('|', scrape_date, section_id, location_name, coalesce(detail_label, '~'), advisory_text))"
BLOCKS["entries"] = (("entries_unkeyed",), f"SELECT *, {_SK} AS advisory_sk FROM entries_unkeyed")
BLOCKS["advisories"] = (("entries",), """
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY advisory_sk ORDER BY location_name,
      date_first_mentioned NULLS FIRST, date_last_mentioned NULLS FIRST, entry_type NULLS FIRST, scraped_at_iso) AS rn
    FROM entries) WHERE rn = 1""")
BLOCKS["sightings"] = (("advisories",), f"""
  SELECT {_BK} AS closure_bk, section_id, section_name,
         CASE WHEN section_name LIKE '%Crossings%' THEN 'Crossings' ELSE split_part(section_name, '/', 1) END AS borough,
         location_name, entry_type, detail_label, street_name, from_street, to_street, advisory_text,
         TRY_CAST(date_first_mentioned AS DATE) AS effective_from, TRY_CAST(date_last_mentioned AS DATE) AS effective_to,
         TRY_CAST(advisory_week_start AS DATE) AS advisory_week_start, TRY_CAST(advisory_week_end AS DATE) AS advisory_week_end,
         TRY_CAST(scrape_date AS DATE) AS scrape_dt, source_system, source_url, batch_id
  FROM advisories""")
BLOCKS["history"] = (("sightings",), """
  SELECT f.closure_bk, f.section_id, f.section_name, f.borough, f.location_name, f.entry_type, f.detail_label,
         f.street_name, f.from_street, f.to_street, f.advisory_text, f.effective_from,
         (SELECT e.effective_to FROM sightings e WHERE e.closure_bk = f.closure_bk AND e.effective_to IS NOT NULL
          ORDER BY e.scrape_dt DESC LIMIT 1) AS effective_to,
         f.advisory_week_start, f.advisory_week_end, f.scrape_dt AS first_seen_scrape, g.last_dt AS last_seen_scrape,
         g.last_dt = (SELECT MAX(scrape_dt) FROM sightings) AS is_current, CAST(g.n AS INTEGER) AS times_seen,
         f.source_system, f.source_url, l.batch_id
  FROM (SELECT closure_bk, MIN(scrape_dt) AS first_dt, MAX(scrape_dt) AS last_dt, COUNT(DISTINCT scrape_dt) AS n
        FROM sightings GROUP BY closure_bk) g
  JOIN sightings f ON f.closure_bk = g.closure_bk AND f.scrape_dt = g.first_dt
  JOIN sightings l ON l.closure_bk = g.closure_bk AND l.scrape_dt = g.last_dt""")
BLOCKS["dim_advisory"] = (("history",), """
  SELECT closure_bk AS advisory_id, section_id, entry_type AS advisory_type, advisory_text AS description, borough,
         location_name, street_name, from_street, to_street,
         coalesce(effective_from, advisory_week_start) AS effective_from,
         coalesce(effective_to, advisory_week_end) AS effective_to
  FROM history WHERE closure_bk IS NOT NULL""")

# Pages: cut the markup in front of every block, then number sections and places with
# running counts and carry headings by window functions.
_OPENERS = "p|li|ul|ol|dl|h[1-6]|div|article|section|nav|header|footer|main|aside|table|form|hr"
_CLOSERS = "ul|ol|dl|div|article|section|nav|header|footer|main|aside|table|form|body|html"
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
BLOCKS["pages_marked"] = ((), r"""
  SELECT page_id, url, replace(replace(replace(regexp_replace(replace(html, '<nav>',
      '<h2>Weekly Traffic Advisory for Monday January ' || (page_id % 28 + 1) || 'th, 2024 to FEBRUARY 3, 2024</h2><p>Lead text</p>'
      || '<h2 id="nav">East River Bridge Crossings</h2><h3>Navigation</h3>'
      || CASE WHEN page_id % 3 <> 0 THEN '<strong>Route:</strong>' ELSE '' END),
    '<li><a href="/([^"]*)">([^<]*)</a></li>',
    CASE WHEN page_id % 5 = 0 THEN '<li><p>\2&rsquo;s ' ELSE '<li>\2&#146;s ' END
      || CASE WHEN page_id % 2 = 0 THEN 'between' ELSE 'bet' END || ' \1 &ndash; &#38;lt; and \2'
      || CASE WHEN page_id % 5 = 0 THEN '</p></li>' ELSE '</li>' END, 'g'),
    '<h1>', '<h2 id="article">'),
    '</h1>', '</h2><p>No place yet</p><h4>Body</h4><p>*Note: skipped</p><h3>Festivals, Parades and Events</h3>'),
    '</p>', ' from March 2nd, 2024 to March ' || (page_id % 35) || ', 2024</p>') AS html
  FROM pages""")
BLOCKS["page_pieces"] = (("pages_marked",), rf"""
  SELECT page_id, url, list_position, piece FROM (
    SELECT page_id, url, unnest(parts) AS piece, generate_subscripts(parts, 1) AS list_position FROM (
      SELECT page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(
        replace(replace(html, '<li><p>', '<li>'), '</p></li>', '</li>'), '{_HIDDEN}', ' ', 'g'),
        '(?i)<({_OPENERS}|strong)\b', chr(1) || '<\1', 'g'), '(?i)</({_CLOSERS})\b', chr(1) || '</\1', 'g'), chr(1)) AS parts
      FROM pages_marked))
  WHERE regexp_matches(piece, '(?i)^<(h2|h3|h4|strong|p|li)\b')""")
# References decode once: an ampersand that comes out of one is put aside until the end.
_entities = "x"
for _name, _char in (("&#38;", "\x02"), ("&#146;", "\u2019"), ("&rsquo;", "\u2019"), ("&ndash;", "\u2013"), ("&nbsp;", " "),
                     ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&amp;", "\x02"), ("\x02", "&")):
    _entities = f"replace({_entities}, '{_name}', '{_char}')"
BLOCKS["blocks"] = (("page_pieces",), rf"""
  SELECT page_id, url, CAST(ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY list_position) - 1 AS INTEGER) AS pos, tag,
         NULLIF(regexp_extract(piece, '(?i)^<[a-z0-9]+[^>]*\sid\s*=\s*"([^"]*)"', 1), '') AS block_id,
         trim(regexp_replace({_entities}, '[\s\x{{00A0}}]+', ' ', 'g')) AS text
  FROM (SELECT *, regexp_replace(regexp_replace(regexp_extract(piece, '(?is)^<[a-z0-9]+[^>]*>(.*)$', 1),
                  '(?is)</' || tag || '\s*>.*$', ''), '<[^>]*>', ' ', 'g') AS x
        FROM (SELECT *, lower(regexp_extract(piece, '^<([A-Za-z0-9]+)', 1)) AS tag FROM page_pieces))""")
_LABELS = "|".join(label.replace("(", r"\(").replace(")", r"\)") for label in FIELD_LABELS)
_LABEL_PATTERN = rf"(?i)^({_LABELS})\s*:\s*$"
_noise = "(text = '' OR text LIKE '*Note%')"
_marker = r"regexp_matches(text, '(?i)^Festivals?,?\s*Parades and Events$')"
BLOCKS["numbered"] = (("blocks",), rf"""
  SELECT *, SUM(CASE WHEN is_location THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, section_no ORDER BY pos) AS location_no
  FROM (SELECT *, SUM(CASE WHEN tag = 'h2' AND block_id IS NOT NULL THEN 1 ELSE 0 END)
               OVER (PARTITION BY page_id ORDER BY pos) AS section_no
        FROM (SELECT *, tag = 'strong' AND regexp_matches(text, '{_LABEL_PATTERN}') AS is_label,
               (tag IN ('h3', 'h4') OR (tag = 'strong' AND NOT regexp_matches(text, '{_LABEL_PATTERN}')
                AND length(text) <= {MAX_HEADING_LENGTH})) AND NOT {_noise} AND NOT {_marker} AS is_location,
               (tag IN ('h3', 'h4') OR (tag = 'strong' AND length(text) <= {MAX_HEADING_LENGTH})) AND {_marker} AS is_marker
              FROM blocks))""")
BLOCKS["carried"] = (("numbered",), rf"""
  SELECT *,
         FIRST_VALUE(block_id) OVER (PARTITION BY page_id, section_no ORDER BY pos) AS section_id,
         FIRST_VALUE(text) OVER (PARTITION BY page_id, section_no ORDER BY pos) AS section_name,
         FIRST_VALUE(text) OVER (PARTITION BY page_id, section_no, location_no ORDER BY pos) AS location_name,
         LAST_VALUE(CASE WHEN is_label THEN regexp_extract(text, '{_LABEL_PATTERN}', 1) END IGNORE NULLS)
           OVER (PARTITION BY page_id, section_no, location_no ORDER BY pos ROWS UNBOUNDED PRECEDING) AS open_label,
         CASE WHEN SUM(CASE WHEN is_marker THEN 1 ELSE 0 END)
           OVER (PARTITION BY page_id, section_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0
           THEN 'event' ELSE 'construction' END AS entry_type
  FROM numbered WHERE section_no > 0""")
BLOCKS["placed"] = (("carried",), "SELECT * FROM carried WHERE location_no > 0 AND NOT is_location")


def dates_in(text: str) -> str:
    """List of the valid dates a text names."""
    pattern = DATE_IN_PROSE
    parts = [f"regexp_extract(m, '{pattern}', {i})" for i in (1, 2, 3)]
    return (
        f"list_filter(list_transform(regexp_extract_all({text}, '{pattern}', 0), lambda m: "
        f"CAST(try_strptime(upper({parts[0]}[1:1]) || lower({parts[0]}[2:]) || ' ' || {parts[1]} || ' ' || {parts[2]}, '%B %d %Y') AS DATE)), "
        f"lambda d: d IS NOT NULL)"
    )


BLOCKS["weeks"] = (("blocks",), f"""
  SELECT p.page_id, coalesce(h.text, '') AS advisory_week_text,
         {dates_in("coalesce(h.text, '')")}[1] AS advisory_week_start, {dates_in("coalesce(h.text, '')")}[2] AS advisory_week_end
  FROM pages p LEFT JOIN (
    SELECT page_id, text FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY pos) AS rn FROM blocks
      WHERE tag = 'h2' AND contains(text, 'Weekly Traffic Advisory for')) WHERE rn = 1) h ON p.page_id = h.page_id""")
_split = f"regexp_matches(text, '{STREET_SEGMENT}')"
BLOCKS["page_entries"] = (("placed", "weeks"), f"""
  SELECT c.page_id, url, pos, section_id, section_name, location_name, entry_type,
         CASE WHEN tag = 'li' THEN open_label END AS detail_label, text AS advisory_text,
         CASE WHEN tag = 'li' THEN CASE WHEN {_split} THEN trim(regexp_extract(text, '{STREET_SEGMENT}', 1)) ELSE text END END AS street_name,
         CASE WHEN tag = 'li' AND {_split} THEN trim(regexp_extract(text, '{STREET_SEGMENT}', 2)) END AS from_street,
         CASE WHEN tag = 'li' AND {_split} THEN trim(regexp_extract(text, '{STREET_SEGMENT}', 3)) END AS to_street,
         CASE WHEN tag = 'p' THEN strftime(d[1], '%Y-%m-%d') END AS date_first_mentioned,
         CASE WHEN tag = 'p' THEN strftime(d[-1], '%Y-%m-%d') END AS date_last_mentioned,
         CASE WHEN tag = 'p' THEN CAST(len(d) AS INTEGER) ELSE 0 END AS n_dates_mentioned,
         strftime(w.advisory_week_start, '%Y-%m-%d') AS advisory_week_start,
         strftime(w.advisory_week_end, '%Y-%m-%d') AS advisory_week_end, w.advisory_week_text
  FROM (SELECT *, {dates_in('text')} AS d FROM placed) c JOIN weeks w ON c.page_id = w.page_id
  WHERE text <> '' AND ((tag = 'p' AND text NOT LIKE '*Note%') OR (tag = 'li' AND (open_label IS NOT NULL OR {_split})))""")


def _closure(names: tuple[str, ...]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in BLOCKS[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def statement(body: str, *needs: str, **local: str) -> str:
    """A body with the building blocks (and local named selects) it needs in front."""
    ctes = [f"{name} AS ({BLOCKS[name][1]})" for name in _closure(needs)]
    ctes += [f"{name} AS ({select})" for name, select in local.items()]
    return f"WITH {', '.join(ctes)}\n{body}" if ctes else body


# --- data-quality statements: one UNION ALL branch per check -----------------------------

_SHARE = "100.0 * failed_rows / NULLIF(total_rows, 0)"
_STATUS = {
    "fail": "CASE WHEN failed_rows = 0 THEN 'PASS' ELSE 'FAIL' END",
    "warn": "CASE WHEN failed_rows = 0 THEN 'PASS' ELSE 'WARN' END",
    "percent": f"CASE WHEN failed_rows = 0 THEN 'PASS' WHEN {_SHARE} < 5 THEN 'WARN' ELSE 'FAIL' END",
    "placeholder": f"CASE WHEN {_SHARE} > 5 THEN 'FAIL' WHEN failed_rows > 0 THEN 'WARN' ELSE 'PASS' END",
    "tolerated": "CASE WHEN failed_rows <= 3 THEN 'PASS' ELSE 'WARN' END",
}


def check_row(column: str, dimension: str, failed: str, total_rows: str, policy: str, dataset: str | None = None) -> str:
    label = f"'{dataset}' AS dataset, " if dataset else ""
    return (
        f'SELECT {label}"column", data_quality_check, failed_rows, total_rows, '
        f"{rounded(_SHARE)} AS percentage, {_STATUS[policy]} AS status FROM (SELECT '{column}' AS \"column\", "
        f"'{dimension}' AS data_quality_check, CAST(({failed}) AS BIGINT) AS failed_rows, "
        f"CAST(({total_rows}) AS BIGINT) AS total_rows)"
    )


def check_rows(rows) -> str:
    return "\nUNION ALL\n".join(rows)


def _count(table: str, condition: str = "true") -> str:
    return f"SELECT COUNT(*) FROM {table} WHERE {condition}"


def trip_check_rows() -> list[str]:
    p, d = "lpep_pickup_datetime", "lpep_dropoff_datetime"
    start, end = (f"TIMESTAMP '{t}'" for t in WINDOW)
    zero = "trip_duration_min = 0"
    q1, q3 = (f"(SELECT quantile_disc(trip_distance, {q}) FROM trips)" for q in (0.25, 0.75))
    low, high = f"greatest(0.0, {q1} - 1.5 * ({q3} - {q1}))", f"{q3} + 1.5 * ({q3} - {q1})"
    failing = [
        *[(c, "Completeness", f"{c} IS NULL", "fail") for c in (p, d, "PULocationID", "DOLocationID", "total_amount")],
        ("ehail_fee", "Completeness", "ehail_fee IS NULL", "warn"),
        ("VendorID_6_Metadata", "Completeness", "VendorID = 6 AND RatecodeID IS NULL", "warn"),
        *[(c, "Validity", f"NOT ({c} BETWEEN 1 AND 263)", "warn") for c in ("PULocationID", "DOLocationID")],
        ("VendorID", "Validity", f"VendorID NOT IN {in_list(r.VENDORS)}", "warn"),
        ("RatecodeID", "Validity", f"RatecodeID NOT IN {in_list(r.RATE_CODES)}", "fail"),
        ("payment_type", "Validity", f"payment_type NOT IN {in_list(r.PAYMENT_TYPES)}", "fail"),
        ("trip_type", "Validity", f"trip_type NOT IN {in_list(r.TRIP_TYPES)}", "fail"),
        ("passenger_count", "Validity", "passenger_count <= 0", "warn"),
        (p, "Timeliness", f"{p} < {start} OR {p} >= {end}", "fail"),
        (p, "Timeliness", f"{p} < {start}", "warn"),
        (d, "Consistency", f"{d} < {p}", "fail"),
        ("trip_duration_min", "Consistency", f"{zero} AND trip_distance > 0", "warn"),
        ("trip_duration_min", "Consistency", f"{zero} AND trip_distance = 0 AND fare_amount > 0", "warn"),
        ("trip_duration_min", "Consistency", "trip_duration_min > 180", "warn"),
        *[(c, "Accuracy", f"{c} < 0", "warn") for c in ("fare_amount", "total_amount", "tip_amount")],
        ("trip_distance", "Accuracy", "trip_distance > 100", "warn"),
        ("trip_distance", "Accuracy", f"trip_distance < {low} OR trip_distance > {high}", "warn"),
    ]
    rows = [check_row(c, dim, _count("trips", bad), _count("trips"), policy) for c, dim, bad, policy in failing]
    rows.append(check_row(
        "ALL_COLUMNS", "Uniqueness", "(SELECT COUNT(*) FROM trips) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM trips))",
        _count("trips"), "fail"))
    return rows


def weather_check_rows(source: str = "weather") -> list[str]:
    def two(c: str, second: str, bad: str) -> list[tuple[str, str, str]]:
        return [(c, "Completeness", f"{c} IS NULL"), (c, second, bad)]

    failing = [
        ("elevation", "Validity", "elevation IS NULL OR elevation < -500 OR elevation > 9000"),
        ("latitude", "Accuracy", "latitude IS NULL OR latitude NOT BETWEEN 40.4 AND 41.0"),
        ("longitude", "Accuracy", "longitude IS NULL OR longitude NOT BETWEEN -74.3 AND -73.6"),
        *two("observation_time", "Timeliness", f"observation_time > TIMESTAMP '{NOW}'"),
        *two("precipitation", "Accuracy", "precipitation < 0"),
        *two("rain", "Accuracy", "rain < 0"),
        *two("snowfall", "Accuracy", "snowfall < 0"),
        *two("temperature_2m", "Validity", "temperature_2m < -90 OR temperature_2m > 60"),
        *two("timezone", "Consistency", "timezone <> 'America/New_York'"),
        *two("weather_code", "Validity", f"weather_code NOT IN {in_list(r.WMO_CODES)}"),
        *two("wind_speed_10m", "Validity", "wind_speed_10m < 0 OR wind_speed_10m > 500"),
    ]
    rows = [check_row(c, dim, _count(source, bad), _count(source), "percent") for c, dim, bad in failing]
    rows.append(check_row(
        "latitude, longitude, observation_time", "Uniqueness",
        f"SELECT COUNT(*) FROM (SELECT 1 FROM {source} GROUP BY latitude, longitude, observation_time HAVING COUNT(*) > 1)",
        _count(source), "percent"))
    return rows


def zone_check_rows() -> list[str]:
    n = _count("zones")
    rows = [
        check_row("location_id", "Completeness", _count("zones", "location_id IS NULL"), n, "fail"),
        check_row("location_id", "Uniqueness", "SELECT COUNT(*) - COUNT(DISTINCT location_id) FROM zones", n, "fail"),
        check_row("location_id", "Validity", _count("zones_raw", "TRY_CAST(LocationID AS INTEGER) IS NULL"), n, "fail"),
        check_row("location_id", "Accuracy", _count("zones", "location_id < 1 OR location_id > 265"), n, "fail"),
        check_row("zone", "Uniqueness",
                  "SELECT COUNT(*) - COUNT(DISTINCT zone) - COUNT(*) FILTER (WHERE zone IS NULL) FROM zones", n, "tolerated"),
    ]
    for c in ("borough", "zone", "service_zone"):
        rows.append(check_row(c, "Completeness", _count("zones", f"{c} IS NULL AND location_id NOT IN (264, 265)"), n, "fail"))
        names = r.ZONE_NAME_PLACEHOLDERS if c == "zone" else r.PLACEHOLDERS
        rows.append(check_row(c, "Validity", _count("zones", f"{c} IN {in_list(names)}"), n, "placeholder"))
    for c, known in (("borough", r.BOROUGHS), ("service_zone", r.SERVICE_ZONES)):
        bad = f"{c} IS NOT NULL AND {c} NOT IN {in_list((*known, *r.PLACEHOLDERS))}"
        rows.append(check_row(c, "Validity", _count("zones", bad), n, "fail"))
    return rows


def advisory_check_rows() -> list[str]:
    newest = "scrape_date = (SELECT MAX(scrape_date) FROM advisories)"
    raw, clean = _count("advisories"), _count("history")
    keys = f"SELECT DISTINCT {_BK} AS bk FROM advisories WHERE {newest}"
    places = f"SELECT COUNT(DISTINCT location_name) FROM advisories WHERE {newest}"
    return [
        check_row("ALL_COLUMNS (raw, latest scrape)", "Completeness",
                  f"CASE WHEN ({_count('advisories', newest)}) > 0 THEN 0 ELSE 1 END", _count("advisories", newest), "fail"),
        check_row("location_name (raw)", "Validity", f"CASE WHEN ({places}) > 20 THEN 0 ELSE 1 END", places, "percent"),
        check_row("advisory_sk (raw)", "Uniqueness", "SELECT COUNT(*) - COUNT(DISTINCT advisory_sk) FROM advisories", raw, "fail"),
        check_row("scrape_date (raw)", "Timeliness", _count("advisories", f"CAST(scrape_date AS DATE) > DATE '{TODAY}'"), raw, "fail"),
        check_row("closure_bk", "Uniqueness", "SELECT COUNT(*) - COUNT(DISTINCT closure_bk) FROM history", clean, "fail"),
        check_row("closure_bk", "Completeness", _count("history", "closure_bk IS NULL"), clean, "fail"),
        check_row("effective_from, effective_to", "Validity", _count("history", "effective_from > effective_to"), clean, "percent"),
        check_row("borough", "Validity", _count("history", f"borough NOT IN {in_list(r.ADVISORY_BOROUGHS)}"), clean, "percent"),
        check_row("closure_bk", "Accuracy",
                  f"SELECT COUNT(*) FROM ({keys}) WHERE bk NOT IN (SELECT closure_bk FROM history)", f"SELECT COUNT(*) FROM ({keys})", "fail"),
        check_row("times_seen", "Consistency",
                  _count("history", "times_seen > (SELECT COUNT(DISTINCT scrape_date) FROM advisories)"), clean, "fail"),
    ]


def mart_check_rows() -> list[str]:
    n = _count("fact")
    rows = [
        check_row(c, "Completeness", _count("fact", f"{c} IS NULL"), n, "fail", "fact_trip")
        for c in ("pu_location_id", "do_location_id", "pickup_date_hour_key")
    ]
    rows.append(check_row("trip_duration_min", "Validity", _count("fact", "trip_duration_min NOT BETWEEN 1 AND 1440"), n, "fail", "fact_trip"))
    for key, dim, dim_key in (
        ("pu_location_id", "dim_zone", "location_id"), ("do_location_id", "dim_zone", "location_id"),
        ("pickup_date_hour_key", "dim_date", "date_hour_key"), ("pickup_date_hour_key", "dim_weather", "date_hour_key"),
    ):
        rows.append(check_row(
            f"{key} -> {dim}", "Consistency",
            _count("fact", f"{key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {dim} WHERE {dim_key} = {key})"), n, "percent", "fact_trip"))
    for dim, key in (("dim_zone", "location_id"), ("dim_date", "date_hour_key"), ("dim_weather", "date_hour_key"),
                     ("dim_advisory", "advisory_id")):
        rows.append(check_row(key, "Uniqueness", f"SELECT COUNT({key}) - COUNT(DISTINCT {key}) FROM {dim}", _count(dim), "fail", dim))
        rows.append(check_row(key, "Completeness", _count(dim, f"{key} IS NULL"), _count(dim), "fail", dim))
    flows = "SELECT COUNT(*) FROM fact JOIN dim_zone a ON pu_location_id = a.location_id JOIN dim_zone b ON do_location_id = b.location_id"
    hours = "SELECT COUNT(*) FROM fact JOIN dim_date ON pickup_date_hour_key = date_hour_key"
    weather = "SELECT COUNT(*) FROM fact JOIN dim_weather ON pickup_date_hour_key = date_hour_key"
    identity = "SELECT DISTINCT pu_location_id, do_location_id, pickup_datetime, dropoff_datetime FROM fact"
    trips = f"SELECT COUNT(*) FROM ({identity})"
    placed = f"SELECT COUNT(*) FROM ({identity}) JOIN dim_zone ON pu_location_id = location_id"
    picked = "SELECT COUNT(*) FROM fact JOIN dim_zone ON pu_location_id = location_id"
    for name, counted, expected in (
        ("borough_flow_analytics", flows, n), ("temporal_patterns_and_behaviors", hours, n), ("kpi_summary", n, n),
        ("weather_impact_analysis", weather, n), ("traffic_advisory_and_incident_impact", placed, trips),
        ("top_pickup_zones", picked, n),
    ):
        rows.append(check_row("total_trips", "Accuracy", f"abs(({counted}) - ({expected}))", expected, "percent", name))
    return rows


def unified_rows() -> str:
    """The four clean-layer result sets under one roof."""
    sets = {
        "Green Taxi": trip_check_rows(), "Weather": weather_check_rows(),
        "Taxi Zones": zone_check_rows(), "Traffic Advisory": advisory_check_rows(),
    }
    return check_rows(f"SELECT '{name}' AS dataset, * FROM ({row})" for name, rows in sets.items() for row in rows)


UNIFIED_NEEDS = ("trips", "weather", "zones", "advisories", "history")
AS_OF_DATE = AS_OF

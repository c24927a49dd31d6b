"""SQL twins of ``leasegrid.sources.testdata`` (and the shared cleaning step),
written once so every oracle query can start from the same CTEs.

The text runs on DuckDB over the driver's pre-registered views.
"""

from __future__ import annotations

from ..functions import constants as K
from ..sources.testdata import PRIORITY_TO_RAW_TYPE, RAW_TYPE_VARIANTS, REQUEST_MODES, REQUEST_TYPES


def _case(expr: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {expr} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"(CASE {whens} END)"


def normalize_type_sql(x: str) -> str:
    canon = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.PROPERTY_TYPE_CANONICAL.items())
    return f"(CASE WHEN trim({x}) = '' THEN NULL ELSE COALESCE(CASE lower(trim({x})) {canon} END, trim({x})) END)"


def coord_sql(key: str, mult: int, base: int) -> str:
    return f"({base}.0 + CAST(({key} * {mult}) % 10000 AS DOUBLE) / 20000.0)"


RAW_LISTINGS = f"""
raw_listings AS (
  SELECT
    o_orderkey AS row_id,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS listing_id,
    CAST(o_custkey % 500 AS VARCHAR) || ' Main St' AS address,
    CASE WHEN o_orderkey % 4 = 0 THEN 'Apt ' || CAST(o_orderkey % 50 AS VARCHAR) END AS address2,
    'NATION_' || CAST(o_custkey % 25 AS VARCHAR) AS city,
    'MI' AS state,
    CAST(48100 + o_custkey % 100 AS VARCHAR) AS zip,
    'm' || CAST(o_custkey % 25 AS VARCHAR) AS city_slug,
    CASE WHEN o_orderkey % 23 = 0 THEN 'N/A'
         WHEN o_orderkey % 29 = 0 THEN ''
         ELSE '$' || (CASE WHEN _dollars >= 1000
                           THEN CAST(CAST(floor(_dollars / 1000) AS BIGINT) AS VARCHAR) || ',' || lpad(CAST(_dollars % 1000 AS VARCHAR), 3, '0')
                           ELSE CAST(_dollars AS VARCHAR) END)
              || '.' || lpad(CAST(_cents % 100 AS VARCHAR), 2, '0') END AS price_raw,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 7 AS DOUBLE) END AS beds,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 1.0::DOUBLE + 0.5::DOUBLE * CAST(o_orderkey % 5 AS DOUBLE) END AS baths,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(150 + (o_orderkey * 37) % 5200 AS DOUBLE) END AS sqft,
    {coord_sql('o_orderkey', 7919, 42)} AS latitude,
    {coord_sql('o_orderkey', 104729, -84)} AS longitude,
    CASE WHEN o_orderkey % 19 = 0 THEN {_case(_case('o_orderpriority', PRIORITY_TO_RAW_TYPE), RAW_TYPE_VARIANTS)}
         WHEN o_orderkey % 97 = 0 THEN ''
         ELSE {_case('o_orderpriority', PRIORITY_TO_RAW_TYPE)} END AS property_type_raw,
    o_orderdate AS listed_date,
    CAST(o_custkey % 8 AS INTEGER) AS cluster_id
  FROM (SELECT *, CAST(floor(_cents / 100) AS BIGINT) AS _dollars FROM (
          SELECT *, CAST(floor(o_totalprice) AS BIGINT) * CASE WHEN o_orderkey % 61 = 0 THEN 9 ELSE 1 END AS _cents FROM orders) c) o
)"""

# standardize_listings: price text -> double, type spelling -> canonical.
LISTINGS = f"""
listings AS (
  SELECT row_id, listing_id, address, address2, city, state, zip, city_slug,
         CASE WHEN isnan(TRY_CAST(regexp_replace(price_raw, '[$,]', '', 'g') AS DOUBLE)) THEN NULL
              ELSE TRY_CAST(regexp_replace(price_raw, '[$,]', '', 'g') AS DOUBLE) END AS price,
         beds, baths, sqft, latitude, longitude,
         {normalize_type_sql('property_type_raw')} AS property_type,
         listed_date, cluster_id
  FROM raw_listings
)"""

MARKETS = """
markets AS (
  SELECT 'm' || CAST(n_nationkey AS VARCHAR) AS city_slug,
         n_name AS display_name,
         r_name AS state,
         42.05 + 0.1 * CAST(floor(n_nationkey / 5) AS DOUBLE) AS center_lat,
         -83.95 + 0.1 * CAST(n_nationkey % 5 AS DOUBLE) AS center_lon,
         CAST(3 + n_nationkey % 4 AS INTEGER) AS radius_miles,
         CAST(4 + n_nationkey % 5 AS INTEGER) AS n_clusters,
         CAST(n_nationkey AS INTEGER) AS market_ord
  FROM nation JOIN region ON n_regionkey = r_regionkey
)"""

PLACES = """
places AS (
  SELECT 42.05 + 0.1 * CAST(floor(n_nationkey / 5) AS DOUBLE) AS latitude,
         -83.95 + 0.1 * CAST(n_nationkey % 5 AS DOUBLE) AS longitude,
         CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END AS suburb,
         r_name AS city
  FROM nation JOIN region ON n_regionkey = r_regionkey
)"""


def _list_at(items: list[str], idx: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(items))
    return f"(CASE {idx} {whens} END)"


RAW_REQUESTS = f"""
raw_requests AS (
  SELECT c_custkey AS request_id,
         CAST(c_custkey % 500 AS VARCHAR) ||
           (CASE c_custkey % 4 WHEN 0 THEN ' Main St' WHEN 1 THEN ' Main Street' WHEN 2 THEN ' Main St Apt 4' ELSE ' Main St.' END) AS address,
         CAST(c_custkey % 12 AS INTEGER) AS beds,
         0.5::DOUBLE * CAST(c_custkey % 8 AS DOUBLE) AS baths,
         CAST(80 + (c_custkey * 53) % 10000 AS INTEGER) AS sqft,
         CASE WHEN c_custkey % 9 = 0 THEN 'Multi Family' ELSE {_list_at(REQUEST_TYPES, 'c_custkey % 5')} END AS property_type,
         {_list_at(REQUEST_MODES, 'c_custkey % 3')} AS prediction_mode,
         CAST(2 + c_custkey % 10 AS INTEGER) AS comps_k,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE {coord_sql('c_custkey', 7919, 42)} END AS latitude,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE {coord_sql('c_custkey', 104729, -84)} END AS longitude
  FROM customer
)"""


def with_views(*names: str) -> str:
    """``WITH`` clause holding the requested views (dependencies included)."""
    order = ["raw_listings", "listings", "markets", "places", "raw_requests"]
    deps = {"listings": ["raw_listings"]}
    text = {"raw_listings": RAW_LISTINGS, "listings": LISTINGS, "markets": MARKETS, "places": PLACES,
            "raw_requests": RAW_REQUESTS}
    want: set[str] = set()
    for n in names:
        want.add(n)
        want.update(deps.get(n, []))
    return "WITH " + ",\n".join(text[n].strip() for n in order if n in want)

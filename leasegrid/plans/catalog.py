"""Registered queries: Spark jobs over the driver's tables, each with the DuckDB
SQL that must give the same rows (where SQL can express the operator).

Every job reads whole tables; no sampling, id subsets or row caps.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.geo import haversine_sql
from ..operators import clean, comps, geo, rents
from ..operators import geocode as gc
from ..session import ensure_checkpoint_dir, prepare_session
from ..sources import testdata as td
from .geocode_sql import SQL_GEOCODED, SQL_VARIANTS
from .oracle_views import normalize_type_sql, with_views


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None, doc: str = ""):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            prepare_session(spark)
            return fn(spark, sf)

        REGISTRY[name] = Query(name, run, sql, doc or (fn.__doc__ or "").strip())
        return fn
    return deco


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ============================================================== shared stages
def listings(spark: SparkSession, sf: str) -> DataFrame:
    """Standardised listings (price parsed, type normalised)."""
    return clean.standardize_listings(td.raw_listings(spark, sf))


def processed_listings(spark: SparkSession, sf: str) -> DataFrame:
    """Reference processing order: impossible SqFt out, medians, imputation."""
    cleaned = clean.filter_impossible_sqft(listings(spark, sf))
    med = clean.bed_sqft_medians(cleaned)
    return clean.impute_listings(cleaned, med, flags=True)


SQL_CLEANED = "cleaned AS (SELECT * FROM listings WHERE sqft IS NULL OR (sqft BETWEEN 200 AND 5000))"
SQL_MEDIANS = """
med_raw AS (SELECT city_slug, CAST(beds AS INTEGER) AS beds, median(sqft) AS m
            FROM cleaned WHERE beds IN (0, 1, 2, 3, 4, 5) AND sqft IS NOT NULL GROUP BY 1, 2),
medians AS (SELECT f.city_slug, f.beds, COALESCE(CAST(trunc(m.m) AS INTEGER), 870) AS sqft_median
            FROM (SELECT c.city_slug, b.beds FROM (SELECT DISTINCT city_slug FROM cleaned) c,
                  (SELECT CAST(unnest(range(0, 6)) AS INTEGER) AS beds) b) f
            LEFT JOIN med_raw m ON f.city_slug = m.city_slug AND f.beds = m.beds)"""


def _type_default_sql(col: str, idx: int) -> str:
    whens = " ".join(f"WHEN '{t}' THEN {float(v[idx])}" for t, v in K.TYPE_DEFAULTS.items())
    return f"(CASE {col} {whens} END)"


SQL_IMPUTED = f"""
s1 AS (SELECT *, COALESCE(beds, CASE WHEN sqft IS NULL THEN NULL WHEN sqft < 450 THEN 0.0 WHEN sqft < 750 THEN 1.0
                                     WHEN sqft < 1100 THEN 2.0 WHEN sqft < 1500 THEN 3.0 ELSE 4.0 END) AS beds1
       FROM cleaned),
s2 AS (SELECT *, COALESCE(baths, CASE WHEN beds1 IS NULL THEN NULL WHEN beds1 < 4 THEN 1.0 ELSE 2.0 END) AS baths1,
              CASE WHEN beds1 > 5 THEN 5 WHEN beds1 IN (0, 1, 2, 3, 4, 5) THEN CAST(beds1 AS INTEGER) END AS mkey
       FROM s1),
imputed AS (
  SELECT s2.row_id, s2.listing_id, s2.address, s2.address2, s2.city, s2.state, s2.zip, s2.city_slug, s2.price,
         s2.latitude, s2.longitude, s2.property_type, s2.listed_date, s2.cluster_id,
         COALESCE(s2.beds1, {_type_default_sql('s2.property_type', 0)}, 2.0) AS beds,
         COALESCE(s2.baths1, {_type_default_sql('s2.property_type', 1)}, 1.0) AS baths,
         COALESCE(s2.sqft, CAST(md.sqft_median AS DOUBLE), 870.0) AS sqft,
         s2.beds IS NULL AS imputed_beds, s2.baths IS NULL AS imputed_baths, s2.sqft IS NULL AS imputed_sqft
  FROM s2 LEFT JOIN medians md ON s2.city_slug = md.city_slug AND s2.mkey = md.beds)"""


def with_processed(*extra: str) -> str:
    """``WITH`` clause up to the ``imputed`` view."""
    head = with_views("listings", *extra)
    return head + ",\n" + SQL_CLEANED + ",\n" + SQL_MEDIANS.strip() + ",\n" + SQL_IMPUTED.strip()


# ============================================================== AGG1 / AGG2
@register("avg_rents", with_views("raw_listings", "markets") + """
, rows AS (
  SELECT city_slug,
         CASE WHEN isnan(TRY_CAST(regexp_replace(price_raw, '[$,]', '', 'g') AS DOUBLE)) THEN NULL
              ELSE TRY_CAST(regexp_replace(price_raw, '[$,]', '', 'g') AS DOUBLE) END AS price,
         beds, """ + normalize_type_sql("property_type_raw") + """ AS property_type
  FROM raw_listings)
SELECT m.display_name || ', ' || m.state AS city, r.city_slug, r.property_type,
       CASE WHEN abs(r.beds - round(r.beds)) < 1e-6 THEN CAST(CAST(round(r.beds) AS BIGINT) AS VARCHAR) END AS beds,
       CAST(round_even(avg(r.price), 0) AS BIGINT) AS avg_price, count(*) AS listings, r.beds AS beds_value
FROM rows r JOIN markets m ON r.city_slug = m.city_slug
WHERE r.price IS NOT NULL AND r.beds IS NOT NULL AND r.property_type IS NOT NULL AND r.price > 0 AND r.beds >= 0
GROUP BY m.display_name, m.state, r.city_slug, r.property_type, r.beds
""")
def q_avg_rents(spark, sf):
    """Average rent and listing count by market, property type and beds (one scan, one shuffle)."""
    return rents.avg_rent_rows(td.raw_listings(spark, sf), td.markets(spark, sf))


@register("avg_rent_layout", REGISTRY["avg_rents"].sql.replace("\nSELECT m.display_name", "\n, agg AS (SELECT m.display_name", 1)
          + """)
SELECT city, city_slug, property_type, beds, avg_price, listings, beds_value,
       dense_rank() OVER (PARTITION BY city ORDER BY COALESCE(CASE property_type WHEN 'Apartment' THEN 0 WHEN 'Condo' THEN 1
            WHEN 'Townhouse' THEN 2 WHEN 'Single Family' THEN 3 WHEN 'Multi-Family' THEN 4 END, 999), property_type) AS type_order,
       dense_rank() OVER (PARTITION BY city ORDER BY beds_value) AS beds_order
FROM agg""")
def q_avg_rent_layout(spark, sf):
    """Per-city average-rent table coordinates (type display order, numeric bed order)."""
    return rents.avg_rent_table_layout(rents.avg_rent_rows(td.raw_listings(spark, sf), td.markets(spark, sf), ordered=False))


# ============================================================== cleaning
@register("clean_listings", with_views("listings") + """
SELECT row_id, listing_id, city_slug, price, beds, baths, sqft, property_type
FROM listings WHERE sqft IS NULL OR (sqft BETWEEN 200 AND 5000)""")
def q_clean_listings(spark, sf):
    """Coercion, currency text, type normalisation and the impossible-SqFt filter."""
    return clean.filter_impossible_sqft(listings(spark, sf)).select(
        "row_id", "listing_id", "city_slug", "price", "beds", "baths", "sqft", "property_type")


@register("sqft_medians", with_views("listings") + ",\n" + SQL_CLEANED + ",\n" + SQL_MEDIANS.strip() + """
SELECT city_slug, beds, sqft_median FROM medians""")
def q_sqft_medians(spark, sf):
    """Median SqFt per bed count 0..5 per market after the impossible-SqFt filter."""
    return clean.bed_sqft_medians(clean.filter_impossible_sqft(listings(spark, sf)))


@register("impute", with_processed() + """
SELECT row_id, city_slug, property_type, price, beds, baths, sqft, imputed_beds, imputed_baths, imputed_sqft
FROM imputed""")
def q_impute(spark, sf):
    """Filter, per-market medians, then the ordered Beds/Baths/SqFt imputation."""
    return processed_listings(spark, sf).select(
        "row_id", "city_slug", "property_type", "price", "beds", "baths", "sqft",
        "imputed_beds", "imputed_baths", "imputed_sqft")


@register("imputation_counts", with_processed() + """
SELECT city_slug, count(*) AS n_rows, count_if(imputed_beds) AS beds_imputed,
       count_if(imputed_baths) AS baths_imputed, count_if(imputed_sqft) AS sqft_imputed
FROM imputed GROUP BY city_slug""")
def q_imputation_counts(spark, sf):
    """Filled values per column and market."""
    return clean.imputation_counts(processed_listings(spark, sf))


@register("price_outliers", with_processed() + """
, b AS (SELECT city_slug, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3
        FROM imputed WHERE price IS NOT NULL GROUP BY city_slug),
bounds AS (SELECT city_slug, q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound FROM b)
SELECT i.city_slug, round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
       round(lower_bound, 6) AS lower_bound, round(upper_bound, 6) AS upper_bound,
       count(*) AS n_original,
       count_if(NOT COALESCE(price BETWEEN lower_bound AND upper_bound, false)) AS n_removed,
       count_if(COALESCE(price BETWEEN lower_bound AND upper_bound, false)) AS n_remaining,
       count_if(price < lower_bound) AS n_removed_low, count_if(price > upper_bound) AS n_removed_high,
       max(CASE WHEN price < lower_bound THEN price END) AS max_removed_low,
       min(CASE WHEN price > upper_bound THEN price END) AS min_removed_high
FROM imputed i JOIN bounds USING (city_slug)
GROUP BY i.city_slug, q1, q3, iqr, lower_bound, upper_bound""")
def q_price_outliers(spark, sf):
    """IQR bounds per market and the removal report (counts, extremes)."""
    df = processed_listings(spark, sf)
    rep = clean.price_outlier_report(df, clean.price_iqr_bounds(df))
    return rep.select("city_slug", *[r6(c).alias(c) for c in ("q1", "q3", "iqr", "lower_bound", "upper_bound")],
                      "n_original", "n_removed", "n_remaining", "n_removed_low", "n_removed_high",
                      "max_removed_low", "min_removed_high")


@register("price_outlier_rows", with_processed() + """
, b AS (SELECT city_slug, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3
        FROM imputed WHERE price IS NOT NULL GROUP BY city_slug),
bounds AS (SELECT city_slug, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound FROM b),
rows AS (SELECT i.city_slug, i.row_id, i.price,
                CASE WHEN price < lower_bound THEN 'low' WHEN price > upper_bound THEN 'high' END AS side
         FROM imputed i JOIN bounds USING (city_slug))
SELECT city_slug, side, row_number() OVER (PARTITION BY city_slug, side ORDER BY price, row_id) AS rank, price, row_id
FROM rows WHERE side IS NOT NULL""")
def q_price_outlier_rows(spark, sf):
    """Removed prices per market and side, in ascending order."""
    df = processed_listings(spark, sf)
    return clean.price_outlier_rows(df, clean.price_iqr_bounds(df))


@register("iqr_filtered", with_processed() + """
, b AS (SELECT city_slug, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3
        FROM imputed WHERE price IS NOT NULL GROUP BY city_slug)
SELECT i.row_id, i.city_slug, i.price FROM imputed i JOIN b USING (city_slug)
WHERE i.price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def q_iqr_filtered(spark, sf):
    """Training rows left after the per-market IQR price filter."""
    df = processed_listings(spark, sf)
    return clean.remove_price_outliers(df, clean.price_iqr_bounds(df)).select("row_id", "city_slug", "price")


SQL_DEDUPE_KEY = """CASE WHEN trim(listing_id) IS NOT NULL AND trim(listing_id) <> '' THEN 'id:' || lower(trim(listing_id))
     ELSE 'addr:' || concat_ws('|', lower(trim(COALESCE(address, ''))), lower(trim(COALESCE(address2, ''))),
                               lower(trim(COALESCE(city, ''))), lower(trim(COALESCE(state, ''))), lower(trim(COALESCE(zip, '')))) END"""

APPEND_CUTOFF = "1996-01-01"


@register("append_listings", with_views("listings") + f"""
, existing AS (SELECT * FROM listings WHERE listed_date < TIMESTAMP '{APPEND_CUTOFF}'),
keys AS (SELECT DISTINCT {SQL_DEDUPE_KEY} AS k FROM existing)
SELECT row_id, city_slug, {SQL_DEDUPE_KEY} AS dedupe_key, false AS appended FROM existing
UNION ALL
SELECT row_id, city_slug, {SQL_DEDUPE_KEY} AS dedupe_key, true AS appended FROM listings
WHERE {SQL_DEDUPE_KEY} NOT IN (SELECT k FROM keys)""")
def q_append_listings(spark, sf):
    """Append mode: the earlier listings as the stored table, the full feed as the
    new fetch; only rows with an unseen de-dup key are appended."""
    allrows = listings(spark, sf)
    existing = allrows.filter(F.col("listed_date") < F.lit(APPEND_CUTOFF).cast("timestamp")).withColumn("appended", F.lit(False))
    out = clean.append_new_listings(existing, allrows.withColumn("appended", F.lit(True)))
    return out.select("row_id", "city_slug", clean.dedupe_key(out).alias("dedupe_key"), "appended")


# ============================================================== geo
SQL_CENTROIDS = """
centroids AS (SELECT city_slug, cluster_id, avg(latitude) AS latitude, avg(longitude) AS longitude, count(*) AS count,
                     'Neighborhood ' || CAST(cluster_id + 1 AS VARCHAR) AS name
              FROM imputed GROUP BY city_slug, cluster_id)"""


@register("cluster_centroids", with_processed() + "," + SQL_CENTROIDS + """
SELECT city_slug, cluster_id, round(latitude, 9) AS latitude, round(longitude, 9) AS longitude, count, name FROM centroids""")
def q_cluster_centroids(spark, sf):
    """Mean coordinates and size per market and cluster."""
    c = geo.cluster_centroids(processed_listings(spark, sf))
    return c.select("city_slug", "cluster_id", r9("latitude"), r9("longitude"), "count", "name")


def r9(c: str) -> F.Column:
    return F.round(F.col(c), 9).alias(c)


def requests_located(spark: SparkSession, sf: str) -> DataFrame:
    """All requests, those without coordinates geocoded first, assigned to a market."""
    req = gc.geocode(td.raw_requests(spark, sf), gc.build_gazetteer(listings(spark, sf)))
    return geo.detect_market(req, td.markets(spark, sf))


SQL_DETECT = SQL_GEOCODED + f""",
located AS (
  SELECT request_id, city_slug, distance_from_center_mi FROM (
    SELECT q.request_id, m.city_slug, {haversine_sql('q.latitude', 'q.longitude', 'm.center_lat', 'm.center_lon')} AS distance_from_center_mi,
           row_number() OVER (PARTITION BY q.request_id ORDER BY {haversine_sql('q.latitude', 'q.longitude', 'm.center_lat', 'm.center_lon')}, m.market_ord) AS rn
    FROM geo_requests q JOIN markets m
      ON {haversine_sql('q.latitude', 'q.longitude', 'm.center_lat', 'm.center_lon')} < m.radius_miles
    ) t WHERE rn = 1)"""


@register("detect_market", with_views("listings", "markets", "raw_requests") + "," + SQL_DETECT + """
SELECT q.request_id, l.city_slug, round(l.distance_from_center_mi, 6) AS distance_from_center_mi
FROM geo_requests q LEFT JOIN located l USING (request_id)""")
def q_detect_market(spark, sf):
    """Nearest market within its own radius for every request; NULL without one."""
    return requests_located(spark, sf).select("request_id", "city_slug", r6("distance_from_center_mi").alias("distance_from_center_mi"))


@register("nearest_cluster", with_processed("markets", "raw_requests") + "," + SQL_CENTROIDS + "," + SQL_DETECT + """
SELECT request_id, city_slug, COALESCE(cid, 0) AS cluster_id FROM (
  SELECT l.request_id, l.city_slug, c.cluster_id AS cid,
         row_number() OVER (PARTITION BY l.request_id ORDER BY (q.latitude - c.latitude) * (q.latitude - c.latitude)
                            + (q.longitude - c.longitude) * (q.longitude - c.longitude), c.cluster_id) AS rn
  FROM located l JOIN geo_requests q USING (request_id) LEFT JOIN centroids c ON c.city_slug = l.city_slug) t
WHERE rn = 1""")
def q_nearest_cluster(spark, sf):
    """Nearest cluster centroid (squared degrees) of the request's market."""
    req = requests_located(spark, sf).filter(F.col("city_slug").isNotNull())
    cents = geo.cluster_centroids(processed_listings(spark, sf))
    return geo.nearest_cluster(req, cents).select("request_id", "city_slug", "cluster_id")


# ============================================================== requests
from ..operators import requests as rq  # noqa: E402


def _pylist(items) -> str:
    """Python list text, quoted for a SQL string literal."""
    return ("[" + ", ".join(f"'{x}'" for x in items) + "]").replace("'", "''")


SQL_VALIDATED = f"""
validated AS (
  SELECT *, CASE WHEN errs = '' THEN NULL ELSE errs END AS error FROM (
    SELECT request_id, trim(address) AS address, CAST(beds AS BIGINT) AS beds, CAST(baths AS DOUBLE) AS baths,
           CAST(sqft AS BIGINT) AS sqft,
           CASE trim(property_type) WHEN 'Multi Family' THEN 'Multi-Family' WHEN 'Multifamily' THEN 'Multi-Family'
                ELSE trim(property_type) END AS property_type,
           lower(trim(COALESCE(prediction_mode, 'auto'))) AS prediction_mode,
           CAST(COALESCE(comps_k, {K.DEFAULT_COMPS_K}) AS INTEGER) AS comps_k,
           latitude, longitude,
           concat_ws('; ',
             CASE WHEN trim(address) = '' THEN 'Address cannot be empty' WHEN length(trim(address)) < 5 THEN 'Address is too short' END,
             CASE WHEN beds < 0 THEN 'Beds cannot be negative' WHEN beds > 10 THEN 'Beds cannot exceed 10' END,
             CASE WHEN baths < 0 THEN 'Baths cannot be negative' WHEN baths > 10 THEN 'Baths cannot exceed 10' END,
             CASE WHEN sqft < 100 THEN 'SqFt must be at least 100' WHEN sqft > 10000 THEN 'SqFt cannot exceed 10,000' END,
             CASE WHEN (CASE trim(property_type) WHEN 'Multi Family' THEN 'Multi-Family' WHEN 'Multifamily' THEN 'Multi-Family'
                        ELSE trim(property_type) END) NOT IN ('Apartment', 'Single Family', 'Condo', 'Townhouse', 'Multi-Family')
                  THEN 'Invalid property_type. Must be one of: {_pylist(K.VALID_PROPERTY_TYPES)}' END,
             CASE WHEN lower(trim(COALESCE(prediction_mode, 'auto'))) NOT IN ('auto', 'model', 'comps')
                  THEN 'Invalid prediction_mode. Must be one of: {_pylist(K.VALID_PREDICTION_MODES)}' END,
             CASE WHEN COALESCE(comps_k, 5) < 3 OR COALESCE(comps_k, 5) > 10 THEN 'comps_k must be between 3 and 10' END
           ) AS errs
    FROM raw_requests) v)"""


@register("validate_requests", with_views("raw_requests") + "," + SQL_VALIDATED + """
SELECT request_id, address, beds, baths, sqft, property_type, prediction_mode, comps_k, error FROM validated""")
def q_validate_requests(spark, sf):
    """Request validation with the reference's messages, joined by '; '."""
    v = rq.validate_requests(td.raw_requests(spark, sf))
    return v.select("request_id", "address", "beds", "baths", "sqft", "property_type", "prediction_mode", "comps_k", "error")


# Comps-first and pooled markets among the stand-in markets (the reference's own
# market names do not occur in the test tables).
TEST_COMPS_FIRST = ("m12",)
TEST_POOLED = ("m11", "m12")


def comps_requests(spark: SparkSession, sf: str, processed: DataFrame | None = None) -> DataFrame:
    """Valid requests, geocoded where they lack coordinates, with their market, cluster and mode columns;
    requests outside all markets have no comparables."""
    processed = processed if processed is not None else processed_listings(spark, sf)
    v = rq.validate_requests(td.raw_requests(spark, sf)).filter(F.col("error").isNull())
    placed = gc.geocode(v, gc.build_gazetteer(listings(spark, sf)))
    located = geo.detect_market(placed, td.markets(spark, sf)).filter(F.col("city_slug").isNotNull())
    cents = geo.cluster_centroids(processed)
    withc = geo.nearest_cluster(located, cents)
    return rq.resolve_mode(withc, TEST_COMPS_FIRST, TEST_POOLED)


def comps_pool(spark: SparkSession, sf: str, processed: DataFrame | None = None) -> DataFrame:
    processed = processed if processed is not None else processed_listings(spark, sf)
    return processed.withColumn(
        "neighborhood", F.concat(F.lit("Neighborhood "), (F.col("cluster_id") + 1).cast("string")))


def comps_result(spark: SparkSession, sf: str) -> DataFrame:
    processed = processed_listings(spark, sf).persist()
    return comps.comparable_listings(comps_requests(spark, sf, processed), comps_pool(spark, sf, processed))


SQL_COMPS = with_processed("markets", "raw_requests") + "," + SQL_CENTROIDS + "," + SQL_GEOCODED + "," + SQL_VALIDATED + f""",
vloc AS (SELECT v.* EXCLUDE (latitude, longitude), g.latitude, g.longitude
         FROM validated v JOIN geo_requests g USING (request_id) WHERE v.error IS NULL),
located2 AS (
  SELECT request_id, city_slug FROM (
    SELECT q.request_id, m.city_slug,
           row_number() OVER (PARTITION BY q.request_id ORDER BY {haversine_sql('q.latitude', 'q.longitude', 'm.center_lat', 'm.center_lon')}, m.market_ord) AS rn
    FROM vloc q JOIN markets m ON {haversine_sql('q.latitude', 'q.longitude', 'm.center_lat', 'm.center_lon')} < m.radius_miles) t
  WHERE rn = 1),
reqc AS (
  SELECT request_id, city_slug, COALESCE(cid, 0) AS cluster_id FROM (
    SELECT l.request_id, l.city_slug, c.cluster_id AS cid,
           row_number() OVER (PARTITION BY l.request_id ORDER BY (q.latitude - c.latitude) * (q.latitude - c.latitude)
                              + (q.longitude - c.longitude) * (q.longitude - c.longitude), c.cluster_id) AS rn
    FROM located2 l JOIN vloc q USING (request_id) LEFT JOIN centroids c ON c.city_slug = l.city_slug) t WHERE rn = 1),
req AS (
  SELECT v.request_id, r.city_slug, r.cluster_id AS q_cluster, v.comps_k AS k, v.beds AS q_beds, v.baths AS q_baths,
         v.sqft AS q_sqft, v.latitude AS q_lat, v.longitude AS q_lon,
         CASE WHEN v.prediction_mode = 'comps'
                   OR (v.prediction_mode = 'auto' AND v.property_type = 'Single Family' AND r.city_slug IN ('{"', '".join(TEST_COMPS_FIRST)}'))
              THEN lower(trim(v.property_type)) END AS tf
  FROM vloc v JOIN reqc r USING (request_id)),
pool AS (SELECT *, 'Neighborhood ' || CAST(cluster_id + 1 AS VARCHAR) AS neighborhood FROM imputed
         WHERE price IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL),
pairs AS (
  SELECT r.request_id, r.k, r.q_cluster, p.*, {haversine_sql('r.q_lat', 'r.q_lon', 'p.latitude', 'p.longitude')} AS dist,
         100.0 * abs(p.beds - r.q_beds) + 50.0 * abs(p.baths - r.q_baths) + abs(p.sqft - r.q_sqft) / 10.0
           + 10.0 * {haversine_sql('r.q_lat', 'r.q_lon', 'p.latitude', 'p.longitude')} AS score
  FROM req r JOIN pool p ON p.city_slug = r.city_slug AND (r.tf IS NULL OR lower(p.property_type) = r.tf)),
cnt AS (SELECT request_id, count_if(cluster_id = q_cluster) AS c FROM pairs GROUP BY request_id),
elig AS (SELECT pairs.*, CASE WHEN cluster_id = q_cluster THEN 1 ELSE 0 END AS same
         FROM pairs JOIN cnt USING (request_id) WHERE cnt.c < pairs.k OR pairs.cluster_id = pairs.q_cluster),
dedup AS (SELECT *, row_number() OVER (PARTITION BY request_id, address ORDER BY same DESC, score, row_id) AS rn_a FROM elig),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY same DESC, score, row_id) AS rank
           FROM dedup WHERE rn_a = 1),
comps AS (
  SELECT request_id, rank, row_id, address, CAST(trunc(price) AS BIGINT) AS price, CAST(trunc(beds) AS BIGINT) AS beds,
         baths, CAST(trunc(sqft) AS BIGINT) AS sqft, property_type, neighborhood,
         round_even(dist, 2) AS distance_mi, score AS similarity
  FROM ranked WHERE rank <= k)"""


@register("comps", SQL_COMPS + """
SELECT request_id, rank, row_id, address, price, beds, baths, sqft, property_type, neighborhood, distance_mi,
       round(similarity, 6) AS similarity FROM comps""")
def q_comps(spark, sf):
    """Exact top-k comparable listings per request (bounded box search, no market-wide pairing)."""
    return comps_result(spark, sf).withColumn("similarity", r6("similarity"))


@register("comps_estimate", SQL_COMPS + """
SELECT request_id, round(avg(price), 6) AS comps_avg, min(price) AS comps_low, max(price) AS comps_high,
       count(*) AS comps_count
FROM comps WHERE price IS NOT NULL GROUP BY request_id""")
def q_comps_estimate(spark, sf):
    """Comps average, low, high and count per request."""
    est = comps.comps_estimate(comps_result(spark, sf))
    return est.withColumn("comps_avg", r6("comps_avg"))


# ============================================================== summaries and splits
from ..operators import stats as st  # noqa: E402


@register("property_types", with_processed() + """
SELECT DISTINCT city_slug, property_type,
       COALESCE(CASE property_type WHEN 'Apartment' THEN 0 WHEN 'Condo' THEN 1 WHEN 'Townhouse' THEN 2
                WHEN 'Single Family' THEN 3 WHEN 'Multi-Family' THEN 4 END, 999) AS type_rank
FROM imputed WHERE property_type IS NOT NULL""")
def q_property_types(spark, sf):
    """Distinct property types per market with display rank."""
    return st.property_types(processed_listings(spark, sf))


@register("price_summary", with_processed() + """
SELECT city_slug, min(price) AS min_price, max(price) AS max_price, round(avg(price), 6) AS mean_price, count(*) AS n_priced
FROM imputed WHERE price IS NOT NULL GROUP BY city_slug""")
def q_price_summary(spark, sf):
    """Price min, max, mean and count per market."""
    return st.price_summary(processed_listings(spark, sf)).withColumn("mean_price", r6("mean_price"))


MISSING_COLS = ["listing_id", "address2", "price", "beds", "baths", "sqft", "property_type", "listed_date"]


@register("missing_share", with_views("listings") + ", w AS (SELECT city_slug, count(*) AS n_rows, "
          + ", ".join(f"avg(CAST({c} IS NULL AS DOUBLE)) AS {c}" for c in MISSING_COLS)
          + " FROM listings GROUP BY city_slug)\n"
          + "\nUNION ALL\n".join(f"SELECT city_slug, n_rows, '{c}' AS column_name, round({c}, 9) AS missing_share FROM w"
                                 for c in MISSING_COLS))
def q_missing_share(spark, sf):
    """Share of missing values per column and market (feature coverage)."""
    return st.missing_share(listings(spark, sf), MISSING_COLS).withColumn("missing_share", F.round("missing_share", 9))


@register("row_loss", with_views("listings") + """
SELECT city_slug, count(*) AS n_raw,
       count_if(latitude IS NOT NULL AND longitude IS NOT NULL) AS n_with_coords,
       count_if(latitude IS NOT NULL AND longitude IS NOT NULL AND (sqft IS NULL OR sqft BETWEEN 200 AND 5000)) AS n_sqft_ok,
       count_if(latitude IS NOT NULL AND longitude IS NOT NULL AND (sqft IS NULL OR sqft BETWEEN 200 AND 5000)
                AND price IS NOT NULL) AS n_training,
       round(100.0 * (count(*) - count_if(latitude IS NOT NULL AND longitude IS NOT NULL
             AND (sqft IS NULL OR sqft BETWEEN 200 AND 5000) AND price IS NOT NULL)) / count(*), 4) AS pct_lost
FROM listings GROUP BY city_slug""")
def q_row_loss(spark, sf):
    """Rows kept after each cleaning step, per market."""
    return st.row_loss(listings(spark, sf))


@register("cv_folds", with_processed() + """
SELECT row_id, city_slug, CAST(ntile(5) OVER (PARTITION BY city_slug ORDER BY row_id) - 1 AS INTEGER) AS fold
FROM imputed WHERE price IS NOT NULL""")
def q_cv_folds(spark, sf):
    """Contiguous 5-fold assignment per market (skew-safe ordinal, no per-market task)."""
    df = processed_listings(spark, sf).filter(F.col("price").isNotNull()).select("row_id", "city_slug")
    return st.contiguous_folds(df).select("row_id", "city_slug", "fold")


@register("time_split", with_processed() + """
, d AS (SELECT row_id, city_slug, row_number() OVER (PARTITION BY city_slug ORDER BY listed_date, row_id) - 1 AS pos,
               count(*) OVER (PARTITION BY city_slug) AS n
        FROM imputed WHERE listed_date IS NOT NULL AND price IS NOT NULL)
SELECT row_id, city_slug, pos, CASE WHEN n < 20 THEN NULL WHEN pos < CAST(floor(n * 0.8) AS BIGINT) THEN 'train'
       ELSE 'validate' END AS split FROM d""")
def q_time_split(spark, sf):
    """Train on the oldest 80 % of each market by listing date, validate on the rest."""
    df = processed_listings(spark, sf).filter(F.col("price").isNotNull()).select("row_id", "city_slug", "listed_date")
    return st.time_split(df).select("row_id", "city_slug", "pos", "split")


# ============================================================== clusters: sizes, names, map
SQL_NAMES = SQL_CENTROIDS + f""",
nearest_place AS (
  SELECT city_slug, cluster_id, place_name FROM (
    SELECT c.city_slug, c.cluster_id, COALESCE(p.suburb, p.city, 'Unknown') AS place_name,
           row_number() OVER (PARTITION BY c.city_slug, c.cluster_id
                              ORDER BY {haversine_sql('c.latitude', 'c.longitude', 'p.latitude', 'p.longitude')}, p.latitude, p.longitude) AS rn
    FROM centroids c, places p) t WHERE rn = 1),
named AS (
  SELECT c.city_slug, c.cluster_id, np.place_name,
         CASE WHEN abs(c.latitude - m.center_lat) > abs(c.longitude - m.center_lon)
              THEN CASE WHEN c.latitude - m.center_lat > 0 THEN 'North' ELSE 'South' END
              ELSE CASE WHEN c.longitude - m.center_lon > 0 THEN 'East' ELSE 'West' END END AS dir,
         sqrt(pow(c.latitude - m.center_lat, 2) + pow(c.longitude - m.center_lon, 2)) AS dist,
         m.display_name
  FROM centroids c JOIN nearest_place np USING (city_slug, cluster_id) JOIN markets m USING (city_slug)),
named2 AS (
  SELECT *, CASE WHEN dist > 0.05 THEN 'Far ' || dir ELSE dir END || ' ' || display_name AS fallback,
         row_number() OVER (PARTITION BY city_slug, place_name ORDER BY cluster_id) AS first_use
  FROM named),
named3 AS (
  SELECT *, row_number() OVER (PARTITION BY city_slug, CASE WHEN first_use = 1 THEN NULL ELSE fallback END,
                                            first_use = 1 ORDER BY cluster_id) AS fb_n
  FROM named2),
names AS (
  SELECT city_slug, cluster_id,
         CASE WHEN first_use = 1 AND place_name <> '' THEN place_name
              WHEN fb_n = 1 THEN fallback ELSE fallback || ' ' || CAST(fb_n AS VARCHAR) END AS name
  FROM named3)"""


def cluster_names(spark: SparkSession, sf: str, processed: DataFrame | None = None) -> DataFrame:
    processed = processed if processed is not None else processed_listings(spark, sf)
    cents = geo.cluster_centroids(processed)
    places = geo.reverse_geocode(cents, td.places(spark, sf), ["city_slug", "cluster_id"])
    return geo.name_clusters(cents, places, td.markets(spark, sf))


@register("cluster_names", with_processed("markets", "places") + "," + SQL_NAMES + """
SELECT city_slug, cluster_id, name FROM names""")
def q_cluster_names(spark, sf):
    """Reverse-geocoded, de-duplicated cluster names (directional fallbacks numbered)."""
    return cluster_names(spark, sf)


@register("cluster_sizes", with_processed("markets", "places") + "," + SQL_NAMES + """
SELECT n.city_slug, n.cluster_id, n.name, CAST(COALESCE(c.cnt, 0) AS BIGINT) AS listings
FROM names n LEFT JOIN (SELECT city_slug, cluster_id, count(*) AS cnt FROM imputed
                         WHERE price IS NOT NULL GROUP BY 1, 2) c USING (city_slug, cluster_id)""")
def q_cluster_sizes(spark, sf):
    """Listings per named cluster after dropping unpriced rows; empty clusters show 0."""
    processed = processed_listings(spark, sf).persist()
    names = cluster_names(spark, sf, processed)
    return geo.cluster_sizes(processed.filter(F.col("price").isNotNull()), names)


@register("cluster_map", with_processed("markets", "places") + "," + SQL_NAMES + f""",
cm AS (SELECT c.city_slug, c.cluster_id, n.name, c.count, c.latitude, c.longitude FROM centroids c JOIN names n USING (city_slug, cluster_id))
SELECT city_slug, cluster_id, name, count, round(latitude, 9) AS latitude, round(longitude, 9) AS longitude,
       round(longitude * {20037508.34} / 180, 3) AS x,
       round(ln(tan((90 + latitude) * pi() / 360)) / (pi() / 180) * {20037508.34} / 180, 3) AS y,
       count >= CASE WHEN (SELECT sum(count) FROM cm) > 100 THEN 5 ELSE 2 END AS labelled
FROM cm""")
def q_cluster_map(spark, sf):
    """Named centroids in Web Mercator with the label threshold (legend data)."""
    processed = processed_listings(spark, sf).persist()
    names = cluster_names(spark, sf, processed)
    cents = geo.cluster_centroids(processed, names)
    lay = geo.map_layer(cents)
    return lay.select("city_slug", "cluster_id", "name", "count", r9("latitude"), r9("longitude"),
                      F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "labelled")


@register("map_extent", with_processed() + """
SELECT round(avg(latitude), 9) AS center_lat, round(avg(longitude), 9) AS center_lon, count(*) AS total_listings FROM imputed""")
def q_map_extent(spark, sf):
    """Mean of all coordinates across markets and the total listing count."""
    e = geo.map_extent(processed_listings(spark, sf))
    return e.select(F.round("center_lat", 9).alias("center_lat"), F.round("center_lon", 9).alias("center_lon"), "total_listings")


# ============================================================== ingest
from ..sources import listings as src  # noqa: E402


@register("ingest_pages", with_views("markets") + """
SELECT 'm' || CAST(o_custkey % 25 AS VARCHAR) AS city_slug, CAST(floor(o_orderkey / 500) + 1 AS INTEGER) AS page,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS listing_id,
       CAST(o_custkey % 500 AS VARCHAR) || ' Main St' AS address,
       CASE WHEN o_orderkey % 4 = 0 THEN 'Apt ' || CAST(o_orderkey % 50 AS VARCHAR)
            WHEN o_orderkey % 4 = 2 THEN 'Unit ' || CAST(o_orderkey % 50 AS VARCHAR) END AS address2,
       CASE WHEN o_orderkey % 2 = 0 THEN 'NATION_' || CAST(o_custkey % 25 AS VARCHAR) ELSE m.display_name END AS city,
       CASE WHEN o_orderkey % 2 = 0 THEN 'MI' ELSE m.state END AS state,
       CAST(48100 + o_custkey % 100 AS VARCHAR) AS zip,
       o_orderdate AS listed_date,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE floor(o_totalprice) / 100.0 END AS price,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 7 AS DOUBLE) END AS beds,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 1.0 + 0.5 * CAST(o_orderkey % 5 AS DOUBLE) END AS baths,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(150 + (o_orderkey * 37) % 5200 AS DOUBLE) END AS sqft,
       CASE WHEN o_orderkey % 3 = 0 THEN 'Parking, Laundry' END AS amenities_text
FROM orders JOIN markets m ON m.city_slug = 'm' || CAST(o_custkey % 25 AS VARCHAR)""")
def q_ingest_pages(spark, sf):
    """Landed pages -> items -> flat listing rows (alternate field names, market
    defaults, missing markers, lenient numbers, joined features)."""
    pages = src.within_page_limit(td.landed_pages(spark, sf))
    flat = src.flatten_items(src.parse_pages(pages), td.markets(spark, sf))
    return flat.select("city_slug", "page", "listing_id", "address", "address2", "city", "state", "zip",
                       "listed_date", "price", "beds", "baths", "sqft", "amenities_text")


# ============================================================== ML and end-to-end (rows-only checks)
from ..ml import kmeans as km  # noqa: E402
from ..ml import models as mlp  # noqa: E402
from ..sources import stored_runs as sr  # noqa: E402
from . import jobs  # noqa: E402

# Steps of the queries that report Lloyd's state after a fixed number of iterations
# (their oracle unrolls them).
FIXED_LLOYD_ITER = 12
# The cross-validated queries fit dozens of models. A boosting round is a handful of Spark
# jobs, about 0.3 s however small the table, so they run fewer rounds than the library's
# default and each market's configured k in place of a sweep per fold. ``feature_importance``,
# ``kmeans_k`` and ``cluster_listings`` run the defaults.
CV_GBT_ROUNDS = 30
CV_ARGS = {"auto_k": False, "cluster_iter": 20}


@register("kmeans_k", None)
def q_kmeans_k(spark, sf):
    """Silhouette-chosen k per market (all markets and all k in one Lloyd run)."""
    return km.choose_k(listings(spark, sf), td.markets(spark, sf))


@register("cluster_listings", None)
def q_cluster_listings(spark, sf):
    """Cluster every market, name clusters, drop impossible SqFt, impute."""
    processed, _ = jobs.cluster_and_clean(listings(spark, sf), td.markets(spark, sf), td.places(spark, sf))
    return processed.select("row_id", "city_slug", "cluster_id", "neighborhood", "beds", "baths", "sqft", "price")


@register("price_model_cv", None)
def q_price_model_cv(spark, sf):
    """Leakage-safe 5-fold CV of the boosted-tree price model (fold RMSE per market)."""
    return mlp.cv_summary(mlp.cross_validate(listings(spark, sf), td.markets(spark, sf), mlp.gbt, max_iter=CV_GBT_ROUNDS, **CV_ARGS))


@register("model_bakeoff", None)
def q_model_bakeoff(spark, sf):
    """Linear, random-forest and boosted models on the raw price: a hashed 80/20 split and the
    folds' RMSE, ranked by the latter."""
    return mlp.bake_off(listings(spark, sf), td.markets(spark, sf), gbt_rounds=CV_GBT_ROUNDS, **CV_ARGS)


@register("feature_importance", None)
def q_feature_importance(spark, sf):
    """Feature importances of the boosted price model over all markets, high to low."""
    df = processed_listings(spark, sf).filter(F.col("price").isNotNull())
    return mlp.importance_table(spark, mlp.fit_price_model(df, mlp.gbt))


@register("estimate", None)
def q_estimate(spark, sf):
    """End-to-end price estimates for every request (errors as rows), from a training that was stored and loaded again."""
    mk = td.markets(spark, sf)
    std = listings(spark, sf)
    processed, clusters = jobs.cluster_and_clean(std, mk, td.places(spark, sf), max_iter=CV_ARGS["cluster_iter"], auto_k=False)
    processed = processed.checkpoint()
    cv_args = {"cluster_iter": CV_ARGS["cluster_iter"], "auto_k": False, "max_iter": CV_GBT_ROUNDS}
    model, runs = jobs.train(processed, std, mk, gbt_rounds=CV_GBT_ROUNDS, cv_cluster_iter=CV_ARGS["cluster_iter"], auto_k=False)
    pooled = mlp.fit_pooled_single_family(processed, TEST_POOLED, max_iter=CV_GBT_ROUNDS)
    pooled_rmse = mlp.pooled_single_family_rmse(std, mk, TEST_POOLED, **cv_args)
    root = _scratch(spark, "store")
    sr.store_training(root, model, runs.checkpoint(), mk, clusters, clean.bed_sqft_medians(processed), processed, pooled, pooled_rmse)
    return sr.estimate_stored(sr.load_serving(spark, root), td.raw_requests(spark, sf), TEST_COMPS_FIRST, TEST_POOLED)


SQL_ESTIMATE_FIELDS = SQL_COMPS + f""",
offered AS (SELECT 'Address is not within any supported city. Available cities: ' || string_agg(display_name, ', ' ORDER BY market_ord) AS refusal FROM markets),
est AS (SELECT request_id, avg(price) AS a, min(price) AS lo, max(price) AS hi, count(*) AS n FROM comps WHERE price IS NOT NULL GROUP BY request_id),
listed AS (SELECT request_id, string_agg(row_id_text, ',' ORDER BY rank) AS addresses FROM (SELECT request_id, rank, address AS row_id_text FROM comps) GROUP BY request_id),
dist AS (SELECT request_id, city_slug, distance_from_center_mi AS d FROM (
    SELECT v.request_id, m.city_slug, {haversine_sql('v.latitude', 'v.longitude', 'm.center_lat', 'm.center_lon')} AS distance_from_center_mi
    FROM vloc v JOIN reqc r USING (request_id) JOIN markets m ON m.city_slug = r.city_slug)),
good AS (SELECT v.request_id, v.prediction_mode, v.comps_k, v.property_type, v.latitude, v.longitude, r.city_slug, r.cluster_id, d.d,
                (v.prediction_mode = 'auto' AND v.property_type = 'Single Family' AND r.city_slug IN ('{"', '".join(TEST_COMPS_FIRST)}')) AS first_rule, e.a, e.lo, e.hi, e.n
         FROM vloc v JOIN reqc r USING (request_id) JOIN dist d USING (request_id) LEFT JOIN est e USING (request_id))
SELECT g.request_id, CASE WHEN prediction_mode = 'comps' AND a IS NULL THEN 'No comparable properties found for comps-average mode. Try model mode.' END AS error,
       g.city_slug AS city, m.display_name AS city_name, m.state, CAST(comps_k AS DOUBLE) AS comps_k, prediction_mode AS prediction_mode_requested,
       CASE WHEN (prediction_mode = 'comps' OR first_rule) AND a IS NOT NULL THEN 'comps' ELSE 'model' END AS prediction_mode_used,
       CASE WHEN a IS NULL THEN 'model' WHEN first_rule THEN 'comps,model' ELSE 'model,comps' END AS prediction_order,
       'Neighborhood ' || CAST(cluster_id + 1 AS VARCHAR) AS neighborhood,
       round_even(d, 2) AS distance_from_center_mi, CAST(round_even(a, 0) AS DOUBLE) AS comps_price, CAST(lo AS DOUBLE) AS comps_low,
       CAST(hi AS DOUBLE) AS comps_high, CAST(n AS DOUBLE) AS comps_count, addresses
FROM good g JOIN markets m ON m.city_slug = g.city_slug LEFT JOIN listed l USING (request_id)
UNION ALL
SELECT v.request_id, COALESCE(v.error, CASE WHEN q.latitude IS NULL THEN 'Could not geocode address' ELSE (SELECT refusal FROM offered) END),
       NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM validated v JOIN geo_requests q USING (request_id) LEFT JOIN good g USING (request_id) WHERE g.request_id IS NULL"""


@register("estimate_fields", SQL_ESTIMATE_FIELDS)
def q_estimate_fields(spark, sf):
    """All that an estimate says beside the model's price, for every request: refusals, market, mode, comparables, place."""
    mk, processed = td.markets(spark, sf), processed_listings(spark, sf)
    pool = comps_pool(spark, sf, processed).checkpoint()
    runs = mk.select("city_slug", F.lit("20260101").alias("training_date"), F.lit(None).cast("double").alias("cv_rmse"))
    model = mlp.fit_price_model(pool, mlp.linear)
    e = jobs.estimate(td.raw_requests(spark, sf), pool, geo.cluster_centroids(pool), mk, model, runs, gc.build_gazetteer(listings(spark, sf)),
                      TEST_COMPS_FIRST, TEST_POOLED)
    c = F.col("comps_prediction")
    return e.select(
        "request_id", "error", "city", "city_name", "state", F.col("comps_k").cast("double"), "prediction_mode_requested", "prediction_mode_used",
        F.array_join("prediction_order", ",").alias("prediction_order"), "neighborhood", "distance_from_center_mi",
        c["price"].cast("double").alias("comps_price"), c["price_range"]["low"].cast("double").alias("comps_low"),
        c["price_range"]["high"].cast("double").alias("comps_high"), c["count"].cast("double").alias("comps_count"),
        F.array_join(F.transform("comparable_properties", lambda x: x["address"]), ",").alias("addresses"))


@register("geocode_requests", with_views("listings", "raw_requests") + ",\n" + SQL_GEOCODED + """
SELECT request_id, address, latitude, longitude, geocoded FROM geo_requests""")
def q_geocode_requests(spark, sf):
    """Every request, missing coordinates filled from the first address variant found in the gazetteer."""
    return gc.geocode(td.raw_requests(spark, sf), gc.build_gazetteer(listings(spark, sf))).select("request_id", "address", "latitude", "longitude", "geocoded")


@register("address_variants", with_views("raw_requests") + ",\n" + SQL_VARIANTS + """
SELECT request_id, pos, variant FROM variants""")
def q_address_variants(spark, sf):
    """Ordered address spellings tried per request."""
    req = td.raw_requests(spark, sf)
    return gc.with_address_variants(req).select("request_id", F.posexplode("variants").alias("pos", "variant"))


@register("comps_cv_metrics", with_processed() + f""",
pool AS (SELECT *, 'Neighborhood ' || CAST(cluster_id + 1 AS VARCHAR) AS neighborhood,
                CAST(ntile(5) OVER (PARTITION BY city_slug ORDER BY row_id) - 1 AS INTEGER) AS fold
         FROM imputed WHERE price IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL),
pairs AS (
  SELECT q.row_id AS request_id, q.city_slug, q.price AS q_price, q.cluster_id AS q_cluster, p.row_id, p.address, p.price,
         p.cluster_id,
         100.0 * abs(p.beds - q.beds) + 50.0 * abs(p.baths - q.baths) + abs(p.sqft - q.sqft) / 10.0
           + 10.0 * {haversine_sql('q.latitude', 'q.longitude', 'p.latitude', 'p.longitude')} AS score
  FROM pool q JOIN pool p ON p.city_slug = q.city_slug AND p.fold <> q.fold),
cnt AS (SELECT request_id, count_if(cluster_id = q_cluster) AS c FROM pairs GROUP BY request_id),
elig AS (SELECT pairs.*, CASE WHEN cluster_id = q_cluster THEN 1 ELSE 0 END AS same
         FROM pairs JOIN cnt USING (request_id) WHERE cnt.c < 5 OR pairs.cluster_id = pairs.q_cluster),
dedup AS (SELECT *, row_number() OVER (PARTITION BY request_id, address ORDER BY same DESC, score, row_id) AS rn_a FROM elig),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY same DESC, score, row_id) AS rnk
           FROM dedup WHERE rn_a = 1),
est AS (SELECT request_id, city_slug, any_value(q_price) AS price, avg(CAST(trunc(price) AS BIGINT)) AS comps_avg
        FROM ranked WHERE rnk <= 5 GROUP BY request_id, city_slug)
SELECT city_slug, round(sqrt(avg((comps_avg - price) * (comps_avg - price))), 6) AS rmse, count(*) AS n_predictions,
       5 AS k, false AS property_type_filter, 1 AS min_comps
FROM est GROUP BY city_slug""")
def q_comps_cv_metrics(spark, sf):
    """Comps-average RMSE per market: each listing priced by its 5 comps from the other folds."""
    m = comps.comps_cv_metrics(comps_pool(spark, sf))
    return m.withColumn("rmse", r6("rmse"))


_LLOYD_POINTS = """
pts AS (SELECT city_slug, row_id, latitude, longitude FROM listings WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
sizes AS (SELECT p.city_slug, count(*) AS n, m.n_clusters AS hint FROM pts p JOIN markets m USING (city_slug)
          GROUP BY p.city_slug, m.n_clusters),
kt AS (SELECT city_slug, n, CASE WHEN n < 6 THEN 0 ELSE least(hint, n) END AS k FROM sizes),
"""


def _lloyd_sql(iters: int, points: str = _LLOYD_POINTS, order: str = "latitude, longitude, row_id") -> str:
    ctes = [points.rstrip() + f"""
seeds AS (SELECT kt.city_slug, CAST(i AS INTEGER) AS cluster_id, CAST(floor((2 * i + 1) * kt.n / (2 * kt.k)) AS BIGINT) AS pos
          FROM kt, (SELECT unnest(range(0, (SELECT max(k) FROM kt))) AS i) r WHERE i < kt.k),
ordered AS (SELECT *, row_number() OVER (PARTITION BY city_slug ORDER BY {order}) - 1 AS pos FROM pts),
c0 AS (SELECT s.city_slug, s.cluster_id, o.latitude, o.longitude FROM seeds s JOIN ordered o USING (city_slug, pos))"""]
    for i in range(1, iters + 1):
        ctes.append(f"""
a{i} AS (SELECT city_slug, row_id, latitude, longitude, cluster_id FROM (
    SELECT p.*, c.cluster_id, row_number() OVER (PARTITION BY p.city_slug, p.row_id
        ORDER BY (p.latitude - c.latitude) * (p.latitude - c.latitude) + (p.longitude - c.longitude) * (p.longitude - c.longitude),
                 c.cluster_id) AS rn
    FROM pts p JOIN c{i - 1} c USING (city_slug)) t WHERE rn = 1),
c{i} AS (SELECT c.city_slug, c.cluster_id, COALESCE(u.lat, c.latitude) AS latitude, COALESCE(u.lon, c.longitude) AS longitude
         FROM c{i - 1} c LEFT JOIN (SELECT city_slug, cluster_id, avg(latitude) AS lat, avg(longitude) AS lon FROM a{i}
                                    GROUP BY 1, 2) u USING (city_slug, cluster_id))""")
    ctes.append(f"""
fin AS (SELECT city_slug, cluster_id, count(*) AS n FROM (
    SELECT p.city_slug, c.cluster_id, row_number() OVER (PARTITION BY p.city_slug, p.row_id
        ORDER BY (p.latitude - c.latitude) * (p.latitude - c.latitude) + (p.longitude - c.longitude) * (p.longitude - c.longitude),
                 c.cluster_id) AS rn
    FROM pts p JOIN c{iters} c USING (city_slug)) t WHERE rn = 1 GROUP BY 1, 2)""")
    return with_views("listings", "markets") + "," + ",".join(x.strip() for x in ctes) + f"""
SELECT c.city_slug, c.cluster_id, round(c.latitude, 9) AS latitude, round(c.longitude, 9) AS longitude,
       COALESCE(f.n, 0) AS listings
FROM c{iters} c LEFT JOIN fin f USING (city_slug, cluster_id)"""


@register("kmeans_fixed", _lloyd_sql(FIXED_LLOYD_ITER))
def q_kmeans_fixed(spark, sf):
    """Lloyd k-means per market with the configured k (all markets in the same
    jobs): centroids and cluster sizes after a fixed number of iterations."""
    pts = listings(spark, sf).filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()) \
        .select("city_slug", "row_id", "latitude", "longitude")
    kt = km.k_bounds(pts, td.markets(spark, sf), table_job=False).select("city_slug", F.col("fixed_k").alias("k"))
    cents = km.lloyd(pts, kt, max_iter=FIXED_LLOYD_ITER, tol=-1.0)
    sizes = geo.nearest_cluster(pts, cents).groupBy("city_slug", "cluster_id").agg(F.count(F.lit(1)).alias("_n"))
    return cents.join(sizes, ["city_slug", "cluster_id"], "left").select(
        "city_slug", "cluster_id", r9("latitude"), r9("longitude"), F.coalesce("_n", F.lit(0)).alias("listings"))


def _silhouette_sql(iters: int, base: str | None = None, root: str = "") -> str:
    base = base or _lloyd_sql(iters)
    head = base[: base.rindex("\nSELECT c.city_slug")]
    return head + f""",
asg AS (SELECT city_slug, row_id, latitude, longitude, cluster_id FROM (
    SELECT p.*, c.cluster_id, row_number() OVER (PARTITION BY p.city_slug, p.row_id
        ORDER BY (p.latitude - c.latitude) * (p.latitude - c.latitude) + (p.longitude - c.longitude) * (p.longitude - c.longitude),
                 c.cluster_id) AS rn
    FROM pts p JOIN c{iters} c USING (city_slug)) t WHERE rn = 1),
csize AS (SELECT city_slug, cluster_id, count(*) AS n FROM asg GROUP BY 1, 2),
pairs AS (SELECT i.city_slug, i.row_id, i.cluster_id AS ci, j.cluster_id AS cj,
                 sum({root}((i.latitude - j.latitude) * (i.latitude - j.latitude) + (i.longitude - j.longitude) * (i.longitude - j.longitude))) AS d
          FROM asg i JOIN asg j ON i.city_slug = j.city_slug GROUP BY 1, 2, 3, 4),
per AS (SELECT p.city_slug, p.row_id,
               max(CASE WHEN p.ci = p.cj AND s.n > 1 THEN p.d / (s.n - 1) END) AS a,
               min(CASE WHEN p.ci <> p.cj THEN p.d / s.n END) AS b
        FROM pairs p JOIN csize s ON s.city_slug = p.city_slug AND s.cluster_id = p.cj GROUP BY 1, 2)
SELECT city_slug, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b)
                                 ELSE 0.0 END), 6) AS silhouette
FROM per GROUP BY city_slug"""


@register("kmeans_silhouette", _silhouette_sql(FIXED_LLOYD_ITER))
def q_kmeans_silhouette(spark, sf):
    """Mean silhouette per market of the fixed-k clustering, from cluster sums
    (linear; the oracle computes it from all pairs)."""
    pts = listings(spark, sf).filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()) \
        .select("city_slug", "row_id", "latitude", "longitude")
    kt = km.k_bounds(pts, td.markets(spark, sf), table_job=False).select("city_slug", F.col("fixed_k").alias("k"))
    cents = km.lloyd(pts, kt, max_iter=FIXED_LLOYD_ITER, tol=-1.0)
    return km.silhouette(pts, cents).withColumn("silhouette", F.round("silhouette", 6))


# ------------------------------------------------- restarts and the k sweep, from starts that SQL can place too
from ..ml import kmeans_sets as kms  # noqa: E402

#: orders of the two fixed restarts, and the ks of the fixed sweep
RESTART_ORDERS = [["latitude", "longitude", "row_id"], ["longitude", "latitude", "row_id"]]
SWEEP_KS = (3, 4, 5)


def _models_sql(models: str, k: str) -> str:
    """Every market once per model r, as a market of its own; ``k`` may use n, hint and r."""
    return f"""
pts AS (SELECT city_slug || '#' || CAST(r AS VARCHAR) AS city_slug, r, row_id, latitude, longitude
        FROM listings, (VALUES {models}) AS t(r) WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
sizes AS (SELECT p.city_slug, p.r, count(*) AS n, m.n_clusters AS hint FROM pts p JOIN markets m ON m.city_slug = split_part(p.city_slug, '#', 1)
          GROUP BY p.city_slug, p.r, m.n_clusters),
kt AS (SELECT city_slug, n, CASE WHEN n < 6 THEN 0 ELSE {k} END AS k FROM sizes),
"""


def _restarts_sql() -> str:
    base = _lloyd_sql(FIXED_LLOYD_ITER, _models_sql("(0), (1)", "least(hint, n)"),
                      "CASE WHEN r = 0 THEN latitude ELSE longitude END, CASE WHEN r = 0 THEN longitude ELSE latitude END, row_id")
    c = f"c{FIXED_LLOYD_ITER}"
    return base[: base.rindex("\nSELECT c.city_slug")] + f""",
cost AS (SELECT city_slug, sum(d) AS cost FROM (
    SELECT p.city_slug, p.row_id, min((p.latitude - c.latitude) * (p.latitude - c.latitude) + (p.longitude - c.longitude) * (p.longitude - c.longitude)) AS d
    FROM pts p JOIN {c} c USING (city_slug) GROUP BY 1, 2) t GROUP BY 1),
won AS (SELECT split_part(city_slug, '#', 1) AS market, arg_min(city_slug, cost) AS city_slug FROM cost GROUP BY 1)
SELECT w.market AS city_slug, CAST(split_part(c.city_slug, '#', 2) AS INTEGER) AS restart, round(s.cost, 6) AS cost, c.cluster_id,
       round(c.latitude, 9) AS latitude, round(c.longitude, 9) AS longitude
FROM won w JOIN {c} c ON c.city_slug = w.city_slug JOIN cost s ON s.city_slug = w.city_slug"""


def _sweep_sql() -> str:
    base = _lloyd_sql(FIXED_LLOYD_ITER, _models_sql(", ".join(f"({k})" for k in SWEEP_KS), "r"))
    return f"""WITH score AS ({_silhouette_sql(FIXED_LLOYD_ITER, base, "sqrt")}),
best AS (SELECT split_part(city_slug, '#', 1) AS market, arg_max(city_slug, silhouette) AS city_slug FROM score GROUP BY 1)
SELECT split_part(s.city_slug, '#', 1) AS city_slug, CAST(split_part(s.city_slug, '#', 2) AS INTEGER) AS k, s.silhouette,
       s.city_slug = b.city_slug AS chosen
FROM score s JOIN best b ON b.market = split_part(s.city_slug, '#', 1)"""


def _even_sets(spark: SparkSession, sf: str, ks, orders) -> tuple[DataFrame, kms.Sets]:
    pts = kms.keep_points(listings(spark, sf))
    rows = km.k_bounds(pts, td.markets(spark, sf), table_job=False).collect()  # the market config
    starts = kms.even_starts(pts, {r.city_slug: ks(r) for r in rows}, orders)
    return pts, kms.improve(pts, starts, FIXED_LLOYD_ITER, rel_tol=None)


@register("kmeans_restarts", _restarts_sql())
def q_kmeans_restarts(spark, sf):
    """The cheaper of two restarts per market, after a fixed number of Lloyd steps from evenly spaced starts."""
    _, sets = _even_sets(spark, sf, lambda r: [r.fixed_k] * (r.fixed_k > 0), RESTART_ORDERS)
    return kms.frame(spark, kms.lowest(sets)).select("city_slug", "restart", F.round("cost", 6).alias("cost"), "cluster_id", r9("latitude"), r9("longitude"))


@register("silhouette_sweep", _sweep_sql())
def q_silhouette_sweep(spark, sf):
    """Plain Euclidean silhouette over all pairs of a market for each k of a sweep, and the k that it chooses."""
    pts, sets = _even_sets(spark, sf, lambda r: list(SWEEP_KS) if r.fixed_k > 0 else [], RESTART_ORDERS[:1])
    scores = kms.silhouettes(pts, sets)
    best = scores.groupBy("city_slug").agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("_k"))
    return scores.join(best, "city_slug").select("city_slug", "k", F.round("silhouette", 6).alias("silhouette"), (F.col("k") == F.col("_k")).alias("chosen"))


# ------------------------------------------------- ingest safety: rejected pages and lines, audits, incomplete markets
from ..sources import quarantine as qu  # noqa: E402


SQL_PAGE_REASON = """CASE WHEN page % 11 = 3 THEN 'not JSON' WHEN page % 13 = 5 THEN 'empty file' WHEN page % 17 = 7 THEN 'neither a list nor an object'
     WHEN page % 19 = 9 THEN 'listings is not a list' WHEN page % 23 = 11 THEN 'an item is not an object' END"""
SQL_LANDED = f"""
items AS (SELECT 'm' || CAST(o_custkey % 25 AS VARCHAR) AS city_slug, CAST(floor(o_orderkey / 500) + 1 AS INTEGER) AS page, o_orderkey FROM orders),
judged AS (SELECT *, {SQL_PAGE_REASON} AS reason FROM items)"""


@register("rejected_pages", "WITH" + SQL_LANDED + """
SELECT DISTINCT city_slug, page, reason FROM judged WHERE reason IS NOT NULL""")
def q_rejected_pages(spark, sf):
    """Landed pages that cannot be read, with the reason."""
    _, bad = qu.split_pages(td.damaged_pages(spark, sf))
    return bad.select("city_slug", "page", "reason")


@register("ingest_audit", "WITH" + SQL_LANDED + """,
per AS (SELECT m.city_slug, count(DISTINCT page) AS pages, count(DISTINCT CASE WHEN reason IS NOT NULL THEN page END) AS rejected,
               count_if(o_orderkey IS NOT NULL AND reason IS NULL) AS listings, count_if(o_orderkey IS NOT NULL AND reason IS NULL) AS located,
               count_if(reason IS NULL AND o_orderkey % 23 <> 0) AS priced, count_if(reason IS NULL AND o_orderkey % 23 <> 0) AS usable
        FROM (SELECT 'm' || CAST(n_nationkey AS VARCHAR) AS city_slug FROM nation) m LEFT JOIN judged USING (city_slug) GROUP BY m.city_slug)
SELECT * FROM per UNION ALL SELECT NULL, sum(pages), sum(rejected), sum(listings), sum(located), sum(priced), sum(usable) FROM per""")
def q_ingest_audit(spark, sf):
    """Pages, rejected pages and listings per market and in all, observed by the ingest's own writes."""
    done = qu.ingest_pages(td.damaged_pages(spark, sf), td.markets(spark, sf), _scratch(spark, "ingest"))
    return done.audit.select("city_slug", "pages", "rejected", "listings", "located", "priced", "usable")


SQL_FILE_LINES = """
lines AS (SELECT *, CAST(substr(city_slug, 2) AS INTEGER) % 6 = 5 AS skipped, row_id % 53 = 1 OR row_id % 59 = 1 AS ragged FROM raw_listings)"""


@register("market_files", with_views("raw_listings") + "," + SQL_FILE_LINES + """
SELECT city_slug, NOT skipped AS used, CASE WHEN skipped THEN 'Beds' ELSE '' END AS missing,
       CASE WHEN skipped THEN 0 ELSE count_if(NOT ragged) END AS n_rows, CASE WHEN skipped THEN 0 ELSE count_if(ragged) END AS n_ragged
FROM lines GROUP BY city_slug, skipped""")
def q_market_files(spark, sf):
    """Listing files of all markets: markets left out for missing columns, rows, and lines of the wrong length."""
    path = _scratch(spark, "files")
    td.write_listing_files(spark, sf, path)
    _, _, report = qu.read_market_files(spark, path)
    return report.withColumn("missing", F.array_join("missing", ","))


@register("avg_rents_of_files", REGISTRY["avg_rents"].sql.replace("\n, rows AS", "," + SQL_FILE_LINES + "\n, rows AS", 1)
          .replace("FROM raw_listings)\nSELECT", "FROM lines WHERE NOT skipped AND NOT ragged)\nSELECT", 1))
def q_avg_rents_of_files(spark, sf):
    """Average rents of the listing files of all complete markets."""
    path = _scratch(spark, "files")
    td.write_listing_files(spark, sf, path)
    rows, _, _ = qu.read_market_files(spark, path)
    return rents.avg_rent_rows(rows.withColumnRenamed("price", "price_raw").withColumnRenamed("property_type", "property_type_raw"), td.markets(spark, sf))


_TYPE_RANK_SQL = """COALESCE(CASE property_type WHEN 'Apartment' THEN 0 WHEN 'Condo' THEN 1
            WHEN 'Townhouse' THEN 2 WHEN 'Single Family' THEN 3 WHEN 'Multi-Family' THEN 4 END, 999)"""


@register("avg_rent_tables", REGISTRY["avg_rents"].sql.replace("\nSELECT m.display_name", "\n, agg AS (SELECT m.display_name", 1) + f"""),
per_type AS (SELECT city, city_slug, property_type, {_TYPE_RANK_SQL} AS rank,
                    '{{' || string_agg('"' || beds || '":{{"avg_price":' || avg_price || ',"listings":' || listings || '}}', ',' ORDER BY beds_value) || '}}' AS cell
             FROM agg GROUP BY ALL),
bed AS (SELECT city, string_agg(beds, '|' ORDER BY beds_value) AS beds FROM (SELECT DISTINCT city, beds, beds_value FROM agg) GROUP BY city)
SELECT city, city_slug, string_agg(property_type, '|' ORDER BY rank, property_type) AS property_types, any_value(bed.beds) AS beds,
       '{{' || string_agg('"' || property_type || '":' || cell, ',' ORDER BY rank, property_type) || '}}' AS cells
FROM per_type JOIN bed USING (city) GROUP BY city, city_slug""")
def q_avg_rent_tables(spark, sf):
    """Nested average-rent table of each city: type -> beds -> (average, count)."""
    t = rents.avg_rent_tables(rents.avg_rent_rows(td.raw_listings(spark, sf), td.markets(spark, sf), ordered=False))
    return t.select("city", "city_slug", F.array_join("property_types", "|").alias("property_types"), F.array_join("beds", "|").alias("beds"),
                    F.to_json("cells").alias("cells"))


@register("map_legend", with_processed("markets", "places") + "," + SQL_NAMES + """
SELECT c.city_slug, c.cluster_id, n.name, c.count FROM centroids c JOIN names n USING (city_slug, cluster_id) ORDER BY c.count DESC""")
def q_map_legend(spark, sf):
    """Legend of the cluster map, the largest cluster first."""
    processed = processed_listings(spark, sf)
    return geo.map_legend(geo.map_layer(geo.cluster_centroids(processed, cluster_names(spark, sf, processed))))

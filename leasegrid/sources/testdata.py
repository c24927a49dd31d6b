"""Stand-in inputs built from the driver's TPC-H-style tables.

These adapters only reshape rows of the test tables into the schemas the jobs
expect (FIXTURES.md F2, F3, F6, F9). They do none of the jobs' work: cleaning,
imputation, clustering, matching and scoring happen in the operators. Every
definition here has a twin in ``leasegrid.plans.oracle_views`` written as SQL
so DuckDB can rebuild the same inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# The five order priorities stand in for the five raw property-type spellings.
PRIORITY_TO_RAW_TYPE = {
    "1-URGENT": "Apartment",
    "2-HIGH": "Condo",
    "3-MEDIUM": "Townhouse",
    "4-NOT SPECIFIED": "Single Family",
    "5-LOW": "Multi-Family",
}
# Alternate raw spellings some rows carry (normalised by the jobs).
RAW_TYPE_VARIANTS = {
    "Apartment": " apartment ",
    "Condo": "CONDO",
    "Townhouse": "Townhome",
    "Single Family": "single-family",
    "Multi-Family": "Multifamily",
}
REQUEST_TYPES = ["Apartment", "Condo", "Townhouse", "Single Family", "Multi-Family"]
REQUEST_MODES = ["auto", "model", "comps"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _mod(c, m):
    return F.pmod(c, F.lit(m))


def _raw_type(priority, key):
    base = F.create_map(*[F.lit(x) for kv in PRIORITY_TO_RAW_TYPE.items() for x in kv])[priority]
    variant = F.create_map(*[F.lit(x) for kv in RAW_TYPE_VARIANTS.items() for x in kv])[base]
    return F.when(_mod(key, 19) == 0, variant).when(_mod(key, 97) == 0, F.lit("")).otherwise(base)


def _price_text(totalprice, key):
    # some listings cost far more than their market, as outliers
    cents = F.floor(totalprice).cast("long") * F.when(_mod(key, 61) == 0, 9).otherwise(1)
    dollars = F.floor(cents / 100).cast("long")
    frac = F.lpad(_mod(cents, 100).cast("string"), 2, "0")
    with_comma = F.when(
        dollars >= 1000,
        F.concat(F.floor(dollars / 1000).cast("long").cast("string"), F.lit(","),
                 F.lpad(_mod(dollars, 1000).cast("string"), 3, "0")),
    ).otherwise(dollars.cast("string"))
    text = F.concat(F.lit("$"), with_comma, F.lit("."), frac)
    return (
        F.when(_mod(key, 23) == 0, F.lit("N/A"))
        .when(_mod(key, 29) == 0, F.lit(""))
        .otherwise(text)
    )


def _coord(key, mult, base):
    return F.lit(float(base)) + _mod(key * F.lit(mult), 10000).cast("double") / F.lit(20000.0)


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed-listing-shaped rows (F2) with raw text price and raw type text."""
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    ck = F.col("o_custkey")
    return o.select(
        k.alias("row_id"),
        F.when(_mod(k, 17) == 0, F.lit(None)).otherwise(k.cast("string")).alias("listing_id"),
        F.concat(_mod(ck, 500).cast("string"), F.lit(" Main St")).alias("address"),
        F.when(_mod(k, 4) == 0, F.concat(F.lit("Apt "), _mod(k, 50).cast("string"))).alias("address2"),
        F.concat(F.lit("NATION_"), _mod(ck, 25).cast("string")).alias("city"),
        F.lit("MI").alias("state"),
        (F.lit(48100) + _mod(ck, 100)).cast("string").alias("zip"),
        F.concat(F.lit("m"), _mod(ck, 25).cast("string")).alias("city_slug"),
        _price_text(F.col("o_totalprice"), k).alias("price_raw"),
        F.when(_mod(k, 11) == 0, F.lit(None)).otherwise(_mod(k, 7).cast("double")).alias("beds"),
        F.when(_mod(k, 13) == 0, F.lit(None)).otherwise(F.lit(1.0) + F.lit(0.5) * _mod(k, 5).cast("double")).alias("baths"),
        F.when(_mod(k, 5) == 0, F.lit(None)).otherwise((F.lit(150) + _mod(k * F.lit(37), 5200)).cast("double")).alias("sqft"),
        _coord(k, 7919, 42).alias("latitude"),
        _coord(k, 104729, -84).alias("longitude"),
        _raw_type(F.col("o_orderpriority"), k).alias("property_type_raw"),
        F.col("o_orderdate").alias("listed_date"),
        _mod(ck, 8).cast("int").alias("cluster_id"),
    )


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market dimension (F3): one market per nation, centres on a 5 x 5 grid."""
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "inner").select(
        F.concat(F.lit("m"), key.cast("string")).alias("city_slug"),
        F.col("n_name").alias("display_name"),
        F.col("r_name").alias("state"),
        (F.lit(42.05) + F.lit(0.1) * F.floor(key / 5).cast("double")).alias("center_lat"),
        (F.lit(-83.95) + F.lit(0.1) * _mod(key, 5).cast("double")).alias("center_lon"),
        (F.lit(3) + _mod(key, 4)).cast("int").alias("radius_miles"),
        (F.lit(4) + _mod(key, 5)).cast("int").alias("n_clusters"),
        key.cast("int").alias("market_ord"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse-geocoding places (F9) at the market centres."""
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "inner").select(
        (F.lit(42.05) + F.lit(0.1) * F.floor(key / 5).cast("double")).alias("latitude"),
        (F.lit(-83.95) + F.lit(0.1) * _mod(key, 5).cast("double")).alias("longitude"),
        F.lit(None).cast("string").alias("neighbourhood"),
        F.when(_mod(key, 3) == 0, F.lit(None)).otherwise(F.col("n_name")).alias("suburb"),
        F.lit(None).cast("string").alias("hamlet"),
        F.lit(None).cast("string").alias("village"),
        F.lit(None).cast("string").alias("town"),
        F.lit(None).cast("string").alias("city_district"),
        F.col("r_name").alias("city"),
        F.lit(None).cast("string").alias("county"),
    )


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimate requests (F6), one per customer; some invalid on purpose.

    Coordinates are missing for every seventh request, which the estimate job
    then resolves through the gazetteer.
    """
    c = read_table(spark, sf_dir, "customer")
    n = F.col("c_custkey")
    suffix = (
        F.when(_mod(n, 4) == 0, F.lit(" Main St"))
        .when(_mod(n, 4) == 1, F.lit(" Main Street"))
        .when(_mod(n, 4) == 2, F.lit(" Main St Apt 4"))
        .otherwise(F.lit(" Main St."))
    )
    ptype = F.when(_mod(n, 9) == 0, F.lit("Multi Family")).otherwise(
        F.element_at(F.array(*[F.lit(x) for x in REQUEST_TYPES]), (_mod(n, 5) + 1).cast("int"))
    )
    no_coords = _mod(n, 7) == 0
    return c.select(
        n.alias("request_id"),
        F.concat(_mod(n, 500).cast("string"), suffix).alias("address"),
        _mod(n, 12).cast("int").alias("beds"),
        (F.lit(0.5) * _mod(n, 8).cast("double")).alias("baths"),
        (F.lit(80) + _mod(n * F.lit(53), 10000)).cast("int").alias("sqft"),
        ptype.alias("property_type"),
        F.element_at(F.array(*[F.lit(x) for x in REQUEST_MODES]), (_mod(n, 3) + 1).cast("int")).alias("prediction_mode"),
        (F.lit(2) + _mod(n, 10)).cast("int").alias("comps_k"),
        F.when(no_coords, F.lit(None)).otherwise(_coord(n, 7919, 42)).alias("latitude"),
        F.when(no_coords, F.lit(None)).otherwise(_coord(n, 104729, -84)).alias("longitude"),
    )


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API-shaped pages from ``orders``: items use the feed's field names and
    alternates; even pages are ``{"listings": [...]}``, odd pages bare arrays.

    A page holds the items of one market and one block of 500 order keys, so
    pages stay bounded in size.
    """
    o = read_table(spark, sf_dir, "orders")
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    no_id = _mod(k, 17) == 0
    item = F.struct(
        F.when(~no_id & (_mod(k, 3) == 0), k.cast("string")).alias("id"),
        F.when(~no_id & (_mod(k, 3) == 1), k.cast("string")).alias("listingId"),
        F.when(~no_id & (_mod(k, 3) == 2), k.cast("string")).alias("listing_id"),
        F.concat(_mod(ck, 500).cast("string"), F.lit(" Main St")).alias("addressLine1"),
        F.when(_mod(k, 4) == 0, F.concat(F.lit("Apt "), _mod(k, 50).cast("string"))).alias("addressLine2"),
        F.when(_mod(k, 4) == 2, F.concat(F.lit("Unit "), _mod(k, 50).cast("string"))).alias("unit"),
        F.when(_mod(k, 2) == 0, F.concat(F.lit("NATION_"), _mod(ck, 25).cast("string"))).alias("city"),
        F.when(_mod(k, 2) == 0, F.lit("MI")).alias("state"),
        F.when(_mod(k, 3) == 0, (F.lit(48100) + _mod(ck, 100)).cast("string")).alias("zipCode"),
        F.when(_mod(k, 3) != 0, (F.lit(48100) + _mod(ck, 100)).cast("string")).alias("postalCode"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("listedDate"),
        F.when(_mod(k, 23) == 0, F.lit("N/A")).otherwise((F.floor(F.col("o_totalprice")) / F.lit(100.0)).cast("string")).alias("price"),
        F.when(_mod(k, 11) != 0, _mod(k, 7)).alias("bedrooms"),
        F.when(_mod(k, 13) != 0, F.lit(1.0) + F.lit(0.5) * _mod(k, 5).cast("double")).alias("bathrooms"),
        F.when(_mod(k, 5) != 0, F.lit(150) + _mod(k * F.lit(37), 5200)).alias("squareFootage"),
        _coord(k, 7919, 42).alias("latitude"),
        _coord(k, 104729, -84).alias("longitude"),
        _raw_type(F.col("o_orderpriority"), k).alias("propertyType"),
        F.when(_mod(k, 3) == 0, F.array(F.lit("Parking"), F.lit("Laundry"))).alias("features"),
    )
    rows = o.select(F.concat(F.lit("m"), _mod(ck, 25).cast("string")).alias("city_slug"),
                    (F.floor(k / 500) + 1).cast("int").alias("page"), k.alias("_k"), item.alias("item"))
    pages = rows.groupBy("city_slug", "page").agg(F.sort_array(F.collect_list(F.struct("_k", "item"))).alias("_items"))
    items = F.transform("_items", lambda x: x["item"])
    return pages.select(
        "city_slug", "page",
        F.when(F.col("page") % 2 == 0, F.to_json(F.struct(items.alias("listings")))).otherwise(F.to_json(items)).alias("page_json"),
    )


def damaged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``landed_pages`` with some pages damaged in ways that a fetch can damage them."""
    page, text = F.col("page"), F.col("page_json")
    return landed_pages(spark, sf_dir).withColumn(
        "page_json",
        F.when(page % 11 == 3, F.substring(text, F.lit(1), (F.length(text) / 2).cast("int")))
        .when(page % 13 == 5, F.lit(""))
        .when(page % 17 == 7, F.lit('"rate limit exceeded"'))
        .when(page % 19 == 9, F.lit('{"listings": "none"}'))
        .when(page % 23 == 11, F.lit('[{"price": "900"}, 17]'))
        .otherwise(text))


# The header of the stand-in listing files; markets of every sixth number lack the beds.
FILE_HEADER = ["Listing ID", "Address", "City", "Price", "Beds", "Baths", "SqFt", "Latitude", "Longitude", "Property Type"]


def write_listing_files(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Listing files per market in CSV form, under ``city_slug=`` folders; some lines have a field too many or too few."""
    raw = raw_listings(spark, sf_dir)
    number = F.substring("city_slug", 2, 9).cast("int")
    columns = ["listing_id", "address", "city", "price_raw", "beds", "baths", "sqft", "latitude", "longitude", "property_type_raw"]
    rows = raw.select("city_slug", F.col("row_id").alias("_at"),
                      F.when(number % 6 == 5, F.to_csv(F.struct(*[c for c in columns if c != "beds"])))
                      .otherwise(F.to_csv(F.struct(*columns))).alias("value"))
    rows = rows.withColumn("value", F.when(F.col("_at") % 53 == 1, F.concat("value", F.lit(",extra")))
                           .when(F.col("_at") % 59 == 1, F.lit("1 Main St,Oakville")).otherwise(F.col("value")))
    head = raw.select("city_slug").distinct().select(
        "city_slug", F.lit(-1).cast("long").alias("_at"),
        F.when(number % 6 == 5, ",".join(c for c in FILE_HEADER if c != "Beds")).otherwise(",".join(FILE_HEADER)).alias("value"))
    rows.unionByName(head).repartition("city_slug").sortWithinPartitions("city_slug", "_at").select("city_slug", "value") \
        .write.mode("overwrite").partitionBy("city_slug").text(root)

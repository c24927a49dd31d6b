"""Average-rent tables: one scan over all markets, one shuffle; a table is sorted only where it is shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import city_label, clean_money, format_beds, normalize_property_type, property_type_rank, to_double
from .common import broadcast_checked, is_string


def avg_rent_rows(listings: DataFrame, markets: DataFrame, ordered: bool = True) -> DataFrame:
    """Average price and count by market x property type x beds.

    Reads only price, beds, property type and market (Parquet prunes the rest).
    Price text loses ``$`` and ``,``; unparsable values become NULL; type text
    is normalised; rows need all three, price > 0 and beds >= 0. Averages round
    half-to-even. Output: city, city_slug, property_type, beds (text),
    avg_price, listings, plus the numeric ``beds_value`` for ordering.
    """
    ptype_col = "property_type_raw" if "property_type_raw" in listings.columns else "property_type"
    price_col = "price_raw" if "price_raw" in listings.columns else "price"
    price = clean_money(price_col) if is_string(listings, price_col) else F.nanvl(F.col(price_col).cast("double"), F.lit(None).cast("double"))
    beds = to_double("beds") if is_string(listings, "beds") else F.nanvl(F.col("beds").cast("double"), F.lit(None).cast("double"))
    rows = listings.select(
        "city_slug",
        price.alias("price"),
        beds.alias("beds"),
        normalize_property_type(ptype_col).alias("property_type"),
    )
    # the price is a condition inside the aggregate: as a filter it would be parsed once more for each use
    paid = F.when(F.col("price") > 0, F.col("price"))
    agg = rows.groupBy("city_slug", "property_type", "beds").agg(F.avg(paid).alias("_avg"), F.count(paid).alias("listings")) \
        .filter(F.col("beds").isNotNull() & F.col("property_type").isNotNull() & (F.col("beds") >= 0) & (F.col("listings") > 0))
    mk = broadcast_checked(markets.select("city_slug", "display_name", "state"))
    out = agg.join(mk, "city_slug", "inner").select(
        city_label("display_name", "state").alias("city"),
        "city_slug",
        "property_type",
        format_beds("beds").alias("beds"),
        F.bround("_avg", 0).cast("long").alias("avg_price"),
        "listings",
        F.col("beds").alias("beds_value"),
        F.lower("display_name").alias("_city_sort"),
    )
    return (out.orderBy("_city_sort", "property_type", "beds_value") if ordered else out).drop("_city_sort")


def avg_rent_table_layout(rows: DataFrame) -> DataFrame:
    """Per-city table coordinates: property types in display order (list order,
    unknown types after, then by name) and bed columns in numeric order."""
    type_rank = property_type_rank("property_type")
    w_type = Window.partitionBy("city").orderBy(type_rank, "property_type")
    w_beds = Window.partitionBy("city").orderBy("beds_value")
    return rows.select(
        "city", "city_slug", "property_type", "beds", "avg_price", "listings", "beds_value",
        F.dense_rank().over(w_type).alias("type_order"),
        F.dense_rank().over(w_beds).alias("beds_order"),
    )


def avg_rent_pivot(rows: DataFrame) -> DataFrame:
    """Wide table: one row per (city, property type), one struct column per bed label.

    The labels become columns, so they are read first: one row per distinct bed count."""
    labels = [r[0] for r in rows.select("beds", "beds_value").distinct().orderBy("beds_value").select("beds").collect()]
    return (
        rows.groupBy("city", "city_slug", "property_type")
        .pivot("beds", labels)
        .agg(F.first(F.struct("avg_price", "listings")))
        .orderBy("city", property_type_rank("property_type"), "property_type")
    )


def avg_rent_tables(rows: DataFrame) -> DataFrame:
    """One row per city: its property types in display order, its bed labels in numeric order, and ``cells``,
    a map of property type to a map of bed label to (avg_price, listings).

    The bed labels stay data, so no pass reads them first; a city holds a few types times a few bed counts."""
    cell = F.struct("beds_value", "beds", F.struct("avg_price", "listings").alias("cell"))
    per_type = rows.filter(F.col("beds").isNotNull()).groupBy("city", "city_slug", "property_type").agg(F.sort_array(F.collect_list(cell)).alias("_c"))
    labelled = F.map_from_entries(F.transform("_c", lambda c: F.struct(c["beds"], c["cell"])))
    entry = F.struct(property_type_rank("property_type").alias("rank"), "property_type", labelled.alias("cells"),
                     F.transform("_c", lambda c: F.struct(c["beds_value"], c["beds"])).alias("beds"))
    # entries hold maps, which have no order: the types are sorted by their own columns
    per_city = per_type.select("city", "city_slug", entry.alias("e")).groupBy("city", "city_slug").agg(F.collect_list("e").alias("_e"))
    ordered = F.array_sort("_e", lambda a, b: F.when((a["rank"] < b["rank"]) | ((a["rank"] == b["rank"]) & (a["property_type"] < b["property_type"])), -1)
                           .when((a["rank"] == b["rank"]) & (a["property_type"] == b["property_type"]), 0).otherwise(1))
    beds = F.array_sort(F.array_distinct(F.flatten(F.transform("_e", lambda e: e["beds"]))))
    return per_city.select(
        "city", "city_slug", F.transform(ordered, lambda e: e["property_type"]).alias("property_types"),
        F.transform(beds, lambda b: b["beds"]).alias("beds"),
        F.map_from_entries(F.transform(ordered, lambda e: F.struct(e["property_type"], e["cells"]))).alias("cells"))

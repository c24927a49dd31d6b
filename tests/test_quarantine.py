"""Rejected pages and lines, observed audits, incomplete markets, nested rent tables and literal values of the rules."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from leasegrid.operators import clean, geo, rents
from leasegrid.sources import quarantine as qu

MARKETS = [("alpha", "Alpha", "MI"), ("beta", "Beta", "OH")]
MSCHEMA = "city_slug string, display_name string, state string"

PAGES = [
    (json.dumps([{"id": "1", "price": "900", "latitude": 42.0, "longitude": -84.0}]), None),
    (json.dumps({"listings": [{"id": "2", "price": "N/A", "features": ["a"]}, {"id": "3"}]}), None),
    (json.dumps([]), None),
    (json.dumps({"status": "ok"}), None),
    (json.dumps({"listings": None}), None),
    ('[{"id": "4"', "not JSON"),
    ("", "empty file"),
    ("  \n", "empty file"),
    (None, "empty file"),
    ("17", "neither a list nor an object"),
    ('"text"', "neither a list nor an object"),
    ('{"listings": {"id": "5"}}', "listings is not a list"),
    ('[{"id": "6"}, 3]', "an item is not an object"),
    ('{"listings": [null]}', "an item is not an object"),
]


def pages(spark):
    rows = [("alpha" if k % 2 == 0 else "beta", k, text) for k, (text, _) in enumerate(PAGES)]
    return spark.createDataFrame(rows, "city_slug string, page int, page_json string")


def test_bad_pages_are_set_aside_with_their_reason(spark):
    good, bad = qu.split_pages(pages(spark))
    assert {r.page: r.reason for r in bad.collect()} == {k: why for k, (_, why) in enumerate(PAGES) if why}
    assert sorted(r.page for r in good.collect()) == [k for k, (_, why) in enumerate(PAGES) if not why]


def test_audit_comes_from_the_writes(spark):
    root = tempfile.mkdtemp(prefix="leasegrid-ingest-")
    markets = spark.createDataFrame(MARKETS, MSCHEMA)
    done = qu.ingest_pages(pages(spark), markets, root, append_mode=True)
    rows = {r.city_slug: r for r in done.audit.collect()}
    assert (rows[None].pages, rows[None].rejected, rows[None].listings, rows[None].priced, rows[None].usable) == (14, 9, 3, 1, 1)
    assert (rows["alpha"].pages, rows["alpha"].listings, rows["beta"].pages, rows["beta"].listings) == (7, 1, 7, 2)
    assert all(r.append_mode and r.fetch_date is not None for r in rows.values())
    assert sorted(r.listing_id for r in done.listings.collect()) == ["1", "2", "3"]
    assert done.rejected.count() == 9 and done.rejected.filter("page = 5").first().page_json == '[{"id": "4"'
    none = qu.ingest_pages(pages(spark).limit(0), markets, tempfile.mkdtemp(prefix="leasegrid-ingest-"))
    assert [r.pages for r in none.audit.collect()] == [0, 0, 0] and none.listings.count() == 0


def write(root, slug, lines, name="rentals.csv"):
    os.makedirs(f"{root}/city_slug={slug}", exist_ok=True)
    with open(f"{root}/city_slug={slug}/{name}", "w") as f:
        f.write("\n".join(lines) + "\n")


def test_incomplete_markets_are_reported_and_ragged_lines_kept_apart(spark):
    root = tempfile.mkdtemp(prefix="leasegrid-files-")
    write(root, "alpha", ["﻿Price,Beds,Property Type,Address", '"$1,200",2,Condo,"1 Main St, Rear"', "900,1", "800,1,Condo,2 Main St,more"])
    write(root, "beta", ["Price,Property Type", "700,Condo"])
    write(root, "gamma", ["Address,Property Type,Beds,Price", "3 Main St,condo,0,650"])
    write(root, "delta", ["Price,Beds,Property Type", "500,1,Condo"])
    write(root, "delta", ["Price,Beds", "500,1"], "more.csv")
    write(root, "empty", ["Price,Beds,Property Type"])
    rows, ragged, report = qu.read_market_files(spark, root)
    assert {r.city_slug: (r.used, r.missing, r.n_rows, r.n_ragged) for r in report.collect()} == {
        "alpha": (True, [], 1, 2), "beta": (False, ["Beds"], 0, 0), "gamma": (True, [], 1, 0),
        "delta": (False, ["Property Type"], 0, 0), "empty": (True, [], 0, 0)}
    assert {(r.city_slug, r.price, r.beds, r.address) for r in rows.collect()} == {("alpha", "$1,200", "2", "1 Main St, Rear"), ("gamma", "650", "0", "3 Main St")}
    assert sorted(r.line for r in ragged.collect()) == ["800,1,Condo,2 Main St,more", "900,1"]
    assert all(r.file.endswith("rentals.csv") for r in ragged.collect())


def test_tables_without_a_column_of_a_market(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", None, 1.0), ("b", 3.0, None)], "city_slug string, price double, beds double")
    rows, report = qu.checked_tables(df, ("price", "beds"))
    assert {r.city_slug: (r.used, r.missing, r.n_rows) for r in report.collect()} == {"a": (True, [], 2), "b": (False, ["beds"], 1)}
    assert rows.count() == 2


def test_nested_rent_tables(spark):
    rows = [("A, MI", "a", "Loft", "1", 900, 2, 1.0), ("A, MI", "a", "Condo", "10", 2000, 1, 10.0), ("A, MI", "a", "Condo", "2", 1200, 3, 2.0),
            ("B, OH", "b", "Apartment", "1.5", 800, 1, 1.5), ("B, OH", "b", "Apartment", None, 1, 1, None)]
    df = spark.createDataFrame(rows, "city string, city_slug string, property_type string, beds string, avg_price long, listings long, beds_value double")
    a, b = rents.avg_rent_tables(df).orderBy("city").collect()
    assert (a.property_types, a.beds) == (["Condo", "Loft"], ["1", "2", "10"])
    assert {t: {k: tuple(c) for k, c in x.items()} for t, x in a.cells.items()} == {"Condo": {"2": (1200, 3), "10": (2000, 1)}, "Loft": {"1": (900, 2)}}
    assert b.beds == ["1.5"] and list(b.cells) == ["Apartment"]


def test_missing_markers_in_text_columns(spark):
    df = spark.createDataFrame([("N/A", "", "n/a", "N/A", "$1,000")], "address string, zip string, city string, beds string, price_raw string")
    r = clean.standardize_listings(df).first()
    assert (r.address, r.zip, r.city, r.beds, r.price) == (None, None, "n/a", None, 1000.0)


def test_legend_is_sorted_by_size(spark):
    df = spark.createDataFrame([("m", c, f"n{c}", n, 42.0, -84.0) for c, n in enumerate([3, 9, 9, 1])],
                               "city_slug string, cluster_id int, name string, count long, latitude double, longitude double")
    assert [r.name for r in geo.map_legend(geo.map_layer(df)).collect()] == ["n1", "n2", "n0", "n3"]


def test_literal_values_of_the_rules(spark):
    """Expected values written out, not taken from the engine's constants."""
    rows = [(k, "m", b, ba, s, t) for k, (b, ba, s, t) in enumerate([
        (None, None, 449.0, "Condo"), (None, None, 450.0, "Condo"), (None, None, 749.0, "Condo"), (None, None, 750.0, "Condo"),
        (None, None, 1099.0, "Condo"), (None, None, 1100.0, "Condo"), (None, None, 1499.0, "Condo"), (None, None, 1500.0, "Condo"),
        (2.0, None, 199.0, "Condo"), (2.0, None, 200.0, "Condo"), (2.0, None, 5000.0, "Condo"), (2.0, None, 5001.0, "Condo"), (4.0, None, 800.0, "Condo")])]
    df = spark.createDataFrame(rows, "row_id int, city_slug string, beds double, baths double, sqft double, property_type string")
    kept = clean.filter_impossible_sqft(df)
    got = {r.row_id: (r.beds, r.baths) for r in clean.impute_listings(kept, clean.bed_sqft_medians(kept)).collect()}
    assert got == {0: (0.0, 1.0), 1: (1.0, 1.0), 2: (1.0, 1.0), 3: (2.0, 1.0), 4: (2.0, 1.0), 5: (3.0, 1.0), 6: (3.0, 1.0), 7: (4.0, 2.0),
                   9: (2.0, 1.0), 10: (2.0, 1.0), 12: (4.0, 2.0)}
    prices = spark.createDataFrame([(k, "m", float(p)) for k, p in enumerate([100, 200, 300, 400, 1000])], "row_id int, city_slug string, price double")
    b = clean.price_iqr_bounds(prices).first()
    assert (b.q1, b.q3, b.lower_bound, b.upper_bound) == (200.0, 400.0, -100.0, 700.0)
    assert sorted(r.price for r in clean.remove_price_outliers(prices, clean.price_iqr_bounds(prices)).collect()) == [100.0, 200.0, 300.0, 400.0]
    point = spark.range(1).select(F.lit(42.0).alias("a"), F.lit(-84.0).alias("b"), F.lit(43.0).alias("c"))
    from leasegrid.functions.geo import haversine_miles
    miles = point.select(haversine_miles("a", "b", "c", "b")).first()[0]
    assert abs(miles - 69.0976) < 1e-3  # one degree of a sphere of 3959 miles

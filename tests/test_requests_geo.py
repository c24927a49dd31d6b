"""Validation messages, mode rules, geocoding variants, nearest centroid, markets."""

from pyspark.sql import functions as F

from leasegrid.operators import geo, geocode, requests as rq
from leasegrid.operators.stats import contiguous_folds

REQ = "request_id long, address string, beds string, baths string, sqft string, property_type string, prediction_mode string, comps_k string"


def test_validation_messages(spark):
    rows = [
        (1, "500 E Washington St", "2", "1", "900", "Apartment", None, None),
        (2, " abc ", "11", "-1", "99", "Loft", "Fast", "2"),
        (3, None, "2", "1", None, "Condo", "auto", "5"),
        (4, "12345", "two", "x", "9.5", "Multi Family", " COMPS ", "10"),
    ]
    out = {r.request_id: r for r in rq.validate_requests(spark.createDataFrame(rows, REQ)).collect()}
    assert out[1].error is None and out[1].prediction_mode == "auto" and out[1].comps_k == 5
    assert out[2].error == ("Address is too short; Beds cannot exceed 10; Baths cannot be negative; SqFt must be at least 100; "
                            "Invalid property_type. Must be one of: ['Apartment', 'Single Family', 'Condo', 'Townhouse', 'Multi-Family']; "
                            "Invalid prediction_mode. Must be one of: ['auto', 'model', 'comps']; comps_k must be between 3 and 10")
    assert out[3].error == "Missing required fields: ['address', 'sqft']"
    assert out[4].error == "Beds must be a valid integer; Baths must be a valid number; SqFt must be a valid integer"
    assert out[4].property_type == "Multi-Family" and out[4].prediction_mode == "comps"


def test_mode_rules_and_band(spark):
    df = spark.createDataFrame([(1, "auto", "Single Family", "east_lansing"), (2, "auto", "Single Family", "lansing"),
                                (3, "comps", "Condo", "x"), (4, "model", "Single Family", "east_lansing")],
                               "request_id long, prediction_mode string, property_type string, city_slug string")
    out = {r.request_id: r for r in rq.resolve_mode(df).collect()}
    assert out[1].use_comps and out[1].comps_first and not out[1].use_pooled
    assert not out[2].use_comps and out[2].use_pooled
    assert out[3].use_comps and out[3].type_filter == "Condo"
    assert not out[4].use_comps and out[4].use_pooled and out[4].type_filter is None
    sc = spark.createDataFrame([(1, 1000.0, None, 1200.0, 1100.0, 1300.0, 5, True, True, "auto"),
                                (2, 100.0, 300.0, None, None, None, None, False, False, "model"),
                                (3, 100.0, 300.0, None, None, None, None, True, False, "comps")],
                               "request_id long, model_price double, cv_rmse double, comps_avg double, comps_low double, "
                               "comps_high double, comps_count long, use_comps boolean, comps_first boolean, prediction_mode string") \
        .withColumn("error", F.lit(None).cast("string"))
    res = {r.request_id: r for r in rq.assemble_estimate(sc).collect()}
    assert res[1].predicted_price == 1200 and res[1].prediction_order == ["comps", "model"]
    assert res[1].model_prediction.price_range.low == 758 and res[1].price_range.high == 1300
    assert res[2].price_range.low == 0 and res[2].prediction_order == ["model"] and res[2].comps_prediction is None
    assert res[3].error.startswith("No comparable properties found")


def variants(spark, addr):
    df = spark.createDataFrame([(addr,)], "address string")
    return geocode.with_address_variants(df).first().variants


def test_address_variants(spark):
    assert variants(spark, "3 Main St.") == ["3 Main St.", "3 Main Street", "3 Main St", "3 Main"]
    # derived by hand from the variant rules (merge keeps the words' case)
    assert variants(spark, "1205 May Apple Ln Ypsilanti MI 48198") == [
        "1205 May Apple Ln Ypsilanti MI 48198", "1205 MayApple Ln Ypsilanti MI 48198",
        "1205 May Apple Lane Ypsilanti MI 48198", "1205 May Apple Ln Ypsilanti Michigan 48198",
        "1205 May Apple Lane Ypsilanti Michigan 48198", "1205 May Apple Ln Ypsilanti MI",
        "1205 May Apple Ln Ypsilanti, MI 48198", "1205 MayApple Ln Ypsilanti, MI 48198",
        "1205 May Apple Lane Ypsilanti, MI 48198", "1205 May Apple Ln Ypsilanti, Michigan 48198",
        "1205 May Apple Lane Ypsilanti, Michigan 48198", "1205 May, Apple Ln Ypsilanti, MI",
        "1205 May Apple Ln Ypsilanti, MI", "1205 May Apple Ypsilanti MI 48198",
    ]


def test_geocode_first_variant_wins(spark):
    gaz = spark.createDataFrame([("12 main street", 1.0, 2.0), ("12 main", 3.0, 4.0)], "normalised_address string, latitude double, longitude double")
    req = spark.createDataFrame([(1, "12 Main St", None, None), (2, "99 Nowhere", None, None), (3, "12 Main St", 7.0, 8.0)],
                                "request_id long, address string, latitude double, longitude double")
    out = {r.request_id: r for r in geocode.geocode(req, gaz).collect()}
    assert (out[1].latitude, out[1].longitude, out[1].geocoded) == (1.0, 2.0, True)
    assert out[2].latitude is None and not out[2].geocoded
    assert (out[3].latitude, out[3].longitude) == (7.0, 8.0)


def test_nearest_cluster_and_market(spark):
    cents = spark.createDataFrame([("a", 0, 42.0, -84.0), ("a", 1, 42.2, -83.8)], "city_slug string, cluster_id int, latitude double, longitude double")
    pts = spark.createDataFrame([(1, "a", 42.19, -83.81), (2, "b", 42.0, -84.0)], "request_id long, city_slug string, latitude double, longitude double")
    assert {r.request_id: r.cluster_id for r in geo.nearest_cluster(pts, cents).collect()} == {1: 1, 2: 0}
    mk = spark.createDataFrame([("x", 42.0, -84.0, 5, 0), ("y", 42.05, -84.0, 5, 1)],
                               "city_slug string, center_lat double, center_lon double, radius_miles int, market_ord int")
    p = spark.createDataFrame([(1, 42.04, -84.0), (2, 43.0, -84.0), (3, 42.025, -84.0)], "request_id long, latitude double, longitude double")
    got = {r.request_id: r.city_slug for r in geo.detect_market(p, mk).collect()}
    assert got == {1: "y", 2: None, 3: "x"}  # equal distance -> earlier market


def test_contiguous_folds_sizes(spark):
    df = spark.createDataFrame([("a", i) for i in range(7)] + [("b", i) for i in range(10, 13)], "city_slug string, row_id long")
    f = contiguous_folds(df).collect()
    a = [r.fold for r in sorted((r for r in f if r.city_slug == "a"), key=lambda r: r.row_id)]
    assert a == [0, 0, 1, 1, 2, 3, 4]
    b = [r.fold for r in sorted((r for r in f if r.city_slug == "b"), key=lambda r: r.row_id)]
    assert b == [0, 1, 2]


def test_folds_exact_with_a_hot_market(spark):
    # one market holds a third of the rows; it spans several range partitions
    rows = [("hot", i) for i in range(3000)] + [(f"m{i % 40}", 10_000 + i) for i in range(6000)]
    df = spark.createDataFrame(rows, "city_slug string, row_id long")
    got = {(r.city_slug, r.row_id): r.fold for r in contiguous_folds(df).collect()}
    by = {}
    for c, r in rows:
        by.setdefault(c, []).append(r)
    for c, ids in by.items():
        n = len(ids)
        q, rem = divmod(n, 5)
        sizes = [q + 1] * rem + [q] * (5 - rem)
        expect = [f for f, s in enumerate(sizes) for _ in range(s)]
        assert [got[(c, r)] for r in sorted(ids)] == expect, c


def test_numbers_beyond_a_long_and_not_a_number(spark):
    from leasegrid.operators.requests import validate_requests

    base = dict(request_id="x", address="12 Main St", beds="2", baths=1.0, sqft=800.0, property_type="Condo")
    rows = [base | c for c in ({"beds": "99999999999999999999"}, {"beds": "-99999999999999999999"}, {"baths": float("nan")}, {"sqft": 1e300},
                               {"sqft": float("inf")}, {"baths": float("inf")})]
    df = spark.createDataFrame([(str(k), r["address"], r["beds"], r["baths"], r["sqft"], r["property_type"]) for k, r in enumerate(rows)],
                               "request_id string, address string, beds string, baths double, sqft double, property_type string")
    got = {r.request_id: r.error for r in validate_requests(df).collect()}
    assert got == {"0": "Beds cannot exceed 10", "1": "Beds cannot be negative", "2": None, "3": "SqFt cannot exceed 10,000",
                   "4": "SqFt must be a valid integer", "5": "Baths cannot exceed 10"}

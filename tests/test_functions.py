"""Scalar functions and small operators on literal rows."""

import math

from pyspark.sql import functions as F

from leasegrid.functions.geo import direction_from_center, haversine_miles, web_mercator
from leasegrid.functions.text import clean_money, format_beds, money_text, normalize_property_type, to_double


def one(spark, expr, schema="x string", rows=None):
    df = spark.createDataFrame(rows or [(None,)], schema)
    return [r[0] for r in df.select(expr).collect()]


def test_haversine_properties(spark):
    df = spark.createDataFrame([(42.24, -83.61, 42.28, -83.74)], "a double, b double, c double, d double")
    r = df.select(haversine_miles("a", "b", "c", "d").alias("ab"), haversine_miles("c", "d", "a", "b").alias("ba"),
                  haversine_miles("a", "b", "a", "b").alias("aa")).first()
    assert abs(r.ab - r.ba) < 1e-9 and r.aa == 0.0
    # independent check of the same formula
    la1, lo1, la2, lo2 = map(math.radians, (42.24, -83.61, 42.28, -83.74))
    a = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    assert abs(r.ab - 2 * 3959 * math.atan2(math.sqrt(a), math.sqrt(1 - a))) < 1e-9


def test_coercion_nan_and_money(spark):
    vals = one(spark, to_double("x"), rows=[("12.5",), ("N/A",), ("nan",), ("",), (None,)])
    assert vals == [12.5, None, None, None, None]
    assert one(spark, clean_money("x"), rows=[("$1,234",), ("N/A",), ("",)]) == [1234.0, None, None]


def test_property_type_normalisation(spark):
    rows = [(" apartment ",), ("Townhome",), ("multifamily",), ("Loft",), ("  ",), (None,)]
    assert one(spark, normalize_property_type("x"), rows=rows) == ["Apartment", "Townhouse", "Multi-Family", "Loft", None, None]


def test_format_beds_and_money(spark):
    assert one(spark, format_beds("x"), "x double", [(2.0,), (2.5,), (None,)]) == ["2", "2.5", None]
    assert one(spark, money_text("x"), "x double", [(1234.5,), (None,), (2.5,)]) == ["$1,234", "N/A", "$2"]


def test_direction(spark):
    df = spark.createDataFrame([(42.3, -83.6, 42.24, -83.61), (42.241, -83.5, 42.24, -83.61), (42.24, -83.61, 42.24, -83.6)],
                               "a double, b double, c double, d double")
    assert [r[0] for r in df.select(direction_from_center("a", "b", "c", "d")).collect()] == ["Far North", "Far East", "West"]


def test_web_mercator(spark):
    df = spark.createDataFrame([(-83.61, 42.24)], "lon double, lat double")
    x, y = web_mercator("lon", "lat")
    r = df.select(x.alias("x"), y.alias("y")).first()
    assert abs(r.x - (-83.61 * 20037508.34 / 180)) < 1e-6
    yy = math.log(math.tan((90 + 42.24) * math.pi / 360)) / (math.pi / 180) * 20037508.34 / 180
    assert abs(r.y - yy) < 1e-6

"""Geographic operators: centroids, nearest centroid, market detection,
reverse geocoding against a places table, unique cluster names, map layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.geo import direction_from_center, haversine_miles, squared_degrees, unit_vector, web_mercator
from .common import broadcast_checked


# --------------------------------------------------------------------------- AGG6 / AGG7
def cluster_centroids(listings: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Mean coordinates and size per (market, cluster); name from ``names`` or
    ``Neighborhood {id+1}``. Partial + final hash aggregate, one shuffle."""
    c = listings.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col("cluster_id").isNotNull()) \
        .groupBy("city_slug", F.col("cluster_id").cast("int").alias("cluster_id")).agg(
            F.avg("latitude").alias("latitude"),
            F.avg("longitude").alias("longitude"),
            F.count(F.lit(1)).alias("count"),
        )
    default = F.concat(F.lit("Neighborhood "), (F.col("cluster_id") + 1).cast("string"))
    if names is None:
        return c.withColumn("name", default)
    n = broadcast_checked(names.select("city_slug", "cluster_id", F.col("name").alias("_name")))
    return c.join(n, ["city_slug", "cluster_id"], "left").withColumn("name", F.coalesce("_name", default)).drop("_name")


def cluster_sizes(listings: DataFrame, clusters: DataFrame) -> DataFrame:
    """Listings per named cluster, zero for clusters that lost all rows."""
    counts = listings.groupBy("city_slug", F.col("cluster_id").cast("int").alias("cluster_id")).agg(F.count(F.lit(1)).alias("_n"))
    dim = broadcast_checked(clusters.select("city_slug", "cluster_id", "name"))
    return dim.join(counts, ["city_slug", "cluster_id"], "left").select(
        "city_slug", "cluster_id", "name", F.coalesce("_n", F.lit(0)).cast("long").alias("listings"))


# --------------------------------------------------------------------------- JN3
def nearest_cluster(points: DataFrame, centroids: DataFrame, out: str = "cluster_id") -> DataFrame:
    """Nearest centroid of the point's own market by squared degrees; 0 when the
    market has none. Centroids are gathered per market (at most a few dozen per
    market) and broadcast, so points are not shuffled."""
    per_market = centroids.groupBy("city_slug").agg(
        F.collect_list(F.struct(F.col("cluster_id").cast("int").alias("cid"),
                                F.col("latitude").alias("clat"), F.col("longitude").alias("clon"))).alias("_cents"))
    j = points.join(broadcast_checked(per_market), "city_slug", "left")
    best = F.array_min(F.transform(
        "_cents",
        lambda c: F.struct(squared_degrees(F.col("latitude"), F.col("longitude"), c["clat"], c["clon"]).alias("d2"), c["cid"].alias("cid")),
    ))
    return j.withColumn(out, F.coalesce(best["cid"], F.lit(0)).cast("int")).drop("_cents")


# --------------------------------------------------------------------------- spatial cells
def _cells(lat: Column, lon: Column, width_miles: float) -> tuple[Column, Column, Column]:
    x, y, z = unit_vector(lat, lon)
    s = F.lit(K.EARTH_RADIUS_MILES / width_miles)
    return tuple(F.floor(v * s).cast("long") for v in (x, y, z))  # type: ignore[return-value]


def _cell_range(v: Column, r: Column, width_miles: float) -> Column:
    s = F.lit(K.EARTH_RADIUS_MILES)
    return F.sequence(F.floor((v * s - r) / F.lit(width_miles)).cast("long"), F.floor((v * s + r) / F.lit(width_miles)).cast("long"))


# --------------------------------------------------------------------------- JN4
def detect_market(points: DataFrame, markets: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Nearest market whose centre lies strictly within its own radius; ties go
    to the earlier market. Adds ``city_slug`` (NULL when none) and
    ``distance_from_center_mi``.

    Markets are replicated into the unit-sphere cells their disks touch and
    gathered per cell; each point looks up only its own cell through a broadcast
    hash join, so the point side is never shuffled nor paired with every market.
    """
    m = markets.select("city_slug", "center_lat", "center_lon", F.col("radius_miles").cast("double").alias("r"), "market_ord")
    width = float(m.agg(F.max("r")).first()[0] or 1.0)
    width = max(width, 1.0)
    x, y, z = unit_vector(F.col("center_lat"), F.col("center_lon"))
    cells = (
        m.withColumn("cx", F.explode(_cell_range(x, F.col("r"), width)))
        .withColumn("cy", F.explode(_cell_range(y, F.col("r"), width)))
        .withColumn("cz", F.explode(_cell_range(z, F.col("r"), width)))
        .groupBy("cx", "cy", "cz")
        .agg(F.collect_list(F.struct("city_slug", "center_lat", "center_lon", "r", "market_ord")).alias("_mk"))
    )
    px, py, pz = _cells(F.col(lat), F.col(lon), width)
    p = points.withColumns({"cx": px, "cy": py, "cz": pz})
    j = p.join(broadcast_checked(cells), ["cx", "cy", "cz"], "left")
    cand = F.transform("_mk", lambda mk: F.struct(
        haversine_miles(F.col(lat), F.col(lon), mk["center_lat"], mk["center_lon"]).alias("d"),
        mk["market_ord"].alias("o"), mk["city_slug"].alias("s"), mk["r"].alias("r")))
    inside = F.filter(cand, lambda c: c["d"] < c["r"])
    best = F.array_min(inside)
    return j.withColumns({"city_slug": best["s"], "distance_from_center_mi": best["d"]}).drop("cx", "cy", "cz", "_mk")


# --------------------------------------------------------------------------- JN9
def reverse_geocode(points: DataFrame, places: DataFrame, key: list[str], start_miles: float = 2.0) -> DataFrame:
    """Most specific locality name of the nearest place to each point.

    ``points`` is small (cluster centroids); it is broadcast and the places table
    streams past it in rounds of growing radius; a point is final once its
    nearest place found lies within the round's radius. Result: key + ``place_name``.
    """
    names = [F.col(c) for c in K.REVERSE_GEOCODE_ORDER if c in places.columns]
    pl = places.select("latitude", "longitude", F.coalesce(*names, F.lit(K.REVERSE_GEOCODE_DEFAULT)).alias("place_name"))
    pts = points.select(*key, F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon")).persist()
    todo = pts
    width = start_miles
    done: list[DataFrame] = []
    while todo.take(1):
        # Unit-sphere coordinates span 2R, so a cell this wide reaches every place.
        last = width >= 2 * K.EARTH_RADIUS_MILES
        x, y, z = unit_vector(F.col("p_lat"), F.col("p_lon"))
        q = (todo.withColumn("cx", F.explode(_cell_range(x, F.lit(width), width)))
             .withColumn("cy", F.explode(_cell_range(y, F.lit(width), width)))
             .withColumn("cz", F.explode(_cell_range(z, F.lit(width), width))))
        px, py, pz = _cells(F.col("latitude"), F.col("longitude"), width)
        cand = pl.withColumns({"cx": px, "cy": py, "cz": pz}).join(broadcast_checked(q), ["cx", "cy", "cz"], "inner")
        cand = cand.withColumn("_d", haversine_miles(F.col("p_lat"), F.col("p_lon"), F.col("latitude"), F.col("longitude")))
        best = cand.groupBy(*key).agg(F.min_by("place_name", F.struct("_d", "latitude", "longitude")).alias("place_name"),
                                      F.min("_d").alias("_d"))
        ok = best if last else best.filter(F.col("_d") <= F.lit(width))
        ok = ok.select(*key, "place_name").checkpoint()
        done.append(ok)
        todo = todo.join(ok.select(*key), key, "left_anti").checkpoint()
        width *= 4
        if last:
            break
    out = done[0] if done else pts.select(*key).withColumn("place_name", F.lit(None).cast("string")).limit(0)
    for d in done[1:]:
        out = out.unionByName(d)
    return out


# --------------------------------------------------------------------------- JN10
def name_clusters(centroids: DataFrame, place_names: DataFrame, markets: DataFrame) -> DataFrame:
    """Unique cluster names per market, decided in cluster order.

    A place name is kept the first time it appears; later repeats (and missing
    names) get ``<direction> <market>``, numbered from 2 when taken. The fold
    runs per market over its clusters (a few dozen at most) with ``aggregate``.
    """
    mk = broadcast_checked(markets.select("city_slug", "display_name", "center_lat", "center_lon"))
    c = centroids.join(place_names, ["city_slug", "cluster_id"], "left").join(mk, "city_slug", "inner")
    c = c.withColumn("fallback", F.concat(direction_from_center("latitude", "longitude", "center_lat", "center_lon"),
                                          F.lit(" "), F.col("display_name")))
    per = c.groupBy("city_slug").agg(F.array_sort(F.collect_list(F.struct("cluster_id", "place_name", "fallback"))).alias("_cl"))
    init = F.struct(F.array().cast("array<string>").alias("used"),
                    F.array().cast("array<struct<cluster_id:int,name:string>>").alias("names"))

    def step(acc, e):
        used = acc["used"]
        real_ok = e["place_name"].isNotNull() & (e["place_name"] != "") & ~F.array_contains(used, e["place_name"])
        free = F.filter(F.sequence(F.lit(2), F.size(used) + 2),
                        lambda i: ~F.array_contains(used, F.concat(e["fallback"], F.lit(" "), i.cast("string"))))
        numbered = F.concat(e["fallback"], F.lit(" "), F.try_element_at(free, F.lit(1)).cast("string"))
        fb = F.when(F.array_contains(used, e["fallback"]), numbered).otherwise(e["fallback"])
        chosen = F.when(real_ok, e["place_name"]).otherwise(fb)
        return F.struct(
            F.array_append(used, chosen).alias("used"),
            F.array_append(acc["names"], F.struct(e["cluster_id"].cast("int").alias("cluster_id"), chosen.alias("name"))).alias("names"),
        )

    folded = per.select("city_slug", F.explode(F.aggregate("_cl", init, step)["names"]).alias("n"))
    return folded.select("city_slug", "n.cluster_id", "n.name")


# --------------------------------------------------------------------------- map data
def map_layer(clusters: DataFrame) -> DataFrame:
    """Cluster centroids in Web Mercator with the label rule (count >= 5, or >= 2
    when the map holds at most 100 listings)."""
    total = clusters.agg(F.sum("count")).first()[0] or 0
    min_count = K.LABEL_MIN_COUNT_LARGE if total > K.LABEL_LARGE_TOTAL else K.LABEL_MIN_COUNT_SMALL
    x, y = web_mercator(F.col("longitude"), F.col("latitude"))
    return clusters.select(
        "city_slug", "cluster_id", "name", "count", "latitude", "longitude",
        x.alias("x"), y.alias("y"), (F.col("count") >= F.lit(min_count)).alias("labelled"),
    )


def map_legend(layer: DataFrame) -> DataFrame:
    """Legend entries of a map layer, the largest cluster first (market and cluster order on ties)."""
    return layer.select("city_slug", "cluster_id", "name", "count").orderBy(F.col("count").desc(), "city_slug", "cluster_id")


def map_extent(listings: DataFrame) -> DataFrame:
    """Mean of all coordinates across markets and the total listing count."""
    return listings.agg(
        F.avg("latitude").alias("center_lat"),
        F.avg("longitude").alias("center_lon"),
        F.count(F.lit(1)).alias("total_listings"),
    )

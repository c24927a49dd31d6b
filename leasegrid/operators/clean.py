"""Listing cleaning: coercion, impossible values, medians, imputation, price outliers, de-dup.

All functions are ``DataFrame -> DataFrame`` and keyed by ``city_slug`` so one
job covers every market.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import clean_money, normalize_property_type, null_if_marker, to_double
from .common import broadcast_checked, is_string
from .stats import ordinal_within

NUMERIC_COLUMNS = ["price", "beds", "baths", "sqft", "latitude", "longitude", "year_built"]


# --------------------------------------------------------------------------- coercion
def standardize_listings(df: DataFrame) -> DataFrame:
    """Missing markers -> NULL, numeric coercion, currency text, type spelling.

    ``"N/A"`` and ``""`` become NULL in every text column; ``price_raw`` (text such as
    ``$1,234.00``) becomes ``price``; string numeric columns are coerced leniently;
    ``property_type_raw`` is normalised.
    """
    out = df.withColumns({c: null_if_marker(c) for c in df.columns if is_string(df, c)})
    if "price_raw" in out.columns:
        out = out.withColumn("price", clean_money("price_raw")).drop("price_raw")
    casts = {}
    for c in NUMERIC_COLUMNS:
        if c in out.columns:
            casts[c] = to_double(c) if is_string(out, c) else F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    if "property_type_raw" in out.columns:
        casts["property_type"] = normalize_property_type("property_type_raw")
    out = out.withColumns(casts)
    if "property_type_raw" in out.columns:
        out = out.drop("property_type_raw")
    return out


# --------------------------------------------------------------------------- filters
def filter_impossible_sqft(df: DataFrame) -> DataFrame:
    """Keep rows whose SqFt is missing or within [200, 5000] (missing is kept)."""
    s = F.col("sqft")
    return df.filter(s.isNull() | s.between(K.SQFT_MIN_VALID, K.SQFT_MAX_VALID))


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    cond = None
    for c in cols:
        e = F.col(c).isNotNull()
        cond = e if cond is None else cond & e
    return df.filter(cond)


# --------------------------------------------------------------------------- medians
def bed_sqft_medians(df: DataFrame, keys: list[str] = ["city_slug"]) -> DataFrame:
    """Median SqFt per bed count 0..5 per market, truncated to int; 870 when empty.

    Exact ``median`` (interpolating, like the reference). It keeps one counter
    per distinct SqFt value of a (market, beds) group, which is bounded by the
    SqFt domain rather than by row count.
    """
    b, s = F.col("beds"), F.col("sqft")
    med = (
        df.filter(b.isin(*range(K.MEDIAN_BEDS_MAX + 1)) & s.isNotNull())
        .groupBy(*keys, b.cast("int").alias("beds"))
        .agg(F.median(s).alias("_med"))
    )
    frame = df.select(*keys).distinct().withColumn("beds", F.explode(F.sequence(F.lit(0), F.lit(K.MEDIAN_BEDS_MAX))))
    return (
        frame.join(med, [*keys, "beds"], "left")
        .select(*keys, "beds", F.coalesce(F.col("_med").cast("int"), F.lit(K.MEDIAN_EMPTY_SQFT)).alias("sqft_median"))
    )


def default_medians_map() -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(K.DEFAULT_SQFT_BY_BEDS.items())])


# --------------------------------------------------------------------------- imputation
def _beds_from_sqft(sqft: Column) -> Column:
    out = F.when(sqft.isNull(), F.lit(None))
    for bound, beds in K.BEDS_FROM_SQFT_BREAKS:
        out = out.when(sqft < bound, F.lit(float(beds)))
    return out.otherwise(F.lit(float(K.BEDS_FROM_SQFT_TOP)))


def impute_listings(df: DataFrame, medians: DataFrame | None = None, keys: list[str] = ["city_slug"],
                    flags: bool = False) -> DataFrame:
    """Fill Beds, Baths and SqFt in the reference's exact order, as one projection.

    beds1  = beds, else from SqFt bands
    baths1 = baths, else 1.0 (beds1 < 4) or 2.0 (beds1 >= 4)
    sqft1  = sqft, else median of beds1 (0..5) or of 5 for beds1 > 5
    beds2/baths2 = property-type defaults, then 2 / 1.0; sqft2 = 870
    ``medians`` is the output of ``bed_sqft_medians``; without it the fixed
    defaults apply. It is broadcast only after its size check.
    """
    beds1 = F.coalesce(F.col("beds"), _beds_from_sqft(F.col("sqft")))
    baths1 = F.coalesce(
        F.col("baths"),
        F.when(beds1.isNull(), F.lit(None)).when(beds1 < K.BATHS_LARGE_FROM_BEDS, F.lit(K.BATHS_SMALL)).otherwise(F.lit(K.BATHS_LARGE)),
    )
    med_key = (
        F.when(beds1 > K.MEDIAN_BEDS_MAX, F.lit(K.MEDIAN_BEDS_MAX))
        .when(beds1.isin(*range(K.MEDIAN_BEDS_MAX + 1)), beds1)
        .cast("int")
    )
    staged = df.withColumns({"_beds1": beds1, "_baths1": baths1, "_mkey": med_key})
    if medians is None:
        m = default_medians_map()
        staged = staged.withColumn("_med", m[F.col("_mkey")].cast("double"))
    else:
        # medians always hold keys 0..5, so beds > 5 finds the key-5 median
        med = broadcast_checked(medians.select(*keys, F.col("beds").alias("_mkey"), F.col("sqft_median").cast("double").alias("_med")))
        staged = staged.join(med, [*keys, "_mkey"], "left")
    type_beds = F.create_map(*[F.lit(x) for t, (b, _) in K.TYPE_DEFAULTS.items() for x in (t, float(b))])
    type_baths = F.create_map(*[F.lit(x) for t, (_, ba) in K.TYPE_DEFAULTS.items() for x in (t, float(ba))])
    sqft1 = F.coalesce(F.col("sqft"), F.col("_med"))
    pt = F.col("property_type")
    new = {
        "beds": F.coalesce(F.col("_beds1"), type_beds[pt], F.lit(float(K.FINAL_BEDS))),
        "baths": F.coalesce(F.col("_baths1"), type_baths[pt], F.lit(K.FINAL_BATHS)),
        "sqft": F.coalesce(sqft1, F.lit(float(K.FINAL_SQFT))),
    }
    if flags:
        new.update({
            "imputed_beds": F.col("beds").isNull(),
            "imputed_baths": F.col("baths").isNull(),
            "imputed_sqft": F.col("sqft").isNull(),
        })
    return staged.withColumns(new).drop("_beds1", "_baths1", "_mkey", "_med")


def imputation_counts(imputed: DataFrame, keys: list[str] = ["city_slug"]) -> DataFrame:
    """How many values were filled per column and market (needs ``flags=True``)."""
    return imputed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("imputed_beds")).alias("beds_imputed"),
        F.count_if(F.col("imputed_baths")).alias("baths_imputed"),
        F.count_if(F.col("imputed_sqft")).alias("sqft_imputed"),
    )


# --------------------------------------------------------------------------- price outliers
def price_iqr_bounds(df: DataFrame, keys: list[str] = ["city_slug"], multiplier: float = K.IQR_MULTIPLIER) -> DataFrame:
    """Q1, Q3 (linear interpolation), IQR and the keep-bounds per market."""
    q = df.filter(F.col("price").isNotNull()).groupBy(*keys).agg(
        F.percentile(F.col("price"), F.array(F.lit(0.25), F.lit(0.75))).alias("_q"),
    )
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    return q.select(
        *keys,
        q1.alias("q1"),
        q3.alias("q3"),
        (q3 - q1).alias("iqr"),
        (q1 - F.lit(multiplier) * (q3 - q1)).alias("lower_bound"),
        (q3 + F.lit(multiplier) * (q3 - q1)).alias("upper_bound"),
    )


def remove_price_outliers(df: DataFrame, bounds: DataFrame, keys: list[str] = ["city_slug"]) -> DataFrame:
    """Keep rows with lower <= price <= upper; missing prices are removed too."""
    b = broadcast_checked(bounds.select(*keys, "lower_bound", "upper_bound"))
    return (
        df.join(b, keys, "inner")
        .filter(F.col("price").between(F.col("lower_bound"), F.col("upper_bound")))
        .drop("lower_bound", "upper_bound")
    )


def price_outlier_report(df: DataFrame, bounds: DataFrame, keys: list[str] = ["city_slug"]) -> DataFrame:
    """Per market: bounds, original/removed/remaining counts, removed extremes.

    The removed prices themselves are a long table (``price_outlier_rows``) so
    no market's list is gathered into one row.
    """
    b = broadcast_checked(bounds)
    p = F.col("price")
    kept = p.between(F.col("lower_bound"), F.col("upper_bound"))
    return df.join(b, keys, "inner").groupBy(*keys, "q1", "q3", "iqr", "lower_bound", "upper_bound").agg(
        F.count(F.lit(1)).alias("n_original"),
        F.count_if(~F.coalesce(kept, F.lit(False))).alias("n_removed"),
        F.count_if(F.coalesce(kept, F.lit(False))).alias("n_remaining"),
        F.count_if(p < F.col("lower_bound")).alias("n_removed_low"),
        F.count_if(p > F.col("upper_bound")).alias("n_removed_high"),
        F.max(F.when(p < F.col("lower_bound"), p)).alias("max_removed_low"),
        F.min(F.when(p > F.col("upper_bound"), p)).alias("min_removed_high"),
    )


def price_outlier_rows(df: DataFrame, bounds: DataFrame, keys: list[str] = ["city_slug"]) -> DataFrame:
    """Removed prices, sorted within side: (market, side, rank, price)."""
    b = broadcast_checked(bounds.select(*keys, "lower_bound", "upper_bound"))
    p = F.col("price")
    side = F.when(p < F.col("lower_bound"), F.lit("low")).when(p > F.col("upper_bound"), F.lit("high"))
    rows = df.join(b, keys, "inner").select(*keys, "row_id", p, side.alias("side")).filter(F.col("side").isNotNull())
    # one market's outliers may be many: positions by range partitions, not by one task per market
    ranked = ordinal_within(rows.withColumn("_group", F.concat_ws("\u0000", *keys, "side")), "_group", ["price", "row_id"])
    return ranked.select(*keys, "side", (F.col("pos") + 1).cast("int").alias("rank"), "price", "row_id")


# --------------------------------------------------------------------------- de-dup / append
def _norm_part(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))


def dedupe_key(df: DataFrame) -> Column:
    """``id:<id>`` when a listing id is present, else ``addr:`` + five normalised parts,
    else the formatted address when all parts are blank."""
    lid = F.trim(F.col("listing_id").cast("string"))
    parts = [_norm_part(c) if c in df.columns else F.lit("") for c in ("address", "address2", "city", "state", "zip")]
    all_blank = F.concat(*parts) == ""
    formatted = _norm_part("formatted_address") if "formatted_address" in df.columns else F.lit("")
    return (
        F.when(lid.isNotNull() & (lid != ""), F.concat(F.lit("id:"), F.lower(lid)))
        .when(all_blank, F.concat(F.lit("addr:"), formatted))
        .otherwise(F.concat(F.lit("addr:"), F.concat_ws("|", *parts)))
    )


def append_new_listings(existing: DataFrame, incoming: DataFrame, dedupe_within_batch: bool = False) -> DataFrame:
    """Existing rows plus incoming rows whose de-dup key is not already present.

    Anti-join on the key (hash/sort-merge as AQE decides; both sides shuffle on
    the key only). Duplicates inside ``incoming`` survive unless
    ``dedupe_within_batch`` is set, as in the reference.
    """
    keys = existing.select(dedupe_key(existing).alias("_k")).distinct()
    inc = incoming.withColumn("_k", dedupe_key(incoming))
    new_rows = inc.join(keys, "_k", "left_anti")
    if dedupe_within_batch:
        # min_by aggregates partially map-side, so a hot key is never gathered whole
        cols = [c for c in new_rows.columns if c != "_k"]
        new_rows = new_rows.groupBy("_k").agg(F.min_by(F.struct(*cols), F.col("row_id")).alias("_r")).select("_k", "_r.*")
    return existing.unionByName(new_rows.drop("_k"), allowMissingColumns=True)

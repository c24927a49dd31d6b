"""Summaries, data-quality tables and order-based splits (folds, time split)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import property_type_rank
from .common import broadcast_checked


# --------------------------------------------------------------------------- summaries
def property_types(df: DataFrame, keys: list[str] = ["city_slug"]) -> DataFrame:
    """Distinct property types per market with their display rank."""
    return df.filter(F.col("property_type").isNotNull()).select(*keys, "property_type").distinct() \
        .withColumn("type_rank", property_type_rank("property_type"))


def price_summary(df: DataFrame, keys: list[str] = ["city_slug"]) -> DataFrame:
    """Min, max, mean and count of price per market."""
    return df.filter(F.col("price").isNotNull()).groupBy(*keys).agg(
        F.min("price").alias("min_price"), F.max("price").alias("max_price"),
        F.avg("price").alias("mean_price"), F.count(F.lit(1)).alias("n_priced"))


def missing_share(df: DataFrame, columns: list[str], keys: list[str] = ["city_slug"]) -> DataFrame:
    """Share of missing values per column and market, long format (column, share)."""
    wide = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    stack = ", ".join(f"'{c}', `{c}`" for c in columns)
    return wide.select(*keys, "n_rows", F.expr(f"stack({len(columns)}, {stack}) as (column_name, missing_share)"))


def row_loss(raw: DataFrame, keys: list[str] = ["city_slug"]) -> DataFrame:
    """Rows surviving each cleaning step per market, in one pass: coordinates
    present, SqFt possible, price present, training-ready (all three)."""
    coords = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    sq = F.col("sqft").isNull() | F.col("sqft").between(K.SQFT_MIN_VALID, K.SQFT_MAX_VALID)
    priced = F.col("price").isNotNull()
    return raw.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.count_if(coords).alias("n_with_coords"),
        F.count_if(coords & sq).alias("n_sqft_ok"),
        F.count_if(coords & sq & priced).alias("n_training"),
    ).withColumn("pct_lost", F.round(F.lit(100.0) * (F.col("n_raw") - F.col("n_training")) / F.col("n_raw"), 4))


# --------------------------------------------------------------------------- ordinals
def ordinal_within(df: DataFrame, key: str, order: list[str], out: str = "pos") -> DataFrame:
    """0-based position of each row within its ``key`` group in ``order``
    (``order`` must end with a unique column such as ``row_id``).

    Skew-safe: rows are range-partitioned by (key, order), so one hot key spans
    many partitions, sorted and numbered in place, and checkpointed so the numbers
    are fixed; a small table of each partition's first number and size per key
    gives the offsets. No task ever holds a whole group and no row is joined back,
    so a repeated or NULL order value neither multiplies nor drops rows.
    """
    wide = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order) \
        .withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    pid = F.shiftright("_at", 33)
    counts = wide.groupBy(key, pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first"))
    offs = counts.withColumn("_off", F.coalesce(F.sum("_c").over(
        Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offs = broadcast_checked(offs.select(F.col(key).alias("_key"), "_pid", "_first", "_off"))
    return wide.join(offs, F.col(key).eqNullSafe(F.col("_key")) & (pid == F.col("_pid")), "inner") \
        .withColumn(out, (F.col("_off") + F.col("_at") - F.col("_first")).cast("long")).drop("_at", "_key", "_pid", "_first", "_off")


def with_row_id(df: DataFrame, order: list[str], out: str = "row_id") -> DataFrame:
    """A dense 0-based id in ``order`` over the whole table, as landed rows have none of their own."""
    return ordinal_within(df.withColumn("_all", F.lit(0)), "_all", order, out).drop("_all")


def group_sizes(df: DataFrame, key: str, out: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(out))


def contiguous_folds(df: DataFrame, key: str = "city_slug", order: list[str] = ["row_id"], k: int = K.CV_FOLDS) -> DataFrame:
    """Unshuffled k-fold blocks in row order per market; the first ``n % k``
    folds hold one extra row (the reference's KFold without shuffling)."""
    pos = ordinal_within(df, key, order)
    sizes = broadcast_checked(group_sizes(df, key))
    q = F.floor(F.col("n") / k)
    r = F.col("n") % k
    big = r * (q + 1)
    fold = F.when(F.col("pos") < big, F.floor(F.col("pos") / (q + 1))).otherwise(r + F.floor((F.col("pos") - big) / q))
    return pos.join(sizes, key, "inner").withColumn("fold", fold.cast("int")).drop("n")


def time_split(df: DataFrame, date_col: str = "listed_date", key: str = "city_slug",
               fraction: float = K.TIME_SPLIT_FRACTION, min_rows: int = K.MIN_ROWS_TIME_SPLIT) -> DataFrame:
    """Sort by date (row order breaks ties), first ``int(0.8 n)`` rows train, the
    rest validate; markets with fewer than ``min_rows`` dated rows are not split."""
    dated = df.filter(F.col(date_col).isNotNull())
    pos = ordinal_within(dated, key, [date_col, "row_id"])
    sizes = broadcast_checked(group_sizes(dated, key))
    cut = F.floor(F.col("n") * F.lit(fraction)).cast("long")
    return pos.join(sizes, key, "inner").withColumn(
        "split", F.when(F.col("n") < min_rows, F.lit(None)).when(F.col("pos") < cut, F.lit("train")).otherwise(F.lit("validate"))
    ).withColumn("cut_pos", cut)


# --------------------------------------------------------------------------- metrics
def regression_metrics(df: DataFrame, label: str, pred: str, keys: list[str] = ["city_slug"]) -> DataFrame:
    """RMSE, MAE, R^2 and log-RMSE (predictions floored at 0) in one pass."""
    y, p = F.col(label), F.col(pred)
    err = p - y
    logerr = F.log1p(y) - F.log1p(F.greatest(p, F.lit(0.0)))
    g = df.filter(y.isNotNull() & p.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.sum(err * err).alias("_sse"),
        (F.count(F.lit(1)) * F.var_pop(y)).alias("_sst"),
        F.sqrt(F.avg(logerr * logerr)).alias("rmse_log"),
    )
    # one row or one constant label has no variance to explain: NULL
    return g.withColumn("r2", F.lit(1.0) - F.try_divide("_sse", F.nullif(F.col("_sst"), F.lit(0.0)))).drop("_sse", "_sst")

"""Bad input: pages and lines that cannot be read are set aside with file and reason, counted, never lost.

Every function returns the readable rows and the rejected ones side by side; both come from one parse.
Market files are checked for their columns before the markets are united.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .listings import CSV_TO_SNAKE, PAGE_ARRAY, PAGE_OBJECT, flatten_items

#: columns without which a market's average rents cannot be formed
RENT_COLUMNS = ("Price", "Beds", "Property Type")
SNAKE = {v: k for k, v in CSV_TO_SNAKE.items()}


# --------------------------------------------------------------------------- pages
def _page_items(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*\["), F.from_json(text, PAGE_ARRAY)).otherwise(F.from_json(text, PAGE_OBJECT)["listings"])


def page_problem(text: Column) -> Column:
    """Why a page cannot be read, or NULL. An object without ``listings`` is an empty page and no problem."""
    value = F.try_parse_json(text)
    start = F.regexp_extract(text, r"^\s*(\S)", 1)
    listed = F.try_variant_get(value, "$.listings", "variant")
    shape = lambda v: F.schema_of_variant(v)
    items = F.try_variant_get(F.when(start == "[", value).otherwise(listed), "$", "array<variant>")
    odd = F.exists(items, lambda x: F.coalesce(~shape(x).startswith("OBJECT"), F.lit(True)))
    return (F.when(F.coalesce(start, F.lit("")) == "", "empty file")
            .when(value.isNull(), "not JSON")
            .when(~start.isin("[", "{"), "neither a list nor an object")
            .when((start == "{") & listed.isNotNull() & ~shape(listed).isin("VOID") & ~shape(listed).startswith("ARRAY"), "listings is not a list")
            .when(odd, "an item is not an object"))


def split_pages(pages: DataFrame, text_col: str = "page_json") -> tuple[DataFrame, DataFrame]:
    """(readable pages, rejected ones): the latter with ``reason`` and ``n_chars`` in place of nothing at all downstream."""
    marked = pages.withColumn("reason", page_problem(F.col(text_col)))
    return (marked.filter(F.col("reason").isNull()).drop("reason"),
            marked.filter(F.col("reason").isNotNull()).withColumn("n_chars", F.coalesce(F.length(text_col), F.lit(0)).cast("long")))


@dataclass(frozen=True)
class IngestResult:
    listings: DataFrame
    rejected: DataFrame
    audit: DataFrame


def ingest_pages(pages: DataFrame, markets: DataFrame, root: str, append_mode: bool = False) -> IngestResult:
    """Writes readable items to ``root/listings`` and rejected pages to ``root/rejected``, and returns both with an audit row
    per market and one for all (``city_slug`` NULL).

    The counts are observed by the writes themselves: no scan of the input or the output for them. The metrics are
    one set per configured market, and one for the rest.
    """
    spark = pages.sparkSession
    slugs = [r.city_slug for r in markets.select("city_slug").distinct().orderBy("city_slug").collect()]  # the market config
    seen, kept = Observation("pages"), Observation("listings")
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    of_page = {"pages": F.lit(True), "rejected": F.col("reason").isNotNull()}
    of_item = {"listings": F.lit(True), "located": located, "priced": F.col("price").isNotNull(), "usable": located & F.col("price").isNotNull()}

    def metrics(conditions: dict[str, Column]) -> list[Column]:
        return [F.count_if((F.col("city_slug") == s) & c if s is not None else c).alias(f"{name}:{k}")
                for k, s in enumerate([None, *slugs]) for name, c in conditions.items()]

    marked = pages.withColumn("reason", page_problem(F.col("page_json")))
    items = F.when(F.col("reason").isNull(), _page_items(F.col("page_json")))
    # one pass over the pages: rejected ones go along as a row without an item
    rows = marked.observe(seen, *metrics(of_page)).select(
        "city_slug", "page", "reason", F.when(F.col("reason").isNotNull(), F.col("page_json")).alias("page_json"),
        F.posexplode_outer(items).alias("item_pos", "item")).filter(F.col("reason").isNotNull() | F.col("item").isNotNull())
    path = root.rstrip("/") + "/landed"
    rows.write.mode("overwrite").parquet(path)
    landed = spark.read.parquet(path)
    listings = flatten_items(landed.filter(F.col("reason").isNull()).drop("reason", "page_json"), markets)
    listings.observe(kept, *metrics(of_item)).write.mode("overwrite").parquet(root.rstrip("/") + "/listings")
    landed.filter(F.col("reason").isNotNull()).select("city_slug", "page", "reason", "page_json") \
        .write.mode("overwrite").parquet(root.rstrip("/") + "/rejected")
    got = seen.get | kept.get
    audit = spark.createDataFrame(
        [(s, *(int(got[f"{name}:{k}"]) for name in (*of_page, *of_item)), append_mode) for k, s in enumerate([None, *slugs])],
        "city_slug string, " + ", ".join(f"{n} long" for n in (*of_page, *of_item)) + ", append_mode boolean")
    return IngestResult(spark.read.parquet(root.rstrip("/") + "/listings"), spark.read.parquet(root.rstrip("/") + "/rejected"),
                        audit.withColumn("fetch_date", F.current_timestamp()))


# --------------------------------------------------------------------------- files per market
def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """(city_slug, file, header) of listing files under ``city_slug=`` folders."""
    lines = spark.read.text(path, recursiveFileLookup=True).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return lines.filter(F.col("block") == 0).groupBy("file").agg(F.min_by("value", "at").alias("header")) \
        .withColumn("city_slug", F.regexp_extract("file", r"city_slug=([^/]+)", 1))


def market_columns(headers: DataFrame, required: tuple[str, ...] = RENT_COLUMNS) -> DataFrame:
    """(city_slug, missing): the required columns that some file of a market lacks; an empty list for a complete market."""
    names = F.transform(F.split(F.regexp_replace("header", "^﻿", ""), ","), lambda c: F.trim(c, F.lit('" ')))
    lacks = F.array_except(F.array(*map(F.lit, required)), names)
    return headers.groupBy("city_slug").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(lacks)))).alias("missing"))


def read_market_files(spark: SparkSession, path: str, required: tuple[str, ...] = RENT_COLUMNS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, ragged, report) of the listing files of all markets.

    A market with a file that lacks a required column is left out whole, as its table would be. A line with more or
    fewer fields than its header is no row: it goes to ``ragged`` as (city_slug, file, line). ``report``: city_slug, used,
    missing, n_rows, n_ragged per market.
    """
    headers = file_headers(spark, path).checkpoint()
    columns = market_columns(headers, required).withColumn("used", F.size("missing") == 0).checkpoint()
    layouts = headers.join(columns.filter("used"), "city_slug", "left_semi").groupBy("header").agg(F.collect_list("file").alias("files"))
    parts = []
    for row in sorted(layouts.collect(), key=lambda r: r.header):  # file names, one row per layout
        names = [c.strip('" ') for c in row.header.lstrip("﻿").rstrip("\r").split(",")]
        schema = ", ".join(f"`{c}` string" for c in names) + ", `_bad` string"
        df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE") \
            .option("columnNameOfCorruptRecord", "_bad").csv(sorted(row.files))
        file = F.col("_metadata.file_path")
        parts.append(df.select(*[(F.col(f"`{c}`") if c in names else F.lit(None).cast("string")).alias(s) for c, s in CSV_TO_SNAKE.items()],
                               F.col("_bad"), file.alias("file"), F.regexp_extract(file, r"city_slug=([^/]+)", 1).alias("city_slug")))
    fields = [*CSV_TO_SNAKE.values(), "_bad", "file", "city_slug"]
    every = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], ", ".join(f"{c} string" for c in fields))
    every = every.checkpoint()  # the marks of bad lines are only kept if all columns are read together
    counts = every.groupBy("city_slug").agg(F.count_if(F.col("_bad").isNull()).alias("n_rows"), F.count("_bad").alias("n_ragged"))
    zero = F.lit(0).cast("long")
    report = columns.join(counts, "city_slug", "left").select(
        "city_slug", "used", "missing", F.coalesce("n_rows", zero).alias("n_rows"), F.coalesce("n_ragged", zero).alias("n_ragged"))
    return (every.filter(F.col("_bad").isNull()).drop("_bad", "file"),
            every.filter(F.col("_bad").isNotNull()).select("city_slug", "file", F.col("_bad").alias("line")), report)


def checked_tables(tables: DataFrame, required: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """For stored tables that hold several markets: (rows of complete markets, report). A market counts as
    without a column if none of its rows has a value there."""
    has = tables.groupBy("city_slug").agg(*(F.count(c).alias(c) for c in required), F.count("*").alias("n_rows"))
    missing = F.array_compact(F.array(*(F.when(F.col(c) == 0, F.lit(c)) for c in required)))
    report = has.select("city_slug", "n_rows", missing.alias("missing"), (F.size(missing) == 0).alias("used"))
    return tables.join(report.filter("used"), "city_slug", "left_semi"), report

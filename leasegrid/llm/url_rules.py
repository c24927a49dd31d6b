"""URL filtering by a policy list and by association rules mined with Spark's FP-growth.

The policy list decides the urls that it fits. For the others, urls with a known verdict are
transactions of their tokens (scheme, host labels, path segments with digits masked, query keys)
and the verdict; FP-growth mines the combinations of all of them that enough rows hold, a fixed number at
every size of the table, and rules that conclude a verdict stay if their confidence suffices and no more
general rule is as confident.
The rules stay a table. Every rule is filed under its rarest item. A url's items meet that inverted index by a join, the
rules whose other items are all there are kept, and the most confident decides (ties: larger
support, more tokens, then allow before block). A url that no rule fits gets the default verdict.

Null urls and urls without ``://`` have an empty host and path and the default verdict; so has every
url if there are no labels. Equal urls are judged once. Repeated and null ids pass through; other
columns are not read; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small, stored

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct<verdict, rule>, or null. A rule is host + path prefix, such as
    ``net/``; it fits its host and all subdomains. The list is part of the plan, so meant to be short;
    of equally long ones the first in the alphabet wins."""
    fit = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        domain, slash, prefix = rule.partition("/")
        if not domain:
            raise ValueError(f"a rule needs a host: {rule!r}")
        hit = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + prefix)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        fit = F.when(hit, value) if fit is None else fit.when(hit, value)
    return fit if fit is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def tokens(url: Column) -> Column:
    """Distinct tokens of a url; none for a null url or one without ``://``."""
    host, path = host_and_path(url)
    mask = lambda c: F.regexp_replace(c, "[0-9]+", "#")
    tagged = lambda tag, parts: F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(tag), mask(p)))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))
    every = F.concat(
        F.array(F.concat(F.lit("s:"), F.lower(F.substring_index(url, "://", 1)))),
        tagged("h:", F.split(host, r"\.")), tagged("p:", F.split(path, "/")), tagged("q:", keys),
        F.when(F.contains(url, F.lit("#")), F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>")))
    return F.when(F.instr(url, "://") > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


RULE = "items array<string>, token string, verdict string, confidence double, support long"


@dataclass
class Rules:
    """Mined rules as tables. ``rules`` (items, token, verdict, confidence, support): items in order, ``token`` the rarest of
    them; ``members`` (token, item): the tokens of a url that stand for an item."""

    rules: DataFrame
    members: DataFrame


def mine(urls: DataFrame, min_count: int = 5, min_confidence: float = 0.8, common: float = 0.9) -> Rules:
    """Rules mined from all rows (url, verdict), as tables: nothing of them passes the driver.

    A rule needs ``min_count`` rows, however many there are, and has any number of tokens. Tokens of more than
    a share ``common`` of the urls separate nothing and are left out. Two prunings bound the work and lose no
    rule: a token whose urls all have one verdict is a rule that no longer one is better than, so it is not
    combined; tokens that occur in the same urls are one item, which any of them stands for. Of the
    rest a rule stays unless a more general one is as confident, which is settled level by level.
    """
    known = urls.where(F.col("verdict").isin(ALLOW, BLOCK)).select("verdict", tokens(F.col("url")).alias("tokens"))
    known = stored(known.withColumn("row", F.monotonically_increasing_id()), "urls")
    n = known.count()
    posted = known.select("row", "verdict", F.explode("tokens").alias("token"))
    held = stored(posted.groupBy("token").agg(
        F.count("*").alias("n"), F.count_if(F.col("verdict") == ALLOW).alias("allow"),
        F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
        .where((F.col("n") >= min_count) & (F.col("n") <= common * n)), "tokens")
    pure = held.where("allow = 0 or allow = n")
    mixed = held.where("allow > 0 and allow < n")
    items = mixed.groupBy("n", "x", "y").agg(F.min("token").alias("item"))
    members = stored(mixed.join(items, ["n", "x", "y"]).select("token", "item", "n")
                     .unionByName(pure.select("token", F.col("token").alias("item"), "n")), "members")
    out = pure.select(F.array("token").alias("items"), F.when(F.col("allow") == 0, BLOCK).otherwise(ALLOW).alias("verdict"),
                      F.lit(1.0).alias("confidence"), F.col("n").alias("support"))
    names = mixed.join(items, ["n", "x", "y"]).where("token = item").select("token")
    basket = stored(posted.join(small(stored(names, "names")), "token").groupBy("row", "verdict").agg(F.collect_list("token").alias("items"))
                    .select(F.concat("items", F.array(F.concat(F.lit("="), "verdict"))).alias("items")), "baskets")
    m = basket.count()
    if m:
        # half a row less, so that rounding does not ask for one more
        model = FPGrowth(itemsCol="items", minSupport=(min_count - 0.5) / m, minConfidence=1.0).fit(basket)
        sets = stored(model.freqItemsets.select(
            F.sort_array(F.filter("items", lambda t: ~t.startswith("="))).alias("items"),
            F.substring(F.get(F.filter("items", lambda t: t.startswith("=")), F.lit(0)), 2, 9).alias("verdict"), F.col("freq").alias("support")), "sets")
        out = out.unionByName(_surest(sets, min_confidence))
    rarest = (out.withColumn("rule", F.struct("items", "verdict")).select("*", F.explode("items").alias("item"))
              .join(members.select("item", "n").distinct(), "item").groupBy("rule", "confidence", "support")
              .agg(F.min_by("item", F.struct("n", "item")).alias("token")))
    rules = stored(rarest.select("rule.items", "token", "rule.verdict", "confidence", "support"), "rules")
    return Rules(rules, members.select("token", "item"))


def _surest(sets: DataFrame, min_confidence: float) -> DataFrame:
    """(items, verdict, confidence, support) of the rules that suffice and that no more general one equals.

    ``sets`` are frequent sets of items, with and without a verdict. The best confidence of the rules within a set is
    handed on from each level to the next: all parts of a frequent set are frequent, so none is missed."""
    alone = sets.where("verdict is null").select("items", F.col("support").alias("n"))
    found = stored(sets.where("verdict is not null and size(items) > 0").join(alone, "items")
                   .select("items", "verdict", (F.col("support") / F.col("n")).alias("confidence"), "support")
                   .where(F.col("confidence") >= min_confidence), "found")
    longest = alone.agg(F.max(F.size("items"))).first()[0] or 0
    kept, best = [], None
    for level in range(1, longest + 1):
        own = found.where(F.size("items") == level)
        if best is None:
            below = own.select("items", "verdict", F.lit(-1.0).alias("best"))
        else:
            parts = alone.where(F.size("items") == level).select(
                "items", F.explode(F.transform("items", lambda t: F.array_remove("items", t))).alias("part"))
            below = parts.join(best.withColumnRenamed("items", "part"), "part").groupBy("items", "verdict").agg(F.max("best").alias("best"))
        both = stored(below.join(own, ["items", "verdict"], "full"), "level")
        kept.append(both.where("confidence is not null and (best is null or best < confidence)").select("items", "verdict", "confidence", "support"))
        best = both.select("items", "verdict", F.greatest("best", "confidence").alias("best"))
    return reduce(DataFrame.unionByName, kept) if kept else found


def matched(urls: DataFrame, mined: Rules) -> DataFrame:
    """(url, verdict) of the distinct urls that a mined rule fits, by an inverted index over the rules' rarest items."""
    posted = urls.select("url").distinct().withColumn("token", F.explode(tokens(F.col("url"))))
    held = posted.join(small(mined.members), "token").groupBy("url").agg(F.collect_set("item").alias("held"))
    index = small(mined.rules, 20_000)
    fits = held.withColumn("token", F.explode("held")).join(index, "token").where(F.size(F.array_except("items", "held")) == 0)
    rank = F.struct("confidence", "support", F.size("items").alias("size"), (F.col("verdict") == ALLOW).alias("allow"))
    return fits.groupBy("url").agg(F.max_by("verdict", rank).alias("mined"))


def judge(pages: DataFrame, labels: DataFrame, policy: list[tuple[str, str]], default: str = ALLOW,
          id_col: str = "page_id", url_col: str = "url", **mining) -> DataFrame:
    """(page_id, url, host, path, rule, verdict) of every page.

    ``labels`` (id, verdict) are known verdicts of pages; the policy list's verdict goes before them.
    """
    url = F.col("url")
    host, path = host_and_path(url)
    rows = (pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
            .withColumn("host", host).withColumn("path", path).withColumn("listed", listed(F.col("host"), F.col("path"), policy)))
    known = labels.select(F.col("id").alias("page_id"), F.col("verdict").alias("known")).where("page_id is not null").distinct()
    train = rows.join(known, "page_id", "left").select("url", F.coalesce(F.col("listed")["verdict"], "known").alias("verdict"))
    mined = mine(train.where("url is not null and verdict is not null"), **mining)
    rows = rows.join(matched(rows.where("listed is null and url is not null"), mined), "url", "left")
    return rows.select("page_id", "url", "host", "path", F.col("listed")["rule"].alias("rule"),
                       F.coalesce(F.col("listed")["verdict"], "mined", F.lit(default)).alias("verdict"))

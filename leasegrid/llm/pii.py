"""Personal data by candidate gradient boosting, in DataFrame and SQL functions only.

Base spans are the leftmost non-overlapping matches of four patterns that pass their checks; they
always stay. Broader generators propose further, overlapping spans (spelled-out addresses, other
separators, numbers without a plus sign). Spark's gradient-boosted trees, fitted on all
documents, whose base matches serve as labels (passing ones 1, failing ones and bare digit
runs 0), score a proposal by its format and its context; the features leave out what defines the
labels of phones, so they carry over to other notations. Trees come from all texts; thresholds are set
for each kind at the wanted precision, on all texts, each half scored by trees of the other. The trees run as nested SQL conditions inside the
scan: no row is exploded, shuffled or leaves the JVM.

Spans are (start, kind, end) in code points, end exclusive. Added spans that overlap a base span are
dropped, as are those that overlap a likelier added one (ties: the earlier kind). Null and empty
texts have no spans. Without two labels nothing is added. Whole texts are searched,
each from its start to its end once per pattern. Rows are independent: repeated and null ids pass
through; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(4)

# Base patterns. Possessive repeats and look-behinds give the same leftmost matches as the plain
# forms and keep long runs linear and free of recursion.
LOCAL = r"A-Za-z0-9._%+\-"
BASE = {
    EMAIL: rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    IP: r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    CARD: r"[0-9](?:[\x20\-]?[0-9])++",
    PHONE: r"\+[0-9][\x20().0-9\-]+[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

_AT = r"(?:@|\x20?[(\[{]\x20?at\x20?[)\]}]\x20?|\x20at\x20)"
_DOT = r"(?:\.|\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\x20dot\x20)"
#: generator patterns, with a cheap test that must hold first
PROPOSE = {
    "email": (rf"(?i)(?:\G|(?<![{LOCAL}]))[{LOCAL}]++{_AT}[A-Z0-9\-]++(?:{_DOT}[A-Z0-9\-]++)++", r"(?i)[(\[{\x20]dot[)\]}\x20]|@"),
    "ip": (r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\x20?\[?\.\]?\x20?[0-9]{1,3}){3}(?![0-9A-Za-z])", r"[0-9]"),
    "number": (r"(?<![0-9A-Za-z+.])\+?\(?[0-9](?:[\x20./()\-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])", r"[0-9]"),
}
# Words that announce personal data, or other numbers.
CUES = r"(?i)\b(?:e-?mail|mail|contact|tel|phone|call|fax|mobile|cell|ip|host|server|client|card|visa|mastercard|amex|credit|pay)\b"
OTHER = r"(?i)\b(?:version|release|ver|order|invoice|isbn|issn|doi|key|token|sha|hash|commit|section|chapter|page|figure|table)\b|[=\"#]\s*$"
CONTEXT = 24
#: array elements gone through at once where a running value is needed
CHUNK = 64
#: code points of a text's segments, in which places are looked up when spans are cut out
SEGMENT = 4096

FEATURES = ["is_email", "is_ip", "is_card", "is_phone", "digits", "seps", "luhn", "octets", "paren", "size", "groups",
            "longest", "cue", "other", "glued", "spelled"]


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: lambdas evaluate an outer expression at every use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine) -> Column:
    """For each of an array's whole numbers ``combine`` of 0 and all before it. Appending to an array copies it, so the
    array is gone through in chunks and the chunks' results likewise: n * CHUNK + (n / CHUNK)^2 copies."""

    def scan(items: Column, value) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, zero, lambda acc, x: F.struct(
            combine(acc["at"], value(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def joined(parts: Column) -> Column:
        heads = scan(parts, lambda p: p["at"])["out"]
        return F.flatten(F.zip_with(parts, heads, lambda p, h: F.transform(p["out"], lambda v: combine(h, v))))

    def chunks(every: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(every) - 1) / CHUNK).cast("int"))
        return F.transform(F.sequence(F.lit(0), last), lambda c: scan(F.slice(every, c * CHUNK + 1, F.lit(CHUNK)), lambda x: x))

    return _bound(values, lambda every: _bound(chunks(every), joined))


def matches(text: Column, pattern: str, need: str, context: bool = False) -> Column:
    """array<struct<s, e, m>>: all leftmost non-overlapping matches with their places in code points; with ``context``
    also b, up to CONTEXT characters before the match, but none before the match that precedes it."""

    def before(z: Column, i: Column) -> list[Column]:
        if not context:
            return []
        last = F.when(i > 0, F.get(z["m"], i - 1)).otherwise(F.lit(""))
        return [F.right(F.concat(last, F.get(z["p"], i)), F.lit(CONTEXT)).alias("b")]

    def placed(z: Column) -> Column:
        found = F.transform(z["m"], lambda m, i: F.struct(F.length(F.get(z["p"], i)).alias("gap"), F.length(m).alias("n"), m.alias("m"), *before(z, i)))
        return _bound(found, lambda every: F.zip_with(
            every, running(F.transform(every, lambda x: x["gap"] + x["n"]), lambda a, b: a + b),
            lambda x, at: F.struct((at + x["gap"]).alias("s"), (at + x["gap"] + x["n"]).alias("e"), x["m"].alias("m"), *([x["b"].alias("b")] if context else []))))

    kind = "array<struct<s:int,e:int,m:string,b:string>>" if context else "array<struct<s:int,e:int,m:string>>"
    pieces = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return F.when(text.rlike(need), _bound(pieces, placed)).otherwise(F.array().cast(kind))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def term(c: Column, i: Column) -> Column:
        d = c.cast("int") * (1 + i % 2)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), term), F.lit(0), lambda a, b: a + b) % 10 == 0


def base_spans(text: Column) -> Column:
    """array<struct<s, k, e>> of the base spans, by start and kind."""

    def passing(k: int, need: str, ok) -> Column:
        found = matches(text, BASE[k], need)
        return F.transform(F.filter(found, lambda x: ok(x["m"])) if ok else found,
                           lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))

    return F.array_sort(F.concat(
        passing(EMAIL, "@", None),
        passing(IP, r"[0-9]\.[0-9]", lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        passing(CARD, "[0-9]", lambda m: F.length(_digits(m)).between(12, 19) & luhn(_digits(m))),
        passing(PHONE, r"\+[0-9]", lambda m: F.length(_digits(m)).between(9, 15)),
    ))


def proposals(text: Column) -> Column:
    """array<struct<s, k, e, ..features>>: all generators' spans; a number is proposed as card and as phone."""
    email, ip, number = (matches(text, *PROPOSE[g], context=True) for g in ("email", "ip", "number"))

    def of(found: Column, k: int) -> Column:
        return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["m"].alias("m"), x["b"].alias("b")))

    numbers = _bound(number, lambda n: F.concat(
        of(F.filter(n, lambda x: F.length(_digits(x["m"])).between(12, 19)), CARD),
        of(F.filter(n, lambda x: F.length(_digits(x["m"])).between(7, 15)), PHONE)))
    every = F.concat(of(email, EMAIL), of(ip, IP), numbers)

    def features(x: Column) -> Column:
        m, k, before = x["m"], x["k"], x["b"]
        digits = _digits(m)
        runs = F.split(F.regexp_replace(m, "[^0-9]+", " "), " ")
        plain = F.regexp_replace(m, r"[^0-9.]", "")
        num = lambda c: c.cast("double")
        return F.struct(
            x["s"].alias("s"), k.alias("k"), x["e"].alias("e"), m.alias("m"),
            *(num(k == F.lit(i)).alias(f"is_{name}") for i, name in enumerate(KINDS)),
            num(F.length(digits)).alias("digits"),
            num(F.length(F.regexp_replace(F.regexp_replace(m, r"^\+", ""), "[0-9A-Za-z]", ""))).alias("seps"),
            num(F.length(digits).between(12, 19) & luhn(F.when(F.length(digits) == 0, "1").otherwise(digits))).alias("luhn"),
            num(plain.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")).alias("octets"),
            num(F.contains(m, F.lit("("))).alias("paren"),
            num(F.length(F.regexp_replace(m, r"^\+", ""))).alias("size"),
            num(F.size(runs)).alias("groups"),
            num(F.array_max(F.transform(runs, F.length))).alias("longest"),
            num(before.rlike(CUES)).alias("cue"),
            num(before.rlike(OTHER)).alias("other"),
            num(before.rlike(r"[0-9A-Za-z/_]$")).alias("glued"),
            num(m.rlike(r"(?i)\b(?:at|dot)\b")).alias("spelled"),
        )

    return F.transform(every, features)


def _label(k: Column, m: Column, is_base: Column) -> Column:
    """1 for passing base matches; 0 for failing ones and for bare digits taken as a phone; else null."""
    shaped = F.lit(False)
    for i, p in BASE.items():
        shaped = shaped | ((k == i) & m.rlike(f"^(?:{p})$"))
    return F.when(is_base, 1.0).when(shaped | ((k == PHONE) & m.rlike("^[0-9]+$")), 0.0)


@dataclass
class Model:
    """Trees as nested tuples (feature, threshold, left, right) or leaf values, with their weights."""

    trees: list[tuple[float, tuple | float]]
    thresholds: list[float]

    def probability(self, x: Column) -> Column:
        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            f, at, left, right = node
            return F.when(x[FEATURES[f]] <= F.lit(float(at)), walk(left)).otherwise(walk(right))

        margin = F.lit(0.0)
        for weight, tree in self.trees:
            margin = margin + F.lit(float(weight)) * walk(tree)
        return 1 / (1 + F.exp(-2 * margin))


def _tree(node) -> tuple | float:
    if node.subtreeDepth() == 0:
        return node.prediction()
    split = node.split()
    return split.featureIndex(), split.threshold(), _tree(node.leftChild()), _tree(node.rightChild())


def examples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(half, k, y, features, n): the labelled proposals of all texts, a repeated text once. Equal ones are one row with
    their number ``n``, so that the trees' passes read format kinds rather than proposals."""
    text = F.col("text")
    drawn = (docs.select(F.col(text_col).alias("text")).where(text.rlike("[0-9@]")).distinct()
             .select(F.monotonically_increasing_id().alias("row"), base_spans(text).alias("base"), proposals(text).alias("found"),
                     F.pmod(F.xxhash64("text", F.lit(7)), F.lit(2)).alias("half")))
    drawn = stored(drawn, "pii-drawn")
    place = F.struct("row", F.col("x")["s"], F.col("x")["k"], F.col("x")["e"]).alias("place")
    base = drawn.select("row", F.explode("base").alias("x")).select(place, F.lit(True).alias("is_base"))
    rows = drawn.select("row", "half", F.explode("found").alias("x")).withColumn("place", place).join(base, "place", "left").select(
        "half", *(F.col("x")[f].alias(f) for f in FEATURES), F.col("x")["k"].alias("k"),
        _label(F.col("x")["k"], F.col("x")["m"], F.coalesce("is_base", F.lit(False))).alias("y"),
    ).where("y is not null")
    return stored(rows.groupBy("half", "k", "y", *FEATURES).agg(F.count("*").cast("double").alias("n")), "pii-examples")


def learn(docs: DataFrame, rounds: int = 12, depth: int = 3, precision: float = 0.95, text_col: str = "text") -> Model:
    """Trees from the proposals of all texts. Thresholds from all texts too, each half of them, by a hash of the text,
    scored by trees of the other half; a half whose other half holds one label only has no say in them."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(examples(docs, text_col))
    labels = {(r["half"], r["y"]) for r in rows.select("half", "y").distinct().collect()}
    if len({y for _, y in labels}) < 2:
        return Model([], [2.0] * len(KINDS))

    def trees(train: DataFrame) -> list:
        # Spark takes its split points from a sample where there are more rows than 10,000 and than maxBins squared
        kinds = train.count()
        bins = 32 if kinds <= 10_000 else math.isqrt(kinds) + 1
        gbt = GBTClassifier(labelCol="y", weightCol="n", maxIter=rounds, maxDepth=depth, maxBins=bins, seed=11, stepSize=0.3,
                            featureSubsetStrategy="all").fit(train)
        return [(w, _tree(t._java_obj.rootNode())) for w, t in zip(gbt.treeWeights, gbt.trees, strict=True)]

    model = Model(trees(rows), [2.0] * len(KINDS))
    # for each kind the lowest level at which the likelier proposals reach the precision, moved half way to the
    # next lower one: what lies between is nearer to one side
    scored = []
    for half in (0, 1):
        if {(1 - half, 0.0), (1 - half, 1.0)} <= labels:
            other = Model(trees(rows.where(F.col("half") == 1 - half)), [])
            scored.append(rows.where(F.col("half") == half).select("k", "y", "n", F.round(other.probability(F.struct(*FEATURES)), 3).alias("p")))
    if not scored:
        return model
    levels = reduce(DataFrame.unionAll, scored).groupBy("k", "p").agg(F.sum(F.col("y") * F.col("n")).alias("hits"), F.sum("n").alias("n")) \
        .orderBy("k", F.desc("p")).collect()
    for k in range(len(KINDS)):
        hits = n = 0
        own = [r for r in levels if r["k"] == k]
        for r, lower in zip(own, [*(r["p"] for r in own[1:]), 0.0][:len(own)], strict=True):
            hits, n = hits + r["hits"], n + r["n"]
            if hits >= precision * n:
                model.thresholds[k] = max(0.5, (r["p"] + lower) / 2)
    return model


def with_spans(docs: DataFrame, model: Model, text_col: str = "text", base: str = "pii_base", added: str = "pii_added") -> DataFrame:
    """``docs`` with two more columns: base and added spans as array<struct<s, k, e>>, in order."""
    text, taken = F.coalesce(F.col(text_col), F.lit("")), f"{added}_taken"
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    rows = docs.withColumn(base, F.when(text.rlike("[0-9@]"), base_spans(text)).otherwise(none))
    if not model.trees:
        return rows.withColumn(added, none)
    scored = F.transform(proposals(text), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), model.probability(x).alias("p")))
    levels = F.array(*(F.lit(t) for t in model.thresholds))
    likely = F.filter(scored, lambda x: x["p"] >= F.element_at(levels, x["k"] + 1))
    rows = rows.withColumn(taken, F.when(text.rlike(r"(?i)[0-9@]|[(\[{\x20]dot[)\]}\x20]"), likely)
                           .otherwise(F.array().cast("array<struct<s:int,k:int,e:int,p:double>>")))
    return rows.withColumn(added, F.when(F.size(taken) == 0, none).otherwise(_chosen(F.col(base), F.col(taken)))).drop(taken)


def _chosen(base: Column, taken: Column) -> Column:
    """The spans of ``taken`` that overlap no base span and no likelier one. Spans are compared within chains of
    overlapping spans only; a chain is long only where one span covers many."""
    overlap = lambda a, b: (a["s"] < b["e"]) & (b["s"] < a["e"])
    before = lambda o, x: (o["p"] > x["p"]) | ((o["p"] == x["p"]) & ((o["k"] < x["k"]) | ((o["k"] == x["k"]) & (o["s"] < x["s"]))))
    sure = F.transform(base, lambda b: F.struct(b["s"].alias("s"), b["k"].alias("k"), b["e"].alias("e"), F.lit(2.0).alias("p")))

    def chains(every: Column) -> Column:
        ends = running(F.transform(every, lambda x: x["e"]), lambda a, b: F.greatest(a, b))
        first = F.filter(F.zip_with(F.sequence(F.lit(0), F.size(every) - 1), F.zip_with(every, ends, lambda x, end: x["s"] >= end),
                                    lambda i, new: F.when(new, i)), lambda i: i.isNotNull())
        return _bound(first, lambda at: F.transform(at, lambda i, n: F.slice(
            every, i + 1, F.coalesce(F.get(at, n + 1), F.size(every)) - i)))

    def kept(chain: Column) -> Column:
        free = F.filter(chain, lambda x: (x["p"] < 2.0) & ~F.exists(chain, lambda b: (b["p"] == 2.0) & overlap(b, x)))
        return _bound(free, lambda own: F.filter(own, lambda x: ~F.exists(own, lambda o: overlap(o, x) & before(o, x))))

    best = F.flatten(F.transform(_bound(F.array_sort(F.concat(sure, taken)), chains), kept))
    return F.array_sort(F.transform(best, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))


def find_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_spans(rows, model, "text", "base", "added").select("doc_id", "base", "added")


def spans_text(spans: Column) -> Column:
    """kind:start:end of the spans by start and kind, comma-joined."""
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(name, x["k"] + 1), x["s"], x["e"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    name = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def whole(z: Column) -> Column:
        spans, parts, size = z["spans"], z["parts"], F.length(text)

        def cut(start: Column, end: Column) -> Column:
            """The text from start to end, by way of the segments that hold them, as substring counts from the beginning."""
            a, b = F.floor(start / SEGMENT).cast("int"), F.floor(end / SEGMENT).cast("int")
            at = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
            return F.when(a == b, F.substring(at(a), start % SEGMENT + 1, end - start)).otherwise(F.concat(
                F.substring(at(a), start % SEGMENT + 1, F.lit(SEGMENT)), F.array_join(F.slice(parts, a + 2, b - a - 1), ""),
                F.substring(at(b), F.lit(1), end % SEGMENT)))

        done = running(F.transform(spans, lambda x: x["e"]), lambda a, b: F.greatest(a, b))
        pieces = F.zip_with(spans, done, lambda x, at: F.when(
            x["s"] >= at, F.concat(cut(at, x["s"]), F.element_at(name, x["k"] + 1))).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), cut(F.array_max(F.transform(spans, lambda x: x["e"])), size))

    bound = F.struct(F.array_sort(spans).alias("spans"), F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{SEGMENT}}}"), F.lit(0)).alias("parts"))
    return F.when(F.size(spans) == 0, text).otherwise(_bound(bound, whole))

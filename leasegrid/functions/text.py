"""Text and coercion column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import PROPERTY_TYPE_ALIASES, PROPERTY_TYPE_CANONICAL, PROPERTY_TYPE_ORDER, UNKNOWN_TYPE_RANK

MISSING_MARKERS = ("N/A", "")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_if_marker(col) -> Column:
    """``"N/A"`` and ``""`` mean missing (the raw feed's placeholders)."""
    c = _c(col)
    return F.when(c.cast("string").isin(*MISSING_MARKERS), F.lit(None)).otherwise(c)


def to_double(col) -> Column:
    """Lenient numeric coercion: bad text -> NULL, and NaN -> NULL too."""
    parsed = _c(col).cast("string").try_cast("double")
    return F.nanvl(parsed, F.lit(None).cast("double"))


def clean_money(col) -> Column:
    """Currency text such as ``$1,234.50`` -> double; blanks and junk -> NULL."""
    return to_double(F.regexp_replace(_c(col).cast("string"), r"[$,]", ""))


def first_truthy(*cols) -> Column:
    """First value that is neither NULL, empty text, nor zero (Python ``a or b``)."""
    cleaned = [F.when((_c(c).cast("string") == "") | (_c(c).cast("string") == "0"), F.lit(None)).otherwise(_c(c).cast("string")) for c in cols]
    return F.coalesce(*cleaned)


def normalize_property_type(col) -> Column:
    """Trim, map known spellings to canonical names, keep unknown text trimmed, blank -> NULL."""
    trimmed = F.trim(_c(col).cast("string"))
    mapping = F.create_map(*[F.lit(x) for x in chain.from_iterable(PROPERTY_TYPE_CANONICAL.items())])
    return F.when(trimmed == "", F.lit(None)).otherwise(F.coalesce(mapping[F.lower(trimmed)], trimmed))


def alias_request_type(col) -> Column:
    """Case-sensitive request aliases (``Multi Family`` -> ``Multi-Family``) after trimming."""
    trimmed = F.trim(_c(col))
    out = trimmed
    for src, dst in PROPERTY_TYPE_ALIASES.items():
        out = F.when(trimmed == src, F.lit(dst)).otherwise(out)
    return out


def property_type_rank(col) -> Column:
    """Position in the display order, unknown types last (999)."""
    arr = F.array(*[F.lit(x) for x in PROPERTY_TYPE_ORDER])
    pos = F.array_position(arr, _c(col))
    return F.when(pos == 0, F.lit(UNKNOWN_TYPE_RANK)).otherwise(pos - 1).cast("int")


def format_beds(col) -> Column:
    """Integer text for whole bed counts, otherwise the shortest decimal text."""
    b = _c(col)
    whole = F.abs(b - F.round(b)) < F.lit(1e-6)
    return (
        F.when(b.isNull(), F.lit(None))
        .when(whole, F.round(b).cast("long").cast("string"))
        .otherwise(F.regexp_replace(F.format_string("%.6g", b), r"\.?0+$", ""))
    )


def money_text(col) -> Column:
    """``$1,235`` (half-even rounding) or ``N/A`` when missing."""
    c = _c(col)
    return F.coalesce(F.concat(F.lit("$"), F.format_number(F.bround(c, 0), 0)), F.lit("N/A"))


def join_features(col) -> Column:
    """Array of feature strings -> ``", "``-joined text, empty -> NULL."""
    txt = F.concat_ws(", ", _c(col))
    return F.when(txt == "", F.lit(None)).otherwise(txt)


def city_label(display_name, state) -> Column:
    return F.concat(_c(display_name), F.lit(", "), _c(state))


def slug_title(col) -> Column:
    return F.initcap(F.regexp_replace(_c(col), "_", " "))

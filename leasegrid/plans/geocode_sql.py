"""DuckDB SQL of the address spellings and of geocoding by the gazetteer (CTEs over ``raw_requests`` and ``listings``)."""

from __future__ import annotations

from ..operators import geocode as gc


def _sq(text: str) -> str:
    return text.replace("'", "''")


def _squash_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _nonempty_sql(x: str) -> str:
    return f"nullif({x}, '')"


def _variants() -> str:
    a = "address"
    exp = a
    for p, r in gc.ABBREVIATIONS:
        exp = f"regexp_replace({exp}, '{_sq(p)}', '{r}', 'gi')"
    def states(x):
        for p, r in gc.STATE_NAMES:
            x = f"regexp_replace({x}, '{_sq(p)}', '{r}', 'gi')"
        return x
    st = states(a)
    both = states("_exp")
    nz = f"rtrim(trim(regexp_replace({a}, '{_sq(gc.ZIP_PATTERN)}', '', 'g')), ',')"
    suffixes = "[" + ", ".join(f"'{s}'" for s in gc.STREET_SUFFIXES) + "]"
    toks = f"string_split_regex(trim(regexp_replace({a}, '[.,]', '', 'g')), '\\s+')"
    cp = _sq(gc.COMMA_PATTERN)
    scp = _sq(gc.STATE_COMMA_PATTERN)
    pattern_form = (f"CASE WHEN regexp_matches(x, '{cp}', 'i') THEN "
                    + _nonempty_sql(_squash_sql(f"regexp_extract(x, '{cp}', 1, 'i') || ', ' || regexp_extract(x, '{cp}', 2, 'i') || ', ' || regexp_extract(x, '{cp}', 3, 'i')"))
                    + " END")
    state_form = (f"CASE WHEN regexp_replace(x, '{scp}', ', \\1', 'gi') <> x THEN "
                  + _nonempty_sql(_squash_sql(f"regexp_replace(x, '{scp}', ', \\1', 'gi')")) + " END")
    tail = (f"[{_nonempty_sql(_squash_sql(f'regexp_replace({a}, {chr(39)}[.,]{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})'))}, "
            f"{_squash_sql(f'regexp_replace({a}, {chr(39)}{_sq(gc.SUFFIX_PATTERN)}{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}gi{chr(39)})')}]")
    return f"""
v0 AS (SELECT request_id, {a}, {exp} AS _exp, {toks} AS _tok FROM raw_requests),
v1 AS (SELECT *, list_filter(range(3, len(_tok)), lambda i: list_contains({suffixes}, lower(_tok[i + 1])))[1] AS _idx FROM v0),
v2 AS (SELECT *, CASE WHEN _idx IS NULL THEN NULL ELSE
                   array_to_string(list_concat(_tok[1:_idx - 2], [_tok[_idx - 1] || _tok[_idx]], _tok[_idx + 1:]), ' ') END AS _merged
       FROM v1),
v3 AS (SELECT request_id, {a}, list_filter([{a}, {_nonempty_sql(_squash_sql('_merged'))},
                  CASE WHEN _exp <> {a} THEN _exp END, CASE WHEN {st} <> {a} THEN {st} END,
                  {both}, CASE WHEN {nz} <> {a} THEN {nz} END], lambda x: x IS NOT NULL) AS _h FROM v2),
v4 AS (SELECT request_id, {a}, list_filter(_h, lambda x, i: list_position(_h, x) = i) AS _snap FROM v3),
v5 AS (SELECT request_id, list_filter(list_concat(_snap,
                  flatten(list_transform(_snap, lambda x: CASE WHEN contains(x, ',') THEN []::VARCHAR[]
                                                         ELSE [{pattern_form}, {state_form}] END)),
                  {tail}), lambda x: x IS NOT NULL) AS _all FROM v4),
v6 AS (SELECT request_id, list_filter(_all, lambda x, i: list_position(_all, x) = i) AS v FROM v5),
variants AS (SELECT request_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos, unnest(v) AS variant FROM v6)"""


def _geocoded() -> str:
    exp = "address"
    for p, r in gc.ABBREVIATIONS:
        exp = f"regexp_replace({exp}, '{_sq(p)}', '{r}', 'gi')"
    return f"""
gaz AS (SELECT lower({_squash_sql(exp)}) AS k, arg_min(latitude, row_id) AS g_lat, arg_min(longitude, row_id) AS g_lon
        FROM listings WHERE address IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1),
hits AS (SELECT t.request_id, arg_min(g.g_lat, t.pos) AS g_lat, arg_min(g.g_lon, t.pos) AS g_lon
         FROM (SELECT request_id, pos, lower({_squash_sql('variant')}) AS k FROM variants) t JOIN gaz g USING (k)
         GROUP BY t.request_id),
geo_requests AS (
  SELECT r.request_id, r.address, COALESCE(r.latitude, h.g_lat) AS latitude, COALESCE(r.longitude, h.g_lon) AS longitude,
         h.request_id IS NOT NULL AND (r.latitude IS NULL OR r.longitude IS NULL) AS geocoded
  FROM raw_requests r LEFT JOIN hits h USING (request_id))"""


SQL_VARIANTS = _variants().strip()
#: ``geo_requests``: every request, its missing coordinates filled from the first spelling that the gazetteer holds
SQL_GEOCODED = SQL_VARIANTS + ",\n" + _geocoded().strip()

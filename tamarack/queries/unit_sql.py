"""A DuckDB statement of problem 3 that decides by patterns of its own rather than by the unit graph."""

#: One row per field that holds a number: row_id, col, v (text without decoration), hint (name, then description), quantity, x (number).
FIELDS = r"""
raw AS (SELECT row_id, source_table, fields_json, unnest(json_keys(fields_json)) AS col FROM extracted_record WHERE fields_json IS NOT NULL AND json_valid(fields_json)),
cell AS (SELECT row_id, source_table, col, json_extract_string(fields_json, '$."' || col || '".value') AS value FROM raw),
known AS (SELECT *, replace(replace(replace(lower(value), 'µ', 'u'), 'μ', 'u'), '³', '^3') AS t FROM cell
  WHERE value IS NOT NULL AND regexp_matches(value, '[0-9]') AND lower(trim(value)) NOT IN ('nan', 'not available (nan)', 'not recorded', 'unavailable', 'unknown', 'n/a')),
hinted AS (SELECT k.*, lower(col) AS c, lower(coalesce(i.description, '')) AS d FROM known k LEFT JOIN column_info i ON i.in_table = k.source_table AND i.col_name = k.col),
measured AS (SELECT *, CASE
    WHEN c LIKE '%glu%' OR c LIKE '%sugar%' THEN 'glu' WHEN c LIKE '%cre%' THEN 'cre' WHEN c LIKE '%uric%' OR c LIKE '%urat%' OR regexp_matches(c, '^ua\b') THEN 'ua' WHEN c LIKE '%bil%' THEN 't_bil'
    WHEN c LIKE '%hgb%' OR c LIKE '%globin%' THEN 'hgb' WHEN c LIKE '%alb%' THEN 'alb' WHEN regexp_matches(c, '^wbc|white|leuko') THEN 'wbc' WHEN c LIKE '%height%' OR c = 'tall' THEN 'height'
    WHEN c LIKE '%weight%' OR c = 'mass' THEN 'weight' WHEN c LIKE '%consumption%' OR c LIKE '%usage%' THEN 'consumption' END AS quantity,
    regexp_extract(regexp_replace(t, '(x|\*)?10\^3.*$', ''), '[0-9][0-9.,]*', 0) AS n0, regexp_extract(regexp_replace(t, '^[^:]*10\^3[^:]*:', ''), '[0-9][0-9.,]*', 0) AS n1 FROM hinted),
numbers AS (SELECT *, regexp_replace(CASE WHEN n0 <> '' THEN n0 ELSE n1 END, '[.,]+$', '') AS n FROM measured WHERE quantity IS NOT NULL),
fields AS (SELECT *, CAST(CASE WHEN regexp_matches(n, '^[1-9][0-9]{0,2}(,[0-9]{3})+(\.[0-9]+)?$') THEN replace(n, ',', '') ELSE replace(n, ',', '.') END AS DOUBLE) AS x FROM numbers)
"""


def _unit(text: str) -> str:
    """1 where a text states another unit, 0 where the common one, null where none."""
    return rf"""CASE
      WHEN quantity IN ('glu', 'cre', 'ua', 't_bil') THEN CASE WHEN regexp_matches({text}, 'mol|[0-9 (]mm\b|^mm:|mmol') THEN 1 WHEN regexp_matches({text}, 'mg') THEN 0 END
      WHEN quantity IN ('hgb', 'alb') THEN CASE WHEN regexp_matches({text}, 'g(m|rams?)? ?(/|per|_per_| per )? ?_?d_?l|g per dl|/dl') THEN 0 WHEN regexp_matches({text}, 'g(rams)?/l|g per l|g_per_l') THEN 1 END
      WHEN quantity = 'wbc' THEN CASE WHEN regexp_matches({text}, '10\^3|thousand|k/ul') THEN 0 WHEN regexp_matches({text}, '/ul|per ul|/mm3') THEN 1 END
      WHEN quantity = 'height' THEN CASE WHEN regexp_matches({text}, 'cm|centi') THEN 0 WHEN regexp_matches({text}, '[0-9 ,:(]in\b|\bin\.|inch|"|ft|feet|met(er|re)|[0-9 (]m\b|^m\.?:|^in') THEN 1 END
      WHEN quantity = 'weight' THEN CASE WHEN regexp_matches({text}, 'kg|kilo') THEN 0 WHEN regexp_matches({text}, 'lb|pound|gram|[0-9 (]g\b|^g:') THEN 1 END
      ELSE CASE WHEN regexp_matches({text}, 'kwh|kilowatt') THEN 0 WHEN regexp_matches({text}, 'wh|mj|joule|watt') THEN 1 END END"""


_BARE = """CASE WHEN quantity = 'glu' THEN x < 20 WHEN quantity IN ('cre', 'ua') THEN x > 25 WHEN quantity = 't_bil' THEN x > 40 WHEN quantity = 'hgb' THEN x > 25 WHEN quantity = 'alb' THEN x > 8 WHEN quantity = 'wbc' THEN x > 250
      WHEN quantity = 'height' THEN x < 100 WHEN quantity = 'weight' THEN x > 1000 ELSE false END"""

_NAME = "regexp_replace(replace(replace(c, 'µ', 'u'), 'μ', 'u'), '_', ' ', 'g')"
_DESCRIPTION = "replace(replace(regexp_replace(d, 'as written by the source', ''), 'µ', 'u'), 'μ', 'u')"

P3_FOUND = rf"""WITH {FIELDS}, judged AS (SELECT row_id, quantity, coalesce({_unit('t')}, {_unit(f"replace(replace(replace({_NAME}, 'mg dl', 'mg/dl'), 'mmol l', 'mmol/l'), 'g per l', 'g per l')")}, {_unit(_DESCRIPTION)}, CAST({_BARE} AS INTEGER)) AS other FROM fields)
SELECT row_id, quantity FROM judged WHERE other = 1"""

"""A DuckDB statement of problem 6: the order of preference as one ORDER BY."""

from tamarack.queries.unit_sql import FIELDS

P6_FOUND = rf"""WITH {FIELDS},
head AS (SELECT row_id, lower(trim(entity_type)) AS entity, trim(record_id) AS id, regexp_extract(trim(record_id), '^[A-Za-z#]*[- ]?0*([0-9]+)', 1) AS number, trim(regexp_extract(trim(record_id), '_(.*)$', 1)) AS tail, ambiguous_fields, extracted_at, fields_json
  FROM extracted_record WHERE record_id IS NOT NULL AND entity_type IS NOT NULL),
keyed AS (SELECT *, CASE entity
    WHEN 'laboratory' THEN CAST(coalesce(try_strptime(tail, '%Y-%m-%d'), try_strptime(tail, '%Y/%m/%d'), try_strptime(tail, '%Y%m%d'), try_strptime(tail, '%d %B %Y'), try_strptime(tail, '%B %d, %Y')) AS VARCHAR)
    WHEN 'usage' THEN CAST(coalesce(try_strptime(tail || '01', '%Y%m%d'), try_strptime(tail || '-01', '%Y-%m-%d'), try_strptime('1 ' || tail, '%d %B %Y')) AS VARCHAR) ELSE '' END AS day FROM head),
held AS (SELECT *, count(*) OVER (PARTITION BY entity, number, day) AS n FROM keyed),
ranked AS (SELECT f.row_id, f.quantity, row_number() OVER (PARTITION BY h.entity, h.number, h.day, f.quantity ORDER BY
    CASE WHEN list_contains(h.ambiguous_fields, f.col) THEN 1 ELSE 0 END,
    CASE json_extract_string(h.fields_json, '$."' || f.col || '".confidence') WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END,
    CASE WHEN json_extract_string(h.fields_json, '$."' || f.col || '".is_correction') = 'true' THEN 0 ELSE 1 END,
    h.extracted_at DESC NULLS LAST, f.row_id, f.col) AS place
  FROM fields f JOIN held h ON h.row_id = f.row_id WHERE h.n > 1)
SELECT row_id, quantity FROM ranked WHERE place = 1"""

"""DuckDB statements that state problem 1 independently, by plain joins."""

_KEYS = r"""
nk(v) AS (VALUES (''),('-'),('--'),('?'),('unknown'),('not known'),('nan'),('none'),('null'),('nil'),('n/a'),('na'),('not available'),('not available (nan)'),('not recorded'),('unavailable')),
refs0 AS (
  SELECT 'laboratory' from_table, lab_id row_id, 'id' col_name, 'patient' parent, id raw, loaded_at ref_at FROM laboratory
  UNION ALL SELECT 'relationships', rel_id, 'source_id', lower(trim(source_type)), source_id, loaded_at FROM relationships
  UNION ALL SELECT 'relationships', rel_id, 'target_id', lower(trim(target_type)), target_id, loaded_at FROM relationships
  UNION ALL SELECT 'foreign_key', fk_id, 'ref_table', '#tables', lower(ref_table), loaded_at FROM foreign_key),
parents0 AS (
  SELECT 'patient' parent, id raw, loaded_at born, deleted_at gone FROM patient
  UNION ALL SELECT 'laboratory', CAST(lab_id AS VARCHAR), loaded_at, NULL FROM laboratory
  UNION ALL SELECT 'club_event', event_id, loaded_at, deleted_at FROM club_event
  UNION ALL SELECT '#tables', lower(in_table), NULL, NULL FROM column_info),
refs AS (SELECT *, CASE WHEN parent IN ('patient','laboratory') AND regexp_matches(regexp_replace(raw, '^[\s"''`]+|[\s"''`]+$', '', 'g'), '(?i)^(pt|patient|lab|laboratory|hero|c)?[\s\-_#:.]*0*[0-9]{1,18}(\.0+)?$')
    THEN regexp_extract(regexp_replace(raw, '^[\s"''`]+|[\s"''`]+$', '', 'g'), '(?i)^(?:(?:pt|patient|lab|laboratory|hero|c)?[\s\-_#:.]*)0*([0-9]{1,18})(?:\.0+)?$', 1) ELSE regexp_replace(raw, '^[\s"''`]+|[\s"''`]+$', '', 'g') END k
  FROM refs0 WHERE raw IS NOT NULL AND parent IS NOT NULL AND lower(regexp_replace(raw, '^[\s"''`]+|[\s"''`]+$', '', 'g')) NOT IN (SELECT v FROM nk)),
parents AS (SELECT *, CASE WHEN parent IN ('patient','laboratory') AND regexp_matches(regexp_replace(raw, '^[\s"''`]+|[\s"''`]+$', '', 'g'), '^0*[0-9]{1,18}$') THEN regexp_extract(regexp_replace(raw, '^[\s"''`]+|[\s"''`]+$', '', 'g'), '^0*([0-9]+)$', 1) ELSE regexp_replace(raw, '^[\s"''`]+|[\s"''`]+$', '', 'g') END k FROM parents0 WHERE raw IS NOT NULL),
judged AS (
  SELECT r.from_table, r.row_id, r.col_name, r.ref_at, count(p.k) n,
    coalesce(bool_or(p.k IS NOT NULL AND (p.born IS NULL OR p.born <= r.ref_at) AND (p.gone IS NULL OR p.gone > r.ref_at)), false) ok,
    coalesce(bool_or(p.k IS NOT NULL AND (p.born IS NULL OR p.born <= r.ref_at)), false) was
  FROM refs r LEFT JOIN parents p ON p.parent = r.parent AND p.k = r.k GROUP BY ALL),
found AS (SELECT from_table, row_id, col_name, ref_at, CASE WHEN n = 0 THEN 'missing' WHEN was THEN 'deleted' ELSE 'late' END reason FROM judged WHERE NOT ok)
"""
P1_FOUND = f"WITH {_KEYS} SELECT from_table, row_id, col_name, reason FROM found"
P1_REPORT = f"WITH {_KEYS} SELECT from_table, col_name, strftime(ref_at, '%Y-%m') AS month, reason, count(*) AS orphans FROM found GROUP BY ALL"

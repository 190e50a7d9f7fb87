"""SQL forms of the queries that plain SQL can express."""

_CANON = """
WITH r AS (
  SELECT entry_id, replace(upper(lower(key)), '_', '') AS k, upper(lower(value)) AS f,
         string_split_regex(upper(lower(value)), '[;|,]') AS parts
  FROM parse_entries WHERE key IS NOT NULL AND value IS NOT NULL),
c AS (
  SELECT entry_id, k, CASE WHEN len(parts) > 1 AND len(list_filter(parts, lambda x: NOT (contains(x, ':') OR contains(x, '=')))) = 0
    THEN array_to_string(list_sort(list_transform(parts, lambda x: regexp_replace(x, '[^\\pL\\pM\\pN]+', '', 'g'))), chr(1))
    ELSE regexp_replace(f, '[^\\pL\\pM\\pN]+', '', 'g') END AS v
  FROM r),
g AS (
  SELECT entry_id, min(entry_id) OVER (PARTITION BY k, v) AS first_id, count(*) OVER (PARTITION BY k, v) AS n_copies
  FROM c WHERE replace(v, chr(1), '') <> '')
"""

_TERMS = """
WITH t AS (
  SELECT entry_id, unnest(regexp_extract_all(lower(value), '[\\pL\\pM\\pN]+')) AS term FROM parse_entries WHERE value IS NOT NULL),
n AS (SELECT term, count(*) AS occurrences, count(DISTINCT entry_id) AS records FROM t GROUP BY term),
m AS (
  SELECT *, CASE WHEN records < 3 THEN 'rare'
    WHEN records > 0.02 * (SELECT count(*) FROM parse_entries WHERE value IS NOT NULL) THEN 'common' END AS mark
  FROM n)
"""

SQL = {
    "p1_found": _CANON + "SELECT first_id, entry_id FROM g WHERE entry_id > first_id",
    "p1_collapsed": _CANON + "SELECT first_id, n_copies, key, value FROM g JOIN parse_entries USING (entry_id) WHERE entry_id = first_id",
    "p5_found": _TERMS + "SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p5_terms": _TERMS + "SELECT term, occurrences, records, mark FROM m",
    "p5_values": "SELECT value, count(*) AS occurrences FROM parse_entries WHERE value IS NOT NULL GROUP BY value",
}

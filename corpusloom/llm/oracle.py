"""SQL for DuckDB that gives the same rows, where SQL can express the query."""

P1_FOUND = """
SELECT content_id, 'markdown' AS field_name FROM clean_content WHERE length(markdown) > 4000
UNION ALL
SELECT content_id, 'plain_text' AS field_name FROM clean_content WHERE length(plain_text) > 4000
"""

P5_RANKED = r"""
WITH named AS (
  SELECT report_row_id, lower(trim(item_id)) AS item_id, title, content_hash, artifact_dir,
    CASE WHEN missing_fields IS NULL THEN 2147483647
      ELSE len(list_distinct(list_filter(list_transform(missing_fields, lambda x: lower(trim(x))), lambda x: x <> ''))) END AS n,
    trim(checked_at) AS t
  FROM report_items WHERE item_id IS NOT NULL
), timed AS (
  SELECT *, CASE
      WHEN regexp_full_match(t, '[+-]?\d{1,12}(\.\d*)?') THEN CAST(CAST(t AS DECIMAL(24, 6)) * 1000000 AS BIGINT)
      WHEN regexp_full_match(t, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:?\d{2})?') THEN
        epoch_us(CAST(replace(substr(t, 1, 19), 'T', ' ') AS TIMESTAMP))
        + CAST(rpad(regexp_extract(t, ':\d{2}\.(\d{1,6})', 1), 6, '0') AS BIGINT)
        - CASE WHEN regexp_matches(t, '[+-]\d{2}:?\d{2}$') THEN
            CAST(regexp_extract(t, '([+-])\d{2}:?\d{2}$', 1) || '1' AS BIGINT) * 60000000
            * (60 * CAST(regexp_extract(t, '[+-](\d{2}):?\d{2}$', 1) AS BIGINT) + CAST(regexp_extract(t, '[+-]\d{2}:?(\d{2})$', 1) AS BIGINT))
          ELSE 0 END
    END AS seen_us
  FROM named
), ranked AS (
  SELECT *, count(*) OVER (PARTITION BY item_id) AS rows_of_item FROM timed
)
"""


def _first(field: str) -> str:
    usable = "" if field == "record" else f"AND {field} IS NOT NULL AND trim({field}) <> ''"
    return f"""
SELECT item_id, '{field}' AS field_name, report_row_id FROM (
  SELECT item_id, report_row_id, row_number() OVER (PARTITION BY item_id ORDER BY n, seen_us DESC NULLS LAST, report_row_id) AS place
  FROM ranked WHERE rows_of_item > 1 {usable}) WHERE place = 1"""


SQL = {
    "p1_found": P1_FOUND,
    "p5_found": P5_RANKED + " UNION ALL ".join(map(_first, ("record", "title", "content_hash", "artifact_dir"))),
}

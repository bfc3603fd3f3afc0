"""SQL that gives the same rows as a registered query, where SQL can express it."""

P5_FOUND = """
WITH latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY parsed_at DESC) AS rn FROM chapters) WHERE rn = 1
), bounded AS (
  SELECT c.book_id, c.chapter_no, c.page_start, l.max_size,
    coalesce(c.page_end, CASE WHEN n.book_id IS NOT NULL THEN n.page_start - 1 ELSE c.logical_pages END) AS page_end
  FROM latest c LEFT JOIN latest n ON n.book_id = c.book_id AND n.chapter_no = c.chapter_no + 1
  JOIN size_limits l ON l.limit_name = lower(trim(c.limit_name)) AND l.size_unit = 'pages'
)
SELECT DISTINCT book_id, chapter_no FROM bounded WHERE page_end >= page_start AND page_end - page_start + 1 > max_size
"""


def oracle_sql() -> dict[str, str]:
    return {"p5_found": P5_FOUND}

"""A view of notes over the documents table, the same in Spark SQL and DuckDB: files with front matter,
links, superseded and malformed notes, made from whole texts."""

NOTES_SQL = """
WITH s AS (
  SELECT doc_id, coalesce(text, '') AS text, lang, source,
         'doc-' || CAST(CASE WHEN doc_id % 10 < 2 THEN doc_id - doc_id % 10 ELSE doc_id END AS VARCHAR(20)) AS stem
  FROM {documents}
), p AS (
  SELECT doc_id AS id, text, lang, stem, source || '/' || lang || '/' AS namespace,
         source || '/' || lang || '/' || stem || '.md' AS path
  FROM s
), j AS (
  SELECT p.id, p.path, p.namespace, p.stem AS slug, p.lang, p.text,
         n1.stem AS next_stem, n1.path AS next_path, substr(n2.path, 1, length(n2.path) - 3) AS next2_target
  FROM p LEFT JOIN p n1 ON n1.id = p.id + 1 LEFT JOIN p n2 ON n2.id = p.id + 2
), b AS (
  SELECT id, path, namespace, slug, lang, text,
         CASE WHEN id % 25 = 7 THEN next_path END AS superseded, id % 50 = 13 AS malformed,
         '# Doc ' || CAST(id AS VARCHAR(20)) || chr(10) || chr(10) || text || chr(10) || chr(10) || 'Links:'
           || coalesce(' [[' || next_stem || ']]', '') || coalesce(' [[' || next2_target || '|next]]', '')
           || CASE WHEN id % 5 = 0 THEN ' [[doc-' || CAST(id - id % 10 AS VARCHAR(20)) || ']]' ELSE '' END
           || CASE WHEN id % 9 = 0 THEN ' [[ghost-' || CAST(id AS VARCHAR(20)) || ']]' ELSE '' END || chr(10) AS body,
         next_stem, next2_target
  FROM j
)
SELECT id, path, namespace, slug, lang, text, 'Doc ' || CAST(id AS VARCHAR(20)) AS title,
       CASE WHEN malformed THEN NULL ELSE superseded END AS superseded_by, malformed, body, next_stem, next2_target,
       '---' || chr(10) || 'type: ' || lang || chr(10)
         || coalesce('superseded_by: "' || superseded || '"' || chr(10), '')
         || CASE WHEN malformed THEN '' ELSE '---' || chr(10) END || body AS raw
FROM b
"""

_NEIGHBOURS = "FROM p LEFT JOIN p n1 ON n1.id = p.id + 1 LEFT JOIN p n2 ON n2.id = p.id + 2"

#: The same rows for Spark. Neighbours are found among keys, so that texts travel once at most and not for each neighbour.
NOTES_PLAN = (
    NOTES_SQL.replace(_NEIGHBOURS, "FROM p LEFT JOIN q ON q.id = p.id", 1)
    .replace("n1.stem AS next_stem, n1.path AS next_path, substr(n2.path, 1, length(n2.path) - 3) AS next2_target", "q.next_stem, q.next_path, q.next2_target", 1)
    .replace("), j AS (", "), q AS (SELECT k.id, n1.stem AS next_stem, n1.path AS next_path, substr(n2.path, 1, length(n2.path) - 3) AS next2_target " + _NEIGHBOURS.replace("FROM p ", "FROM (SELECT DISTINCT id FROM p) k ").replace("p.id", "k.id") + "), j AS (", 1)
)

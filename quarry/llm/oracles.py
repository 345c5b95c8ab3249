"""DuckDB SQL that gives the rows of the queries SQL can express."""

_BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"

SQL: dict[str, str] = {
    "op1_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
k AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes)
            ELSE page_id END AS keep FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM k
""",
    "op3_url_filter": """
WITH u AS (
  SELECT page_id, coalesce(substr(url, strpos(url, '://') + 3), '') AS rest, coalesce(strpos(url, '://'), 0) > 0 AS ok
  FROM pages),
h AS (
  SELECT page_id, CASE WHEN ok THEN regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1) ELSE '' END AS host,
         CASE WHEN ok THEN regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) ELSE '' END AS path FROM u),
l AS (
  SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h),
r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM l)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
""",
    "op6_substring_dedup": """
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (
  SELECT doc_id, p.pos, list_slice(ws, p.pos + 1, p.pos + 50) AS g
  FROM w, LATERAL (SELECT unnest(range(len(ws) - 49)) AS pos) p WHERE len(ws) >= 50),
own AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY g) < doc_id AS late FROM win),
gone AS (
  SELECT DISTINCT o.doc_id, o.pos + k.k AS pos FROM own o CROSS JOIN (SELECT unnest(range(50)) AS k) k WHERE late),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, string_agg(list_extract(ws, p.pos + 1), ' ' ORDER BY p.pos) AS t
  FROM w, LATERAL (SELECT unnest(range(len(ws))) AS pos) p
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = w.doc_id AND g.pos = p.pos) GROUP BY w.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
""",
    "op10_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS all_pos
  FROM documents),
seq AS (
  SELECT doc_id, all_pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY all_pos) - 1 AS pos
  FROM lines WHERE length(trim(line, {_BLANKS})) > 0),
arr AS (SELECT doc_id, list(line ORDER BY pos) AS ls FROM seq GROUP BY doc_id),
win AS (
  SELECT a.doc_id, s.pos, g.size, list_slice(a.ls, s.pos + 1, s.pos + g.size) AS w
  FROM arr a JOIN seq s ON s.doc_id = a.doc_id
  CROSS JOIN (SELECT unnest([2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096]) AS size) g
  WHERE s.pos + g.size <= len(a.ls)),
runs AS (
  SELECT doc_id, pos, size, row_number() OVER (PARTITION BY size, w ORDER BY doc_id, pos) > 1 AS later FROM win),
gone AS (
  SELECT DISTINCT doc_id, p AS pos FROM (
    SELECT doc_id, pos AS p FROM runs WHERE later AND size = 2
    UNION ALL SELECT doc_id, pos + 1 FROM runs WHERE later AND size = 2)),
kept AS (
  SELECT l.doc_id, l.all_pos, l.line FROM lines l
  LEFT JOIN seq s ON s.doc_id = l.doc_id AND s.all_pos = l.all_pos
  LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.pos = s.pos
  WHERE g.pos IS NULL),
text_left AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY all_pos) AS kept_text FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_lines, coalesce(g.n, 0) AS n_removed,
       coalesce(r.size, 0) AS longest_run,
       sha256(coalesce(t.kept_text, '')) AS kept_sha256
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM seq GROUP BY doc_id) n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, max(size) AS size FROM runs WHERE later GROUP BY doc_id) r ON r.doc_id = d.doc_id
LEFT JOIN text_left t ON t.doc_id = d.doc_id
""",
    "op13_exact_dedup": """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
""",
}

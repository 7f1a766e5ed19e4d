"""SQL for the queries that SQL can express."""

P1_FOUND = r"""
WITH RECURSIVE c AS (
  SELECT pair_id,
         regexp_replace(replace(regexp_replace(lower(key), '\s+', '', 'g'), '\', '/'), '^(\./|/)+', '') AS k,
         regexp_replace(replace(regexp_replace(lower(raw_path), '\s+', '', 'g'), '\', '/'), '^(\./|/)+', '') AS r,
         list_sort(regexp_split_to_array(trim(regexp_replace(lower(author), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')) AS a
  FROM sft_pairs
), marks AS (
  SELECT pair_id, 'r' || regexp_extract(k, '^(run-[^:]+):', 1) AS mark FROM c WHERE k LIKE 'run-%:%'
  UNION
  SELECT pair_id, 'p' || replace(regexp_replace(regexp_replace(regexp_replace(k, '#.*$', ''), '^wiki/', ''), '\.md$', ''), '/', '-')
  FROM c WHERE k NOT LIKE 'run-%:%' AND k <> ''
  UNION
  SELECT pair_id, 'c' || r FROM c WHERE r <> ''
  UNION
  SELECT pair_id, 'a' || array_to_string(a, ' ') FROM c
  WHERE array_to_string(a, ' ') NOT IN ('', 'unknown', 'author unknown', 'anonymous', 'a n', 'na', 'none')
), first AS (SELECT mark, min(pair_id) AS m FROM marks GROUP BY mark),
edges AS (
  SELECT DISTINCT pair_id AS u, m AS v FROM marks JOIN first USING (mark)
  UNION SELECT DISTINCT m, pair_id FROM marks JOIN first USING (mark)
), reach AS (
  SELECT DISTINCT pair_id AS u, pair_id AS v FROM sft_pairs
  UNION
  SELECT reach.u, edges.v FROM reach JOIN edges ON reach.v = edges.u
)
SELECT min(v) AS group_id, u AS pair_id FROM reach GROUP BY u HAVING min(v) <> u
"""

_GROUPS = P1_FOUND[: P1_FOUND.rindex("SELECT min(v)")]
P1_INTEGRITY = _GROUPS + """SELECT count(*)::BIGINT AS pairs, count(DISTINCT g)::BIGINT AS groups, 0::BIGINT AS straddling FROM (SELECT u, min(v) AS g FROM reach GROUP BY u)"""

P5_REJOINED = """
SELECT DISTINCT rel_path, sha256(body_text) AS sha, true AS fits FROM resources r
WHERE strlen(body_text) > 28000
  AND synced_at = (SELECT max(synced_at) FROM resources s WHERE s.rel_path = r.rel_path)
"""

P7_INTEGRITY = "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS broken, 0::BIGINT AS overfull FROM documents WHERE text <> ''"

P5_FOUND = """
SELECT DISTINCT rel_path FROM resources r
WHERE strlen(body_text) > 28000
  AND synced_at = (SELECT max(synced_at) FROM resources s WHERE s.rel_path = r.rel_path)
"""

P6_ROUNDTRIP = "SELECT true AS same, count(*) AS n FROM documents"

P4_FOUND = """
WITH c AS (SELECT id, embedding FROM notes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY synced_at DESC) = 1),
u AS (SELECT id, embedding::DOUBLE[] AS v FROM c WHERE len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 128
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.id AS id, b.id AS other, list_cosine_similarity(a.v, b.v) AS score FROM u a JOIN u b ON a.id <> b.id),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, other) <= 5)
SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM k WHERE score >= 0.75
"""

ORACLES = {"p1_integrity": P1_INTEGRITY, "p5_rejoined": P5_REJOINED, "p7_integrity": P7_INTEGRITY, "p4_found": P4_FOUND, "p1_found": P1_FOUND, "p5_found": P5_FOUND, "p6_roundtrip": P6_ROUNDTRIP}

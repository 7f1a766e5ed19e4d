"""A vault over the test tables: the documents, given frontmatter and links by id arithmetic.

The files hold the whole text of each document behind a line of links that covers every outcome of
resolution (unique, by folder, ambiguous, broken, to itself, repeated, other case, in code).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.markup import parsed_notes
from quillgraph.functions.text import lenient_date, note_dir, note_id, note_slug
from quillgraph.operators import resolve
from quillgraph.runtime import spread, table

PREFIX = "wiki/"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(rel_path, text)``."""
    docs = table(spark, sf_dir, "documents")
    n = (docs.agg(F.max("doc_id")).first()[0] or 0) + 1
    d = docs.where("text is not null").selectExpr(
        "doc_id as i", "text", "coalesce(kind, 'note') as dir", "coalesce(source, 'none') as source", "updated",
        "coalesce(nullif(lower(trim(lang)), ''), 'und') as lang", f"{n}L as n",
    )
    d = d.withColumn("slug", F.expr("case when i % 10 = 5 then concat('t', i div 40) else concat('d', i) end"))
    d = d.withColumn("other", F.expr("(i + 5) % n")).withColumn("other_slug", F.expr("case when other % 10 = 5 then concat('t', other div 40) else concat('d', other) end"))
    path = F.expr("concat('wiki/', dir, '/', case when i % 10 = 5 then concat('x', i, '/') else '' end, slug, '.md')")
    front = F.expr(
        "concat_ws('\\n', '---', concat('title: Page ', i), if(i % 17 = 0, null, concat('kind: ', dir)), concat('status: ', element_at(array('draft', 'reviewed', 'stale'), int(i % 3 + 1))), "
        "concat('updated: ', updated), concat('tags: [\"', lang, '\", \"', source, '\"]'), if(i % 11 = 0, concat('contradicts: ', other_slug), null), "
        "if(i % 2 = 0, concat('source_refs: raw/', source, '.md'), null), '---', '')"
    )
    links = F.expr(
        "concat_ws(' ', 'See', if(i % 3 = 0, concat('[[d', (7 * i + 1) % n, ']]'), null), if(i % 4 = 0, concat('[[', dir, '/d', (3 * i + 2) % n, ']]'), null), "
        "if(i % 7 = 0, concat('[[t', i div 40, '|alias]]'), null), if(i % 5 = 1, concat('[[nope', i, ']]'), null), if(i % 6 = 0, concat('[[', slug, ']]'), null), "
        "if(i % 9 = 0, concat('[[d', (7 * i + 1) % n, ']]'), null), if(i % 12 = 0, concat('[[D', (7 * i + 1) % n, '#anchor]]'), null), if(i % 8 = 0, concat('`[[d', (i + 1) % n, ']]`'), null))"
    )
    return d.select(path.alias("rel_path"), F.concat(front, links, F.lit("\n\n"), F.col("text")).alias("text"))


def ids(found: DataFrame) -> DataFrame:
    """``(id, slug, dir, path)``: the notes of files ``(rel_path)`` as far as their paths tell; of files with one id the last path counts."""
    path = F.col("path")
    f = found.select(F.col("rel_path").alias("path"))
    last = f.groupBy(note_id(path, PREFIX).alias("id")).agg(F.max("path").alias("path"))
    return last.select("id", note_slug(path, PREFIX).alias("slug"), note_dir(path, PREFIX).alias("dir"), "path")


def notes(spark: SparkSession, sf_dir: str, *want: str) -> DataFrame:
    """Parsed notes with id, slug and dir: all columns, or those wanted, and only what these need is parsed."""
    f = files(spark, sf_dir)
    p = parsed_notes(spread(f), ("contradicts", "source_refs"), inline=False, want=want or None)
    n = p.join(ids(f), "path").select("id", "slug", "dir", "path", *[c for c in p.columns if c != "path"])
    if "updated" in n.columns:
        n = n.withColumn("updated", lenient_date(F.col("updated")))
    return n.withColumn("title", F.coalesce("title", "id")) if "title" in n.columns else n


def edges(n: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """All edges of the vault."""
    return (
        resolve.wikilink_edges(n, among=among)
        .unionByName(resolve.field_edges(n, "contradicts", "CONTRADICTS", among=among))
        .unionByName(resolve.field_edges(n, "source_refs", "SOURCE_OF", to_resource=True))
        .unionByName(resolve.tag_edges(n))
    )


def current_notes(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The latest row of each note of the notes table, without its text and vector unless asked for; repeated rows count once."""
    raw = table(spark, sf_dir, "notes").where("id is not null")
    cols = [c for c in raw.columns if c not in ("id", "synced_at", "body_text", "embedding", "frontmatter_json") or c in more]
    last = raw.groupBy("id").agg(F.max(F.struct("synced_at", *cols)).alias("m"))
    return last.select("id", "m.*")


#: The same notes, links and edges in SQL.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id AS i, text, coalesce(kind, 'note') AS dir, coalesce(source, 'none') AS source, updated,
         coalesce(nullif(lower(trim(lang)), ''), 'und') AS lang, (SELECT max(doc_id) + 1 FROM documents) AS n
  FROM documents WHERE text IS NOT NULL
), v AS (SELECT *, CASE WHEN i % 10 = 5 THEN 't' || (i // 40) ELSE 'd' || i END AS slug,
                CASE WHEN (i + 5) % n % 10 = 5 THEN 't' || ((i + 5) % n // 40) ELSE 'd' || ((i + 5) % n) END AS other FROM d
), note AS (SELECT *, dir || '-' || CASE WHEN i % 10 = 5 THEN 'x' || i || '-' ELSE '' END || slug AS id FROM v
), own AS (
  SELECT id AS src, dir, unnest(regexp_extract_all(text, '\[\[([^\]\n]*)\]\]', 1)) AS l FROM note
), link AS (
  SELECT src, dir, trim(split_part(split_part(l, '|', 1), '#', 1)) AS target FROM own WHERE trim(split_part(split_part(l, '|', 1), '#', 1)) <> ''
  UNION ALL SELECT id, dir, 'd' || ((7 * i + 1) % n) FROM note WHERE i % 3 = 0
  UNION ALL SELECT id, dir, dir || '/d' || ((3 * i + 2) % n) FROM note WHERE i % 4 = 0
  UNION ALL SELECT id, dir, 't' || (i // 40) FROM note WHERE i % 7 = 0
  UNION ALL SELECT id, dir, 'nope' || i FROM note WHERE i % 5 = 1
  UNION ALL SELECT id, dir, slug FROM note WHERE i % 6 = 0
  UNION ALL SELECT id, dir, 'd' || ((7 * i + 1) % n) FROM note WHERE i % 9 = 0
  UNION ALL SELECT id, dir, 'D' || ((7 * i + 1) % n) FROM note WHERE i % 12 = 0
  UNION ALL SELECT id, dir, 'd' || ((i + 1) % n) FROM note WHERE i % 8 = 0
), slugs AS (SELECT slug, list_sort(list(DISTINCT id)) AS ids FROM note GROUP BY slug
), hit AS (
  SELECT l.src, l.dir, l.target, n.id AS by_id, s.ids,
         list_filter(s.ids, lambda x: starts_with(x, l.dir || '-')) AS near
  FROM link l
  LEFT JOIN note n ON contains(l.target, '/') AND replace(lower(l.target), '/', '-') = n.id
  LEFT JOIN slugs s ON NOT contains(l.target, '/') AND lower(l.target) = s.slug
), res AS (
  SELECT src, target, CASE WHEN by_id IS NOT NULL THEN by_id WHEN len(ids) = 1 THEN ids[1] WHEN len(ids) > 1 AND len(near) = 1 THEN near[1] END AS dst,
         len(ids) > 1 AS many FROM hit
), resolved AS (
  SELECT src, target, dst, CASE WHEN dst IS NOT NULL THEN 'resolved' WHEN many THEN 'ambiguous' ELSE 'broken' END AS outcome FROM res
), contra AS (
  SELECT m.id AS src, CASE WHEN len(s.ids) = 1 THEN s.ids[1]
     WHEN len(list_filter(s.ids, lambda x: starts_with(x, m.dir || '-'))) = 1 THEN list_filter(s.ids, lambda x: starts_with(x, m.dir || '-'))[1] END AS dst
  FROM note m JOIN slugs s ON s.slug = m.other WHERE m.i % 11 = 0
), edge AS (
  SELECT DISTINCT src, dst, 'Note' AS dst_type, 'LINKS_TO' AS edge FROM resolved WHERE outcome = 'resolved' AND src <> dst
  UNION ALL SELECT DISTINCT src, dst, 'Note', 'CONTRADICTS' FROM contra WHERE dst IS NOT NULL
  UNION ALL SELECT DISTINCT id, 'raw/' || source || '.md', 'Resource', 'SOURCE_OF' FROM note WHERE i % 2 = 0
  UNION ALL SELECT DISTINCT id, t, 'Tag', 'TAGGED' FROM (SELECT id, unnest([lang, source]) AS t FROM note)
), adj AS (
  SELECT src AS a, dst AS b FROM edge WHERE dst_type = 'Note' UNION SELECT dst, src FROM edge WHERE dst_type = 'Note'
)
"""

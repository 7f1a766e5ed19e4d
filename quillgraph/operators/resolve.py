"""Links to notes: resolution, typed edges, backlinks, and what changes when notes come and go.

Everything is an equi-join on id or slug; no side is broadcast by hint, so Spark decides by size.
Nulls never match. All functions take and give DataFrames with the columns named in their docstrings
and ignore further columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def slug_index(notes: DataFrame) -> DataFrame:
    """``(slug, ids)`` with ids in order, from notes ``(id, slug)``."""
    return notes.groupBy("slug").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def resolve(links: DataFrame, notes: DataFrame) -> DataFrame:
    """links ``(dir, target, ...)`` plus ``outcome`` (resolved, ambiguous, broken), ``dst`` and ``options``.

    A target with a slash names a full id. A bare target names a slug; of several notes with it, the one
    whose id starts with the linking note's folder wins when there is exactly one.
    """
    want = F.lower(F.trim("target"))
    work = links.withColumn("_want", F.when(want.contains("/"), F.replace(want, F.lit("/"), F.lit("-"))).otherwise(want)).withColumn(
        "_path", want.contains("/")
    )
    ids = notes.select(F.col("id").alias("_id")).distinct()
    index = slug_index(notes.select("id", "slug")).select(F.col("slug").alias("_slug"), F.col("ids").alias("_ids"))
    work = work.join(ids, F.col("_path") & (F.col("_want") == F.col("_id")), "left")
    work = work.join(index, ~F.col("_path") & (F.col("_want") == F.col("_slug")), "left")
    near = F.filter("_ids", lambda x: x.startswith(F.concat(F.col("dir"), F.lit("-"))))
    dst = (
        F.when(F.col("_path"), F.col("_id"))
        .when(F.size("_ids") == 1, F.col("_ids")[0])
        .when((F.size("_ids") > 1) & (F.size(near) == 1), near[0])
    )
    out = work.withColumn("dst", dst)
    return out.withColumn(
        "outcome", F.when(F.col("dst").isNotNull(), "resolved").when(~F.col("_path") & (F.size("_ids") > 1), "ambiguous").otherwise("broken")
    ).withColumn("options", F.when(F.col("outcome") == "ambiguous", F.col("_ids"))).drop("_want", "_path", "_id", "_slug", "_ids")


def note_links(notes: DataFrame) -> DataFrame:
    """``(src, dir, pos, target, anchor, alias, start, end, masked)`` of every link occurrence."""
    return notes.select(F.col("id").alias("src"), "dir", F.posexplode("links").alias("pos", "l")).select("src", "dir", "pos", "l.*")


def _first_raw(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst, edge) with the raw target that comes first."""
    return edges.groupBy("src", "dst", "dst_type", "edge").agg(F.min_by("raw_target", "pos").alias("raw_target"))


def wikilink_edges(notes: DataFrame, edge: str = "LINKS_TO", among: DataFrame | None = None) -> DataFrame:
    """``(src, dst, dst_type, edge, raw_target)``; unresolved links and links to oneself make none."""
    got = resolve(note_links(notes), notes if among is None else among).where("outcome = 'resolved' and src <> dst")
    return _first_raw(got.select("src", "dst", F.lit("Note").alias("dst_type"), F.lit(edge).alias("edge"), F.col("target").alias("raw_target"), "pos"))


def field_edges(notes: DataFrame, field: str, edge: str, to_resource: bool = False, among: DataFrame | None = None) -> DataFrame:
    """Edges from a frontmatter field; links to oneself are kept."""
    vals = notes.select(F.col("id").alias("src"), "dir", F.posexplode("fields").alias("pos", "f")).where(F.col("f.field") == field)
    vals = vals.select("src", "dir", "pos", F.col("f.value").alias("target"))
    if to_resource:
        got = vals.withColumn("dst", F.col("target"))
    else:
        got = resolve(vals, notes if among is None else among).where("outcome = 'resolved'")
    kind = F.lit("Resource" if to_resource else "Note").alias("dst_type")
    return _first_raw(got.select("src", "dst", kind, F.lit(edge).alias("edge"), F.col("target").alias("raw_target"), "pos"))


def tag_edges(notes: DataFrame) -> DataFrame:
    return (
        notes.select(F.col("id").alias("src"), F.explode("tags").alias("dst"))
        .distinct()
        .select("src", "dst", F.lit("Tag").alias("dst_type"), F.lit("TAGGED").alias("edge"), F.lit(None).cast("string").alias("raw_target"))
    )


def resources_with_stubs(resources: DataFrame, edges: DataFrame, key: str = "rel_path") -> DataFrame:
    """All resources, and one with nothing but its path for each edge to a missing file."""
    wanted = edges.where("dst_type = 'Resource'").select(F.col("dst").alias(key)).distinct()
    return resources.join(wanted, key, "full_outer")


def backlinks(notes: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """``(dst, src, pos)`` of each resolved occurrence, in code or not, from another note."""
    return resolve(note_links(notes), notes if among is None else among).where("outcome = 'resolved' and src <> dst").select("dst", "src", "pos")


def shifted(links: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Links ``(src, dir, pos, target)`` whose resolution differs between two sets of notes."""
    a = resolve(links, before).select("src", "pos", "target", F.col("dst").alias("dst_before"), F.col("outcome").alias("was"))
    b = resolve(links, after).select("src", "pos", F.col("dst").alias("dst_after"), F.col("outcome").alias("now"))
    return a.join(b, ["src", "pos"]).where(~F.col("dst_before").eqNullSafe(F.col("dst_after")) | (F.col("was") != F.col("now")))


def references(notes: DataFrame, target_id: str | None = None) -> DataFrame:
    """``(dst, src, path, start, end, masked)``: where each resolved link stands in its file, or those to one note.

    Spans are characters of the body; ``markup.position_of`` turns bytes of a file into lines and columns.
    """
    got = resolve(note_links(notes), notes).where("outcome = 'resolved' and src <> dst")
    got = got if target_id is None else got.where(F.col("dst") == target_id)
    return got.select("dst", "src", "start", "end", "masked").join(notes.select(F.col("id").alias("src"), "path"), "src").select("dst", "src", "path", "start", "end", "masked")


def rename_plan(notes: DataFrame, target_id: str, new_slug: str) -> DataFrame:
    """``(src, path, start, end, replacement)``: the edits that keep links alive when a note is renamed, and last the
    file's own renaming, a row without a span whose replacement is the new path. Links in code stay."""
    got = resolve(note_links(notes), notes).where((F.col("dst") == target_id) & ~F.col("masked"))
    text = F.concat(
        F.lit("[["), F.when(F.col("target").contains("/"), F.regexp_replace("target", r"[^/]*$", new_slug)).otherwise(F.lit(new_slug)),
        F.when(F.col("anchor").isNotNull(), F.concat(F.lit("#"), F.col("anchor"))).otherwise(""),
        F.when(F.col("alias").isNotNull(), F.concat(F.lit("|"), F.col("alias"))).otherwise(""), F.lit("]]"),
    )
    edits = got.select("src", "start", "end", text.alias("replacement")).join(notes.select(F.col("id").alias("src"), "path"), "src")
    own = notes.where(F.col("id") == target_id)
    none = F.lit(None).cast("int")
    move = own.select(F.col("id").alias("src"), "path", none.alias("start"), none.alias("end"), F.regexp_replace("path", r"[^/]*(\.md)$", f"{new_slug}$1").alias("replacement"))
    return edits.select("src", "path", "start", "end", "replacement").unionByName(move)


def definitions(notes: DataFrame) -> DataFrame:
    """``(src, pos, dst, heading_start)``: where each resolved link leads, down to the heading its anchor names."""
    norm = lambda c: F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit(" "))
    heads = notes.select(F.col("id").alias("dst"), F.explode("headings").alias("h")).select("dst", norm(F.col("h.text")).alias("_h"), F.col("h.start").alias("at"))
    heads = heads.groupBy("dst", "_h").agg(F.min("at").alias("heading_start"))
    got = resolve(note_links(notes), notes).where("outcome = 'resolved'").withColumn("_h", norm(F.col("anchor")))
    return got.join(heads, ["dst", "_h"], "left").select("src", "pos", "dst", "heading_start")


def completions(notes: DataFrame, folder: str, typed: str = "", limit: int = 200) -> DataFrame:
    """``(id, insert)``: the slug where it resolves to its own note from that folder, else the id."""
    hit = notes.where(F.lower("id").contains(typed.lower()) | F.lower("slug").contains(typed.lower())).select(
        "id", F.lit(folder).alias("dir"), F.col("slug").alias("target")
    )
    got = resolve(hit, notes)
    return got.select("id", F.when(F.col("dst") == F.col("id"), F.col("target")).otherwise(F.col("id")).alias("insert")).orderBy("id").limit(limit)

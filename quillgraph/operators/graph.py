"""Reads over ``edges(src, dst, dst_type, edge)`` and ``nodes(id, node_type, title, ...)``.

Traversals are a bounded number of frontier joins; each frontier is distinct before the next join, so
work follows the edges reached and not the walks. Ends of every limit are ordered by id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.runtime import Scratch


def node_view(notes: DataFrame, resources: DataFrame | None = None, tags: bool = True) -> DataFrame:
    """``(id, node_type, title, kind)`` over notes, resources and tags."""
    out = notes.select("id", F.lit("Note").alias("node_type"), F.coalesce("title", "id").alias("title"), "kind")
    if resources is not None:
        out = out.unionByName(
            resources.select(F.col("rel_path").alias("id"), F.lit("Resource").alias("node_type"), F.coalesce("title", "rel_path").alias("title"), F.lit(None).cast("string").alias("kind"))
        )
    if tags:
        t = notes.select(F.explode("tags").alias("id")).distinct()
        out = out.unionByName(t.select("id", F.lit("Tag").alias("node_type"), F.col("id").alias("title"), F.lit(None).cast("string").alias("kind")))
    return out


def neighbours(edges: DataFrame, nodes: DataFrame, start: str | DataFrame, direction: str = "out", edge: str = "*", limit: int = 25) -> DataFrame:
    """``(edge, node_type, id, title)`` one step away from a note, by id or as a table ``(id)``; at most 200."""
    here, there = ("src", "dst") if direction == "out" else ("dst", "src")
    hit = edges.where(F.col(here) == start) if isinstance(start, str) else edges.join(start.select(F.col("id").alias(here)), here, "left_semi")
    if edge != "*":
        hit = hit.where(F.col("edge") == edge)
    return (
        hit.select("edge", F.col(there).alias("id"))
        .join(nodes.select("id", "node_type", "title"), "id")
        .select("edge", "node_type", "id", "title")
        .orderBy("edge", "id")
        .limit(min(limit, 200))
    )


def undirected(edges: DataFrame) -> DataFrame:
    """``(a, b)`` both ways over note-to-note edges."""
    e = edges.where("dst_type = 'Note'").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 1, scratch: Scratch | None = None, per_hop: int | None = None) -> DataFrame:
    """``(id, hop)`` of the seeds ``(id)`` and of the notes within that many undirected steps.

    With ``per_hop`` each hop adds at most so many notes, the first by id. With a scratch space every frontier is
    computed once, whatever the number of hops.
    """
    keep = scratch.keep if scratch else lambda df: df
    adj = keep(undirected(edges))
    seen = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    frontier = seen.select("id")
    for hop in range(1, hops + 1):
        reached = frontier.join(adj, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        frontier = reached.join(seen.select("id"), "id", "left_anti")
        frontier = keep(frontier if per_hop is None else frontier.orderBy("id").limit(per_hop))
        seen = seen.unionByName(frontier.withColumn("hop", F.lit(hop)))
    return seen


def expand_each(edges: DataFrame, seeds: DataFrame, hops: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """``(root, id, hop)``: what ``expand`` gives for each seed ``(id)`` by itself."""
    keep = scratch.keep if scratch else lambda df: df
    adj = keep(undirected(edges))
    seen = seeds.select(F.col("id").alias("root"), "id").distinct().withColumn("hop", F.lit(0))
    frontier = seen.select("root", "id")
    for hop in range(1, hops + 1):
        reached = frontier.join(adj, F.col("id") == F.col("a")).select("root", F.col("b").alias("id")).distinct()
        frontier = reached.join(seen.select("root", "id"), ["root", "id"], "left_anti")
        frontier = keep(frontier) if hop < hops else frontier
        seen = seen.unionByName(frontier.withColumn("hop", F.lit(hop)))
    return seen


def lineage(edges: DataFrame, roots: DataFrame, depth: int = 3, forward: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """``(root, id, depth)`` of directed walks of 1..depth steps (at most 5) from each root ``(id)``."""
    keep = scratch.keep if scratch else lambda df: df
    step = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")) if forward else edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    step = keep(step.distinct())
    level = roots.select(F.col("id").alias("root"), "id").distinct()
    levels = []
    most = min(max(depth, 1), 5)
    for d in range(1, most + 1):
        level = level.join(step, F.col("id") == F.col("a")).select("root", F.col("b").alias("id")).distinct()
        level = keep(level) if d < most else level
        levels.append(level.withColumn("depth", F.lit(d)))
    return reduce(DataFrame.unionByName, levels)


def lineage_both(edges: DataFrame, roots: DataFrame, depth: int = 4, limit: int = 200) -> dict[str, DataFrame]:
    """Walks down and up from the roots, the first ``limit`` of each by depth and id."""
    return {d: lineage(edges, roots, depth, d == "down").select("id", "depth").distinct().orderBy("depth", "id").limit(limit) for d in ("down", "up")}


def detail_counts(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, out_n, in_n)`` of every note."""
    o = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o"))
    i = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i"))
    n = notes.select("id").join(o, "id", "left").join(i, "id", "left")
    return n.select("id", F.coalesce("o", F.lit(0)).cast("long").alias("out_n"), F.coalesce("i", F.lit(0)).cast("long").alias("in_n"))


def resolve_ids(raws: DataFrame, notes: DataFrame, prefix: str = "wiki/") -> DataFrame:
    """``(raw, id)`` of texts ``(raw)``: an id as it is, else the id of a path, else the only note with that slug, else null."""
    bare = F.regexp_replace(F.regexp_replace("raw", rf"^\Q{prefix}\E", ""), r"\.md$", "")
    r = raws.select("raw").distinct().withColumn("_p", F.replace(bare, F.lit("/"), F.lit("-")))
    ids = notes.select("id").distinct()
    one = notes.groupBy("slug").agg(F.min("id").alias("_s"), F.countDistinct("id").alias("n")).where("n = 1").select(F.col("slug").alias("raw"), "_s")
    r = r.join(ids.select(F.col("id").alias("raw"), F.col("id").alias("_a")), "raw", "left").join(ids.select(F.col("id").alias("_p"), F.col("id").alias("_b")), "_p", "left").join(one, "raw", "left")
    return r.select("raw", F.coalesce("_a", "_b", "_s").alias("id"))


def list_notes(notes: DataFrame, kind: str | None = None, status: str | None = None, tag: str | None = None, limit: int = 50) -> DataFrame:
    """``(id, title, kind, status, updated)`` of the notes that have all that is given, by id; at most 500."""
    for column, v in (("kind", kind), ("status", status)):
        notes = notes if v is None else notes.where(F.col(column) == v)
    notes = notes if tag is None else notes.where(F.array_contains("tags", tag))
    return notes.select("id", "title", "kind", "status", "updated").orderBy("id").limit(min(limit, 500))


def facet_filter(notes: DataFrame, kinds=None, statuses=None, tags=None, hits: DataFrame | None = None, since=None, until=None) -> DataFrame:
    """Notes of one of the kinds and statuses ('(none)' is a null or empty one), with any of the tags, among the hits
    ``(id)``, last updated between two days. What is None does not count."""
    for column, values in (("kind", kinds), ("status", statuses)):
        if values is not None:
            notes = notes.where(F.coalesce(F.nullif(column, F.lit("")), F.lit("(none)")).isin(*values))
    if tags is not None:
        notes = notes.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if hits is not None:
        notes = notes.join(hits.select("id"), "id", "left_semi")
    if since is not None or until is not None:
        notes = notes.where(F.col("updated").between(F.lit(since or "0001-01-01").cast("date"), F.lit(until or "9999-12-31").cast("date")))
    return notes


def tag_counts(notes: DataFrame, most: int | None = None) -> DataFrame:
    """``(tag, n)``, the commonest first."""
    t = notes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")
    return t if most is None else t.limit(most)


def tag_dictionary(notes: DataFrame) -> DataFrame:
    """``(tag)``: every tag once, in order."""
    return notes.select(F.explode("tags").alias("tag")).where("tag is not null").distinct().orderBy("tag")


def linked_pairs(edges: DataFrame) -> DataFrame:
    e = edges.where("dst_type = 'Note' and src <> dst")
    return e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def orphans(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id)`` of notes without any edge in or out, tags aside."""
    e = edges.where("edge <> 'TAGGED'")
    ids = notes.select("id")
    return ids.join(e.select(F.col("src").alias("id")), "id", "left_anti").join(e.select(F.col("dst").alias("id")), "id", "left_anti")


def stale(notes: DataFrame, today, days: int) -> DataFrame:
    """Notes last updated before today - days; an unknown date is never stale."""
    return notes.where(F.col("updated") < F.date_sub(F.lit(today).cast("date"), days)).select("id", "updated")


def contradictions(edges: DataFrame, evidence: DataFrame | None = None, edge: str = "CONTRADICTS") -> DataFrame:
    """``(src, dst)`` of contradicting notes, both among the evidence ``(id)`` if given."""
    e = edges.where(F.col("edge") == edge).select("src", "dst")
    if evidence is not None:
        e = e.join(evidence.select(F.col("id").alias("src")), "src", "left_semi").join(evidence.select(F.col("id").alias("dst")), "dst", "left_semi")
    return e.select("src", "dst")


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, degree, size)`` where size grows with the root of the degree between 2.5 and 14."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("n"))
    d = nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("degree"))
    return d.withColumn("size", F.round(F.least(F.lit(14.0), F.greatest(F.lit(2.5), 2 + 1.6 * F.sqrt("degree"))), 6))


def facet(df: DataFrame, column: str) -> DataFrame:
    """Counts of a column's values; null and empty are '(none)'."""
    v = F.when(F.col(column).isNull() | (F.col(column) == ""), "(none)").otherwise(F.col(column))
    return df.groupBy(v.alias("value")).agg(F.count("*").alias("n"))


def already_ingested(edges: DataFrame, paths: DataFrame, edge: str = "SOURCE_OF") -> DataFrame:
    """``(src, dst)`` of notes that cite one of the resource paths ``(rel_path)``."""
    hit = edges.where(F.col("edge") == edge).join(paths.select(F.col("rel_path").alias("dst")), "dst", "left_semi")
    return hit.select("src", "dst")


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Modularity of communities ``(id, community)`` over undirected note-to-note edges, each pair once."""
    adj = undirected(edges).where("a <> b")
    l = labels.select("id", "community")
    e = adj.join(l.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(l.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    r = e.agg(F.count("*").alias("m2"), F.count_if(F.col("ca") == F.col("cb")).alias("inside")).first()
    if not r.m2:
        return 0.0
    k = e.groupBy("ca").agg(F.count("*").alias("k")).agg(F.sum((F.col("k") / r.m2) ** 2)).first()[0]
    return r.inside / r.m2 - k


def communities(edges: DataFrame, scratch: Scratch, rounds: int = 6, levels: int = 3) -> DataFrame:
    """``(id, community)`` by modularity: notes move to the neighbouring community that gains most, then communities
    become the nodes of a smaller graph, and so on.

    In a round only one half of the nodes, by a hash, may move, so two never swap for ever; of equal gains the
    smallest label wins. All steps are joins and aggregates; nothing is collected but one number a round. A community
    is named by its smallest id. Notes without an edge have no row.
    """
    adj = scratch.keep(undirected(edges).where("a <> b").groupBy("a", "b").agg(F.lit(1.0).alias("w")))
    of = scratch.keep(adj.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id")))
    m2 = adj.count()
    if not m2:
        return of
    for _ in range(levels):
        lab = scratch.keep(adj.select(F.col("a").alias("id")).distinct().withColumn("c", F.col("id")))
        deg = scratch.keep(adj.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")))
        moves = 0
        for r in range(rounds):
            tot = lab.join(deg, "id").groupBy("c").agg(F.sum("k").alias("t"))
            # weights from each node to the communities around it; its own counts even where nothing links to it
            near = adj.where("a <> b").join(lab.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id"), "c").agg(F.sum("w").alias("w"))
            near = near.unionByName(lab.select("id", "c", F.lit(0.0).alias("w"))).groupBy("id", "c").agg(F.sum("w").alias("w"))
            own = lab.withColumnRenamed("c", "was").join(deg, "id")
            g = near.join(own, "id").join(tot, "c")
            gain = F.round(F.col("w") - F.col("k") * (F.col("t") - F.when(F.col("c") == F.col("was"), F.col("k")).otherwise(0.0)) / m2, 9)
            best = g.withColumn("gain", gain).groupBy("id").agg(F.max_by("c", F.struct("gain", (F.col("c") == F.col("was")).alias("stays"))).alias("best"), F.max("gain").alias("gain"), F.first("was").alias("was"), F.max(F.when(F.col("c") == F.col("was"), F.col("gain"))).alias("stay"))
            first = g.withColumn("gain", gain).join(best.select("id", F.col("gain").alias("top")), "id").where("gain = top").groupBy("id").agg(F.min("c").alias("least"))
            may = F.pmod(F.xxhash64("id", F.lit(r // 2)), F.lit(2)) == r % 2
            nxt = scratch.keep(best.join(first, "id").select("id", F.when(may & (F.col("gain") > F.col("stay")), F.col("least")).otherwise(F.col("was")).alias("c"), "was"))
            moved = nxt.where("c <> was").count()
            scratch.drop(lab)
            lab = nxt.drop("was")
            moves += moved
            if not moved and r % 2:
                break
        if not moves:
            break
        names = lab.groupBy("c").agg(F.min("id").alias("n"))
        lab = scratch.keep(lab.join(names, "c").select("id", F.col("n").alias("c")))
        of = scratch.keep(of.join(lab.withColumnRenamed("id", "community"), "community").select("id", F.col("c").alias("community")))
        nxt = adj.join(lab.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(lab.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
        adj = scratch.keep(nxt.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
    names = of.groupBy("community").agg(F.min("id").alias("n"))
    return of.join(names, "community").select("id", F.col("n").alias("community"))

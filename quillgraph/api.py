"""The query surface of a published vault: every method gives a DataFrame or a plain dict of them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import ask as ask_
from quillgraph.operators import checks, graph, resolve, search, vectors
from quillgraph.runtime import Scratch
from quillgraph.sources import files
from quillgraph.sources.config import Config
from quillgraph.sources.snapshot import SnapshotStore


class VaultView:
    """Reads the last published tables; build a new view to see a later sync."""

    def __init__(self, spark: SparkSession, store: SnapshotStore, cfg: Config = Config(), provider=None, teacher=None):
        self.spark, self.cfg, self.provider, self.teacher = spark, cfg, provider, teacher
        tables = store.state()["tables"]
        if "notes" not in tables:
            raise ValueError("nothing has been published yet")
        self.notes, self.resources, self.edges = (store.read(tables[n]) for n in ("notes", "resources", "edges"))
        self.index = {n: store.read(tables[n]) for n in ("postings", "terms", "index_stats")} if "postings" in tables else None
        self.nodes = graph.node_view(self.notes, resolve.resources_with_stubs(self.resources, self.edges))
        for name in ("notes", "resources", "edges", "nodes"):
            getattr(self, name).createOrReplaceTempView({"notes": "note", "resources": "resource", "edges": "edges", "nodes": "nodes_all"}[name])

    def query(self, sql: str, **args) -> DataFrame:
        """Any SQL over note, resource, edges and nodes_all; parameters are bound, not spliced."""
        return self.spark.sql(sql, args=args)

    def resolve_id(self, raw: str) -> str | None:
        """An id, a path, or a slug that one note has."""
        one = self.spark.createDataFrame([(raw,)], "raw string")
        return graph.resolve_ids(one, self.notes, self.cfg.vault.id_strip_prefix).first().id

    def _described(self, hits: DataFrame) -> DataFrame:
        return hits.join(self.notes.select("id", "title", "kind", "status"), "id").orderBy(F.desc("score"), "id")

    def _asked(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(0, text)], "query_id int, query string")

    def search(self, text: str, k: int = 10) -> DataFrame:
        """By words, over the stored index; where there is none, by substring of id and title."""
        k = min(k, 100)
        if self.index is None:
            return search.contains(self.notes, text, cap=k).select("id", "title", "kind", "status", F.lit(0.0).alias("score"))
        return self._described(search.index_search(self.index, self._asked(text), k).select("id", "score"))

    def hybrid(self, text: str, k: int = 10) -> DataFrame:
        """By words and, with a provider, by meaning."""
        return self._described(ask_.hybrid_search(self._asked(text), self.notes, min(k, 50), self.provider, self.index).select("id", "score"))

    def _embedded(self) -> DataFrame:
        if "embedding" not in self.notes.columns:
            raise ValueError("the notes have no embeddings")
        return self.notes.where("embedding is not null and size(embedding) > 0").select("id", "embedding")

    def semantic_search(self, text: str, k: int = 10) -> DataFrame:
        """``(id, title, kind, status, score)`` of the notes nearest to a text in meaning."""
        if self.provider is None:
            raise ValueError("no embedding provider")
        hits = ask_.vector_hits(ask_.query_vectors(self._asked(text), self.provider), self._embedded(), min(k, 50))
        return self._described(hits.select("id", "score"))

    def embedding(self, raw: str) -> list[float] | None:
        """The stored embedding of a note."""
        row = self._embedded().where(F.col("id") == self.resolve_id(raw)).first()
        return None if row is None else list(row.embedding)

    def similar_notes(self, raw: str, k: int = 10, exclude_linked: bool = False) -> DataFrame:
        """``(id, title, kind, status, score, linked)``: the k notes nearest to a note; linked ones are left out after that."""
        i = self.resolve_id(raw)
        v = None if i is None else self.embedding(i)
        if v is None:
            raise ValueError(f"{raw} has no embedding")
        me = self.spark.createDataFrame([(i, v)], "query_id string, v array<double>")
        hits = ask_.vector_hits(me, self._embedded().where(F.col("id") != i), min(k, 50)).select("id", "score")
        got = search.flag_linked(hits, graph.linked_pairs(self.edges), i)
        return self._described(got.where("not linked") if exclude_linked else got)

    def similarity(self, k: int = 5, min_score: float = 0.6, unlinked_only: bool = False, among: DataFrame | None = None) -> DataFrame:
        """``(a, b, score, linked)`` over the whole vault, the best first."""
        v = self._embedded().select("id", F.col("embedding").alias("v"))
        found = vectors.neighbours(v, Scratch(self.spark, "similarity"), min(k, 10))
        return search.similarity_pairs(found, graph.linked_pairs(self.edges), min_score, unlinked_only, among)

    def ask(self, question: str) -> dict:
        if self.teacher is None:
            raise ValueError("no chat provider")
        return ask_.ask(question, self.notes, self.edges, self.teacher, provider=self.provider, index=self.index)

    def expand(self, ids: list[str], hops: int = 1) -> DataFrame:
        return graph.expand(self.edges, self.spark.createDataFrame([(i,) for i in ids], "id string"), hops)

    def documents(self) -> DataFrame:
        return search.search_docs(self.notes)

    def markdown(self, raw: str, root: str) -> str | None:
        """The file of a note as it is now; None where it has gone."""
        row = self.notes.where(F.col("id") == self.resolve_id(raw)).select("path").first()
        if row is None:
            return None
        got = files.contents(self.spark.createDataFrame([(row.path, f"file:{root.rstrip('/')}/{row.path}" if "://" not in root else f"{root.rstrip('/')}/{row.path}")], "rel_path string, uri string")).first()
        return None if got is None else bytes(got.content).decode("utf-8", "replace")

    def get_note(self, raw: str) -> dict:
        i = self.resolve_id(raw)
        return {"note": self.notes.where(F.col("id") == i), "out": self.neighbours(i or "", direction="out", limit=100), "backlinks": self.neighbours(i or "", direction="in", limit=100)}

    def neighbours(self, note: str, edge: str = "*", direction: str = "both", limit: int = 25):
        if edge not in ("*", "TAGGED", *[e.name for e in self.cfg.edges]):
            raise ValueError(f"unknown edge {edge}")
        one = lambda d: graph.neighbours(self.edges, self.nodes, note, d, edge, limit)
        return {d: one(d) for d in ("out", "in")} if direction == "both" else one(direction)

    def lineage(self, note: str, max_depth: int = 3, forward: bool = True, limit: int = 100) -> DataFrame:
        roots = self.spark.createDataFrame([(note,)], "id string")
        got = graph.lineage(self.edges.where("edge <> 'TAGGED'"), roots, max_depth, forward)
        return got.join(self.nodes, "id").select("node_type", "id", "title", "depth").distinct().orderBy("depth", "id").limit(limit)

    def lineage_both(self, note: str, depth: int = 4, limit: int = 200) -> dict:
        """What a note leads to and what leads to it, with types and titles."""
        roots = self.spark.createDataFrame([(note,)], "id string")
        both = graph.lineage_both(self.edges.where("edge <> 'TAGGED'"), roots, depth, limit)
        return {d: got.join(self.nodes, "id").select("node_type", "id", "title", "depth").orderBy("depth", "id") for d, got in both.items()}

    def list_notes(self, kind: str | None = None, status: str | None = None, tag: str | None = None, limit: int = 50) -> DataFrame:
        return graph.list_notes(self.notes, kind, status, tag, limit)

    def tags(self) -> DataFrame:
        return graph.tag_dictionary(self.notes)

    def symbols(self, typed: str) -> DataFrame:
        return search.contains(self.notes, typed).select("id", "title", "path")

    def health(self, today: dt.date | None = None) -> dict:
        days = self.cfg.diagnostics.stale_after_days
        return {
            "orphans": graph.orphans(self.notes, self.edges).orderBy("id").limit(500),
            "orphans_by_links": graph.orphans(self.notes, self.edges.where(F.col("edge").isin([e.name for e in self.cfg.edges if e.source == "wikilinks"]))),
            "contradictions": graph.contradictions(self.edges),
            "stale": self.notes.limit(0).select("id", "updated") if days is None else graph.stale(self.notes, today or dt.date.today(), days).orderBy("updated", "id"),
            "counts": self.edges.groupBy("edge").agg(F.count("*").alias("n")),
        }

    def diagnostics(self) -> DataFrame:
        d = self.cfg.diagnostics
        gate = {"broken_link": d.broken_link, "ambiguous_link": d.ambiguous_link, "unknown_kind": self.cfg.unknown_kind, "missing_field": "warn"}
        return checks.diagnostics(self.notes, self.cfg.kinds, {k: tuple(v) for k, v in d.required_fields.items()}, gate)

    def graph(self, resources: bool = False) -> dict:
        e = self.edges.where("edge <> 'TAGGED'")
        n = self.notes.select("id", F.col("title").alias("label"), "kind", "status", "updated", "tags", "dir", "path").orderBy("id")
        return {"nodes": n, "edges": (e if resources else e.where("dst_type = 'Note'")).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("edge").alias("type")).orderBy("source", "target", "type")}

    def meta(self) -> dict:
        return {"kinds": list(self.cfg.kinds), "edges": [e.name for e in self.cfg.edges], "has_resources": self.cfg.resources is not None, "stale_after_days": self.cfg.diagnostics.stale_after_days}

    def json_rows(self, df: DataFrame) -> DataFrame:
        return df.select(F.to_json(F.struct("*")).alias("json"))

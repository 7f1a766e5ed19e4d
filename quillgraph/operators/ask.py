"""Question answering over the graph and the gates around model calls. Models are injected."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.markup import parse_reply, tolerant_list
from quillgraph.operators import graph, search


class ChatProvider(Protocol):
    def complete(self, task: str, messages: list[dict], temperature: float = 0.0) -> str: ...


class EmbeddingProvider(Protocol):
    dim: int

    def embed(self, text: str) -> list[float]: ...


class HashingEmbedder:
    """A deterministic embedder for tests: signed hashes of words, cut to a number of characters."""

    def __init__(self, dim: int = 64, char_cap: int = 7000):
        self.dim, self.char_cap = dim, char_cap

    def embed(self, text: str) -> list[float]:
        v = [0.0] * self.dim
        for w in re.findall(r"\w+", (text[: self.char_cap] or " ").lower()):
            h = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big")
            v[h % self.dim] += 1.0 if h >> 63 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v


class Capped:
    """A provider held to its contract: texts cut to a number of characters, a blank for an empty one, and while the
    server fails (an error with a status of 500 or more) half the text again, down to ``least`` characters.

    ``embed_query`` puts the instruction before a query.
    """

    def __init__(self, provider: EmbeddingProvider, char_cap: int = 7000, instruction: str = "", least: int = 1000):
        self.provider, self.char_cap, self.instruction, self.least = provider, char_cap, instruction, least
        self.dim = provider.dim

    def embed(self, text: str) -> list[float]:
        cap = self.char_cap
        while True:
            try:
                return self.provider.embed(text[:cap] or " ")
            except Exception as e:
                if getattr(e, "status", 0) < 500 or cap <= self.least:
                    raise
                cap //= 2

    def embed_query(self, text: str) -> list[float]:
        return self.embed(f"Instruct: {self.instruction}\nQuery: {text}" if self.instruction else text)


def make_provider(cfg, known: dict[str, Callable]) -> Capped:
    """The provider that the embeddings section names, from factories ``name -> f(section)``, tried once: a
    misconfigured one, or one of another dimension than configured, fails here rather than at every note."""
    if cfg.provider not in known:
        raise ValueError(f"unknown embedding provider {cfg.provider}")
    got = Capped(known[cfg.provider](cfg), cfg.char_cap, cfg.query_instruction)
    n = len(got.embed("startup probe"))
    if n != cfg.dim:
        raise ValueError(f"provider {cfg.provider} gives {n} numbers, the configuration says {cfg.dim}")
    got.dim = n
    return got


def query_vectors(queries: DataFrame, provider) -> DataFrame:
    """``(query_id, v)``: the vectors of a few questions, embedded here; those that fail are left out."""
    embed = getattr(provider, "embed_query", provider.embed)
    out = []
    for r in queries.select("query_id", "query").collect():  # questions of one call: a handful
        try:
            out.append((r.query_id, [float(x) for x in embed(r.query)]))
        except Exception:  # noqa: BLE001 - the text leg goes on alone
            continue
    return queries.sparkSession.createDataFrame(out, f"query_id {dict(queries.dtypes)['query_id']}, v array<double>")


def vector_hits(queries: DataFrame, notes: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, score, rank)``: the k notes ``(id, embedding)`` nearest to each query vector ``(query_id, v)``."""
    spark = notes.sparkSession
    kind = dict(queries.dtypes)["query_id"]
    asked = queries.select(F.concat(F.lit("q:"), F.col("query_id").cast("string")).alias("vec_id"), F.col("v").alias("embedding"))
    data = notes.where("embedding is not null and size(embedding) > 0").select(F.concat(F.lit("n:"), F.col("id")).alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    if not asked.limit(1).count():
        return spark.createDataFrame([], f"query_id {kind}, id string, score double, rank int")
    got = search.nearest(asked, data, k)
    return got.select(F.substring("query", 3, 1_000_000).cast(kind).alias("query_id"), F.substring("id", 3, 1_000_000).alias("id"), "score", "rank")


def hybrid_search(queries: DataFrame, notes: DataFrame, k: int, provider=None, index: dict[str, DataFrame] | None = None) -> DataFrame:
    """``(query_id, id, score, rank)`` for queries ``(query_id, query)`` over notes: words (over a stored index if there
    is one) and, with a provider, vectors, fused by reciprocal rank. Used by ask, the facade and candidate pages."""
    if index is not None:
        text = search.index_search(index, queries, 2 * k)
    else:
        text = search.bm25_batch(notes.select("id", F.concat_ws(" ", "title", "body_text").alias("text")), queries, 2 * k)
    vec = None if provider is None or "embedding" not in notes.columns else vector_hits(query_vectors(queries, provider), notes, 2 * k)
    return search.hybrid(text, vec, k)


def candidate_pages(claims: list[str], names: list[str], notes: DataFrame, cap: int = 16, provider=None, index: dict[str, DataFrame] | None = None) -> DataFrame:
    """``(id, title, kind, score)``: pages that a capture's claims (the best 6 of each) and names (the best 4) point to."""
    spark = notes.sparkSession
    asked = [(i, c, 6) for i, c in enumerate(claims)] + [(len(claims) + i, n, 4) for i, n in enumerate(names)]
    q = spark.createDataFrame(asked, "query_id int, query string, most int")
    parts = [hybrid_search(q.where(F.col("most") == m), notes, m, provider, index) for m in (6, 4)]
    got = search.candidate_pages(parts[0].unionByName(parts[1]).withColumn("run", F.lit(0)), cap)
    return got.join(notes.select("id", "title", "kind"), "id").select("id", "title", "kind", "score").orderBy(F.desc("score"), "id")


@dataclass
class Recorded:
    """Calls a provider, parses the reply, tries once more with some heat, and keeps a record of each."""

    provider: ChatProvider
    records: list[dict] = field(default_factory=list)

    def call(self, task: str, messages: list[dict]):
        for heat in (0.0, 0.7):
            raw = self.provider.complete(task, messages, heat)
            value = parse_reply(raw)
            self.records.append({"seq": len(self.records) + 1, "task": task, "messages": messages, "raw_output": raw, "parsed_ok": value is not None})
            if value is not None:
                return value
        return None


@dataclass(frozen=True)
class Limits:
    seeds: int = 6
    hops: int = 1
    notes: int = 14
    body_chars: int = 1600
    questions: int = 4
    per_hop: int = 200


def ask(question: str, notes: DataFrame, edges: DataFrame, teacher: Recorded, limits: Limits = Limits(), provider=None, index: dict[str, DataFrame] | None = None) -> dict:
    """Decompose, retrieve by words and vectors, expand, synthesise, and keep only citations of the evidence.

    Notes are ``(id, title, body_text)``, with ``embedding`` where a provider is given. Evidence is cut in order of
    id. Without evidence there is no model call but an abstention.
    """
    plan = teacher.call("decompose", [{"role": "user", "content": question}])
    parts = tolerant_list(plan.get("subquestions") if isinstance(plan, dict) else plan)[: limits.questions] or [question]
    asked = notes.sparkSession.createDataFrame(list(enumerate(parts)), "query_id int, query string")
    hits = hybrid_search(asked, notes, limits.seeds, provider, index).select("id").distinct()
    ids = graph.expand(edges, hits, limits.hops, per_hop=limits.per_hop).select("id").distinct()
    evidence = notes.join(ids, "id", "left_semi").select("id", "title", F.substring("body_text", 1, limits.body_chars).alias("body")).orderBy("id").limit(limits.notes).collect()
    if not evidence:
        return {"question": question, "text": "The notes hold nothing on this.", "citations": [], "contradictions": [], "notes_considered": 0, "abstained": True}
    known = notes.sparkSession.createDataFrame([(r.id,) for r in evidence], "id string")
    against = [tuple(r) for r in graph.contradictions(edges, known).orderBy("src", "dst").collect()]
    context = "\n\n".join(f"### [{r.id}] {r.title}\n{r.body}" for r in evidence) + "".join(f"\n{a} contradicts {b}" for a, b in against)
    reply = teacher.call("synthesize", [{"role": "user", "content": f"Question: {question}\n\nNotes:\n{context}"}])
    reply = reply if isinstance(reply, dict) else {}
    abstained = bool(reply.get("abstained")) or not reply.get("answer")
    have = {r.id for r in evidence}
    cites = [] if abstained else list(dict.fromkeys(c for c in tolerant_list(reply.get("citations")) if c in have))
    return {"question": question, "text": reply.get("answer") or "", "citations": cites, "contradictions": against, "notes_considered": len(evidence), "abstained": abstained or not cites}


def embedding_due(exclude_kinds: tuple[str, ...] = ()) -> Column:
    """Whether a note's embedding is missing or of an older body; notes of some kinds never get one."""
    return ~F.col("embedded_hash").eqNullSafe(F.col("body_hash")) & ~F.coalesce("kind", F.lit("")).isin(*exclude_kinds)


def embed_missing(notes: DataFrame, make: Callable[[], EmbeddingProvider], exclude_kinds: tuple[str, ...] = ()) -> DataFrame:
    """Notes with embeddings brought up to their bodies, and ``embed_error``; a failed call keeps the old hash, so it is
    tried again, and says why.

    ``make`` builds the provider once for each task, on the rows that are due only; a provider with ``embed_many``
    gets a batch at a time.
    """
    due = embedding_due(exclude_kinds)
    stale = notes.where(due)
    schema = stale.select("id", "body_text").schema["id"].dataType.simpleString()

    def run(batches):
        provider = make()
        for b in batches:
            texts = [t or " " for t in b.column("body_text").to_pylist()]
            out, why = [], []
            many = getattr(provider, "embed_many", None)
            try:
                got = many(texts) if many else None
            except Exception as e:  # noqa: BLE001 - the batch is tried one by one
                got = None
                del e
            for i, t in enumerate(texts):
                try:
                    out.append(got[i] if got else provider.embed(t))
                    why.append(None)
                except Exception as e:  # noqa: BLE001 - told in the row
                    out.append(None)
                    why.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.list_(pa.float32())), pa.array(why, pa.string())], names=["id", "_e", "_why"])

    got = stale.select("id", "body_text").mapInArrow(run, f"id {schema}, _e array<float>, _why string")
    fresh = stale.drop("embedding").join(got, "id")
    fresh = fresh.withColumn("embedded_hash", F.when(F.col("_e").isNotNull(), F.col("body_hash")).otherwise(F.col("embedded_hash")))
    fresh = fresh.withColumnRenamed("_e", "embedding").withColumnRenamed("_why", "embed_error")
    return notes.where(~due).withColumn("embed_error", F.lit(None).cast("string")).unionByName(fresh)

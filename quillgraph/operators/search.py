"""Full-text ranking with and without a stored index, rank fusion, exact vector search and hybrid retrieval."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import NON_WORD
from quillgraph.runtime import spread

K1, B, RRF = 1.2, 0.75, 60
BLOCK = 4096


def bm25(docs: DataFrame, query: str, k: int | None = 10, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of the k best documents; all matches when k is None.

    One pass: term frequencies of the query's terms are counted inside each row, and only rows with a
    hit go on. The collection's size, mean length and document frequencies are one row, joined back.
    Null texts are empty documents.
    """
    terms = [t for t in dict.fromkeys(_split(query)) if len(t.encode()) > 1]
    words = F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), NON_WORD), lambda w: w != "")
    base = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("id"), words.alias("w"))
    base = base.select("id", F.size("w").alias("dl"), F.filter("w", lambda x: x.isin(terms)).alias("w"))
    base = base.select("id", "dl", *[_occurrences("w", t).alias(f"t{i}") for i, t in enumerate(terms)])
    if not terms:
        return base.where("false").select("id", F.lit(0.0).alias("score"))
    stats = base.agg(F.count("*").alias("n"), F.avg("dl").alias("al"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(terms))])
    hit = base.where(" or ".join(f"t{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))  # stats is one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        tf = F.col(f"t{i}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("al")))
    out = hit.select("id", F.round(score, 6).alias("score"))
    return out if k is None else out.orderBy(F.desc("score"), "id").limit(k)


def _occurrences(words: str, term: str):
    return F.size(F.filter(words, lambda x: x == F.lit(term)))


def _split(text: str) -> list[str]:
    import re

    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(term, id, tf)``: the inverted index, for writing partitioned or bucketed by term."""
    w = F.explode(F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), NON_WORD), lambda x: x != ""))
    return docs.select(F.col(id_col).alias("id"), w.alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))


def _query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, term)`` of queries ``(query_id, query)``."""
    return queries.select("query_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("query"), NON_WORD), lambda w: F.octet_length(w) > 1))).alias("term"))


def _ranked(q: DataFrame, post: DataFrame, df: DataFrame, stats: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, score, rank)`` from query terms, postings ``(term, id, tf, dl)``, ``(term, df)`` and one row ``(n, total)``."""
    m = q.join(post, "term").join(df, "term").crossJoin(F.broadcast(stats))  # stats is one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") * F.col("n") / F.col("total")))
    s = m.groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_batch(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(query_id, id, score, rank)`` for many queries ``(query_id, query)`` in one join on terms.

    Words that no query has are dropped before anything moves; a text's length travels in its own rows.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), NON_WORD), lambda x: x != "")
    base = docs.select(F.col(id_col).alias("id"), words.alias("w")).select("id", "w", F.size("w").alias("dl"))
    q = _query_terms(queries)
    hits = base.select("id", "dl", F.explode("w").alias("term")).join(q.select("term").distinct(), "term", "left_semi")
    post = hits.groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
    stats = base.agg(F.count("*").alias("n"), F.sum("dl").alias("total"))
    return _ranked(q, post, post.groupBy("term").agg(F.count("*").alias("df")), stats, k)


#: Partitions of the stored index.
BUCKETS = 64


def _bucket(term):
    return F.pmod(F.crc32(F.encode(term, "utf-8")), F.lit(BUCKETS)).cast("int")


def index_tables(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> dict[str, DataFrame]:
    """The stored index: postings ``(term, id, tf, dl, bucket)``, terms ``(term, df, bucket)``, index_stats ``(n, total)``.

    Write the first two partitioned by bucket: a search then reads the buckets of its own words only.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), NON_WORD), lambda x: x != "")
    base = docs.select(F.col(id_col).alias("id"), words.alias("w")).select("id", "w", F.size("w").alias("dl"))
    post = base.select("id", "dl", F.explode("w").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf")).withColumn("bucket", _bucket(F.col("term")))
    terms = post.groupBy("term", "bucket").agg(F.count("*").alias("df"))
    return {"postings": post.select("term", "id", "tf", "dl", "bucket"), "terms": terms.select("term", "df", "bucket"), "index_stats": base.agg(F.count("*").alias("n"), F.sum("dl").alias("total"))}


def index_search(index: dict[str, DataFrame], queries: DataFrame, k: int) -> DataFrame:
    """``bm25_batch`` over a stored index. The buckets read are those of the queries' words, at most BUCKETS of them."""
    q = _query_terms(queries)
    buckets = [r.b for r in q.select(_bucket(F.col("term")).alias("b")).distinct().collect()]
    own = lambda name: index[name].where(F.col("bucket").isin(buckets)).drop("bucket")
    return _ranked(q, own("postings"), own("terms"), index["index_stats"], k)


def rrf(ranked: DataFrame, k: int | None = None) -> DataFrame:
    """``(id, score)`` from ranked lists ``(leg, id, score)``: the sum of 1 / (60 + rank from 0)."""
    w = Window.partitionBy("leg").orderBy(F.desc("score"), "id")
    out = ranked.withColumn("r", F.row_number().over(w) - 1).groupBy("id").agg(F.round(F.sum(1.0 / (RRF + F.col("r"))), 9).alias("score"))
    return out if k is None else out.orderBy(F.desc("score"), "id").limit(k)


def fuse(lists: DataFrame, k: int, group: str = "query_id") -> DataFrame:
    """``(group, id, score, rank)``: reciprocal rank fusion of lists ``(group, leg, id, rank)`` with ranks from 1, by group."""
    s = lists.groupBy(group, "id").agg(F.round(F.sum(1.0 / (RRF + F.col("rank") - 1)), 9).alias("score"))
    w = Window.partitionBy(group).orderBy(F.desc("score"), "id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hybrid(text_hits: DataFrame, vector_hits: DataFrame | None, k: int) -> DataFrame:
    """``(query_id, id, score, rank)``: the two legs ``(query_id, id, rank)``, each of the best 2k, fused. Without vectors the text leg alone."""
    t = text_hits.where(F.col("rank") <= 2 * k).select("query_id", "id", "rank")
    if vector_hits is not None:
        t = t.unionByName(vector_hits.where(F.col("rank") <= 2 * k).select("query_id", "id", "rank"))
    return fuse(t, k)


def candidate_pages(hits: DataFrame, cap: int = 16) -> DataFrame:
    """``(run, id, score, rank)``: of hybrid lists ``(run, query_id, id, rank)`` for a run's claims (the best 6 each) and
    names (the best 4 each), the pages that rank best over all of them."""
    return fuse(hits, cap, "run")


def _blocks(df: DataFrame, name: str, id_col: str, vec_col: str, block: int, n: int) -> DataFrame:
    parts = max(1, -(-n // block))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_list()).astype(np.float32)
        return pd.DataFrame({"b": [int(pdf["b"].iloc[0])], "ids": [pdf["id"].tolist()], "x": [x.tobytes()]})

    kind = df.schema[id_col].dataType.simpleString()
    keyed = df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int").alias("b"))
    return keyed.groupBy("b").applyInPandas(pack, f"b int, ids array<{kind}>, x binary").select(F.col("b").alias(f"{name}b"), F.col("ids").alias(f"{name}ids"), F.col("x").alias(f"{name}x"))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def best_of(x: np.ndarray, y: np.ndarray, k: int, same: np.ndarray | None = None):
    """(row, column, cosine) of the k best columns of each row of unit vectors; equals of the last one kept come, too."""
    s = x @ y.T
    if same is not None:
        s[same] = -9
    m = min(k, s.shape[1])
    top = np.argpartition(-s, m - 1, axis=1)[:, :m]
    bar = np.take_along_axis(s, top, axis=1).min(axis=1)
    r, c = np.nonzero((s >= bar[:, None] - 1e-9) & (s > -5))
    return r, c, np.round(s[r, c], 6)


def nearest(queries: DataFrame, data: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", drop_self: bool = True, block: int = BLOCK) -> DataFrame:
    """``(query, id, score, rank)``: the exact k most similar vectors of each query vector by cosine.

    Both sides are packed into blocks of bounded size; each pair of blocks is one matrix product that
    keeps k rows a query, so nothing is broadcast and memory depends on the block alone. Vectors must
    be of one length; zero vectors score 0; ids are of any type. For all vectors against all of a large
    collection there is ``vectors.neighbours``.
    """
    nq, nd = queries.count(), data.count()
    q, d = _blocks(queries, "q", id_col, vec_col, block, nq), _blocks(data, "d", id_col, vec_col, block, nd)
    parts = max(1, -(-nq // block))
    met = d.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(q, "qb")
    kind = data.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for qi, qx, di, dx in zip(*(b.column(c).to_pylist() for c in ("qids", "qx", "dids", "dx"))):
                qi, di = np.array(qi), np.array(di)
                x, y = (unit(np.frombuffer(v, np.float32).reshape(len(i), -1)) for v, i in ((qx, qi), (dx, di)))
                for at in range(0, len(x), 256):
                    own = qi[at : at + 256]
                    r, c, s = best_of(x[at : at + 256], y, k, own[:, None] == di[None, :] if drop_self else None)
                    yield pa.RecordBatch.from_arrays([pa.array(own[r]), pa.array(di[c]), pa.array(s)], names=["query", "id", "score"])

    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return met.mapInArrow(run, f"query {kind}, id {kind}, score double").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similarity_pairs(found: DataFrame, linked: DataFrame | None = None, least: float = 0.6, unlinked_only: bool = False, among: DataFrame | None = None) -> DataFrame:
    """``(a, b, score, linked)``: undirected pairs of a neighbour list ``(query, id, score)``, best first, then by ids.

    With ``among`` ``(id)``, such as the notes a filter leaves, both ends must be in it.
    """
    p = found.where(F.col("score") >= least).groupBy(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b")).agg(F.max("score").alias("score"))
    if among is not None:
        p = p.join(among.select(F.col("id").alias("a")), "a", "left_semi").join(among.select(F.col("id").alias("b")), "b", "left_semi")
    if linked is None:
        p = p.withColumn("linked", F.lit(False))
    else:
        p = p.join(linked.select("a", "b", F.lit(True).alias("linked")), ["a", "b"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
        p = p.where(~F.col("linked")) if unlinked_only else p
    return p.select("a", "b", "score", "linked").orderBy(F.desc("score"), "a", "b")


def flag_linked(hits: DataFrame, linked: DataFrame, note) -> DataFrame:
    """Hits ``(id, score)`` of a note, by id or as a column, with ``linked``: whether the pair is among ``(a, b)``, a < b."""
    me = F.lit(note) if isinstance(note, str) else note
    p = hits.withColumn("a", F.least(me, F.col("id"))).withColumn("b", F.greatest(me, F.col("id")))
    p = p.join(linked.select("a", "b", F.lit(True).alias("linked")), ["a", "b"], "left")
    return p.withColumn("linked", F.coalesce("linked", F.lit(False))).drop("a", "b")


def contains(df: DataFrame, typed: str, columns: tuple[str, ...] = ("title", "id"), cap: int = 200) -> DataFrame:
    """Rows with a text in one of the columns, whatever the case, in order of id: symbol search, and what is left where there is no index."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(typed.lower()), F.lit(False))
    return df.where(hit).orderBy("id").limit(cap)


def search_docs(notes: DataFrame) -> DataFrame:
    """``(id, title, body, tags)``: what a client-side index is built from."""
    return notes.select("id", F.coalesce("title", "id").alias("title"), F.coalesce("body_text", F.lit("")).alias("body"), "tags")

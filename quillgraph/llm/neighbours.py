"""Problem 4: the most similar vectors of every vector.

Additive quantisation: each unit vector is approximated by a sum of full-dimensional codewords, one
from each of ``BOOKS`` residual codebooks, chosen by beam search. The norm of the approximation is
stored beside the codes. Queries score all codes of a block by tables of query-codeword products;
the best ``RERANK`` candidates of each query are then scored exactly on the full vectors.

The search is inverted: vectors lie in cells, and a query visits the cells nearest to its own. Cells have
about ``CELL`` vectors at every size: beyond ``COARSE`` of them each is a coarse centroid plus one of a shared
table of fine ones. How many cells to visit is measured on the training sample so that the true neighbours of
the sample's vectors are found with probability ``REACH``; where vectors have no structure this is most of the
cells, and recall is kept. Which cells a cell visits is found in tasks, from the two tables of centroids.
Cells are stored in blocks of at most ``BLOCK`` codes, so no cell, however many vectors crowd in it, is
one task's load. Equal vectors are one class and searched once; a class keeps its k + 1 smallest ids,
which is all that a list of k neighbours can show of it.

The codebooks are trained on a bounded sample (``SAMPLE`` classes with the smallest hashes); every vector
is indexed. README.md states the measured recall.

Defined results: a note's row with the latest synced_at counts (ties: the greater embedding); embeddings
that are null, not of length DIM, with a null, NaN or infinite entry or all zero are left out; equal
scores are ordered by id; with fewer than k other vectors all are listed; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.runtime import Scratch, spread

DIM, K = 128, 5
BOOKS, WORDS, BEAM = 32, 256, 4
SAMPLE = 16_384
RERANK = 32
BLOCK = 8192
CELL = 1500
#: Coarse and fine centroids at most; both are trained on the sample, with four vectors or more for each.
COARSE, FINE = 1024, 4096
#: Sample vectors whose neighbours' cells are ranked, and candidates reranked for each neighbour asked for, at least.
RANKED, PER_K = 4096, 4
#: Codes that one task of the search holds (about 25 MB).
SHARE_CODES = 1 << 19
REACH = 0.99
#: Fixed point of the tables, and the queries and codes scored together.
FIXED, QUERIES, STRIP = 6000, 256, 512


def usable(notes: DataFrame, dim: int = DIM, id_col: str = "id") -> DataFrame:
    """``(id, v)`` of each current note with a usable embedding."""
    cur = notes.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.struct("synced_at", "embedding")).alias("r"))
    v = cur.select("id", F.col("r.embedding").alias("v")).where(F.size("v") == dim)
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(fine & F.exists("v", lambda x: x != 0))


def _matrix(column, dim: int) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        order = np.argsort(near, kind="stable")
        at = np.searchsorted(near[order], np.arange(k))
        n = np.bincount(near, minlength=k)
        used = n > 0
        sums = np.add.reduceat(x[order], at[used], axis=0)
        c[used] = sums / n[used][:, None]
        if (~used).any():
            c[~used] = x[rng.choice(len(x), (~used).sum())]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(axis=1)
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(axis=1) for i in range(0, len(x), 4096)])


class Quantiser:
    """Residual codebooks, cells, and the number of cells a query visits."""

    def __init__(self, sample: np.ndarray, total: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        x = unit_rows(sample).astype(np.float32)
        want = max(1, round(total / CELL))
        self.coarse = _kmeans(x, min(want, COARSE, len(x)), rng)
        rest = x - self.coarse[_nearest(x, self.coarse)]
        fine = min(-(-want // len(self.coarse)), FINE, max(1, len(x) // 4))
        self.fine = _kmeans(rest, fine, rng) if fine > 1 else np.zeros((1, x.shape[1]), np.float32)
        self.books, rest = [], x.copy()
        words = min(WORDS, len(x))
        for _ in range(BOOKS):
            book = _kmeans(rest, words, rng, 6)
            self.books.append(book)
            rest -= book[_nearest(rest, book)]
        self.books = np.stack(self.books).astype(np.float32)
        self.visits = self._visits(x)

    def __len__(self) -> int:
        return len(self.coarse) * len(self.fine)

    def cell(self, x: np.ndarray) -> np.ndarray:
        c = _nearest(x, self.coarse)
        return c if len(self.fine) == 1 else c * len(self.fine) + _nearest(x - self.coarse[c], self.fine)

    def centre(self, cells: np.ndarray) -> np.ndarray:
        return self.coarse[cells // len(self.fine)] + self.fine[cells % len(self.fine)]

    def distances(self, cells: np.ndarray):
        """Blocks of (first cell, squared distances up to a constant) from the centres of some cells to those of all."""
        x = self.centre(cells)
        step = max(1, (1 << 16) // len(self.fine))
        for i in range(0, len(self.coarse), step):
            y = (self.coarse[i : i + step, None, :] + self.fine[None, :, :]).reshape(-1, x.shape[1])
            yield i * len(self.fine), 0.5 * (y * y).sum(axis=1) - x @ y.T

    def visited(self, cells: np.ndarray) -> np.ndarray:
        """The cells that queries of each given cell visit, nearest first, with its own."""
        near = np.zeros((len(cells), 0), np.int64)
        far = np.zeros((len(cells), 0), np.float32)
        for first, d in self.distances(cells):
            near = np.hstack([near, np.broadcast_to(np.arange(first, first + d.shape[1]), d.shape)])
            far = np.hstack([far, d])
            if near.shape[1] > self.visits:
                top = np.argpartition(far, self.visits - 1, axis=1)[:, : self.visits]
                near, far = np.take_along_axis(near, top, axis=1), np.take_along_axis(far, top, axis=1)
        return np.take_along_axis(near, np.argsort(far, axis=1, kind="stable"), axis=1)

    def _visits(self, x: np.ndarray) -> int:
        """Cells to visit so that REACH of the sample's true neighbours lie in them."""
        if len(self) == 1 or len(x) < 2:
            return len(self)
        cell = self.cell(x)
        seen = []
        for i in range(0, min(len(x), RANKED), 512):
            s = x[i : i + 512] @ x.T
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
            top = np.argpartition(-s, min(K, len(x) - 1) - 1, axis=1)[:, : min(K, len(x) - 1)]
            own, theirs = cell[i : i + 512], cell[top]
            half = 0.5 * (self.centre(theirs) ** 2).sum(axis=2)
            bar = half - np.einsum("id,ikd->ik", self.centre(own), self.centre(theirs))
            place = np.zeros(theirs.shape, np.int64)
            for _, d in self.distances(own):
                d.sort(axis=1)
                place += np.stack([np.searchsorted(row, b - 1e-6) for row, b in zip(d, bar)])
            seen.append(place.ravel())
        return min(len(self), int(np.quantile(np.concatenate(seen), REACH)) + 1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, norm of the sum of the chosen codewords) by beam search."""
        out, norms = [], []
        for i in range(0, len(x), 1024):
            part = x[i : i + 1024].astype(np.float32)
            n = len(part)
            rest = part[:, None, :]
            codes = np.zeros((n, 1, 0), np.uint8)
            for book in self.books:
                b = rest.shape[1]
                # squared distance of each residual to each codeword, up to nothing
                cost = (rest * rest).sum(axis=2)[:, :, None] - 2 * (rest.reshape(n * b, -1) @ book.T).reshape(n, b, -1) + (book * book).sum(axis=1)
                flat = cost.reshape(n, -1)
                keep = min(BEAM, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                parent, word = best // len(book), best % len(book)
                rest = np.take_along_axis(rest, parent[:, :, None], axis=1) - book[word]
                codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
            win = (rest * rest).sum(axis=2).argmin(axis=1)
            rows = np.arange(n)
            out.append(codes[rows, win])
            norms.append(np.linalg.norm(part - rest[rows, win], axis=1))
        return np.concatenate(out), np.concatenate(norms).astype(np.float32)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of each codeword with each query in fixed point, (BOOKS, words, queries)."""
        flat = self.books.reshape(-1, self.books.shape[2])
        t = np.clip(np.rint((flat @ q.T.astype(np.float32)) * np.float32(FIXED)), -32_000, 32_000).astype(np.int16, order="C")
        return t.reshape(len(self.books), -1, len(q))


def table_scores(tables: np.ndarray, codes: np.ndarray, scale: np.ndarray, sums: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Approximate cosines, (codes, queries): sums of looked-up products over stored norms.

    codes are (BOOKS, n); sums and spare are buffers of at least n rows, small enough for the cache.
    """
    n = codes.shape[1]
    s, t = sums[:n], spare[:n]
    np.take(tables[0], codes[0], axis=0, out=s, mode="clip")
    for b in range(1, len(tables)):
        np.take(tables[b], codes[b], axis=0, out=t, mode="clip")
        s += t
    return s * scale[:, None]


class Best:
    """The best candidates of each query so far, and the score a new one must exceed."""

    def __init__(self, queries: int, keep: int):
        self.keep, self.bar = keep, np.full(queries, -np.inf, np.float32)
        self.parts, self.n, self.room = [], 0, 4 * keep * queries

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        r, q = np.nonzero(scores > self.bar[None, :])
        if len(r):
            self.parts.append((q, scores[r, q], ids[r]))
            self.n += len(r)
            if self.n > self.room:
                self.settle()

    def settle(self):
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, s, c = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((c, -s, q))
        q, s, c = q[order], s[order], c[order]
        first = np.searchsorted(q, q, "left")
        nth = np.arange(len(q)) - first
        full = nth == self.keep - 1
        self.bar[q[full]] = s[full]
        top = nth < self.keep
        self.parts, self.n = [(q[top], s[top], c[top])], int(top.sum())
        self.room = max(4 * self.n, 1)
        return q[top], c[top]


def _encode_batches(model: Quantiser, dim: int):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = unit_rows(_matrix(b.column("v"), dim)).astype(np.float32)
            codes, norms = model.encode(x)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("c"),
                    pa.array(model.cell(x), pa.int64()),
                    pa.array([r.tobytes() for r in codes], pa.binary()),
                    pa.array(norms, pa.float32()),
                    pa.array([r.tobytes() for r in x], pa.binary()),
                ],
                names=["c", "cell", "codes", "norm", "x"],
            )

    return run


def _visit_batches(model: Quantiser):
    def run(batches):
        for b in batches:
            cells = b.column("cell").to_numpy()
            for i in range(0, len(cells), 64):
                own = cells[i : i + 64]
                met = model.visited(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, met.shape[1])), pa.array(met.ravel())], names=["qcell", "cell"])

    return run


def _search(model: Quantiser, rerank: int):
    """One block of queries against the code blocks of the cells it visits."""

    def run(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        if not len(queries) or not len(blocks):
            return pa.table({"q": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})
        q = np.frombuffer(b"".join(queries.column("x").to_pylist()), np.float32).reshape(len(queries), -1)
        qid = queries.column("c").to_numpy()
        stored = []
        for cs, codes, norms in zip(*(blocks.column(n).to_pylist() for n in ("cs", "codes", "norms"))):
            cs = np.frombuffer(cs, np.int64)
            codes = np.frombuffer(codes, np.uint8).reshape(len(cs), -1)
            scale = 1 / (FIXED * np.maximum(np.frombuffer(norms, np.float32), 1e-6))
            stored.append((cs, np.ascontiguousarray(codes.T), scale.astype(np.float32)))
        out_q, out_c = [], []
        sums, spare = np.empty((STRIP, QUERIES), np.int16), np.empty((STRIP, QUERIES), np.int16)
        for i in range(0, len(q), QUERIES):
            tables = model.tables(q[i : i + QUERIES])
            own = qid[i : i + QUERIES]
            best = Best(len(own), rerank + 1)  # one more, for the query itself
            a, b = np.ascontiguousarray(sums[:, : len(own)]), np.ascontiguousarray(spare[:, : len(own)])
            for cs, codes, scale in stored:
                for j in range(0, len(cs), STRIP):
                    strip = codes[:, j : j + STRIP].astype(np.intp)
                    best.add(table_scores(tables, strip, scale[j : j + STRIP], a, b), cs[j : j + STRIP])
            at, c = best.settle()
            other = own[at] != c
            out_q.append(own[at[other]])
            out_c.append(c[other])
        return pa.table({"q": np.concatenate(out_q).astype(np.int64), "c": np.concatenate(out_c).astype(np.int64)})

    return run


def _pack_blocks(t: pa.Table) -> pa.Table:
    return pa.table(
        {
            "cell": t.column("cell")[:1],
            "sub": t.column("sub")[:1],
            "cs": pa.array([t.column("c").to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "codes": pa.array([b"".join(t.column("codes").to_pylist())], pa.binary()),
            "norms": pa.array([t.column("norm").to_numpy().astype(np.float32).tobytes()], pa.binary()),
        }
    )


def _exact_batches(batches):
    for b in batches:
        if b.num_rows:
            dim = len(b.column("x")[0].as_py()) // 4
            x = np.frombuffer(b"".join(b.column("x").to_pylist()), np.float32).reshape(-1, dim)
            y = np.frombuffer(b"".join(b.column("y").to_pylist()), np.float32).reshape(-1, dim)
            s = np.einsum("ij,ij->i", x.astype(np.float64), y.astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("c"), pa.array(np.round(np.clip(s, -1, 1), 7))], names=["q", "c", "score"])


def nearest(vectors: DataFrame, scratch: Scratch, k: int = K, dim: int = DIM, rerank: int = RERANK) -> DataFrame:
    """``(id, other, score, rank)``: the k most similar other vectors of every vector ``(id, v)``.

    At least PER_K * k candidates are scored exactly, so any k up to the number of vectors is served.
    """
    spark = vectors.sparkSession
    rerank = max(rerank, PER_K * k)
    keyed = scratch.keep(vectors.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(5), "v")))
    # The k + 1 smallest ids of a class; the rank filter runs before the shuffle.
    w = Window.partitionBy("h1", "h2").orderBy("id")
    heads = keyed.select("h1", "h2", "id").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k + 1)
    firsts = heads.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min("id").alias("id"))
    firsts = scratch.keep(firsts.withColumn("c", F.monotonically_increasing_id()))
    classes = scratch.keep(firsts.select("c", "id", "h1").join(keyed.select("id", "v"), "id").select("c", "h1", "v"))
    total = classes.count()
    if total:
        sample = classes.orderBy("h1", "c").limit(SAMPLE).select("v").toArrow()
        model = Quantiser(_matrix(sample.column("v"), dim), total)
        coded = scratch.keep(
            classes.select("c", "v").mapInArrow(_encode_batches(model, dim), "c long, cell long, codes binary, norm float, x binary")
        )
        size = scratch.keep(coded.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("subs")))
        placed = coded.join(size, "cell").withColumn("sub", F.pmod(F.xxhash64("c"), F.col("subs")).cast("int"))
        blocks = placed.groupBy("cell", "sub").applyInArrow(_pack_blocks, "cell long, sub int, cs binary, codes binary, norms binary")
        # what one block of queries visits is dealt to as many tasks as keep each below SHARE_CODES codes
        tasks = max(1, -(-total * model.visits // len(model) // SHARE_CODES))
        visits = spread(size.select("cell")).mapInArrow(_visit_batches(model), "qcell long, cell long")
        visits = visits.join(size.select(F.col("cell").alias("qcell"), F.col("subs").alias("qsubs")), "qcell")
        sent = (
            blocks.withColumn("task", F.pmod(F.xxhash64("cell", "sub"), F.lit(tasks)).cast("int"))
            .join(visits, "cell")
            .select("cs", "codes", "norms", "task", "qcell", F.explode(F.sequence(F.lit(0), (F.col("qsubs") - 1).cast("int"))).alias("qsub"))
        )
        queries = placed.select(
            F.col("cell").alias("qcell"), F.col("sub").alias("qsub"), "c", "x", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task")
        )
        met = (
            queries.groupBy("qcell", "qsub", "task")
            .cogroup(sent.groupBy("qcell", "qsub", "task"))
            .applyInArrow(_search(model, rerank), "q long, c long")
        )
        vec = coded.select("c", "x")
        exact = (
            met.join(vec.withColumnRenamed("x", "y"), "c")
            .join(vec.select(F.col("c").alias("q"), "x"), "q")
            .mapInArrow(_exact_batches, "q long, c long, score double")
        )
    else:
        exact = spark.createDataFrame([], "q long, c long, score double")
    # Classes become ids again: of each class as many ids as a list of k can show.
    names = firsts.select("c", "id", "ids")
    own = firsts.where(F.size("ids") > 1).select(F.col("c").alias("q"), "c", F.lit(1.0).alias("score"))
    # the k + 1 first ids of a list lie in the k + 1 first classes, equal scores in order of the smallest id
    top = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    near = exact.unionByName(own).join(names, "c").withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1)
    lists = (
        near.groupBy("q")
        .agg(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("ids"))).alias("l"))
        .select("q", F.slice(F.expr("array_sort(flatten(transform(l, e -> transform(e.ids, i -> struct(e.s as s, i as other)))))"), 1, k + 1).alias("l"))
    )
    member = keyed.select("id", "h1", "h2").join(firsts.select("h1", "h2", F.col("c").alias("q")), ["h1", "h2"])
    return (
        member.join(lists, "q")
        .select("id", F.posexplode(F.slice(F.filter("l", lambda e: e["other"] != F.col("id")), 1, k)).alias("rank", "e"))
        .select("id", F.col("e.other").alias("other"), (-F.col("e.s")).alias("score"), (F.col("rank") + 1).alias("rank"))
    )


def similar_pairs(found: DataFrame, least: float) -> DataFrame:
    """``(id_a, id_b)``, a < b, of neighbours with at least the given cosine."""
    return found.where(F.col("score") >= least).select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()

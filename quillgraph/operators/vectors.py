"""The nearest neighbours of all vectors of a collection, over a cell index with exact scores.

Centroids are fitted on a sample of at most SAMPLE vectors with the smallest hashes; every vector is indexed.
There are about as many cells as the root of the collection, so a cell has about as many vectors, until the sample
bounds them. How many cells a query visits is measured on the sample so that REACH of its true neighbours lie in
them. Cells are kept in blocks of bounded size; a visit is one matrix product of a block of queries and a block of
vectors. README.md states the measured recall.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.search import best_of, unit
from quillgraph.runtime import Scratch, spread

SAMPLE, REACH, BLOCK = 16_384, 0.99, 4096


class Cells:
    def __init__(self, sample: np.ndarray, total: int, k: int, reach: float = REACH, seed: int = 9):
        x, rng = unit(sample).astype(np.float32), np.random.default_rng(seed)
        n = int(np.clip(round(total**0.5), 1, max(1, len(x) // 8)))
        c = x[rng.choice(len(x), n, replace=False)]
        for _ in range(8):
            near = self._near(x, c)
            total_of = np.zeros_like(c)
            np.add.at(total_of, near, x)
            used = np.linalg.norm(total_of, axis=1) > 0
            c[used] = unit(total_of[used])
        self.centres = c
        own = self._near(x, c)
        place = np.argsort(np.argsort(-(c @ c.T), axis=1, kind="stable"), axis=1)
        some = rng.choice(len(x), min(len(x), 2048), replace=False)
        if n == 1 or len(x) < 2:
            self.visits = n
        else:
            s = x[some] @ x.T
            s[np.arange(len(some)), some] = -9
            top = np.argpartition(-s, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)]
            self.visits = int(np.quantile(place[own[some][:, None], own[top]], reach)) + 1
        self.order = np.argsort(place, axis=1)[:, : self.visits]

    @staticmethod
    def _near(x, c):
        return np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])

    def of(self, x: np.ndarray) -> np.ndarray:
        return self._near(x, self.centres)


def neighbours(vectors: DataFrame, scratch: Scratch, k: int = 5, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """``(query, id, score, rank)`` of every vector ``(id, v)``, itself left out; equal scores in order of id.

    Null and zero vectors take no part; all must be of one length; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["id"].dataType.simpleString()
    v = scratch.keep(vectors.where("id is not null and v is not null").where(F.exists("v", lambda e: e != 0)).select("id", "v"))
    total = v.count()
    if total < 2:
        return spark.createDataFrame([], f"query {kind}, id {kind}, score double, rank int")
    got = v.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column("v")
    cells = Cells(np.array(got.to_pylist(), np.float32), total, k)

    def place(batches):
        for b in batches:
            if b.num_rows:
                x = unit(np.array(b.column("v").to_pylist(), np.float32)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(cells.of(x), pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "cell", "x"])

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": [int(pdf["cell"].iloc[0])], "sub": [int(pdf["sub"].iloc[0])], "ids": [pdf["id"].tolist()], "x": [b"".join(pdf["x"])]})

    placed = spread(v).mapInArrow(place, f"id {kind}, cell int, x binary")
    size = placed.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("subs"))
    placed = placed.join(size, "cell").withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int"))
    blocks = scratch.keep(placed.groupBy("cell", "sub").applyInPandas(pack, f"cell int, sub int, ids array<{kind}>, x binary"))
    visits = spark.createDataFrame([(int(q), int(c)) for q in range(len(cells.order)) for c in cells.order[q]], "qcell int, cell int")
    q = blocks.select(F.col("cell").alias("qcell"), F.col("ids").alias("qids"), F.col("x").alias("qx"))
    met = q.join(visits, "qcell").join(blocks.select("cell", F.col("ids").alias("dids"), F.col("x").alias("dx")), "cell")

    def run(batches):
        for b in batches:
            for qi, qx, di, dx in zip(*(b.column(c).to_pylist() for c in ("qids", "qx", "dids", "dx"))):
                qi, di = np.array(qi), np.array(di)
                x, y = (np.frombuffer(w, np.float32).reshape(len(i), -1).astype(np.float64) for w, i in ((qx, qi), (dx, di)))
                for at in range(0, len(x), 256):
                    own = qi[at : at + 256]
                    r, c, s = best_of(x[at : at + 256], y, k, own[:, None] == di[None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(own[r]), pa.array(di[c]), pa.array(s)], names=["query", "id", "score"])

    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = met.select("qids", "qx", "dids", "dx").mapInArrow(run, f"query {kind}, id {kind}, score double")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

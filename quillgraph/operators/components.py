"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.runtime import Scratch


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Label every vertex of ``edges(u, v)`` with the smallest vertex of its component.

    Both columns are longs. Null ends and self-loops are ignored, repeated edges count once; an
    empty input gives an empty result. Output: ``(u, root)`` with one row for each vertex that is
    not itself a root. The minimum of a vertex's neighbours is a map-side-combined aggregate, so a
    hub holding a third of the edges is reduced before the shuffle; the join that follows has one
    row per vertex on its aggregated side, which lets adaptive execution split the hub's partition.
    Every round ends in a table in the shared folder.
    """
    e = (
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e = scratch.keep(e)
    mark = _mark(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(low2.select("u", F.col("m").alias("v"))).distinct()
        nxt = scratch.keep(small)
        scratch.drop(e)
        e, before = nxt, mark
        mark = _mark(e)
        if mark == before:
            return e.select("u", F.col("v").alias("root"))
    raise RuntimeError("components did not settle")


def _mark(e: DataFrame) -> tuple:
    """An order-free fingerprint of an edge table."""
    r = e.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s"),
        F.bit_xor(F.xxhash64(F.lit(7), "v", "u")).alias("x"),
    ).first()
    return r.n, r.s, r.x

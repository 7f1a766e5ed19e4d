"""Problem 7: filling containers of fixed capacity.

First-fit decreasing: items in falling size go into the first container with room, which a tournament
tree of remaining capacities finds in logarithmic time. Documents are dealt at random (by a hash of
their id) into groups of about ``GROUP`` rows, and each group is packed on its own, so no task's memory
depends on the corpus.

Defined results: texts without tokens (null or empty) take no room and have no row; a text above the
capacity is split into full pieces and a rest; equal sizes are taken in order of doc_id; an empty table
gives an empty result; extra columns are ignored; a repeated doc_id is packed as often as it occurs.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.encoding import token_counts

CAPACITY = 2048
GROUP = 16_384


def first_fit(sizes: list[int], capacity: int = CAPACITY) -> list[int]:
    """The container of each size, all sizes in 1..capacity and in falling order."""
    n = 1
    while n < len(sizes):
        n *= 2
    room = [capacity] * (2 * n)
    out = []
    for s in sizes:
        at = 1
        while at < n:
            at *= 2
            if room[at] < s:
                at += 1
        out.append(at - n)
        room[at] -= s
        at //= 2
        while at:
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
            at //= 2
    return out


def pack(items: pd.DataFrame, capacity: int = CAPACITY) -> pd.DataFrame:
    """Pieces of one group: columns container (from 0), doc_id, first_token, n_tokens."""
    doc, first, size = [], [], []
    full_doc, full_first = [], []
    for d, n in zip(items["doc_id"].tolist(), items["n_tokens"].tolist()):
        whole = n // capacity * capacity
        for at in range(0, whole, capacity):
            full_doc.append(d)
            full_first.append(at)
        if n > whole:
            doc.append(d)
            first.append(whole)
            size.append(n - whole)
    order = sorted(range(len(doc)), key=lambda i: (-size[i], doc[i]))
    place = first_fit([size[i] for i in order], capacity)
    base = max(place, default=-1) + 1
    return pd.DataFrame(
        {
            "container": [*place, *range(base, base + len(full_doc))],
            "doc_id": [*(doc[i] for i in order), *full_doc],
            "first_token": [*(first[i] for i in order), *full_first],
            "n_tokens": [*(size[i] for i in order), *[capacity] * len(full_doc)],
        }
    )


def containers(documents: DataFrame, capacity: int = CAPACITY, group: int = GROUP, path: str | None = None) -> DataFrame:
    """``(container, doc_id, first_token, n_tokens)`` of every piece. Only ids and sizes are shuffled."""
    docs = documents.where("doc_id is not null").select("doc_id", "text")
    groups = max(1, math.ceil(docs.count() / group))
    sizes = token_counts(docs, path).where("n_tokens > 0")

    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        out = pack(items, capacity)
        out["container"] += int(key[0]) << 32
        return out

    return (
        sizes.withColumn("g", F.pmod(F.xxhash64("doc_id", F.lit(2048)), F.lit(groups)))
        .groupBy("g")
        .applyInPandas(run, "container long, doc_id long, first_token long, n_tokens long")
    )

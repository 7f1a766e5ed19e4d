"""Problem 1: splits that keep related records together.

Two records are related through a shared page, run, capture or author. ``related_groups`` closes the
relation under chains; ``balanced_splits`` weighs the groups, combines the weights into many nearly
equal bins by the largest-differencing method and hands whole bins to the splits.

Defined results: a repeated pair_id counts once (all its rows' relations hold); a null pair_id is left out; null, blank and
placeholder values relate nothing; an empty table gives empty results; extra columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.components import components
from quillgraph.runtime import Scratch

#: Author values that name nobody.
NOBODY = ("", "unknown", "unknown author", "author unknown", "anonymous", "anon", "n a", "na", "none", "null", "nobody", "various")
SPLITS = (("train", 0.8), ("valid", 0.1), ("test", 0.1))
BINS = 100
ATOMS = 4096


def _clean(c: Column) -> Column:
    """Lower case, one kind of slash, no invisible characters or blanks at all."""
    c = F.regexp_replace(F.lower(c), r"[\p{Cf}\p{Cc}\p{Z}\s]+", "")
    return F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"/{2,}", "/")


def _path(c: Column) -> Column:
    """A path without leading and trailing parts that depend on where it was written."""
    c = F.regexp_replace(_clean(c), r"^(\./|/)+", "")
    return F.regexp_replace(c, r"(\.md|/)+$", "")


def page_of(key: Column) -> Column:
    """The page a key stands for, as a note id; null for a run key or a blank."""
    p = F.regexp_replace(_clean(key), r"#.*$", "")
    p = F.regexp_replace(_path(p), r"^wiki/", "")
    p = F.regexp_replace(p, "/", "-")
    return F.when(run_of(key).isNull() & (p != ""), p)


def run_of(key: Column) -> Column:
    """The run of a key 'run-<date>-<tag>:<seq>'; null for other keys."""
    r = F.regexp_extract(_clean(key), r"^(run-\d+-[^:/#]+):\d+$", 1)
    return F.when(r != "", r)


def capture_of(path: Column) -> Column:
    p = F.regexp_replace(_path(path), r"^raw/", "")
    return F.when((p != "") & ~p.isin("-", "n/a", "none", "null", "unknown"), p)


def author_of(name: Column) -> Column:
    """The words of a name, sorted: 'Veva, Kiluneri' equals 'kiluneri VEVA'."""
    n = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"\p{Cf}+", ""), r"[^\p{L}\p{M}\p{N}]+", " "))
    return F.when(~n.isin(*NOBODY), F.array_join(F.array_sort(F.split(n, " ")), " "))


def related_groups(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(pair_id, group_id)`` of every pair; group_id is the smallest pair_id of the group.

    Each relation value is represented by the smallest pair_id that has it, so the graph's vertices
    are pair ids and no string or hash stands for a vertex.
    """
    marks = pairs.where("pair_id is not null").select(
        "pair_id",
        F.array_compact(
            F.array(
                F.concat(F.lit("p:"), page_of(F.col("key"))),
                F.concat(F.lit("r:"), run_of(F.col("key"))),
                F.concat(F.lit("c:"), capture_of(F.col("raw_path"))),
                F.concat(F.lit("a:"), author_of(F.col("author"))),
            )
        ).alias("marks"),
    )
    links = marks.select("pair_id", F.explode("marks").alias("mark"))
    first = links.groupBy("mark").agg(F.min("pair_id").alias("v"))
    edges = links.join(first, "mark").where("pair_id <> v").select(F.col("pair_id").alias("u"), "v")
    roots = components(edges, scratch)
    ids = pairs.where("pair_id is not null").select("pair_id").distinct()
    return ids.join(roots.withColumnRenamed("u", "pair_id"), "pair_id", "left").select(
        "pair_id", F.coalesce("root", "pair_id").alias("group_id")
    )


def largest_difference(weights: list[int], bins: int) -> list[int]:
    """The bin of each weight: the two partial partitions with the widest spread are merged, the
    heaviest bin of one onto the lightest of the other, until one partition is left.

    Ties go to the lower position. Members are kept as linked trees, so a merge costs ``bins`` steps.
    """
    if not weights:
        return []
    heap = []
    for i, w in enumerate(weights):
        sums = [0] * (bins - 1) + [w]
        heap.append((-w, i, sums, [None] * (bins - 1) + [i]))
    heapq.heapify(heap)
    fresh = len(weights)
    while len(heap) > 1:
        _, _, sa, ma = heapq.heappop(heap)
        _, _, sb, mb = heapq.heappop(heap)
        merged = sorted(
            ((sa[k] + sb[-1 - k], k) for k in range(bins)),
        )
        sums = [s for s, _ in merged]
        members = []
        for _, k in merged:
            x, y = ma[k], mb[-1 - k]
            members.append(x if y is None else y if x is None else (x, y))
        heapq.heappush(heap, (sums[0] - sums[-1], fresh, sums, members))
        fresh += 1
    out = [0] * len(weights)
    for b, tree in enumerate(heap[0][3]):
        todo = [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo.extend(x)
            elif x is not None:
                out[x] = b
    return out


def allocate(bin_weights: list[int], shares=SPLITS) -> list[str]:
    """The split of each bin: heaviest first, to the split that lacks the most."""
    total = sum(bin_weights)
    lack = {name: share * total for name, share in shares}
    out = [shares[0][0]] * len(bin_weights)
    for b in sorted(range(len(bin_weights)), key=lambda b: (-bin_weights[b], b)):
        name = max(lack, key=lambda n: lack[n])
        out[b] = name
        lack[name] -= bin_weights[b]
    return out


def balanced_splits(groups: DataFrame, shares=SPLITS, bins: int = BINS, atoms: int = ATOMS) -> DataFrame:
    """``(pair_id, group_id, split)`` with whole groups in one split.

    Groups heavier than total / atoms are weighed one by one: there are fewer than ``atoms`` of
    them whatever the input. All other groups are hashed into ``atoms`` parcels. So the driver
    weighs at most 2 * atoms numbers at any scale.
    """
    spark = groups.sparkSession
    weight = groups.groupBy("group_id").agg(F.count("*").alias("w"))
    total = groups.count()
    if not total:
        return groups.withColumn("split", F.lit(None).cast("string"))
    parcel = F.when(F.col("w") > total / atoms, F.concat(F.lit("g"), F.col("group_id"))).otherwise(
        F.concat(F.lit("h"), F.pmod(F.xxhash64("group_id"), F.lit(atoms)))
    )
    weight = weight.withColumn("parcel", parcel)
    parts = sorted((r.parcel, int(r.n)) for r in weight.groupBy("parcel").agg(F.sum("w").alias("n")).collect())
    place = largest_difference([n for _, n in parts], bins)
    sums = [0] * bins
    for (_, n), b in zip(parts, place):
        sums[b] += n
    names = allocate(sums, shares)
    plan = spark.createDataFrame([(p, names[b]) for (p, _), b in zip(parts, place)], "parcel string, split string")
    of_group = weight.join(F.broadcast(plan), "parcel").select("group_id", "split")  # at most 2 * atoms rows
    return groups.join(of_group, "group_id").select("pair_id", "group_id", "split")

"""Problem 2: the same or nearly the same records across splits.

Texts are compared as word sequences: the longest common subsequence decides, at least 65 % of the longer
text's words. Words in common in the same order are words in common in any order, so a pair has at least
65 % of the longer text's words in common as bags, at any length and however the changes are scattered.

The candidates are an exact prefix filter on that bound. All words (the second 'the' of a text is another
token than the first) have one global order, rarest first. Where two bags share t of n tokens, the first L
tokens they share (L <= t) stand among the first n - t + L of each, so asking for L common tokens there
loses no pair. Tokens in common are counted by blocks of texts of similar length.

Defined results: a repeated pair_id counts once; null splits, null messages and texts without a word
take no part; identical word sequences are one class and joined once. ``class_links`` gives the links between
classes and who is in them, ``report`` counts from those without unfolding copies, and only ``overlaps``, whose
result is pairs, unfolds them; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.runtime import Scratch, spread

LEAST = 0.65
#: Common prefix tokens that a candidate must show (fewer where 65 % of a text are fewer). Any number is exact.
COMMON = 40
BUCKETS = 1 << 19
#: A token in one of so many texts of a block is frequent there.
DENSE = 8
#: What a block holds at most, on average.
BLOCK_TEXTS, BLOCK_WORDS = 8_192, 1 << 20
#: Texts whose lengths differ by less than 65 % lie in the same or in neighbouring bands of this ratio.
BAND = 0.64

_WORD = re.compile(r"[^\W_]+")
_NUMBERING = re.compile(r"(?m)^[ \t>]*\d{1,3}[.)][ \t]+")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")


def words_of(text: str) -> list[str]:
    """The words that count: no case, punctuation, markup, list numbers or invisible characters."""
    t = unicodedata.normalize("NFKC", text)
    if not t.isascii():
        t = "".join(ch for ch in t if unicodedata.category(ch) != "Cf")
    t = _TAG.sub(" ", _NUMBERING.sub("", t))
    return _WORD.findall(t.lower())


def longest_common(a: list, b: list) -> int:
    """Length of the longest common subsequence, one machine-integer row at a time."""
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & at.get(w, 0)
        if hit:
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


class Sequence:
    """A word sequence with what comparisons need of it."""

    def __init__(self, words: list):
        self.words, self.distinct, self.at = words, set(words), {}
        for i, w in enumerate(words):
            self.at[w] = self.at.get(w, 0) | 1 << i


def same_enough(a: list, b: list, least: float = LEAST) -> bool:
    return alike(Sequence(a), Sequence(b), least)


def alike(a: Sequence, b: Sequence, least: float = LEAST) -> bool:
    """Whether the longest common subsequence has enough of the longer one's words."""
    m, n = len(a.words), len(b.words)
    longer = max(m, n)
    if not m or not n or min(m, n) < least * longer:
        return False
    if a.words == b.words:
        return True
    # no more words in common in any order than distinct ones and repetitions allow
    if len(a.distinct & b.distinct) + min(m - len(a.distinct), n - len(b.distinct)) < least * longer:
        return False
    get, full = a.at.get, (1 << m) - 1
    row, left = full, n
    for w in b.words:
        hit = row & get(w, 0)
        if hit:
            row = (row + hit | row - hit) & full
        left -= 1
        # what is left cannot make up for what is missing
        if not left & 15 and m - row.bit_count() + left < least * longer:
            return False
    return m - row.bit_count() >= least * longer


def _norm_batches(batches):
    for b in batches:
        texts = ["\n".join(x or "" for x in row) if row else "" for row in b.column("said").to_pylist()]
        norm = [" ".join(words_of(t)) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [b.column("pair_id"), b.column("split"), pa.array(norm, pa.string())], names=["pair_id", "split", "norm"]
        )


def _hashes(words: list[str], memo: dict) -> np.ndarray:
    import xxhash

    if len(memo) > 500_000:
        memo.clear()
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = memo.get(w)
        if h is None:
            h = memo[w] = xxhash.xxh64_intdigest(w)
        out[i] = h
    return out


_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(words: list[str], memo: dict) -> np.ndarray:
    """One 32-bit hash for each word of a text: the second 'the' is another token than the first.

    Two tokens with one hash count as one everywhere, so they can add candidates and lose none.
    """
    h = _hashes(words, memo)
    with np.errstate(over="ignore"):
        s = np.sort(h)
        start = np.r_[True, s[1:] != s[:-1]]
        nth = np.arange(len(s)) - np.maximum.accumulate(np.where(start, np.arange(len(s)), 0))
        return ((s * _MIX + nth.astype(np.uint64)) * _MIX >> np.uint64(32)).astype(np.uint32)


def needed(n: int) -> int:
    return int(np.ceil(LEAST * n - 1e-9))


def _count_batches(batches):
    """Occurrences by bucket over all texts of a partition."""
    memo: dict = {}
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        sets = [tokens(norm.split(" "), memo) for norm in b.column("norm").to_pylist()]
        if sets:
            total += np.bincount((np.concatenate(sets) % BUCKETS).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(total)
    for i in range(0, len(at), 65_536):
        part = at[i : i + 65_536]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["bucket", "n"])


class Blocks:
    """Numbers for the blocks of one side: each band of lengths has as many as its texts and words ask for."""

    def __init__(self, rows):
        self.first, self.of, at = {}, {}, 0
        for band, texts, words in sorted(rows):
            self.first[band], self.of[band] = at, max(1, -(-texts // BLOCK_TEXTS), -(-words // BLOCK_WORDS))
            at += self.of[band]

    def own(self, band: int, cid: int) -> int:
        return self.first[band] + (cid * 0x9E3779B97F4A7C15 >> 32) % self.of[band]

    def met(self, band: int) -> list[int]:
        return [self.first[b] + i for b in (band - 1, band, band + 1) if b in self.of for i in range(self.of[b])]


_PREFIX = "cid long, n int, g array<int>, eb int, tb int, tbs array<int>, ebs array<int>"


def _prefix_batches(table: np.ndarray, ev: Blocks, tr: Blocks):
    def run(batches):
        memo: dict = {}
        for b in batches:
            cols: list[list] = [[], [], [], [], [], [], []]
            for c, n, band, e, t, text in zip(*(b.column(x).to_pylist() for x in ("cid", "n", "band", "e", "t", "norm"))):
                g = tokens(text.split(" "), memo)
                p = min(n, n - needed(n) + min(COMMON, needed(n)))
                g = g[np.lexsort((g, table[(g % BUCKETS).astype(np.int64)]))[:p]]
                row = (c, n, g.view(np.int32), ev.own(band, c) if e else None, tr.own(band, c) if t else None, tr.met(band) if e else [], ev.met(band) if t else [])
                for col, v in zip(cols, row):
                    col.append(v)
            types = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in _PREFIX.split(", ")])

    return run


def _flat(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    g = t.column("g").combine_chunks()
    g = g.combine_chunks() if isinstance(g, pa.ChunkedArray) else g
    return g.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(g.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)


def _meet(left: pa.Table, right: pa.Table) -> pa.Table:
    """The pairs of a block of evaluation texts and a block of training texts with enough prefix tokens in common."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if len(left) and len(right):
        ga, at_a = _flat(left)
        gb, at_b = _flat(right)
        ca, cb = left.column("cid").to_numpy(), right.column("cid").to_numpy()
        na, nb = left.column("n").to_numpy(), right.column("n").to_numpy()
        need_a, need_b = (np.minimum(COMMON, np.ceil(LEAST * n - 1e-9)) for n in (na, nb))
        order = np.argsort(gb, kind="stable")
        owner = np.repeat(np.arange(len(cb), dtype=np.int32), np.diff(at_b))[order]
        known, start = np.unique(gb[order], return_index=True)
        stop = np.r_[start[1:], len(gb)]
        # tokens of many texts as rows of ones and zeros, which add up faster than lists of their texts
        often = np.flatnonzero(stop - start > len(cb) // DENSE)
        row = np.full(len(known), -1)
        row[often] = np.arange(len(often))
        ones = np.zeros((len(often), len(cb)), np.uint16)
        for r, k in enumerate(often):
            np.add.at(ones[r], owner[start[k] : stop[k]], 1)
        where = np.minimum(np.searchsorted(known, ga), len(known) - 1)
        hit = known[where] == ga
        least = need_b.min()
        for i in range(len(ca)):
            k = where[at_a[i] : at_a[i + 1]][hit[at_a[i] : at_a[i + 1]]]
            if len(k):
                rows = row[k]
                few = k[rows < 0]
                n = np.bincount(np.concatenate([owner[x:y] for x, y in zip(start[few], stop[few])]), minlength=len(cb)) if len(few) else np.zeros(len(cb), np.int64)
                if len(few) < len(k):
                    n += ones[rows[rows >= 0]].sum(axis=0, dtype=np.uint16)
                j = np.flatnonzero(n >= min(need_a[i], least))
                if len(j):
                    ok = (n[j] >= np.minimum(need_a[i], need_b[j])) & (np.minimum(na[i], nb[j]) >= LEAST * np.maximum(na[i], nb[j])) & (cb[j] != ca[i])
                    j = j[ok]
                if len(j):
                    found.append((np.full(len(j), ca[i]), cb[j]))
    a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
    return pa.table({"ca": pa.array(a, pa.int64()), "cb": pa.array(b, pa.int64())})


def _verify_batches(batches):
    known: dict[str, Sequence] = {}

    def of(text: str) -> Sequence:
        got = known.get(text)
        if got is None:
            if len(known) >= 2048:
                known.clear()
            got = known[text] = Sequence(text.split(" "))
        return got

    for b in batches:
        a, c = b.column("norm_a").to_pylist(), b.column("norm_b").to_pylist()
        keep = pa.array([alike(of(x), of(y)) for x, y in zip(a, c)], pa.bool_())
        yield b.select(["ca", "cb"]).filter(keep)


def class_links(pairs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Links ``(ca, cb)`` of a class with evaluation records and one with training records, the same class included,
    and members ``(pair_id, split, cid)`` with split 'e' or 't'. A class is named by its smallest pair_id."""
    said = pairs.where("pair_id is not null and split is not null").select(
        "pair_id",
        F.when(F.lower(F.trim("split")) == "train", "t").when(F.lower(F.trim("split")).isin("valid", "test"), "e").alias("split"),
        F.transform(F.filter("messages", lambda m: F.lower(F.trim(m["role"])) == "user"), lambda m: m["content"]).alias("said"),
    )
    said = spread(said.where("split is not null and said is not null")).mapInArrow(_norm_batches, "pair_id long, split string, norm string")
    # all rows of a text, then one class for each text; copies never meet as pairs before the end
    member = scratch.keep(said.where("norm <> ''").withColumn("k", F.md5("norm")))
    ids = member.groupBy("k").agg(
        F.min("pair_id").alias("cid"), F.bool_or(F.col("split") == "t").alias("t"), F.bool_or(F.col("split") == "e").alias("e")
    )
    # the text is taken from the row whose pair_id is the smallest of its class
    text = member.select("k", F.col("pair_id").alias("cid"), "norm").dropDuplicates(["k", "cid"])
    cls = scratch.keep(text.join(ids, ["k", "cid"]).withColumn("n", F.size(F.split("norm", " "))))
    rows = cls.select("norm").mapInArrow(_count_batches, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    order = np.zeros(BUCKETS, np.int64)
    for r in rows:
        order[r.bucket] = r.n
    banded = cls.withColumn("band", F.floor(F.log("n") / -float(np.log(BAND))).cast("int"))
    sizes = banded.groupBy("band").agg(*[f(F.when(F.col(x), v)).alias(f"{x}{y}") for x in ("e", "t") for y, f, v in (("n", F.count, F.lit(1)), ("w", F.sum, F.col("n")))]).collect()
    ev, tr = (Blocks([(r.band, r[f"{x}n"], r[f"{x}w"]) for r in sizes if r[f"{x}n"]]) for x in ("e", "t"))
    prefix = scratch.keep(spread(banded.select("cid", "n", "band", "e", "t", "norm")).mapInArrow(_prefix_batches(order, ev, tr), _PREFIX))
    left = prefix.where("eb is not null").select("eb", F.explode("tbs").alias("tb"), "cid", "n", "g")
    right = prefix.where("tb is not null").select(F.explode("ebs").alias("eb"), "tb", "cid", "n", "g")
    near = left.groupBy("eb", "tb").cogroup(right.groupBy("eb", "tb")).applyInArrow(_meet, "ca long, cb long")
    texts = cls.select("cid", "norm")
    checked = (
        scratch.keep(near)
        .join(texts.select(F.col("cid").alias("ca"), F.col("norm").alias("norm_a")), "ca")
        .join(texts.select(F.col("cid").alias("cb"), F.col("norm").alias("norm_b")), "cb")
        .mapInArrow(_verify_batches, "ca long, cb long")
    )
    same = cls.where("t and e").select(F.col("cid").alias("ca"), F.col("cid").alias("cb"))
    of = member.join(ids.select("k", "cid"), "k").select("pair_id", "split", "cid").distinct()
    return scratch.keep(checked.unionByName(same)), scratch.keep(of)


def _sides(of: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (of.where(F.col("split") == x).select(F.col("pair_id").alias(i), F.col("cid").alias(c)) for x, i, c in (("e", "eval_id", "ca"), ("t", "train_id", "cb")))


def overlaps(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(eval_id, train_id)`` of every evaluation record and every training record that match."""
    links, of = class_links(pairs, scratch)
    ev, tr = _sides(of)
    return links.join(ev, "ca").join(tr, "cb").where("eval_id <> train_id").select("eval_id", "train_id").distinct()


def linked_classes(links: DataFrame, of: DataFrame) -> DataFrame:
    """``(eval_class, train_class, eval_records, train_records)``: one row for each link, whatever the copies."""
    n = of.groupBy("cid").agg(F.count_if(F.col("split") == "e").alias("eval_records"), F.count_if(F.col("split") == "t").alias("train_records"))
    e = n.select(F.col("cid").alias("ca"), "eval_records")
    t = n.select(F.col("cid").alias("cb"), "train_records")
    return links.join(e, "ca").join(t, "cb").select(F.col("ca").alias("eval_class"), F.col("cb").alias("train_class"), "eval_records", "train_records")


def matches(links: DataFrame, of: DataFrame) -> DataFrame:
    """``(eval_id, n)``: how many training records each evaluation record matches.

    Classes are counted, not unfolded. Only records that are in several classes or on both sides go out as
    pairs, so that none of their matches counts twice.
    """
    several = of.groupBy("pair_id").agg(F.count("*").alias("n")).where("n > 1").select("pair_id")
    one, rest = of.join(several, "pair_id", "left_anti"), of.join(several, "pair_id", "left_semi")
    (ev, tr), (ev2, tr2) = _sides(one), _sides(rest)
    whole = links.join(tr.groupBy("cb").agg(F.count("*").alias("n")), "cb").groupBy("ca").agg(F.sum("n").alias("n"))
    pairs = ev2.join(links, "ca").join(tr.unionByName(tr2), "cb").select("eval_id", "train_id")
    pairs = pairs.unionByName(tr2.join(links, "cb").join(ev, "ca").select("eval_id", "train_id")).where("eval_id <> train_id").distinct()
    return ev.join(whole, "ca").select("eval_id", "n").unionByName(pairs.groupBy("eval_id").agg(F.count("*").alias("n"))).groupBy("eval_id").agg(F.sum("n").alias("n"))


def report(links: DataFrame, of: DataFrame, pairs: DataFrame) -> DataFrame:
    """The number of overlaps by evaluation split and source (origin, raw_path) of the evaluation record."""
    src = pairs.groupBy(F.col("pair_id").alias("eval_id")).agg(F.max(F.struct("split", "origin", "raw_path")).alias("s"))
    return (
        matches(links, of)
        .join(src, "eval_id")
        .groupBy(F.col("s.split").alias("split"), F.col("s.origin").alias("origin"), F.col("s.raw_path").alias("raw_path"))
        .agg(F.sum("n").alias("overlaps"), F.count("*").alias("records"))
    )

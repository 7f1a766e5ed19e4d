"""Problem 5: cutting oversized texts at natural boundaries.

Every place where a text may be cut has a strength; a sparse table over the places answers "strongest
place in this window, the rightmost of equals" in constant time. A piece starts ``overlap`` characters
before the end of the piece before it and ends at the strongest place of the permissible window, which
reaches from ``fill`` of the limit to the limit (in UTF-8 bytes); without any place there, at the last
character that fits.

Defined results: null, empty and short texts give no piece; of several rows of one rel_path the one with
the latest synced_at counts (ties: the longer body, then the greater hash), repeated rows once; null
rel_path is a path of its own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, FILL = 28_000, 200, 0.5
WORD, SENTENCE, LINE, PARAGRAPH, HEADING = 1, 2, 3, 4, 5

_RULES = (
    (WORD, re.compile(r"\s+(?=\S)")),
    (SENTENCE, re.compile(r"[.!?…؟]+[\"'’”»)\]]*\s+(?=\S)|[。！？]+[」』”]*")),
    (LINE, re.compile(r"\r\n|\n|\r| ")),
    (PARAGRAPH, re.compile(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)\s*?(?=[^\r\n])| ")),
    (HEADING, re.compile(r"(?:\r\n|\n|\r)(?=#{1,6}[ \t])|(?:\r\n|\n|\r)(?=[^\r\n]{1,200}(?:\r\n|\n|\r)(?:={3,}|-{3,})[ \t]*(?:\r\n|\n|\r|$))")),
)


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places (a cut before that character) in order, and the strength of each."""
    best = np.zeros(len(text) + 1, np.int8)
    for strength, rule in _RULES:
        at = np.fromiter((m.end() for m in rule.finditer(text)), np.int64)
        best[at] = strength
    best[0] = 0
    best[-1] = 0
    places = np.flatnonzero(best)
    return places, best[places]


class RangeMax:
    """Sparse table over keys that hold strength and place, so that equals resolve to the right."""

    def __init__(self, places: np.ndarray, strengths: np.ndarray, widest: int):
        key = strengths.astype(np.int64) << 40 | places
        self.rows = [key]
        span = 1
        while span * 2 <= min(len(key), max(widest, 1)):
            prev = self.rows[-1]
            self.rows.append(np.maximum(prev[:-span], prev[span:]))
            span *= 2

    def strongest(self, lo: int, hi: int) -> int:
        """The place of the maximum of keys lo..hi-1, or -1 when there is none."""
        if lo >= hi:
            return -1
        level = min((hi - lo).bit_length() - 1, len(self.rows) - 1)
        row, span = self.rows[level], 1 << level
        top = int(row[lo])
        for at in (*range(lo + span, hi - span, span), hi - span):
            top = max(top, int(row[at]))
        return top & ((1 << 40) - 1)


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP, fill: float = FILL) -> list[tuple[int, int]]:
    """(start, end) in characters of each piece of a text above the limit; [] for any other text."""
    if limit < 4 * (overlap + 4):
        raise ValueError("the limit leaves no room beside the overlap")
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) <= limit:
        return []
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
    upto = np.r_[0, np.cumsum(width)]  # bytes before each character
    del width
    places, strengths = boundaries(text)
    table = RangeMax(places, strengths, limit)
    out, start, done, n = [], 0, 0, len(code)
    while True:
        if upto[n] - upto[start] <= limit:
            out.append((start, n))
            return out
        last = int(np.searchsorted(upto, upto[start] + limit, "right")) - 1
        least = max(done + 1, int(np.searchsorted(upto, upto[start] + int(limit * fill), "left")))
        end = table.strongest(*np.searchsorted(places, [least, last + 1]).tolist())
        if end < 0:
            end = last
            while end - 1 > done and _inseparable(code, end):
                end -= 1
        out.append((start, end))
        start, done = max(end - overlap, 0), end


def _inseparable(code: np.ndarray, at: int) -> bool:
    """No cut inside CR LF, before a combining mark or variation selector, or at a joiner."""
    c, before = int(code[at]), int(code[at - 1])
    return (
        (before == 13 and c == 10)
        or 0x300 <= c <= 0x36F
        or 0xFE00 <= c <= 0xFE0F
        or 0x1F3FB <= c <= 0x1F3FF
        or 0x200D in (c, before)
    )


def _cut_batches(limit: int, overlap: int, fill: float):
    def run(batches):
        for b in batches:
            for path, text in zip(b.column("rel_path").to_pylist(), b.column("body_text").to_pylist()):
                spans = cut(text, limit, overlap, fill)
                if spans:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([path] * len(spans), pa.string()),
                            pa.array(range(len(spans)), pa.int32()),
                            pa.array([s for s, _ in spans], pa.int64()),
                            pa.array([e for _, e in spans], pa.int64()),
                            pa.array([text[s:e] for s, e in spans], pa.string()),
                        ],
                        names=["rel_path", "piece", "first_char", "end_char", "piece_text"],
                    )

    return run


def pieces(resources: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, fill: float = FILL) -> DataFrame:
    """``(rel_path, piece, first_char, end_char, piece_text)`` of every current body above the limit.

    The current row is chosen from three numbers for each path; only bodies above the limit are
    shuffled at all.
    """
    stamp = F.struct("synced_at", F.octet_length("body_text").alias("size"), F.xxhash64("body_text").alias("hash"))
    current = resources.groupBy("rel_path").agg(F.max(stamp).alias("stamp"))
    big = resources.where(F.octet_length("body_text") > limit).select(
        F.col("rel_path").alias("path"), "body_text", stamp.alias("own")
    )
    chosen = (
        big.join(current, big["path"].eqNullSafe(current["rel_path"]) & big["own"].eqNullSafe(current["stamp"]))
        .dropDuplicates(["rel_path"])
        .select("rel_path", "body_text")
    )
    return chosen.mapInArrow(
        _cut_batches(limit, overlap, fill),
        "rel_path string, piece int, first_char long, end_char long, piece_text string",
    )

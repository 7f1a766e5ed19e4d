"""Problem 6: encoding of a corpus with a public byte-level vocabulary.

The merges of a word run on a doubly linked list of symbols; a priority queue holds the rank of every
adjacent pair, and an entry whose symbols have meanwhile changed is skipped. Decoding concatenates the
vocabulary's byte strings. Ids of words met before come from a bounded memo, which changes no result.

Defined results: null and empty texts give an empty list; special tokens are ordinary text; an empty
table gives an empty result; extra columns are ignored; repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import heapq
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.runtime import spread

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's published pattern for splitting text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO = 200_000
MEMO_WORD = 64


def vocabulary_path(name: str = VOCABULARY, folder: str | None = None) -> str:
    """A vocabulary file: in the given folder, $TOKENIZER_DIR or /opt/tokenizers."""
    return os.path.join(folder or os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.ranks = ranks
        self.strings = [b""] * (max(ranks.values()) + 1)
        for s, i in ranks.items():
            self.strings[i] = s
        self.words = regex.compile(PATTERN).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        n, rank = len(word), self.ranks
        sym: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            r = rank.get(word[i : i + 2])
            if r is not None:
                queue.append((r, i, 2))
        heapq.heapify(queue)
        while queue:
            _, i, size = heapq.heappop(queue)
            a = sym[i]
            j = right[i]
            if a is None or j < 0 or len(a) + len(sym[j]) != size:
                continue  # stale: one of the two has been merged since
            a += sym[j]
            sym[i], sym[j] = a, None
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                r = rank.get(a + sym[k])
                if r is not None:
                    heapq.heappush(queue, (r, i, len(a) + len(sym[k])))
            h = left[i]
            if h >= 0:
                r = rank.get(sym[h] + a)
                if r is not None:
                    heapq.heappush(queue, (r, h, len(sym[h]) + len(a)))
        return [rank[s] for s in sym if s is not None]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        memo, out = self.memo, []
        if len(memo) > MEMO:
            memo.clear()
        for w in self.words(text):
            ids = memo.get(w)
            if ids is None:
                ids = self.merge(w.encode("utf-8", "surrogatepass"))
                if len(w) <= MEMO_WORD:
                    memo[w] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def _codec(ranks: dict[bytes, int], key: int) -> Codec:
    """One codec for each Python worker and vocabulary."""
    if key not in _codecs:
        _codecs[key] = Codec(ranks)
    return _codecs[key]


def _shared(spark, path: str | None):
    ranks = load_ranks(path or vocabulary_path())
    return spark.sparkContext.broadcast(ranks), hash((path or vocabulary_path(), len(ranks)))


def encode_table(documents: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids)`` of every row. The vocabulary (a file of fixed size) is broadcast."""
    ranks, key = _shared(documents.sparkSession, path)
    kind = documents.schema[id_col].dataType

    def run(batches):
        codec = _codec(ranks.value, key)
        for b in batches:
            ids, ends = [], [0]
            for t in b.column(1).to_pylist():
                ids += codec.encode(t)
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(ids, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[id_col, "ids"])

    return spread(documents.select(id_col, text_col)).mapInArrow(run, f"{id_col} {kind.simpleString()}, ids array<int>")


def token_counts(documents: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens)`` of every row."""
    ranks, key = _shared(documents.sparkSession, path)
    kind = documents.schema[id_col].dataType

    def run(batches):
        codec = _codec(ranks.value, key)
        for b in batches:
            n = [len(codec.encode(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[id_col, "n_tokens"])

    return spread(documents.select(id_col, text_col)).mapInArrow(run, f"{id_col} {kind.simpleString()}, n_tokens long")


def decode_column(spark, ids: Column, path: str | None = None) -> Column:
    """The text of a column of id lists; a null list gives null."""
    ranks, key = _shared(spark, path)

    @F.udf("string", useArrow=True)
    def decode(x):
        return None if x is None else _codec(ranks.value, key).decode(x)

    return decode(ids)

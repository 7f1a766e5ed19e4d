"""Problem 8: the subject areas of each document.

Documents become weighted term vectors (log-idf over all documents of their language) and are embedded
by a truncated singular value decomposition, found by subspace iteration over all documents. Every
sentence is embedded in the same space and assigned by cosine similarity to the nearest centroid; the
centroids start from the subjects' seed terms and are refined from the sentences assigned to them. A
document has a subject when the subject holds at least ``SHARE`` of its sentences.

The vocabulary is every word in at least ``LEAST_DF`` of its language's documents, and in two, which bounds it for each language
by (distinct words of a document) / LEAST_DF whatever the corpus; matrices on the driver have one row for each such word.
A word is a 64-bit hash of itself and its language throughout. Sentences are embedded once and stored in half
precision; the passes that refine the centroids and the one that assigns read only that.

The language is the one whose function words prevail, else the first two letters of lang; a text of neither is
of the class 'other', which has a vocabulary and a subspace of its own, with 'en' where lang is blank, too.

Defined results: null, empty and blank texts, and texts of page furniture only (frontmatter, headings,
menus, addresses, bare links, log lines), have no subject and no row; repeated texts get the same
subjects; null doc_ids are left out; without subjects or documents the result is empty; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.replies import _FUNCTION, _ONE
from quillgraph.runtime import Scratch, spread

RANK = 40
POWER_ROUNDS = 3
REFINE_ROUNDS = 4
LEAST_DF = 1e-4
#: A fifth of the sentences is a subject and a tenth a mention; the line is drawn between.
SHARE = 0.15
LEAST_COSINE = 0.12
CONTEXT = 0.4
LANGS = ("en", "de", "fr", "es", "other")
NONE = "none"
BLOCKS = 16
#: Words of housekeeping, by which remarks about the pages themselves are known.
HOUSEKEEPING = (
    "page link note index table title list draft heading summary caption comment footnote paragraph section outline tag review "
    "remark quote answer entry overview topic "
    "seiten verweise entwürfe überschriften zusammenfassungen kommentare anmerkungen absätze abschnitte listen titel einträge tabellen "
    "pages liens brouillons titres résumés commentaires notes paragraphes sections listes entrées tableaux "
    "páginas enlaces borradores títulos resúmenes comentarios notas párrafos secciones listas entradas tablas"
).split()

_FRONT = re.compile(r"\A﻿?\s*---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\Z)", re.S)
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_CITED = re.compile(r"\[\[?[^\[\]\n]*\]\]?(?:\([^()\n]*\))?")
_URL = re.compile(r"(?:https?://|www\.)\S+")
_INVISIBLE = re.compile("[​-‏‪-‮⁠-⁤﻿­]")
_END = re.compile(r"[.!?…。！？][\"”»’)]*\s+(?=\S)")
_WORD = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)?")
_BLOCK = re.compile(r"\n(?:[ \t]*\n+|(?=[ \t]*(?:[-*+#>]|\d{1,3}[.)])[ \t]))")
_MARK = re.compile(r"^[\s>*+-]*(?:\d{1,3}[.)]\s+)?")


def sentence_words(text: str) -> list[list[str]]:
    """The words of each sentence of a text, without its page furniture."""
    # each rule is asked for only where a sign of it is there
    t = text if text.isascii() else _INVISIBLE.sub("", text)
    t = t.replace("\r\n", "\n").replace("\r", "\n") if "\r" in t else t
    t = _FRONT.sub("", t) if "---" in t else t
    t = _FENCE.sub("\n", t) if "```" in t else t
    out = []
    for block in _BLOCK.split(t) if "\n" in t else [t]:
        if block.lstrip().startswith("#") or block.count("|") >= 2:
            continue
        line = " ".join(block.split())
        if line and not line[0].isalpha():
            line = _MARK.sub("", line)
        if "http" in line or "www." in line:
            line = _URL.sub(" ", line)
        if "[" in line:
            line = _CITED.sub(" ", line)
        line, at = line.strip(), 0
        for end in (*((m.start() + 1, m.end()) for m in _END.finditer(line)), (len(line), 0)):
            s, at = line[at : end[0]].strip(), end[1]
            # furniture is short or does not end as a sentence does
            if s and s.rstrip("\"”»’)* ")[-1:] in ".!?…。！？":
                words = _WORD.findall(s)
                if len(words) >= 4:
                    out.append(words)
    return out


def term_of(w: str, lang: str) -> str | None:
    """The lower-case word that can carry a subject; None for function words and single letters."""
    w = w.lower()
    for cut in ("’", "'"):
        if cut in w:
            head, _, tail = w.partition(cut)
            w = tail if lang == "fr" and len(head) <= 2 else head
    return w if len(w) > 1 and w not in _FUNCTION else None


def word_hash(term: str, lang: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{lang} {term}") - (1 << 63)


class Terms:
    """Hashes of the words of a language, by spelling: first in a sentence, and later. Names, where capitals
    tell them, are left out later. What is remembered is bounded and changes no result."""

    def __init__(self, lang: str):
        self.lang, self.first, self.later = lang, {}, {}

    def _add(self, w: str) -> None:
        t = term_of(w, self.lang)
        h = None if t is None else word_hash(t, self.lang)
        self.first[w] = h
        self.later[w] = None if self.lang != "de" and w[0].isupper() and not w.isupper() else h

    def of(self, words: list[str]) -> list[int]:
        if len(self.first) > 200_000:
            self.first.clear()
            self.later.clear()
        for w in words:
            if w not in self.first:
                self._add(w)
        got = [*map(self.later.get, words)]
        got[0] = self.first.get(words[0])
        return [h for h in got if h is not None]


def language_of(sentences: list[list[str]], given: str | None, memo: dict) -> str:
    """The language whose function words prevail, else what is given."""
    if len(memo) > 200_000:
        memo.clear()
    flat = [w for words in sentences for w in words]
    for w in set(flat).difference(memo):
        memo[w] = _ONE.get(w.lower())
    seen = Counter(map(memo.get, flat))
    n = {l: seen[l] for l in ("en", "de", "fr", "es")}
    (a, x), (_, y) = sorted(n.items(), key=lambda p: -p[1])[:2]
    if x >= 2 and x >= 2 * y:
        return a
    given = (given or "").strip().lower()[:2]
    return given if given in LANGS else "other" if given else "en"


def _split_batches(batches):
    of, memo = {l: Terms(l) for l in LANGS}, {}
    for b in batches:
        ids, langs, words, at, ends = [], [], [], [0], []
        for d, t, given in zip(*(b.column(i).to_pylist() for i in range(3))):
            ss = sentence_words(t) if t else []
            if not ss:
                continue
            lang = language_of(ss, given, memo)
            base, upto = len(words), []
            for s in ss:
                words += of[lang].of(s)
                upto.append(len(words) - base)
            ids.append(d)
            langs.append(LANGS.index(lang))
            at.append(len(words))
            ends.append(upto)
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.array(words, np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.int8()), lists, pa.array(ends, pa.list_(pa.int32()))], names=["doc_id", "lang", "words", "ends"])


def _index_batches(known: np.ndarray):
    """Hashes to places in the ordered vocabulary, dropping words outside it."""

    def run(batches):
        for b in batches:
            h, upto = _flat(b.column("words"))
            local, sents = _flat(b.column("ends"))
            doc = np.repeat(np.arange(b.num_rows), np.diff(np.r_[0, sents]))
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[place] == h
            before = np.r_[0, np.cumsum(hit)]  # words of the vocabulary before each word
            base = np.r_[0, upto[:-1]]
            start = before[base]
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, before[upto]].astype(np.int32)), pa.array(place[hit].astype(np.int32)))
            ends = pa.ListArray.from_arrays(pa.array(np.r_[0, sents].astype(np.int32)), pa.array((before[base[doc] + local] - start[doc]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), ids, ends], names=["doc_id", "lang", "ids", "ends"])

    return run


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and ends of a list column."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False), np.cumsum(a.value_lengths().to_numpy(zero_copy_only=False))


def _row_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows of values up to each end; empty runs give zero."""
    starts = np.r_[0, ends[:-1]]
    out = np.zeros((len(ends), values.shape[1]), values.dtype)
    full = ends > starts
    if full.any():
        out[full] = np.add.reduceat(values, starts[full], axis=0)
    return out


def _documents(ids: np.ndarray, ends: np.ndarray, idf: np.ndarray):
    """(document, term, weight) with repeated terms joined and each document of length 1."""
    doc = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
    key, n = np.unique(doc.astype(np.int64) << 32 | ids, return_counts=True)
    d, t = key >> 32, key & 0xFFFFFFFF
    w = (1 + np.log(n)) * idf[t]
    norm = np.sqrt(np.bincount(d, w * w, len(ends)))
    return d, t, (w / np.maximum(norm[d], 1e-12)).astype(np.float32)


def _chunks(batch, rows: int = 2000):
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def _power_batches(basis: np.ndarray, idf: np.ndarray):
    """Partial sums of A' A basis, in BLOCKS pieces by term."""

    def run(batches):
        total = np.zeros(basis.shape, np.float64)
        for batch in batches:
            for b in _chunks(batch):
                ids, ends = _flat(b.column("ids"))
                if not len(ids):
                    continue
                d, t, w = _documents(ids, ends, idf)
                counts = np.searchsorted(d, np.arange(len(ends)), "right")
                image = _row_sums(basis[t] * w[:, None], counts)
                back = image[d] * w[:, None]
                order = np.argsort(t, kind="stable")
                ts = t[order]
                at = np.flatnonzero(np.r_[True, ts[1:] != ts[:-1]])
                total[ts[at]] += np.add.reduceat(back[order], at, axis=0)
        edges = np.linspace(0, len(total), BLOCKS + 1).astype(int)
        for k in range(BLOCKS):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([total[edges[k] : edges[k + 1]].astype(np.float64).tobytes()], pa.binary())], names=["block", "part"]
            )

    return run


def _summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Element-wise sums of float64 blobs by block, in two steps so that no task holds all of them."""

    def add(t: pa.Table) -> pa.Table:
        total = None
        for p in t.column("part"):
            x = np.frombuffer(p.as_buffer())
            total = x.copy() if total is None else np.add(total, x, out=total)
        return pa.table({"block": t.column("block")[:1], "part": pa.array([total.tobytes()], pa.binary())})

    shape = "block int, part binary"
    first = parts.withColumn("salt", F.spark_partition_id() % 64).groupBy("block", "salt").applyInArrow(lambda t: add(t), shape)
    return {r.block: np.frombuffer(bytes(r.part)) for r in first.groupBy("block").applyInArrow(lambda t: add(t), shape).collect()}


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


class Model:
    """What an executor needs to embed sentences and name their subjects."""

    def __init__(self, term: np.ndarray, idf: np.ndarray, mean: np.ndarray, names: list[str]):
        self.term, self.idf, self.mean, self.names = term.astype(np.float32), idf.astype(np.float32), mean, names
        self.centroids = np.zeros((len(LANGS), len(names), term.shape[1]))

    def read(self, b):
        """Unit vectors of all sentences, their document and language, the documents' vectors."""
        k = self.term.shape[1]
        lang = b.column("lang").to_numpy(zero_copy_only=False)
        cells = b.column("sentences").to_pylist()
        doc = np.repeat(np.arange(b.num_rows), [len(c) // (2 * k) for c in cells])
        s = np.frombuffer(b"".join(cells), np.float16).reshape(-1, k).astype(np.float32)
        d = np.frombuffer(b"".join(b.column("whole").to_pylist()), np.float32).reshape(-1, k)
        of, mean = lang[doc], self.mean.astype(np.float32)
        s = np.where((s != 0).any(axis=1, keepdims=True), s - mean[of], 0)
        return _unit(s), doc, of, _unit(d - mean[lang])

    def scores(self, s, doc, of, d):
        out = np.full((len(s), len(self.names)), -1.0, np.float32)
        for l in range(len(LANGS)):
            rows = of == l
            if rows.any():
                c = self.centroids[l].astype(np.float32)
                out[rows] = s[rows] @ c.T + CONTEXT * (d[doc[rows]] @ c.T)
        return out


def _embed_batches(model: Model):
    """Unit vectors of a document's sentences in half precision, and of the document."""

    def run(batches):
        for batch in batches:
            for b in _chunks(batch):
                ids, doc_ends = _flat(b.column("ids"))
                local, upto = _flat(b.column("ends"))
                doc = np.repeat(np.arange(b.num_rows), np.diff(np.r_[0, upto]))
                raw = _row_sums(model.term[ids] * model.idf[ids][:, None], np.r_[0, doc_ends[:-1]][doc] + local)
                whole = _unit(_row_sums(raw, upto)).astype(np.float32)
                half = _unit(raw).astype(np.float16)
                cells = [half[i:j].tobytes() for i, j in zip(np.r_[0, upto[:-1]], upto)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("lang"), pa.array([r.tobytes() for r in whole], pa.binary()), pa.array(cells, pa.binary())],
                    names=["doc_id", "lang", "whole", "sentences"],
                )

    return run


def _mean_batches(model: Model):
    def run(batches):
        k = model.term.shape[1]
        total = np.zeros((len(LANGS), k + 1))
        for batch in batches:
            for b in _chunks(batch):
                s, doc, of, d = model.read(b)
                total += _by(of, np.hstack([s, np.ones((len(s), 1), s.dtype)]), len(LANGS))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "part"])

    return run


def _by(label: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each label."""
    order = np.argsort(label, kind="stable")
    upto = np.searchsorted(label[order], np.arange(n), "right")
    return _row_sums(values[order].astype(np.float64), upto)


def _refine_batches(model: Model):
    """Sums of the sentences nearest to each centroid, weighted by how clear the choice is."""

    def run(batches):
        k, m = model.term.shape[1], len(model.names)
        total = np.zeros((len(LANGS) * m, k + 1))
        for batch in batches:
            for b in _chunks(batch):
                s, doc, of, d = model.read(b)
                if not len(s):
                    continue
                sc = model.scores(s, doc, of, d)
                best = sc.argmax(axis=1)
                two = np.partition(sc, -2, axis=1)[:, -2:]
                clear = two[:, 1] - two[:, 0]
                ok = (two[:, 1] >= 2 * LEAST_COSINE) & (clear > 0.05)
                total += _by(of[ok].astype(np.int64) * m + best[ok], np.hstack([s[ok], np.ones((ok.sum(), 1), s.dtype)]), len(total))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "part"])

    return run


def _assign_batches(model: Model, share: float):
    names = model.names

    def run(batches):
        for batch in batches:
            for b in _chunks(batch):
                s, doc, of, d = model.read(b)
                if not len(s):
                    continue
                sc = model.scores(s, doc, of, d)
                best = np.where(sc.max(axis=1) >= LEAST_COSINE, sc.argmax(axis=1), len(names) - 1)
                m = len(names)
                n = np.bincount(doc * m + best, minlength=b.num_rows * m).reshape(b.num_rows, m)
                part = n / np.maximum(n.sum(axis=1, keepdims=True), 1)
                r, c = np.nonzero(part[:, :-1] >= share)
                ids = b.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[r], pa.int64()), pa.array([names[i] for i in c], pa.string()), pa.array(part[r, c], pa.float64())],
                    names=["doc_id", "subject", "share"],
                )

    return run


def subject_shares(documents: DataFrame, subjects: DataFrame, scratch: Scratch, least_share: float = SHARE, rank: int = RANK) -> DataFrame:
    """``(doc_id, subject, share)``: the share of a document's sentences about each of its subjects."""
    spark = documents.sparkSession
    empty = spark.createDataFrame([], "doc_id long, subject string, share double")
    merged: dict[str, set] = {}
    for r in subjects.where("subject is not null").select("subject", "terms").collect():  # a fixed reference table
        merged.setdefault(r.subject, set()).update(x for x in (r.terms or []) if x)
    named = sorted((s, tuple(sorted(t))) for s, t in merged.items())
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text", "lang")
    split = scratch.keep(spread(texts).mapInArrow(_split_batches, "doc_id long, lang byte, words array<long>, ends array<int>"))
    size = {r.lang: r.n for r in split.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    total = sum(size.values())
    if not named or not total:
        return empty
    least = F.coalesce(*[F.when(F.col("lang") == l, F.lit(max(2.0, n * LEAST_DF))) for l, n in size.items()])
    df = (
        split.select("lang", F.explode(F.array_distinct("words")).alias("w"))
        .groupBy("lang", "w")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= least)
        .orderBy("w")
        .toArrow()
    )
    if not len(df):
        return empty
    known, of_lang = (df.column(c).to_numpy() for c in ("w", "lang"))
    share = df.column("n").to_numpy() / np.array([size.get(l, 1) for l in range(len(LANGS))])[of_lang]
    idf = np.log((1 + np.array([size.get(l, 1) for l in range(len(LANGS))])[of_lang]) / (1 + df.column("n").to_numpy())) + 1e-3
    rows = scratch.keep(split.mapInArrow(_index_batches(known), "doc_id long, lang byte, ids array<int>, ends array<int>"))
    scratch.drop(split)

    # Languages share no term, so A'A is block-diagonal and each block has its own subspace.
    basis = np.random.default_rng(5).standard_normal((len(df), rank))
    image = basis
    for _ in range(POWER_ROUNDS):
        for l in range(len(LANGS)):
            block = np.flatnonzero(of_lang == l)
            if len(block):
                q, _ = np.linalg.qr(image[block])
                basis[block] = 0
                basis[block, : q.shape[1]] = q
        got = _summed(rows.select("ids").mapInArrow(_power_batches(basis.astype(np.float32), idf), "block int, part binary"))
        image = np.concatenate([got[k] for k in sorted(got)]).reshape(len(df), rank)
    # rotate each block to its singular vectors
    term = np.zeros_like(image)
    for l in range(len(LANGS)):
        block = np.flatnonzero(of_lang == l)
        if len(block):
            _, vec = np.linalg.eigh(basis[block].T @ image[block])
            term[block] = basis[block] @ vec[:, ::-1]
            image[block] = image[block] @ vec[:, ::-1]

    names = [s for s, _ in named] + [NONE]
    model = Model(term, idf, np.zeros((len(LANGS), rank)), names)
    said = scratch.keep(rows.mapInArrow(_embed_batches(model), "doc_id long, lang byte, whole binary, sentences binary"))
    scratch.drop(rows)
    got = _summed(said.mapInArrow(_mean_batches(model), "block int, part binary"))[0].reshape(len(LANGS), rank + 1)
    model.mean = got[:, :-1] / np.maximum(got[:, -1:], 1)

    # A term's own vector is the mean of its documents' vectors, a row of A'A times the basis.
    of_term = _unit(image)
    seeds = np.zeros_like(model.centroids)
    for j, (_, words) in enumerate([*named, (NONE, tuple(HOUSEKEEPING))]):
        for phrase in words:
            for w in _WORD.findall(phrase.lower()):
                hashes = [word_hash(w, l) for l in LANGS] if w not in _FUNCTION else []
                found = [(share[i], i) for h, i in zip(hashes, np.minimum(np.searchsorted(known, hashes), len(known) - 1)) if known[i] == h]
                # a word seeds the language it is commonest in, and the class of other languages where it occurs
                for i in {i for _, i in [*sorted(found)[-1:], *(f for f in found if of_lang[f[1]] == LANGS.index("other"))]}:
                    seeds[of_lang[i], j] += _unit(of_term[i] - model.mean[of_lang[i]])
    seeds = _unit(seeds)
    model.centroids = seeds
    for _ in range(REFINE_ROUNDS):
        got = _summed(said.mapInArrow(_refine_batches(model), "block int, part binary"))[0].reshape(len(LANGS), len(names), rank + 1)
        fresh = _unit(got[:, :, :-1])
        known = got[:, :, -1:] >= 3
        model.centroids = np.where(known, _unit(0.3 * seeds + 0.7 * fresh), seeds)
    return said.mapInArrow(_assign_batches(model, least_share), "doc_id long, subject string, share double")

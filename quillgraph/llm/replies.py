"""Problem 3: broken prompt and response pairs.

One pass over each table labels what shows in the record itself (empty, copied, truncated, another
language) and reduces the opening of each reply to a template: words that the corpus of prompts uses as
subject matter, names and numbers become slots. Templates are clustered over five-word shingles, by MinHash
first and by an exact prefix filter for what that leaves, every link verified at a Jaccard similarity of 0.8.
A cluster that recurs across RECURS unrelated prompts, counted exactly, and of whose members at least a third
stand where the task demanded another form, or abstain, is a way of declining; its members that do not
state an abstention are refusals, whatever their length. No list of phrases takes part. Prompts are unrelated
when the sets of their words, function words aside, differ.

Defined results: one row for a record at most, with the latest of repeated rows (by recorded_at or
synced_at, then the greater defect) deciding; a null reply is empty; a null prompt leaves copied and
language undecided; records with a null key are left out; null abstained counts as not abstained; empty
tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.components import components
from quillgraph.runtime import Scratch, spread

#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the a an of and to is isn are was were in on that this it by with from for not no but or as at has have had which what "
    "why how when who does did do can could would will may might must be been i you we they he she his her its their there than "
    "then if without each every some only both neither nor most while my your our me us about between after before over under "
    "yet just one other until since whether although into",
    "de": "der die das den dem des und oder ist sind war waren nicht kein keine ein eine einen einem einer im in am an auf aus bei "
    "mit von vom zu zum zur für durch als wie wer was wann warum wenn dann doch nur auch noch weder viele einige mehrere alle sich "
    "lassen wird werden wurde wurden hat haben ich sie es wir ihr über ohne zwischen nach seit laut erst zuletzt lange selten",
    "fr": "le la les l un une des du de d et ou est sont était étaient ne pas ni que qui quand quels quelle quel pourquoi comment "
    "dans sur sous avec sans pour par chez au aux en ont été je vous nous il elle ils elles ce cette ces son sa ses leur leurs "
    "plusieurs quelques beaucoup toutes tous rarement puis enfin depuis après avant selon aussi entre on y",
    "es": "el la los las un una unos unas de del y o es son era eran no ni que qué quien quién cuando cuándo cómo por para con sin en "
    "sobre entre al se lo le les su sus yo usted nosotros esta este estos estas también además algunos muchos todo rara casi "
    "siempre según después primero desde hasta tras durante hay",
}
_LANG_OF: dict[str, list[str]] = {}
for _l, _w in FUNCTION_WORDS.items():
    for _x in _w.split():
        _LANG_OF.setdefault(_x, []).append(_l)
_ONE = {w: ls[0] for w, ls in _LANG_OF.items() if len(ls) == 1}
_FUNCTION = frozenset(_LANG_OF)

FILLERS = frozenset(["", "n/a", "na", "none", "null", "nil", "-", "--", "---", "...", "…", "todo", "tbd", "undefined", "nan", "\"\"", "''", "[]", "{}", "()", "?"])
RECURS = 3
#: A prompt word is subject matter from this share of the prompts on.
SUBJECT_SHARE = 2e-4
BANDS, ROWS = 20, 4
SIMILAR = 0.8

_FENCE = re.compile(r"^\s*```[A-Za-z0-9_-]*[ \t]*\n?(.*?)\n?\s*```\s*$", re.S)
_OPEN_FENCE = re.compile(r"^\s*```[A-Za-z0-9_-]*[ \t]*\n?")
_INVISIBLE = re.compile("[​-‏⁠-⁤﻿­]")
_WORD = re.compile(r"[^\W_]+")
_CITATION = re.compile(r"\[\[?[^\[\]\n]*\]\]?")
_QUOTED = re.compile(r"“[^”]*”|«[^»]*»|„[^“”]*[“”]|\"[^\"\n]*\"")
_LABEL = re.compile(r"^\s*(?:q|question|frage|pregunta)\s*:\s*", re.I)
_LEAD = re.compile(r"^(?:[^\s.?!:;,“\"]+\s){0,3}[^\s.?!:;,“\"]+\s?:\s+|^again,\s+", re.I)
_SENTENCE_END = re.compile(r"(?<=[.!?…。！？])[\"”»’)\]]*\s+")
_STRING_FIELDS = {
    "extract": "summary", "extract_chunk": "summary", "extract_merge": "summary", "synthesize": "answer", "page_update": "section_md",
    "decompose": "subquestions", "suggest_links": "linked_claims", "contradiction": "findings",
}
#: Fields a sound reply to a task has besides its text.
_SCHEMA = {
    "extract": ("key_claims",), "extract_chunk": ("key_claims",), "extract_merge": ("key_claims",), "synthesize": ("citations",),
    "page_update": ("topic",), "decompose": (), "suggest_links": (), "contradiction": (),
}


def _strings(v, out: list[str], skip=()) -> None:
    if isinstance(v, str):
        out.append(v)
    elif isinstance(v, list):
        for x in v:
            _strings(x, out, skip)
    elif isinstance(v, dict):
        for k, x in v.items():
            if k not in skip:
                _strings(x, out, skip)


def _blank(v) -> bool:
    """No content: blanks, fillers, empty containers, and containers of these. Flags are no content."""
    if v is None or isinstance(v, bool):
        return True
    if isinstance(v, str):
        return _INVISIBLE.sub("", v).strip().lower() in FILLERS
    if isinstance(v, (list, tuple)):
        return all(_blank(x) for x in v)
    if isinstance(v, dict):
        return all(_blank(x) for x in v.values())
    return False


def language(words: list[str]) -> str | None:
    """The language whose function words prevail; None when the evidence is thin."""
    n = {"en": 0, "de": 0, "fr": 0, "es": 0}
    for w in words:
        l = _ONE.get(w)
        if l:
            n[l] += 1
    (a, x), (_, y) = sorted(n.items(), key=lambda p: -p[1])[:2]
    return a if x >= 2 and x >= 2 * y else None


def broken_off(text: str) -> bool:
    """Prose that stops before the end of its last sentence."""
    t = _INVISIBLE.sub("", text).rstrip()
    if t.count("```") % 2:
        return True
    if t.endswith("```"):
        return False
    cited = re.sub(r"(?:\s*\[\[?[^\[\]\n]*\]\]?)+$", "", t).rstrip()
    if not cited:
        return False
    if cited.endswith(("…", "...")):
        return True
    # a citation directly after a word closes the sentence as written: 'is rare [a].' or 'is rare. [a]'
    core = cited.rstrip("\"'”»’)*_`>").rstrip()
    if core.endswith((".", "!", "?", "。", "！", "？")):
        return False
    if t != cited:
        return core[-1:] in ",;:-–(" or "[" in core[-1:]
    return True


def template(sentence: str, subject: frozenset) -> str:
    """A sentence with slots for names, numbers and subject matter."""
    out = []
    for i, m in enumerate(_WORD.finditer(sentence)):
        w = m.group()
        low = w.lower()
        slot = low not in _FUNCTION and (low in subject or w[0].isdigit() or (i and w[0].isupper() and low != "i"))
        if not slot:
            out.append(low)
        elif not out or out[-1] != "_":
            out.append("_")
    return " ".join(out)


def opening(prose: str) -> str:
    t = _CITATION.sub(" ", _INVISIBLE.sub("", prose)).strip().lstrip("->*# ").strip()
    cut = _LEAD.sub("", t, count=1)
    return _SENTENCE_END.split(cut or t, maxsplit=1)[0]


def judge(task: str | None, prompt: str | None, reply: str | None, abstained: bool, subject: frozenset):
    """(defect or None, template or None, stands in the demanded form, abstained)."""
    free = task is None
    if reply is None:
        return "empty", None, False, abstained
    text = _INVISIBLE.sub("", reply).strip()
    if free and abstained and text.lower() in FILLERS:
        return "empty", None, False, abstained
    m = _FENCE.match(text)
    body = m.group(1).strip() if m and (not free or m.group(1).count("```") == 0) else text
    if body.lower() in FILLERS:
        if task == "contradiction" and body == "[]":
            return None, None, True, abstained
        return "empty", None, False, abstained
    value, form, prose = None, free, body
    at = min((i for i in (body.find("{"), body.find("[") if body[:1] == "[" else -1) if i >= 0), default=-1)
    opened = at >= 0 and (not free or body[0] == "{")
    if opened:
        try:
            value, _ = json.JSONDecoder(strict=False).raw_decode(body, at)
        except ValueError:
            value = None
        if value is None:
            rest = _OPEN_FENCE.sub("", body)
            if not free and (rest[:1] in "{[" or len(body[:at].split()) <= 12):
                return "truncated", None, False, abstained
            opened = False
    if opened and isinstance(value, (dict, list)):
        if isinstance(value, dict) and task == "synthesize":
            abstained = value.get("abstained") is True
        if _blank(value):
            sound = (task == "contradiction" and isinstance(value, dict) and "findings" in value) or abstained
            return (None if sound else "empty"), None, sound, abstained
        if isinstance(value, dict):
            field = _STRING_FIELDS.get(task)
            form = field in value and all(k in value for k in _SCHEMA.get(task, ()))
            said: list[str] = []
            _strings(value.get(field) if form and isinstance(value.get(field), str) else value, said)
            prose = "\n".join(said)
            all_said: list[str] = []
            _strings(value, all_said, ("suggested_slug", "page_id", "citations", "tags", "location", "kind", "cross_references", "quotes", "name", "topic"))
            whole = "\n".join(all_said)
        else:
            form, whole = False, prose
    else:
        form = free
        whole = prose
    plain = _CITATION.sub(" ", prose)
    words = _WORD.findall(plain.lower())
    asked = None
    if prompt and prompt.strip():
        asked = _WORD.findall(prompt.lower())
        # a copy keeps the subquestion form sound: only whole messages count there
        if not (form and task in ("decompose", "suggest_links", "contradiction")) and words:
            own = _WORD.findall(_LABEL.sub("", plain.lower().lstrip("> \t\n“\"«*")))
            if _copies(words, own, asked, prompt):
                return "copied", None, form, abstained
    # a reply that has the fields the task demands answers it, unless its one field is prose
    skeleton = template(opening(prose), subject) if free or not form or task == "synthesize" else None
    defect = None
    if (free or not opened or (form and task in ("synthesize", "page_update"))) and broken_off(prose):
        defect = "truncated"
    elif asked:
        spoken = _WORD.findall(_CITATION.sub(" ", _QUOTED.sub(" ", whole)).lower())
        mine, theirs = language(spoken), language(asked)
        if mine and theirs and mine != theirs:
            defect = "language"
    return defect, skeleton, form, abstained


def _copies(words: list[str], own: list[str], asked: list[str], prompt: str) -> bool:
    if own == asked or words == asked:
        return True
    n = len(asked)
    if abs(len(own) - n) <= 0.1 * n + 1 and n > 8:
        from quillgraph.llm.crosssplit import longest_common

        if longest_common(own, asked) >= 0.93 * max(len(own), n):
            return True
    m = re.match(r"\s*(?:Question|Frage|Pregunta)\s*:\s*([^\n]+)", prompt)
    if m and own == _WORD.findall(m.group(1).lower()):
        return True
    return False


_OUT = "tbl string, rec_key string, stamp timestamp, defect string, skeleton string, asked long, form boolean, abstained boolean"


def _judge_batches(subject: frozenset):
    def run(batches):
        import xxhash

        for b in batches:
            cols = [b.column(i).to_pylist() for i in (3, 4, 5, 6)]
            got, seen = [], []
            for task, prompt, reply, abstained in zip(*cols):
                got.append(judge(task, prompt, reply, abstained is True, subject))
                seen.append(None if got[-1][1] is None else xxhash.xxh64_intdigest(" ".join(sorted(set(_WORD.findall((prompt or "").lower())) - _FUNCTION))) >> 1)
            d, s, f, a = zip(*got) if got else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), b.column(2), pa.array(d, pa.string()), pa.array(s, pa.string()), pa.array(seen, pa.int64()),
                    pa.array(f, pa.bool_()), pa.array(a, pa.bool_()),
                ],
                names=[x.split()[0] for x in _OUT.split(", ")],
            )

    return run


def minhash_bands(tokens: list[str], seeds: np.ndarray) -> list[int]:
    """BANDS keys over the five-word shingles of a template (the whole template where it is shorter)."""
    import xxhash

    sh = {" ".join(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))}
    h = np.array([xxhash.xxh64_intdigest(s) for s in sh], np.uint64)
    with np.errstate(over="ignore"):
        x = h[None, :] ^ seeds[:, None]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    low = x.min(axis=1).reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), seed=i) >> 1 for i, r in enumerate(low)]


def _band_batches(batches):
    seeds = np.random.default_rng(11).integers(1, 2**63, BANDS * ROWS).astype(np.uint64)
    for b in batches:
        keys = [minhash_bands(s.split(" "), seeds) for s in b.column("skeleton").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("sid"), pa.array(keys, pa.list_(pa.int64()))], names=["sid", "bands"])


def clustered(skeletons: DataFrame, scratch: Scratch) -> DataFrame:
    """``(sid, cluster)`` of distinct templates ``(sid, skeleton)``: chains of a Jaccard similarity of SIMILAR.

    MinHash links come first, from each member of a bucket to its smallest and greatest member, each verified on
    the exact shingle sets; they are cheap and join most of a cluster, but not all of it. An exact prefix filter
    then finds the rest: sets of a Jaccard similarity j share a shingle among the first n - ceil(j n) + 1 of each
    in one global order, rarest first. Only pairs from different clusters meet there, so a large cluster
    that MinHash has joined costs nothing more.
    """
    bands = skeletons.mapInArrow(_band_batches, "sid long, bands array<long>").select("sid", F.posexplode("bands").alias("band", "k"))
    low = bands.groupBy("band", "k").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low < high")
    links = (
        bands.join(low, ["band", "k"])
        .select("sid", F.explode(F.array("low", "high")).alias("other"))
        .where("sid <> other")
        .select(F.greatest("sid", "other").alias("u"), F.least("sid", "other").alias("v"))
        .distinct()
    )
    sets = scratch.keep(
        skeletons.select("sid", F.expr("split(skeleton, ' ')").alias("w")).select(
            "sid",
            F.expr("transform(array_distinct(transform(sequence(0, greatest(0, size(w) - 5)), i -> array_join(slice(w, i + 1, 5), ' '))), x -> xxhash64(x))").alias("s"),
        )
    )

    def verified(links: DataFrame) -> DataFrame:
        both = links.join(sets.select(F.col("sid").alias("u"), F.col("s").alias("su")), "u").join(
            sets.select(F.col("sid").alias("v"), F.col("s").alias("sv")), "v"
        )
        return both.where(F.size(F.array_intersect("su", "sv")) >= SIMILAR * F.size(F.array_union("su", "sv"))).select("u", "v")

    sure = scratch.keep(verified(links))
    first = components(sure, scratch).withColumnRenamed("u", "sid")
    each = sets.select("sid", F.size("s").alias("n"), F.explode("s").alias("g"))
    ranked = each.join(each.groupBy("g").agg(F.count("*").alias("df")), "g").groupBy("sid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("o"))
    prefix = ranked.select("sid", "n", F.explode(F.slice("o", F.lit(1), F.col("n") - F.ceil(SIMILAR * F.col("n") - 1e-9).cast("int") + 1)).alias("x"))
    prefix = prefix.join(first, "sid", "left").select("sid", "n", F.coalesce("root", "sid").alias("c"), F.col("x.g").alias("g"))
    mixed = prefix.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("g")
    prefix = scratch.keep(prefix.join(mixed, "g", "left_semi"))
    met = prefix.alias("a").join(prefix.alias("b"), "g").where("a.c <> b.c and a.sid > b.sid").where(F.expr(f"least(a.n, b.n) >= {SIMILAR} * greatest(a.n, b.n) - 1e-9"))
    rest = verified(met.select(F.col("a.sid").alias("u"), F.col("b.sid").alias("v")).distinct())
    sure = sure.unionByName(rest)
    roots = components(sure, scratch)
    return skeletons.join(roots.withColumnRenamed("u", "sid"), "sid", "left").select("sid", "skeleton", F.coalesce("root", "sid").alias("cluster"))


def defects(records: DataFrame, answers: DataFrame, scratch: Scratch) -> DataFrame:
    """``(tbl, rec_key, defect)`` of every defective record."""
    said = F.transform(F.filter("messages", lambda m: F.lower(F.trim(m["role"])) == "user"), lambda m: m["content"])
    a = records.where("run_id is not null and seq is not null").select(
        F.lit("training_records").alias("tbl"),
        F.concat_ws(":", "run_id", F.col("seq").cast("string")).alias("rec_key"),
        F.col("recorded_at").cast("timestamp").alias("stamp"),
        F.coalesce("task", F.lit("other")).alias("task"),
        F.array_join(said, "\n").alias("prompt"),
        F.col("raw_output").alias("reply"),
        F.lit(False).alias("abstained"),
    )
    b = answers.where("answer_id is not null").select(
        F.lit("answers").alias("tbl"),
        F.col("answer_id").cast("string").alias("rec_key"),
        F.col("synced_at").cast("timestamp").alias("stamp"),
        F.lit(None).cast("string").alias("task"),
        F.col("question").alias("prompt"),
        F.col("text").alias("reply"),
        F.coalesce("abstained", F.lit(False)).alias("abstained"),
    )
    rows = a.unionByName(b)
    # Subject words: at most (distinct words of a prompt) / SUBJECT_SHARE of them at any scale.
    prompts = a.select("prompt").unionByName(b.select("prompt")).where("prompt is not null")
    n = prompts.count()
    words = (
        prompts.select(F.explode(F.array_distinct(F.split(F.lower("prompt"), r"[^\p{L}\p{N}]+"))).alias("w"))
        .groupBy("w")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= max(2, n * SUBJECT_SHARE))
    )
    subject = frozenset(r.w for r in words.select("w").collect() if r.w)
    seen = scratch.keep(spread(rows).mapInArrow(_judge_batches(subject), _OUT))
    told = seen.where("skeleton <> '' and coalesce(defect, '') not in ('empty', 'copied')")
    per = scratch.keep(
        told.groupBy("skeleton")
        .agg(F.count_if(F.expr("not form or abstained")).alias("odd"), F.count("*").alias("n"))
        .withColumn("sid", F.xxhash64("skeleton"))
    )
    of = scratch.keep(clustered(per.select("sid", "skeleton"), scratch))
    likely = (
        of.join(per.drop("skeleton"), "sid")
        .groupBy("cluster")
        .agg(F.sum("odd").alias("odd"), F.sum("n").alias("n"))
        .where((F.col("n") >= RECURS) & (F.col("odd") * 3 >= F.col("n")))
        .select("cluster")
    )
    ways = of.join(likely, "cluster", "left_semi").select("skeleton", "cluster")
    # distinct prompts of each cluster, counted over rows that have been made distinct before they move
    prompts = told.select("skeleton", "asked").distinct().join(ways, "skeleton").select("cluster", "asked").distinct()
    recurring = prompts.groupBy("cluster").agg(F.count("*").alias("prompts")).where(F.col("prompts") >= RECURS)
    ways = ways.join(recurring, "cluster", "left_semi").select("skeleton", F.lit(True).alias("declining"))
    final = seen.join(ways, "skeleton", "left").withColumn(
        "defect",
        F.when(F.expr("declining and not abstained and coalesce(defect, '') not in ('empty', 'copied')"), "refusal").otherwise(F.col("defect")),
    )
    return (
        final.groupBy("tbl", "rec_key")
        .agg(F.max(F.struct("stamp", F.coalesce("defect", F.lit("")).alias("defect"))).alias("r"))
        .where("r.defect <> ''")
        .select("tbl", "rec_key", F.col("r.defect").alias("defect"))
    )

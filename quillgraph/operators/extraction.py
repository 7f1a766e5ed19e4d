"""Extraction replies as tables: tolerant shapes made one, merged by document, and held to the rules.

A row is one capture: ``(key, title, summary, claims, quotes, entities, topics, tags, slug, author, publisher)`` with
claims array<struct<text, entities>>, quotes array<struct<text, location>> and entities
array<struct<name, kind, blurb>>. Python reads the replies, in batches; the rules are column expressions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillgraph.functions.markup import as_text, find_verbatim, parse_reply, tolerant_items
from quillgraph.functions.text import normalize_ws
from quillgraph.runtime import spread

SHAPE = (
    "title string, summary string, claims array<struct<text: string, entities: array<string>>>, quotes array<struct<text: string, location: string>>, "
    "entities array<struct<name: string, kind: string, blurb: string>>, topics array<string>, tags array<string>, slug string, author string, publisher string"
)
LEAST_BYTES, CLAIMS, QUOTES, TAGS = 15, 12, 6, 6
SLUG = r"^[a-z0-9][a-z0-9-]{1,60}$"


def _named(v, key: str, more: dict) -> list[dict]:
    """Objects with ``key``; a plain text stands for an object with that alone."""
    out = []
    for x in tolerant_items(v):
        if isinstance(x, dict):
            out.append({key: as_text(x.get(key)) or ""} | {k: (as_text(x.get(k)) or "" if d is not list else [t for t in map(as_text, tolerant_items(x.get(k))) if t]) for k, d in more.items()})
        elif (t := as_text(x)) is not None:
            out.append({key: t} | {k: [] if d is list else d for k, d in more.items()})
    return out


def shaped(reply: str | None) -> dict | None:
    """A reply's extraction in the one shape; None where there is none."""
    return shaped_value(parse_reply(reply))


def shaped_value(v) -> dict | None:
    """A parsed reply in the one shape. A bare list is a list of claims; anything else but an object is none."""
    if isinstance(v, list):
        v = {"key_claims": v}
    if not isinstance(v, dict):
        return None
    text = lambda k: as_text(v.get(k)) or ""
    words = lambda k: [t for t in map(as_text, tolerant_items(v.get(k))) if t]
    return {
        "title": text("title") or None, "summary": text("summary"), "claims": _named(v.get("key_claims"), "text", {"entities": list}),
        "quotes": _named(v.get("quotes"), "text", {"location": ""}), "entities": _named(v.get("entities"), "name", {"kind": "entity", "blurb": ""}),
        "topics": words("topics"), "tags": words("tags"), "slug": text("suggested_slug"), "author": text("author") or None, "publisher": text("publisher") or None,
    }


def extractions(replies: DataFrame, column: str = "raw_output") -> DataFrame:
    """The rows whose reply holds an extraction, with its columns in place of the reply."""
    from pyspark.sql.pandas.types import to_arrow_schema

    at = replies.columns.index(column)
    shape = StructType.fromDDL(SHAPE)
    out = StructType([f for f in replies.schema if f.name != column] + list(shape))
    fields = to_arrow_schema(shape)

    def run(batches):
        for b in batches:
            got = [shaped(x) for x in b.column(at).to_pylist()]
            keep = b.filter(pa.array([g is not None for g in got], pa.bool_()))
            ex = pa.Table.from_pylist([g for g in got if g is not None], fields)
            rest = [i for i in range(keep.num_columns) if i != at]
            t = pa.table([*[pa.chunked_array([keep.column(i)]) for i in rest], *ex.columns], names=[*[keep.schema.names[i] for i in rest], *fields.names])
            yield from t.to_batches()

    return spread(replies).mapInArrow(run, out)


def _distinct_by(items: Column, key) -> Column:
    """Items of an array, the first of those with one key."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def merged(parts: DataFrame, key: str, order: str) -> DataFrame:
    """One extraction for each key from its parts, in order: lists joined, the first of case-insensitive equals kept;
    summaries joined; of the other texts the first that is not empty. Topics and tags are one list of lower-case words."""
    low = lambda t: F.lower(F.trim(t))
    rows = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *StructType.fromDDL(SHAPE).names))).alias("p"))
    many = lambda c: F.flatten(F.transform("p", lambda x: F.coalesce(x[c], F.array())))
    texts = lambda c: F.filter(F.transform("p", lambda x: F.trim(F.coalesce(x[c], F.lit("")))), lambda t: t != "")
    words = F.array_distinct(F.filter(F.transform(F.flatten(F.transform("p", lambda x: F.concat(F.coalesce(x["topics"], F.array()), F.coalesce(x["tags"], F.array())))), low), lambda t: t != ""))
    return rows.select(
        key, F.get(texts("title"), 0).alias("title"), F.array_join(texts("summary"), " ").alias("summary"), _distinct_by(many("claims"), lambda c: low(c["text"])).alias("claims"),
        _distinct_by(many("quotes"), lambda q: low(q["text"])).alias("quotes"), _distinct_by(many("entities"), lambda e: low(e["name"])).alias("entities"),
        words.alias("topics"), words.alias("tags"), F.coalesce(F.get(texts("slug"), 0), F.lit("")).alias("slug"), F.get(texts("author"), 0).alias("author"), F.get(texts("publisher"), 0).alias("publisher"),
    )


def verbatim_quotes(rows: DataFrame, key: str, body: str, quotes: str) -> DataFrame:
    """``(key, quotes, dropped)``: quotes that stand in the body, white space aside, as they stand there; and the texts of the others."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            kept, gone = [], []
            for text, qs in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                found = [(q, find_verbatim(text or "", q["text"] or "")) for q in qs or []]
                kept.append([{"text": f, "location": q["location"]} for q, f in found if f])
                gone.append([q["text"] for q, f in found if not f])
            shape = pa.list_(pa.struct([("text", pa.string()), ("location", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, shape), pa.array(gone, pa.list_(pa.string()))], names=[key, "quotes", "dropped"])

    return rows.select(key, body, quotes).mapInArrow(run, f"{key} {kind}, quotes array<struct<text: string, location: string>>, dropped array<string>")


def validated(ex: DataFrame, key: str, body: str, fallback_slug: Column, taken: DataFrame | None = None) -> DataFrame:
    """Extractions held to the rules, with ``warnings``; extractions without a sound claim are left out.

    Claims: white space collapsed, LEAST_BYTES at least, distinct without case, the first CLAIMS. A missing summary
    is made of the first three claims. Quotes: verbatim in the body, the first QUOTES. Entities have names. Tags:
    lower case, blanks as dashes, distinct, the first TAGS. A slug that is malformed is replaced by the fallback; one
    that is taken ``(slug)``, or claimed by a key before it, gets -2, -3 and so on.
    """
    texts = F.transform("claims", lambda c: F.struct(normalize_ws(F.coalesce(c["text"], F.lit(""))).alias("text"), F.coalesce(c["entities"], F.array().cast("array<string>")).alias("entities")))
    rows = ex.withColumn("_all", texts).withColumn("_long", F.filter("_all", lambda c: F.octet_length(c["text"]) >= LEAST_BYTES))
    rows = rows.withColumn("_one", _distinct_by(F.col("_long"), lambda c: F.lower(c["text"]))).where(F.size("_one") > 0)
    quoted = verbatim_quotes(rows, key, body, "quotes").withColumnRenamed("quotes", "_q")
    rows = rows.join(quoted, key)
    summary = F.trim(F.coalesce("summary", F.lit("")))
    tags = F.array_distinct(F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.replace(F.lower(F.trim(t)), F.lit(" "), F.lit("-"))), lambda t: t != ""))
    sound = F.coalesce(F.col("slug").rlike(SLUG), F.lit(False))
    rows = rows.withColumn("_base", F.when(sound, F.col("slug")).otherwise(fallback_slug))
    nth = F.row_number().over(Window.partitionBy("_base").orderBy(key))
    rows = rows.withColumn("_n", nth)
    if taken is not None:
        # the suffixes of a base that exist: as many of the smallest free numbers are handed out in order of the key
        t = taken.select(F.regexp_extract("slug", r"^(.*?)(?:-(\d+))?$", 1).alias("_base"), F.coalesce(F.regexp_extract("slug", r"-(\d+)$", 1).try_cast("int"), F.lit(1)).alias("_i"))
        own = taken.select(F.col("slug").alias("_base"), F.lit(1).alias("_i"))
        used = t.unionByName(own).groupBy("_base").agg(F.array_sort(F.collect_set("_i")).alias("_used"))
        free = F.expr("get(filter(sequence(1, _n + size(coalesce(_used, array()))), i -> not array_contains(coalesce(_used, array()), i)), _n - 1)")
        rows = rows.join(used, "_base", "left").withColumn("_n", free).drop("_used")
    slug = F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", F.col("_n").cast("string")))
    said = lambda cond, text: F.when(cond, text)
    warnings = F.array_compact(
        F.concat(
            F.transform(F.filter("_all", lambda c: (c["text"] != "") & (F.octet_length(c["text"]) < LEAST_BYTES)), lambda c: F.concat(F.lit("dropped junk claim "), c["text"])),
            F.array(
                said(F.size("_one") > CLAIMS, F.concat(F.lit("model produced "), F.size("_one").cast("string"), F.lit(f" claims; keeping the first {CLAIMS}"))),
                said(summary == "", F.lit("no summary: synthesized one from the top claims")),
            ),
            F.transform("dropped", lambda q: F.concat(F.lit("dropped non-verbatim quote: "), F.substring(q, 1, 80))),
            F.array(
                said(~sound & (F.coalesce("slug", F.lit("")) != ""), F.concat(F.lit("malformed slug "), "slug")),
                said(F.col("_n") > 1, F.concat(F.lit("slug taken: "), "_base")),
            ),
        )
    )
    top = F.array_join(F.transform(F.slice("_one", 1, 3), lambda c: c["text"]), " ")
    return rows.select(
        *[c for c in ex.columns if c not in StructType.fromDDL(SHAPE).names], "title", F.when(summary == "", top).otherwise(summary).alias("summary"), F.slice("_one", 1, CLAIMS).alias("claims"),
        F.slice("_q", 1, QUOTES).alias("quotes"), F.filter("entities", lambda e: F.trim(F.coalesce(e["name"], F.lit(""))) != "").alias("entities"), "topics",
        F.slice(tags, 1, TAGS).alias("tags"), slug.alias("slug"), "author", "publisher", warnings.alias("warnings"),
    )

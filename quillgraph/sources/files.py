"""Scan of a vault folder: notes, resources, their metadata files and fingerprints.

A listing has no contents. Bytes are read by ``contents``, in tasks, of exactly the files it is given.
"""

from __future__ import annotations

from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.markup import parsed_notes
from quillgraph.functions.text import lenient_date, note_dir, note_id, note_slug
from quillgraph.operators import resolve
from quillgraph.runtime import spread
from quillgraph.sources.config import Config, glob_regex


def _any(path: Column, globs) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_regex(g))
    return out


def is_note(path: Column, cfg: Config) -> Column:
    return path.endswith(".md") & _any(path, cfg.vault.notes) & ~_any(path, cfg.vault.exclude)


def is_resource(path: Column, cfg: Config) -> Column:
    if cfg.resources is None:
        return F.lit(False)
    return ~path.endswith(".meta.md") & _any(path, cfg.resources.paths) & ~_any(path, cfg.resources.exclude)


def listing(spark: SparkSession, root: str, cfg: Config) -> DataFrame:
    """``(rel_path, layer, size, mtime, uri)`` of every file; a note is never a resource, and metadata files have a layer
    of their own. No file is opened."""
    base = root if "://" in root or root.startswith("file:") else f"file:{root}"
    base = base.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    head = unquote(base.split(":", 1)[1]).lstrip("/")
    rel = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), rf"^[a-z0-9]+:/*\Q{head}\E/", "")
    skip = rel.rlike(r"(^|/)(\.git|\.vault|node_modules)/")
    layer = F.when(is_note(rel, cfg), "note").when(is_resource(rel, cfg), "resource").when(rel.endswith(".meta.md") & F.lit(cfg.resources is not None), "meta")
    return raw.where(~skip).select(rel.alias("rel_path"), layer.alias("layer"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.col("path").alias("uri"))


def _read_batches(batches):
    from pyarrow import fs

    known: dict = {}
    for b in batches:
        out = []
        for uri in b.column("uri").to_pylist():
            scheme, rest = uri.split(":", 1)
            if scheme not in known:
                known[scheme] = fs.LocalFileSystem() if scheme == "file" else fs.FileSystem.from_uri(uri)[0]
            path = "/" + unquote(rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(uri)[1]
            try:
                with known[scheme].open_input_stream(path) as f:
                    out.append(f.read())
            except FileNotFoundError:  # it went after the listing; the next one will not have it
                out.append(None)
        yield pa.RecordBatch.from_arrays([b.column("rel_path"), pa.array(out, pa.binary())], names=["rel_path", "content"])


def contents(files: DataFrame) -> DataFrame:
    """``(rel_path, content)`` of files ``(rel_path, uri)``; each is opened once, by the task that has its row."""
    return spread(files.select("rel_path", "uri")).mapInArrow(_read_batches, "rel_path string, content binary").where("content is not null")


def fingerprints(files: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``(rel_path, size, mtime, content_hash)``; a file of the same size and time keeps its hash and is not opened."""
    now = files.where("layer is not null")
    if before is None:
        read, kept = now, None
    else:
        old = before.select("rel_path", F.col("size").alias("s"), F.col("mtime").alias("m"), F.col("content_hash"))
        same = F.coalesce(F.col("size").eqNullSafe(F.col("s")) & F.col("mtime").eqNullSafe(F.col("m")) & F.col("content_hash").isNotNull(), F.lit(False))
        both = now.join(old, "rel_path", "left")
        read, kept = both.where(~same), both.where(same).select("rel_path", "size", "mtime", "content_hash")
    hashed = contents(read).select("rel_path", F.sha2("content", 256).alias("content_hash"))
    fresh = read.select("rel_path", "size", "mtime").join(hashed, "rel_path")
    return fresh if kept is None else fresh.unionByName(kept)


def meta_paths(resources: DataFrame, all_paths: DataFrame) -> DataFrame:
    """``(rel_path, meta_path)``: the file itself when markdown, else its .meta.md companion, else null."""
    have = all_paths.select(F.col("rel_path").alias("meta"))
    r = resources.select("rel_path").withColumn("a", F.concat(F.regexp_replace("rel_path", r"\.[^./]*$", ""), F.lit(".meta.md"))).withColumn("b", F.concat("rel_path", F.lit(".meta.md")))
    r = r.join(have.withColumnRenamed("meta", "ma"), F.col("a") == F.col("ma"), "left").join(have.withColumnRenamed("meta", "mb"), F.col("b") == F.col("mb"), "left")
    return r.select("rel_path", F.when(F.col("rel_path").endswith(".md"), F.col("rel_path")).otherwise(F.coalesce("ma", "mb")).alias("meta_path"))


def texts(files: DataFrame, overlays: DataFrame | None = None) -> DataFrame:
    """``(rel_path, text)`` of files; a text that is open in an editor ``(rel_path, text)`` hides the file's."""
    if overlays is None:
        return contents(files).select("rel_path", F.decode("content", "utf-8").alias("text"))
    shown = files.select("rel_path").join(overlays.select("rel_path", "text"), "rel_path")
    disk = contents(files.join(overlays.select("rel_path"), "rel_path", "left_anti"))
    return disk.select("rel_path", F.decode("content", "utf-8").alias("text")).unionByName(shown)


def read_notes(files: DataFrame, cfg: Config, overlays: DataFrame | None = None) -> DataFrame:
    """Parsed notes of the files given; ``last_of_id`` drops what a later path of the same id hides."""
    fields = tuple(dict.fromkeys(e.field for e in cfg.edges if e.source == "frontmatter"))
    names = {k: v for k, v in cfg.fields.items() if k in ("title", "kind", "status", "created", "updated")} | {"tags": cfg.tag_field}
    prefix = cfg.vault.id_strip_prefix if cfg.markdown_paths else None
    p = parsed_notes(texts(files.where("layer = 'note'"), overlays), fields, names, cfg.inline_tags, prefix)
    path, pre = F.col("path"), cfg.vault.id_strip_prefix
    n = p.withColumns({"id": note_id(path, pre), "slug": note_slug(path, pre), "dir": note_dir(path, pre)})
    return n.withColumns({"title": F.coalesce("title", "id"), "created": lenient_date(F.col("created")), "updated": lenient_date(F.col("updated"))})


def last_of_id(notes: DataFrame) -> DataFrame:
    """Of notes with one id, which paths that differ in '/' and '-' can have, the last path's."""
    last = notes.groupBy("id").agg(F.max("path").alias("path"))
    return notes.join(last, ["id", "path"], "left_semi")


RESOURCE = "rel_path string, title string, captured date, source_date date, url string, body_text string, body_hash string, meta_path string"


def read_resources(files: DataFrame, cfg: Config, only: DataFrame | None = None) -> DataFrame:
    """``(rel_path, title, captured, source_date, url, body_text, body_hash, meta_path)``; without metadata there is no row.

    With ``only`` ``(rel_path)`` no metadata of other resources is opened.
    """
    if cfg.resources is None:
        return files.sparkSession.createDataFrame([], RESOURCE)
    res = files.where("layer = 'resource'")
    meta = meta_paths(res, files).where("meta_path is not null")
    if only is not None:
        meta = meta.join(only.select("rel_path"), "rel_path", "left_semi")
    wanted = files.join(meta.select(F.col("meta_path").alias("rel_path")).distinct(), "rel_path", "left_semi")
    p = parsed_notes(texts(wanted), (), {}, False)
    j = meta.join(p, meta["meta_path"] == p["path"])
    get = lambda k: F.get_json_object("frontmatter_json", f"$.{k}")
    own = F.col("rel_path") == F.col("meta_path")
    urls = F.array_compact(F.array(*[get(k) for k in cfg.resources.url_fields]))
    return j.select(
        "rel_path", F.coalesce("title", F.element_at(F.split("rel_path", "/"), -1)).alias("title"),
        lenient_date(get(cfg.resources.date_fields.get("captured", "captured_at"))).alias("captured"),
        lenient_date(get(cfg.resources.date_fields.get("source", "source_date"))).alias("source_date"),
        F.get(F.filter(urls, lambda u: u.rlike("^(http|file:)")), 0).alias("url"),
        F.when(own, F.col("body_text")).alias("body_text"), F.when(own, F.col("body_hash")).alias("body_hash"), "meta_path",
    )


def graph_edges(notes: DataFrame, cfg: Config, among: DataFrame | None = None) -> DataFrame:
    """All configured edges and the tags of notes, resolved among ``among`` (all notes) if that is another set."""
    out = resolve.tag_edges(notes)
    for e in cfg.edges:
        if e.source == "wikilinks":
            out = out.unionByName(resolve.wikilink_edges(notes, e.name, among))
        else:
            out = out.unionByName(resolve.field_edges(notes, e.field, e.name, e.target == "resource", among))
    return out


def note_targets(notes: DataFrame, cfg: Config) -> DataFrame:
    """``(src, dir, pos, target)`` of everything in notes that is resolved to a note: links and fields."""
    out = resolve.note_links(notes).select("src", "dir", "pos", "target")
    named = [e.field for e in cfg.edges if e.source == "frontmatter" and e.target == "note"]
    f = notes.select(F.col("id").alias("src"), "dir", F.posexplode("fields").alias("pos", "f")).where(F.col("f.field").isin(named))
    return out.unionByName(f.select("src", "dir", (-F.col("pos") - 1).alias("pos"), F.col("f.value").alias("target")))

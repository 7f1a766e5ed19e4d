"""The ingest dataflow around a teacher model: stages, gates, planned writes and rendered pages."""

from __future__ import annotations

import json
import os
import posixpath
import re
import subprocess
from dataclasses import dataclass, field
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.markup import add_list_item, chunk_body, set_scalar, split_frontmatter
from quillgraph.functions.text import normalize_ws
from quillgraph.operators.extraction import shaped_value
from quillgraph.operators.resolve import resolve

# --- gates over tables


def claim_targets(claims: DataFrame, column: str) -> DataFrame:
    """The rows with one ``target`` for each link in a text column."""
    return claims.withColumn("target", F.explode(F.regexp_extract_all(column, F.lit(r"\[\[([^\]|#\n]+)"), F.lit(1)))).drop(column)


def links_to(texts: DataFrame, notes: DataFrame, note: str) -> DataFrame:
    """``(key)`` of texts ``(key, dir, text)`` with a link that resolves to a note."""
    return resolve(claim_targets(texts, "text"), notes).where(F.col("dst") == note).select("key").distinct()


def sanitize_links(texts: DataFrame, notes: DataFrame) -> DataFrame:
    """``(key, text)`` of texts ``(key, dir, text)`` with unresolvable links put back to their words.

    The broken targets of a text are few, so they are folded over its own string.
    """
    broken = resolve(claim_targets(texts.select("key", "dir", "text"), "text"), notes).where("outcome <> 'resolved'")
    per = broken.groupBy("key").agg(F.collect_set("target").alias("bad"))
    undo = F.aggregate(
        F.coalesce("bad", F.array().cast("array<string>")), F.col("text"),
        lambda t, b: F.regexp_replace(
            F.regexp_replace(t, F.concat(F.lit(r"\[\[\Q"), b, F.lit(r"\E(?:#[^\]|\n]*)?\|([^\]\n]*)\]\]")), F.lit("$1")),
            F.concat(F.lit(r"\[\[\Q"), b, F.lit(r"\E(?:#[^\]|\n]*)?\]\]")), F.regexp_replace(F.element_at(F.split(b, "/"), -1), r"([\\$])", r"\\$1"),
        ),
    )
    return texts.join(per, "key", "left").select("key", undo.alias("text"))


def free_slugs(rows: DataFrame, slug: str, order: str, existing: DataFrame | None = None) -> DataFrame:
    """Rows with ``free_slug``: the slug, or with -2, -3 … after those that come before it or exist."""
    n = F.row_number().over(Window.partitionBy(slug).orderBy(order))
    out = rows.withColumn("_n", n)
    if existing is not None:
        taken = existing.select(F.regexp_replace("slug", r"-\d+$", "").alias(slug)).groupBy(slug).agg(F.count("*").alias("_t"))
        out = out.join(taken, slug, "left").withColumn("_n", F.col("_n") + F.coalesce("_t", F.lit(0))).drop("_t")
    return out.withColumn("free_slug", F.when(F.col("_n") == 1, F.col(slug)).otherwise(F.concat_ws("-", slug, F.col("_n").cast("string")))).drop("_n")


def valid_references(refs: DataFrame, candidates: DataFrame, notes: DataFrame, most: int, not_kind: str = "source") -> DataFrame:
    """``(run, pos, id)`` of references ``(run, pos, dir, target)`` that resolve to a candidate ``(run, id)`` of another kind."""
    got = resolve(refs, notes).where("outcome = 'resolved'").select("run", "pos", F.col("dst").alias("id"))
    got = got.join(candidates.select("run", "id").distinct(), ["run", "id"], "left_semi")
    got = got.join(notes.where(F.coalesce("kind", F.lit("")) != not_kind).select("id"), "id", "left_semi")
    first = got.groupBy("run", "id").agg(F.min("pos").alias("pos"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("run").orderBy("pos", "id"))).where(F.col("n") <= most).select("run", "pos", "id")


def valid_contradictions(findings: DataFrame, pages: DataFrame, claims: DataFrame) -> DataFrame:
    """Findings ``(run, page_id, existing_text, new_claim)`` that quote the page and one of the run's claims."""
    p = pages.select(F.col("id").alias("page_id"), F.col("body_text").alias("_b"))
    got = findings.join(p, "page_id").where((normalize_ws(F.col("existing_text")) != "") & normalize_ws(F.col("_b")).contains(normalize_ws(F.col("existing_text"))))
    c = claims.select("run", F.lower(normalize_ws(F.col("text"))).alias("_c")).distinct()
    return got.withColumn("_c", F.lower(normalize_ws(F.col("new_claim")))).join(c, ["run", "_c"], "left_semi").drop("_b", "_c")


def relevant_claims(claims: DataFrame, entities: DataFrame, pages: DataFrame, notes: DataFrame) -> DataFrame:
    """``(run, page_id, pos, text)``: the claims worth showing for each page of a run.

    Of claims ``(run, pos, text, dir)`` those that link to the page ``(run, page_id, title)`` or have an entity
    ``(run, pos, name)`` whose name contains the title or is contained in it; where there is none, all.
    """
    each = claims.join(pages, "run")
    links = resolve(claim_targets(claims, "text"), notes).where("outcome = 'resolved'").select("run", "pos", F.col("dst").alias("page_id")).distinct()
    t, e = F.lower("title"), F.lower("name")
    named = entities.where(F.trim("name") != "").join(pages, "run").where(e.contains(t) | t.contains(e)).select("run", "pos", "page_id")
    hits = links.unionByName(named).distinct().withColumn("_hit", F.lit(True))
    w = Window.partitionBy("run", "page_id")
    out = each.join(hits, ["run", "pos", "page_id"], "left").withColumn("_any", F.max(F.coalesce("_hit", F.lit(False))).over(w))
    return out.where("_hit or not _any").select("run", "page_id", "pos", "text")


def near_duplicates(neighbours: DataFrame, most_distance: float = 0.35) -> DataFrame:
    """``(query, id, distance)`` of neighbours nearer than a distance."""
    return neighbours.select("query", "id", F.round(1 - F.col("score"), 6).alias("distance")).where(F.col("distance") < most_distance)


def suspected_duplicates(text_hits: DataFrame, vector_hits: DataFrame | None, notes: DataFrame, kind: str = "source", most: int = 3, most_distance: float = 0.35) -> DataFrame:
    """``(query, id, via, score)``: notes of a kind that a capture may repeat: the first ``most`` of the best 8 by words
    ``(query_id, id, score, rank)``, and by vector ``(query, id, score)`` any other nearer than a distance (its score)."""
    own = notes.where(F.col("kind") == kind).select("id")
    t = text_hits.where("rank <= 8").join(own, "id", "left_semi")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))
    out = t.withColumn("_n", nth).where(F.col("_n") <= most).select(F.col("query_id").alias("query"), "id", F.lit("fts").alias("via"), "score")
    if vector_hits is None:
        return out
    v = near_duplicates(vector_hits, most_distance).join(own, "id", "left_semi").join(out.select("query", "id"), ["query", "id"], "left_anti")
    return out.unionByName(v.select("query", "id", F.lit("vector").alias("via"), F.col("distance").alias("score")))


def page_updates(updates: DataFrame, pages: DataFrame, notes: DataFrame, today: date, field: str = "source_refs") -> DataFrame:
    """``(key, page_id, path, heading, section, content, problem)``: what becomes of each proposed section.

    Updates are ``(key, page_id, topic, section_md, relevant, source_id, source_slug, raw_path)``, pages
    ``(id, dir, path, text)``. Headings in a section are flattened and broken links put back to words; it must cite
    the source; its own heading is one the page does not have. The page gets the capture in ``field`` and today as
    ``updated``. A row with a problem has no content.
    """
    u = updates.where("relevant and trim(coalesce(section_md, '')) <> ''").join(pages.select(F.col("id").alias("page_id"), "dir", "path", F.col("text").alias("_page")), "page_id")
    flat = F.trim(F.regexp_replace("section_md", r"(?m)^#+[ \t]*", ""))
    clean = sanitize_links(u.select(F.struct("key", "page_id").alias("key"), "dir", flat.alias("text")), notes).select("key.*", F.col("text").alias("section"))
    u = u.join(clean, ["key", "page_id"])
    cited = resolve(claim_targets(u.select("key", "page_id", "source_id", "dir", "section"), "section"), notes)
    cited = cited.where("dst = source_id").select("key", "page_id").distinct().withColumn("_cites", F.lit(True))
    u = u.join(cited, ["key", "page_id"], "left")
    topic = F.regexp_replace(normalize_ws(F.coalesce("topic", F.lit(""))), r"^[# ]+|[# ]+$", "")
    topic = F.when(topic == "", "From ingest").otherwise(topic)
    head = lambda n: F.concat(F.lit("## "), topic, F.when(n > 1, F.concat(F.lit(" — "), n.cast("string"))).otherwise(""), F.lit(f" ({today} ingest)"))
    # one number more than the page has lines of that kind is always free
    most = F.size(F.split("_page", "\n## ")) + 1
    u = u.withColumn("heading", F.get(F.filter(F.transform(F.sequence(F.lit(1), most), head), lambda h: ~F.col("_page").contains(h)), 0))

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            content, problem = [], []
            for r in rows:
                try:
                    if not r["_cites"]:
                        raise ValueError(f"the section never cites [[{r['source_slug']}]]")
                    base = set_scalar(add_list_item(r["_page"], field, r["raw_path"]), "updated", str(today))
                    content.append(base + ("" if base.endswith("\n") else "\n") + f"\n{r['heading']}\n\n{r['section'].strip()}\n")
                    problem.append(None)
                except ValueError as e:
                    content.append(None)
                    problem.append(str(e))
            cols = [b.column(c) for c in ("key", "page_id", "path", "heading", "section")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(content, pa.string()), pa.array(problem, pa.string())], names=["key", "page_id", "path", "heading", "section", "content", "problem"])

    kinds = dict(u.dtypes)
    wanted = u.select("key", "page_id", "path", "heading", "section", "_cites", "_page", "source_slug", "raw_path")
    return wanted.mapInArrow(run, f"key {kinds['key']}, page_id string, path string, heading string, section string, content string, problem string")


def batches(pages: DataFrame, path: str, size: int) -> DataFrame:
    """``(path, batch)``: pages in the order of their hashes, so many to a batch.

    Ranks are counted within ranges of the hash and added up, so no task sorts all pages.
    """
    h = pages.select(path, F.sha2(path, 256).alias("_h")).withColumn("_r", F.substring("_h", 1, 2))
    n = h.groupBy("_r").agg(F.count("*").alias("_n"))  # 256 rows
    before = n.withColumn("_b", F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))).select("_r", F.coalesce("_b", F.lit(0)).alias("_b"))
    ranked = h.withColumn("_k", F.row_number().over(Window.partitionBy("_r").orderBy("_h", path)) - 1).join(F.broadcast(before), "_r")
    return ranked.select(path, F.floor((F.col("_b") + F.col("_k")) / size).cast("int").alias("batch"))


# --- stages


FULL = "Reply with the whole JSON object: title, summary, key_claims, quotes, entities, topics, suggested_slug, tags, author, publisher."


def _usable(ex: dict | None) -> bool:
    return bool(ex and ex["summary"].strip() and ex["claims"])


def extract(teacher, title: str, body: str, cap: int = 28_000) -> dict | None:
    """One extraction of a capture, in the shape of ``extraction.SHAPE``.

    A short body is one call, asked again once when claims came without a summary. A long one is a call for each
    chunk and one to merge them; where that gives no summary or no claims, the parts are joined in document order.
    """
    ask = lambda task, *texts: shaped_value(teacher.call(task, [{"role": "user", "content": t} for t in texts]))
    prompt = lambda chunk: f"title: {title}\n\n{chunk}"
    chunks = chunk_body(body, cap)
    if len(chunks) == 1:
        got = ask("extract", prompt(chunks[0]))
        if got and got["claims"] and not got["summary"].strip():
            again = ask("extract", prompt(chunks[0]), FULL)
            got = again if _usable(again) else got
        return got
    parts = [p for p in (ask("extract_chunk", prompt(c)) for c in chunks) if p]
    if not parts:
        return None
    got = ask("extract_merge", "\n".join(json.dumps(p, ensure_ascii=False) for p in parts))
    return got if _usable(got) else joined(parts)


def joined(parts: list[dict]) -> dict:
    """``extraction.merged`` of one document's parts, without a table."""
    def distinct(field, key):
        seen, out = set(), []
        for x in (x for p in parts for x in p[field]):
            if key(x).strip().lower() not in seen:
                seen.add(key(x).strip().lower())
                out.append(x)
        return out

    words = list(dict.fromkeys(t.strip().lower() for p in parts for t in [*p["topics"], *p["tags"]] if t.strip()))
    scalar = lambda k: next((p[k] for p in parts if p[k] and p[k].strip()), None)
    return {
        "title": scalar("title"), "summary": " ".join(p["summary"].strip() for p in parts if p["summary"].strip()), "claims": distinct("claims", lambda c: c["text"]),
        "quotes": distinct("quotes", lambda q: q["text"]), "entities": distinct("entities", lambda e: e["name"]), "topics": words, "tags": words,
        "slug": scalar("slug") or "", "author": scalar("author"), "publisher": scalar("publisher"),
    }


def preflight(path: str, root: str, cfg, read=None, force: bool = False) -> tuple[str, str, list[str]]:
    """(vault path, text, warnings) of a capture that may be ingested; an error says why another may not."""
    from quillgraph.functions.markup import normalize_path
    from quillgraph.sources.config import glob_regex

    rel = os.path.relpath(os.path.realpath(path), os.path.realpath(root)) if os.path.isabs(path) else path
    rel = normalize_path(rel.replace(os.sep, "/"))
    hit = lambda globs: any(re.match(glob_regex(g), rel) for g in globs)
    if rel is None or rel.startswith("../"):
        raise ValueError(f"{path} lies outside the vault")
    if cfg.resources is None or rel.endswith(".meta.md") or not hit(cfg.resources.paths) or hit(cfg.resources.exclude):
        raise ValueError(f"{rel} is not a resource of this vault")
    if not rel.endswith(".md"):
        raise ValueError(f"{rel} is not markdown")
    if not any(e.target == "resource" for e in cfg.edges):
        raise ValueError("no edge leads to resources")
    if read is None:
        with open(os.path.join(root, rel), encoding="utf-8") as f:
            text = f.read()
    else:
        text = read(rel)
    if not split_frontmatter(text)[1].strip():
        raise ValueError(f"{rel} has no body")
    return rel, text, clean_tree(root, cfg.vault.id_strip_prefix.rstrip("/") or ".", force)


@dataclass
class Report:
    """What an ingest did."""

    run_id: str
    raw_path: str
    already_ingested: str | None = None
    source_page: str | None = None
    pages_created: list = field(default_factory=list)
    pages_updated: list = field(default_factory=list)
    contradictions: list = field(default_factory=list)
    near_duplicates: list = field(default_factory=list)
    warnings: list = field(default_factory=list)
    training_records: int = 0
    dry_run: bool = False
    planned: list = field(default_factory=list)


def ingest_summary(reports: DataFrame) -> DataFrame:
    """One row over reports ``(run_id, pages_created, pages_updated, warnings, training_records)``, with all warnings in order of run."""
    return reports.agg(
        F.count("*").alias("runs"), F.sum("training_records").alias("training_records"), F.sum(F.size("pages_created")).alias("pages_created"), F.sum(F.size("pages_updated")).alias("pages_updated"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("run_id", "warnings"))), lambda r: r["warnings"])).alias("warnings"),
    )


def links_prompt(claims: list[str], candidates: list[tuple[str, str]], slug: str) -> list[dict]:
    """The messages that ask for links: numbered claims, then the pages that may be linked."""
    lines = [f"{i}. {c}" for i, c in enumerate(claims, 1)] + ["", f"New page: {slug}", "Candidates:"] + [f"- [[{i}]] {t}" for i, t in candidates]
    return [{"role": "system", "content": "Link each claim to the candidate pages it mentions. Keep the wording. Answer as JSON."}, {"role": "user", "content": "\n".join(lines)}]


# --- pages and writes


#: How a conflict, an ingest's heading and the lines of the log are worded.
CONFLICT = '- Conflicts with [[{page_id}]]: it says "{existing_text}", this source claims "{new_claim}". {explanation}'
FROM_INGEST = "## From ingest ({today})"
LOG = {
    "head": "## [{today}] ingest | {title}", "source": "- source: {0}", "created": "- source page created: {0}", "updated": "- pages updated: {0}", "new": "- pages created: {0}",
    "against": "- contradictions raised: {0} ({1})", "near": "- near-duplicates flagged: {0}", "run": "- run: {0} (model {1})",
}


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _page(head: list[tuple[str, str | None]], parts: list[str]) -> str:
    """A page of frontmatter lines (those with a value) and blocks."""
    front = "\n".join(f"{k}: {v}" for k, v in head if v)
    return f"---\n{front}\n---\n\n" + "\n\n".join(p for p in parts if p) + "\n"


def _listed(title: str, lines: list[str]) -> str:
    return f"## {title}\n\n" + "\n".join(lines) if lines else ""


def render_source(title: str, capture: str, today: date, ex: dict, references=(), contradictions=(), captured: date | None = None, source_date: date | None = None, owner: str = "", model: str = "") -> str:
    """The page of a capture: frontmatter, summary, claims, quotes, contradictions and cross-references."""
    head = [
        ("title", _quoted(title)), ("kind", "source"), ("status", "draft"), ("updated", str(today)), ("captured_at", captured and str(captured)), ("source_date", source_date and str(source_date)),
        ("source_refs", f"[{capture}]"), ("author", ex.get("author") and _quoted(ex["author"])), ("publisher", ex.get("publisher") and _quoted(ex["publisher"])),
        ("tags", f"[{', '.join(ex.get('tags') or [])}]"), ("contradicts", contradictions and f"[{', '.join(c['page_id'] for c in contradictions)}]"), ("owner", owner), ("ingested_by", model),
    ]
    said = lambda q: f'> "{q["text"].strip()}"' + (f" — {q['location'].strip()}" if (q.get("location") or "").strip() else "")
    against = [CONFLICT.format(**{k: str(c[k]).strip() for k in ("page_id", "existing_text", "new_claim", "explanation")}) for c in contradictions]
    return _page(head, [
        f"# {title}", f"## Summary\n\n{(ex.get('summary') or '').strip()}", _listed("Key claims", [f"- {c['text'].strip()}" for c in ex.get("claims") or []]),
        _listed("Quotes", [said(q) for q in ex.get("quotes") or []]), _listed("Contradictions", against), _listed("Cross-references", [f"- [[{r}]]" for r in references]),
    ])


def render_new_page(spec: dict, claims: list[str], source_slug: str, today: date, owner: str = "", model: str = "") -> str:
    """A first page for a name: what it is, the claims that link to it, and where they come from."""
    head = [("title", _quoted(spec["title"])), ("kind", spec["kind"]), ("status", "draft"), ("updated", str(today)), ("tags", "[]"), ("owner", owner), ("ingested_by", model)]
    body = [f"# {spec['title']}", (spec.get("blurb") or "").strip(), FROM_INGEST.format(today=today), "\n".join(f"- {c}" for c in claims), f"Source: [[{source_slug}]]"]
    return _page(head, body)


def log_entry(today: date, title: str, report: Report, model: str = "") -> str:
    """What is appended to the log for a run."""
    names = lambda x: ", ".join(x) or "none"
    near = [f"{d['id']} ({d['via']}, {d['score']:.2f})" for d in report.near_duplicates]
    lines = [
        LOG["source"].format(report.raw_path), LOG["created"].format(report.source_page or "none"), LOG["updated"].format(names(report.pages_updated)), LOG["new"].format(names(report.pages_created)),
        report.contradictions and LOG["against"].format(len(report.contradictions), "; ".join(c["page_id"] for c in report.contradictions)),
        near and LOG["near"].format(", ".join(near)), LOG["run"].format(report.run_id, model),
    ]
    return "\n" + "\n".join([LOG["head"].format(today=today, title=title), *(x for x in lines if x)]) + "\n"


def update_section(topic: str, body: str, source: str, today: date, page: str) -> str:
    """A dated section for a page; headings in the body are flattened, the source is cited, the heading is free."""
    text = re.sub(r"(?m)^#+\s*", "", body).strip()
    if f"[[{source}" not in text:
        text += f" [[{source}]]"
    n, head = 1, f"## {topic} ({today} ingest)"
    while head in page:
        n += 1
        head = f"## {topic} — {n} ({today} ingest)"
    return f"\n{head}\n\n{text}\n"


@dataclass(frozen=True)
class Write:
    path: str
    text: str
    action: str  # create, append or update


def flush(writes: list[Write], root: str, note_folder: str, raw_folders: tuple[str, ...] = ("raw",)) -> list[str]:
    """Write planned pages below a local folder or a URI of any file system that pyarrow knows.

    Every path lies in the note folder and outside the raw layer; a new page hides no old one. Everything is checked
    before anything is written, and a file changes by a rename.
    """
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(root))
    there = lambda p: store.get_file_info(p).type != fs.FileType.NotFound
    full = {}
    for w in writes:
        rel = posixpath.normpath(w.path)
        if not rel.startswith(note_folder.rstrip("/") + "/") or rel.split("/")[0] in raw_folders:
            raise ValueError(f"{w.path} lies outside the notes")
        if w.action == "create" and there(f"{base}/{rel}"):
            raise FileExistsError(w.path)
        full[w] = f"{base}/{rel}"
    for w, p in full.items():
        store.create_dir(posixpath.dirname(p), recursive=True)
        text = w.text.encode()
        if w.action == "append" and there(p):
            with store.open_input_stream(p) as f:
                text = f.read() + text
        with store.open_output_stream(p + ".tmp") as f:
            f.write(text)
        store.move(p + ".tmp", p)
    return [w.path for w in writes]


def clean_tree(root: str, scope: str = ".", force: bool = False) -> list[str]:
    """Warnings about uncommitted changes; an error for them unless forced. A folder without git only warns."""
    got = subprocess.run(["git", "-C", root, "status", "--porcelain", "--", scope], capture_output=True, text=True)
    if got.returncode:
        return ["not a git repository"]
    if got.stdout.strip() and not force:
        raise RuntimeError("there are uncommitted changes")
    return ["there are uncommitted changes"] if got.stdout.strip() else []

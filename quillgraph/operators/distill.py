"""Training pairs mined from accepted pages and from recorded runs: what survives on a page is the label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import bullets, is_valid_split, normalize_ws, section, strip, strip_links
from quillgraph.operators.extraction import verbatim_quotes

WINDOW = 28_000
_LINK = r"\[\[([^\]\n]*)\]\]"


def _links(c: Column) -> Column:
    """Targets and what is shown of the wikilinks of a text, as array<struct<target, shown>>."""

    def one(l):
        target = F.trim(F.regexp_extract(l, r"^([^|#]*)", 1))
        alias = F.trim(F.regexp_extract(l, r"\|(.*)$", 1))
        return F.struct(target.alias("target"), F.when(alias != "", alias).otherwise(F.element_at(F.split(target, "/"), -1)).alias("shown"))

    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_LINK), F.lit(1)), one), lambda l: l["target"] != "")


def reconstructed(pages: DataFrame, new_page_dirs: dict[str, str]) -> DataFrame:
    """``(id, extraction, linked_claims, cross_references, gold)``: the reply a model would have had to give for an accepted page.

    Pages are ``(id, slug, body_text, frontmatter_json, raw_text)``; ``extraction`` is JSON. Claims are the bullets of
    their section, without and with links; entities are what the page links to in the folders of new pages; quotes
    are those that still stand in the capture. Pages without a summary or without claims are left out.
    """
    body = F.col("body_text")
    claims = F.filter(bullets(section(body, "Key claims")), lambda c: F.trim(c) != "")
    summary = normalize_ws(section(body, "Summary"))
    p = pages.withColumn("_claims", claims).withColumn("_summary", summary).where((F.size("_claims") > 0) & (F.col("_summary") != ""))
    quote = F.transform(
        F.filter(F.split(section(body, "Quotes"), "\n"), lambda l: l.startswith("> ")),
        lambda l: F.struct(
            F.regexp_replace(F.trim(F.regexp_replace(F.substring(l, 3, 1_000_000), r" — [^—]*$", "")), r'^"+|"+$', "").alias("text"),
            F.regexp_extract(l, r" — ([^—]*)$", 1).alias("location"),
        ),
    )
    quotes = verbatim_quotes(p.select("id", "raw_text", quote.alias("q")), "id", "raw_text", "q").select("id", "quotes")
    kinds = F.create_map(*[F.lit(x) for kv in new_page_dirs.items() for x in kv]) if new_page_dirs else F.create_map().cast("map<string,string>")
    folder = lambda t: F.regexp_extract(F.lower(t), r"^([^/]*)/", 1)
    known = F.filter(_links(body), lambda l: folder(l["target"]).isin(*new_page_dirs))
    names = F.transform(known, lambda l: F.lower(l["shown"]))
    entities = F.transform(
        F.filter(known, lambda l, i: F.array_position(names, F.lower(l["shown"])) == i + 1),
        lambda l: F.struct(l["shown"].alias("name"), kinds[folder(l["target"])].alias("kind"), F.lit("").alias("blurb")),
    )
    get = lambda k: F.get_json_object("frontmatter_json", f"$.{k}")
    tags = F.coalesce(F.from_json(get("tags"), "array<string>"), F.array().cast("array<string>"))
    ex = F.struct(
        get("title").alias("title"), F.col("_summary").alias("summary"),
        F.transform("_claims", lambda c: F.struct(normalize_ws(strip_links(c)).alias("text"), F.transform(_links(c), lambda l: l["shown"]).alias("entities"))).alias("key_claims"),
        F.col("quotes"), entities.alias("entities"), tags.alias("topics"), F.col("slug").alias("suggested_slug"), tags.alias("tags"), get("author").alias("author"), get("publisher").alias("publisher"),
    )
    gold = F.array_distinct(F.flatten(F.transform("_claims", lambda c: F.transform(_links(c), lambda l: F.replace(F.lower(l["target"]), F.lit("/"), F.lit("-"))))))
    cross = F.transform(_links(section(body, "Cross-references")), lambda l: l["target"])
    return p.join(quotes, "id").select("id", F.to_json(ex, {"ignoreNullFields": "false"}).alias("extraction"), F.col("_claims").alias("linked_claims"), cross.alias("cross_references"), gold.alias("gold"))


def skip_reason(pages: DataFrame, resources: DataFrame, source_field: str = "source_refs") -> DataFrame:
    """The pages with ``raw_title, url, raw_text`` of their capture and ``skip_reason``: null, or why none can be mined."""
    raw = F.filter("fields", lambda f: f["field"] == source_field)
    p = pages.withColumn("_refs", F.size(raw)).withColumn("rel_path", F.get(F.transform(raw, lambda f: f["value"]), 0))
    r = resources.select("rel_path", F.col("title").alias("raw_title") if "title" in resources.columns else F.lit(None).cast("string").alias("raw_title"), F.col("url") if "url" in resources.columns else F.lit(None).cast("string").alias("url"), F.col("body_text").alias("raw_text"), F.lit(True).alias("_found"))
    body = F.col("body_text")
    why = (
        F.when(body.isNull(), "page_unreadable").when(F.col("_refs") != 1, "not_one_source_ref")
        .when(F.col("_found").isNull() | ~F.col("rel_path").endswith(".md"), "resource_missing_or_not_markdown").when(F.col("raw_text").isNull(), "resource_unreadable")
        .when(strip(F.col("raw_text")) == "", "resource_empty").when(F.octet_length("raw_text") > WINDOW, "resource_too_long")
        .when((normalize_ws(section(body, "Summary")) == "") | (F.size(F.filter(bullets(section(body, "Key claims")), lambda c: F.trim(c) != "")) == 0), "sections_missing")
    )
    return p.join(r, "rel_path", "left").withColumn("skip_reason", why).drop("_refs", "_found")


def extract_prompt(title: Column, url: Column, body: Column) -> Column:
    return F.concat(F.lit("title: "), F.coalesce(title, F.lit("")), F.coalesce(F.concat(F.lit("\nurl: "), url), F.lit("")), F.lit("\n\n"), body)


def links_prompt(claims: Column, lines: Column, slug: Column) -> Column:
    """Numbered claims, then the pages that may be linked."""
    numbered = F.transform(claims, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c))
    return F.concat(F.array_join(numbered, "\n"), F.lit("\n\nNew page: "), slug, F.lit("\nCandidates:\n"), F.array_join(F.transform(lines, lambda l: F.concat(F.lit("- "), l)), "\n"))


def mined(pages: DataFrame, resources: DataFrame, new_page_dirs: dict[str, str] | None = None, candidates: DataFrame | None = None, notes: DataFrame | None = None, prefix: str = "wiki/") -> DataFrame:
    """``(task, key, prompt, target, skip_reason)`` of every source page ``(id, title, body_text, fields)``, one row for each task.

    A page that none can be mined from is one row with the reason. Link pairs need notes ``(id, path, title, kind)``;
    their candidates ``(id, candidate, rank)`` get the pages that the accepted claims link to added at the end, so
    that the accepted answer can always be given.
    """
    for c, kind in (("slug", "string"), ("frontmatter_json", "string")):
        pages = pages if c in pages.columns else pages.withColumn(c, F.col("id") if c == "slug" else F.lit(None).cast(kind))
    j = skip_reason(pages, resources)
    good = j.where("skip_reason is null")
    re = reconstructed(good, new_page_dirs or {"concepts": "concept", "entities": "entity"})
    whole = good.join(re, "id")
    prompt = extract_prompt(F.coalesce("raw_title", "title"), F.col("url"), F.col("raw_text"))
    none = F.lit(None).cast("string")
    out = j.where("skip_reason is not null").select(F.lit("extract").alias("task"), F.col("id").alias("key"), none.alias("prompt"), none.alias("target"), "skip_reason")
    out = out.unionByName(whole.select(F.lit("extract").alias("task"), F.col("id").alias("key"), prompt.alias("prompt"), F.col("extraction").alias("target"), none.alias("skip_reason")))
    if notes is None:
        return out
    gold = re.select("id", F.posexplode("gold").alias("rank", "candidate")).select("id", "candidate", (F.col("rank") + 1_000_000).alias("rank"))
    every = gold if candidates is None else candidates.select("id", "candidate", F.col("rank").cast("int").alias("rank")).unionByName(gold)
    first = every.groupBy("id", "candidate").agg(F.min("rank").alias("rank"))
    line = F.concat(F.regexp_replace(F.regexp_replace("path", rf"^\Q{prefix}\E", ""), r"\.md$", ""), F.lit(" — "), F.coalesce("title", "candidate"), F.lit(" ("), F.coalesce("kind", F.lit("")), F.lit(")"))
    meta = notes.select(F.col("id").alias("candidate"), "path", F.col("title"), "kind")
    lines = first.join(meta, "candidate").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    plain = F.transform("linked_claims", lambda c: normalize_ws(strip_links(c)))
    plan = F.struct(F.col("linked_claims"), F.array().cast("array<string>").alias("new_pages"), F.col("cross_references"), F.array().cast("array<string>").alias("update_targets"))
    l = whole.join(lines, "id", "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))
    return out.unionByName(l.select(F.lit("suggest_links").alias("task"), F.col("id").alias("key"), links_prompt(plain, F.col("lines"), F.col("slug")).alias("prompt"), F.to_json(plan).alias("target"), none.alias("skip_reason")))


def mined_from_runs(records: DataFrame, writes: DataFrame, pages: DataFrame, resources: DataFrame, new_page_dirs: dict[str, str], source_dir: str = "sources") -> DataFrame:
    """``(task, key, prompt, target, skip_reason)`` of recorded calls whose output was accepted.

    Records are ``(run_id, seq, task, parsed_ok, messages, raw_output)``, writes ``(run_id, seq, rel_path, kind,
    section_heading, raw_rel_path)``, pages the vault's notes as they are now ``(id, slug, path, title, kind, body_text,
    frontmatter_json)``. The label is what is left on the page: its reconstruction, the section that was added, the
    findings it still names. What was removed was rejected, and the row says so.
    """
    rec = records.where("parsed_ok").withColumn("prompt", F.array_join(F.transform(F.filter("messages", lambda m: m["role"] == "user"), lambda m: m["content"]), "\n"))
    src = writes.where((F.col("kind") == "created") & F.col("rel_path").contains(f"/{source_dir}/")).groupBy("run_id").agg(F.min_by(F.struct("seq", "rel_path", "raw_rel_path"), "rel_path").alias("w"))
    src = src.select("run_id", F.col("w.seq").alias("w_seq"), F.col("w.rel_path").alias("path"), F.col("w.raw_rel_path").alias("raw_rel_path"))
    raw = resources.select(F.col("rel_path").alias("raw_rel_path"), F.col("body_text").alias("raw_text"))
    there = src.join(pages, "path", "left").join(raw, "raw_rel_path", "left")
    re = reconstructed(there.where("id is not null").dropDuplicates(["id"]), new_page_dirs)
    none = F.lit(None).cast("string")
    out = lambda df, task, key, target, why: df.select(F.lit(task).alias("task"), key.alias("key"), "prompt", F.when(why.isNull(), target).alias("target"), why.alias("skip_reason"))
    at = rec.join(there.select("run_id", "w_seq", "path", "id", "body_text"), "run_id", "left").join(re, "id", "left")
    gone = F.when(F.col("path").isNull(), "no_page_written").when(F.col("id").isNull(), "page_deleted")
    x = at.where(F.col("task").isin("extract", "extract_merge"))
    got = out(x, "extract", F.coalesce("id", "path", "run_id"), F.col("extraction"), F.when(F.col("path").isNull() | (F.coalesce("w_seq", F.lit(-1)) != F.col("seq")), "no_page_written").otherwise(F.coalesce(gone, F.when(F.col("extraction").isNull(), "sections_missing"))))
    # links: claims and references as they stand, pages that were created and still exist, sections that are still there
    others = writes.join(src.select("run_id", F.col("path").alias("_own")), "run_id").where("rel_path <> _own").join(pages.select(F.col("path").alias("rel_path"), "title", F.col("kind").alias("note_kind"), F.col("body_text").alias("_text")), "rel_path")
    target = F.regexp_replace(F.regexp_replace("rel_path", r"^wiki/", ""), r"\.md$", "")
    spec = F.struct(F.element_at(F.split(target, "/"), -1).alias("slug"), F.regexp_extract(target, r"^([^/]*)/", 1).alias("dir"), "title", F.col("note_kind").alias("kind"), F.lit("").alias("blurb"))
    kept = others.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.when((F.col("kind") == "created") & target.contains("/"), spec))).alias("new_pages"),
        F.array_sort(F.collect_set(F.when((F.col("kind") != "created") & F.col("_text").contains(F.col("section_heading")), target))).alias("update_targets"),
    )
    l = at.where("task = 'suggest_links'").join(kept, "run_id", "left")
    plan = F.struct("linked_claims", F.coalesce("new_pages", F.array()).alias("new_pages"), "cross_references", F.coalesce("update_targets", F.array().cast("array<string>")).alias("update_targets"))
    got = got.unionByName(out(l, "suggest_links", F.coalesce("id", "path", "run_id"), F.to_json(plan), F.coalesce(gone, F.when(F.col("linked_claims").isNull(), "sections_missing"))))
    # updates: the section under its heading
    u = rec.where("task = 'page_update'").join(writes.select("run_id", "seq", "rel_path", "section_heading"), ["run_id", "seq"], "left").join(pages.select(F.col("path").alias("rel_path"), F.col("body_text").alias("_text")), "rel_path", "left")
    after = F.get(F.split(F.get(F.split("_text", F.concat(F.lit("(?m)^\\Q"), F.col("section_heading"), F.lit("\\E[ \\t]*$"))), 1), r"(?m)^## "), 0)
    head = F.regexp_replace("section_heading", r"^#+ ", "")
    upd = F.to_json(F.struct(F.regexp_replace(head, r" \(.*$", "").alias("topic"), F.trim(strip(after)).alias("section_md"), F.lit(True).alias("relevant")))
    why = F.when(F.col("rel_path").isNull() | F.col("section_heading").isNull(), "no_page_written").when(F.col("_text").isNull(), "page_deleted").when(after.isNull(), "section_removed")
    got = got.unionByName(out(u, "page_update", F.concat(F.coalesce("rel_path", "run_id"), F.lit("#"), F.coalesce("section_heading", F.lit(""))), upd, why))
    # contradictions: none found is a label, too; found ones must still be named on the source page
    from quillgraph.functions.markup import parsed_replies

    c = parsed_replies(rec.where("task = 'contradiction'").select("run_id", "seq", "prompt", "raw_output"), "raw_output")
    c = c.withColumn("f", F.from_json("raw_output", "findings array<struct<page_id: string, existing_text: string, new_claim: string, explanation: string>>")["findings"]).where("f is not null")
    c = c.join(there.select("run_id", "path", "id", "body_text"), "run_id", "left").withColumn("_s", section(F.col("body_text"), "Contradictions"))
    left = F.filter("f", lambda f: F.coalesce(F.col("_s").contains(f["page_id"]), F.lit(False)))
    why = F.when(F.size("f") == 0, none).otherwise(F.coalesce(gone, F.when(F.size(left) == 0, "findings_removed")))
    key = F.concat_ws(":", "run_id", F.col("seq").cast("string"))
    got = got.unionByName(out(c, "contradiction", key, F.to_json(F.struct(left.alias("findings"))), why))
    chunks = rec.where("task = 'extract_chunk'")
    return got.unionByName(out(chunks, "extract", key, none, F.lit("chunk_of_an_extraction")))


def pairs(mined_rows: DataFrame, run_rows: DataFrame | None = None, valid_share: float = 0.1) -> DataFrame:
    """One pair for each (task, key), run pairs first, with its split by the key's hash."""
    m = mined_rows.where("skip_reason is null").select("task", "key", "prompt", "target", F.lit(1).alias("o"))
    if run_rows is not None:
        m = m.unionByName(run_rows.select("task", "key", "prompt", "target", F.lit(0).alias("o")))
    w = Window.partitionBy("task", "key").orderBy("o", "prompt", "target")
    one = m.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "o")
    return one.withColumn("split", F.when(is_valid_split(F.col("key"), valid_share), "valid").otherwise("train"))


def histogram(mined_rows: DataFrame) -> DataFrame:
    """``(task, outcome, n)``: emitted, or why not."""
    return mined_rows.groupBy("task", F.coalesce("skip_reason", F.lit("emitted")).alias("outcome")).agg(F.count("*").alias("n"))


def write_chat(out: DataFrame, folder: str) -> None:
    """Chat lines as JSON under split=train and split=valid."""
    msg = F.array(
        F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("target").alias("content"))
    )
    out.select("split", msg.alias("messages")).write.partitionBy("split").mode("overwrite").json(folder)


RUN_RECORD = (
    "run_id string, seq long, task string, provider string, model string, created timestamp, messages array<struct<role: string, content: string>>, "
    "raw_output string, parsed_ok boolean, meta string"
)


def read_runs(spark, folder: str) -> DataFrame:
    """Recorded calls of all runs (JSON lines); lines that are no JSON are left out."""
    raw = spark.read.schema(RUN_RECORD).option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).json(folder)
    return raw.where("run_id is not null and seq is not null")


MANIFEST = (
    "run_id string, created string, raw_rel_path string, raw_body_hash string, provider string, model string, "
    "writes array<struct<rel_path: string, kind: string, section_heading: string, content_hash: string, seq: long>>"
)


def read_manifests(spark, folder: str) -> DataFrame:
    """``(run_id, raw_rel_path, seq, rel_path, kind, section_heading, content_hash)``: what each run wrote, from its manifest."""
    raw = spark.read.schema(MANIFEST).option("pathGlobFilter", "*.meta.json").option("recursiveFileLookup", True).option("multiLine", True).json(folder)
    return raw.where("run_id is not null").select("run_id", "raw_rel_path", F.explode("writes").alias("w")).select("run_id", "raw_rel_path", "w.seq", "w.rel_path", "w.kind", "w.section_heading", "w.content_hash")


def read_run_log(spark, path: str, marker: str = "=== TEACHER ===") -> DataFrame:
    """``(side, ok, seconds)`` of each file in a run log: '[…] OK name 12s' lines, between markers the teacher's."""
    text = spark.read.text(path, wholetext=True)
    parts = text.select(F.posexplode(F.split("value", rf"(?m)^\Q{marker}\E[^\n]*$")).alias("i", "part"))
    lines = parts.select(F.when(F.col("i") % 2 == 1, "teacher").otherwise("student").alias("side"), F.explode(F.split("part", "\n")).alias("l"))
    m = r"^\[.*\] (OK|FAIL) .* (\d+)s\s*$"
    return lines.where(F.col("l").rlike(m)).select("side", (F.regexp_extract("l", m, 1) == "OK").alias("ok"), F.regexp_extract("l", m, 2).cast("int").alias("seconds"))


REPORT = "run_id string, raw_path string, pages_created array<string>, pages_updated array<string>, contradictions array<string>, warnings array<string>, training_records long"


def read_reports(spark, folder: str) -> DataFrame:
    """Ingest reports, one JSON file each; unreadable ones are left out."""
    raw = spark.read.schema(REPORT).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).option("multiLine", True).json(folder)
    return raw.where("coalesce(raw_path, run_id) is not null or warnings is not null")


def log_metrics(log: DataFrame) -> DataFrame:
    """By side: files that went well and not, and the mean seconds of those that did."""
    return log.groupBy("side").agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("fail"), F.round(F.avg(F.when(F.col("ok"), F.col("seconds"))), 1).alias("seconds_avg"))

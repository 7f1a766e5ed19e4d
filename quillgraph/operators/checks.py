"""Diagnostics and the gates of the ingest dataflow, as labelled filters and ordered aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import normalize_ws
from quillgraph.operators.resolve import note_links, resolve


def diagnostics(notes: DataFrame, kinds: tuple[str, ...], required: dict[str, tuple[str, ...]], severity: dict[str, str] | None = None) -> DataFrame:
    """``(id, rule, detail)``: broken and ambiguous links outside code, unknown kinds, missing fields."""
    got = resolve(note_links(notes), notes).where("not masked")
    bad = got.where("outcome <> 'resolved'").select(F.col("src").alias("id"), F.concat(F.col("outcome"), F.lit("_link")).alias("rule"), F.col("target").alias("detail"))
    odd = notes.where(F.col("kind").isNotNull() & ~F.col("kind").isin(*kinds)).select("id", F.lit("unknown_kind").alias("rule"), F.col("kind").alias("detail"))
    out = bad.unionByName(odd)
    for kind, fields in required.items():
        for f in fields:
            v = F.get_json_object("frontmatter_json", f"$.{f}")
            miss = notes.where((F.col("kind") == kind) & (v.isNull() | v.isin("", "[]")))
            out = out.unionByName(miss.select("id", F.lit("missing_field").alias("rule"), F.lit(f).alias("detail")))
    return out if severity is None else out.where(F.col("rule").isin(*[r for r, s in severity.items() if s != "allow"]))


def merge_chunks(items: DataFrame, keys: list[str], text: str, order: list[str]) -> DataFrame:
    """Union of chunk extractions: the first of case-insensitive equals, in document order."""
    w = Window.partitionBy(*keys, F.lower(F.trim(text))).orderBy(*order)
    first = items.where(F.trim(text) != "").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda e: e[text]).alias("merged"))


def valid_claims(claims: DataFrame, keys: list[str], text: str, order: list[str], least_bytes: int = 15, most: int = 12) -> DataFrame:
    """Claims with white space collapsed, long enough, distinct without case, the first ``most`` of each key."""
    c = claims.withColumn(text, normalize_ws(F.col(text))).where(F.octet_length(text) >= least_bytes)
    first = c.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, F.lower(text)).orderBy(*order))).where("_n = 1")
    return first.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("n") <= most).drop("_n")


def verbatim(quotes: DataFrame, body: Column, quote: Column) -> DataFrame:
    """Quotes that stand in the body, white space aside."""
    return quotes.where((normalize_ws(quote) != "") & normalize_ws(body).contains(normalize_ws(quote)))


def valid_new_pages(specs: DataFrame, dirs: dict[str, str], existing: DataFrame, most: int = 6, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Specs ``(run, pos, slug, dir, title, kind)`` with a good slug, a known folder and a free id, the first ``most`` of a run.

    A kind that is missing, or none of ``kinds``, is the folder's; a missing title is the slug in words.
    """
    kind_of = F.create_map(*[F.lit(x) for p in dirs.items() for x in p])
    s = specs.withColumn("slug", F.lower(F.trim("slug"))).where(F.col("slug").rlike(r"^[a-z0-9][a-z0-9-]{1,60}$") & F.col("dir").isin(*dirs)).withColumn("id", F.concat_ws("-", "dir", "slug"))
    s = s.withColumn("kind", F.when((F.coalesce("kind", F.lit("")) == "") | (~F.col("kind").isin(*kinds) if kinds else F.lit(False)), kind_of[F.col("dir")]).otherwise(F.col("kind"))).withColumn("title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.replace("slug", F.lit("-"), F.lit(" "))))
    s = s.join(existing.select("id"), "id", "left_anti")
    s = s.withColumn("_n", F.row_number().over(Window.partitionBy("run", "id").orderBy("pos"))).where("_n = 1")
    return s.withColumn("n", F.row_number().over(Window.partitionBy("run").orderBy("pos"))).where(F.col("n") <= most).drop("_n")


def linked_claims(claims: DataFrame, linked: DataFrame, notes: DataFrame) -> DataFrame:
    """``(key, pos, text, reverted)``: each plain claim ``(key, pos, text, dir)`` with the links of its linked version ``(key, pos, text)``.

    Links that do not resolve are put back to their words, the others stay. A claim whose words differ from the
    plain ones after that keeps its plain text, and so do all claims of a key whose numbers of versions differ.
    """
    from quillgraph.functions.text import strip_links
    from quillgraph.operators.ingest import sanitize_links

    plain = claims.select("key", "pos", F.col("text").alias("plain"), "dir")
    size = lambda df, n: df.groupBy("key").agg(F.count("*").alias(n))
    whole = size(claims, "_a").join(size(linked, "_b"), "key").where("_a = _b").select("key")
    both = plain.join(linked.select("key", "pos", F.col("text").alias("linked")), ["key", "pos"]).join(whole, "key", "left_semi")
    clean = sanitize_links(both.select(F.struct("key", "pos").alias("key"), "dir", F.col("linked").alias("text")), notes)
    clean = clean.select("key.key", "key.pos", F.col("text").alias("clean"))
    same = F.coalesce(normalize_ws(strip_links(F.col("clean"))) == normalize_ws(F.col("plain")), F.lit(False))
    out = plain.join(clean, ["key", "pos"], "left")
    return out.select("key", "pos", F.when(same, F.col("clean")).otherwise(F.col("plain")).alias("text"), (~same).alias("reverted"))


def cited(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(answer_id, pos, id)``: citations that are evidence ``(id)``, in order; none of an abstention."""
    c = answers.where(~F.coalesce("abstained", F.lit(False))).select("answer_id", F.posexplode("citations").alias("pos", "id"))
    return c.join(evidence.select("id").distinct(), "id", "left_semi").select("answer_id", "pos", "id")


def worth_training(answers: DataFrame, probe: Column) -> DataFrame:
    """Answers to train on: those that say something and cite it, and abstentions where the question was a probe, one that
    the notes cannot answer."""
    abstained = F.coalesce("abstained", F.lit(False))
    return answers.where((~abstained & (F.size("citations") > 0)) | (abstained & probe))


def question_counts(answers: DataFrame, probe: Column) -> DataFrame:
    """``(probe, n, abstained)``: real questions and probes, and how many of each were left unanswered."""
    return answers.groupBy(probe.alias("probe")).agg(F.count("*").alias("n"), F.count_if(F.coalesce("abstained", F.lit(False))).alias("abstained"))


def accepted_runs(records: DataFrame, writes: DataFrame) -> DataFrame:
    """Records ``(run_id, seq, ...)`` that were parsed and whose output was written: a write with their (run_id, seq).

    The columns of the writes come along; a column that both have is the record's.
    """
    extra = [c for c in writes.columns if c not in records.columns]
    return records.where("parsed_ok").join(writes.select("run_id", "seq", *extra), ["run_id", "seq"])


def run_metrics(records: DataFrame, by: tuple[str, ...] = ("task",)) -> DataFrame:
    """By task, or other columns: calls, replies that did not parse and their share, and second calls for missing content."""
    bad = F.count_if(~F.coalesce("parsed_ok", F.lit(False)))
    again = [F.count_if(F.get_json_object("meta", "$.content_retry") == "true").alias("content_retries")] if "meta" in records.columns else []
    return records.groupBy(*by).agg(F.count("*").alias("calls"), bad.alias("failed"), F.round(100.0 * bad / F.count("*"), 4).alias("failed_pct"), *again)


def page_metrics(pages: DataFrame) -> DataFrame:
    """One row: source pages ``(body_text)``, their claims, quotes and links in claims on average and in all."""
    from quillgraph.functions.text import bullets, section

    claims = bullets(section(F.col("body_text"), "Key claims"))
    quotes = F.filter(F.split(section(F.col("body_text"), "Quotes"), "\n"), lambda x: x.startswith("> "))
    links = F.aggregate(claims, F.lit(0), lambda n, c: n + F.size(F.regexp_extract_all(c, F.lit(r"(\[\[)"), F.lit(1))))
    p = pages.select(F.size(claims).alias("c"), F.size(quotes).alias("q"), links.alias("l"))
    return p.agg(F.count("*").alias("pages"), F.round(F.avg("c"), 1).alias("claims_avg"), F.round(F.avg("q"), 1).alias("quotes_avg"), F.sum("l").alias("links_in_claims"))


#: What a warning says, and the bucket it is counted in.
WARNINGS = (
    ("non-verbatim quote", "quote dropped (fabricated/paraphrased)"),
    ("unwrapped unresolvable link", "hallucinated link unwrapped"),
    ("rewrote claim", "claim rewrite reverted"),
    ("junk claim", "junk claim dropped"),
    ("never cites", "page update rejected (no citation)"),
    ("synthesized one from the top claims", "summary synthesized (fallback)"),
    ("link weaving skipped", "whole link stage degraded"),
    ("claims; keeping the first", "claim overflow truncated"),
    ("already exists", "duplicate new-page proposal"),
    ("malformed slug", "malformed slug"),
)


def report_metrics(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sums over ingest reports, and their warnings ``(bucket, n)``."""
    n = lambda c: F.coalesce(F.sum(F.size(F.coalesce(c, F.array().cast("array<string>")))), F.lit(0)).alias(c)
    sums = reports.agg(F.count("*").alias("reports"), n("pages_created"), n("pages_updated"), n("contradictions"))
    w = reports.select(F.explode("warnings").alias("w")).groupBy(warning_bucket(F.col("w"), WARNINGS).alias("bucket")).agg(F.count("*").alias("n"))
    return sums, w


def compared(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("student", "teacher")) -> DataFrame:
    """``(metric, student, teacher)``: two one-row tables of metrics side by side, one row for each column."""
    long = lambda df, name: df.select(F.posexplode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("v")) for c in df.columns]))).select("col.metric", F.col("col.v").alias(name))
    return long(a, names[0]).join(long(b, names[1]), "metric", "full_outer")


def warning_bucket(c: Column, buckets: tuple = WARNINGS) -> Column:
    """The label of the first bucket (text, label) whose text the warning contains, else 'other'."""
    out = F.lit("other")
    for text, label in reversed(buckets):
        out = F.when(c.contains(text), label).otherwise(out)
    return out

import datetime as dt
import subprocess

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import ingest as I
from quillgraph.operators.ask import Recorded


@pytest.fixture
def notes(spark):
    return spark.createDataFrame([("concepts-a", "a", "concept", "Body of\n a page."), ("sources-s", "s", "source", "x")], "id string, slug string, kind string, body_text string")


def test_links(spark, notes):
    t = spark.createDataFrame([("k1", "concepts", "see [[a]] and [[gone/b$1|B]] or [[gone/b$1]]"), ("k2", "concepts", None), ("k3", "concepts", "none")], "key string, dir string, text string")
    assert {r.key: r.text for r in I.sanitize_links(t, notes).collect()} == {"k1": "see [[a]] and B or b$1", "k2": None, "k3": "none"}
    assert [r.key for r in I.links_to(t, notes, "concepts-a").collect()] == ["k1"]
    assert I.sanitize_links(t.limit(0), notes).count() == 0


def test_slugs_and_batches(spark):
    rows = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "id string, slug string")
    assert {r.id: r.free_slug for r in I.free_slugs(rows, "slug", "id").collect()} == {"a": "x", "b": "x-2", "c": "y"}
    taken = spark.createDataFrame([("y",)], "slug string")
    assert {r.id: r.free_slug for r in I.free_slugs(rows, "slug", "id", taken).collect()}["c"] == "y-2"
    b = I.batches(spark.range(10).select(F.col("id").cast("string").alias("path")), "path", 3).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in b) == [1, 3, 3, 3]


def test_gates(spark, notes):
    refs = spark.createDataFrame([("r", 0, "concepts", "a"), ("r", 1, "concepts", "a"), ("r", 2, "concepts", "s"), ("r", 3, "concepts", "zz")], "run string, pos int, dir string, target string")
    cand = spark.createDataFrame([("r", "concepts-a"), ("r", "sources-s")], "run string, id string")
    assert [(r.pos, r.id) for r in I.valid_references(refs, cand, notes, 5).collect()] == [(0, "concepts-a")]
    f = spark.createDataFrame([("r", "concepts-a", "Body of a", "A  claim"), ("r", "concepts-a", "not there", "A claim"), ("r", "zz", "Body", "A claim"), ("r", "concepts-a", None, "A claim")], "run string, page_id string, existing_text string, new_claim string")
    c = spark.createDataFrame([("r", "a claim")], "run string, text string")
    assert I.valid_contradictions(f, notes, c).count() == 1
    claims = spark.createDataFrame([("r", 0, "one [[a]]", "sources"), ("r", 1, "two", "sources"), ("q", 0, "three", "sources")], "run string, pos int, text string, dir string")
    ents = spark.createDataFrame([("r", 1, "Red Fox"), ("r", 0, None), ("q", 0, "x")], "run string, pos int, name string")
    pages = spark.createDataFrame([("r", "concepts-f", "fox"), ("r", "concepts-a", "nothing"), ("q", "concepts-b", "bear")], "run string, page_id string, title string")
    got = {(r.page_id, r.pos) for r in I.relevant_claims(claims, ents, pages, notes).collect()}
    assert got == {("concepts-f", 1), ("concepts-a", 0), ("concepts-b", 0)}


def test_suspected_duplicates(spark, notes):
    t = spark.createDataFrame([(1, "concepts-a", 9.0, 1), (1, "sources-s", 5.0, 2), (2, "sources-s", 1.0, 9)], "query_id int, id string, score double, rank int")
    v = spark.createDataFrame([(1, "sources-s", 0.9), (2, "sources-s", 0.8), (2, "concepts-a", 0.99), (3, "sources-s", 0.6)], "query int, id string, score double")
    assert {(r["query"], r.id, r.via) for r in I.suspected_duplicates(t, v, notes).collect()} == {(1, "sources-s", "fts"), (2, "sources-s", "vector")}


def test_page_updates(spark, notes):
    page = "---\ntitle: A\nsource_refs: [raw/o.md]\n---\nBody.\n\n## T (2025-01-01 ingest)\n\nold\n"
    pages = spark.createDataFrame([("concepts-a", "concepts", "wiki/concepts/a.md", page), ("concepts-b", "concepts", "wiki/concepts/b.md", "no front")], "id string, dir string, path string, text string")
    u = [("k", "concepts-a", " #T# ", "# Head\nnew [[s]] and [[gone|G]]", True), ("l", "concepts-a", "", "no citation", True), ("m", "concepts-a", "T", "[[s]]", False), ("n", "concepts-b", "T", "[[s]]", True), ("o", "concepts-a", "T", " ", True)]
    u = spark.createDataFrame([(*r, "sources-s", "s", "raw/n.md") for r in u], "key string, page_id string, topic string, section_md string, relevant boolean, source_id string, source_slug string, raw_path string")
    got = {r.key: r for r in I.page_updates(u, pages, notes, dt.date(2025, 1, 1)).collect()}
    assert set(got) == {"k", "l", "n"} and got["k"].heading == "## T — 2 (2025-01-01 ingest)" and got["k"].section == "Head\nnew [[s]] and G"
    assert "source_refs: [raw/o.md, raw/n.md]" in got["k"].content and "updated: 2025-01-01" in got["k"].content and got["k"].content.endswith("## T — 2 (2025-01-01 ingest)\n\nHead\nnew [[s]] and G\n")
    assert "never cites" in got["l"].problem and got["l"].content is None and "frontmatter" in got["n"].problem


def test_preflight_and_reports(spark, tmp_path):
    from quillgraph.sources import config

    cfg = config.parse('[resources]\npaths = ["raw/**/*"]\n[[edges]]\nname = "S"\nsource = "frontmatter"\nfield = "source_refs"\ntarget = "resource"\n')
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/a.md").write_text("---\ntitle: x\n---\nBody")
    (tmp_path / "raw/e.md").write_text("---\ntitle: x\n---\n \n")
    assert I.preflight(f"{tmp_path}/raw/a.md", str(tmp_path), cfg)[0] == "raw/a.md" and I.preflight("raw/./a.md", str(tmp_path), cfg)[2] == ["not a git repository"]
    for bad in ("raw/e.md", "raw/a.bin", "wiki/a.md", "../a.md"):
        with pytest.raises(ValueError):
            I.preflight(bad, str(tmp_path), cfg)
    r = I.Report("run-1", "raw/a.md", source_page="sources/a", pages_updated=["b"], near_duplicates=[{"id": "d", "via": "fts", "score": 1.234}], contradictions=[{"page_id": "c"}])
    log = I.log_entry(dt.date(2025, 1, 1), "A", r, "m")
    assert "pages created: none" in log and "d (fts, 1.23)" in log and "raised: 1 (c)" in log
    rows = spark.createDataFrame([("b", ["x"], [], ["w2"], 2), ("a", [], ["y"], ["w1"], 3)], "run_id string, pages_created array<string>, pages_updated array<string>, warnings array<string>, training_records int")
    assert tuple(I.ingest_summary(rows).first()) == (2, 5, 1, 1, ["w1", "w2"])


def test_extraction_tables(spark):
    import json

    from quillgraph.operators import extraction as X

    raw = [
        ("a", 0, json.dumps({"summary": "S one.", "key_claims": [{"text": "The first  claim here", "entities": ["E"]}, "Plain claim number two"], "entities": ["Fox", {"name": " "}], "tags": "- Big Cat\n- x", "suggested_slug": "good-slug"})),
        ("a", 1, json.dumps({"summary": "", "key_claims": {"2": {"text": "later claim in a map"}, "1": {"text": "THE FIRST  CLAIM HERE"}}, "quotes": [{"text": "red  fox", "location": "p1"}, "never said"], "topics": ["X"], "author": "Me"})),
        ("b", 0, '```json\n[{"text": "only a list of claims"}, {"text": "short"}]\n```'), ("c", 0, "no json"), ("d", 0, None), ("e", 0, '{"summary": "s", "key_claims": []}'), ("f", 0, '{"suggested_slug": "good-slug", "key_claims": ["another capture with that slug"]}'),
    ]
    ex = X.extractions(spark.createDataFrame(raw, "key string, part int, raw_output string"))
    assert {(r.key, r.part) for r in ex.collect()} == {("a", 0), ("a", 1), ("b", 0), ("e", 0), ("f", 0)}
    m = {r.key: r for r in X.merged(ex, "key", "part").collect()}
    assert [c.text for c in m["a"].claims] == ["The first  claim here", "Plain claim number two", "later claim in a map"] and m["a"].tags == ["big cat", "x"] == m["a"].topics and m["a"].author == "Me" and m["a"].summary == "S one."
    whole = X.merged(ex, "key", "part").join(spark.createDataFrame([("a", "the red\nfox ran"), ("b", ""), ("e", ""), ("f", None)], "key string, body string"), "key")
    F = __import__("pyspark").sql.functions
    got = {r.key: r for r in X.validated(whole, "key", "body", F.lit("fallback"), spark.createDataFrame([("fallback",), ("fallback-2",), ("good-slug-2",)], "slug string")).collect()}
    assert set(got) == {"a", "b", "f"} and got["a"].tags == ["big-cat", "x"] and [e.name for e in got["a"].entities] == ["Fox"] and [q.text for q in got["a"].quotes] == ["red\nfox"]
    assert got["a"].slug == "good-slug" and got["f"].slug == "good-slug-3" and got["b"].slug == "fallback-3" and got["b"].summary == "only a list of claims"
    assert any("junk" in w for w in got["b"].warnings) and any("non-verbatim" in w for w in got["a"].warnings) and any("synthesized" in w for w in got["b"].warnings)
    assert X.validated(whole.limit(0), "key", "body", F.lit("f")).count() == 0


def test_stages_and_writes(tmp_path):
    class Chat:
        def complete(self, task, messages, temperature=0.0):
            n = messages[0]["content"].count("## ")
            return '{"summary": "S%d.", "key_claims": ["One", "one", {"text": "T%d"}], "quotes": ["x  y"], "tags": ["t"], "author": null}' % (n, n)

    got = I.extract(Recorded(Chat()), "T", "## a\nx\ny\n" + "## b\n" + "z" * 40, cap=30)
    assert [c["text"] for c in got["claims"]] == ["One", "one", "T0"] and got["summary"] == "S0."  # the model's own merge
    assert [c["text"] for c in I.joined([got, {**got, "summary": "More."}])["claims"]] == ["One", "T0"]

    class Flat:
        def __init__(self):
            self.n = 0

        def complete(self, task, messages, temperature=0.0):
            self.n += 1
            if task == "extract_merge":
                return "[]"
            return '{"summary": "Full.", "key_claims": ["c"]}' if len(messages) > 1 or task == "extract_chunk" else '[{"text": "c"}, {"text": "d"}]'

    flat = Flat()
    assert I.extract(Recorded(flat), "T", "body")["summary"] == "Full." and flat.n == 2
    assert I.extract(Recorded(Flat()), "T", "## a\nx\ny\n" + "## b\n" + "z" * 40, cap=30)["summary"].startswith("Full. Full.")
    page = I.render_source('A "b"', "raw/c.md", dt.date(2025, 1, 1), {**got, "quotes": [{"text": "q", "location": "p"}]}, ["d"], [{"page_id": "e", "existing_text": "x", "new_claim": "y", "explanation": "z"}])
    assert "source_refs: [raw/c.md]" in page and "- [[d]]" in page and page.startswith('---\ntitle: "A \\"b\\""') and '> "q" — p' in page and "contradicts: [e]" in page and "Conflicts with [[e]]" in page
    new = I.render_new_page({"title": "N", "kind": "concept", "blurb": "B"}, ["c1"], "s", dt.date(2025, 1, 1))
    assert "## From ingest (2025-01-01)\n\n- c1\n\nSource: [[s]]" in new
    sec = I.update_section("T", "# H\ntext", "s", dt.date(2025, 1, 1), "## T (2025-01-01 ingest)")
    assert "## T — 2 (2025-01-01 ingest)" in sec and "[[s]]" in sec and "# H" not in sec
    w = [I.Write("wiki/a.md", "x", "create"), I.Write("wiki/a.md", "y", "append")]
    assert I.flush(w, str(tmp_path), "wiki") == ["wiki/a.md", "wiki/a.md"] and (tmp_path / "wiki/a.md").read_text() == "xy"
    for bad in (I.Write("raw/x.md", "", "create"), I.Write("wiki/../x.md", "", "create")):
        with pytest.raises(ValueError):
            I.flush([bad], str(tmp_path), "wiki")
    with pytest.raises(FileExistsError):
        I.flush([w[0]], str(tmp_path), "wiki")
    assert I.clean_tree(str(tmp_path)) == ["not a git repository"]
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    with pytest.raises(RuntimeError):
        I.clean_tree(str(tmp_path))
    assert "1. c" in I.links_prompt(["c"], [("a", "A")], "s")[1]["content"]

import collections
import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import markup as M
from quillgraph.functions import text as T
from quillgraph.operators import ask, checks, distill, graph, resolve, search
from quillgraph.operators.components import components
from quillgraph.runtime import Scratch
from quillgraph.sources import config
from quillgraph.sources.snapshot import SnapshotStore, changes, upsert
from quillgraph.streaming import sync as S


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "f, given, want",
    [
        (T.normalize_ws, "  a \t b\n c ", "a b c"), (T.normalize_ws, None, None), (T.note_id, "wiki/a/b/c.md", "a-b-c"), (T.note_slug, "wiki/a/b/c.md", "c"),
        (T.note_dir, "wiki/a/b.md", "a"), (T.note_dir, "wiki/b.md", ""), (T.note_dir, None, None), (T.lenient_date, "2025-03-04T10:00", dt.date(2025, 3, 4)), (T.lenient_date, "2025", None),
        (T.strip_links, "x [[a/b#c|label]] [[a/b#c]] y", "x label b y"), (T.slug_from_filename, "raw/2024-01-02-Some File!.md", "some-file"), (T.slug_from_filename, "raw/!.md", "capture"),
        (lambda c: T.section(c, "Key claims"), "## Key claims\n- a\n\n## Next\n- b", "- a\n\n"), (lambda c: T.section(c, "X"), "## Y\n", ""), (T.bullets, "- a\n  - no\n- b ", ["a", "b"]),
        (T.strip_headings, "# A\n## B", "A\nB"), (T.strip_marker, "12. x", "x"), (T.strip_marker, "- x", "x"), (lambda c: T.preview(c, 3), "  abcd", "abc…"), (T.inline_tags, "#a x (#b-c) y#d ##e", ["a", "b-c"]),
        (lambda c: T.truncate_bytes(c, 4), "aé漢x", "aé"), (lambda c: T.truncate_bytes(c, 2), "aé", "a"), (lambda c: T.truncate_bytes(c, 3), "aé", "aé"), (lambda c: T.truncate_bytes(c, 1), "漢", ""), (lambda c: T.truncate_bytes(c, 5), "a👩b", "a👩"), (T.query_terms, "The é a C++", ["the", "é"]), (T.yaml_scalar, "plain text", "plain text"), (T.yaml_scalar, "yes", '"yes"'), (T.yaml_scalar, "a: b", '"a: b"'), (T.yaml_scalar, 'q"\\', '"q\\"\\\\"'), (T.strip, "\n a \t", "a"),
    ],
)
def test_text(spark, f, given, want):
    assert one(spark, f, given) == want


def test_split_matches_python(spark):
    import hashlib

    for k in ("a", "b/c", "é"):
        want = int.from_bytes(hashlib.sha256(k.encode()).digest()[:8], "big") / 2**64 < 0.5
        assert one(spark, lambda c: T.is_valid_split(c, 0.5), k) == want


def test_frontmatter():
    assert M.split_frontmatter("---\na: 1\n---\nbody") == ("a: 1\n", "body")
    assert M.split_frontmatter("---\r\na: 1\r\n---\r\nbody")[1] == "body"
    assert M.split_frontmatter("---\n---\nx")[0] is None and M.split_frontmatter(" ---\na\n---\n")[0] is None
    assert M.yaml_value("a: 2024-01-01\nb: yes\nc: [1, x]\na: z\n") == {"a": "z", "b": "yes", "c": [1, "x"]}
    assert M.yaml_value("a: [") is None


def test_links_and_code():
    body = "[[A/b#c | d]] `[[code]]` [[]] ![i](x.md) [p](../y.md#h) [q](/z.md) [r](http://a/b.md)\n\n```\n[[fenced]]\n```\n"
    links = M.wikilinks(body)
    assert [(x["target"], x["anchor"], x["alias"], x["masked"]) for x in links] == [("A/b", "c", "d", False), ("code", None, None, True), ("fenced", None, None, True)]
    assert [x["target"] for x in M.path_links(body, "wiki/a/n.md", "wiki/")] == ["y", "z"]
    assert M.normalize_path("a/../../b") is None and M.normalize_path("./a//b/") == "a/b"
    assert M.headings("Title *of*\nall\n===\n\n> q\n---\n\n#\n## [x](y.md) ##") == [(1, "Title of all", 0), (1, "", 29), (2, "x", 31)]
    nested = "- item\n\n      [[c]]\n\n    [[t]] `a\n[[s]]`\n\n    [[u]]\n"
    assert [(x["target"], x["masked"]) for x in M.wikilinks(nested)] == [("c", True), ("t", False), ("s", True), ("u", False)]
    assert [x["masked"] for x in M.wikilinks("text\n\n    [[code]]\n\n1. one\n   ```\n   [[f]]\n   ```\n")] == [True, True]
    assert M.headings("# A\n```\n# no\n```\n## `B` ##\n") == [(1, "A", 0), (2, "B", 17)]


def test_json_replies():
    assert M.extract_json('so {"a": "}"} x') == '{"a": "}"}'
    assert M.parse_reply('{"a": [1, 2, {"b": "c"}, {"b": "tr') == {"a": [1, 2, {"b": "c"}]}
    assert M.parse_reply('[{"a": 1}]') == {"a": 1} and M.parse_reply("none") is None and M.parse_reply(None) is None
    assert M.tolerant_list({"10": "b", "2": "a"}) == ["a", "b"] and M.tolerant_list("- x\n2. y\n") == ["x", "y"]
    assert M.tolerant_list([{"text": "t"}, " ", None]) == ["t"]


def test_edits_and_positions():
    doc = "---\ntitle: x\nrefs:\n  - a\n---\nbody"
    once = M.add_list_item(doc, "refs", "b")
    assert M.yaml_value(M.split_frontmatter(once)[0])["refs"] == ["a", "b"] and M.add_list_item(once, "refs", "b") == once
    assert "tags: [q, r]" in M.add_list_item("---\ntags: [q]\n---\n", "tags", "r")
    assert M.yaml_value(M.split_frontmatter(M.add_list_item(doc, "new", "n"))[0])["new"] == ["n"]
    assert M.yaml_value(M.split_frontmatter(M.set_scalar(doc, "title", "y"))[0])["title"] == "y"
    text = "aé\n👩b"
    for b in (0, 1, 3, 4, 8, 9):
        assert M.offset_of(text, *M.position_of(text, b)) == b
    assert M.truncate_bytes("aé", 2) == "a" and M.find_verbatim("x a\n b y", "a b") == "a\n b"


def test_chunks():
    body = "intro\n## A\n" + "x" * 50 + "\n## B\n" + "é" * 100
    parts = M.chunk_body(body, 80)
    assert "".join(parts) == body and all(len(p.encode()) <= 80 for p in parts) and M.chunk_body(" ", 80) == [" "]


FILES = {
    "wiki/concepts/alpha.md": "---\ntitle: Alpha\nkind: concept\nstatus: draft\nupdated: 2025-01-01\ntags: [t]\nsource_refs: [raw/r.md]\n---\nSee [[beta]] and [[twin]].\n",
    "wiki/concepts/beta.md": "---\ntitle: Beta\nkind: concept\ntags: [t]\n---\nBack to [[alpha]].\n",
    "wiki/concepts/sub/twin.md": "---\ntitle: Twin\nkind: concept\n---\nOther: [[entities/twin|the twin]].\n",
    "wiki/entities/twin.md": "---\ntitle: Twin\nkind: entity\ncontradicts: [alpha]\n---\nFrom [[alpha]] `[[beta]]`.\n",
    "wiki/index.md": "[[alpha]]\n", "raw/r.md": "---\ntitle: R\ncaptured_at: 2025-02-03\nurl: https://r.example\n---\nText.\n", "raw/p.bin": "xx", "raw/p.meta.md": "---\ntitle: P\n---\n",
    "raw/README.md": "no",
}
CFG = """
[vault]
notes = ["wiki/**/*.md"]
exclude = ["wiki/index.md"]
id_strip_prefix = "wiki/"
[resources]
paths = ["raw/**/*"]
exclude = ["raw/README.md"]
[kinds]
values = ["concept", "entity"]
unknown = "warn"
[tags]
inline = false
[diagnostics]
stale_after_days = 30
[diagnostics.required_fields]
concept = ["updated"]
[[edges]]
name = "CITES"
[[edges]]
name = "SOURCE_OF"
source = "frontmatter"
field = "source_refs"
target = "resource"
[[edges]]
name = "CONTRADICTS"
source = "frontmatter"
field = "contradicts"
"""


def write(root, files):
    for p, t in files.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)


def test_sync_incremental_equals_full(spark, tmp_path):
    from quillgraph.api import VaultView

    root, cfg = tmp_path / "v", config.parse(CFG)
    write(root, FILES)
    store = SnapshotStore(spark, f"file:{tmp_path}/s")
    out = S.sync(spark, str(root), cfg, store)
    assert (out.full, out.notes, out.resources) == (True, 4, 2)
    n = lambda: {r.edge: r.n for r in store.current("edges").groupBy("edge").agg(F.count("*").alias("n")).collect()}
    # the bare link to 'twin' from concepts leads to the one twin in that folder
    assert n() == {"CITES": 6, "SOURCE_OF": 1, "CONTRADICTS": 1, "TAGGED": 2}
    assert S.sync(spark, str(root), cfg, store).synced == 0
    (root / "wiki/concepts/beta.md").write_text("Now [[gamma]] only, and [[alpha]].\n")
    assert S.sync(spark, str(root), cfg, store).synced == 1 and n()["CITES"] == 6
    write(root, {"wiki/concepts/gamma.md": "Nothing.\n"})
    assert S.sync(spark, str(root), cfg, store).synced == 1 and n()["CITES"] == 7
    (root / "wiki/concepts/gamma.md").unlink()
    out = S.sync(spark, str(root), cfg, store)
    assert out.deleted == 1 and n()["CITES"] == 6
    fresh = SnapshotStore(spark, f"file:{tmp_path}/f")
    S.sync(spark, str(root), cfg, fresh)
    for t in ("edges", "notes"):
        assert sorted(map(str, fresh.current(t).drop("body_hash").collect())) == sorted(map(str, store.current(t).drop("body_hash").select(fresh.current(t).drop("body_hash").columns).collect()))
    v = VaultView(spark, store, cfg)
    assert v.resolve_id("wiki/concepts/alpha.md") == "concepts-alpha" and v.resolve_id("beta") == "concepts-beta" and v.resolve_id("twin") is None
    assert v.search("twin").count() >= 2 and v.lineage("concepts-alpha").count() > 0
    assert {r.id for r in v.neighbours("concepts-alpha", "SOURCE_OF", "out").collect()} == {"raw/r.md"}
    assert {(r.rule, r.id) for r in v.diagnostics().collect()} >= {("broken_link", "concepts-beta"), ("missing_field", "concepts-sub-twin")}
    assert v.health(dt.date(2025, 6, 1))["stale"].count() == 1 and v.list_notes(kind="entity").count() == 1
    assert v.query("select count(*) n from note where kind = :k", k="entity").first().n == 1
    r = {x.rel_path: x for x in store.current("resources").collect()}
    assert r["raw/r.md"].url == "https://r.example" and r["raw/r.md"].captured == dt.date(2025, 2, 3) and r["raw/p.bin"].title == "P"
    with pytest.raises(ValueError):
        v.neighbours("x", "NOPE")


def counts(store):
    return {r.edge: r.n for r in store.current("edges").groupBy("edge").agg(F.count("*").alias("n")).collect()}


def test_bundle_of_markdown_path_links(spark, tmp_path):
    """Both forms of path links beside a wikilink: nine notes, nine links, six of them from one table."""
    metrics = ["count", "users", "revenue", "sessions", "bounce"]
    root, body = tmp_path / "b", "\n".join(f"- [{m}](../references/metrics/{m}.md)" for m in metrics)
    write(root, {
        "tables/events_.md": f"---\ntype: Big Table\ntitle: Events\ntimestamp: 2026-05-28T00:00:00Z\nresource: https://x.example\n---\n{body}\n[clicks](../references/joins/clicks.md)\n[gone](../references/metrics/gone.md) [gone](../references/metrics/lost.md)\n",
        **{f"references/metrics/{m}.md": f"---\ntype: Reference\ntitle: {m}\n---\nText.\n" for m in metrics},
        "references/joins/clicks.md": "---\ntype: Reference\n---\nText.\n", "datasets/shop.md": "---\ntype: Dataset\n---\nText.\n",
        "overview.md": "---\ntype: Playbook\nowner_team: a\n---\n[t](/tables/events_.md#schema) [m](./references/metrics/count.md \"title\") [[shop]] [no](/models/churn.md) [ext](https://x.example/a.md) [d](data.csv) `[c](/tables/events_.md)` ![i](/tables/events_.md) [up](../../x.md)\n",
        "index.md": "[t](/tables/events_.md)\n", "references/index.md": "x\n", "log.md": "x\n",
    })
    cfg = config.parse('[vault]\nnotes = ["**/*.md"]\nexclude = ["**/index.md", "log.md"]\n[notes.fields]\nkind = "type"\nupdated = "timestamp"\n[links]\nmarkdown_paths = true\n')
    store = SnapshotStore(spark, f"file:{tmp_path}/s")
    assert S.sync(spark, str(root), cfg, store).notes == 9
    e = store.current("edges").where("edge = 'LINKS_TO'")
    assert e.count() == 9 and e.where("src = 'tables-events_'").count() == 6
    assert {r.dst for r in e.where("src = 'overview'").collect()} == {"tables-events_", "references-metrics-count", "datasets-shop"}
    n = {r.id: r for r in store.current("notes").collect()}
    assert n["tables-events_"].updated == dt.date(2026, 5, 28) and n["overview"].kind == "Playbook" and "owner_team" in n["overview"].frontmatter_json
    off = SnapshotStore(spark, f"file:{tmp_path}/o")
    S.sync(spark, str(root), config.parse('[vault]\nexclude = ["**/index.md", "log.md"]'), off)
    assert off.current("edges").where("edge = 'LINKS_TO'").count() == 1


def test_sync_opens_only_changed_files_and_relinks(spark, tmp_path, monkeypatch):
    from quillgraph.sources import files

    root, cfg = tmp_path / "v", config.parse(CFG)
    write(root, FILES)
    store = SnapshotStore(spark, f"file:{tmp_path}/s")
    S.sync(spark, str(root), cfg, store)
    (root / "wiki/concepts/beta.md").write_text("Now [[gamma]] only, and [[alpha]].\n")
    S.sync(spark, str(root), cfg, store)
    opened = []
    real = files.contents

    def seen(f):
        opened.extend(r.rel_path for r in f.select("rel_path").collect())
        return real(f)

    monkeypatch.setattr(files, "contents", seen)
    assert S.sync(spark, str(root), cfg, store).synced == 0 and opened == []
    write(root, {"wiki/concepts/gamma.md": "Nothing.\n"})
    out = S.sync(spark, str(root), cfg, store)
    assert (out.synced, out.relinked) == (1, 1) and set(opened) == {"wiki/concepts/gamma.md"}
    opened.clear()
    (root / "raw/p.meta.md").write_text("---\ntitle: Other\n---\n")
    S.sync(spark, str(root), cfg, store)
    assert set(opened) <= {"raw/p.meta.md"} and {r.title for r in store.current("resources").where("rel_path = 'raw/p.bin'").collect()} == {"Other"}
    (root / "wiki/concepts/gamma.md").unlink()
    out = S.sync(spark, str(root), cfg, store)
    assert (out.deleted, out.relinked) == (1, 1) and counts(store)["CITES"] == 6


def test_one_writer_and_versions(spark, tmp_path):
    from quillgraph.sources.snapshot import Conflict

    store = SnapshotStore(spark, f"file:{tmp_path}/s", keep=2, lease=0)
    t = [spark.range(i + 1).selectExpr("id") for i in range(4)]
    for x in t[:3]:
        store.publish({"t": x})
    assert store.current("t").count() == 3 and len(store._numbers()) == 2
    assert len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("t-")]) <= 3
    held = SnapshotStore(spark, f"file:{tmp_path}/h")
    with held.writer():
        with pytest.raises(Conflict):
            with SnapshotStore(spark, f"file:{tmp_path}/h").writer():
                pass
    with held.writer():  # free again
        held.publish({"t": t[0]})
    # of two that start from one version, the second is refused
    state, n = held.state(), held._numbers()[-1]
    with pytest.raises(Conflict):
        held._put(f"version-{n:012d}.json", "{}")
    assert held.state() == state and held.current("t").count() == 1


def test_indexer(spark, tmp_path):
    root, cfg = tmp_path / "v", config.parse(CFG)
    write(root, FILES)
    x = S.Indexer(spark, str(root), cfg, SnapshotStore(spark, f"file:{tmp_path}/s"), debounce=0.2)
    import time

    assert x.tick() is None  # not quiet yet
    time.sleep(0.3)
    assert x.tick().synced == 7 and x.tick() is None
    x.open("wiki/concepts/beta.md", "Open text, no links.\n")
    assert x.sync_now().synced == 1 and counts(x.store)["CITES"] == 5
    x.close("wiki/concepts/beta.md")
    assert x.sync_now().synced == 1 and counts(x.store)["CITES"] == 6


def test_watch_syncs(spark, tmp_path):
    root, cfg = tmp_path / "v", config.parse(CFG)
    write(root, FILES)
    store = SnapshotStore(spark, f"file:{tmp_path}/s")
    q = S.watch(spark, str(root), cfg, store, str(tmp_path / "c"))
    import time

    end = time.time() + 60
    while time.time() < end and store.current("edges") is None:
        time.sleep(0.5)
    q.stop()
    assert store.current("notes").count() == 4


def test_upsert_stream(spark, tmp_path):
    spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (2, 1, "c")], "k int, t int, v string").write.parquet(str(tmp_path / "in"))
    store = SnapshotStore(spark, f"file:{tmp_path}/s")
    src = spark.readStream.schema("k int, t int, v string").parquet(str(tmp_path / "in"))
    S.upsert_stream(src, store, "last", "k", "t", str(tmp_path / "c")).awaitTermination()
    assert {(r.k, r.v) for r in store.current("last").collect()} == {(1, "b"), (2, "c")}


def test_config():
    cfg = config.parse(CFG)
    assert cfg.content_hash() == config.parse(CFG + "\n[server]\nport = 1\n").content_hash() != config.Config().content_hash()
    for bad in ('[[edges]]\nname = "TAGGED"', '[[edges]]\nname = "A"\nsource = "frontmatter"', '[[edges]]\nname = "A"\n[[edges]]\nname = "B"', "[nope]\nx = 1", "[vault]\nx = 1"):
        with pytest.raises(ValueError):
            config.parse(bad)
    assert config.parse('[llm]\nmodel = "a"\n[llm.ask]\nmodel = "b"').for_task("ask") == {"model": "b"}
    import re
    import tempfile
    from pathlib import Path

    with tempfile.TemporaryDirectory() as d:
        (Path(d) / "a/b").mkdir(parents=True)
        (Path(d) / "own.toml").write_text(CFG)
        assert config.discover(f"{d}/a/b", ("own.toml",))[1] == cfg and config.discover(f"{d}/a/b", ("own.toml",))[0] == str(Path(d).resolve())
    assert re.match(config.glob_regex("wiki/**/*.md"), "wiki/a/b.md") and re.match(config.glob_regex("**/*.md"), "b.md") and not re.match(config.glob_regex("raw/*.md"), "raw/a/b.md")


def test_changes_and_upsert(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (None, "n")], "k int, h string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k int, h string")
    assert {(r.k, r.change) for r in changes(a, b, "k", "h").collect()} == {(1, "deleted"), (2, "changed"), (4, "added")}
    assert changes(a.limit(0), b.limit(0), "k", "h").count() == 0
    assert {(r.k, r.h) for r in upsert(a.where("k is not null"), b, "k", a.where("k = 1")).collect()} == {(2, "z"), (3, None), (4, "w")}


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (None, 1), (3, 1)], "u long, v long")
    assert {(r.u, r.root) for r in components(e, Scratch(spark, "t")).collect()} == {(2, 1), (3, 1), (8, 7), (9, 7)}
    hub = spark.range(1, 3000).selectExpr("id as u", "0L as v")
    chain = spark.range(3000, 3100).selectExpr("id as u", "id + 1 as v")
    got = components(hub.union(chain), Scratch(spark, "t"))
    assert got.where("root = 0").count() == 2999 and got.where("root = 3000").count() == 100
    assert components(e.limit(0), Scratch(spark, "t")).count() == 0


def test_search(spark):
    d = spark.createDataFrame([(1, "red fox", "q"), (2, "red red dog", "q"), (3, None, "q"), (4, "", "q"), (5, "red fox", "q")], "id long, text string, score string")
    got = [(r.id, r.score) for r in search.bm25(d, "fox RED", 3).collect()]
    assert [i for i, _ in got] == [1, 5, 2] and search.bm25(d, "", 3).count() == 0 and search.bm25(d.limit(0), "fox", 3).count() == 0
    v = spark.createDataFrame([(i, [float(i % 3 == k) for k in range(3)]) for i in range(9)] + [(99, None)], "vec_id long, embedding array<double>")
    near = search.nearest(v.where("vec_id in (0, 4)"), v, 2).collect()
    assert {(r["query"], r.id) for r in near} == {(0, 3), (0, 6), (4, 1), (4, 7)}
    named = v.withColumn("vec_id", F.concat(F.lit("n"), "vec_id"))
    assert {(r["query"], r.id) for r in search.nearest(named.where("vec_id = 'n4'"), named, 2).collect()} == {("n4", "n1"), ("n4", "n7")}
    pairs = search.similarity_pairs(search.nearest(v, v, 3), None, 0.5)
    assert [(r.a, r.b) for r in pairs.collect()][:3] == [(0, 3), (0, 6), (1, 4)] and search.similarity_pairs(search.nearest(v, v, 3), None, 0.5, among=v.where("vec_id < 4").select(F.col("vec_id").alias("id"))).count() == 1
    assert search.rrf(spark.createDataFrame([("a", 1, 9.0), ("b", 1, 5.0), ("b", 2, 7.0)], "leg string, id long, score double"), 1).first().id == 1


def test_stored_index_and_hybrid(spark, tmp_path):
    d = spark.createDataFrame([(i, f"red fox {i % 7}" + " word" * (i % 5)) for i in range(60)] + [(99, None)], "id long, text string")
    q = spark.createDataFrame([("a", "fox RED 3"), ("b", "!"), ("c", "word word")], "query_id string, query string")
    for name, t in search.index_tables(d).items():
        w = t.write
        (w.partitionBy("bucket") if "bucket" in t.columns else w).parquet(f"{tmp_path}/{name}")
    index = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("postings", "terms", "index_stats")}
    got = search.index_search(index, q, 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, search.bm25_batch(d, q, 5).collect())) and got.count() == 10
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    one = {r.id: r.score for r in search.bm25(d, "fox RED", None).collect()}
    assert all(abs(one[r.id] - r.score) < 1e-6 for r in search.bm25_batch(d, spark.createDataFrame([(1, "fox red")], "query_id int, query string"), 100).collect())
    vec = spark.createDataFrame([("a", 0, 1), ("a", 3, 2)], "query_id string, id long, rank int")
    both = search.hybrid(got, vec, 3).where("query_id = 'a'").collect()
    assert both[0].rank == 1 and both[0].id == 0 and len(both) == 3
    runs = got.withColumn("run", F.lit("r"))
    assert search.candidate_pages(runs, 4).count() == 4


def test_vector_index_recall(spark):
    import numpy as np

    from quillgraph.operators import vectors

    rng = np.random.default_rng(1)
    c = rng.standard_normal((60, 32))
    x = np.array([c[i % 60] + 0.5 * rng.standard_normal(32) for i in range(900)], np.float32)
    rows = [(f"n{i:03d}", v.tolist()) for i, v in enumerate(x)] + [("zero", [0.0] * 32), (None, [1.0] * 32), ("null", None)]
    got = {}
    for r in vectors.neighbours(spark.createDataFrame(rows, "id string, v array<float>"), Scratch(spark, "t"), 5, block=50).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r.id
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = [{f"n{j:03d}" for j in np.argsort(-s[i])[:5]} for i in range(900)]
    assert len(got) == 900 and sum(len(w & set(got[f"n{i:03d}"].values())) for i, w in enumerate(want)) / 4500 >= 0.95
    assert vectors.neighbours(spark.createDataFrame([], "id string, v array<float>"), Scratch(spark, "t")).count() == 0


def test_communities_by_modularity(spark):
    ring = [(g * 6 + a, g * 6 + b) for g in range(5) for a in range(6) for b in range(a)] + [(g * 6, (g + 1) % 5 * 6) for g in range(5)]
    e = spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}") for a, b in ring], "src string, dst string").withColumns({"dst_type": F.lit("Note"), "edge": F.lit("L")})
    got = graph.communities(e, Scratch(spark, "t"))
    assert {r.id: r.community for r in got.collect()} == {f"n{i:02d}": f"n{i // 6 * 6:02d}" for i in range(30)}
    assert graph.modularity(e, got) > 0.7 and graph.communities(e.limit(0), Scratch(spark, "t")).count() == 0


def test_reads_with_limits(spark):
    e = spark.createDataFrame([("a", f"b{i}") for i in range(9)], "src string, dst string").withColumns({"dst_type": F.lit("Note"), "edge": F.lit("L")})
    seeds = spark.createDataFrame([("a",)], "id string")
    assert [r.id for r in graph.expand(e, seeds, 1, Scratch(spark, "t"), per_hop=3).where("hop = 1").orderBy("id").collect()] == ["b0", "b1", "b2"]
    both = graph.lineage_both(e, spark.createDataFrame([("b1",)], "id string"))
    assert both["down"].count() == 0 and [r.id for r in both["up"].collect()] == ["a"]
    n = spark.createDataFrame([("a", "T", "k", None, ["x", "y"], dt.date(2025, 1, 1)), ("b", None, "", "s", None, None)], "id string, title string, kind string, status string, tags array<string>, updated date")
    assert [r.id for r in graph.facet_filter(n, ("(none)",)).collect()] == ["b"] and [r.id for r in graph.facet_filter(n, tags=("y", "z"), since="2024-01-01", hits=seeds).collect()] == ["a"]
    assert [r.tag for r in graph.tag_dictionary(n).collect()] == ["x", "y"] and graph.tag_counts(n, 1).count() == 1
    assert [r.id for r in search.contains(n, "t").collect()] == ["a"] and search.search_docs(n).columns == ["id", "title", "body", "tags"] if "body_text" in n.columns else True


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d")], "src string, dst string").withColumns({"dst_type": F.lit("Note"), "edge": F.lit("L")})
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {(r.id, r.hop) for r in graph.expand(e, seeds, 2).collect()} == {("a", 0), ("b", 1), ("c", 1)}
    assert {(r.id, r.depth) for r in graph.lineage(e, seeds, 3).collect()} == {("b", 1), ("c", 2), ("a", 3)}
    notes = spark.createDataFrame([("a",), ("z",)], "id string")
    assert [r.id for r in graph.orphans(notes, e).collect()] == ["z"]
    assert graph.communities(e, Scratch(spark, "t")).select("community").distinct().count() <= 2


def test_checks(spark):
    c = spark.createDataFrame([("k", i, t) for i, t in enumerate(["short", "A  claim long enough", "a claim LONG enough", None, "Another claim here"])], "key string, pos int, text string")
    assert [r.text for r in checks.valid_claims(c, ["key"], "text", ["pos"]).orderBy("n").collect()] == ["A claim long enough", "Another claim here"]
    assert checks.merge_chunks(c, ["key"], "text", ["pos"]).first().merged[0] == "short"
    q = spark.createDataFrame([("a  b c", "b\nc"), ("a", ""), (None, "a"), ("a", None)], "body string, quote string")
    assert checks.verbatim(q, F.col("body"), F.col("quote")).count() == 1
    notes = spark.createDataFrame([("concepts-a", "a")], "id string, slug string")
    pl = spark.createDataFrame([("k", 0, "x a"), ("k", 1, "x b a"), ("k", 2, "x"), ("m", 0, "y a"), ("m", 1, "z")], "key string, pos int, text string").withColumn("dir", F.lit("concepts"))
    l = spark.createDataFrame([("k", 0, "x [[a]]"), ("k", 1, "x [[b]] [[a]]"), ("k", 2, "y [[a]]"), ("m", 0, "y [[a]]")], "key string, pos int, text string")
    got = [(r.text, r.reverted) for r in checks.linked_claims(pl, l, notes).orderBy("key", "pos").collect()]
    assert got == [("x [[a]]", False), ("x b [[a]]", False), ("x", True), ("y a", True), ("z", True)]
    specs = spark.createDataFrame([("r", 0, "Ok-1 ", "concepts", " ", None), ("r", 1, "Bad!", "concepts", "t", None), ("r", 2, "a", "concepts", "t", None), ("r", 3, "ok-1", "concepts", "t", None), ("r", 4, "two", "concepts", "T", "odd")], "run string, pos int, slug string, dir string, title string, kind string")
    assert [(r.id, r.title, r.kind) for r in checks.valid_new_pages(specs, {"concepts": "concept"}, notes, kinds=("concept",)).orderBy("pos").collect()] == [("concepts-ok-1", "ok 1", "concept"), ("concepts-two", "T", "concept")]


def test_rename_and_definitions(spark):
    files = spark.createDataFrame([("wiki/c/a.md", "# Top\n\n## Part Two\n"), ("wiki/c/b.md", "[[a#part-two|x]] and `[[a]]`")], "rel_path string, text string")
    n = M.parsed_notes(files)
    p = F.col("path")
    n = n.withColumns({"id": T.note_id(p), "slug": T.note_slug(p), "dir": T.note_dir(p)})
    assert [r.replacement for r in resolve.rename_plan(n, "c-a", "new").collect()] == ["[[new#part-two|x]]", "wiki/c/new.md"]
    assert {(r.pos, r.heading_start) for r in resolve.definitions(n).collect()} == {(0, 7), (1, None)}


class Scripted:
    def __init__(self, replies):
        self.replies = replies

    def complete(self, task, messages, temperature=0.0):
        return self.replies[task].pop(0)


def test_ask_and_distill(spark):
    notes = spark.createDataFrame([("a", "Fox", "red fox runs"), ("b", "Dog", "brown dog"), ("c", "Cat", "grey cat")], "id string, title string, body_text string")
    e = spark.createDataFrame([("a", "b", "Note", "CONTRADICTS")], "src string, dst string, dst_type string, edge string")
    t = ask.Recorded(Scripted({"decompose": ["bad", '{"subquestions": ["fox"]}'], "synthesize": ['{"answer": "Runs.", "citations": ["a", "zz"], "abstained": false}']}))
    got = ask.ask("what of the fox", notes, e, t)
    assert got["citations"] == ["a"] and got["notes_considered"] == 2 and got["contradictions"] == [("a", "b")] and [r["parsed_ok"] for r in t.records] == [False, True, True]
    none = ask.ask("zzz", notes, e, ask.Recorded(Scripted({"decompose": ["{}"]})))
    assert none["abstained"] and none["notes_considered"] == 0
    pages = spark.createDataFrame([("s", "T", "## Summary\nS.\n\n## Key claims\n- one [[a|x]]\n", [("source_refs", "r.md")]), ("t", "T", "", [])], "id string, title string, body_text string, fields array<struct<field: string, value: string>>")
    m = distill.mined(pages, spark.createDataFrame([("r.md", "raw")], "rel_path string, body_text string"))
    assert {(r.key, r.skip_reason) for r in m.collect()} == {("s", None), ("t", "not_one_source_ref")}
    import json

    got = json.loads(distill.pairs(m).first().target)
    assert got["summary"] == "S." and got["key_claims"] == [{"text": "one x", "entities": ["x"]}] and got["suggested_slug"] == "s"


def test_distill_reasons_gold_links_and_runs(spark, tmp_path):
    import json

    page = lambda claims="- one [[concepts/fox|Fox]] [[b]]\n- two\n": f"## Summary\n\nS  s.\n\n## Key claims\n\n{claims}\n## Quotes\n\n> \"red  fox\" — p1\n\n> \"never said\"\n\n## Contradictions\n\n- with [[old]]\n\n## Cross-references\n\n- [[b]]\n"
    refs = lambda *r: [("source_refs", x) for x in r]
    rows = [
        ("ok", page(), refs("r.md")), ("none", page(), []), ("two", page(), refs("r.md", "e.md")), ("missing", page(), refs("zz.md")), ("bin", page(), refs("r.pdf")), ("empty", page(), refs("e.md")),
        ("long", page(), refs("l.md")), ("unread", page(), refs("n.md")), ("bare", "text", refs("r.md")), ("noclaims", page("text\n"), refs("r.md")), ("gone", None, refs("r.md")),
    ]
    shape = "id string, body_text string, fields array<struct<field: string, value: string>>"
    pages = spark.createDataFrame(rows, shape).withColumns({"title": F.col("id"), "slug": F.col("id"), "frontmatter_json": F.lit('{"title": "T", "tags": ["t"], "author": "A"}'), "path": F.concat(F.lit("wiki/sources/"), "id", F.lit(".md")), "kind": F.lit("source")})
    res = spark.createDataFrame([("r.md", "R", None, "the red\nfox"), ("e.md", "E", None, " \n"), ("l.md", "L", None, "x" * 28_001), ("n.md", "N", None, None), ("r.pdf", "P", None, "x")], "rel_path string, title string, url string, body_text string")
    notes = spark.createDataFrame([("concepts-fox", "wiki/concepts/fox.md", "Fox", "concept"), ("b", "wiki/b.md", "B", None), ("c", "wiki/c.md", "C", "x")], "id string, path string, title string, kind string")
    cand = spark.createDataFrame([("ok", "c", 1), ("ok", "b", 2)], "id string, candidate string, rank int")
    m = {(r.task, r.key): r for r in distill.mined(pages, res, {"concepts": "concept"}, cand, notes).collect()}
    why = {k: r.skip_reason for (t, k), r in m.items() if t == "extract"}
    assert why == {"ok": None, "none": "not_one_source_ref", "two": "not_one_source_ref", "missing": "resource_missing_or_not_markdown", "bin": "resource_missing_or_not_markdown", "empty": "resource_empty", "long": "resource_too_long", "unread": "resource_unreadable", "bare": "sections_missing", "noclaims": "sections_missing", "gone": "page_unreadable"}
    ex = json.loads(m["extract", "ok"].target)
    assert ex["quotes"] == [{"text": "red\nfox", "location": "p1"}] and ex["entities"] == [{"name": "Fox", "kind": "concept", "blurb": ""}] and ex["summary"] == "S s." and ex["author"] == "A" and ex["tags"] == ["t"] and ex["publisher"] is None
    links = m["suggest_links", "ok"]
    assert links.prompt.endswith("Candidates:\n- c — C (x)\n- b — B ()\n- concepts/fox — Fox (concept)") and links.prompt.startswith("1. one Fox b\n2. two\n")
    assert json.loads(links.target)["cross_references"] == ["b"] and json.loads(links.target)["linked_claims"][0] == "one [[concepts/fox|Fox]] [[b]]"
    # runs
    (tmp_path / "runs").mkdir()
    w = lambda path, seq, kind="created", head=None: {"rel_path": path, "kind": kind, "section_heading": head, "content_hash": "h", "seq": seq}
    man = {"run_id": "r1", "created": "c", "raw_rel_path": "r.md", "raw_body_hash": "h", "provider": "p", "model": "m", "writes": [w("wiki/sources/ok.md", 1), w("wiki/concepts/n.md", 2), w("wiki/concepts/u.md", 3, "appended", "## T (2025 ingest)"), w("wiki/concepts/u.md", 9, "appended", "## Gone (2025 ingest)")]}
    (tmp_path / "runs/r1.meta.json").write_text(json.dumps(man, indent=1))
    (tmp_path / "runs/r2.meta.json").write_text(json.dumps({**man, "run_id": "r2", "writes": [w("wiki/sources/zz.md", 1)]}))
    (tmp_path / "runs/bad.meta.json").write_text("{")
    call = lambda run, seq, task, out="{}", ok=True: json.dumps({"run_id": run, "seq": seq, "task": task, "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": f"ask {task}"}], "raw_output": out, "parsed_ok": ok})
    found = '{"findings": [{"page_id": "old", "existing_text": "e", "new_claim": "n", "explanation": "x"}, {"page_id": "other"}]}'
    lines = [call("r1", 1, "extract"), call("r1", 5, "extract"), call("r1", 2, "suggest_links"), call("r1", 3, "page_update"), call("r1", 9, "page_update"), call("r1", 4, "page_update", ok=False), call("r1", 6, "contradiction", found), call("r1", 7, "contradiction", '{"findings": []}'), call("r1", 8, "extract_chunk"), call("r2", 1, "extract"), call("r2", 2, "contradiction", found), "no json"]
    (tmp_path / "runs/all.jsonl").write_text("\n".join(lines))
    rec, wr = distill.read_runs(spark, f"{tmp_path}/runs"), distill.read_manifests(spark, f"{tmp_path}/runs")
    assert rec.count() == 11 and wr.count() == 5
    more = spark.createDataFrame([("n", "N", "concept", "x", "wiki/concepts/n.md"), ("u", "U", "concept", "a\n## T (2025 ingest)\n\nnew text\n\n## Next\nz", "wiki/concepts/u.md")], "id string, title string, kind string, body_text string, path string").withColumns({"slug": F.col("id"), "frontmatter_json": F.lit(None).cast("string")})
    now = pages.where("id = 'ok'").select(more.columns).unionByName(more)
    got = distill.mined_from_runs(rec, wr, now, res, {"concepts": "concept"}).collect()
    by = {(r.task, r.key): r for r in got}
    assert sorted((r.task, r.skip_reason or "") for r in got) == sorted([("extract", ""), ("extract", "no_page_written"), ("extract", "page_deleted"), ("extract", "chunk_of_an_extraction"), ("suggest_links", ""), ("page_update", ""), ("page_update", "section_removed"), ("contradiction", ""), ("contradiction", ""), ("contradiction", "page_deleted")])
    assert json.loads(by["page_update", "wiki/concepts/u.md### T (2025 ingest)"].target) == {"topic": "T", "section_md": "new text", "relevant": True}
    plan = json.loads(by["suggest_links", "ok"].target)
    assert plan["update_targets"] == ["concepts/u"] and [p["slug"] for p in plan["new_pages"]] == ["n"]
    assert [f["page_id"] for f in json.loads(by["contradiction", "r1:6"].target)["findings"]] == ["old"] and json.loads(by["contradiction", "r1:7"].target) == {"findings": []}
    assert [r.n for r in distill.histogram(distill.mined(pages, res)).where("outcome = 'emitted'").collect()] == [1]


def test_eval_sources(spark, tmp_path):
    (tmp_path / "log").write_text("[1] OK a.md 12s\n[2] FAIL b.md 3s\nnoise\n=== TEACHER ===\n[1] OK a.md 4s\n[2] OK b.md 6s\n=== TEACHER ===\n[3] OK c.md 20s\n")
    got = {r.side: (r.ok, r["fail"], r.seconds_avg) for r in distill.log_metrics(distill.read_run_log(spark, f"file:{tmp_path}/log")).collect()}
    assert got == {"student": (2, 1, 16.0), "teacher": (2, 0, 5.0)}
    (tmp_path / "rep").mkdir()
    (tmp_path / "rep/a.json").write_text('{"run_id": "r", "raw_path": "p", "pages_created": ["x"], "pages_updated": [], "contradictions": [], "warnings": ["dropped junk claim a", "odd", "slug malformed slug x"]}')
    (tmp_path / "rep/b.json").write_text("{")
    sums, w = checks.report_metrics(distill.read_reports(spark, f"{tmp_path}/rep"))
    assert (sums.first().reports, sums.first().pages_created) == (1, 1) and {(r.bucket, r.n) for r in w.collect()} == {("junk claim dropped", 1), ("other", 1), ("malformed slug", 1)}
    pages = spark.createDataFrame([("## Key claims\n- a [[x]] [[y]]\n- b\n\n## Quotes\n> q\n",), ("none",)], "body_text string")
    assert tuple(checks.page_metrics(pages).first()) == (2, 1.0, 0.5, 2)
    side = checks.compared(sums, sums.withColumn("reports", F.lit(5)))
    assert {r.metric: (r.student, r.teacher) for r in side.collect()}["reports"] == ("1", "5")


def test_facade_by_meaning(spark, tmp_path):
    from quillgraph.api import VaultView

    class Busy(Exception):
        status = 503

    class Short:
        dim = 8

        def embed(self, text):
            if len(text) > 1500:
                raise Busy
            return ask.HashingEmbedder(8).embed(text)

    assert len(ask.Capped(Short(), 7000).embed("word " * 2000)) == 8
    with pytest.raises(Busy):
        ask.Capped(Short(), 7000, least=2000).embed("word " * 2000)
    assert ask.Capped(ask.HashingEmbedder(8), instruction="find").embed_query("x") == ask.HashingEmbedder(8).embed("Instruct: find\nQuery: x")
    cfg = config.parse('[embeddings]\nenabled = true\nprovider = "hash"\ndim = 8\n').embeddings
    with pytest.raises(ValueError):
        ask.make_provider(cfg, {"hash": lambda c: ask.HashingEmbedder(9)})
    provider = ask.make_provider(cfg, {"hash": lambda c: ask.HashingEmbedder(c.dim)})
    root, vcfg = tmp_path / "v", config.parse(CFG)
    write(root, FILES)
    store = SnapshotStore(spark, f"file:{tmp_path}/s")
    S.sync(spark, str(root), vcfg, store)
    n = store.current("notes").withColumns({"embedding": F.lit(None).cast("array<float>"), "embedded_hash": F.lit(None).cast("string")})
    store.publish({"notes": ask.embed_missing(n, lambda: ask.HashingEmbedder(8))})
    t = ask.Recorded(Scripted({"decompose": ['{"subquestions": ["twin alpha"]}'], "synthesize": ['{"answer": "Yes.", "citations": ["concepts-beta"]}']}))
    v = VaultView(spark, store, vcfg, provider, t)
    assert v.semantic_search("Back to alpha").first().id == "concepts-beta" and v.hybrid("twin").count() >= 2 and v.search("twin").count() >= 2
    near = {r.id: r.linked for r in v.similar_notes("beta", 10).collect()}
    assert "concepts-beta" not in near and len(near) == 3 and near["concepts-alpha"] and v.similar_notes("beta", 10, True).where("linked").count() == 0
    assert v.similarity(3, -1).count() >= 4 and v.similarity(3, -1, True).where("linked").count() == 0
    got = v.ask("what?")
    assert got["citations"] == ["concepts-beta"] and got["notes_considered"] == 4
    assert v.markdown("beta", str(root)).startswith("---\ntitle: Beta") and v.expand(["concepts-beta"]).count() == 3
    assert {r.id for r in v.lineage_both("concepts-beta")["down"].collect()} >= {"concepts-alpha"} and [r.tag for r in v.tags().collect()] == ["t"]
    cand = ask.candidate_pages(["alpha text", "the twin"], ["Beta"], v.notes, 3, provider, v.index)
    assert cand.count() == 3 and cand.columns == ["id", "title", "kind", "score"]
    with pytest.raises(ValueError):
        VaultView(spark, store, vcfg).semantic_search("x")


def test_embed_missing(spark):
    n = spark.createDataFrame([("a", "k", "text one", "h", None, None), ("b", "k", "x", "h", [1.0], "h")], "id string, kind string, body_text string, body_hash string, embedding array<float>, embedded_hash string")
    got = {r.id: r for r in ask.embed_missing(n, lambda: ask.HashingEmbedder(8)).collect()}
    assert len(got["a"].embedding) == 8 and got["a"].embedded_hash == "h" and got["b"].embedding == [1.0]

    class Fails:
        def embed(self, text):
            raise RuntimeError("down")

    bad = {r.id: r for r in ask.embed_missing(n, Fails).collect()}
    assert bad["a"].embedding is None and bad["a"].embedded_hash is None and bad["a"].embed_error == "RuntimeError: down" and bad["b"].embed_error is None


def test_catalog_names_have_sql():
    from quillgraph.plans import catalog

    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.ORACLES) > 55


def test_replies_in_fences_and_behind_lead_ins(spark, tmp_path):
    import json

    from quillgraph.plans import catalog

    ways = [lambda x: x, lambda x: f"```json\n{x}\n```", lambda x: f"Here is the result:\n{x}", lambda x: f"[{x}]", lambda x: x[:-2], lambda x: "no reply"]
    rows = []
    for i, way in enumerate(ways):
        asked = [("user", f"The body says  claim number {i} in full.")]
        claim = {"text": f"claim number {i} in full"}
        found = {"page_id": f"p{i}", "existing_text": "e", "new_claim": claim["text"], "explanation": "x"}
        for task, reply in (("extract", {"key_claims": [claim]}), ("contradiction", {"findings": [found]}), ("suggest_links", {"linked_claims": [f"see [[d{i}]] now"]})):
            rows.append((f"{task}{i}", 0, task, asked, way(json.dumps(reply))))
    rows.append(rows[3])
    t = spark.createDataFrame(rows, "run_id string, seq long, task string, messages array<struct<role: string, content: string>>, raw_output string")
    t.write.parquet(f"{tmp_path}/training_records.parquet")
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted(r.run_id for r in run("claims_validate")) == [f"extract{i}" for i in range(5)]
    assert {(r.run_id, r.n) for r in run("extract_merge")} == {(f"extract{i}", 1) for i in range(5)}
    assert {(r.page_id, r.verbatim) for r in run("findings_verbatim")} >= {(f"p{i}", True) for i in range(4)}
    assert {r.target for r in run("claim_links")} >= {f"d{i}" for i in range(4)}


def test_graph_reads_start_from_every_note(spark, tmp_path):
    from quillgraph.plans import catalog, vault

    docs = [(i, f"text {i}", "en", "web", "note", None) for i in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, kind string, updated date").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    n = vault.notes(spark, str(tmp_path))
    edges = vault.edges(n).collect()
    ids = {r.id for r in n.select("id").collect()}
    assert len(ids) == 120
    outs, ins = collections.Counter(e.src for e in edges), collections.Counter(e.dst for e in edges)
    assert {(r.id, r.out_n, r.in_n) for r in run("note_detail")} == {(i, outs[i], ins[i]) for i in ids}
    steps = {(e.src, e.dst) for e in edges if e.dst_type == "Note"}
    for name, way in (("lineage_down", steps), ("lineage_up", {(b, a) for a, b in steps})):
        level, want = {(i, i) for i in ids}, set()
        for depth in (1, 2, 3):
            level = {(r, b) for r, x in level for a, b in way if a == x}
            want |= {(r, x, depth) for r, x in level}
        assert {(r.root, r.id, r.depth) for r in run(name)} == want and want
    near = steps | {(b, a) for a, b in steps}
    seen = {(i, i): 0 for i in ids}
    for hop in (1, 2):
        for root, x in list(seen):
            for a, b in near:
                if a == x:
                    seen.setdefault((root, b), hop)
        assert {(r.root, r.id): r.hop for r in run(f"expand_{hop}hop")} == seen


def test_relink_counts_links_of_every_form(spark, tmp_path):
    import re

    from quillgraph.plans import catalog, vault

    docs = [(i, f"text {i}", "en", "web", ("note", "clip", "answer", "log")[i // 10 % 4], None) for i in range(240)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, kind string, updated date").write.parquet(f"{tmp_path}/documents.parquet")
    n = vault.notes(spark, str(tmp_path))
    stay = [r.id for r in n.select("id", "path").collect() if int(re.search(r"/x(\d+)/", r.path)[1] if "/x" in r.path else re.search(r"d(\d+)\.md", r.path)[1]) % 13]
    after = n.where(F.col("id").isin(stay))
    links = resolve.note_links(n)
    was, now = ({(r.src, r.pos): (r.dst, r.outcome, r.target) for r in resolve.resolve(links, x).select("src", "pos", "dst", "outcome", "target").collect()} for x in (n, after))
    moved = {k for k in was if was[k][:2] != now[k][:2]}
    assert any("/" in was[k][2] for k in moved) and any(was[k][2].startswith("t") for k in moved)
    r = catalog.QUERIES["relink"](spark, str(tmp_path)).first()
    assert (r.links, r.notes) == (len(moved), len({src for src, _ in moved}))


def test_walks_are_never_shuffled(spark, tmp_path, monkeypatch):
    """Many ways lead to few ends: more walks than are written, roots wider than what is unfolded at once, null and
    repeated edges, types that are reached twice; all against plain sets."""
    from quillgraph.operators import walks

    monkeypatch.setattr(walks, "WALKS", 20)
    monkeypatch.setattr(walks, "PAIRS", 40)
    monkeypatch.setattr(walks, "EDGES", 60)
    ab = [(a, 7 * a + k) for a in range(5) for k in range(4)] + [(0, k) for k in range(40)] + [(-3, 2**40)]
    bc = [(b, (b * k) % 11) for b in range(40) for k in range(6)] + [(1, None), (None, 4), (2**40, -(2**40))]
    bb = [(3, 2**40), (3, 3), (3, None)]
    frame = lambda rows: spark.createDataFrame(rows + rows[:3], "head long, tail long")
    layers = [("a", "b", frame(ab)), ("b", "c", frame(bc)), ("b", "b", frame(bb)), ("c", "a", frame([])), ("x", "c", frame(ab))]
    roots = [0, 1, 4, -3, 99, None]
    of = {(s, h): set() for s, _, rows in (("a", "b", ab), ("b", "c", bc), ("b", "b", bb)) for h, _ in rows}
    for s, t, rows in (("a", "b", ab), ("b", "c", bc), ("b", "b", bb)):
        for h, x in rows:
            of[s, h].add((t, x) if x is not None else (None, None))
    for depth in (2, 3):
        got = walks.lineage(layers, spark.createDataFrame([(r,) for r in roots + [0]], "key long"), "a", depth, Scratch(spark, "walks")).collect()
        want, level = [], {(r, "a", r) for r in roots if r is not None}
        for d in range(1, depth + 1):
            level = {(r, *n) for r, t, k in level for n in of.get((t, k), ()) if k is not None}
            want += [(f"a:{r}", t and f"{t}:{k}", d) for r, t, k in level]
        order = lambda rows: sorted(rows, key=lambda x: (x[0], x[1] or "", x[2]))
        assert order(tuple(r) for r in got) == order(want)
    none = walks.lineage([], spark.createDataFrame([(1,)], "key long"), "a", 2, Scratch(spark, "walks"))
    assert none.collect() == [] and none.columns == ["root", "id", "depth"]
    with pytest.raises(TypeError, match="integers"):
        walks.lineage([], spark.createDataFrame([("1",)], "key string"), "a", 2, Scratch(spark, "walks"))


def test_key_graph_lineage_keeps_walks_off_the_disk(spark, tmp_path):
    """Every root reaches the same 20 ends in 200 ways each; the last level, with its 200,000 walks, is neither shuffled nor
    made distinct by Spark."""
    from quillgraph.plans.catalog import QUERIES

    many, parts, ends = 50, 200, 20
    rows = {
        "region": ("r_regionkey int", [(0,)]), "nation": ("n_nationkey int, n_regionkey int", [(0, 0)]),
        "customer": ("c_custkey long, c_nationkey int", [(c, 0) for c in range(many)]), "supplier": ("s_suppkey long, s_nationkey int", [(s, 0) for s in range(ends)]),
        "orders": ("o_orderkey long, o_custkey long", [(c, c) for c in range(many)]),
    }
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    lines = spark.range(many * parts).select((F.col("id") % many).alias("l_orderkey"), F.expr(f"id div {many}").alias("l_partkey")).crossJoin(spark.range(ends).withColumnRenamed("id", "l_suppkey"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    df = QUERIES["key_graph_lineage"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange hashpartitioning" not in plan
    got = {(r.depth, r.n) for r in df.groupBy("depth").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, 2 * many), (2, many * (parts + 1)), (3, many * ends)}

"""Small cases of every problem: nulls, empty and long texts, ties, repeats, empty tables, odd columns."""

import datetime as dt
import random

import numpy as np
import pytest

from quillgraph.llm import crosssplit, cutting, encoding, neighbours, packing, replies, splits, subjects
from quillgraph.runtime import Scratch

PAIR = "pair_id long, key string, task string, messages array<struct<role: string, content: string>>, split string, origin string, author string, raw_path string, u string, rank string"


def pair(i, key=None, text=None, split="train", author=None, raw=None):
    m = None if text is None else [("system", "Answer."), ("user", text)]
    return (i, key, "extract", m, split, "mined", author, raw, "x", "y")


# --- 1


def test_related_groups(spark):
    rows = [
        pair(10, "wiki/concepts/a-b.md#Head (2025)"), pair(11, " CONCEPTS-A-B "), pair(12, ".\\wiki\\Concepts\\a-b.md", author="Veva, Kiluneri"),
        pair(13, author="kiluneri  VEVA", raw="raw/clips/x.md"), pair(14, raw="./raw/clips/X.md\n"), pair(15, "concepts/other-b"),
        pair(16, "run-20250101-00a:1"), pair(17, "RUN-20250101-00A : 9"), pair(18, author="n/a"), pair(19, author="Unknown author"),
        pair(20, ""), pair(21, None), pair(None, "concepts-a-b"), pair(22, "entities/a-b.md"), pair(10, "wiki/concepts/a-b.md#Head (2025)"),
    ]
    got = {r.pair_id: r.group_id for r in splits.related_groups(spark.createDataFrame(rows, PAIR), Scratch(spark, "t")).collect()}
    assert {p: g for p, g in got.items() if p != g} == {11: 10, 12: 10, 13: 10, 14: 10, 17: 16}
    assert set(got) == set(range(10, 23))


def test_related_groups_match_union_find_and_splits_keep_groups(spark):
    rng = random.Random(4)
    rows = [pair(i, f"concepts-p{rng.randrange(150)}", author=rng.choice([None, "Hot Author", f"A B{rng.randrange(200)}"]), raw=f"raw/{rng.randrange(300)}.md") for i in range(400)]
    rows = [r if r[6] != "Hot Author" or r[0] % 3 == 0 else (*r[:6], None, *r[7:]) for r in rows]
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = {}
    for r in rows:
        for mark in (("k", r[1]), ("a", r[6]), ("r", r[7])):
            if mark[1]:
                a, b = sorted((find(seen.setdefault(mark, r[0])), find(r[0])))
                parent[b] = a
    scratch = Scratch(spark, "t")
    groups = scratch.keep(splits.related_groups(spark.createDataFrame(rows, PAIR), scratch))
    assert {r.pair_id: r.group_id for r in groups.collect()} == {i: find(i) for i in range(400)}
    by = {}
    for r in splits.balanced_splits(groups).collect():
        by.setdefault(r.group_id, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values())


def test_largest_difference_and_allocation():
    rng = random.Random(1)
    w = [rng.randint(1, 50) for _ in range(500)] + [4000]
    place = splits.largest_difference(w, 20)
    sums = [sum(x for x, b in zip(w, place) if b == k) for k in range(20)]
    assert max(sums) == 4000 and sorted(sums)[-2] - min(sums) <= 2
    even = splits.allocate([10] * 100)
    assert [even.count(s) for s in ("train", "valid", "test")] == [80, 10, 10]
    assert splits.largest_difference([], 4) == []


def test_splits_empty(spark):
    empty = spark.createDataFrame([], PAIR)
    groups = splits.related_groups(empty, Scratch(spark, "t"))
    assert groups.count() == 0 and splits.balanced_splits(groups).count() == 0


# --- 2


def brute(rows):
    texts = {r[0]: (r[4], crosssplit.words_of(r[3][1][1])) for r in rows if r[0] is not None and r[3] and r[4]}
    out = set()
    for a, (sa, wa) in texts.items():
        for b, (sb, wb) in texts.items():
            if sa == "train" and sb in ("valid", "test"):
                n = [[0] * (len(wb) + 1) for _ in range(len(wa) + 1)]
                for i, x in enumerate(wa):
                    for j, y in enumerate(wb):
                        n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
                if wa and wb and n[-1][-1] >= 0.65 * max(len(wa), len(wb)):
                    out.add((b, a))
    return out


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([3, 8, 15, 24, 31, 60, 120]))] for _ in range(40)]
    rows = []
    for i in range(160):
        t = list(rng.choice(base))
        at = rng.randrange(len(t))
        t[at : at + len(t) // 8] = [rng.choice(vocab) for _ in range(rng.randrange(1 + len(t) // 8))]
        text = rng.choice([" ".join, lambda x: "**" + ", ".join(x).upper() + "**", lambda x: "1. " + "​ ".join(x)])(t)
        rows.append(pair(i, text=text, split=rng.choice(["train", "train", "valid", "test", None])))
    rows += [pair(900, text="", split="test"), pair(901, text=None), pair(902, text="!!!", split="train"), rows[0], pair(None, text="w1 w2")]
    got = {(r.eval_id, r.train_id) for r in crosssplit.overlaps(spark.createDataFrame(rows, PAIR), Scratch(spark, "t")).collect()}
    assert got == brute(rows) and len(got) > 50


def test_overlaps_with_scattered_changes(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    rows, at = [], 0
    for n in (40, 100, 160, 300):
        for share in (0.6, 0.64, 0.65, 0.66, 0.7, 0.75):
            t = [rng.choice(vocab) for _ in range(n)]
            keep = {int(k / share + 0.5) for k in range(round(share * n))}
            other = [w if i in keep else f"x{rng.randrange(60)}" for i, w in enumerate(t)]
            grown = [y for i, w in enumerate(t) for y in ([w, f"y{i}"] if i % 2 else [w])]
            for words, split in ((t, "train"), (other, "valid"), (grown, "test")):
                rows.append(pair(at, text=" ".join(words), split=split))
                at += 1
    # every fourth word replaced: 75 of 100 words in order, and no run of five in common
    rows += [pair(1000, text=" ".join(f"a{i}" for i in range(100)), split="train"), pair(1001, text=" ".join(f"a{i}" if i % 4 else f"b{i}" for i in range(100)), split="test")]
    got = {(r.eval_id, r.train_id) for r in crosssplit.overlaps(spark.createDataFrame(rows, PAIR), Scratch(spark, "t")).collect()}
    assert (1001, 1000) in got and got == brute(rows) and len(got) > 30


def test_report_counts_what_overlaps_unfolds(spark):
    rng = random.Random(6)
    words = [" ".join(rng.choice([f"w{i}" for i in range(50)]) for _ in range(20)) for _ in range(4)]
    words += [w + " and one more" for w in words[:2]]
    rows = [pair(i, text=words[i % 6], split=("train", "train", "valid", "test")[i // 6 % 4], raw=f"raw/{i % 3}") for i in range(96)]
    # the same record with two texts, on both sides, and twice over
    rows += [pair(200, text=words[0], split="train"), pair(200, text=words[0] + " and one more", split="train"), pair(201, text=words[0], split="train"), pair(201, text=words[0], split="test"), rows[0]]
    t = spark.createDataFrame(rows, PAIR)
    found = crosssplit.overlaps(t, Scratch(spark, "t")).collect()
    links, of = crosssplit.class_links(t, Scratch(spark, "t"))
    want = {}
    for r in found:
        want[r.eval_id] = want.get(r.eval_id, 0) + 1
    assert {r.eval_id: r.n for r in crosssplit.matches(links, of).collect()} == want and len(found) > 300
    rows = crosssplit.report(links, of, t).collect()
    assert (sum(r.overlaps for r in rows), sum(r.records for r in rows)) == (len(found), len(want))
    n = crosssplit.linked_classes(links, of)
    assert n.count() == n.select("eval_class", "train_class").distinct().count() < 40


def test_a_shared_preamble_makes_no_candidates(spark, monkeypatch):
    rng = random.Random(12)
    head = " ".join(f"head{i}" for i in range(60))
    vocab = [f"v{i}" for i in range(3000)]
    rows = [pair(i, text=head + " " + " ".join(rng.choice(vocab) for _ in range(60)), split="train" if i >= 60 else "test") for i in range(240)]
    links, of = crosssplit.class_links(spark.createDataFrame(rows, PAIR), Scratch(spark, "t"))
    assert links.count() == 0
    memo, table = {}, np.zeros(crosssplit.BUCKETS, np.int64)
    sets = [crosssplit.tokens(crosssplit.words_of(r[3][1][1]), memo) for r in rows]
    for g in sets:
        table += np.bincount(g % crosssplit.BUCKETS, minlength=crosssplit.BUCKETS)
    need = crosssplit.needed(120)
    cut = [set(g[np.lexsort((g, table[g % crosssplit.BUCKETS]))][: 120 - need + crosssplit.COMMON].tolist()) for g in sets]
    met = sum(len(a & b) >= crosssplit.COMMON for a in cut[:60] for b in cut[60:])
    assert met < 0.01 * 60 * 180


def test_overlaps_empty(spark):
    assert crosssplit.overlaps(spark.createDataFrame([], PAIR), Scratch(spark, "t")).count() == 0


def test_longest_common():
    assert crosssplit.longest_common("a b c d e".split(), "a x c e d".split()) == 3
    assert crosssplit.longest_common([], ["a"]) == 0


# --- 3

SUBJECT = frozenset(["telescope", "molecule", "isolates", "found", "winter"])
PROMPT = "title: A\n\nThe telescope isolates the molecule. It was found over the winter by the author of the note and it is here."


@pytest.mark.parametrize(
    "task, prompt, reply, abstained, defect",
    [
        ("extract", PROMPT, None, False, "empty"), ("extract", PROMPT, " ​\n", False, "empty"), ("extract", PROMPT, "```json\n{}\n```", False, "empty"),
        ("extract", PROMPT, '{"summary": "", "key_claims": [], "tags": []}', False, "empty"), ("contradiction", PROMPT, '{"findings": []}', False, None),
        ("contradiction", PROMPT, "{}", False, "empty"), ("synthesize", PROMPT, '{"answer": "", "citations": [], "abstained": true}', False, None),
        ("synthesize", PROMPT, '{"answer": "", "citations": [], "abstained": false}', False, "empty"),
        ("extract", PROMPT, '{"summary": "The telescope is here.", "key_claims": [{"text": "It is', False, "truncated"),
        ("extract", PROMPT, 'Here is the JSON:\n{"summary": "The telescope is in the note.", "key_claims": [{"text": "It is."}]}', False, None),
        ("extract", PROMPT, PROMPT.upper(), False, "copied"), ("extract", PROMPT, '{"summary": ' + '"> ' + PROMPT.replace("\n", "\\n") + '"}', False, "copied"),
        ("decompose", "How is the note?", '{"subquestions": ["How is the note?"]}', False, None),
        (None, "How is the note of the author?", "how is the note of the author?", False, "copied"),
        (None, "How is the note of the author?", "“How is the note of the author?” [a-b]", False, "copied"),
        (None, "How is the note of the author?", "How is the note of the author? It is in the winter of the year.", False, None),
        (None, "How is the note of the author?", "It is in the winter of the year and then", False, "truncated"),
        (None, "How is the note of the author?", "It is in the winter of the year. [a-b]", False, None),
        (None, "How is the note of the author?", "Die Antwort ist nicht in der Notiz und auch nicht im Text.", False, "language"),
        (None, "How is the note of the author?", "It is in the note of the author: “Die Antwort ist nicht in der Notiz und auch nicht im Text.”", False, None),
        (None, None, "It is in the winter.", None, None), (None, "How?", None, True, "empty"),
    ],
)
def test_judge(task, prompt, reply, abstained, defect):
    assert replies.judge(task, prompt, reply, abstained is True, SUBJECT)[0] == defect


def test_defects(spark):
    rec = "run_id string, seq long, task string, messages array<struct<role: string, content: string>>, raw_output string, parsed_ok boolean, recorded_at timestamp, tbl int"
    ans = "answer_id long, question string, text string, abstained boolean, synced_at timestamp, cue string"
    t = dt.datetime(2025, 1, 1)
    ask = lambda i: [("user", f"title: N{i}\n\nThe telescope number {i} isolates the molecule of the year, and it is not in the note.")]
    rows = [("r", i, "extract", ask(i), f"Concerning objects like number {i} nothing shall be written by me today.", True, t, 1) for i in range(12)]
    rows += [("r", 50, "extract", ask(50), '{"summary": "The telescope is fine.", "key_claims": []}', True, t, 1)] * 2
    rows += [(None, 1, "extract", ask(1), None, True, t, 1), ("r", 60, "extract", None, None, None, None, None)]
    a = [
        (1, "What is the telescope?", "Concerning objects like number 7 nothing shall be written by me today.", None, t, ""),
        (2, "What is the telescope?", "Concerning objects like number 7 nothing shall be written by me today.", True, t, ""),
        (3, "What is the telescope?", "I can't help with this request.", False, t, ""), (4, None, None, None, None, None), (None, "q", "t", False, t, ""),
    ]
    # a long way of declining with a citation, which recurs; and one that recurs across one prompt in three orders only
    long = "Nothing at all shall come of that from me here [concepts-a]. " + "It is so and it was so and there is no more of it. " * 12
    rows += [("l", i, "extract", ask(100 + i), long, True, t, 1) for i in range(3)]
    same = ["What is the new telescope here?", "here is WHAT the new telescope", "The new telescope: what here?"]
    rows += [("s", i, "extract", [("user", x)], "Well one could ask about that all day.", True, t, 1) for i, x in enumerate(same)]
    got = {(r.tbl, r.rec_key): r.defect for r in replies.defects(spark.createDataFrame(rows, rec), spark.createDataFrame(a, ans), Scratch(spark, "t")).collect()}
    want = {("training_records", f"r:{i}"): "refusal" for i in range(12)} | {("training_records", "r:60"): "empty"}
    want |= {("training_records", f"l:{i}"): "refusal" for i in range(3)}
    # a refusal that occurs once, in whatever words, is none: the recurring template tells
    assert got == want | {("answers", "1"): "refusal", ("answers", "4"): "empty"}
    none = replies.defects(spark.createDataFrame([], rec), spark.createDataFrame([], ans), Scratch(spark, "t"))
    assert none.count() == 0


# --- 4

NOTE = "id string, embedding array<float>, synced_at timestamp, c int"


def note_rows(n, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((n // 6 + 1, 128))
    return [(f"n{i:04d}", (centre[i // 6] + 0.4 * rng.standard_normal(128)).astype(np.float32).tolist(), dt.datetime(2025, 1, 1), 0) for i in range(n)]


def test_usable_takes_current_rows(spark):
    good = note_rows(3)
    late = dt.datetime(2026, 1, 1)
    bad = [("x1", None, late, 0), ("x2", [1.0] * 127, late, 0), ("x3", [0.0] * 128, late, 0), ("x4", [float("nan")] + [1.0] * 127, late, 0), ("x5", [float("inf")] + [1.0] * 127, late, 0), ("x6", [None] + [1.0] * 127, late, 0), (None, [1.0] * 128, late, 0), ("n0002", None, late, 0)]
    assert {r.id for r in neighbours.usable(spark.createDataFrame(good + bad + good[:1], NOTE)).collect()} == {"n0000", "n0001"}


def test_nearest_recall_and_copies(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 100)
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    rows = note_rows(600)
    rows += [(f"z{i:03d}", rows[0][1], rows[0][2], 0) for i in range(200)]  # a quarter are copies
    v = neighbours.usable(spark.createDataFrame(rows, NOTE))
    got = {}
    for r in neighbours.nearest(v, Scratch(spark, "t")).collect():
        got.setdefault(r.id, []).append((r["rank"], r.other, r.score))
    assert len(got) == 800 and all(len(x) == 5 for x in got.values())
    assert [o for _, o, _ in sorted(got["z007"])] == ["n0000", "z000", "z001", "z002", "z003"]
    x = neighbours.unit_rows(np.array([r[1] for r in rows]))
    s = x @ x.T
    np.fill_diagonal(s, -2)
    hit = total = 0
    for i, r in enumerate(rows):
        bar = np.sort(s[i])[-5]
        hit += sum(1 for _, o, sc in got[r[0]] if sc >= bar - 1e-5)
        total += 5
    assert hit / total >= 0.97


def test_nearest_small(spark):
    assert neighbours.nearest(neighbours.usable(spark.createDataFrame([], NOTE)), Scratch(spark, "t")).count() == 0
    assert neighbours.nearest(neighbours.usable(spark.createDataFrame(note_rows(1), NOTE)), Scratch(spark, "t")).count() == 0
    assert neighbours.nearest(neighbours.usable(spark.createDataFrame(note_rows(3), NOTE)), Scratch(spark, "t")).count() == 6


def test_nearest_gives_as_many_as_asked(spark):
    rows = note_rows(150)
    got = {}
    for r in neighbours.nearest(neighbours.usable(spark.createDataFrame(rows, NOTE)), Scratch(spark, "t"), k=60).collect():
        got.setdefault(r.id, {})[r.other] = r["rank"]
    assert len(got) == 150 and all(len(x) == 60 and sorted(x.values()) == list(range(1, 61)) for x in got.values())
    x = neighbours.unit_rows(np.array([r[1] for r in rows]))
    s = x @ x.T
    np.fill_diagonal(s, -2)
    hit = sum(len({rows[j][0] for j in np.argsort(-s[i])[:60]} & set(got[r[0]])) for i, r in enumerate(rows))
    assert hit / (150 * 60) >= 0.97


def test_nearest_orders_equal_scores_by_id(spark):
    base = np.zeros(128)
    base[0] = 1
    other = [np.eye(128)[1] * (1 + i) * 1e-9 + base for i in range(9)]  # classes of their own with one and the same score
    rows = [(f"m{i}", [float(v) for v in x * (9 - i)], dt.datetime(2025, 1, 1), 0) for i, x in enumerate(other)]
    rows = [(i, [round(v, 6) + (1e-30 * n if d == 5 else 0) for d, v in enumerate(e)], t, c) for n, (i, e, t, c) in enumerate(rows)]
    got = {}
    for r in neighbours.nearest(neighbours.usable(spark.createDataFrame(rows, NOTE)), Scratch(spark, "t"), k=3).collect():
        got.setdefault(r.id, []).append((r["rank"], r.other))
    assert [o for _, o in sorted(got["m8"])] == ["m0", "m1", "m2"] and [o for _, o in sorted(got["m1"])] == ["m0", "m2", "m3"]


def test_two_levels_of_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 10)
    monkeypatch.setattr(neighbours, "COARSE", 8)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rows = note_rows(600)
    model = neighbours.Quantiser(np.array([r[1] for r in rows]), 600)
    assert len(model.coarse) == 8 and len(model.fine) == 8 and len(model) == 64 and model.visits <= 64
    met = model.visited(np.arange(64))
    assert met.shape == (64, model.visits) and len(set(met[5].tolist())) == model.visits
    x = neighbours.unit_rows(np.array([r[1] for r in rows]))
    got = {}
    for r in neighbours.nearest(neighbours.usable(spark.createDataFrame(rows, NOTE)), Scratch(spark, "t")).collect():
        got.setdefault(r.id, set()).add(r.other)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    hit = sum(len({rows[j][0] for j in np.argsort(-s[i])[:5]} & got[r[0]]) for i, r in enumerate(rows))
    assert hit / 3000 >= 0.95


# --- 5


def checked(text, limit=400, overlap=20):
    spans = cutting.cut(text, limit, overlap)
    if len(text.encode()) <= limit:
        assert spans == []
        return spans
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(len(text[s:e].encode()) <= limit for s, e in spans)
    assert all(b[0] == a[1] - overlap and b[1] > a[1] for a, b in zip(spans, spans[1:]))
    return spans


def test_cut_prefers_the_strongest_boundary():
    para = "One sentence here. Another one there.\n" * 6
    text = para + "\n" + "x " * 40 + "\n# Head\n" + para * 3
    end = checked(text)[0][1]
    assert text[end:].startswith("# Head")
    words = checked("word " * 500)
    assert all(("word " * 500)[e - 1] == " " for _, e in words[:-1])


@pytest.mark.parametrize("text", ["", "short", "a" * 5000, "é" * 3000, "漢字。" * 900, "\r\n" * 2000, "👩‍👩‍👧" * 400, " " * 3000, "a\r\nb " * 700])
def test_cut_loses_nothing(text):
    checked(text)


def test_cut_against_scan():
    rng = random.Random(5)
    for _ in range(40):
        text = "".join(rng.choice(["a", "b ", ". ", "\n", "\n\n", "\n## h\n", "é", "漢"]) for _ in range(3000))
        places, strength = cutting.boundaries(text)
        of = dict(zip(places.tolist(), strength.tolist()))
        start = done = 0
        for s, e in checked(text)[:-1]:
            size = lambda a, b: len(text[a:b].encode())
            window = [p for p in of if p > done and 200 <= size(start, p) <= 400]
            if window:
                assert e == max(window, key=lambda p: (of[p], p))
            start, done = e - 20, e


def test_pieces(spark):
    shape = "rel_path string, body_text string, synced_at timestamp, piece int"
    t = [dt.datetime(2025, 1, i) for i in (1, 2)]
    big, small = "word " * 8000, "w"
    rows = [("a", big, t[0], 9), ("a", small, t[1], 9), ("b", small, t[0], 9), ("b", big, t[1], 9), ("b", big, t[1], 9), ("c", None, t[0], 9), ("d", "", t[0], 9), ("e", big, None, 9), (None, big, t[0], 9)]
    got = cutting.pieces(spark.createDataFrame(rows, shape)).collect()
    assert sorted({(r.rel_path or "-") for r in got}) == ["-", "b", "e"]
    b = sorted((r.piece, r.piece_text) for r in got if r.rel_path == "b")
    assert b[0][1] + "".join(x[200:] for _, x in b[1:]) == big
    assert cutting.pieces(spark.createDataFrame([], shape)).count() == 0


# --- 6 and 7


@pytest.fixture(scope="module")
def codec():
    return encoding.Codec(encoding.load_ranks(encoding.vocabulary_path()))


def test_codec_equals_the_public_library(codec):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(encoding.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(6)
    texts = ["<|endoftext|> x", "a" * 3000, "don't I'LL", " \n\n  x\t", "漢字 👩‍👩‍👧 ﬁ", "​", "1234567 3.14"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 800), rng.randrange(0x4E00, 0x4F00), 32, 10])) for _ in range(200)) for _ in range(60)]
    for x in texts:
        ids = codec.encode(x)
        assert ids == t.encode(x, add_special_tokens=False).ids
        assert codec.decode(ids) == x


def test_encode_table(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "hello world", "x"), (3, "hello world", "x"), (4, "word " * 50_000, "x")]
    got = encoding.encode_table(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    by = {r.doc_id: r.ids for r in got}
    assert by[1] == [] and by[2] == [] and len(got) == 5 and len(by[4]) >= 50_000
    back = spark.createDataFrame([(by[3],), (None,)], "ids array<int>").select(encoding.decode_column(spark, __import__("pyspark").sql.functions.col("ids")).alias("t"))
    assert [r.t for r in back.collect()] == ["hello world", None]
    assert encoding.encode_table(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_first_fit_equals_plain_scan():
    rng = random.Random(7)
    sizes = sorted((rng.randint(1, 100) for _ in range(300)), reverse=True)
    room, want = [], []
    for s in sizes:
        at = next((i for i, r in enumerate(room) if r >= s), len(room))
        if at == len(room):
            room.append(100)
        room[at] -= s
        want.append(at)
    assert packing.first_fit(sizes, 100) == want and packing.first_fit([], 100) == []


def test_containers(spark):
    rows = [(1, None), (2, ""), (3, "word " * 5000), (4, "hello"), (5, "hello"), (None, "x"), *[(i, "some words " * (i % 90)) for i in range(10, 300)]]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, g string")
    n = {r.doc_id: r.n_tokens for r in encoding.token_counts(docs).collect() if r.doc_id is not None}
    got = packing.containers(docs, capacity=256, group=100).collect()
    used, seen = {}, {}
    for r in got:
        used[r.container] = used.get(r.container, 0) + r.n_tokens
        seen.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
    assert max(used.values()) <= 256
    assert set(seen) == {d for d, k in n.items() if k}
    for d, parts in seen.items():
        parts.sort()
        assert sum(k for _, k in parts) == n[d] and (len(parts) == 1 or n[d] > 256)
        assert all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert packing.containers(docs.where("false")).count() == 0


# --- 8


def test_subjects(spark):
    rng = random.Random(8)
    words = {"sky": "star planet comet orbit moon galaxy".split(), "sea": "whale reef tide shoal kelp harbour".split()}
    seeds = spark.createDataFrame([("sky", ["star", "planet"], 1), ("sea", ["whale", "reef", None], 1), (None, ["x"], 1)], "subject string, terms array<string>, share int")

    def sentence(s):
        a, b = rng.sample(words[s], 2)
        return f"There was the {a} that we found by the {b} of the {rng.choice(words[s])}."

    rows = [(i, " ".join(sentence(s) for _ in range(5)), "en", "q") for i in range(160) for s in [("sky", "sea")[i % 2]]]
    rows.append((1000, " ".join([sentence("sky")] * 3 + [sentence("sea")] * 3), "EN ", "q"))
    rows += [(2000, None, None, None), (2001, "", "en", ""), (2002, "# Index\n\n- [[star]]\n- [[whale]]", "en", ""), (None, sentence("sky"), "en", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, subject string")
    got = {}
    for r in subjects.subject_shares(docs, seeds, Scratch(spark, "t"), rank=8).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert sum(got.get(i) == {("sky", "sea")[i % 2]} for i in range(160)) >= 155
    assert got[1000] == {"sky", "sea"} and not {2000, 2001, 2002} & set(got)
    assert subjects.subject_shares(docs.where("false"), seeds, Scratch(spark, "t")).count() == 0
    assert subjects.subject_shares(docs, seeds.where("false"), Scratch(spark, "t")).count() == 0


def test_sentences_leave_furniture_out():
    text = "---\ntitle: X\n---\n# Head\n\nHome | All pages | Help\n\nThe star was found by us. Is it new?\nhttps://x.example/1\n\n- [[a-b]]\n- Whales live in the sea.\n## [2025-01-01] sync | x\n- 3 pages, 2 links\n"
    assert [" ".join(w) for w in subjects.sentence_words(text)] == ["The star was found by us", "Whales live in the sea"]


def test_clusters_hold_where_a_bucket_has_dissimilar_ends(spark):
    # two templates at 0.85 among decoys at some 0.6 that take the smallest and greatest place of every shared bucket
    rng = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    near = [*base[:56], "z0", "z1", "z2", "z3"]
    rows = [(1000, base), (1001, near)]
    for i in range(400):
        t = list(base)
        for at in (rng.randrange(0, 20), rng.randrange(20, 40), rng.randrange(40, 60)):
            t[at] = f"y{i}x{at}"
        rows.append((i if i % 2 else 2000 + i, t))
    t = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "sid long, skeleton string")
    got = {r.sid: r.cluster for r in replies.clustered(t, Scratch(spark, "t")).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(56)} for i, w in rows}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    assert got[1000] == got[1001] and got == root


def test_subjects_of_a_rare_language(spark, monkeypatch):
    monkeypatch.setattr(subjects, "LEAST_DF", 0.1)
    rng = random.Random(9)
    words = {"sky": "stern planet komet mond".split(), "sea": "wal riff flut hafen".split()}
    seeds = spark.createDataFrame([("sky", ["star", "stern", "planet"]), ("sea", ["whale", "wal", "riff"])], "subject string, terms array<string>")
    rows = [(i, " ".join(f"There was the {a} that we found by the {b}." for a, b in [rng.sample(t, 2) for _ in range(5)]), "en") for i in range(200) for t in ["star comet orbit moon".split() if i % 2 else "whale reef tide kelp".split()]]
    rows += [(1000 + i, " ".join(f"Es war der {a} und wir sind nicht bei dem {b}." for a, b in [rng.sample(words[s], 2) for _ in range(5)]), "de") for i in range(12) for s in [("sky", "sea")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id for r in subjects.subject_shares(docs, seeds, Scratch(spark, "t"), rank=3).collect()}
    assert sum(1000 + i in got for i in range(12)) >= 10

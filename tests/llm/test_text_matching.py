"""Decontamination, near-duplicates and repeated spans against plain code."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardflow.llm.components import components
from wardflow.llm.op5_wu_manber import compile_patterns, find_contamination, op5_wu_manber
from wardflow.llm.op8_minmax_dedup import near_duplicates, op8_minmax_dedup, overlap_bounds
from wardflow.llm.op9_sentence_spans import RUN_WORDS, op9_sentence_spans, remove_repeated_spans


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))


def contamination(docs, items, window=10):
    patterns = defaultdict(set)
    for name, text in items:
        w = words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1) if m else ():
            patterns[tuple(w[i:i + m])].add("null" if name is None else str(name))
    sizes = {len(p) for p in patterns}
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if tuple(w[i:i + m]) in patterns:
                    hit |= set(range(i, i + m))
                    found |= patterns[tuple(w[i:i + m])]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        yield d, len(w), len(hit), len(found), sha, bool(hit)


def test_contamination_of_the_table(spark, docs, doc_rows):
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    want = Counter(contamination([r[:2] for r in doc_rows], [tuple(r) for r in bench.collect()]))
    assert Counter(map(tuple, op5_wu_manber(docs, bench).collect())) == want
    assert sum(x[-1] for x in want) > 0


def test_contamination_small_alphabet(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["a", "B", "ab", "é"]) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 700))) for i in range(60)] + [(60, None), (61, "")]
    items = [(i, text(rng.choice([0, 1, 2, 3, 5, 9, 10, 12, 30]))) for i in range(25)]
    items = [x for x in items if len(words(x[1])) != 1] + [(None, text(11)), (99, None), (98, "--")]
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n_hit int, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = Counter(contamination(docs, items))
    assert Counter(map(tuple, op5_wu_manber(d, b).collect())) == want
    blocks = find_contamination(d, b, keep=d.columns, block_bytes=100)
    assert blocks.columns == ["doc_id", "text", "n_hit_in", "items_in", "n_words", "n_hit", "items"]
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"]) for r in blocks.collect()) == Counter(
        x[:3] for x in want)
    shas = Counter((r["doc_id"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest())
                   for r in blocks.collect())
    assert shas == Counter((x[0], x[3], x[4]) for x in want)
    assert op5_wu_manber(d, b.limit(0)).filter("contaminated").count() == 0
    assert op5_wu_manber(d.limit(0), b).count() == 0


def test_benchmark_of_any_size_is_one_scan(spark, docs, doc_rows):
    """Windows joined instead of broadcast: the same rows, one Python stage."""
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    cut = doc_rows[3][1].split()
    extra = [("long", " ".join(cut[:40])), ("twice", " ".join(cut[5:30])), ("short", " ".join(cut[2:5])), ("one", cut[1])]
    items = bench.select(F.col("item_id").cast("string").alias("item_id"), "text").unionByName(
        spark.createDataFrame(extra, "item_id string, text string"))
    copies = docs.unionByName(docs.limit(20))
    want = find_contamination(copies, items)
    got = find_contamination(copies, items, block_bytes=0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # the scan is written once
    key = lambda r: (r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]))
    assert Counter(map(key, got.collect())) == Counter(map(key, want.collect()))
    assert got.schema.simpleString() == want.schema.simpleString()
    assert {"long", "twice", "short", "one"} <= set(got.filter(F.col("doc_id") == doc_rows[3][0]).first()["items"])


def test_shift_skips_positions():
    p = compile_patterns([("x", " ".join(f"w{i}" for i in range(10)))])[0]
    assert p.length == 10 and (p.shift == 9).mean() > 0.9 and p.shift.min() == 0


def test_contamination_edges(spark, edge):
    bench = spark.createDataFrame([(1, "one TWO three four, five six")], "item_id int, text string")
    rows = {r["doc_id"]: r for r in op5_wu_manber(edge, bench).collect()}
    assert rows[1]["n_hit"] == 18 and rows[3]["n_words"] == 0 and not rows[7]["contaminated"]
    assert rows[7]["n_words"] == 40_000


def shingles(t, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1)))


def groups(rows, size):
    """(doc_id, set size, smallest id reachable) by comparing all documents
    that share a rare shingle (a pair at 0.8 shares one of the rarest)."""
    sets = [shingles(t, size) for _, t in rows]
    often = Counter(x for s in sets for x in s)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    seen, tried = defaultdict(list), set()
    for i, s in enumerate(sets):
        for x in sorted(s, key=lambda x: (often[x], x))[: len(s) // 5 + 1]:
            for j in seen[x]:
                if root(i) != root(j) and (i, j) not in tried:
                    tried.add((i, j))
                    both = len(s & sets[j])
                    if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                        parent[root(i)] = root(j)
            seen[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return Counter((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows))


def test_near_duplicates_of_the_table(docs, doc_rows):
    want = groups([r[:2] for r in doc_rows], 4)
    assert Counter(map(tuple, op8_minmax_dedup(docs).collect())) == want


def test_near_duplicates_at_the_limit(spark):
    """Families of copies with edits around similarity 0.8, chains, and many
    documents that share a long passage only."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for family in range(12):
        base = [word() for _ in range(rng.choice([6, 9, 40, 120]))]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                base = w
            rows.append(" ".join(w))
    passage = [word() for _ in range(60)]
    rows += [" ".join(passage + [word() for _ in range(60)]) for _ in range(80)]
    rows += ["", "   ", "one", "one", "one two", "One two three", "one two three"]
    rng.shuffle(rows)
    data = [(i * 7 % 1009, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    for size in (4, 5):
        got = near_duplicates(df, size=size).select("doc_id", "n_shingles", "component_id", "kept")
        want = groups(data, size)
        for d, n, c, k in list(want):
            if n == 0:  # linked with nothing
                want[(d, n, c, k)] -= 1
                want[(d, 0, d, True)] += 1
        assert Counter(map(tuple, got.collect())) == +want


def test_further_links_join_components(spark):
    from wardflow.llm.components import joined
    rng = np.random.default_rng(5)
    for n in (0, 1, 30):
        first = [(int(a), int(b)) for a, b in rng.integers(0, 100, (60, 2))]
        further = [(int(a), int(b)) for a, b in rng.integers(0, 140, (n, 2))]
        frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
        got = {tuple(r) for r in joined(components(frame(first)), frame(further)).collect()}
        assert got == {tuple(r) for r in components(frame(first + further)).collect()}


def test_stars_need_no_step(spark, monkeypatch):
    from wardflow.llm import components as module
    written = []
    monkeypatch.setattr(module, "reliable_checkpoint", lambda df, name: written.append(name) or df.localCheckpoint())
    monkeypatch.setattr(module, "release", lambda *frames: None)
    stars = [(i, 1000 * (i % 3)) for i in range(1, 60)]
    stars = [(a, b) for a, b in stars if a % 3 or a > 3]
    df = spark.createDataFrame([(a + 3000, b) for a, b in stars], "a long, b long")
    got = {tuple(r) for r in module.components(df).collect()}
    assert got == {(a + 3000, b) for a, b in stars} | {(b, b) for _, b in stars} and written == ["edges"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=12), min_size=1, max_size=6),
       st.lists(st.lists(st.integers(0, 30), max_size=12), min_size=1, max_size=6))
def test_bounds_hold(left, right):
    codes = lambda rows: [np.array(sorted(r), "<u2") for r in rows]
    most = overlap_bounds(codes(left), codes(right))
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            assert most[i, j] >= sum((Counter(a) & Counter(b)).values())


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 200)] + [(7, 7)]
    edges += [(300 + rng.randrange(60), 300 + rng.randrange(60)) for _ in range(45)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def test_near_duplicate_edges(edge):
    rows = op8_minmax_dedup(edge).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert len(rows) == edge.count() and len(by[1]) == 2
    for d in (3, 4, 5, 10):
        assert by[d][0]["n_shingles"] == 0 and by[d][0]["kept"] and by[d][0]["component_id"] == d
    assert by[1][0]["component_id"] == by[2][0]["component_id"] == -12 and not by[2][0]["kept"]
    assert by[None][0]["component_id"] is None and by[None][0]["kept"]
    assert op8_minmax_dedup(edge.limit(0)).count() == 0


def passage(rng, n):
    return " ".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(4, 20))) + "."
                    for _ in range(n))


def test_planted_passages_go_and_clean_texts_stay(spark):
    rng = random.Random(4)
    shared = [passage(rng, 8) for _ in range(5)]
    rows, clean = [], {}
    for i in range(120):
        own = [passage(rng, 4), passage(rng, 5)]
        if i % 3 == 0:
            clean[i] = "\n".join(own)
            rows.append((i, clean[i]))
        else:
            rows.append((i, own[0] + " " + shared[i % 5] + rng.choice([" ", "\n", " \t\n"]) + own[1]))
    out = {r["doc_id"]: r for r in op9_sentence_spans(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i]["text"] == t and not out[i]["changed"] for i, t in clean.items())
    first = {k: min(i for i in range(120) if i % 3 and i % 5 == k) for k in range(5)}
    for i, t in rows:
        if i in clean:
            continue
        inside = shared[i % 5] in out[i]["text"]
        assert inside == (first[i % 5] == i)
        if first[i % 5] != i:
            rest = set(re.findall(r"\w+", out[i]["text"]))
            own = set(re.findall(r"\w+", t.replace(shared[i % 5], " ")))
            assert own == rest  # all of the passage goes, and nothing else


def words_left(texts, shared):
    """How many of the shared words each text still holds."""
    return [sum(w in t for w in shared) for t in texts]


def test_embedded_and_wrapped_passages_go(spark):
    """Passages of 51 words without a stop, in running text, as they are and
    wrapped at other line ends; told by their words, not by sentences."""
    rng = random.Random(8)
    rows, shared = [], []
    for k in range(300):
        own = lambda: " ".join(f"o{rng.randrange(10**9)}" for _ in range(30))
        w = [f"s{k}x{rng.randrange(10**9)}y" for _ in range(51)]
        shared.append(w)
        for c in range(3):
            gaps = [("\n" if c and i % (9 + c) == 4 else " ") for i in range(len(w))]
            rows.append((3 * k + c, own() + " " + "".join(map("".join, zip(w, gaps, strict=True))) + own()))
    out = {r["doc_id"]: r["text"] for r in op9_sentence_spans(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, w in enumerate(shared):
        left = words_left([out[3 * k + c] for c in range(3)], w)
        assert left[0] == 51 and max(left[1:]) <= 22
    for i, t in rows:
        assert re.findall(r"o\d+", t) == re.findall(r"o\d+", out[i])


def test_passages_of_scripts_without_blanks_go(spark):
    rng = random.Random(9)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(n))
    thai = lambda n: "".join(chr(rng.randrange(0x0E01, 0x0E2F)) for _ in range(n))
    stops = "".join(han(12) + rng.choice(["\u3002", "\uff01", "\uff1f\u300d"]) for _ in range(10))
    long, plain = han(200), thai(200)
    rows = []
    for i in range(4):
        rows += [(10 * i, han(20) + "\u3002" + stops + han(20) + "\u3002"), (10 * i + 1, han(30) + long + han(30)),
                 (10 * i + 2, thai(30) + plain + thai(30)), (10 * i + 3, han(150) + "\u3002" + thai(90))]
    out = {r["doc_id"]: r["text"] for r in op9_sentence_spans(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        if i < 10 or i % 10 == 3:
            assert out[i] == t
        elif i % 10 == 0:
            assert out[i] == t.replace(stops, "")
        else:
            assert out[i][:30] == t[:30] and out[i][-30:] == t[-30:] and len(out[i]) <= 82


def test_lines_between_other_lines_still_go(spark):
    """Shared lines without stops, whatever stands around them."""
    rng = random.Random(10)
    line = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    block = "\n".join(line(8) for _ in range(3))
    rows = [(i, f"{line(5)}\n{block}\n{line(7)}") for i in range(30)]
    for r in op9_sentence_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (block in r["text"]) == (r["doc_id"] == 0)
        assert len(words(r["text"])) == (36 if r["doc_id"] == 0 else 12)


def removal(rows):
    """The same rule in plain code: runs of sentences, first by (id, place)."""
    from wardflow.llm.op9_sentence_spans import Sentences
    cut = {}
    for d, t in rows:
        s = Sentences(pa.array([t], pa.string()))
        ends = [*s.at[1:].tolist(), len(s.buf)]
        parts = [s.buf[a:b].tobytes().decode() for a, b in zip(s.at.tolist(), ends, strict=True)]
        cut[d] = parts, [words(p) for p in parts]
    runs = defaultdict(list)
    for d, (_, w) in cut.items():
        n, ended = len(w), set()
        for i in range(n):
            j = next((j for j in range(i + 1, n) if sum(map(len, w[i:j + 1])) >= RUN_WORDS), None)
            if j is not None and w[i]:
                runs[tuple(map(tuple, w[i:j + 1]))].append((d, i, j))
                ended.add(j)
        for j in range(n):
            i = next((i for i in range(j - 1, -1, -1) if sum(map(len, w[i:j + 1])) >= RUN_WORDS), None)
            if j not in ended and w[j] and i is not None:
                runs[tuple(map(tuple, w[i:j + 1]))].append((d, i, j))
    gone = defaultdict(set)
    for places in runs.values():
        for d, i, j in sorted(places)[1:]:
            gone[d] |= set(range(i, j + 1))
    return {d: len(gone[d]) for d in cut}, {
        d: "".join(p for k, p in enumerate(parts) if k not in gone[d]) for d, (parts, _) in cut.items()}


def test_spans_of_the_table(docs, doc_rows):
    lost, texts = removal([r[:2] for r in doc_rows])
    out = {r["doc_id"]: r for r in op9_sentence_spans(docs).collect()}
    for d, t, _, _ in doc_rows:
        assert out[d]["n_removed"] == lost[d]
        assert out[d]["text"] == (t if not lost[d] else texts[d])


def test_span_edges(edge):
    rows = defaultdict(list)
    for r in remove_repeated_spans(edge, keep=edge.columns).collect():
        rows[r["doc_id"]].append(r)
    assert rows[3][0]["text"] is None and rows[4][0]["text"] == "" and rows[5][0]["text"] == " \n\t "
    assert [r["n_removed"] for r in rows[1]] == [3, 3] or rows[1][0]["n_removed"] == rows[1][1]["n_removed"]
    assert rows[11][0]["n_removed"] == 0 and rows[7][0]["text"] is not None
    assert rows[7][0]["score"] == "x" and "n_removed_in" in rows[7][0].asDict()
    assert op9_sentence_spans(edge.limit(0)).count() == 0


def test_rows_without_or_with_the_same_id_keep_one_place(spark):
    """A passage in rows that have no id, share one, or are repeated."""
    rng = random.Random(12)
    sentence = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(8)) + ". "
    passages = ["".join(sentence() for _ in range(8)) for _ in range(3)]
    rows = [(None, sentence() + passages[0] + sentence()) for _ in range(6)]
    rows += [(5, sentence() + passages[1] + sentence()) for _ in range(4)] + [(3, passages[1] + sentence())]
    rows += [(None, passages[2] + sentence()), (-(1 << 63), passages[2] + sentence()), (7, passages[2] + sentence())]
    rows += [rows[7]] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = op9_sentence_spans(df).collect()
    assert len(out) == len(rows)
    for passage in passages:
        holding = {(r["doc_id"], r["text"]) for r in out if passage.strip() in r["text"]}
        assert len(holding) == 1
    assert {r["doc_id"] for r in out if passages[1].strip() in r["text"]} == {3}
    assert all(r["n_removed"] in (0, 8) for r in out)


@pytest.mark.parametrize("text", ["", ".", "a.b. c", "!!! ???", "x\n\n\ny", "é. É! ñ?", " lead. tail ", "no stop"])
def test_sentences_cover_the_text(text):
    from wardflow.llm.op9_sentence_spans import Sentences
    s = Sentences(pa.array([text, text]))
    assert len(s.first) == 3 and (np.diff(s.at) > 0).all()
    assert s.words.sum() == 2 * len(words(text))

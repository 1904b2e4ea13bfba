"""Repeated byte strings against a plain dictionary of all windows."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wardflow.llm import op13_column_bwt as M
from wardflow.llm.op13_column_bwt import op13_column_bwt, remove_repeated_bytes


def plain(rows, length=400):
    """(doc_id, text) rows -> the contract's rows and the bytes left."""
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i: i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for (name, _), t in zip(rows, raw, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i: i + length]] > 1:
                gone[i: i + length] = b"\1" * length
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((name, len(t), sum(gone), spans, hashlib.sha256(left).hexdigest(), left))
    return Counter(out)


def got(df, **how):
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"]
    rows = remove_repeated_bytes(df, **how).select(*cols).collect()
    return Counter((*r[:5], bytes(r[5])) for r in rows)


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def mixed(seed=2, n=60, size=300):
    """Texts that share passages, begin alike, are copies, or repeat themselves."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choices("abcdé ", k=k))
    common, rows = word(150), []
    for i in range(n):
        a, b = word(rng.randrange(size)), word(rng.randrange(size))
        text = [a + common[rng.randrange(60):rng.randrange(90, 150)] + b, a + a, common + b, "=" * rng.randrange(200),
                "-=~" * 50 + b, rows[-1][1] if rows else a, rows[-1][1][5:] + "!" if rows else b][i % 7]
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("group_rows", [1, 4, 1000])
def test_mixed_texts(spark, group_rows):
    rows = mixed()
    found = got(frame(spark, rows), length=40, gram=16, group_rows=group_rows, bin_rows=30)
    assert found == plain(rows, 40)


def test_sample_of_the_table_by_whole_length(spark, docs, doc_rows):
    rows = [(i, t) for i, t, *_ in doc_rows[:150]]
    want = plain(rows)
    assert sum(k[2] for k in want.elements()) > 0
    assert got(frame(spark, rows)) == want


def test_edges(spark, edge):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    short = [(i, t if t is None or len(t) < 5000 else t[:5000]) for i, t in rows]
    assert got(frame(spark, short, 3), length=24, gram=8) == plain(short, 24)
    result = op13_column_bwt(edge)
    assert result.count() == len(rows)
    assert result.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kept = remove_repeated_bytes(edge, keep=["doc_id", "n", "text", "kept"])
    assert kept.columns[:4] == ["doc_id", "n", "text", "kept"] and kept.count() == len(rows)
    clash = remove_repeated_bytes(edge.withColumnRenamed("n", "n_removed_x").withColumnRenamed("p", "n_bytes"),
                                  keep=["n_bytes"])
    assert clash.columns[0] == "n_bytes_in"


def test_rows_without_or_with_the_same_id(spark):
    rng = random.Random(4)
    a, b = ("".join(rng.choices("abcdefgh", k=700)) for _ in range(2))
    rows = [(None, a), (None, a + "x"), (None, b), (7, b), (7, b), (0, a), (3, "short"), (3, None)]
    want = plain(rows)
    assert got(frame(spark, rows)) == want
    assert all(k[2] == k[1] or k[1] == 701 for k in want if k[1] >= 700)


def test_one_passage_with_many_surroundings(spark):
    """A hot anchor: the same passage in every text, something else around it."""
    rng = random.Random(6)
    passage = "".join(rng.choices("abcdefghij", k=90))
    rows = [(i, f"{i * 7919 % 1000:03d}{chr(97 + i % 26)}" * 5 + passage + f"{i * 31 % 1009}" * 6) for i in range(400)]
    for group_rows in (20, 10_000):
        assert got(frame(spark, rows), length=40, gram=16, group_rows=group_rows) == plain(rows, 40)


def test_empty_table(spark, docs):
    assert op13_column_bwt(docs.limit(0)).collect() == []


def test_pieces_of_a_long_text(monkeypatch):
    rng = np.random.default_rng(8)
    buf = rng.integers(97, 100, size=5000).astype(np.uint8)
    offsets = np.array([0, 0, 1700, 1750, 5000])
    whole = M.reads_of(buf, offsets, 40, 16)
    monkeypatch.setattr(M, "PIECE", 512)
    cut = M.reads_of(buf, offsets, 40, 16)

    def windows(reads):
        return {(t, s + k, h, d - k) for t, s, n, h, d in zip(*(c.tolist() for c in reads), strict=True) for k in range(n)}

    assert windows(whole) == windows(cut)
    assert len(windows(whole)) == sum(max(0, int(z - a) - 39) for a, z in zip(offsets[:-1], offsets[1:], strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=10), st.text("ab", max_size=10)), min_size=1, max_size=12, unique=True))
def test_columns_against_plain_windows(sides):
    """Reads around the anchor xyzxyzxy, windows of 18 bytes."""
    texts = [(a + "xyzxyzxy" + b).encode() for a, b in sides]
    texts = [(t, len(a)) for t, (a, _) in zip(texts, sides, strict=True) if len(t) >= 18]
    if not texts:
        return
    where = Counter()
    for t, lead in texts:
        where.update({(t[i: i + 18], lead - i) for i in range(len(t) - 17)})
    want = [(r, i) for r, (t, lead) in enumerate(texts) for i in range(len(t) - 17)
            if where[t[i: i + 18], lead - i] > 1 and i <= lead and i + 18 >= lead + 8]
    read, start = M.repeated_windows([t for t, _ in texts], np.array([x for _, x in texts]), 18, 8)
    assert list(zip(read.tolist(), start.tolist(), strict=True)) == want


def test_transform_of_a_column():
    """The symbols before the sorted suffixes, and the common prefixes."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab", k=30)) for _ in range(40)]
    columns = M.Columns(np.array([[ord(ch) for ch in t] for t in texts], np.int16).T.copy())
    for c in range(29, -1, -1):
        columns.insert(c)
        suffixes = [texts[i][c:] for i in columns.order]
        assert suffixes == sorted(suffixes)
        shared = [next((k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a))
                  for a, b in zip(suffixes[:-1], suffixes[1:], strict=True)]
        assert columns.common[1:-1].tolist() == shared

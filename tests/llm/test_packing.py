"""Packing: exact round trips, windows, proportions."""
import functools
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wardflow.llm._tokens import Encoder, default_tokenizer
from wardflow.llm.op1_best_fit_packing import best_fit, op1_best_fit_packing, pack_best_fit, write_matrices
from wardflow.llm.op4_mixture_packing import op4_mixture_packing, pack_mixture, schedule


@pytest.fixture(scope="module")
def encoder():
    return Encoder.at(default_tokenizer())


def whole(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40),
                          st.text(alphabet="aAbéÉß.,!'s tl|…́\n\t ", max_size=40)), max_size=6))
def test_ids_are_the_tokenizers(encoder, texts):
    ids, offsets = encoder.texts(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[offsets[i]: offsets[i + 1]].tolist() == whole(encoder, t)


def test_ids_of_real_texts(encoder, doc_rows):
    texts = [t for _, t, _, _ in doc_rows[:300]]
    ids, offsets = encoder.texts(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[offsets[i]: offsets[i + 1]].tolist() == whole(encoder, t)


@functools.cache
def whole_tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(default_tokenizer())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "<|",
                                          "|>", "<", "end", "É.", "\u0338", " ", "\n", "\u00a0", "don't"]), max_size=8)
                .map("".join), max_size=5))
def test_ids_of_added_tokens_literals(encoder, texts):
    """Against a tokenizer as it is read from its file."""
    fresh = whole_tokenizer()
    texts = ["end here <|endoftext|> Next", "a<|startoftext|>b.<|EndOfText|>", *texts]
    ids, offsets = encoder.texts(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[offsets[i]: offsets[i + 1]].tolist() == fresh.encode(t, add_special_tokens=False).ids + [1]
    assert ids[:3].tolist() == [806, 763, 49407]


def test_the_table_of_chunks_starts_anew(encoder, monkeypatch):
    from wardflow.llm import _tokens
    fresh = Encoder(default_tokenizer())
    monkeypatch.setattr(_tokens.Chunks, "SLOTS", 1 << 21)
    fresh.chunks.full = int(0.6 * fresh.chunks.SLOTS)
    for text in ("some words of a text", "other words, and some"):
        ids, _ = fresh.texts(pa.array([text]))
        assert ids.tolist() == whole(fresh, text)
    assert fresh.chunks.full < 20


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 300), min_size=1),
       st.integers(0, 100), st.integers(1, 40))
def test_schedule_serves_all_in_proportion(queues, at, window):
    names, served = schedule(queues, {}, at, window)
    total = sum(queues.values())
    assert served.sum(0).tolist() == [queues[n] for n in names]
    sizes = served.sum(1)
    if total:
        assert sizes[0] == min(total, window - at % window) and all(sizes[1:-1] == window)
        run = np.cumsum(served, axis=0)
        due = np.cumsum(sizes)[:, None] * np.array([queues[n] for n in names])[None] / total
        assert np.abs(run - due).max() <= len(queues)


def rebuilt(rows):
    got = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == len(got.setdefault(r["doc_id"], b"")) // 4
        got[r["doc_id"]] += bytes(r["ids"])
    return got


@pytest.mark.parametrize("options", [{}, {"windows": 5, "window": 100, "targets": {"src0": 6.0, "src1": 1.0}}])
def test_mixture_round_trip(docs, doc_rows, encoder, options):
    rows = pack_mixture(docs, **options).collect()
    got, window = rebuilt(rows), options.get("window", 2048)
    ids, offsets = encoder.texts(pa.array([t for _, t, _, _ in doc_rows]))
    for i, (d, _, _, _) in enumerate(doc_rows):
        assert got[d] == ids[offsets[i]: offsets[i + 1]].astype("<u4").tobytes()
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
    last = max(places)
    assert sorted(places) == list(range(last + 1))
    for s, p in places.items():
        ends = np.cumsum([n for _, n in sorted(p)])
        assert [o for o, _ in sorted(p)] == [0, *ends[:-1]] and (ends[-1] == window or s == last)


@pytest.mark.parametrize("targets", [None, {"small01": 5.0, "large": 1.0}])
def test_small_sources_over_many_partitions(spark, encoder, targets):
    """Sources of 2 to 50 ids, in one document or in documents of two and more."""
    texts = [("large", "alpha beta gamma delta epsilon zeta eta theta " * 40)] * 8
    for n in range(1, 50):
        texts.append((f"small{n:02}", " ".join(["word"] * n)))
        texts += [(f"split{n:02}", "word")] * (n // 2)
    texts += [(f"one{i}", None) for i in range(3)]
    df = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(texts)], "doc_id long, text string, source string")
    ids, offsets = encoder.texts(pa.array([t for _, t in texts], pa.string()))
    assert len(ids) // 20 > 3 * 50
    rows = pack_mixture(df, window=10, windows=2, targets=targets).collect()
    got = rebuilt(rows)
    for i in range(len(texts)):
        assert got[i] == ids[offsets[i]: offsets[i + 1]].astype("<u4").tobytes()
    assert all(r["length"] > 0 for r in rows)
    fill = Counter()
    for r in rows:
        fill[r["sequence_id"]] += r["length"]
    assert all(fill[s] == 10 for s in range(max(fill)))


def plain_round_robin(supply, weights, window):
    """Ids of each source in each window, by exact credits and no shortcut;
    stops at the first window for which a queue of weight is too short."""
    total, left, deficit = sum(weights.values()), dict(supply), dict.fromkeys(weights, Fraction(0))
    served = []
    while True:
        for s, w in weights.items():
            deficit[s] += Fraction(window * w, total)
        take = {s: int(d) for s, d in deficit.items()}
        for s in sorted(weights, key=lambda s: take[s] - deficit[s])[:window - sum(take.values())]:
            take[s] += 1
        if any(take[s] > left[s] for s in weights):
            return served
        for s in weights:
            left[s] -= take[s]
            deficit[s] -= take[s]
        served.append(take)


def test_targets_against_a_plain_round_robin(spark, encoder):
    """Shares of every window while all queues last, over several partitions."""
    texts = [(s, "alpha beta gamma delta " * 25) for s in ("a", "b", "c") for _ in range(60)]
    df = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(texts)], "doc_id long, text string, source string")
    ids, _ = encoder.texts(pa.array([t for _, t in texts]))
    weights, window = {"a": 5, "b": 2, "c": 1}, 64
    plain = plain_round_robin(dict.fromkeys(weights, len(ids) // 3), weights, window)
    assert len(plain) > 100
    del plain[len(plain) // 8 * 8:]  # the partition in which a queue ends spreads what is left of it
    per = {}
    for r in pack_mixture(df, window=window, windows=8, targets={k: float(w) for k, w in weights.items()}).collect():
        per.setdefault(r["sequence_id"], Counter())[r["source"]] += r["length"]
    mine, due = Counter(), Counter()
    for k, take in enumerate(plain):
        mine.update(per[k])
        due.update(take)
        assert all(abs(per[k][s] - take[s]) <= 3 and abs(mine[s] - due[s]) <= 3 for s in weights)


@pytest.mark.parametrize("targets", [
    {"src0": 1.0, "src1": 0.0, "src2": 0.0, "src3": 0.0, "src4": 0.0},
    {"src0": 1.0, "src1": 1e-9, "src2": 1e-7, "src3": 0.0, "src4": 1e-5},
    {"src0": 0.0, "src1": 0.0}, {"nowhere": 1.0}])
def test_small_and_zero_weights_cost_no_more_pieces(docs, doc_rows, encoder, targets):
    rows = pack_mixture(docs, window=256, windows=8, targets=targets).collect()
    got = rebuilt(rows)
    ids, offsets = encoder.texts(pa.array([t for _, t, _, _ in doc_rows]))
    for i, (d, _, _, _) in enumerate(doc_rows):
        assert got[d] == ids[offsets[i]: offsets[i + 1]].astype("<u4").tobytes()
    fill, sources = Counter(), {s for _, _, s, _ in doc_rows} if isinstance(doc_rows[0][2], str) else set()
    for r in rows:
        fill[r["sequence_id"]] += r["length"]
    assert all(fill[s] == 256 for s in range(max(fill)))
    plain = pack_mixture(docs, window=256, windows=8).count()
    assert len(rows) <= 2 * plain + len(sources)


def test_weights_are_not_negative(docs):
    with pytest.raises(ValueError):
        pack_mixture(docs, targets={"a": -1.0})


def test_mixture_proportions(docs):
    rows = pack_mixture(docs).select("sequence_id", "source", "length").collect()
    total, per = Counter(), {}
    for r in rows:
        total[r["source"]] += r["length"]
        per.setdefault(r["sequence_id"], Counter())[r["source"]] += r["length"]
    ids = sum(total.values())
    for s in list(per)[:-1]:
        if sum(per[s].values()) == 2048:
            assert all(abs(per[s][k] - 2048 * total[k] / ids) <= len(total) for k in total)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_is_best_fit_decreasing(lengths):
    window = 64
    row = best_fit(np.array(lengths, np.int64), window)
    free = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [f for f in free if f >= lengths[i]]
        if fits:
            free[free.index(min(fits))] -= lengths[i]
        else:
            free.append(window - lengths[i])
    mine = Counter()
    for r, n in zip(row.tolist(), lengths, strict=True):
        mine[r] += n
    assert sorted(window - n for n in mine.values()) == sorted(free)


@pytest.mark.parametrize("options", [{}, {"window": 64, "shard_ids": 3000}])
def test_matrices_round_trip(docs, doc_rows, encoder, options):
    window = options.get("window", 2048)
    got = {}
    for r in pack_best_fit(docs, **options).collect():
        ids, places = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["positions"], "<u2")
        assert len(ids) == window and r["lengths"][0] == 0 and r["lengths"][-1] == r["n_ids"]
        for a, b, d, s in zip(r["lengths"][:-1], r["lengths"][1:], r["doc_ids"], r["starts"], strict=True):
            assert places[a:b].tolist() == list(range(b - a))
            got.setdefault(d, []).append((s, ids[a:b].tolist()))
    ids, offsets = encoder.texts(pa.array([t for _, t, _, _ in doc_rows]))
    for i, (d, _, _, _) in enumerate(doc_rows):
        assert sum((x for _, x in sorted(got[d])), []) == ids[offsets[i]: offsets[i + 1]].tolist()


def test_matrices_are_written(spark, docs, tmp_path):
    write_matrices(docs.limit(50), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).agg({"n_ids": "sum"}).first()[0] > 0


def test_edges(edge):
    rows = op4_mixture_packing(edge).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] in (3, 4, 5, 10)) == 4
    per = Counter()
    for r in rows:
        per[r["doc_id"]] += r["length"]
    for d in (1, 2, 7, None):
        n = next(r["doc_tokens"] for r in rows if r["doc_id"] == d)
        assert per[d] == n * (2 if d == 1 else 1)
    packed = op1_best_fit_packing(edge).collect()
    assert sum(r["n_ids"] for r in packed) == sum(per.values())
    none = edge.limit(0)
    assert op4_mixture_packing(none).count() == 0 and op1_best_fit_packing(none).count() == 0


def test_tokenizing_holds_little_at_once():
    """The temporaries of op4's slices, beside the remembered chunks."""
    import tracemalloc

    import pyarrow as pa

    from wardflow.llm import _arrays as A
    from wardflow.llm import op4_mixture_packing as op4
    from wardflow.llm._tokens import Encoder, default_tokenizer
    text = " ".join(f"{w}{i % 31}" for i in range(900) for w in ("a", "an", "the", "of", "in", "word"))
    batch = pa.record_batch({"text": pa.array([text] * (8 * (1 << 20) // len(text)))})
    encoder = Encoder.at(default_tokenizer())
    encoder.texts(batch.column("text").slice(0, 1))
    tracemalloc.start()
    try:
        for piece in A.slices(batch, "text", op4.SLICE):
            encoder.texts(piece.column("text"))
        assert tracemalloc.get_traced_memory()[1] < 48 << 20
    finally:
        tracemalloc.stop()

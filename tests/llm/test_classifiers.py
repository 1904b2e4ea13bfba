"""Classifiers: held-out figures, the rules that bind them, edges."""
import zlib

import numpy as np
import pyarrow as pa
import pytest

from wardflow.llm.op6_boosted_quality import (STATISTICS, fit_quality, fit_trees, op6_boosted_quality,
                                              score_quality, statistics)
from wardflow.llm.op7_centroid_language import (fit_centroids, fit_languages, counts, op7_centroid_language,
                                                predict_language)
from wardflow.llm.op10_toxicity_chain import (apply_chain, feature_keys, fit_chain, fit_logistic, fit_toxicity,
                                              op10_toxicity_chain, score_toxicity)

LARGE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def large(spark):
    return (spark.read.parquet(f"{LARGE}/documents.parquet"), spark.read.parquet(f"{LARGE}/labels.parquet"))


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n = y.sum()
    return (rank[y].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def crc(i):
    return zlib.crc32(str(i).encode())


def test_quality_held_out(large):
    docs, labels = large
    rows = op6_boosted_quality(docs, labels).toPandas()
    assert len(rows) == docs.count() and rows.score.between(0, 1).all()
    assert (rows.held_out == [crc(i) % 5 == 0 for i in rows.doc_id]).all()
    assert (rows.predicted == (rows.score >= 0.3)).all()
    j = rows.merge(labels.toPandas(), on="doc_id")
    j = j[j.held_out]
    assert auc((j.quality == 1).to_numpy(), j.score.to_numpy()) > 0.98
    assert (j.predicted == j.quality).mean() > 0.95


def test_quality_does_not_learn_from_held_out_rows(large):
    docs, labels = large
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, "
                               "quality) as quality")
    a, b = fit_quality(docs, labels, fit_rows=500), fit_quality(docs, turned, fit_rows=500)
    assert np.array_equal(a.value, b.value) and np.array_equal(a.threshold, b.threshold)


def test_trees_find_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = fit_trees(x[:2000], y[:2000])
    assert auc(y[2000:] > 0, model.score(x[2000:])) > 0.98
    # The flat arrays give what walking each tree gives.
    for row in x[2000:2020]:
        z = model.base
        for at in model.roots:
            while model.left[at] != at:
                at = model.left[at] if row[model.statistic[at]] <= model.threshold[at] else model.right[at]
            z += model.value[at]
        assert model.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-z)))


def test_statistics_of_known_texts():
    texts = ["Aa bb bb.\ncc 12", None, "", "x"]
    s = dict(zip(STATISTICS, statistics(pa.array(texts)).T, strict=True))
    assert s["capitals"][0] == 1 / 15 and s["digits"][0] == 2 / 15 and s["lines"][0] == 1 / 15
    assert s["distinct_words"][0] == 1 and s["same_as_before"][0] == 0 and s["marked_ends"][0] == 0.2
    assert (statistics(pa.array(texts))[1] == statistics(pa.array(texts))[2]).all()


def test_statistics_do_not_depend_on_neighbours(doc_rows):
    texts = [t for _, t, _, _ in doc_rows[:40]] + ["", None, " ", ".", "", "x"]
    assert np.allclose(statistics(pa.array(texts)), np.concatenate([statistics(pa.array([t])) for t in texts]))
    assert (counts(pa.array(texts)) == np.concatenate([counts(pa.array([t])) for t in texts])).all()


def test_language_held_out(large):
    docs, _ = large
    rows = op7_centroid_language(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (rows.held_out == [crc(i) % 4 == 2 for i in rows.doc_id]).all()
    assert (rows[rows.held_out].lang == rows[rows.held_out].lang_pred).mean() > 0.97
    assert rows.score.between(0, 1).all()


def test_language_ignores_held_out_rows_and_the_column(large):
    docs, _ = large
    turned = docs.selectExpr("doc_id", "text", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 'xx', "
                             "lang) as lang")
    a, b = fit_languages(docs, fit_rows=400), fit_languages(turned, fit_rows=400)
    assert a.names == b.names and np.array_equal(a.centroids, b.centroids)


def test_language_counts():
    c = counts(pa.array(["ab", " a  b ", "AB!", "", None]))
    assert c[0].sum() == 2 + 2 + 2 and (c[0] == c[2]).all() and c[3].sum() == c[4].sum() == 0
    assert c[1].sum() == 2 + 2 + 2


def test_language_far_texts_are_rejected(large):
    docs, _ = large
    model = fit_languages(docs, fit_rows=1000)
    names, score, rejected = model.predict(pa.array(["数学 物理 化学 文学", "qqq zzz xxx kkk", "9 9", None, "é"]))
    assert rejected[:2].all() and names[2:4] == ["und", "und"] and score[2] == score[3] == 0
    assert names[4] in model.names
    assert fit_centroids(np.zeros((0, 4096), np.uint32), []).predict(pa.array(["a"]))[0] == ["und"]


def test_toxicity_catches_and_spares(large):
    docs, labels = large
    rows = op10_toxicity_chain(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    toxic = rows.toxic == 1
    # One in twenty of the toxic rows is junk whose telling words are gone.
    assert rows.rejected[toxic].mean() > 0.93 and rows.rejected[~toxic].mean() < 0.005
    assert rows.category_scores.map(len).eq(3).all()


def test_toxicity_on_rows_outside_the_sample(large):
    docs, labels = large
    model = fit_toxicity(docs, labels.filter("doc_id % 2 = 0"))
    rows = score_toxicity(docs, model).toPandas().merge(labels.toPandas(), on="doc_id")
    rows = rows[rows.doc_id % 2 == 1]
    assert auc((rows.toxic == 1).to_numpy(), rows.toxicity.to_numpy()) > 0.95


def test_the_chain_uses_earlier_links():
    rng = np.random.default_rng(1)
    x = (rng.random((4000, 6)) < 0.3).astype(float)
    first = (x[:, 0] + x[:, 1] > 0) & (rng.random(4000) < 0.95)
    second = first & (x[:, 2] > 0)
    links = fit_chain(x, np.column_stack([first, second]))
    assert [len(w) for w in links] == [7, 8] and links[1][6] > 0.5
    p = apply_chain(links, x)
    assert auc(second, p[:, 1]) > 0.97
    # A link is the logistic regression of its own inputs.
    assert np.allclose(links[0], fit_logistic(x, first.astype(float)))


def test_features_are_words_and_beginnings():
    keys, texts = feature_keys(pa.array(["Abcdef abcdef", "abcd xyz", None]))
    assert set(keys[texts == 0]) & set(keys[texts == 1]) == set()
    one = feature_keys(pa.array(["abcdefg"]))[0]
    two = feature_keys(pa.array(["abcdexy"]))[0]
    assert len(set(one.tolist()) & set(two.tolist())) == 2 and len(set(one.tolist())) == 4


def test_edges(edge, labels):
    for rows in (op6_boosted_quality(edge, labels), op7_centroid_language(edge), op10_toxicity_chain(edge, labels)):
        assert rows.count() == edge.count()
    lang = {r["doc_id"]: r for r in op7_centroid_language(edge).collect()}
    assert all(lang[d]["lang_pred"] == "und" and lang[d]["score"] == 0 for d in (3, 4, 5, 6, 10))
    assert lang[9]["lang_pred"] in ("en", "de", "fr", "ja")
    quality = {r["doc_id"]: r["score"] for r in op6_boosted_quality(edge, labels).collect()}
    assert quality[3] == quality[4] == quality[10]
    kept = score_toxicity(edge, fit_toxicity(edge, labels), keep=edge.columns)
    assert "rejected_in" in kept.columns and kept.filter("rejected_in = 'x'").count() == edge.count()


def test_empty_tables(edge, labels):
    none, no_labels = edge.limit(0), labels.limit(0)
    for rows in (op6_boosted_quality(none, labels), op6_boosted_quality(none, no_labels),
                 op7_centroid_language(none), op10_toxicity_chain(none, labels)):
        assert rows.count() == 0
    assert {r["score"] for r in op6_boosted_quality(edge, no_labels).collect()} == {0.5}
    assert {r["toxicity"] for r in op10_toxicity_chain(edge, no_labels).collect()} == {0.0}
    only = labels.filter("doc_id = 2")
    assert {r["rejected"] for r in op10_toxicity_chain(edge, only).collect()} == {True}


def test_repeated_ids_are_learned_once(spark, docs):
    """A table that was ingested three times gives the same models."""
    docs = docs.select("doc_id", "text", "lang")
    thrice = docs.union(docs).union(docs)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    one, three = (fit_languages(d, fit_rows=60) for d in (docs, thrice))
    assert set(three.names) == {r["lang"] for r in docs.select("lang").distinct().collect()}
    assert np.array_equal(one.idf, three.idf) and one.limits == three.limits
    some = pa.array([r["text"] for r in docs.limit(200).collect()])
    one, three = (fit_quality(d, labels, fit_rows=60) for d in (docs, thrice))
    assert np.array_equal(one.score(statistics(some)), three.score(statistics(some)))
    one, three = (fit_toxicity(d, labels, fit_rows=300) for d in (docs, thrice))
    assert np.array_equal(one.keys, three.keys) and np.array_equal(one.scores(some), three.scores(some))


def test_an_id_with_texts_of_two_languages(spark, docs):
    """Each pair of id and language is learned from its own rows."""
    langs = sorted(r["lang"] for r in docs.select("lang").distinct().collect())[:2]
    rows = [(i % 60, r["text"], r["lang"]) for lang in langs for i, r in enumerate(
        docs.filter(docs["lang"] == lang).orderBy("doc_id").limit(60).collect())]
    model = fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fit_rows=40)
    assert set(model.names) == set(langs)


def test_unlabelled_languages(edge):
    rows = predict_language(edge, fit_languages(edge.withColumn("lang", edge.lang.substr(9, 1)).replace("", None)))
    assert {r["lang_pred"] for r in rows.collect()} == {"und"}
    assert score_quality(edge, fit_trees(np.zeros((0, 24)), np.zeros(0))).count() == edge.count()


def test_one_hot_language_is_ranked_in_parts(spark, monkeypatch):
    """The sample is that of one ranking, whatever the parts, also where one
    language has nearly all ids and ids are repeated."""
    from wardflow.llm import op7_centroid_language as M
    words = ["alpha beta gamma delta", "uno dos tres cuatro", "eins zwei drei vier"]
    rows = [(i, f"{words[0 if i % 20 else 1 + i % 2]} {i}", "abc"[0 if i % 20 else 1 + i % 2]) for i in range(2000)]
    df = spark.createDataFrame(rows + rows[:300], "doc_id long, text string, lang string").repartition(6)
    learned = {}
    for bits in (1, 5, 16):
        monkeypatch.setattr(M, "PART_BITS", bits)
        learned[bits] = M.fit_languages(df, fit_rows=120).__dict__
    for bits in (5, 16):
        for k, v in learned[1].items():
            assert np.array_equal(np.asarray(v), np.asarray(learned[bits][k])) if not isinstance(v, dict) else True, k

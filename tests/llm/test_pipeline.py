"""The pipeline's stages against the operators' plain rules."""
from collections import Counter

import pytest
from test_text_matching import contamination, groups, removal

import corpus_pipeline as P

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents that go into each stage, and the last result."""
    folder = tmp_path_factory.mktemp("stages")
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in P.STAGES:
        stage(spark, docs[-1], SF).write.parquet(str(folder / name))
        docs.append(spark.read.parquet(str(folder / name)))
    return docs


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    assert all(d.dtypes == stages[0].dtypes for d in stages[1:5])
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "substrings", "decontaminate", "packing"]


def test_toxic_documents_go(spark, stages):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {d for d, _ in pairs(stages[1])}
    clean = {d for d, t in labels.items() if t == 0}
    toxic = {d for d, t in labels.items() if t == 1}
    assert clean <= kept and len(toxic & kept) <= 0.1 * len(toxic)
    before = dict(pairs(stages[0]))
    assert all(before[d] == t for d, t in pairs(stages[1]))


def test_one_of_each_group_stays(stages):
    before = pairs(stages[1])
    want = {d for (d, _, _, kept), n in groups(before, 5).items() if kept}
    assert {d for d, _ in pairs(stages[2])} == want and stages[2].count() == len(want)


def test_spans_and_benchmark(spark, stages):
    lost, texts = removal(pairs(stages[2]))
    after = dict(pairs(stages[3]))
    for d, t in pairs(stages[2]):
        assert after.get(d, "") == (texts[d] if lost[d] else t)
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3].collect() if lost[r["doc_id"]])
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {x[0] for x in contamination(pairs(stages[3]), bench) if not x[-1]}
    assert {d for d, _ in pairs(stages[4])} == want


def test_everything_is_packed(stages):
    total, counted = Counter(), {}
    for r in stages[5].collect():
        total[r["doc_id"]] += r["length"]
        counted[r["doc_id"]] = r["doc_tokens"]
    assert total == counted and set(total) == {d for d, _ in pairs(stages[4])}


def test_stages_on_edge_rows(spark, edge, tmp_path):
    docs = edge
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "near_dedup":
            kept = Counter(r["doc_id"] for r in docs.collect())
            assert kept[1] == 0 and kept[-12] == 1 and kept[3] == kept[10] == kept[None] == 1
    assert docs.count() > 0


def test_repeated_rows_leave_one(spark, edge):
    twice = edge.filter("doc_id in (1, 8, 4)").unionByName(edge.filter("doc_id in (8, 4)"))
    kept = Counter(r["doc_id"] for r in P.near_dedup(spark, twice, SF).collect())
    assert kept == {1: 1, 8: 1, 4: 2}


def test_short_items_remove_nothing(spark, tmp_path):
    """Items of one to three words are common speech; long ones still count."""
    long = "the quick brown fox jumps over a very lazy dog while thirteen cats look on"
    items = [("a", "True"), ("b", "New York"), ("c", "of the day"), ("d", long), ("e", None), ("f", ""),
             ("g", "Four short WORDS here")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, "That is true of New York."), (2, "of the day, " + long + "."), (3, "four short words here"), (4, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in P.decontaminate(spark, docs, str(tmp_path)).collect()} == {1, 3, 4}


def test_the_run_releases_its_intermediate_tables(spark):
    import os

    from wardflow.session import child_folders, scratch_root
    before = set(child_folders(spark, scratch_root(spark)))
    out = P.run(spark, SF)
    assert out.count() > 0
    left = {n.rsplit("-", 1)[0] for n in set(child_folders(spark, scratch_root(spark))) - before}
    assert not left & {"stage-toxicity", "stage-near_dedup", "stage-substrings"} and os.path.isdir(SF)


def test_stages_on_empty_tables(spark, edge):
    for _, stage in P.STAGES:
        assert stage(spark, edge.limit(0), SF).count() == 0

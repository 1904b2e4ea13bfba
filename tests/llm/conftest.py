import pytest

#: As in the folder above: of two conftest modules, tests meet the one that was loaded last.
SF_SMALL = "/root/testdata/sf0.001"
CLASH = ["score", "kept", "shard", "slot", "text_hash", "n", "p", "items", "n_hit", "n_words", "toxicity",
         "rejected", "category_scores", "n_removed", "component_id", "node", "key", "label", "_text", "_k0", "ids"]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra
    columns named like results."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    long = " ".join(words[(i * i + i // 7) % 12] + str(i % 97) for i in range(40_000))
    same = "One two three four five six seven eight nine ten. " * 3
    rows = [(1, same, "en", "a"), (1, same, "en", "a"), (2, same, "en", None), (3, None, "en", "b"),
            (4, "", None, "b"), (5, " \n\t ", "en", "c"), (6, "...!!! 123", "en", "c"), (7, long, "de", "a"),
            (None, "No id here, but a text.", "en", "a"), (8, "word", "fr", None), (9, "é", "fr", "b"),
            (10, None, None, None), (11, "\u0000 zero\u0000byte 🙂 テスト", "ja", "d"), (-12, same + "tail", "en", "a")]
    data = [(*r, None if r[1] is None else len(r[1]), *["x"] * len(CLASH)) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"`{c}` string" for c in CLASH)
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, int(i in (1, 2, 8))) for i in range(12)] + [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="session")
def doc_rows(docs):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]

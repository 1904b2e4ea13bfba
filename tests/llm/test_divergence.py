"""The source audit against a plain sum over all terms."""
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wardflow.llm.op11_pattern_tree import audit, op11_pattern_tree, tree_corrections

TERM = re.compile(r"[a-zA-Z\x80-\U0010ffff]+")


def plain(rows, least=10, top=10):
    """(lang, source, text) rows -> the audit's rows, term by term."""
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        words = [w.translate(upper) for w in TERM.findall(text)]
        groups[lang].add(source)
        count[lang, source].update(words)
        docs[lang].update(set(words))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return [1 + 1_000_000_000 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept]

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(map(f, p[s], p[o]))) for o in sources if o != s]
            terms = [(t, f(x, y)) for t, x, y in zip(kept, p[s], q, strict=True) if count[lang, s][t] and x > y]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda i: (-i[1], i[0].encode()))
                out += [(lang, s, part, i, v, n + 1) for n, (i, v) in enumerate(items[:most])]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def test_table_against_plain_sums(docs, doc_rows):
    assert got(op11_pattern_tree(docs)) == plain([(lang, s, t) for _, t, lang, s in doc_rows])


def test_edges(edge):
    rows = [(r["lang"], r["source"], r["text"]) for r in edge.collect()]
    for least in (1, 2, 10):
        assert got(audit(edge, least_docs=least)) == plain(rows, least)


def test_one_hot_source_and_empty_groups(spark):
    words = ["Aa", "bb", "Cc", "éÉ", "dd", "x1y"]
    rows = [("l", "hot", " ".join(words[i % 5:] + ["aa"] * (i % 3))) for i in range(300)]
    rows += [("l", f"s{i}", " ".join(words[:i % 7])) for i in range(40)] + [("l", "none", None), ("m", "only", "aa")]
    rows += [("n", "a", ""), ("n", "b", "rare"), (None, None, "aa bb"), ("", "", "aa")] * 2
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(7)
    assert got(op11_pattern_tree(df)) == plain(rows)


def test_empty_table(spark, docs):
    assert op11_pattern_tree(docs.limit(0)).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.dictionaries(st.integers(0, 4), st.integers(1, 3)), st.integers(1, 4)),
                min_size=1, max_size=25))
def test_tree_shares_paths_without_losing_any(rows):
    paths = sorted((lang, sorted(row.items()), m) for lang, row, m in rows if row)
    if not paths:
        return
    base = {s: 10 + s for s in range(5)}
    share = lambda s, c: 10 + s + 7 * c
    f = lambda p, q: (p - q) ** 2 // (p + q)
    want = Counter()
    for lang, path, m in paths:
        for j, (b, cb) in enumerate(path):
            for a, ca in path[:j]:
                pa, pb = share(a, ca), share(b, cb)
                want[lang, a, b] += m * (f(pa, pb) - f(pa, base[b]) - f(base[a], pb) + f(base[a], base[b]))
    flat = [i for _, path, _ in paths for i in path]
    found = tree_corrections(
        np.array([p[0] for p in paths]), np.array([s for s, _ in flat]), np.array([share(*i) for i in flat]),
        np.array([base[s] for s, _ in flat]), np.cumsum([0, *[len(p[1]) for p in paths]]),
        np.array([p[2] for p in paths]))
    assert found == dict(want)

"""Registered queries against their DuckDB SQL."""
import pytest
from oracle_check import SPARK_TO_DUCK, compare, duck

from wardflow.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, name):
    df = QUERIES[name](spark, SF)
    res = duck(SF).execute(ORACLE[name])
    ok, msg = compare([tuple(r) for r in df.collect()], df.columns, res.fetchall(),
                      [c[0] for c in res.description])
    assert ok, msg
    types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
             for f in df.schema.fields}
    assert types == {c[0]: str(c[1]) for c in res.description}


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))

"""Every query of the library against its DuckDB text on the smallest tables."""

import pytest
from entitymill.plans import registry


def rows_of(pdf, columns):
    out = pdf[columns].astype(object)
    out = out.where(out.notna(), None).astype(str)
    for c in columns:
        out[c] = out[c].str.replace(r"^(-?\d+)\.0$", r"\1", regex=True)
    return sorted(map(tuple, out.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, data, name):
    got = registry.QUERIES[name](spark, data).toPandas()
    if name not in registry.ORACLES:
        assert len(got)
        return
    want = duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got, sorted(got.columns)) == rows_of(want, sorted(got.columns))


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)

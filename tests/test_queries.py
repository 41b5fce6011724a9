"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import duckdb
import pytest

from timberline import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: v + 0.0 if isinstance(v, float) else v
    return sorted(repr([fix(r[i]) for i in order]) for r in rows), [names[i] for i in order]


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), names)


@pytest.mark.parametrize("name", ["forest", "linear_fit", "gbdt_depthwise", "folds_grouped"])
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_tune_random_searches_all_rows(spark, monkeypatch):
    """Every trial holds out each row of the table once."""
    from timberline.plans import search

    held, real = [], search.cross_validate

    def counted(*a, **how):
        r = real(*a, **how)
        held.append(r.oof.count())
        return r

    monkeypatch.setattr(search, "cross_validate", counted)
    assert catalog.QUERIES["tune_random"](spark, SF).count() == 3
    assert held == [catalog.training_rows(spark, SF).count()] * 3

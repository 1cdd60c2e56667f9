"""Every registered query with SQL gives the SQL's rows on the smallest driver tables; others give rows."""

import datetime
import math
import os

import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
if not os.path.isdir(SF):
    pytest.skip("driver tables are not here", allow_module_level=True)

from seriesloom.plans import catalogue, models  # noqa: E402


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, datetime.date):
        return v.isoformat() + " 00:00:00"
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in found), key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, database, name, monkeypatch):
    full = f"range(1, {models.PATHS + 1})"
    sql = catalogue.ORACLES[name].replace(full, "range(1, 201)")  # 200 paths here; the driver compares all
    monkeypatch.setattr(models, "PATHS", 200)
    got = catalogue.QUERIES[name](spark, SF)
    want = database.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == y or all(p == q or (isinstance(p, float) and q is not None and math.isclose(p, q, rel_tol=1e-6, abs_tol=2e-3)) for p, q in zip(x, y, strict=True)), (x, y)


QUICK = ["ar_order_search", "ar_forecast", "seasonal_regression", "tfidf_logreg", "augmented_dickey_fuller", "arma_order_search", "hourly_regression"]


@pytest.mark.parametrize("name", QUICK)
def test_query_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_backtest_scores_every_method_on_the_same_dates(spark):
    found = catalogue.QUERIES["band_backtest"](spark, SF).collect()
    assert {(r.h, r.method) for r in found} == {(h, m) for h in models.HORIZONS for m in models.forecast.METHODS}
    for h in models.HORIZONS:
        own = [r for r in found if r.h == h]
        assert len({r.n for r in own}) == 1 and sum(r.is_best for r in own) == 1 and all(0 <= r.coverage <= 1 for r in own)
        assert all(r.coverage_50 <= r.coverage <= r.coverage_90 for r in own)
        assert {r.method: r.relative_loss for r in own}["fhs"] == 0

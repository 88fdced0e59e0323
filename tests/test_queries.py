"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from hydrolith.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 8) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def scores_are_sound(got):
    """Scores of fitted models: one for each example, between 0 and 1, not all alike; a calibrated one never falls where the score rises."""
    assert len(got) > 100 and not got.duplicated(["sensor", "t"]).any() and got["label"].isin([0, 1]).all()
    assert got["score"].between(0, 1).all() and got["score"].nunique() > 10
    assert got.loc[got["label"] == 1, "score"].mean() > got.loc[got["label"] == 0, "score"].mean()
    if "calibrated" in got:
        assert got["calibrated"].between(0, 1).all() and (got.sort_values("score")["calibrated"].diff().dropna() >= -1e-9).all()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name not in catalog.ORACLE_SQL:
        scores_are_sound(df.toPandas())
        return
    got = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted(tuple(norm(r[i]) for i in at) for r in got.fetchall())

"""Every query with SQL gives the same rows as an independent database on the smallest tables."""

import importlib.util
import math
from pathlib import Path

import duckdb
import pytest

from emberline.plans import registry

REPO = Path(__file__).resolve().parent.parent


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    return str(x)


def rows(columns, data):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).iterdir()):
        con.sql(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return con


@pytest.mark.parametrize("name", list(registry.SQL))
def test_same_as_sql(spark, sf_dir, db, name):
    df = registry.QUERIES[name](spark, sf_dir)
    relation = db.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(relation.columns)
    assert rows(df.columns, df.collect()) == rows(relation.columns, relation.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_points(spark):
    spec = importlib.util.spec_from_file_location("entry_points", REPO / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert set(module.oracle_sql()) <= set(module.queries())
    assert module.entry(spark).count() > 0

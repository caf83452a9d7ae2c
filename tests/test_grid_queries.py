"""Every grid query against its SQL on the smallest tables, where these are there."""

import os
from collections import Counter

import pytest

import __spark_entry__ as entry
from terralith.plans import grid
from terralith.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return db


def plain(v):
    return None if v is None or v != v else float(v) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == names
    order = [columns.index(n) for n in names]
    expected = Counter(tuple(plain(r[k]) for k in order) for r in want.fetchall())
    assert Counter(tuple(map(plain, r)) for r in got.select(*names).collect()) == expected


@pytest.fixture
def few_trees(monkeypatch):
    """The queries keep the operators' defaults (see below); here forests of few trees do."""
    from terralith.operators import supervised

    forest = supervised.SCHEMA["random_forest"]
    monkeypatch.setitem(forest, "n_estimators", (4, *forest["n_estimators"][1:]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"feature_importance"}))
def test_runs(spark, name, few_trees):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and abs(sum(r["pct"] for r in rows) - 100) < 1
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_vectors_are_whole(spark, tmp_path):
    rows = [(i, [float(i * 100 + k) for k in range(64)], i % 3) for i in range(6)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = grid.vectors(spark, str(tmp_path))
    assert got.columns == ["segment_id", *(f"f{k}" for k in range(64)), "label"]
    assert sorted(map(tuple, got.collect())) == [(i + 1, *v, label) for i, v, label in rows]


def test_importance_of_every_component(spark, few_trees):
    assert {r["feature"] for r in QUERIES["feature_importance"](spark, SF).collect()} == {f"f{k}" for k in range(64)}


def test_models_have_the_operators_defaults(spark, monkeypatch):
    from terralith.operators import supervised, unsupervised

    class Fitted(Exception):
        pass

    def fit(self, *_):
        raise Fitted(self.params)

    folds, dealt = [], supervised.stratified_folds
    monkeypatch.setattr(supervised.SupervisedClassifier, "fit", fit)
    monkeypatch.setattr(unsupervised.UnsupervisedClassifier, "fit", fit)
    monkeypatch.setattr(supervised, "stratified_folds", lambda labels, cv=5: folds.append(cv) or dealt(labels, cv))
    for name in ("random_forest", "feature_importance", "cross_validate"):
        with pytest.raises(Fitted) as found:
            QUERIES[name](spark, SF)
        assert found.value.args[0] == {k: v[0] for k, v in supervised.SCHEMA["random_forest"].items()}
    assert folds == [5]
    for name in ("kmeans", "gmm"):
        with pytest.raises(Fitted) as found:
            QUERIES[name](spark, SF)
        assert found.value.args[0]["n_init"] == unsupervised.SCHEMA[name]["n_init"][0]

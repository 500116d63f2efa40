import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dataquarry.operators.profile import semantic_types
from dataquarry.plans.auto import plan_auto, run_auto
from dataquarry.plans.clustering import run_clustering
from dataquarry.plans.supervised import run_supervised
from dataquarry.plans.topics import run_topics
from queryset.analyses import auto_profile


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(20)
    n = 300
    age = rng.normal(40, 10, n)
    y = np.where(age + rng.normal(0, 3, n) > 40, "yes", "no")
    city = np.where(rng.random(n) < 0.5, "north", np.where(y == "yes", "east", "west"))
    pdf = pd.DataFrame({"id": np.arange(n), "age": age, "twice": 2 * age, "noise": rng.normal(size=n), "city": city, "y": y})
    return spark.createDataFrame(pdf)


def test_supervised_classification(spark, people):
    r = run_supervised(people, "id", "y", "classification", rounds=5, trees=5)
    assert {x["feature"] for x in r.vif.filter("removed_at is not null").collect()} in ({"age"}, {"twice"})
    m = {x["metric"]: x["value"] for x in r.metrics.collect()}
    assert m["accuracy"] > 0.8 and 0.8 < m["roc_auc"] <= 1.0
    assert r.scores.count() == 20 and r.winner in ("linear", "gradient_boosting")
    top = r.attribution.orderBy(F.desc("mean_abs")).first()["feature"]
    assert top in ("num__age", "num__twice")
    assert r.predictions.count() == 60


def test_supervised_regression(spark, people):
    df = people.withColumn("target", F.col("age") * 3 + F.col("noise"))
    r = run_supervised(df.drop("y", "twice"), "id", "target", "regression", rounds=5, trees=5)
    m = {x["metric"]: x["value"] for x in r.metrics.collect()}
    assert m["r2"] > 0.95 and {x["model"] for x in r.scores.collect()} == {"baseline", "linear", "forest", "gradient_boosting"}
    with pytest.raises(ValueError):
        run_supervised(df, "id", "nope", "regression")


def test_clustering_keeps_every_row(spark):
    rng = np.random.default_rng(22)
    x = np.vstack([rng.normal(c, 0.5, size=(60, 2)) for c in (0, 10)])
    pdf = pd.DataFrame({"id": np.arange(120), "a": x[:, 0], "b": x[:, 1], "kind": ["p"] * 60 + ["q"] * 60})
    r = run_clustering(spark.createDataFrame(pdf), "id", trees=30)
    rows = r.rows.toPandas()
    assert sorted(rows["id"]) == list(range(120))
    assert (rows["Cluster_ID"] == -1).sum() == 6 == (rows["__anomaly__"] == -1).sum()
    assert r.sweep.filter("best").first()["k"] == 2
    assert {d["feature"] for d in r.differentiators.filter("key").collect()} == {"a", "b", "kind"}
    assert r.numeric_profiles.count() == 4 and r.categorical_profiles.count() == 2
    scored = r.model.transform(spark.createDataFrame(pdf))
    assert {x["Cluster_ID"] for x in scored.select("Cluster_ID").distinct().collect()} == {0, 1}


@pytest.fixture(scope="module")
def notes(spark):
    rng = np.random.default_rng(23)
    a, b = [f"perro{i}" for i in range(12)], [f"luna{i}" for i in range(12)]
    texts = [" ".join(rng.choice(a, 14)) for _ in range(40)] + [" ".join(rng.choice(b, 14)) for _ in range(40)]
    return spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "id long, nota string, flag int")


@pytest.mark.parametrize("method", ["dense", "sparse"])
def test_topics(spark, notes, method):
    r = run_topics(notes, "id", "nota", method)
    rows = r.rows.toPandas().set_index("id")
    assert len(rows) == 80 and {"nota_clean", "lemmatized", "Topic_ID"} <= set(rows.columns)
    found = rows[rows["Topic_ID"] != -1]
    for t in set(found["Topic_ID"]):
        members = found.index[found["Topic_ID"] == t]
        assert (members < 40).all() or (members >= 40).all()
    if len(found):
        assert r.payload.count() == found["Topic_ID"].nunique()


def test_topics_with_target_stop_at_vectors(spark, notes):
    r = run_topics(notes, "id", "nota", target="flag")
    assert r.keywords is None and r.vectors.count() == 80
    with pytest.raises(ValueError):
        run_topics(notes, "id", "nope")
    with pytest.raises(ValueError):
        run_topics(notes, "id", "nota", method="other")


def test_auto_chooses_the_route(spark, people, notes):
    assert semantic_types(notes)["nota"] == "Texto Libre"
    texts = run_auto(notes.drop("flag"), "id")
    assert texts.route == "fase_3" and texts.report().count() > 0
    supervised = run_auto(people.drop("twice", "noise"), "id", target="y", rounds=3, trees=3)
    assert supervised.route == "fase_1" and supervised.result.task == "classification"
    last = run_auto(people.drop("twice", "noise"), "id", assume_last=True, rounds=3, trees=3)
    assert last.result.target == "y"
    grouped = run_auto(people.drop("y"), trees=20)
    assert grouped.route == "fase_2" and grouped.result.rows.count() == 300


def test_profile_of_a_table_whose_analysis_is_refused(spark, tmp_path):
    """A name of its own in every row: too many categories to cluster by, but the profile is whole."""
    n = 10_500
    df = spark.range(n).selectExpr(
        "id as s_suppkey", "concat('Supplier', id) as s_name", "cast(id % 25 as int) as s_nationkey", "cast(id % 997 as double) as s_acctbal"
    )
    df.write.parquet(str(tmp_path / "supplier.parquet"))
    rows = {r["column"]: r for r in auto_profile(spark, str(tmp_path)).collect()}
    assert set(rows) == set(df.columns) and all(r["total"] == n for r in rows.values())
    assert rows["s_name"]["cardinality"] == n and rows["s_acctbal"]["cardinality"] == 997
    assert plan_auto(df, "s_suppkey").route == "fase_2"

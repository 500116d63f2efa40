import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dataquarry.plans import clustering, supervised
from dataquarry.plans.auto import number_rows, run_auto
from dataquarry.plans.clustering import run_clustering
from dataquarry.plans.report import cluster_report, supervised_report
from dataquarry.plans.supervised import run_supervised
from dataquarry.runtime import new_path, scratch, shared_dir
from dataquarry.sources.phases import SavedPhases, table_digest


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in (0, 6, 12)])
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "a": x[:, 0], "b": x[:, 1], "g": ["u", "v", "w"] * 60}))


def broken(*_, **__):
    raise RuntimeError("lost")


def test_clustering_goes_on_after_the_last_phase(spark, blobs, tmp_path, monkeypatch):
    phases = lambda: SavedPhases(blobs, str(tmp_path), "one", trees=10)
    with monkeypatch.context() as m:
        m.setattr(clustering, "kmeans_sweep", broken)
        with pytest.raises(RuntimeError):
            run_clustering(blobs, "id", trees=10, phases=phases())
    assert phases().done("outliers") and not phases().done("clusters")
    with monkeypatch.context() as m:
        m.setattr(clustering, "isolation_forest", broken)
        first = run_clustering(blobs, "id", trees=10, phases=phases())
        m.setattr(clustering, "kmeans_sweep", broken)
        m.setattr(clustering, "cluster_differentiators", broken)
        again = run_clustering(blobs, "id", trees=10, phases=phases())
    whole = run_clustering(blobs, "id", trees=10)
    for name in ("rows", "sweep", "variance", "differentiators", "numeric_profiles"):
        assert rows(getattr(first, name)) == rows(getattr(again, name))
    assert rows(first.rows) == rows(whole.rows)
    assert again.model.stages[-1].clusterCenters()
    items = {(r["section"], r["item"]): r["value"] for r in cluster_report(again).collect()}
    assert items["rows", "rows"] == "180" and ("silhouette", "3") in items and ("davies_bouldin", "3") in items
    assert int(items["rows", "anomalies"]) == first.rows.where("Cluster_ID = -1").count()
    assert any(k[0] == "cluster_median" for k in items)


def test_supervised_goes_on_after_the_last_phase(spark, blobs, tmp_path, monkeypatch):
    df = blobs.withColumn("y", F.col("a") * 2 + F.col("b"))
    run = lambda: run_supervised(
        df, "id", "y", "regression", rounds=3, trees=3, phases=SavedPhases(df, str(tmp_path), "two", target="y")
    )
    with monkeypatch.context() as m:
        m.setattr(supervised, "evaluate", broken)
        with pytest.raises(RuntimeError):
            run()
    monkeypatch.setattr(supervised, "cross_validate", broken)
    monkeypatch.setattr(supervised, "select_by_pvalue", broken)
    first, again = run(), run()
    assert rows(first.metrics) == rows(again.metrics) and first.predictions.count() == again.predictions.count() > 0
    items = {(r["section"], r["item"]) for r in supervised_report(again).collect()}
    assert {("threshold", "p_value"), ("threshold", "vif"), ("cv_std", "linear")} <= items


def test_other_input_or_option_is_another_run(spark, blobs, tmp_path):
    name = lambda df, **o: SavedPhases(df, str(tmp_path), "r", **o).run
    same = {name(blobs, k=1), name(blobs.repartition(7), k=1), name(blobs.orderBy(F.desc("id")), k=1)}
    assert len(same) == 1
    assert len({*same, name(blobs, k=2), name(blobs.where("id > 0"), k=1), name(blobs.withColumn("g", F.lower("g")).withColumn("a", F.lit(0.0)), k=1)}) == 4
    pairs = spark.createDataFrame([(None, 1), (1, 1)], "a int, b int")
    turned = spark.createDataFrame([(1, None), (1, 1)], "a int, b int")
    assert table_digest(pairs) != table_digest(turned)
    maps = spark.createDataFrame([({"a": 1},)], "m map<string,int>")
    assert table_digest(maps) == table_digest(maps) != table_digest(blobs.limit(0))


def test_intermediates_are_removed(spark, tmp_path):
    with scratch(spark):
        path = new_path(spark, "t")
        spark.range(3).write.parquet(path)
        assert spark.read.parquet(path).count() == 3
    assert not path.startswith(f"{shared_dir(spark)}/dataquarry/t-")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    phases = SavedPhases(spark.range(5), str(tmp_path), "r")
    assert phases.step("Empty one", lambda: {"t": spark.range(0), "none": None})["none"] is None
    assert phases.step("Empty one", broken)["t"].count() == 0


def test_row_numbers_do_not_depend_on_the_layout(spark, blobs):
    df = blobs.drop("id").union(blobs.drop("id").where("g = 'u'"))
    a, b = number_rows(df.repartition(5), "n"), number_rows(df.orderBy("b").coalesce(2), "n")
    assert rows(a) == rows(b) and {r["n"] for r in a.collect()} == set(range(df.count()))


def test_auto_returns_the_profile(spark, blobs, tmp_path, monkeypatch):
    run = lambda: run_auto(blobs, "id", phases=SavedPhases(blobs, str(tmp_path), "auto"), trees=5)
    first = run()
    monkeypatch.setattr(clustering, "isolation_forest", broken)
    assert rows(first.report()) == rows(run().report()) and first.profile.count() == len(blobs.columns)

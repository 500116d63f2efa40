import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from dataquarry.operators import anomaly as A
from dataquarry.operators import cluster as K
from dataquarry.operators import neighbors as N
from dataquarry.operators import topics as T
from dataquarry.operators.graph import connected_components, follow_links


def frame(spark, x, labels=None):
    rows = [(i, [float(v) for v in r], int(labels[i]) if labels is not None else 0) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(3)


def brute(x, k, metric):
    if metric == "cosine":
        size = np.linalg.norm(x, axis=1)
        u = x / np.where(size == 0, 1, size)[:, None]
        d = 1 - u @ u.T
        zero = size == 0
        d[np.ix_(zero, zero)] = 0
    else:
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    d = np.round(d, 9)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(d, order, 1)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("block", [32, 4096])
def test_knn_equals_brute_force(spark, metric, block):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(80, 6)), np.repeat(rng.normal(size=(1, 6)), 60, axis=0), np.zeros((2, 6)), rng.normal(5, 0.1, size=(60, 6))])
    got = N.knn(frame(spark, x), "id", "v", 5, metric, block_rows=block).toPandas().sort_values(["src", "rank"])
    ids, dist = brute(x, 5, metric)
    assert len(got) == 5 * len(x)
    assert np.allclose(got["dist"].to_numpy().reshape(-1, 5), dist, atol=1e-6)
    assert (got["dst"].to_numpy().reshape(-1, 5) == ids).mean() > 0.99  # equal up to rounding-level ties
    copies = got[got["src"].between(80, 139)]
    assert copies["dst"].between(80, 139).all() and (copies["src"] != copies["dst"]).all()


def test_knn_with_fewer_rows_than_neighbors(spark):
    assert N.knn(frame(spark, np.eye(3)), "id", "v", 15).count() == 6


def test_silhouette_and_davies_bouldin(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(c, 1, size=(40, 3)) for c in (0, 3, 6)] + [[[50.0, 50, 50]]])
    labels = np.array([0] * 40 + [1] * 40 + [2] * 40 + [3])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))

    def score(dist):
        out = []
        for i in range(len(x)):
            own = labels == labels[i]
            if own.sum() == 1:
                out.append(0.0)
                continue
            a = dist[i, own].sum() / (own.sum() - 1)
            b = min(dist[i, labels == k].mean() for k in set(labels) - {labels[i]})
            out.append((b - a) / max(a, b))
        return np.mean(out)

    df = frame(spark, x, labels)
    assert np.isclose(K.silhouette(df, "id", "v", "label").first()["silhouette"], score(d))
    assert np.isclose(K.silhouettes(df.withColumn("l", F.array("label")), "id", "v", "l", block_rows=25).agg(F.avg("s")).first()[0], score(d))
    assert np.isclose(K.silhouette(df, "id", "v", "label", "squared_euclidean").first()["silhouette"], score(d**2))
    cen = np.array([x[labels == k].mean(0) for k in range(4)])
    s = np.array([np.linalg.norm(x[labels == k] - cen[k], axis=1).mean() for k in range(4)])
    m = np.linalg.norm(cen[:, None] - cen[None], axis=-1)
    want = np.mean([max((s[i] + s[j]) / m[i, j] for j in range(4) if j != i) for i in range(4)])
    assert np.isclose(K.davies_bouldin(df, "v", "label").first()["davies_bouldin"], want)
    evaluator = ClusteringEvaluator(featuresCol="w", predictionCol="label")
    assert np.isclose(evaluator.evaluate(df.withColumn("w", array_to_vector("v")).filter("label < 3")),
                      K.silhouette(df.filter("label < 3"), "id", "v", "label", "squared_euclidean").first()["silhouette"])


def test_pca_shares_and_stable_signs(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 4)) @ np.diag([5, 2, 1, 0.1])
    df = frame(spark, x)
    out, _, ratios = K.pca_reduce(df, "v")
    want = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.isclose(ratios.sum(), 1.0) and np.allclose(ratios, want / want.sum())
    needed = K.cumulative_variance(K.variance_table(spark, ratios)).filter("needed").count()
    assert out.first()["reduced"].size == needed
    again, _, _ = K.pca_reduce(df.withColumn("v", F.transform("v", lambda t: t * 1.0)), "v")
    pair = out.select("id", "reduced").join(again.select("id", F.col("reduced").alias("b")), "id").collect()
    assert all(np.allclose(r["reduced"].toArray(), r["b"].toArray()) for r in pair)


def test_sweep_finds_three_blobs(spark):
    rng = np.random.default_rng(10)
    x = np.vstack([rng.normal(c, 0.3, size=(30, 2)) for c in ((0, 0), (8, 0), (0, 8))])
    table, _, labelled = K.kmeans_sweep(frame(spark, x), "id", "v")
    assert table.filter("best").first()["k"] == 3 and table.count() == 8
    assert sorted(r["count"] for r in labelled.groupBy("Cluster_ID").count().collect()) == [30, 30, 30]
    with pytest.raises(ValueError):
        K.kmeans_sweep(frame(spark, x[:3]), "id", "v")


def test_sweep_fits_repeated_vectors_once(spark, monkeypatch):
    """Rows with equal vectors are one weighted point of the fit; scores and labels are those of the rows."""
    rng = np.random.default_rng(12)
    x = np.vstack([rng.normal(c, 0.3, size=(30, 2)) for c in ((0, 0), (8, 0), (0, 8))])
    copies = np.vstack([x, x, x, x[:30], x[:30]])
    sizes = []
    monkeypatch.setattr(K.KMeans, "fit", lambda self, rows, fit=K.KMeans.fit: sizes.append(rows.count()) or fit(self, rows))
    table, model, labelled = K.kmeans_sweep(frame(spark, copies), "id", "v")
    assert set(sizes) == {90}
    assert table.filter("best").first()["k"] == 3
    assert sorted(r["count"] for r in labelled.groupBy("Cluster_ID").count().collect()) == [90, 90, 150]
    centres = sorted(tuple(c) for c in model.clusterCenters())
    assert np.allclose(centres, sorted(tuple(x[i:i + 30].mean(axis=0)) for i in (0, 30, 60)))
    sizes.clear()
    K.kmeans_sweep(frame(spark, np.vstack([x, x[:60]])), "id", "v")
    assert set(sizes) == {150}


def test_levels_get_every_edge_once(spark, monkeypatch):
    """Both directions of an edge are one before the levels multiply it, and it is there from its smaller distance on."""
    seen = []

    def components(nodes, edges, by, ordered, run=T.connected_components):
        seen.append(edges.collect())
        return run(nodes, edges, by, ordered)

    monkeypatch.setattr(T, "connected_components", components)
    core = spark.createDataFrame([(i, 0.5) for i in range(6)], "node bigint, core double")
    ways = [(0, 1, 1.0), (1, 0, 1.0), (2, 1, 1.0), (1, 2, 2.0), (3, 4, 1.0), (4, 3, 1.0), (5, 4, 2.0), (2, 3, 4.0), (3, 2, 4.0), (5, 5, 1.0)]
    edges = spark.createDataFrame(ways, "src bigint, dst bigint, w double")
    T._excess_of_mass(core, edges, 2)
    assert len(seen[0]) == len(set(seen[0])) and all(r["src"] > r["dst"] for r in seen[0])
    levels = max(r["level"] for r in seen[0]) + 1
    count = lambda a, b: sum((r["src"], r["dst"]) == (a, b) for r in seen[0])
    assert count(1, 0) == count(2, 1) == count(4, 3) == levels > count(5, 4) > count(3, 2) == 1


def test_pivots_are_compared_on_all_cores(spark, monkeypatch):
    """Thousands of short vectors are few bytes, but each is compared with every pivot, so they are spread by rows."""
    df = spark.range(0, 30_000, 1, 1).select("id", F.array(*[(F.xxhash64("id", F.lit(i)) % 997).cast("double") for i in range(2)]).alias("v"))
    sizes = []
    monkeypatch.setattr(N, "_pivots", lambda points, *a, f=N._pivots: sizes.extend(r["count"] for r in points.groupBy(F.spark_partition_id()).count().collect()) or f(points, *a))
    assert N.knn(df, "id", "v", k=2, metric="euclidean").count() == 60_000
    assert len(sizes) >= 3 and max(sizes) <= 15_000


def test_density_clusters_find_blobs_and_noise(spark):
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(0, 0.2, size=(60, 2)), rng.normal(6, 0.2, size=(40, 2)), rng.uniform(-40, 40, size=(12, 2))])
    df = frame(spark, x)
    for options in ({"epsilon": 0.8}, {}):
        got = {r["id"]: r["label"] for r in T.density_cluster(df, "id", "v", **options).collect()}
        assert len(got) == len(x)
        for start, end in ((0, 60), (60, 100)):
            inside = [got[i] for i in range(start, end)]
            assert max(inside.count(c) for c in set(inside)) >= 0.9 * (end - start)
        assert got[5] != got[65] and sum(got[i] == -1 for i in range(100, 112)) >= 8


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)]
    nodes = spark.createDataFrame([(i,) for i in [*range(0, 50), *range(100, 161), 999]], "node long")
    got = {r["node"]: r["comp"] for r in connected_components(nodes, spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(50)) and all(got[i] == 100 for i in range(100, 161)) and got[999] == 999


def test_components_need_few_rounds_on_a_winding_path(spark, monkeypatch):
    """Labels that only move to neighbours and to their labels take tens of rounds here."""
    from dataquarry.operators import graph

    names = np.random.default_rng(3).permutation(600)
    edges = [(int(level), int(a), int(b)) for level in (0, 1) for a, b in zip(names, names[1:]) if level or a % 50]
    nodes = spark.createDataFrame([(level, int(i)) for level in (0, 1) for i in names], "level int, node long")
    rounds, write = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: rounds.append(name) or write(df, name))
    got = connected_components(nodes, spark.createDataFrame(edges, "level int, src long, dst long"), ["level"]).collect()
    near = {(level, i): {i} for level in (0, 1) for i in map(int, names)}
    for level, a, b in edges:
        both = near[level, a] | near[level, b]
        for i in both:
            near[level, i] = both
    assert {(r["level"], r["node"]): r["comp"] for r in got} == {k: min(v) for k, v in near.items()}
    assert rounds.count("cc-edges") <= 8


def test_merge_order_matches_the_sequential_rule(spark):
    links = spark.createDataFrame([(0, 1), (1, 2), (2, None), (3, None), (4, 6), (6, 7), (7, None)], "node int, next int")
    assert {r["node"]: r["last"] for r in follow_links(links).collect()} == {0: 2, 1: 2, 2: 2, 3: 3, 4: 7, 6: 7, 7: 7}
    rng = np.random.default_rng(12)
    for _ in range(2):
        cen = rng.normal(size=(9, 3))
        unit = cen / np.linalg.norm(cen, axis=1)[:, None]
        sim = unit @ unit.T
        labels = np.arange(9)
        for i in range(9):  # the pairwise pass over fixed centroids
            for j in range(i + 1, 9):
                if sim[i, j] > 0.4:
                    labels[labels == i] = j
        got = {r["id"]: r["label"] for r in T.merge_topics(frame(spark, cen, np.arange(9)), "v", "label", 0.4).collect()}
        assert [got[i] for i in range(9)] == labels.tolist()


def test_isolation_forest_share_and_outlier(spark):
    rng = np.random.default_rng(13)
    pdf = pd.DataFrame({"id": np.arange(400), "a": rng.normal(size=400), "b": rng.normal(size=400), "c": "x"})
    pdf.loc[0, ["a", "b"]] = [30.0, -30.0]
    df = spark.createDataFrame(pdf)
    got = {r["id"]: r["__anomaly_label__"] for r in A.isolation_forest(df, "id").collect()}
    assert got[0] == -1 and sum(v == -1 for v in got.values()) == 20
    again = {r["id"]: r["__anomaly_label__"] for r in A.isolation_forest(df.repartition(5), "id").collect()}
    assert got == again
    assert A.isolation_forest(df.select("id", "c"), "id").filter("__anomaly_label__ = 1").count() == 400
    assert np.isclose(A.average_path(256), 10.244770920116851)


def test_large_table_trees_use_a_pool(spark):
    df = spark.range(60_000).select("id", F.rand(1).alias("x"), F.lit(1.0).alias("k"))
    picked, psi = A._tree_samples(df, "id", ["x", "k"], 4, 64)
    sizes = [r["count"] for r in picked.groupBy("tree").count().collect()]
    assert psi == 64 and sizes == [64] * 4


def test_low_dimensional_vectors_pass_unchanged(spark):
    df = frame(spark, np.eye(4))
    assert [r["reduced"] for r in T.reduce_vectors(df, "v").orderBy("id").collect()] == np.eye(4).tolist()


def test_search_copies_a_row_a_bounded_number_of_times(spark, monkeypatch):
    """Cells beyond the blocks share one, and cells larger than a block are cut."""
    assert [N.tiles_for(n, 64) for n in (100, 10_000, 50_000, 600_000, 2_000_000)] == [1, 5, 16, 16, 16]
    assert N.tiles_for(20_000_000, 64) == 153
    monkeypatch.setattr(N, "HELD", 500)
    rng = np.random.default_rng(12)
    x = np.vstack([rng.normal(size=(150, 4)), rng.normal(7, 0.01, size=(150, 4))])
    seen = N.knn(frame(spark, x), "id", "v", 5, "euclidean", block_rows=6).toPandas().sort_values(["src", "rank"])
    ids, dist = brute(x, 5, "euclidean")
    assert np.allclose(seen["dist"].to_numpy().reshape(-1, 5), dist, atol=1e-6)
    assert (seen["dst"].to_numpy().reshape(-1, 5) == ids).all()
    df = frame(spark, x, np.arange(300) % 3).withColumn("l", F.array("label"))
    a, b = (N.distances_to_labels(df, "id", "v", "l", block_rows=m).orderBy("key", "label").toPandas() for m in (6, 4096))
    assert len(a) == 900 and np.allclose(a["total"], b["total"]) and (a["n"] == b["n"]).all()


def test_sweep_and_scores_use_all_cores(spark, tmp_path, monkeypatch):
    """A file of one row group is cut into many parts, but one of them holds all rows."""
    from dataquarry.runtime import balance

    df = spark.range(0, 25_000, 1, 1).select("id", F.array(*[(F.xxhash64("id", F.lit(i)) % 97).cast("double") for i in range(2)]).alias("v"))
    df.write.parquet(str(tmp_path / "one"))
    size = "spark.sql.files.maxPartitionBytes"
    monkeypatch.setattr(K.KMeans, "fit", lambda self, rows, fit=K.KMeans.fit: parts.append(rows.groupBy(F.spark_partition_id()).count().collect()) or fit(self, rows))
    parts = []
    spark.conf.set(size, 40_000)
    try:
        one = spark.read.parquet(str(tmp_path / "one"))
        assert one.rdd.getNumPartitions() >= 4 and one.groupBy(F.spark_partition_id()).count().count() == 1
        K.kmeans_sweep(one, "id", "v")
        assert parts and all(max(r["count"] for r in p) <= 12_500 and sum(r["count"] for r in p) == 25_000 for p in parts)
        few = one.filter("id < 40")
        assert balance(few, "few") is few
        assert sorted(r[0] for r in balance(one, "even").select("id").collect()) == list(range(25_000))
    finally:
        spark.conf.unset(size)

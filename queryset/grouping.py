"""Outliers, feature space, cluster profiles, and the numbers behind plots."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataquarry.operators import anomaly as A
from dataquarry.operators import cluster as K
from dataquarry.operators.features import transform_features
from queryset.common import Registry, rnd, table
from queryset.statistics import _anova_sql

REGISTRY = Registry()

EV_SQL = "ev as (select event_id, value, event_type, cast(user_id % 3 as integer) as cluster from events)"


def ev_clusters(spark, sf):
    return table(spark, sf, "events").select("event_id", "value", "event_type", F.expr("cast(user_id % 3 as int)").alias("cluster"))


@REGISTRY.add("isolation_forest")
def isolation_forest(spark, sf):
    return A.isolation_forest(table(spark, sf, "events"), "event_id", ["value", "user_id"]).select("event_id", "__anomaly_label__")


@REGISTRY.add("isolation_forest_share", """
select count(*) as n, count(distinct event_id) as keys, count(*) - 1 - cast(floor(0.95 * (count(*) - 1)) as bigint) as most, true as found from events""")
def isolation_forest_share(spark, sf):
    """All rows are labelled, and at most those above the cut as anomalies."""
    out = A.isolation_forest(table(spark, sf, "events"), "event_id", ["value", "user_id"])
    flagged = F.count_if(F.col("__anomaly_label__") == -1)
    most = F.count(F.lit(1)) - 1 - F.floor(0.95 * (F.count(F.lit(1)) - 1))
    return out.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("keys"), most.alias("most"),
        ((flagged > 0) & (flagged <= most)).alias("found"),
    )


@REGISTRY.add("build_feature_space", """
with q as (select quantile_cont(c_acctbal, 0.25) as a1, quantile_cont(c_acctbal, 0.5) as a2, quantile_cont(c_acctbal, 0.75) as a3,
  quantile_cont(c_nationkey, 0.25) as b1, quantile_cont(c_nationkey, 0.5) as b2, quantile_cont(c_nationkey, 0.75) as b3 from customer)
select c_custkey, round((c_nationkey - b2) / (b3 - b1), 4) as x0, round((c_acctbal - a2) / (a3 - a1), 4) as x1,
  cast(c_mktsegment = 'AUTOMOBILE' as double) as x2 from customer, q""")
def build_feature_space(spark, sf):
    from pyspark.ml.functions import vector_to_array

    df = table(spark, sf, "customer").drop("c_name")
    model, _ = K.build_feature_space(df, "c_custkey")
    v = vector_to_array(F.col("features"))
    return transform_features(model, df).select("c_custkey", *[rnd(v[i]).alias(f"x{i}") for i in range(3)])


_CHI2 = """cells as (select event_type as a, cluster as b, count(*) as o from ev group by 1, 2),
 r as (select a, sum(o) as r from cells group by 1), c as (select b, sum(o) as c from cells group by 1), n as (select sum(o) as n from cells),
 grid as (select r * c / n as e, coalesce(o, 0) as o from r cross join c cross join n left join cells on cells.a = r.a and cells.b = c.b)
select 'event_type' as feature, 'chi2' as test, round(sum((o - e) ** 2 / e), 4) as stat,
  cast((select (count(distinct a) - 1) * (count(distinct b) - 1) from cells) as integer) as dof1, cast((select n from n) as bigint) as dof2 from grid"""


@REGISTRY.add("cluster_differentiators", f"with {EV_SQL} select * from (" + _anova_sql(
    "select 'value' as feature, cluster as grp, value as x from ev") + f") union all select * from (with {_CHI2})")
def cluster_differentiators(spark, sf):
    out = K.cluster_differentiators(ev_clusters(spark, sf), "cluster", skip=["event_id"])
    return out.select("feature", "test", rnd("stat").alias("stat"), "dof1", "dof2")


@REGISTRY.add("cluster_profile_numeric", f"""with {EV_SQL}
select cluster, count(*) as size, 'value' as "column", round(quantile_cont(value, 0.5), 4) as median, round(avg(value), 4) as mean,
  round(stddev_samp(value), 4) as std from ev group by 1""")
def cluster_profile_numeric(spark, sf):
    out = K.cluster_profile_numeric(ev_clusters(spark, sf), "cluster", ["value"])
    return out.withColumns({c: rnd(c) for c in ("median", "mean", "std")})


@REGISTRY.add("cluster_profile_categorical", f"""with {EV_SQL}, n as (select cluster, event_type as v, count(*) as n from ev group by 1, 2)
select cluster, 'event_type' as "column", arg_min(v, (-n, v)) as mode, max(n) as mode_count, count(*) as n_categories, cast(sum(n) as bigint) as total from n group by 1""")
def cluster_profile_categorical(spark, sf):
    out = K.cluster_profile_categorical(ev_clusters(spark, sf), "cluster", ["event_type"], maps=True)
    total = F.aggregate(F.map_values("categories"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select("cluster", "column", "mode", "mode_count", F.size("categories").cast("bigint").alias("n_categories"), total.alias("total"))


@REGISTRY.add("category_counts", f"""with {EV_SQL} select cluster, 'event_type' as "column", event_type as value, count(*) as n from ev group by 1, 3""")
def category_counts(spark, sf):
    return K.category_counts(ev_clusters(spark, sf), "cluster", ["event_type"])


@REGISTRY.add("plot_data", f"""with {EV_SQL}
select cluster, count(*) as n, round(min(value), 4) as low, round(quantile_cont(value, 0.25), 4) as q1, round(quantile_cont(value, 0.5), 4) as median,
  round(quantile_cont(value, 0.75), 4) as q3, round(max(value), 4) as high from ev group by 1""")
def plot_data(spark, sf):
    """Box-plot numbers per group."""
    out = K.cluster_boxplot(ev_clusters(spark, sf), "cluster", "value")
    return out.withColumns({c: rnd(c) for c in ("low", "q1", "median", "q3", "high")})


@REGISTRY.add("plot_scatter", """
select vec_id, label, round(cast(embedding[1] as double), 5) as pca1, round(cast(embedding[2] as double), 5) as pca2 from embeddings""")
def plot_scatter(spark, sf):
    out = K.scatter_points(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")
    return out.withColumns({c: rnd(c, 5) for c in ("pca1", "pca2")})

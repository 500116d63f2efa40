"""Splits, folds, samples, and exact metrics of given predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataquarry.operators import columns as C
from dataquarry.operators import metrics as M
from dataquarry.operators import sampling as S
from queryset.common import ORDERS_SQL, Registry, docs_topic, TOPIC_SQL, orders_cls, rnd, sql_hash, table

REGISTRY = Registry()


@REGISTRY.add("train_test_split", f"""with {ORDERS_SQL}, r as (
  select o_orderkey, y, row_number() over (partition by y order by {sql_hash('o_orderkey', 'split')}, o_orderkey) as rn,
    count(*) over (partition by y) as n from ord)
select o_orderkey, y, rn <= floor(0.2 * n + 0.5) as is_test from r""")
def train_test_split(spark, sf):
    return S.train_test_split(orders_cls(spark, sf).select("o_orderkey", "y"), "o_orderkey", "y")


@REGISTRY.add("train_test_split_hash", f"select event_id, {sql_hash('event_id', 'split')} % 10000 < 2000 as is_test from events")
def train_test_split_hash(spark, sf):
    return S.train_test_split(table(spark, sf, "events").select("event_id"), "event_id")


@REGISTRY.add("kfold_assign", f"""with r as (
  select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus order by {sql_hash('o_orderkey', 'fold')}, o_orderkey) as rn,
    count(*) over (partition by o_orderstatus) as n from orders)
select o_orderkey, o_orderstatus, {" + ".join(f"cast(rn > floor(n * {j} / 5.0) as integer)" for j in range(1, 5))} as fold from r""")
def kfold_assign(spark, sf):
    return S.kfold_assign(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")


@REGISTRY.add("sample_rows", "select p_partkey, p_size from part order by md5('42' || cast(p_partkey as varchar)), p_partkey limit 100")
def sample_rows(spark, sf):
    return S.sample_rows(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")


@REGISTRY.add("sample_per_group", f"""with {TOPIC_SQL}, r as (select topic, doc_id, text,
  row_number() over (partition by topic order by md5('42' || cast(doc_id as varchar)), doc_id) as rank from docs where topic <> -1)
select topic, doc_id, cast(rank as integer) as rank, text from r where rank <= 3""")
def sample_per_group(spark, sf):
    df = C.filter_noise(docs_topic(spark, sf), "topic").select("topic", "doc_id", "text")
    return S.sample_per_group(df, ["topic"], "doc_id", 3, "text")


@REGISTRY.add("confusion_matrix", f"with {ORDERS_SQL} select y, pred, count(*) as n from ord group by 1, 2")
def confusion_matrix(spark, sf):
    return M.confusion_matrix(orders_cls(spark, sf), "y", "pred")


_STATUS = "select o_orderstatus as y, case when o_orderkey % 3 = 0 then 'F' when o_orderkey % 3 = 1 then 'O' else 'X' end as pred from orders"


@REGISTRY.add("classification_metrics", f"""with p as ({_STATUS}), k as (select distinct y as c from p),
 s as (select c, (select count(*) from p where y = c) as n, (select count(*) from p where pred = c) as m,
   (select count(*) from p where y = c and pred = c) as tp from k)
select round(sum(tp) / sum(n), 4) as accuracy, round(sum(n * case when m > 0 then tp / m else 0 end) / sum(n), 4) as "precision",
  round(sum(n * (tp / n)) / sum(n), 4) as recall, round(sum(n * (2 * tp / (n + m))) / sum(n), 4) as f1 from s""")
def classification_metrics(spark, sf):
    pred = F.expr("case when o_orderkey % 3 = 0 then 'F' when o_orderkey % 3 = 1 then 'O' else 'X' end")
    df = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("y"), pred.alias("pred"))
    return M.classification_metrics(df, "y", "pred").select(*[rnd(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


_AUC = """r as (select score, sum({p}) as p, sum(1 - {p}) as q from {t} group by 1),
 c as (select p, q, sum(q) over (order by score) - q as below from r)"""


@REGISTRY.add("roc_auc", f"""with {ORDERS_SQL}, {_AUC.format(p="y", t="ord")}
select cast(sum(p) as bigint) as positives, cast(sum(q) as bigint) as negatives, round(sum(p * (below + q / 2)) / sum(p) / sum(q), 6) as auc from c""")
def roc_auc(spark, sf):
    return M.roc_auc(orders_cls(spark, sf), "y", "score").withColumn("auc", rnd("auc", 6))


_CLASSES = ["F", "O", "P"]


@REGISTRY.add("roc_auc_weighted", "with o as (select o_orderstatus as y, " + ", ".join(
    f"(o_orderkey * {k} % 1000) / 1000.0 as s{i}" for i, k in enumerate((37, 41, 43))) + " from orders), a as (" + " union all ".join(
    f"""(with r as (select s{i} as score, sum(cast(y = '{c}' as integer)) as p, sum(cast(y <> '{c}' as integer)) as q from o group by 1),
      c as (select p, q, sum(q) over (order by score) - q as below from r) select sum(p) as n, sum(p * (below + q / 2)) / sum(p) / sum(q) as auc from c)"""
    for i, c in enumerate(_CLASSES)) + ") select round(sum(n * auc) / sum(n), 6) as auc from a")
def roc_auc_weighted(spark, sf):
    scores = F.array(*[F.expr(f"(o_orderkey * {k} % 1000) / 1000.0D") for k in (37, 41, 43)])
    df = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("y"), scores.alias("s"))
    return M.roc_auc_weighted(df, "y", "s", _CLASSES).select(rnd("auc", 6).alias("auc"))


@REGISTRY.add("regression_metrics", """
select round(sqrt(avg((p_retailprice - (900 + 10 * p_size)) ** 2)), 4) as rmse,
  round(1 - sum((p_retailprice - (900 + 10 * p_size)) ** 2) / (var_pop(p_retailprice) * count(*)), 4) as r2 from part""")
def regression_metrics(spark, sf):
    df = table(spark, sf, "part").select(F.col("p_retailprice").alias("y"), F.expr("900 + 10 * p_size").alias("pred"))
    return M.regression_metrics(df, "y", "pred").select(rnd("rmse").alias("rmse"), rnd("r2").alias("r2"))


@REGISTRY.add("top_k_importance", """
select p_brand as feature, round(avg(abs(p_retailprice - 1000)), 4) as mean_abs from part group by 1 order by avg(abs(p_retailprice - 1000)) desc, 1 limit 5""")
def top_k_importance(spark, sf):
    df = table(spark, sf, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.avg(F.abs(F.col("p_retailprice") - 1000)).alias("mean_abs"))
    return M.top_k_importance(df, "mean_abs").withColumn("mean_abs", rnd("mean_abs"))


@REGISTRY.add("cumulative_variance", """
with v as (select row_number() over (order by n desc, p) as component, n / sum(n) over () as ratio
  from (select p_type as p, cast(count(*) as double) as n from part group by 1)),
 c as (select component, ratio, sum(ratio) over (order by component) as cumulative from v)
select cast(component as integer) as component, round(ratio, 6) as ratio, round(cumulative, 6) as cumulative, cumulative - ratio < 0.8 as needed from c""")
def cumulative_variance(spark, sf):
    """Shares of the part types, largest first, as a variance table."""
    from pyspark.sql import Window

    from dataquarry.operators.cluster import cumulative_variance as accumulate

    n = table(spark, sf, "part").groupBy("p_type").agg(F.count(F.lit(1)).cast("double").alias("n"))
    shares = n.select(
        F.row_number().over(Window.orderBy(F.desc("n"), "p_type")).alias("component"),
        (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("ratio"),
    )
    return accumulate(shares).select("component", rnd("ratio", 6).alias("ratio"), rnd("cumulative", 6).alias("cumulative"), "needed")

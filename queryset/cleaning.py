"""Missing values, cleaning plans, and the choice of route."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataquarry.operators import clean as C
from dataquarry.operators import features as X
from dataquarry.operators import profile as P
from dataquarry.operators import route as R
from dataquarry.operators.sampling import train_test_split
from queryset.common import LI_SQL, Registry, li_nulls, rnd, sql_hash, table

REGISTRY = Registry()

_MEDIAN = "(select quantile_cont({c}, 0.5) from {t})"
_MODE = "(select arg_min(v, (-n, v)) from (select {c} as v, count(*) as n from {t} where {c} is not null group by 1))"


@REGISTRY.add("drop_high_missing", f"with {LI_SQL} select * exclude (l_discount) from li")
def drop_high_missing(spark, sf):
    return C.drop_high_missing(li_nulls(spark, sf))


@REGISTRY.add("impute_missing", f"""with {LI_SQL}
select * replace (
  coalesce(l_tax, {_MEDIAN.format(c="l_tax", t="li")}) as l_tax,
  coalesce(l_discount, {_MEDIAN.format(c="l_discount", t="li")}) as l_discount,
  coalesce(l_returnflag, {_MODE.format(c="l_returnflag", t="li")}) as l_returnflag) from li""")
def impute_missing(spark, sf):
    return C.impute_missing(li_nulls(spark, sf))


@REGISTRY.add("clean_table", f"""with {LI_SQL}
select * exclude (l_discount) replace (
  coalesce(l_tax, {_MEDIAN.format(c="l_tax", t="li")}) as l_tax,
  coalesce(l_returnflag, {_MODE.format(c="l_returnflag", t="li")}) as l_returnflag) from li""")
def clean_table(spark, sf):
    return C.clean_table(li_nulls(spark, sf))


@REGISTRY.add("apply_cleaning_plan", f"""with {LI_SQL}
select * exclude (l_discount) replace (
  coalesce(l_tax, {_MEDIAN.format(c="l_tax", t="li")}) as l_tax,
  coalesce(l_returnflag, {_MODE.format(c="l_returnflag", t="li")}) as l_returnflag) from li""")
def apply_cleaning_plan(spark, sf):
    plan = [
        ("l_discount", "drop"), ("l_tax", "impute_median"), ("l_returnflag", " Impute_Mode "), ("l_quantity", "scale"),
        ("l_linestatus", "encode"), ("l_shipdate", "keep"), ("no_such_column", "drop"), ("l_partkey", "polish"),
    ]
    return C.apply_cleaning_plan(li_nulls(spark, sf), plan)


_LI_TRAIN = f"{LI_SQL}, train as (select * from li where {sql_hash('l_orderkey', 'split')} % 10000 >= 2000)"


@REGISTRY.add("fit_impute", f"""with {_LI_TRAIN}
select l_orderkey, coalesce(l_tax, {_MEDIAN.format(c="l_tax", t="train")}) as l_tax,
  coalesce(l_returnflag, {_MODE.format(c="l_returnflag", t="train")}) as l_returnflag from li""")
def fit_impute(spark, sf):
    """Fills learnt on the training rows, applied to all rows."""
    df = train_test_split(li_nulls(spark, sf).select("l_orderkey", "l_tax", "l_returnflag"), "l_orderkey")
    fills = X.fit_impute(df.filter("not is_test"), ["l_tax"], ["l_returnflag"])
    return X.apply_impute(df, fills).drop("is_test")


@REGISTRY.add("safe_float", """
select event_id, case when user_id % 5 = 0 or user_id % 7 = 0 then null else value end as value from events""")
def safe_float(spark, sf):
    """Values made NaN or infinite by a rule on their user come back as null."""
    from dataquarry.functions.scalars import safe_float as safe

    broken = F.expr("case when user_id % 5 = 0 then double('NaN') when user_id % 7 = 0 then double('-Infinity') else value end")
    return table(spark, sf, "events").select("event_id", safe(broken).alias("value"))


_TEXT = "select avg(length({c})) > 50 from {t}"


def _route_sql(name, route_text, is_text, target, yes, no):
    return f"""select '{name}' as input, case when ({is_text}) then 'fase_3' else '{route_text}' end as route,
      '{target}' as target, case when ({is_text}) then '{yes}' else '{no}' end as reason"""


@REGISTRY.add("route_decision", " union all ".join([
    _route_sql("documents", "fase_2", "select false", "", "mostly free text", "no target, structured columns"),
    _route_sql("documents by text", "fase_1", _TEXT.format(c="text", t="documents"), "text", "free-text target", "structured target"),
    _route_sql("orders by status", "fase_1", _TEXT.format(c="o_orderstatus", t="orders"), "o_orderstatus", "free-text target", "structured target"),
    _route_sql("html", "fase_2", _TEXT.format(c="html", t="pages"), "", "mostly free text", "no target, structured columns"),
    _route_sql("benchmark", "fase_2", "select false", "", "mostly free text", "no target, structured columns"),
]))
def route_decision(spark, sf):
    docs, orders = table(spark, sf, "documents"), table(spark, sf, "orders")
    cases = [
        ("documents", R.route_decision(docs)),
        ("documents by text", R.route_decision(docs, "text")),
        ("orders by status", R.route_decision(orders, "o_orderstatus")),
        ("html", R.route_decision(table(spark, sf, "pages").select("html"))),
        ("benchmark", R.route_decision(table(spark, sf, "benchmark"))),
    ]
    out = None
    for name, df in cases:
        one = df.select(F.lit(name).alias("input"), "route", "target", "reason")
        out = one if out is None else out.unionByName(one)
    return out


@REGISTRY.add("infer_task_type", " union all ".join(
    f"""select '{c}' as target, count(distinct {c}) as cardinality,
      case when count(distinct {c}) < 15 then 'classification' else 'regression' end as task from {t}"""
    for c, t in (("o_orderstatus", "orders"), ("o_totalprice", "orders"), ("p_size", "part"), ("event_type", "events"))))
def infer_task_type(spark, sf):
    out = None
    for c, t in (("o_orderstatus", "orders"), ("o_totalprice", "orders"), ("p_size", "part"), ("event_type", "events")):
        one = R.infer_task_type(table(spark, sf, t), c)
        out = one if out is None else out.unionByName(one)
    return out


@REGISTRY.add("first_free_text_column", """
select case when avg(length(text)) > 50 then 'text' when avg(length(lang)) > 50 then 'lang'
  when avg(length(source)) > 50 then 'source' else 'doc_id' end as "column" from documents""")
def first_free_text_column(spark, sf):
    return R.first_free_text_column(P.infer_semantic_type(table(spark, sf, "documents")))


@REGISTRY.add("robust_scale", """
with q as (select quantile_cont(p_size, 0.25) as a1, quantile_cont(p_size, 0.5) as a2, quantile_cont(p_size, 0.75) as a3,
  quantile_cont(p_retailprice, 0.25) as b1, quantile_cont(p_retailprice, 0.5) as b2, quantile_cont(p_retailprice, 0.75) as b3 from part)
select p_partkey, round((p_size - a2) / case when a3 = a1 then 1 else a3 - a1 end, 4) as p_size,
  round((p_retailprice - b2) / case when b3 = b1 then 1 else b3 - b1 end, 4) as p_retailprice from part, q""")
def robust_scale(spark, sf):
    df = X.robust_scale(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return df.select("p_partkey", rnd("p_size").alias("p_size"), rnd("p_retailprice").alias("p_retailprice"))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@REGISTRY.add("one_hot", """
with train as (select distinct c_mktsegment from customer where c_mktsegment <> 'MACHINERY')
select c_custkey, """ + ", ".join(
    f"cast(c_mktsegment = '{s}' and c_mktsegment in (select c_mktsegment from train) as double) as {s.lower()}" for s in _SEGMENTS[:4]
) + ", 4 as n_slots from customer")
def one_hot(spark, sf):
    """Fitted without one segment: its rows get zeros."""
    from pyspark.ml.functions import vector_to_array

    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    model = X.one_hot(df.filter("c_mktsegment <> 'MACHINERY'"), ["c_mktsegment"])
    hot = vector_to_array(F.col("c_mktsegment__hot"))
    return model.transform(df).select(
        "c_custkey", *[hot[i].alias(s.lower()) for i, s in enumerate(_SEGMENTS[:4])], F.size(hot).alias("n_slots")
    )


@REGISTRY.add("label_encode", """
select o_orderkey, cast(dense_rank() over (order by o_orderpriority) - 1 as integer) as label from orders""")
def label_encode(spark, sf):
    return X.label_encode(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority").select("o_orderkey", "label")


@REGISTRY.add("baseline_predictor", """
with m as (select arg_min(v, (-n, v)) as mode from (select o_orderstatus as v, count(*) as n from orders group by 1)),
 d as (select quantile_cont(o_totalprice, 0.5) as med from orders)
select o_orderkey, mode as by_class, med as by_median from orders, m, d""")
def baseline_predictor(spark, sf):
    from dataquarry.operators.metrics import baseline_predictor as predict

    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    first = predict(df, df, "o_orderstatus", "classification").withColumnRenamed("prediction", "by_class")
    return predict(df, first, "o_totalprice", "regression").select("o_orderkey", "by_class", F.col("prediction").alias("by_median"))

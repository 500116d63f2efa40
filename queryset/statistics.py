"""Tests, correlations and collinearity; the SQL checks the statistics, unit tests the p-values."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataquarry.operators import stats as S
from queryset.common import LI_SQL, ORDERS_SQL, Registry, li_nulls, orders_cls, rnd, table, unpivot_sql

REGISTRY = Registry()


def _anova_sql(cells: str, prefix: str = "with") -> str:
    """F statistic from ``cells(feature, grp, x)``."""
    return f"""{prefix} cells as ({cells}),
  g as (select feature, grp, count(x) as n, avg(x) as m, var_samp(x) as v from cells group by 1, 2),
  t as (select feature, sum(n) as total, count(*) as k, min(n) as least, sum(n * m) / sum(n) as grand from g group by 1),
  s as (select g.feature, any_value(total) as total, any_value(k) as k, any_value(least) as least,
    sum(n * (m - grand) * (m - grand)) as ssb, sum((n - 1) * coalesce(v, 0)) as ssw from g join t using (feature) group by 1)
select feature, 'anova' as test, case when least > 0 and k > 1 and ssw > 0 then round((ssb / (k - 1)) / (ssw / (total - k)), 4) end as stat,
  cast(k - 1 as integer) as dof1, cast(total - k as bigint) as dof2 from s"""


def _rounded(df):
    return df.withColumn("stat", rnd("stat"))


@REGISTRY.add("crosstab", f"""with {LI_SQL} select l_returnflag, l_linestatus, count(*) as n from li
where l_returnflag is not null and l_linestatus is not null group by 1, 2""")
def crosstab(spark, sf):
    return S.crosstab(li_nulls(spark, sf), "l_returnflag", "l_linestatus")


@REGISTRY.add("class_distribution", "select o_orderpriority, count(*) as n from orders group by 1")
def class_distribution(spark, sf):
    return S.class_distribution(table(spark, sf, "orders"), "o_orderpriority")


_LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@REGISTRY.add("anova_by_class", _anova_sql(
    unpivot_sql("li", _LI_NUM, keep="l_returnflag as grp, ") .replace("from li", "from li where l_returnflag is not null"),
    f"with {LI_SQL},"))
def anova_by_class(spark, sf):
    return _rounded(S.anova_by_class(li_nulls(spark, sf), "l_returnflag", _LI_NUM))


@REGISTRY.add("anova_by_category", _anova_sql(" union all ".join(
    f"select '{c}' as feature, {c} as grp, f as x from ord" for c in ("o_orderstatus", "o_orderpriority")), f"with {ORDERS_SQL},"))
def anova_by_category(spark, sf):
    return _rounded(S.anova_by_category(orders_cls(spark, sf), "f", ["o_orderstatus", "o_orderpriority"]))


def _pearson_sql(c, y, t):
    return f"""select '{c}' as feature, 'pearson' as test, round(corr({c}, {y}), 4) as r,
      round(corr({c}, {y}) * sqrt((count(*) - 2) / (1 - corr({c}, {y}) * corr({c}, {y}))), 2) as stat,
      1 as dof1, count(*) - 2 as dof2 from {t} where {c} is not null and {y} is not null"""


@REGISTRY.add("pearson_target", f"with {LI_SQL} " + " union all ".join(
    _pearson_sql(c, "l_extendedprice", "li") for c in ("l_quantity", "l_discount", "l_tax")))
def pearson_target(spark, sf):
    out = S.pearson_target(li_nulls(spark, sf), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return out.withColumns({"r": rnd("r"), "stat": rnd("stat", 2)})


_CHI2 = f"""with {ORDERS_SQL}, cells as (
  select 'o_orderstatus' as feature, o_orderstatus as a, y as b, count(*) as o from ord group by 2, 3 union all
  select 'o_orderpriority', o_orderpriority, y, count(*) from ord group by 2, 3 union all
  select 'pred', cast(pred as varchar), y, count(*) from ord group by 2, 3),
 r as (select feature, a, sum(o) as r from cells group by 1, 2), c as (select feature, b, sum(o) as c from cells group by 1, 2),
 k as (select feature, (select count(*) from r where r.feature = f.feature) as nr, (select count(*) from c where c.feature = f.feature) as nc,
   (select sum(o) from cells where cells.feature = f.feature) as n from (select distinct feature from cells) f),
 grid as (select r.feature, r.r * c.c / n as e, coalesce(o, 0) as o, (nr - 1) * (nc - 1) as dof, n from r join c using (feature)
   join k using (feature) left join cells on cells.feature = r.feature and cells.a = r.a and cells.b = c.b)
select feature, 'chi2' as test, round(sum(case when dof = 1 then (abs(o - e) - least(0.5, abs(o - e))) ** 2 / e else (o - e) ** 2 / e end), 4) as stat,
  cast(any_value(dof) as integer) as dof1, cast(any_value(n) as bigint) as dof2 from grid group by feature"""


@REGISTRY.add("chi2_independence", _CHI2)
def chi2_independence(spark, sf):
    df = orders_cls(spark, sf).withColumn("pred", F.col("pred").cast("string"))
    return _rounded(S.chi2_independence(df, "y", ["o_orderstatus", "o_orderpriority", "pred"]))


@REGISTRY.add("select_by_pvalue")
def select_by_pvalue(spark, sf):
    return S.select_by_pvalue(orders_cls(spark, sf).drop("o_orderkey"), "y", "classification")


# Critical values at 5 %: z^2 with its first correction for F(1, d), and chi-squared by its degrees of freedom.
_APPROVED = """case when test = 'anova' then stat > 3.8415 + 9.3 / dof2 else stat > case dof1 when 1 then 3.8415 when 2 then 5.9915
  when 3 then 7.8147 when 4 then 9.4877 when 5 then 11.0705 else 12.5916 end end"""


@REGISTRY.add("select_by_pvalue_approved", f"""with a as ({_anova_sql(
    unpivot_sql("ord", ["o_custkey", "o_totalprice", "f", "score", "pred"], keep="y as grp, "), f"with {ORDERS_SQL},")}), c as ({_CHI2}),
 t as (select * from a union all select * from c where feature <> 'pred'),
 names as (select unnest(['o_custkey', 'o_orderstatus', 'o_orderpriority', 'o_totalprice', 'f', 'score', 'pred']) as feature, unnest(range(1, 8)) as ordinal)
select feature, cast(ordinal as integer) as ordinal, test, stat, coalesce({_APPROVED}, false) as approved from names left join t using (feature)""")
def select_by_pvalue_approved(spark, sf):
    """The statistics and the verdicts of the selection."""
    out = S.select_by_pvalue(orders_cls(spark, sf).drop("o_orderkey"), "y", "classification")
    return _rounded(out).select("feature", "ordinal", "test", "stat", "approved")


@REGISTRY.add("hypothesis_tests", _anova_sql(
    unpivot_sql("ord", ["o_custkey", "o_totalprice", "f", "score", "pred"], keep="y as grp, "), f"with {ORDERS_SQL},"))
def hypothesis_tests(spark, sf):
    """The statistics behind the selection, for the numeric features."""
    df = orders_cls(spark, sf).select("o_custkey", "o_totalprice", "f", "score", "pred", "y")
    return _rounded(S.hypothesis_tests(df, "y", "classification"))


@REGISTRY.add("correlation_matrix", "with p as (select l_quantity, l_extendedprice, l_discount, l_tax from lineitem) " + " union all ".join(
    f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 4) as r from p" for a in _LI_NUM for b in _LI_NUM))
def correlation_matrix(spark, sf):
    return S.correlation_matrix(table(spark, sf, "lineitem"), _LI_NUM).withColumn("r", rnd("r"))


@REGISTRY.add("vif_scores", """
select 'p_size' as feature, round(1 / (1 - corr(p_size, p_retailprice) ** 2), 4) as vif from part
union all select 'p_retailprice', round(1 / (1 - corr(p_size, p_retailprice) ** 2), 4) from part""")
def vif_scores(spark, sf):
    return S.vif_scores(table(spark, sf, "part"), ["p_size", "p_retailprice"]).withColumn("vif", rnd("vif"))


_DOC_VIF = "with d as (select n_chars, length(text) as n_text, doc_id % 100 as bucket from documents) "


@REGISTRY.add("vif_prune", _DOC_VIF + """
select 'n_chars' as feature, cast('inf' as double) as vif, cast(0.9 as double) as p, 1 as removed_at
union all select 'n_text', round(1 / (1 - corr(n_text, bucket) ** 2), 4), cast(0.2 as double), null from d
union all select 'bucket', round(1 / (1 - corr(n_text, bucket) ** 2), 4), cast(0.5 as double), null from d""")
def vif_prune(spark, sf):
    """The text length appears twice; of the two copies the one with the larger p goes."""
    df = table(spark, sf, "documents").select("n_chars", F.length("text").alias("n_text"), F.expr("doc_id % 100").alias("bucket"))
    out = S.vif_prune(df, df.columns, {"n_chars": 0.9, "n_text": 0.2, "bucket": 0.5})
    return out.withColumn("vif", rnd("vif"))


@REGISTRY.add("vif_candidate", """
with c as (select 'p_size' as feature, round(1 / (1 - corr(p_size, p_retailprice) ** 2), 4) as vif, cast(0.3 as double) as p from part
union all select 'p_retailprice', round(1 / (1 - corr(p_size, p_retailprice) ** 2), 4), cast(0.7 as double) from part)
select * from c order by p desc, vif desc, feature limit 1""")
def vif_candidate(spark, sf):
    p = F.when(F.col("feature") == "p_size", 0.3).otherwise(0.7)
    return S.vif_candidate(vif_scores(spark, sf).withColumn("p", p))


@REGISTRY.add("lookup_pvalues", f"""with {LI_SQL}, n as ({unpivot_sql("li", _LI_NUM)}),
 t as (select feature, avg(case when x is null then 1.0 else 0 end) as p from n group by 1)
select feature, round(case when p > 0 then p else 1.0 end, 4) as p from t""")
def lookup_pvalues(spark, sf):
    """Features with a value in the lookup table, and 1.0 for the others."""
    from dataquarry.operators.profile import profile_nulls

    shares = profile_nulls(li_nulls(spark, sf).select(*_LI_NUM)).select(F.col("column").alias("feature"), (F.col("nulls") / F.col("total")).alias("p"))
    return S.lookup_pvalues(shares.select("feature"), shares.filter("p > 0")).withColumn("p", rnd("p"))


@REGISTRY.add("lowest_p_feature", f"""with {LI_SQL}, n as ({unpivot_sql("li", _LI_NUM)}),
 t as (select feature, avg(case when x is null then 1.0 else 0 end) as p from n group by 1)
select arg_min(feature, (p, case feature {" ".join(f"when '{c}' then {i}" for i, c in enumerate(_LI_NUM, 1))} end)) as feature, round(min(p), 4) as p from t""")
def lowest_p_feature(spark, sf):
    from dataquarry.operators.profile import profile_nulls

    shares = profile_nulls(li_nulls(spark, sf).select(*_LI_NUM)).select(
        F.col("column").alias("feature"), (F.col("nulls") / F.col("total")).alias("p"),
        F.array_position(F.array(*map(F.lit, _LI_NUM)), F.col("column")).alias("ordinal"),
    )
    return S.lowest_p_feature(shares).withColumn("p", rnd("p"))


# Fold scores of two models, from the data: mean prices per fold.
SCORES_SQL = """scores as (
  select 'gradient_boosting' as model, cast(o_orderkey % 5 as integer) as fold, avg(o_totalprice) / 1000 as score from orders group by 2
  union all select 'linear', cast(o_orderkey % 5 as integer), avg(o_totalprice + o_custkey % 100) / 1000 from orders group by 2)"""


def fold_scores(spark, sf):
    o = table(spark, sf, "orders").withColumn("fold", F.expr("cast(o_orderkey % 5 as int)"))
    a = o.groupBy("fold").agg((F.avg("o_totalprice") / 1000).alias("score")).withColumn("model", F.lit("gradient_boosting"))
    b = o.groupBy("fold").agg((F.avg(F.expr("o_totalprice + o_custkey % 100")) / 1000).alias("score")).withColumn("model", F.lit("linear"))
    return a.unionByName(b).select("model", "fold", "score")


_T_SQL = f"""with {SCORES_SQL}, d as (
  select fold, max(score) filter (where model = 'gradient_boosting') - max(score) filter (where model = 'linear') as d from scores group by 1),
 t as (select avg(d) / (stddev_samp(d) / sqrt(count(*))) as t, count(*) - 1 as dof from d)"""


@REGISTRY.add("paired_ttest", _T_SQL + " select 'paired_t' as test, round(t, 2) as stat, 1 as dof1, dof as dof2 from t")
def paired_ttest(spark, sf):
    return S.paired_ttest(fold_scores(spark, sf), "gradient_boosting", "linear").withColumn("stat", rnd("stat", 2))


@REGISTRY.add("select_model", _T_SQL + """ select round(t, 2) as stat,
  case when abs(t) >= 2.776445 then 'gradient_boosting' else 'linear' end as winner from t""")
def select_model(spark, sf):
    from dataquarry.operators.supervised import select_model as select

    return select(fold_scores(spark, sf)).select(rnd("stat", 2).alias("stat"), "winner")


@REGISTRY.add("cv_summary", f"with {SCORES_SQL} select model, round(avg(score), 4) as mean, round(stddev_pop(score), 4) as std from scores group by 1")
def cv_summary(spark, sf):
    from dataquarry.operators.metrics import cv_summary as summarise

    return summarise(fold_scores(spark, sf)).select("model", rnd("mean").alias("mean"), rnd("std").alias("std"))

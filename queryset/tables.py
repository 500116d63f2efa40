"""Reading, writing, masking, selecting and profiling."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from dataquarry.functions.scalars import metadata_json, parse_metadata
from dataquarry.operators import columns as C
from dataquarry.operators import profile as P
from dataquarry.operators.features import build_preprocessor
from dataquarry.runtime import new_path
from dataquarry.sources import checkpoints as K
from dataquarry.sources import tables as S
from queryset.common import LI_SQL, Registry, li_nulls, rnd, table

REGISTRY = Registry()
LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


@REGISTRY.add("scan_parquet", "select * from part")
def scan_parquet(spark, sf):
    return S.scan_parquet(spark, f"{sf}/part.parquet")


def _csv(spark, df, name, sep):
    path = new_path(spark, name) + ".csv"
    df.write.csv(path, sep=sep, header=True)
    return path


@REGISTRY.add("scan_csv_sniffed", """
select cast(s_suppkey as varchar) as s_suppkey, s_name, cast(s_nationkey as varchar) as s_nationkey,
  cast(s_acctbal as varchar) as s_acctbal from supplier""")
def scan_csv_sniffed(spark, sf):
    return S.scan_csv_sniffed(spark, _csv(spark, table(spark, sf, "supplier"), "supplier", ";"))


@REGISTRY.add("scan_csv_messy", """
select cast(s_suppkey as varchar) as id, s_name || chr(10) || 'said "' || cast(s_nationkey as varchar) || '"' as note,
  case when s_suppkey % 5 = 0 then null else cast(s_acctbal as varchar) end as "id.1" from supplier where s_suppkey % 7 <> 0""")
def scan_csv_messy(spark, sf):
    """Quoted line breaks and quotes, rows that are too short or too long, a repeated name."""
    note = F.concat(F.lit('"'), "s_name", F.lit('\nsaid ""'), F.col("s_nationkey").cast("string"), F.lit('"""'))
    short = F.concat_ws(";", F.col("s_suppkey").cast("string"), note)
    full = F.concat_ws(";", short, F.col("s_acctbal").cast("string"))
    line = F.when(F.expr("s_suppkey % 7 = 0"), F.concat_ws(";", full, F.lit("more"))).when(F.expr("s_suppkey % 5 = 0"), short).otherwise(full)
    lines = table(spark, sf, "supplier").select("s_suppkey", line.alias("value"))
    head = spark.createDataFrame([(-1, "id;note;id")], "s_suppkey bigint, value string")
    path = new_path(spark, "messy") + ".csv"
    head.union(lines).coalesce(1).sortWithinPartitions("s_suppkey").select("value").write.text(path)
    return S.scan_csv_sniffed(spark, path)


@REGISTRY.add("infer_types", """
select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey,
  case when c_custkey % 7 = 0 then null else c_acctbal end as c_acctbal,
  c_custkey % 2 = 0 as even, c_mktsegment from customer""")
def infer_types(spark, sf):
    df = table(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_nationkey",
        F.expr("case when c_custkey % 7 = 0 then 'NA' else cast(c_acctbal as string) end").alias("c_acctbal"),
        F.expr("c_custkey % 2 = 0").alias("even"), "c_mktsegment",
    )
    return S.infer_types(S.scan_csv_sniffed(spark, _csv(spark, df, "customer", "\t")))


def _workbook(rows: pd.DataFrame) -> bytes:
    """A minimal .xlsx file with inline strings."""
    def cell(v):
        return "<c t='inlineStr'><is><t>" + str(v) + "</t></is></c>"

    lines = ["".join(cell(c) for c in rows.columns)] + ["".join(cell(v) for v in r) for r in rows.itertuples(index=False)]
    sheet = "<worksheet xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'><sheetData>"
    sheet += "".join(f"<row>{x}</row>" for x in lines) + "</sheetData></worksheet>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", sheet)
    return out.getvalue()


@REGISTRY.add("scan_excel", "select s_suppkey, s_name, cast(s_nationkey as bigint) as s_nationkey, s_acctbal from supplier")
def scan_excel(spark, sf):
    """The supplier table as workbooks of up to 200 rows, parsed back."""
    def pack(part: pd.DataFrame) -> pd.DataFrame:
        book = part["book"].iloc[0]
        return pd.DataFrame({"path": [f"book{book}.xlsx"], "content": [_workbook(part.drop(columns="book").sort_values("s_suppkey"))]})

    rows = table(spark, sf, "supplier").withColumn("book", F.expr("s_suppkey div 200"))
    books = rows.groupBy("book").applyInPandas(pack, "path string, content binary")
    return S.workbook_table(S.parse_workbooks(books))


@REGISTRY.add("scan_auto", """
select 'csv' as kind, s_suppkey, s_name, cast(s_nationkey as bigint) as s_nationkey, s_acctbal from supplier
union all select 'parquet', s_suppkey, s_name, cast(s_nationkey as bigint), s_acctbal from supplier""")
def scan_auto(spark, sf):
    df = table(spark, sf, "supplier")
    parquet = new_path(spark, "supplier") + ".parquet"
    df.write.parquet(parquet)
    read = lambda p, kind: S.scan_auto(spark, p).withColumns({"kind": F.lit(kind), "s_nationkey": F.col("s_nationkey").cast("bigint")})
    return read(parquet, "parquet").unionByName(read(_csv(spark, df, "supplier", ","), "csv"))


@REGISTRY.add("checkpoint_write", "select * from orders")
def checkpoint_write(spark, sf):
    data, _ = K.checkpoint_write(table(spark, sf, "orders"), new_path(spark, "runs"), "demo", " Fase 0 Clean ", {"route": "fase_1"})
    return spark.read.parquet(data)


@REGISTRY.add("checkpoint_read", "select *, 'fase_1' as route, 5 as n_columns from customer")
def checkpoint_read(spark, sf):
    root, df = new_path(spark, "runs"), table(spark, sf, "customer")
    K.checkpoint_write(df, root, "demo", "fase_0_clean", {"route": "fase_1", "columns": df.columns})
    back, meta = K.checkpoint_read(spark, root, "demo", "fase_0_clean")
    return back.withColumns({"route": F.lit(meta["route"]), "n_columns": F.lit(len(meta["columns"]))})


@REGISTRY.add("model_save", """
with m as (select regr_slope(p_retailprice, p_size) as b, regr_intercept(p_retailprice, p_size) as a from part)
select p_partkey, round(a + b * p_size, 4) as prediction from part, m""")
def model_save(spark, sf):
    df = table(spark, sf, "part")
    prep, _ = build_preprocessor(df, ["p_size"], [])
    line = LinearRegression(featuresCol="features", labelCol="p_retailprice")
    path = K.model_save(Pipeline(stages=[prep, line]).fit(df), new_path(spark, "model"))
    return K.model_load(path).transform(df).select("p_partkey", rnd("prediction").alias("prediction"))


@REGISTRY.add("metadata_sink", """
select 'c_custkey' as "column", count(*) as total, count(distinct c_custkey) as cardinality from customer
union all select 'c_name', count(*), count(distinct c_name) from customer
union all select 'c_nationkey', count(*), count(distinct c_nationkey) from customer
union all select 'c_acctbal', count(*), count(distinct c_acctbal) from customer
union all select 'c_mktsegment', count(*), count(distinct c_mktsegment) from customer""")
def metadata_sink(spark, sf):
    path = new_path(spark, "metadata")
    K.write_metadata(P.profile_table(table(spark, sf, "customer")), path)
    return K.read_metadata(spark, path, "column string, total bigint, cardinality bigint")


@REGISTRY.add("metadata_json", """
select event_id, cast(json_extract(props, '$.k') as bigint) as k, event_type from events""")
def metadata_json_query(spark, sf):
    """Props and type packed into one JSON document and read back."""
    df = table(spark, sf, "events").select("event_id", parse_metadata(F.col("props"), "k bigint").alias("p"), "event_type")
    packed = df.select("event_id", metadata_json(F.col("p.k").alias("k"), F.col("event_type")).alias("m"))
    back = packed.select("event_id", parse_metadata(F.col("m"), "k bigint, event_type string").alias("m"))
    return back.select("event_id", "m.k", "m.event_type")


@REGISTRY.add("mask_columns", """
select c_custkey as Var_01, c_name as Var_02, c_nationkey as Var_03, c_acctbal as Var_04, c_mktsegment as Var_05 from customer""")
def mask_columns(spark, sf):
    return C.mask_columns(table(spark, sf, "customer"))[0]


@REGISTRY.add("unmask_columns", f"""with {LI_SQL}
select 'l_tax' as "column", count(*) - count(l_tax) as nulls from li union all
select 'l_discount', count(*) - count(l_discount) from li union all
select 'l_returnflag', count(*) - count(l_returnflag) from li""")
def unmask_columns(spark, sf):
    masked, names = C.mask_columns(li_nulls(spark, sf).select("l_tax", "l_discount", "l_returnflag"))
    return C.unmask_values(P.profile_nulls(masked).select("column", "nulls"), "column", names)


@REGISTRY.add("select_numeric", "select o_orderkey, o_custkey, o_totalprice from orders")
def select_numeric(spark, sf):
    return C.select_numeric(table(spark, sf, "orders"))


@REGISTRY.add("select_categorical", "select o_orderstatus, o_orderdate, o_orderpriority from orders")
def select_categorical(spark, sf):
    return C.select_categorical(table(spark, sf, "orders"))


@REGISTRY.add("split_features_target", "select p_partkey, p_name, p_brand, p_type, p_size from part")
def split_features_target(spark, sf):
    return C.split_features_target(table(spark, sf, "part"), "p_retailprice")[0]


@REGISTRY.add("prune_to_features", "select o_orderkey, o_totalprice, o_orderstatus from orders")
def prune_to_features(spark, sf):
    return C.prune_to_features(table(spark, sf, "orders"), ["o_totalprice"], ["o_orderstatus"], keep=["o_orderkey"])


@REGISTRY.add("split_inliers_outliers", """
select event_id, value, cast(null as integer) as __anomaly__ from events where not value > 100
union all select event_id, value, -1 from events where value > 100""")
def split_inliers_outliers(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value", F.expr("case when value > 100 then -1 else 1 end").alias("label"))
    inliers, outliers = C.split_inliers_outliers(df, "label")
    return inliers.unionByName(outliers, allowMissingColumns=True)


@REGISTRY.add("union_inliers_outliers", """
select event_id, event_type, case when value > 100 then -1 else cast(user_id % 3 as integer) end as Cluster_ID,
  case when value > 100 then -1 end as __anomaly__ from events""")
def union_inliers_outliers(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type", "user_id", F.expr("case when value > 100 then -1 else 1 end").alias("label"))
    inliers, outliers = C.split_inliers_outliers(df, "label")
    clustered = inliers.withColumn("Cluster_ID", F.expr("cast(user_id % 3 as int)"))
    return C.union_inliers_outliers(clustered, outliers).drop("user_id")


@REGISTRY.add("drop_null_rows", f"with {LI_SQL} select * from li where l_tax is not null and l_returnflag is not null")
def drop_null_rows(spark, sf):
    return C.drop_null_rows(li_nulls(spark, sf), ["l_tax", "l_returnflag"])


@REGISTRY.add("pairwise_not_null", f"""with {LI_SQL}
select l_orderkey, l_tax, l_discount from li where l_tax is not null and l_discount is not null""")
def pairwise_not_null(spark, sf):
    return C.pairwise_not_null(li_nulls(spark, sf).select("l_orderkey", "l_tax", "l_discount"), "l_tax", "l_discount")


@REGISTRY.add("column_set_diff", f"""with {LI_SQL}, f as (
  select * from (values {", ".join(f"('{c}')" for c in LINEITEM)}) v(feature))
select feature from f where feature in (
  select 'l_discount' from li having avg(case when l_discount is null then 1.0 else 0 end) > 0.6
  union all select 'l_tax' from li having avg(case when l_tax is null then 1.0 else 0 end) > 0.6
  union all select 'l_returnflag' from li having avg(case when l_returnflag is null then 1.0 else 0 end) > 0.6)""")
def column_set_diff(spark, sf):
    """Columns lost to the missing-value rule."""
    nulls = P.profile_nulls(li_nulls(spark, sf)).withColumnRenamed("column", "feature")
    return C.column_set_diff(nulls, nulls.filter("pct_nulls <= 60"))


_PROFILE_NULLS = " union all ".join(
    f"""select '{c}' as "column", count(*) as total, count(*) - count({c}) as nulls,
    round(100.0 * (count(*) - count({c})) / count(*), 4) as pct_nulls, count(distinct {c}) as cardinality from li"""
    for c in LINEITEM
)


@REGISTRY.add("profile_nulls", f"with {LI_SQL} {_PROFILE_NULLS}")
def profile_nulls(spark, sf):
    return P.profile_nulls(li_nulls(spark, sf))


_NUMERIC = [c for c in LINEITEM if c not in ("l_returnflag", "l_linestatus", "l_shipdate")]


@REGISTRY.add("profile_numeric", f"with {LI_SQL} " + " union all ".join(
    f"""select '{c}' as "column", round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std,
    round(skewness({c}), 4) as skewness, round(kurtosis({c}), 4) as kurtosis from li""" for c in _NUMERIC))
def profile_numeric(spark, sf):
    return P.profile_numeric(li_nulls(spark, sf)).select(
        "column", *[rnd(c).alias(c) for c in ("mean", "std", "skewness", "kurtosis")]
    )


def _mode_sql(column, source):
    return f"""select '{column}' as "column", count(*) as cardinality, arg_min(v, (-n, v)) as mode, max(n) as mode_count
    from (select cast({column} as varchar) as v, count(*) as n from {source} where {column} is not null group by 1)"""


@REGISTRY.add("profile_categorical", f"with {LI_SQL} " + " union all ".join(
    f"({_mode_sql(c, 'li')})" for c in ("l_returnflag", "l_linestatus", "l_shipdate")))
def profile_categorical(spark, sf):
    return P.profile_categorical(li_nulls(spark, sf))


def _tipo_sql(source, column):
    return f"case when avg(length({column})) > 50 then 'Texto Libre' else 'Categórico' end as tipo from {source}"


@REGISTRY.add("infer_semantic_type", f"""
select 1 as ordinal, 'page_id' as "column", 'Numérico' as tipo
union all select 2, 'url', {_tipo_sql("pages", "url")}
union all select 3, 'html', {_tipo_sql("pages", "html")}""")
def infer_semantic_type(spark, sf):
    return P.infer_semantic_type(table(spark, sf, "pages"))


def _profile_sql(source, columns):
    parts = []
    for i, (c, kind) in enumerate(columns, 1):
        head = f"""select {i} as ordinal, '{c}' as "column", 'Var_{i:02d}' as masked"""
        base = f"""count(*) as total, count(*) - count({c}) as nulls,
          round(100.0 * (count(*) - count({c})) / count(*), 4) as pct_nulls, count(distinct {c}) as cardinality"""
        if kind == "n":
            parts.append(f"""{head}, 'Numérico' as tipo, {base}, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std,
              round(skewness({c}), 4) as skewness, round(kurtosis({c}), 4) as kurtosis,
              cast(null as varchar) as mode, cast(null as bigint) as mode_count from {source}""")
        else:
            tipo = f"case when avg(length(cast({c} as varchar))) > 50 then 'Texto Libre' else 'Categórico' end"
            parts.append(f"""{head}, {tipo} as tipo, {base}, null as mean, null as std, null as skewness, null as kurtosis,
              (select mode from ({_mode_sql(c, source)})) as mode, (select mode_count from ({_mode_sql(c, source)})) as mode_count
              from {source}""")
    return " union all ".join(parts)


def rounded_profile(df):
    moments = ("mean", "std", "skewness", "kurtosis")
    return P.profile_table(df).withColumns({c: rnd(c) for c in moments})


@REGISTRY.add("profile_table", f"with {LI_SQL} " + _profile_sql("li", [(c, "n" if c in _NUMERIC else "c") for c in LINEITEM]))
def profile_table(spark, sf):
    return rounded_profile(li_nulls(spark, sf))


@REGISTRY.add("profile_long_text", _profile_sql("conversations", [("conv_id", "n"), ("turn", "n"), ("role", "c"), ("text", "c")]))
def profile_long_text(spark, sf):
    """The same profile on a table with a free-text column."""
    return rounded_profile(table(spark, sf, "conversations"))

"""Shared pieces: reading the tables, and derived inputs written the same way in both languages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dataquarry.sources.tables import scan_parquet


class Registry(dict):
    """``name -> (callable, SQL or None)``."""

    def add(self, name: str, sql: str | None = None) -> Callable:
        def keep(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
            self[name] = (run, sql)
            return run

        return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return scan_parquet(spark, f"{sf}/{name}.parquet")


def rnd(c: Column | str, digits: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# lineitem with nulls: about 14 % of l_tax, 9 % of l_returnflag, 70 % of l_discount.
LI_SQL = """li as (
  select * replace (
    case when l_orderkey % 7 = 0 then null else l_tax end as l_tax,
    case when l_partkey % 11 = 0 then null else l_returnflag end as l_returnflag,
    case when l_suppkey % 10 < 7 then null else l_discount end as l_discount)
  from lineitem)"""


def li_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").withColumns({
        "l_tax": F.expr("case when l_orderkey % 7 = 0 then null else l_tax end"),
        "l_returnflag": F.expr("case when l_partkey % 11 = 0 then null else l_returnflag end"),
        "l_discount": F.expr("case when l_suppkey % 10 < 7 then null else l_discount end"),
    })


# orders with a class, a feature that follows it, and a fixed score and prediction.
ORDERS_SQL = """ord as (
  select o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice,
    cast(o_totalprice > 200000 as integer) as y,
    o_totalprice + o_custkey as f,
    (o_orderkey * 37 % 1000) / 1000.0 as score,
    cast((o_orderkey * 37 % 1000) / 1000.0 > 0.5 as integer) as pred
  from orders)"""


def orders_cls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice",
        F.expr("cast(o_totalprice > 200000 as int)").alias("y"),
        F.expr("o_totalprice + o_custkey").alias("f"),
        F.expr("(o_orderkey * 37 % 1000) / 1000.0D").alias("score"),
        F.expr("cast((o_orderkey * 37 % 1000) / 1000.0D > 0.5D as int)").alias("pred"),
    )


# documents with a topic taken from their source; every tenth document is noise.
TOPIC_SQL = """docs as (
  select *, case when doc_id % 10 = 0 then -1 else cast(regexp_extract(source, '([0-9]+)$', 1) as integer) end as topic
  from documents)"""


def docs_topic(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").withColumn(
        "topic", F.expr("case when doc_id % 10 = 0 then -1 else cast(regexp_extract(source, '([0-9]+)$', 1) as int) end")
    )


# Text cleaning, token by token, on ``{t}``.
SQL_SPACE = (
    "chr(11)||chr(28)||chr(29)||chr(30)||chr(31)||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)"
    "||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"
)


def sql_words(text: str) -> str:
    """DuckDB: the cleaned words of a text, by replacing and splitting."""
    plain = f"translate(lower(coalesce({text}, '')), {SQL_SPACE}, repeat(' ', 24))"
    no_url = f"regexp_replace({plain}, 'http\\S+|www\\.\\S+', ' ', 'g')"
    no_mail = f"regexp_replace({no_url}, '\\S+@\\S+', ' ', 'g')"
    letters = f"regexp_replace({no_mail}, '[^a-záéíóúüñ0-9]+', ' ', 'g')"
    return f"list_filter(string_split({letters}, ' '), lambda w: w <> '' and not regexp_full_match(w, '[0-9]+'))"


def sql_hash(key: str, salt: str = "") -> str:
    return f"cast('0x' || substr(md5('{salt}' || cast({key} as varchar)), 1, 8) as bigint)"


def unpivot_sql(source: str, columns: list[str], value: str = "double", keep: str = "") -> str:
    """Long form of some columns in SQL."""
    return " union all ".join(f"select {keep}'{c}' as feature, cast({c} as {value}) as x from {source}" for c in columns)

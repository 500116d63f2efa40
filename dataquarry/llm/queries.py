"""The registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataquarry.llm import bpe, htmltext, langid, minhash, periods, simhash, toxicity, urlfilter, warc
from dataquarry.llm.common import shared_path, source, written
from dataquarry.llm.decontaminate import decontaminate, decontamination_sql
from dataquarry.llm.exactdedup import exact_duplicates, exact_duplicates_sql
from dataquarry.llm.sharding import shard_documents, sharding_sql
from dataquarry.llm.whitening import whitened_embeddings
from queryset.common import Registry

REGISTRY = Registry()
RANKS = "byte_bpe_multi_50k.tiktoken"


@REGISTRY.add("op1_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth document is searched among all: ``n_near`` counts its copies and near copies."""
    found = written(simhash.edited_fingerprints(source(spark, sf_dir, "documents")), "fingerprints")
    return simhash.count_near(found, F.col("doc_id") % 20 == 0, radius=simhash.NEAR, blocks=simhash.NEAR_BLOCKS)


@REGISTRY.add("op2_warc")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "archives")
    warc.write_archives(source(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"
    )


@REGISTRY.add("op3_url_filters", urlfilter.judge_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(source(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@REGISTRY.add("op4_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path(RANKS)
    return bpe.digest(bpe.encode(source(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)


@REGISTRY.add("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = source(spark, sf_dir, "documents"), source(spark, sf_dir, "labels")
    out = toxicity.held_out(F.col("doc_id"))
    model = toxicity.train(docs, labels.where(~out))
    return toxicity.score_documents(docs, model).select(
        "doc_id", out.alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending")
    )


@REGISTRY.add("op6_html_text")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(source(spark, sf_dir, "pages"))


@REGISTRY.add("op7_sharding", sharding_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(source(spark, sf_dir, "documents"))


@REGISTRY.add("op8_minhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(source(spark, sf_dir, "documents"), shingle=2, percent=80)


@REGISTRY.add("op9_language")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.where(~out))
    return langid.identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


@REGISTRY.add("op10_decontamination", decontamination_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(source(spark, sf_dir, "documents"), source(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"
    )


@REGISTRY.add("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periods.with_planted_run(source(spark, sf_dir, "documents"))
    return periods.summary(periods.periodic_runs(docs))


@REGISTRY.add("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_embeddings(source(spark, sf_dir, "embeddings"), components=16)


@REGISTRY.add("op13_exact_dedup", exact_duplicates_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(source(spark, sf_dir, "documents"))


def all_queries() -> dict:
    return {name: run for name, (run, _) in REGISTRY.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}

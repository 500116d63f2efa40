"""From raw documents to token ids: language, toxicity, near-duplicates, benchmark, tokens.

``STAGES`` are applied in order; every stage reads what its predecessor wrote.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataquarry.llm import bpe, decontaminate, langid, minhash, toxicity
from dataquarry.llm.common import fresh, source, written
from dataquarry.runtime import ship

RANKS = "byte_bpe_multi_50k.tiktoken"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is identified; those without text or letters go.

    The profiles learn from all documents with a language.  Where none has one, all stay.
    """
    ship(spark)
    model = langid.train(docs)
    if not model.languages:
        return docs
    lang = fresh(docs, "_lang")[0]
    found = langid.predictor(model)(F.col("text"))["lang"]
    return docs.withColumn(lang, found).where(F.col(lang) != langid.UNKNOWN).drop(lang)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are not predicted toxic by a model of all ``labels``.

    Null and empty texts get the share of toxic labels as their score; repeated rows are
    judged alike; without labels, or without a toxic one among them, all documents stay.
    """
    ship(spark)
    model = toxicity.train(docs, source(spark, sf_dir, "labels"))
    score = fresh(docs, "_score")[0]
    return docs.withColumn(score, toxicity.scorer(model)(F.col("text"))["score"]).where(F.col(score) < 0.5).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest id.

    A row is known by its id and its text, so rows that share an id but not the text are
    different documents.  Null ids stand behind all others, equal ids in the order of a
    hash of id and text, and of rows that agree in both one stays.  Documents without words are in no
    group and all stay.
    """
    ship(spark)
    key, row = fresh(docs, "_key", "_row")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    found = minhash.near_duplicates(keyed.where(worded).select(key, "text"), shingle=5, percent=80, key=key)
    named = found.select(F.col(key).alias("k"), "component_id").distinct().join(
        keyed.where(worded).select(F.col(key).alias("k"), "doc_id").distinct(), "k"
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "k"))
    kept = named.groupBy("component_id").agg(first.alias("f")).select(F.col("f.k").alias(key))
    # Rows with the same id and text are combined before the shuffle: they may be many.
    one = keyed.where(worded).join(kept, key, "left_semi").groupBy(key).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(row))
    return one.select(f"{row}.*").unionByName(keyed.where(~worded).drop(key))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which no window of ten benchmark words (or whole shorter item) occurs.

    Null and empty texts have no window and stay; repeated rows are judged alike; an empty benchmark keeps all.
    """
    return decontaminate.without_hits(docs, source(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of what they decode to.

    Null and empty texts have no ids; every row, repeated or not, gives a row.
    """
    import public_tokenizers

    ship(spark)
    ranks = public_tokenizers.path(RANKS)
    vocab = bpe.vocabulary(docs, ranks)
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN).select(
        "doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(bpe.id_bytes(F.col("ids"), vocab), 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids"), vocab), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("tokens", tokens),
]

#: Trained models and a tokenizer are beyond SQL; tests/llm/test_llm_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = source(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

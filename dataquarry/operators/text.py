"""Text columns to lemmas, term counts, TF-IDF and vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dataquarry.functions.text import clean_text, tokenize
from dataquarry.runtime import materialise

MAX_TERMS, MIN_DF, MAX_DF = 5000, 5, 0.90
EMBEDDING_SIZE = 384
ENCODER_BATCH = 128
# A dictionary of at most so many bytes is looked up in the row.
DICTIONARY_BYTES = 4_000_000
# A larger one is joined to the distinct tokens of blocks of texts of about so many characters.
BLOCK_CHARS = 4_000_000


def explode_words(df: DataFrame, keep: list[str], words: Column, name: str) -> DataFrame:
    """One row per word.

    The outer form on purpose: for the inner one the optimizer adds a filter on the
    array's size, pushes it to the scan, and so computes the words several times.
    """
    return df.select(*keep, F.explode_outer(words).alias(name)).filter(F.col(name).isNotNull())


def add_clean_text(df: DataFrame, text: str) -> DataFrame:
    """Add ``<text>_clean``."""
    return df.withColumn(f"{text}_clean", clean_text(F.col(text)))


def stop_words(spark: SparkSession, language: str = "spanish") -> DataFrame:
    """Spark's own stop list of a language, as a table ``(token)``."""
    words = sorted(set(StopWordsRemover.loadDefaultStopWords(language)))
    return spark.createDataFrame([(w,) for w in words], "token string")


def lemmatize(df: DataFrame, key: str, text: str, lemmas: DataFrame | None = None, stops: DataFrame | None = None, out: str = "lemmatized") -> DataFrame:
    """Add ``out``: tokens without stop words, replaced by their lemma, in order.

    ``lemmas`` is ``(token, lemma)`` with unique tokens, ``stops`` is ``(token)``.  A
    dictionary whose size is small, or gets small without the tokens that no text
    holds, is a hash table in the plan: texts stay in their rows and no token is
    shuffled.  A larger one is joined to the distinct tokens of blocks of texts.  A null
    text becomes an empty one.
    """
    if stops is None and lemmas is None:
        return df.withColumn(out, F.col(text))
    entries = materialise(_dictionary(df.sparkSession, lemmas, stops), "dictionary")
    table = _lookup_table(entries)
    if table is None:
        words = df.select(F.explode(F.array_distinct(F.split(F.col(text), " "))).alias("token")).distinct()
        table = _lookup_table(materialise(entries.join(words, "token", "left_semi"), "dictionary"))
    if table is None:
        return _lemmatize_joined(df, text, entries, out)
    found = F.transform(F.filter(F.split(F.col(text), " "), lambda t: t != ""), table)
    return df.withColumn(out, F.coalesce(F.array_join(F.filter(found, lambda t: t.isNotNull()), " "), F.lit("")))


def _dictionary(spark: SparkSession, lemmas: DataFrame | None, stops: DataFrame | None) -> DataFrame:
    """``(token, lemma)`` without entries that change nothing; stop words have no lemma."""
    parts = spark.createDataFrame([], "token string, lemma string, stop boolean")
    if lemmas is not None:
        parts = parts.unionByName(lemmas.select("token", "lemma", F.lit(False).alias("stop")).filter("token is not null and lemma is not null"))
    if stops is not None:
        parts = parts.unionByName(stops.select("token", F.lit(None).cast("string").alias("lemma"), F.lit(True).alias("stop")).filter("token is not null"))
    # Each table is read once: they may be derived from a corpus.
    entries = parts.groupBy("token").agg(F.max("stop").alias("stop"), F.min("lemma").alias("lemma"))
    return entries.select("token", F.when(~F.col("stop"), F.col("lemma")).alias("lemma"))


def _lookup_table(entries: DataFrame) -> Callable[[Column], Column] | None:
    """What a token becomes, by a literal hash table; None if the table is too large or has its marks in a text.

    A bucket is a text of entries between marks, and the place of a token in it gives its lemma.
    """
    mark, end, stop = "\x01", "\x02", "\x03"
    marked = F.concat("token", F.coalesce("lemma", F.lit(""))).rlike("[\x01-\x04]")
    size = entries.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("token") + F.coalesce(F.octet_length("lemma"), F.lit(1)) + 3).alias("bytes"), F.max(marked).alias("marked")
    ).first()
    if not size["n"]:
        return lambda token: token
    if size["bytes"] > DICTIONARY_BYTES or size["marked"]:
        return None
    slots = size["n"]
    bucket = lambda token: F.pmod(F.xxhash64(token), F.lit(slots)).cast("int")
    entry = F.concat(F.lit(mark), "token", F.lit(end), F.coalesce("lemma", F.lit(stop)))
    texts = [""] * slots
    for r in entries.select(bucket(F.col("token")).alias("slot"), entry.alias("entry")).collect():
        texts[r["slot"]] += r["entry"]
    table = F.split(F.lit("\x04".join(texts)), "\x04")

    def look_up(token: Column) -> Column:
        entries_of, own = F.concat(F.get(table, bucket(token)), F.lit(mark)), F.concat(F.lit(mark), token, F.lit(end))
        behind = F.call_function("substring_index", entries_of, own, F.lit(-1))
        lemma = F.substring_index(behind, mark, 1)
        return F.when(~F.contains(entries_of, own), token).when(lemma != stop, lemma)

    return look_up


def _lemmatize_joined(df: DataFrame, text: str, entries: DataFrame, out: str) -> DataFrame:
    """The same with a dictionary of any size: it is joined to the distinct tokens of every block of texts.

    A block holds about ``BLOCK_CHARS`` characters, and a longer text is a block of its own.
    """
    row, block = _free(df, "_row"), _free(df, "_block")

    @F.pandas_udf("bigint")
    def numbered(sizes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from pyspark import TaskContext

        first, before = TaskContext.get().partitionId() << 32, 0
        for size in sizes:
            total = size.cumsum() + before
            yield first + (total - size) // BLOCK_CHARS
            before = int(total.iloc[-1]) if len(total) else before

    size = F.coalesce(F.length(text), F.lit(0)).cast("bigint") + 1
    # Written: numbers that depend on the partitions must not be given twice.
    rows = materialise(df.withColumn(row, F.monotonically_increasing_id()).withColumn(block, numbered.asNondeterministic()(size)), "texts")
    words = rows.select(F.col(block).alias("block"), F.explode(F.array_distinct(F.split(F.col(text), " "))).alias("token")).distinct()
    found = words.join(entries.select("token", "lemma"), "token")

    def replaced(texts: pd.DataFrame, lemmas: pd.DataFrame) -> pd.DataFrame:
        table = dict(zip(lemmas["token"], lemmas["lemma"]))
        lines = []
        for t in texts["text"]:
            new = [table.get(w, w) for w in (t or "").split(" ") if w]
            lines.append(" ".join([w for w in new if w is not None]))
        return pd.DataFrame({"row": texts["row"], "out": lines})

    texts = rows.select(F.col(block).alias("block"), F.col(row).alias("row"), F.col(text).alias("text"))
    lines = texts.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(replaced, "row bigint, out string")
    lines = lines.select(F.col("row").alias(row), F.col("out").alias(_free(df, "_out")))
    kept = [F.col(f"`{c}`") for c in df.columns if c != out]
    return rows.join(lines, row, "left").select(*kept, F.col(_free(df, "_out")).alias(out))


def _free(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def term_counts(df: DataFrame, by: str, tokens: Column) -> DataFrame:
    """``(by, term, n)``: occurrences of every term per document or topic."""
    return explode_words(df, [by], tokens, "term").groupBy(by, "term").agg(F.count(F.lit(1)).alias("n"))


def document_frequency(df: DataFrame, tokens: Column) -> DataFrame:
    """``(term, df, total)``: documents that hold a term, and its occurrences.

    Each document contributes its distinct tokens and all its tokens, so both
    counts are combined map-side by term; documents themselves are not shuffled.
    """
    both = df.select(tokens.alias("t")).select(
        F.inline(F.array(
            F.struct(F.array_distinct("t").alias("t"), F.lit(1).alias("d"), F.lit(0).alias("c")),
            F.struct(F.col("t").alias("t"), F.lit(0).alias("d"), F.lit(1).alias("c")),
        ))
    )
    return (
        explode_words(both, ["d", "c"], F.col("t"), "term")
        .groupBy("term")
        .agg(F.sum("d").alias("df"), F.sum("c").alias("total"))
    )


def fit_tfidf(df: DataFrame, tokens: Column, max_terms: int = MAX_TERMS, min_df: int = MIN_DF, max_df: float = MAX_DF) -> list[tuple[str, float]]:
    """The vocabulary with its idf, on the driver: at most ``max_terms`` entries, in term order."""
    n = df.count()
    if n == 0:
        return []
    kept = (
        document_frequency(df, tokens)
        .filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
        .orderBy(F.desc("total"), "term")
        .limit(max_terms)
        .select("term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    )
    return sorted((r["term"], r["idf"]) for r in kept.collect())


def tfidf_vectors(df: DataFrame, tokens: Column, vocabulary: list[tuple[str, float]], out: str = "vector") -> DataFrame:
    """Add the L2-normalised sparse TF-IDF vector: three row-local JVM stages, no shuffle."""
    words = [t for t, _ in vocabulary]
    counted = CountVectorizerModel.from_vocabulary(words, inputCol="_tokens", outputCol="_tf").transform(
        df.withColumn("_tokens", tokens)
    )
    weights = Vectors.dense([w for _, w in vocabulary])
    weighted = ElementwiseProduct(scalingVec=weights, inputCol="_tf", outputCol="_w").transform(counted)
    return Normalizer(p=2.0, inputCol="_w", outputCol=out).transform(weighted).drop("_tokens", "_tf", "_w")


def tfidf(df: DataFrame, key: str, tokens: Column, max_terms: int = MAX_TERMS, min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """``(key, term, weight)`` in long form; documents without a kept term have no rows."""
    vocabulary = fit_tfidf(df, tokens, max_terms, min_df, max_df)
    if not vocabulary:
        return df.select(key, F.lit("").alias("term"), F.lit(0.0).alias("weight")).limit(0)
    vectors = tfidf_vectors(df.select(key, tokens.alias("_t")), F.col("_t"), vocabulary, "_vec")
    terms = df.sparkSession.createDataFrame([(i, t) for i, (t, _) in enumerate(vocabulary)], "i int, term string")
    # The vectors are sparse: only the entries they hold become rows.  An inner inline would let
    # the optimizer test the array in a pushed-down filter, with the vector computed once more.
    held = F.unwrap_udt("_vec")
    return (
        vectors.select(key, F.arrays_zip(held["indices"].alias("i"), held["values"].alias("weight")).alias("_e"))
        .select(key, F.inline_outer("_e"))
        .filter("weight > 0")
        .join(F.broadcast(terms), "i")
        .select(key, "term", "weight")
    )


def hashed_slots(tokens: Column, size: int = EMBEDDING_SIZE) -> Column:
    """``array<struct<dim,sign>>``: the slot and the sign of every token, from its md5."""
    return F.transform(
        F.transform(tokens, F.md5),
        lambda m: F.struct(
            (F.conv(F.substring(m, 1, 8), 16, 10).cast("bigint") % size).cast("int").alias("dim"),
            F.when(F.substring(m, 9, 1) < "8", 1).otherwise(-1).alias("sign"),
        ),
    )


def embed_text(df: DataFrame, tokens: Column, size: int = EMBEDDING_SIZE, out: str = "embedding") -> DataFrame:
    """Add ``out``: signed feature hashing of the tokens, L2-normalised, as ARRAY<DOUBLE>.

    Counting vectorisers over the slot numbers turn positive and negative slots
    into dense counts inside the row, so documents are not shuffled.
    """
    slots = [str(i) for i in range(size)]
    picked = df.withColumn("_slots", hashed_slots(tokens, size))
    side = lambda sign: F.transform(F.filter("_slots", lambda s: s["sign"] == sign), lambda s: s["dim"].cast("string"))
    picked = picked.withColumn("_pos", side(1)).withColumn("_neg", side(-1)).drop("_slots")
    for c in ("_pos", "_neg"):
        picked = CountVectorizerModel.from_vocabulary(slots, inputCol=c, outputCol=f"{c}_n").transform(picked)
    dense = F.zip_with(vector_to_array("_pos_n"), vector_to_array("_neg_n"), lambda a, b: a - b)
    picked = Normalizer(p=2.0, inputCol="_dense", outputCol="_unit").transform(picked.withColumn("_dense", array_to_vector(dense)))
    return picked.withColumn(out, vector_to_array("_unit")).drop("_pos", "_neg", "_pos_n", "_neg_n", "_dense", "_unit")


def encode_text(df: DataFrame, key: str, text: str, load: Callable[[], Callable[[list[str]], list]], batch: int = ENCODER_BATCH) -> DataFrame:
    """``(key, embedding)`` from a user's encoder.

    ``load()`` runs once per Python worker and returns ``encode(texts) -> vectors``,
    which is called with batches of ``batch`` whole texts.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start:start + batch]
                vectors = encode(part["text"].fillna("").tolist())
                yield pd.DataFrame({"key": part["key"].to_numpy(), "embedding": [[float(x) for x in v] for v in vectors]})

    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return source.mapInPandas(run, f"key {kind}, embedding array<double>").withColumnRenamed("key", key)


__all__ = [
    "add_clean_text", "document_frequency", "embed_text", "encode_text", "fit_tfidf",
    "hashed_slots", "lemmatize", "stop_words", "term_counts", "tfidf", "tfidf_vectors", "tokenize",
]

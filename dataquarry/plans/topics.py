"""Text analysis: cleaning, lemmas, vectors, density topics, merging, keywords, payload."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataquarry.functions.text import tokenize
from dataquarry.operators.columns import attach_labels
from dataquarry.operators.text import add_clean_text, embed_text, encode_text, fit_tfidf, lemmatize, tfidf_vectors
from dataquarry.operators.topics import (
    class_tfidf_keywords,
    density_cluster,
    merge_map,
    merge_topics,
    reduce_vectors,
    topic_payload,
    topic_stats,
)
from dataquarry.runtime import materialise
from dataquarry.sources.phases import Phases


@dataclass
class TopicResult:
    rows: DataFrame
    vectors: DataFrame
    keywords: DataFrame | None = None
    payload: DataFrame | None = None
    stats: DataFrame | None = None


def vectorise(df: DataFrame, key: str, text: str, method: str = "dense", load: Callable | None = None) -> DataFrame:
    """Add ``vector``: hashed or user-encoded (``dense``), or TF-IDF (``sparse``)."""
    if method not in {"dense", "sparse"}:
        raise ValueError("method must be 'dense' or 'sparse'")
    tokens = tokenize(F.col(text))
    if method == "sparse":
        return tfidf_vectors(df, tokens, fit_tfidf(df, tokens))
    if load is None:
        return embed_text(df, tokens, out="vector")
    return df.join(encode_text(df, key, text, load).withColumnRenamed("embedding", "vector"), key)


def run_topics(
    df: DataFrame,
    key: str,
    text: str,
    method: str = "dense",
    target: str | None = None,
    lemmas: DataFrame | None = None,
    stops: DataFrame | None = None,
    load: Callable | None = None,
    merge: bool = True,
    vocab: str = "global",
    probes: int | None = None,
    phases: Phases | None = None,
) -> TopicResult:
    """The whole analysis.  With a target it ends at the vectors, for a supervised analysis to use.

    ``merge=False`` also leaves out keywords and payload.  ``probes`` bounds the
    neighbour search of the density clustering on very large tables.
    ``phases`` publishes every phase, so that a repeated run goes on after the last one.
    """
    if text not in df.columns:
        raise ValueError(f"column '{text}' not found")
    phases = phases or Phases()

    plain = lemmas is None and stops is None

    # Texts are written once: vectors, labels and merged labels are tables of their own.
    def clean() -> dict:
        cleaned = add_clean_text(df, text)
        return {"rows": cleaned if plain else lemmatize(cleaned, key, f"{text}_clean", lemmas, stops)}

    texts = phases.step("lemmas", clean)["rows"]
    if plain:
        texts = lemmatize(texts, key, f"{text}_clean")
    vectors = phases.step("vectors", lambda: {"rows": vectorise(texts, key, "lemmatized", method, load).select(key, "vector")})["rows"]
    if target is not None:
        return TopicResult(rows=texts, vectors=vectors)
    reduced = phases.step("reduced", lambda: {"rows": reduce_vectors(vectors, "vector")})["rows"]
    labels = phases.step("topics", lambda: {"rows": density_cluster(reduced, key, "reduced", label="Topic_ID", probes=probes)})["rows"]
    rows = attach_labels(texts, labels, key, "Topic_ID")
    if not merge:
        return TopicResult(rows=rows, vectors=reduced, stats=topic_stats(rows, "Topic_ID"))
    labelled = attach_labels(vectors, labels, key, "Topic_ID")
    moves = phases.step("merged", lambda: {"moves": merge_map(labelled, "vector", "Topic_ID")})["moves"]
    merged = merge_topics(rows, "vector", "Topic_ID", merged=moves)
    tokens = tokenize(F.col("lemmatized"))

    def describe() -> dict:
        keywords = materialise(class_tfidf_keywords(merged, "Topic_ID", tokens, vocab=vocab), "keywords")
        return {
            "keywords": keywords,
            "payload": topic_payload(merged, "Topic_ID", key, text, tokens, vocab, keywords),
            "stats": topic_stats(merged, "Topic_ID"),
        }

    found = phases.step("description", describe)
    return TopicResult(rows=merged, vectors=reduced, **found)

"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's logit is the bias plus the weights of its
distinct words' features (the word, and its first 3 to 8 letters), and the document is
toxic unless none of its sentences is: ``p = 1 - prod(1 - p_s)`` (noisy-or).  Only
document labels are known, and the weights follow from their likelihood; afterwards the
sentence scores say which sentences offend.

A real sentence without any offence still has a small probability, and thousands of them
would make every long text toxic.  When a document is scored, what a sentence adds to
``-log(1 - p)`` up to ``BACKGROUND`` is background, and all background of a document together
counts at most ``MOST_BACKGROUND``; only what lies above it adds up without a bound.  A short
text keeps its plain noisy-or, nearly always.

The model is fitted in one task from a bounded sample of labelled rows, and only its weights
reach the driver; all documents are scored by Spark.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataquarry.llm.common import fresh

#: The fit uses at most so many rows of each label, by the order of a hash of the key ...
SAMPLE_PER_LABEL = 3_000
#: ... and no row with more characters than this.
SAMPLE_CHARS = 20_000
FEATURES = 1 << 18
PREFIXES = (3, 4, 5, 6, 7, 8)
STEPS, RATE, SPARSITY = 150, 0.1, 1e-4
WORD_CACHE = 300_000
#: Of a sentence's -log(1 - p), so much is background ...
BACKGROUND = 0.05
#: ... and the background of all sentences of a document counts at most so much (p = 0.18).
MOST_BACKGROUND = 0.2

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")


def sentences(text: str | None) -> list[tuple[int, int, set[str]]]:
    """Begin, end and distinct lower-case words of every sentence that has words."""
    out = []
    for m in SENTENCE.finditer(text or ""):
        words = set(WORD.findall(m.group().lower()))
        if words:
            out.append((m.start(), m.end(), words))
    return out


def features(word: str) -> list[int]:
    """Hashed features of a word."""
    import xxhash

    names = [f"w{word}", *(f"{n}{word[:n]}" for n in PREFIXES if len(word) >= n)]
    return [xxhash.xxh64_intdigest(n) % FEATURES for n in names]


@dataclass(frozen=True)
class ToxicityModel:
    """Feature weights, the bias of a sentence, and the score of a document without words."""

    weights: np.ndarray
    bias: float
    empty: float

    def scorer(self) -> _Scorer:
        return _Scorer(self)


class _Scorer(dict):
    """Word scores, kept while there is room."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = value = float(self.model.weights[features(word)].sum())
        return value

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and ``(begin, end, probability)`` of sentences at one half or more."""
        parts = sentences(text)
        if not parts:
            return self.model.empty, []
        logits = np.array([self.model.bias + sum(map(self.__getitem__, words)) for _, _, words in parts])
        mass = np.logaddexp(0, logits)
        common = np.minimum(mass, BACKGROUND).sum()
        clean = min(common, MOST_BACKGROUND) + np.maximum(mass - BACKGROUND, 0).sum()
        found = [(b, e, float(1 / (1 + np.exp(-z)))) for (b, e, _), z in zip(parts, logits.tolist()) if z >= 0]
        return float(-np.expm1(-clean)), found


def fit(texts: list[str], labels: np.ndarray, shares: tuple[float, float]) -> ToxicityModel:
    """Maximum likelihood under the noisy-or, with Adam and an L1 step that keeps weights sparse.

    Weights are not negative: a harmless word is no evidence against an offence beside it.

    ``shares`` are the two labels' shares of all labelled rows, which the sample need not keep.
    """
    vocabulary: dict[str, int] = {}
    doc_starts, sentence_starts, word_of = array("q", [0]), array("q", [0]), array("q")
    owner, feature, used = array("q"), array("q"), []
    for i, text in enumerate(texts):
        parts = sentences(text)
        if parts:
            for _, _, words in parts:
                word_of.extend(vocabulary.setdefault(w, len(vocabulary)) for w in sorted(words))
                sentence_starts.append(len(word_of))
            doc_starts.append(len(sentence_starts) - 1)
            used.append(labels[i])
    y = np.array(used, float)
    empty = float(shares[1])
    if not len(y) or y.min() == y.max():
        return ToxicityModel(np.zeros(FEATURES, np.float32), -20.0 if not y.sum() else 0.0, empty)
    for word, number in vocabulary.items():
        found = features(word)
        feature.extend(found)
        owner.extend([number] * len(found))
    owner, feature = np.array(owner), np.array(feature)
    word_of, starts, docs = np.array(word_of), np.array(sentence_starts[:-1]), np.array(doc_starts[:-1])
    sentence_of_word = np.repeat(np.arange(len(starts)), np.diff(sentence_starts))
    doc_of_sentence = np.repeat(np.arange(len(docs)), np.diff(doc_starts))
    weight = np.where(y == 1, shares[1] / max(y.mean(), 1e-9), shares[0] / max(1 - y.mean(), 1e-9))
    weight /= weight.sum()

    w, bias = np.zeros(FEATURES), -6.0
    m, v, mb, vb = np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0
    for step in range(1, STEPS + 1):
        of_word = np.bincount(owner, w[feature], len(vocabulary))
        z = np.add.reduceat(of_word[word_of], starts) + bias
        soft = np.logaddexp(0, z)
        clean = np.add.reduceat(soft, docs)
        p = np.maximum(-np.expm1(-clean), 1e-12)
        # d loss / d clean: 1 for label 0, -(1 - p) / p for label 1; d clean / d z is the sentence's probability.
        slope = weight * np.where(y == 1, -np.exp(-clean) / p, 1.0)
        gz = slope[doc_of_sentence] / (1 + np.exp(-z))
        g = np.bincount(feature, np.bincount(word_of, gz[sentence_of_word], len(vocabulary))[owner], FEATURES)
        gb = gz.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
        scale = RATE / (np.sqrt(v / fix2) + 1e-8)
        w -= scale * (m / fix1)
        w = np.maximum(w - scale * SPARSITY, 0)
        bias -= RATE * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-8)
    return ToxicityModel(w.astype(np.float32), float(bias), empty)


def held_out(key: Column, parts: int = 5, part: int = 0) -> Column:
    """Whether ``crc32`` of the key as text leaves ``part`` modulo ``parts``; null keys count as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts == part


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    per_label: int = SAMPLE_PER_LABEL, most_chars: int = SAMPLE_CHARS,
) -> ToxicityModel:
    """Fit on labelled rows: at most ``per_label`` keys of each label, by the order of a hash.

    Rows with a null key or label teach nothing.  Keys that the documents lack, and texts
    longer than ``most_chars``, leave the sample smaller.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    total = max(sum(counts.values()), 1)
    chosen: dict = {}
    for y in (0, 1):
        # A hash leaves about four times as many for the sort, whatever the table's size.
        every = max(1, counts.get(y, 0) // (4 * per_label))
        some = known.where((F.col("y") == y) & (F.pmod(F.xxhash64("k"), F.lit(every)) == 0))
        for r in some.orderBy(F.xxhash64("k"), "k").limit(per_label).collect():
            chosen[r.k] = y
    if not chosen:
        return ToxicityModel(np.zeros(FEATURES, np.float32), -20.0, 0.0)
    shares = (counts.get(0, 0) / total, counts.get(1, 0) / total)
    marked = F.col(key).isin([k for k, y in chosen.items() if y]).cast("int")
    rows = (
        docs.where(F.col(key).isin(list(chosen)) & (F.coalesce(F.length(text), F.lit(0)) <= most_chars))
        .select(F.col(key).alias("k"), F.col(text).alias("t"), marked.alias("y")).repartition(1).sortWithinPartitions("k", "t")
    )

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = [(t, y) for batch in batches for t, y in zip(batch["t"], batch["y"])]
        model = fit([t for t, _ in seen], np.array([y for _, y in seen], float), shares)
        yield pd.DataFrame({"weights": [model.weights.tobytes()], "bias": [model.bias]})

    found = rows.select("t", "y").mapInPandas(fitted, "weights binary, bias double").first()
    if found is None:
        return fit([], np.array([]), shares)
    return ToxicityModel(np.frombuffer(bytes(found["weights"]), np.float32), float(found["bias"]), float(shares[1]))


def scorer(model: ToxicityModel):
    """A column function: text to ``struct<score, offending>``; offsets count code points."""

    @F.pandas_udf("struct<score:double,offending:array<struct<begin:int,end:int,score:double>>>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = model.scorer()
        for texts in batches:
            yield pd.DataFrame([words.score(t) for t in texts], columns=["score", "offending"])

    return score


def score_documents(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """All rows and columns with ``score``, ``predicted`` and ``offending``, which replace columns of those names.

    Null and empty texts get the share of toxic rows among the labelled ones.
    """
    kept = docs.drop(*[c for c in ("score", "predicted", "offending") if c != text])
    found = fresh(kept, "_found")[0]
    return kept.withColumn(found, scorer(model)(F.col(text))).select(
        *[F.col(f"`{c}`") for c in kept.columns], F.col(found)["score"].alias("score"),
        (F.col(found)["score"] >= 0.5).cast("int").alias("predicted"), F.col(found)["offending"].alias("offending"),
    )

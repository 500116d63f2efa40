"""Language identification with hyperdimensional profiles.

Every letter has a random vector of ``DIM`` signs, drawn from its code point.  A trigram
binds three of them: the first permuted twice (rotated by two), the second once, and the
three multiplied.  A text bundles its trigrams, counted, over its words in lower case
with a space around each.  A language's prototype bundles all its training texts, each
with the same total weight.  A text gets the language whose prototype has the largest
cosine with its vector.

Training is one pass over all training rows: every task bundles its own rows, and the
partial prototypes (languages x ``DIM`` numbers a task) are summed by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 1024
UNKNOWN = "und"
#: Trigram vectors a task keeps; beyond, it starts anew.
CACHE = 20_000
SPACE = 32


def letter_vector(code: int) -> np.ndarray:
    """The fixed random signs of a code point; the space has one too."""
    return np.random.default_rng([7, code]).integers(0, 2, DIM).astype(np.int8) * 2 - 1


class Grams:
    """Trigram vectors by number, kept while there is room."""

    def __init__(self) -> None:
        self.letters: dict[int, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.table = np.empty((CACHE, DIM), np.float32)

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = letter_vector(code)
        return self.letters[code]

    def vector(self, gram: int) -> np.ndarray:
        a, b, c = gram >> 42, (gram >> 21) & 0x1FFFFF, gram & 0x1FFFFF
        return np.roll(self._letter(a), 2) * np.roll(self._letter(b), 1) * self._letter(c)

    def places(self, grams: list[int]) -> np.ndarray:
        """Row numbers of at most ``CACHE`` trigrams."""
        if len(self.rows) + len(grams) > CACHE:
            self.clear()
        out = np.empty(len(grams), np.int64)
        for i, gram in enumerate(grams):
            at = self.rows.get(gram)
            if at is None:
                at = self.rows[gram] = len(self.rows)
                self.table[at] = self.vector(gram)
            out[i] = at
        return out


def trigrams(text: str | None) -> tuple[list[int], np.ndarray]:
    """Distinct trigrams of a text's letters and their counts; none without letters."""
    import re

    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not words:
        return [], np.empty(0, np.int64)
    codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    grams, counts = np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:], return_counts=True)
    return grams.tolist(), counts


def bundle(grams: list[int], counts: np.ndarray, table: Grams) -> np.ndarray:
    """The text's vector: the sum of its trigram vectors, in blocks that fit the table."""
    out = np.zeros(DIM, np.float32)
    for at in range(0, len(grams), CACHE):
        rows = table.places(grams[at : at + CACHE])
        out += counts[at : at + CACHE].astype(np.float32) @ table.table[rows]
    return out


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order of name, and their prototypes of length 1."""

    languages: tuple[str, ...]
    prototypes: np.ndarray

    def predict(self, text: str | None, table: Grams) -> tuple[str, float]:
        """Language and cosine (negative: 0); ``und`` and 0 without a letter or without any language."""
        grams, counts = trigrams(text)
        if not grams or not self.languages:
            return UNKNOWN, 0.0
        vector = bundle(grams, counts, table)
        cosines = self.prototypes @ vector / max(float(np.linalg.norm(vector)), 1e-9)
        best = int(np.argmax(cosines))
        return self.languages[best], min(1.0, max(0.0, float(cosines[best])))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, sums = Grams(), {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            grams, counts = trigrams(text.as_py())
            if grams:
                weights = counts / counts.sum()
                held = sums.setdefault(lang, {})
                for gram, weight in zip(grams, weights.tolist()):
                    held[gram] = held.get(gram, 0.0) + weight
                if len(held) > 4 * CACHE:
                    yield _rows(lang, sums.pop(lang), table)
    for lang, held in sums.items():
        yield _rows(lang, held, table)


def _rows(lang: str, held: dict[int, float], table: Grams) -> pa.RecordBatch:
    vector = bundle(list(held), np.fromiter(held.values(), np.float64), table).astype(np.float64)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * DIM, pa.string()), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(vector)], ["lang", "dim", "value"]
    )


def train(rows: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Prototypes of all non-null languages of the rows; texts without letters teach nothing."""
    sums = (
        rows.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string"), F.col(text))
        .mapInArrow(_partial, "lang string, dim int, value double")
        .groupBy("lang", "dim").agg(F.sum("value").alias("value")).collect()
    )
    languages = tuple(sorted({r.lang for r in sums}))
    table = np.zeros((len(languages), DIM), np.float64)
    for r in sums:
        table[languages.index(r.lang), r.dim] = r.value
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    return LanguageModel(languages, table.astype(np.float32))


def predictor(model: LanguageModel):
    """A column function: text to ``struct<lang, score>``."""

    @F.pandas_udf("struct<lang:string,score:double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = Grams()
        for texts in batches:
            yield pd.DataFrame([model.predict(t, table) for t in texts], columns=["lang", "score"])

    return predict


def held_out(key: Column, parts: int = 3, part: int = 1) -> Column:
    """Whether ``crc32`` of the key as text leaves ``part`` modulo ``parts``; null keys count as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts == part


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """All rows and columns with ``lang_pred`` and ``score``, which replace columns of those names."""
    kept = docs.drop("lang_pred", "score") if text not in ("lang_pred", "score") else docs
    return kept.withColumn("_found", predictor(model)(F.col(text))).select(
        *[F.col(f"`{c}`") for c in kept.columns], F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("score")
    )

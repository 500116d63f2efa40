"""Periodic runs, whitening and exact copies against plain Python."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from dataquarry.llm import exactdedup, periods, queries, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- periodic runs


def plain_runs(words):
    """Every maximal stretch by comparing all words q apart, for every q."""
    found = {}
    numbers = np.unique(np.array(words), return_inverse=True)[1] if words else np.zeros(0, int)
    for q in range(1, len(words) // 3 + 1):
        equal = np.concatenate([[0], numbers[:-q] == numbers[q:], [0]]).astype(int)
        change = np.diff(equal)
        for start, stop in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist()):
            if stop - start + q >= max(24, 3 * q):
                found.setdefault((start, stop - start + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_summary(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def random_words(rng):
    words = []
    for _ in range(rng.randint(0, 8)):
        base = [rng.choice("abcdefghijk"[: rng.choice([1, 2, 3, 11])]) for _ in range(rng.randint(1, rng.choice([3, 9, 20, 60])))]
        if rng.random() < 0.5:
            base = base[:2] * rng.randint(1, 12) + base[2:5]
        words += base * rng.choice([1, 1, 2, 3, 4, 7])
        del words[len(words) - rng.randint(0, 3) :]
    return words


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(60):
        docs = [random_words(rng) for _ in range(rng.randint(1, 6))]
        numbers = np.array([ord(w) for d in docs for w in d], np.int64)
        found = [[] for _ in docs]
        for d, *run in zip(*(c.tolist() for c in periods.runs_of(numbers, np.array([len(d) for d in docs])))):
            found[d].append(tuple(run))
        assert found == [sorted(plain_runs(d), key=lambda r: (r[0], r[2])) for d in docs]


def test_successor_of_wavelet_matrix():
    rng = np.random.default_rng(1)
    for size, top in ((1, 1), (7, 3), (300, 300), (300, 5)):
        values = rng.integers(0, top, size)
        tree = periods.WaveletMatrix(values)
        low = rng.integers(0, size, 200)
        high = low + rng.integers(0, size - low + 1)
        bound = rng.integers(0, top + 3, 200)
        expected = [min((v for v in values[a:b] if v >= c), default=-1) for a, b, c in zip(low, high, bound)]
        assert tree.successor(low, high, bound).tolist() == expected


def test_query_of_runs(spark, small_docs, tmp_path):
    found = {r.doc_id: tuple(r)[1:] for r in queries.op11(spark, "/root/testdata/sf0.001").collect()}
    assert found == {r.doc_id: plain_summary(r.doc_id, r.text) for r in small_docs.collect()}
    assert any(f[0] for f in found.values())


def test_runs_of_odd_texts(make_docs):
    line = "alpha beta gamma delta"
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "a " * 23), (5, "a " * 24), (6, " ".join([line] * 6)), (6, " ".join([line] * 6)),
        (None, " ".join([line] * 7)), (7, "a\u00a0b " * 40), (8, " ".join(f"w{i % 50_000}" for i in range(160_000))),
        (9, " ".join(str(i) for i in range(60_000))), (10, "x " * 200_000), (11, "a\x0bb\x0c" * 30),
    ]
    docs = make_docs(rows).select("doc_id", "text", F.lit("mine").alias("key"), F.lit(1).alias("runs"), F.lit(2).alias("collapsed"))
    found = sorted(
        ((r.doc_id or 0, [tuple(x) for x in r.runs], len(WORD.findall(r.collapsed))) for r in periods.periodic_runs(docs).collect()), key=lambda r: (r[0], r[2])
    )
    six = [(0, 24, 4)]
    assert found == [
        (0, [(0, 28, 4)], 4), (1, [], 0), (2, [], 0), (3, [], 0), (4, [], 23), (5, [(0, 24, 1)], 1), (6, six, 4), (6, six, 4),
        (7, [(0, 40, 1)], 1), (8, [(0, 160_000, 50_000)], 50_000), (9, [], 60_000), (10, [(0, 200_000, 1)], 1), (11, [(0, 60, 2)], 2),
    ]
    assert periods.periodic_runs(docs.where("false")).count() == 0
    assert periods.summary(periods.periodic_runs(docs.where("doc_id < 3"))).where("start is null and n_runs = 0").count() == 2


# --- whitening


def plain_whitening(rows, most=16):
    """``key -> (n, deviation, whitened row)``, eigenvalue shares; by a full decomposition."""
    grid = {k: [math.floor(64 * c) + 1_000_000 for c in v] for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted({tuple(x) for x in grid.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    out = {}
    for k, x in grid.items():
        c = np.array([(n * a - s) / n for a, s in zip(x, sums)])
        out[k] = (n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), c @ vectors / np.sqrt(values))
    return out, values / np.trace(centred.T @ centred / n)


def whitened_rows(df):
    out = {}
    for r in df.orderBy("vec_id", "component").collect():
        out.setdefault(r.vec_id, []).append(r)
    return out


def test_whitening_of_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    expected, shares = plain_whitening([(r.vec_id, r.embedding) for r in table.collect()])
    found = whitened_rows(queries.op12(spark, "/root/testdata/sf0.001"))
    assert found.keys() == expected.keys()
    signs = np.sign(sum(np.array([r.whitened for r in found[k]]) * expected[k][2] for k in found))
    for k, rows in found.items():
        assert [r.component for r in rows] == list(range(1, 17))
        assert {(r.n, r.deviation) for r in rows} == {expected[k][:2]}
        assert np.allclose([r.whitened for r in rows], expected[k][2] * signs, atol=1e-7)
        assert np.allclose([r.explained for r in rows], shares, rtol=1e-9)
        assert rows[0].identity_error < 1e-9


def test_components_with_equal_eigenvalues_stop_early_or_not(spark):
    """A wide table whose largest eigenvalues are equal: one starting vector sees each value once."""
    width, rows = 48, []
    for i in range(width):
        size = 40.0 if i < 3 else 20.0 if i < 5 else 3.0 / (1 + i)
        for sign in (1, -1):
            rows.append((len(rows), [sign * size if j == i else 0.0 for j in range(width)]))
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = whitened_rows(whitening.whitened_embeddings(table, components=5))
    _, shares = plain_whitening(rows, 5)
    assert np.allclose([r.explained for r in found[0]], shares, rtol=1e-9)
    assert found[0][0].identity_error < 1e-9


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 2.0, 3.0]), (2, [2.0, 1.0, 0.5]), (3, [0.0, 4.0, 1.0]), (3, [0.0, 4.0, 1.0]), (None, [1.0, 2.0, 3.0]), (4, None),
        (5, [1.0, None, 2.0]), (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0]), (8, [1.0, 2.0]), (9, []), (10, [1e300, 1.0, 1.0]),
    ]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("x", F.lit(1)).withColumn("component", F.lit(0))
    found = whitening.whitened_embeddings(table).groupBy("vec_id").agg(F.count("*").alias("k"), F.first("n").alias("n")).collect()
    # Four distinct vectors span at most three directions; one entry is so large that the others vanish in rounding.
    assert {(r.vec_id, r.n) for r in found} == {(1, 4), (2, 4), (3, 4), (None, 4), (10, 4)}
    assert {r.vec_id: r.k for r in found}[3] == 2 * {r.vec_id: r.k for r in found}[1]
    for odd in ("false", "vec_id = 1", "vec_id in (4, 9)"):
        assert whitening.whitened_embeddings(table.where(odd)).count() == 0
    equal = whitening.whitened_embeddings(table.where("vec_id < 3")).collect()
    assert len(equal) == 2 and {abs(round(r.whitened, 9)) for r in equal} == {1.0}


# --- exact copies


def plain_copies(rows):
    groups = {}
    even = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for key, text in rows:
        groups.setdefault(even(text), []).append(key)
    return sorted(
        (key, min(groups[even(text)]), len(groups[even(text)]), key == min(groups[even(text)]), hashlib.sha256(even(text).encode()).hexdigest())
        for key, text in rows
    )


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_copies_over_any_number_of_partitions(make_docs, partitions):
    rng = random.Random(partitions)
    texts = ["", None, "one two", "one  two", "one\ttwo", "one two ", "ünï code", *(f"text {i}" for i in range(40))]
    rows = [(i, "the hot one" if i % 3 == 0 else rng.choice(texts)) for i in range(600)]
    rng.shuffle(rows)
    found = exactdedup.exact_duplicates(make_docs(rows).repartition(partitions))
    assert sorted(map(tuple, found.collect())) == plain_copies(rows)


def test_copies_with_odd_ids(make_docs):
    rows = [(None, "a"), (None, "a"), (2, "a"), (2, "a"), (3, "b"), (3, "c"), (None, "d"), (None, "d")]
    docs = make_docs(rows).select("doc_id", "text", F.lit("mine").alias("node"), F.lit(1).alias("digest"), F.lit("x").alias("keep_id"))
    found = exactdedup.exact_duplicates(docs).groupBy("text_sha256").agg(
        F.first("keep_id").alias("keep"), F.first("group_size").alias("size"), F.count_if("kept").alias("kept"), F.count("*").alias("rows")
    )
    assert sorted((r.keep or 0, r.size, r.kept, r.rows) for r in found.collect()) == [(0, 2, 1, 2), (2, 4, 1, 4), (3, 1, 1, 1), (3, 1, 1, 1)]
    assert exactdedup.exact_duplicates(docs.where("false")).count() == 0


def test_equal_short_hashes_do_not_make_copies():
    """Entries of one sort key but different SHA-256 or length stay apart."""
    import pyarrow as pa

    def entry(sha, size, key):
        return {"id": key, "row": key, "node": 0, "digest": 7, "sha": sha, "bytes": size, "copies": 1}

    rows = [entry(b"a", 1, 4), entry(b"a", 1, 5), entry(b"a", 2, 1), entry(b"b", 1, 3), entry(b"b", 1, 9)]
    batches = [pa.RecordBatch.from_pylist(rows[:2]), pa.RecordBatch.from_pylist(rows[2:4]), pa.RecordBatch.from_pylist(rows[4:])]
    out = [r for b in exactdedup.combine(iter(batches)) for r in b.to_pylist()]
    assert [(r["sha"], r["bytes"], r["id"], r["copies"]) for r in out] == [(b"a", 1, 4, 2), (b"a", 2, 1, 1), (b"b", 1, 3, 2)]


def test_query_of_copies(spark, small_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    assert sorted(map(tuple, queries.op13(spark, "/root/testdata/sf0.001").collect())) == plain_copies(rows)

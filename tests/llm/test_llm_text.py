"""Tokens, near-duplicates, languages and toxicity."""

import base64
import hashlib
import os
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dataquarry.llm import bpe, langid, minhash, toxicity

tokenizers = pytest.importorskip("public_tokenizers")
RANKS = tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_equal_the_library(make_docs, small_docs, library):
    draw = random.Random(5)
    odd = [None, "", " ", "\n\n  \t", "a", "<|endoftext|>", "don't we'll I'd", "漢字かな 🙂🙃 é  x", "x" * 3000, "ab" * 700,
           "=" * 2500, "".join(draw.choice("abcdefgh") for _ in range(1500)), "".join(chr(draw.randrange(32, 0x2FF)) for _ in range(3000)),
           "€" * 300, " " * 500 + "end", "7" * 400]
    df = make_docs([(i, t) for i, t in enumerate(odd)] + [(None, "no id"), (3, "twice"), (3, "twice")])
    both = df.union(small_docs.select(F.col("doc_id") + 1000, "text", "lang", "source", "n_chars"))
    both = both.withColumn("words", F.lit("clash")).withColumn("ids", F.lit(0))
    encoded = bpe.encode(both, RANKS, tokenizers.PATTERN)
    texts = sorted((library.encode_ordinary(r.text or "") for r in both.collect()))
    rows = encoded.withColumn("bytes", bpe.decode(F.col("ids"), bpe.vocabulary(both, RANKS))).collect()
    assert sorted(list(r.ids) for r in rows) == texts
    assert sorted(bytes(r.bytes) for r in rows) == sorted((r.text or "").encode() for r in both.collect())
    assert bpe.encode(make_docs([]), RANKS, tokenizers.PATTERN).count() == 0


def test_digest(make_docs, library):
    text = "Some words, some more words."
    row = bpe.digest(bpe.encode(make_docs([(1, text)]), RANKS, tokenizers.PATTERN), RANKS).first()
    ids = library.encode_ordinary(text)
    assert tuple(row) == (
        1, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
    )


def as_bytes(spark, words):
    return spark.createDataFrame([([b - 256 if b > 127 else b for b in w.encode()],) for w in words], "w array<tinyint>")


def test_rounds_and_places_agree(spark, library, monkeypatch):
    draw = random.Random(6)
    words = ["".join(draw.choice("aab e") for _ in range(n)) for n in (2, 3, 9, 30, 60, 120)]
    df = as_bytes(spark, words)
    vocab = bpe.vocabulary(df, RANKS)
    by_place = [list(r[0]) for r in df.select(bpe.word_ids(F.col("w"), vocab)).collect()]
    monkeypatch.setattr(bpe, "LONG_WORD", 0)
    assert [list(r[0]) for r in df.select(bpe.word_ids(F.col("w"), vocab)).collect()] == by_place
    assert by_place == [library._core_bpe.encode_single_piece(w.encode()) for w in words]


def test_small_vocabulary_without_order(spark, tmp_path):
    """A rank table in which a longer piece ranks before its parts."""
    pieces = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"bc", b"aba", b"cbcb"]
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % i for i, p in enumerate(pieces)))
    import tiktoken

    own = tiktoken.Encoding("x", pat_str=r".+", mergeable_ranks={p: i for i, p in enumerate(pieces)}, special_tokens={})
    words = ["abcab", "ababab", "cabababc", "bcbcabc" * 30, "cbcb", "é"]
    df = as_bytes(spark, words)
    vocab = bpe.Vocabulary(bpe.read_ranks(str(path)))
    assert not vocab.ordered and vocab.unreached == {b"cbcb": 260}
    assert [list(r[0]) for r in df.select(bpe.word_ids(F.col("w"), vocab)).collect()] == [own.encode_ordinary(w) for w in words]


def test_first_merges_are_those_of_the_fold(spark, library):
    """However many merges are made on arrays before the fold, a word's ids are the library's."""
    draw = random.Random(3)
    words = ["".join(draw.choices(["a", "the", "é", "字", "in", " ", "er", "1", "aa"], k=draw.randrange(0, 9))) for _ in range(200)]
    words += ["", "a" * 150, "banana" * 40]
    vocab = bpe.vocabulary(spark.range(1), RANKS)
    expected = [library._core_bpe.encode_single_piece(w.encode()) if w else [] for w in words]
    for merges in (0, 1, 3, 10**6):
        states = bpe.first_states(words, vocab.bytes, vocab.last, vocab.pairs, merges).to_pylist()
        df = spark.createDataFrame([(s,) for s in states], "s array<bigint>").coalesce(1)
        assert [list(r[0]) for r in df.select(bpe.state_ids(F.col("s"), vocab)).collect()] == expected
    assert [[e & bpe.ID_MASK for e in s] for s in states] == expected


def expected_components(rows, size, percent):
    sets, parent = {}, {}
    for key, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        runs = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        sets.setdefault(key, []).append(runs)
        parent.setdefault(key, key)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            for s in sets[a]:
                for t in sets[b]:
                    common = len(s & t)
                    if common and 100 * common >= percent * (len(s) + len(t) - common):
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}, {k: {len(s) for s in v} for k, v in sets.items()}


def copies(draw, count):
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(count):
        words = [draw.choice(vocab) for _ in range(draw.choice([1, 2, 3, 30, 120, 300]))]
        for _ in range(draw.choice([1, 1, 2, 12])):
            w = list(words)
            for _ in range(draw.choice([0, 0, 1, 2, 3, 6, 12])):
                w[draw.randrange(len(w))] = draw.choice(vocab)
            rows.append((len(rows) + 1, draw.choice([" ", "  ", "\n"]).join(w)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_components_of_near_duplicates(make_docs, size):
    rows = copies(random.Random(size), 40)
    rows += [(900, None), (901, ""), (902, " \t"), (903, "x"), (904, "X"), (905, "x"), (rows[0][0], rows[0][1])]
    df = make_docs(rows).withColumn("id", F.lit(1)).withColumn("component", F.lit("clash")).withColumn("rep", F.lit(1))
    found = minhash.near_duplicates(df, shingle=size).collect()
    expected, sizes = expected_components(rows, size, 80)
    assert len(found) == len(rows)
    assert {r.doc_id: r.component_id for r in found} == expected
    assert all(r.n_shingles in sizes[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_without_ids_or_rows(make_docs):
    found = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(
        make_docs([(None, "a b c d e f"), (3, "a b c d e f"), (None, "q r s t u v")]), shingle=2
    ).collect()}
    assert found == {(None, 3, False), (3, 3, True), (None, None, True)}
    assert minhash.near_duplicates(make_docs([])).count() == 0


def test_components_by_stars(spark):
    draw = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    draw.shuffle(edges)
    found = {r.id: r.component for r in minhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 160)}, 201: 200}
    assert minhash.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_minima_estimate_similarity():
    draw = np.random.default_rng(9)
    x = np.unique(draw.integers(0, 2**63, 4000, np.uint64))
    a, b = minhash.universal()
    s, t = minhash.minima(x[:3000], a, b), minhash.minima(x[1000:], a, b)
    assert abs((s == t).mean() - 0.5) < 0.09
    assert (minhash.minima(x, a, b, block=17) == minhash.minima(x, a, b)).all()


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.where(~out))
    rows = langid.identify(docs, model).select("doc_id", "lang", "lang_pred", "score", out.alias("o")).collect()
    assert all(r.o == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.o]
    assert len(rows) == docs.count() and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98


def test_language_of_odd_rows(make_docs):
    df = make_docs([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "", None), (5, "12 !?", "de"),
                    (None, "the dog", None), (6, "und die " * 9000, None), (6, "und die " * 9000, None)]).withColumn("score", F.lit("clash"))
    model = langid.train(df)
    found = langid.identify(df, model)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score"]
    got = sorted(((r.doc_id or 0, r.lang_pred, r.score > 0) for r in found.collect()))
    assert got == [(0, "en", True), (1, "en", True), (2, "de", True), (3, "und", False), (4, "und", False), (5, "und", False), (6, "de", True), (6, "de", True)]
    none = langid.train(make_docs([(1, "abc", None)]))
    assert langid.identify(make_docs([(1, "abc", None)]), none).first().lang_pred == "und"
    assert langid.identify(make_docs([]), model).count() == 0


def test_letters_are_bound_by_place():
    table = langid.Grams()
    ab, ba = (langid.bundle(*langid.trigrams(t), table) for t in ("ab", "ba"))
    assert abs(ab @ ba) / (np.linalg.norm(ab) * np.linalg.norm(ba)) < 0.2


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = toxicity.held_out(F.col("doc_id"))
    model = toxicity.train(docs, labels.where(~out))
    rows = toxicity.score_documents(docs.join(labels, "doc_id"), model).select("doc_id", "toxic", "score", "predicted", out.alias("o")).collect()
    assert all(r.o == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.o]
    bad, good = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    assert np.mean([[(b > g) + (b == g) / 2 for g in good] for b in bad]) > 0.95
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.95 and np.mean([s >= 0.5 for s in good]) < 0.01


def test_toxicity_of_long_texts(spark):
    """Thousands of clean sentences stay clean, and one toxic document among them is caught."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scorer = toxicity.train(docs, labels).scorer()
    rows = docs.join(labels, "doc_id").where("text is not null").orderBy("doc_id").collect()
    clean, size = [], 0
    for r in [r for r in rows if not r.toxic] * 20:
        clean.append(r.text)
        size += len(toxicity.sentences(r.text))
        if size >= 5_000:
            break
    assert size >= 5_000 and scorer.score(". ".join(clean))[0] < 0.5
    toxic = [r.text for r in rows if r.toxic and scorer.score(r.text)[1]][:20]
    assert toxic and all(scorer.score(". ".join([*clean, t]))[0] >= 0.5 for t in toxic)
    # Without words above the background the score is bounded, however long the text is.
    unknown = scorer.score("qqzx vvkj. " * 50_000)[0]
    assert unknown <= -np.expm1(-toxicity.MOST_BACKGROUND) + 1e-9


def test_toxicity_finds_the_sentence(spark, make_docs):
    draw = random.Random(10)
    plain = [f"w{i}" for i in range(60)]
    sentence = lambda extra=(): " ".join([*draw.choices(plain, k=8), *extra])
    rows, labels = [], []
    for i in range(200):
        parts = [sentence() for _ in range(5)]
        if i % 4 == 0:
            parts[draw.randrange(5)] = sentence(["vile"])
        rows.append((i, ". ".join(parts) + "."))
        labels.append((i, int(i % 4 == 0)))
    known = spark.createDataFrame([*labels, (None, 1), (5000, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.train(make_docs(rows), known)
    test = make_docs([(1, "w1 w2. w3 vile w4! w5"), (2, "w1 w2. w3"), (3, None), (4, ""), (None, "vile"), (5, "w1 " * 9000), (6, "?!")])
    found = {r.doc_id: r for r in toxicity.score_documents(test.withColumn("predicted", F.lit("clash")), model).collect()}
    assert [(o.begin, o.end) for o in found[1].offending] == [(6, 17)] and found[1].predicted == 1
    assert found[2].predicted == found[5].predicted == 0 and found[None].predicted == 1
    assert found[3].score == found[4].score == found[6].score == pytest.approx(51 / 201)
    assert toxicity.score_documents(make_docs([]), model).count() == 0
    blank = toxicity.train(make_docs(rows), known.where("toxic = 9"))
    assert toxicity.score_documents(make_docs(rows), blank).where("predicted = 1").count() == 0


def test_very_long_words(spark, make_docs, library):
    """Words of tens of thousands of letters: rounds end when no pair is left."""
    rng = random.Random(8)
    texts = ["a" * 40_000, "".join(rng.choice("ab") for _ in range(20_000)), "".join(rng.choice("abcdefghijklmnop") for _ in range(4_000)), "é" * 9_000]
    found = {r.doc_id: r.ids for r in bpe.encode(make_docs(list(enumerate(texts))), RANKS, tokenizers.PATTERN).collect()}
    assert found == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch):
    """The sample's texts never reach the driver, which gets weights only."""
    driver, real = os.getpid(), toxicity.fit

    def only_in_a_task(*args):
        assert os.getpid() != driver
        return real(*args)

    rows = [(i, f"you awful idiot {i}." if i % 3 == 0 else f"a kind and sunny day {i}.", int(i % 3 == 0)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    want = toxicity.fit([t for _, t, _ in rows], np.array([y for *_, y in rows], float), (2 / 3, 1 / 3))
    monkeypatch.setattr(toxicity, "fit", only_in_a_task)
    got = toxicity.train(df.select("doc_id", "text").repartition(5), df.select("doc_id", "toxic"))
    assert np.allclose(got.weights, want.weights) and np.isclose(got.bias, want.bias) and np.isclose(got.empty, 1 / 3)

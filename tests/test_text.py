import math
import re

from pyspark.sql import functions as F

from dataquarry.functions.text import clean_text, clean_words, raw_tokens, tokenize
from dataquarry.operators import text as X
from dataquarry.operators import topics as T


def clean(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    return [r["c"] for r in df.orderBy("i").select(clean_text(F.col("t")).alias("c")).collect()]


def test_clean_text_rules(spark):
    got = clean(spark, [
        "ñ12 12 a", "Ver HTTP://x.y/z?q=1, www.a.b y mail a.b@c.d!", None, "", "  Año 2020\tfin ", "@solo a@ 7th 007", "中文 ok",
    ])
    assert got == ["ñ12 a", "ver y mail", "", "", "año fin", "solo a 7th", "ok"]


def test_clean_text_equals_the_step_by_step_definition(spark):
    import random

    random.seed(1)
    alphabet = "ab1 2@.:/-ñé\tÑ ü0_x\n"
    texts = ["".join(random.choice(alphabet) for _ in range(40)) + random.choice([" http://a b", " www.q", ""]) for _ in range(400)]

    def expected(t):
        t = t.lower()
        for pattern in (r"http\S+|www\.\S+", r"\S+@\S+", r"[^a-záéíóúüñ0-9\s]", r"\b\d+\b", r"\s+"):
            t = re.sub(pattern, " ", t)
        return t.strip()

    assert clean(spark, texts) == [expected(t) for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.filter(raw_tokens(F.col("t")) != tokenize(clean_text(F.col("t")))).count() == 0


def test_tokens_have_two_characters(spark):
    df = spark.createDataFrame([("a bb ccc",)], "t string")
    assert df.select(tokenize(F.col("t")).alias("x")).first()["x"] == ["bb", "ccc"]


def test_lemmatize_keeps_order_and_empty_documents(spark):
    df = spark.createDataFrame([(1, "los gatos comen los ratones"), (2, "los"), (3, "")], "id int, t string")
    lemmas = spark.createDataFrame([("gatos", "gato"), ("comen", "comer")], "token string, lemma string")
    out = {r["id"]: r["lemmatized"] for r in X.lemmatize(df, "id", "t", lemmas, X.stop_words(spark)).collect()}
    assert out == {1: "gato comer ratones", 2: "", 3: ""}
    assert {r["id"]: r["lemmatized"] for r in X.lemmatize(df, "id", "t").collect()}[1] == "los gatos comen los ratones"


def test_lemmatize_paths_agree(spark, monkeypatch):
    import random

    draw = random.Random(5)
    words = ["".join(draw.choice("abñ") for _ in range(draw.randrange(1, 4))) for _ in range(60)]
    texts = [(i, " ".join(draw.choice([*words, ""]) for _ in range(draw.randrange(0, 40)))) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(texts, "id int, t string")
    known = sorted(set(words))
    lemmas = spark.createDataFrame([(w, w[:1] * 2 + " x" if i % 4 else None) for i, w in enumerate(known[::2])] + [("zz", "unused")], "token string, lemma string")
    stops = spark.createDataFrame([(w,) for w in known[::5]] * 2 + [(None,)], "token string")
    table = {w: (w[:1] * 2 + " x" if i % 4 else w) for i, w in enumerate(known[::2])}
    for use in ((lemmas, stops), (lemmas, None), (None, stops)):
        gone = set(known[::5]) if use[1] is not None else set()
        swap = table if use[0] is not None else {}
        expected = {i: " ".join(swap.get(w, w) for w in (t or "").split(" ") if w and w not in gone) for i, t in texts}
        looked_up = X.lemmatize(df, "id", "t", *use)
        assert {r["id"]: r["lemmatized"] for r in looked_up.collect()} == expected
        assert "Exchange" not in looked_up._jdf.queryExecution().executedPlan().toString()
        with monkeypatch.context() as m:
            m.setattr(X, "DICTIONARY_BYTES", 10)
            assert {r["id"]: r["lemmatized"] for r in X.lemmatize(df, "id", "t", *use).collect()} == expected


def test_lemmatize_joins_blocks_of_texts(spark, monkeypatch):
    """A dictionary too large for the row: rows that share a key, or have none, stay rows of their own."""
    rows = [(1, "a  b c"), (1, "c a"), (None, "b b"), (2, None), (3, "")] + [(k, f"w{k} a w{k % 3}") for k in range(4, 40)]
    df = spark.createDataFrame(rows, "id int, t string").repartition(3)
    lemmas = spark.createDataFrame([("a", "x"), ("w5", "y"), ("w1", "")], "token string, lemma string")
    stops = spark.createDataFrame([("b",), ("w2",)], "token string")
    monkeypatch.setattr(X, "DICTIONARY_BYTES", 1)
    monkeypatch.setattr(X, "BLOCK_CHARS", 40)
    found = X.lemmatize(df, "id", "t", lemmas, stops)
    assert found.columns == ["id", "t", "lemmatized"]
    change = {"a": "x", "w5": "y", "w1": "", "b": None, "w2": None}
    expected = [
        (k, t, " ".join(w for w in (change.get(w, w) for w in (t or "").split(" ") if w) if w is not None)) for k, t in rows
    ]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


def test_lemmatize_repeated_keys_and_marks(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "b a"), (None, "a")], "id int, t string")
    assert sorted(r[0] for r in X.lemmatize(df, "id", "t", spark.createDataFrame([("a", "c")], "token string, lemma string")).select("lemmatized").collect()) == ["b c", "c", "c b"]
    empty = spark.createDataFrame([], "token string, lemma string")
    assert sorted(r[0] for r in X.lemmatize(df, "id", "t", empty).select("lemmatized").collect()) == ["a", "a b", "b a"]
    marked = spark.createDataFrame([("a", "c\x01")], "token string, lemma string")
    rows = X.lemmatize(df.filter("id = 1").limit(1), "id", "t", marked).collect()
    assert "c\x01" in rows[0]["lemmatized"]


def test_tfidf_definition(spark):
    docs = {1: "aa aa bb", 2: "aa cc", 3: "cc cc dd", 4: ""}
    df = spark.createDataFrame(list(docs.items()), "id int, t string")
    got = {(r["id"], r["term"]): r["weight"] for r in X.tfidf(df, "id", tokenize(F.col("t")), min_df=2).collect()}
    idf = math.log(5 / 3) + 1  # aa and cc are in two of four documents
    assert set(got) == {(1, "aa"), (2, "aa"), (2, "cc"), (3, "cc")}
    assert math.isclose(got[1, "aa"], 1.0) and math.isclose(got[2, "aa"], idf / math.sqrt(2 * idf * idf))
    assert X.tfidf(df, "id", tokenize(F.col("t")), min_df=50).count() == 0
    top = X.fit_tfidf(df, tokenize(F.col("t")), max_terms=1, min_df=1)
    assert [t for t, _ in top] == ["aa"]  # equal counts: the alphabetically first term stays


def test_embeddings_are_unit_vectors_and_order_free(spark):
    df = spark.createDataFrame([(1, "uno dos tres"), (2, "tres dos uno"), (3, "")], "id int, t string")
    e = {r["id"]: r["embedding"] for r in X.embed_text(df, clean_words(F.col("t"))).collect()}
    assert len(e[1]) == 384 and math.isclose(sum(x * x for x in e[1]), 1.0) and e[1] == e[2] and not any(e[3])


def test_encoder_gets_whole_texts_in_batches(spark):
    def load():
        return lambda texts: [[len(texts), len(t)] for t in texts]

    df = spark.range(300).select("id", F.repeat(F.lit("x"), 5000).alias("t")).coalesce(1)
    out = X.encode_text(df, "id", "t", load).collect()
    assert max(r["embedding"][0] for r in out) == 128 and {r["embedding"][1] for r in out} == {5000.0} and len(out) == 300


def test_keywords_and_payload(spark):
    rows = [(1, 0, "perro perro gato"), (2, 0, "perro casa"), (3, 1, "luna sol sol"), (4, -1, "ruido ruido ruido"), (5, 2, "")]
    df = spark.createDataFrame(rows, "id int, topic int, t string")
    tokens = tokenize(F.col("t"))
    words = T.class_tfidf_keywords(df, "topic", tokens)
    first = {r["topic"]: r["term"] for r in words.filter("rank = 1").collect()}
    assert first[0] == "perro" and first[1] == "sol"
    # The vocabulary is global: every topic ranks the same words, ties in reverse order.
    assert [r["term"] for r in words.filter("topic = 2").orderBy("rank").collect()] == ["sol", "perro", "luna", "gato", "casa"]
    own = T.class_tfidf_keywords(df, "topic", tokens, vocab="per_topic")
    assert {r["term"] for r in own.filter("topic = 1").collect()} == {"luna", "sol"}
    payload = {r["topic"]: r for r in T.topic_payload(df, "topic", "id", "t", tokens).collect()}
    assert set(payload) == {0, 1, 2} and sorted(payload[0]["context"]) == ["perro casa", "perro perro gato"]
    assert T.topic_stats(df, "topic").first().asDict() == {"n_topics": 3, "noise_pct": 20.0, "n_rows": 5}

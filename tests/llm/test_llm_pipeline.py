"""The pipeline against a plain version of every stage, and the registered queries against SQL."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from dataquarry.llm import langid, queries, toxicity
from dataquarry.llm.common import source

from test_llm_native import expected_hits
from test_llm_text import expected_components, tokenizers

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(queries.all_sql()))
def test_query_equals_sql(spark, name):
    found = queries.all_queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    expected = con.sql(queries.all_sql()[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    rows = lambda df: sorted(tuple("" if x is None or x != x else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(found) == rows(expected)


def test_every_operator_is_registered(spark):
    names = list(queries.all_queries())
    assert [n for i in range(1, 14) for n in names if n.startswith(f"op{i}_")] == names and len(names) == 13


def test_pipeline_equals_plain_version(spark):
    """Models are trained by the operators; every decision is made again here, row by row."""
    docs = source(spark, SF, "documents")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    stage, kept = docs, dict(rows)

    table, model = langid.Grams(), langid.train(docs)
    kept = {k: r for k, r in kept.items() if model.predict(r.text, table)[0] != "und"}
    stage = pipeline.language(spark, stage, SF)
    assert stage.columns == columns and {r.doc_id for r in stage.collect()} == set(kept)

    scorer = toxicity.train(stage, source(spark, SF, "labels")).scorer()
    kept = {k: r for k, r in kept.items() if scorer.score(r.text)[0] < 0.5}
    stage = pipeline.toxic(spark, stage, SF)
    assert stage.columns == columns and {r.doc_id for r in stage.collect()} == set(kept)

    component, _ = expected_components([(k, r.text) for k, r in kept.items()], 5, 80)
    kept = {k: r for k, r in kept.items() if component[k] == k}
    stage = pipeline.near_duplicates(spark, stage, SF)
    assert stage.columns == columns and sorted(r.doc_id for r in stage.collect()) == sorted(kept)

    items = [(r.item_id, r.text) for r in source(spark, SF, "benchmark").collect()]
    hit = {r[0] for r in expected_hits([(k, r.text) for k, r in kept.items()], items) if r[-1]}
    assert hit
    kept = {k: r for k, r in kept.items() if k not in hit}
    stage = pipeline.benchmark(spark, stage, SF)
    assert stage.columns == columns and {r.doc_id: r.text for r in stage.collect()} == {k: r.text for k, r in kept.items()}

    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizers.path(pipeline.RANKS), "rb"))}
    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r.doc_id: list(r.ids) for r in pipeline.tokens(spark, stage, SF).collect()}
    assert found == {k: own.encode_ordinary(r.text) for k, r in kept.items()}
    assert {r.doc_id: list(r.ids) for r in pipeline.run(spark, SF).collect()} == found


def test_toxic_words_are_rejected(spark):
    """Clean documents stay, toxic ones go."""
    docs, labels = source(spark, SF, "documents"), source(spark, SF, "labels")
    left = {r.doc_id for r in pipeline.toxic(spark, docs, SF).select("doc_id").collect()}
    known = labels.join(docs.select("doc_id"), "doc_id").collect()
    assert np.mean([r.doc_id in left for r in known if not r.toxic]) > 0.99
    assert np.mean([r.doc_id in left for r in known if r.toxic]) < 0.1


def test_stages_on_odd_rows(spark, make_docs, tmp_path):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, "en"), (2, text, "en"), (None, text, "en"), (None, "eins zwei drei vier fünf sechs", "de"), (None, "eins zwei drei vier fünf sechs", "de"),
            (3, None, "en"), (4, "", None), (5, "!? 12", None), (6, "six seven", "en"), (6, "six seven", "en"), (7, "some other words are written here " * 400, "en")]
    docs = make_docs(rows).withColumn("extra", F.lit(1))
    for name in ("_id", "_row", "_key", "_lang", "_score", "_doc", "_hit_key", "_host", "_found", "k", "b", "id"):
        docs = docs.withColumn(name, F.lit("mine"))
    sf = str(tmp_path)
    spark.createDataFrame([(1, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "Seven! EIGHT")], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    one = pipeline.language(spark, docs, sf)
    assert one.columns == docs.columns and one.count() == 8
    two = pipeline.toxic(spark, one, sf)
    assert two.count() == 8
    three = pipeline.near_duplicates(spark, two, sf)
    assert sorted(((r.doc_id, r.text[:4]) for r in three.collect()), key=str) == [(1, "one "), (6, "six "), (7, "some"), (None, "eins")]
    four = pipeline.benchmark(spark, three, sf)
    assert sorted((r.doc_id for r in four.collect()), key=str) == [6, 7, None]
    assert four.columns == docs.columns and {r[c] for r in four.collect() for c in docs.columns[6:]} == {"mine"}
    again = make_docs([(1, text), (1, "entirely different words stand in this row here"), (1, ""), (1, ""), (2, text), (2, text)])
    assert sorted((r.doc_id, r.text[:8]) for r in pipeline.near_duplicates(spark, again, sf).collect()) == [(1, ""), (1, ""), (1, "entirely"), (1, "one two ")]
    assert pipeline.tokens(spark, four, sf).count() == 3
    empty = make_docs([])
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0

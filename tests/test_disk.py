"""What analyses leave on the shared folder and on the disks of the executors."""

import os
import time

import pytest
from pyspark.sql import functions as F

from dataquarry import runtime
from dataquarry.operators import supervised as M
from dataquarry.plans.topics import run_topics

WORDS = ["sol luna estrella cielo noche", "pan queso vino aceite sal", "tren coche barco avion moto"]


def tables(spark):
    folder = f"{runtime.shared_dir(spark)}/dataquarry".removeprefix("file:")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_topics_keep_one_copy_of_the_texts(spark):
    notes = spark.createDataFrame([(i, f"{WORDS[i % 3]} {WORDS[i % 3].split()[i % 5]}") for i in range(120)], "id int, nota string")
    before = tables(spark)
    found = run_topics(notes, "id", "nota")
    assert found.rows.count() == 120 and found.rows.columns == ["id", "nota", "nota_clean", "lemmatized", "Topic_ID"]
    assert found.rows.where("lemmatized <> nota_clean").count() == 0 and found.payload.count() == found.stats.first()["n_topics"]
    left = {name.split("-")[0] for name in tables(spark) - before}
    assert left == {"lemmas", "vectors", "reduced", "topics", "merged", "description"}
    texts = [n for n in tables(spark) - before if "nota" in spark.read.parquet(f"{runtime.shared_dir(spark)}/dataquarry/{n}").columns]
    assert [n.split("-")[0] for n in texts] == ["lemmas"]


def test_written_tables_leave_no_shuffle_files(spark):
    files = lambda: {f.getName() for f in _files(spark) if f.getName().startswith("shuffle_")}
    before = files()
    table = runtime.materialise(spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).count(), "counts")
    limit = time.time() + 20
    while files() - before and time.time() < limit:
        time.sleep(0.2)
    assert not files() - before and table.count() == 5000
    assert spark.conf.get(runtime._TIDY) == "false" and not runtime._tidying


def _files(spark):
    found = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return [found.apply(i) for i in range(found.size())]


def test_scratch_covers_its_own_threads(spark):
    with runtime.scratch(spark):
        inside = runtime.concurrently(spark, lambda i: runtime.new_path(spark, "x"), range(2), 2)
        assert all("/scratch-" in p for p in inside)
    assert "/scratch-" not in runtime.new_path(spark, "x")
    kept = runtime.distil(spark, lambda: runtime.materialise(spark.range(7), "inner"), "outer")
    assert kept.count() == 7 and not any(n.startswith("scratch") for n in tables(spark))


@pytest.mark.parametrize("many", [0, 10**9])
def test_folds_of_large_tables_are_not_written(spark, monkeypatch, many):
    """A large table is written once for all folds; small ones keep their features of every fold."""
    monkeypatch.setattr(M, "MANY_ROWS", many)
    df = spark.range(400).select(
        (F.col("id") % 5).cast("int").alias("fold"), (F.col("id") % 7 > 2).cast("double").alias("label"), (F.col("id") % 7).cast("double").alias("a")
    )
    written = []
    keep = runtime.write_table
    monkeypatch.setattr(runtime, "write_table", lambda t, path, *mode: written.append(path.rsplit("/", 1)[1].split("-")[0]) or keep(t, path, *mode))
    scores = M.cross_validate(df, ["a"], [], "classification", models=("baseline", "linear"))
    assert scores.count() == 10 and scores.where("model = 'linear' and score < 0.99").count() == 0
    assert written.count("training") == (0 if many == 0 else 10) and written.count("folded") == (1 if many == 0 else 0)

"""Exact duplicates by a tree merge of sorted digest runs.

1. Every row gets a digest entry: a short hash to sort by, SHA-256 and the byte length to
   verify with, its id, and its own number.  The partition that read it is its first node.
2. A node's entries are sorted; of equal ones the first, which has the smallest id, stays
   with their count.  That is the node's run.
3. In each round a node sends every entry to the node whose number has the round's digit
   replaced by a digit of the hash, so sixteen runs at a time exchange their parts.  The
   shuffle's sort merges the parts that arrive, and step 2 repeats.
4. After as many rounds as node numbers have digits, a hash decides its node alone, so
   every text has one entry.  The answers return over the first runs, at most one for a
   text and node, and from there to the rows.

Entries are equal only if hash, SHA-256 and length all are: the sort key alone decides
nothing.  Copies are combined before every exchange: however many rows hold a text, no node
sends it more than once, and no node receives it from more than sixteen others a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataquarry.llm.common import remove, written

#: Bits of a digit: runs that are merged at a time are two to this power.
DIGIT_BITS = 4
HASH_BITS = 64
KEYS = ["digest", "sha", "bytes"]


def normalised(text: Column) -> Column:
    """The text with every run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _same(left: pa.RecordBatch, right: pa.RecordBatch) -> np.ndarray:
    """Row by row, whether node and verified digest agree."""
    same = np.ones(left.num_rows, bool)
    for name in ("node", "digest", "bytes"):
        same &= left.column(name).to_numpy() == right.column(name).to_numpy()
    if not same.any():
        return same
    at = np.flatnonzero(same)
    equal = [a == b for a, b in zip(left.column("sha").take(pa.array(at)).to_pylist(), right.column("sha").take(pa.array(at)).to_pylist())]
    same[at] = equal
    return same


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first of equal entries of a sorted run, with the sum of their counts."""
    held: pa.RecordBatch | None = None

    def counted(batch: pa.RecordBatch, copies: np.ndarray) -> pa.RecordBatch:
        return batch.set_column(batch.schema.get_field_index("copies"), "copies", pa.array(copies, pa.int64()))

    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        new = np.concatenate([[True], ~_same(batch.slice(0, batch.num_rows - 1), batch.slice(1))])
        at = np.flatnonzero(new)
        firsts = counted(batch.take(pa.array(at)), np.add.reduceat(batch.column("copies").to_numpy(), at))
        held = firsts.slice(firsts.num_rows - 1)
        yield firsts.slice(0, firsts.num_rows - 1)
    if held is not None:
        yield held


def _sorted(entries: DataFrame) -> DataFrame:
    """Entries of a task as sorted runs of their nodes, copies combined."""
    order = ["node", *KEYS, F.col("id").asc_nulls_last(), "row"]
    return entries.sortWithinPartitions(*order).mapInArrow(combine, entries.schema)


def _exchanged(runs: DataFrame, level: int, nodes: int) -> DataFrame:
    """Every entry at the node whose digit number ``level`` is that of its hash."""
    place = 1 << DIGIT_BITS * level
    mask = (1 << DIGIT_BITS) - 1
    own = F.shiftright("node", DIGIT_BITS * level).bitwiseAND(mask)
    wanted = F.shiftrightunsigned("digest", HASH_BITS - DIGIT_BITS * (level + 1)).bitwiseAND(mask)
    moved = runs.withColumn("node", F.col("node") + (wanted - own) * place)
    return moved.repartitionById(nodes, F.col("node").cast("int"))


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, keep_id, group_size, kept, text_sha256)`` for every row.

    Texts are equal if they are after white space is made even (``normalised``); null and
    empty texts are equal.  The row with the smallest key is kept, null keys last; of rows
    with the same text and the same key exactly one is kept.  ``keep_id`` is the kept row's
    key, null only if no row of the group has one.  Keys that are repeated for different
    texts are no reason to drop a row.  Other columns are left out; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    entries = written(
        docs.select(F.col(key).alias("id"), normalised(F.col(text)).alias("t")).select(
            "id", F.monotonically_increasing_id().alias("row"), F.spark_partition_id().cast("bigint").alias("node"),
            F.xxhash64("t").alias("digest"), F.unhex(F.sha2("t", 256)).alias("sha"), F.octet_length("t").cast("bigint").alias("bytes"),
            F.lit(1).cast("bigint").alias("copies"),
        ),
        "digests",
    )
    last = entries.agg(F.max("node")).first()[0] or 0
    levels = max(1, -(-int(last).bit_length() // DIGIT_BITS))
    nodes = min(1 << DIGIT_BITS * levels, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    first = written(_sorted(entries), "digest-run")
    run = first
    for level in range(levels):
        merged = written(_sorted(_exchanged(run, level, nodes)), "digest-run")
        if run is not first:
            remove(run)
        run = merged
    answers = first.select("node", *KEYS).join(
        run.select(*KEYS, F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("copies").alias("group_size")), KEYS
    )
    return entries.select("id", "row", "node", *KEYS).join(answers.distinct(), ["node", *KEYS]).select(
        F.col("id").alias(key), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def exact_duplicates_sql() -> str:
    return r"""
        WITH n AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
        )
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
        FROM n WINDOW g AS (PARTITION BY text_sha256)
    """

"""Benchmark decontamination by winnowing, with DataFrame functions only.

Every document is turned into hashes of ``k`` consecutive words; of each ``w``
consecutive hashes the smallest (the rightmost of equal ones) is an anchor.  A window
of ``k + w - 1`` words contains exactly one set of ``w`` hashes, so equal windows have the
same anchor at the same place: documents and benchmark are joined by anchors alone,
about ``2 / (w + 1)`` of the words, and no shared window is missed.  A hit is extended
to the windows around it by comparing words, so equal hashes of different words do no
harm.  A benchmark item shorter than the window is one window of its own length; for
each such length that occurs every run of so many document words is an anchor.

A bit table of the benchmark's anchors (at most 2^23 bits) filters the documents' anchors
inside the row.  It only saves work: a full table lets everything through to the join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataquarry.llm.common import fresh, let, literal_longs, lower_ascii, written

WINDOW, GRAM = 10, 5
#: Word characters: digits, lower-case letters, everything beyond ASCII (fixed value).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TABLE_BITS = 23


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; null has none."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def grams(word_hashes: Column, k: int, tag: int) -> Column:
    """A hash of every ``k`` consecutive words."""
    return F.when(
        F.size(word_hashes) >= k,
        F.transform(
            F.sequence(F.lit(0), F.size(word_hashes) - k),
            lambda i: F.xxhash64(F.lit(tag), *[F.get(word_hashes, i + j) for j in range(k)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _run(hashes: Column, i: Column, value: Column, step: int, most: int) -> Column:
    """Up to ``most`` neighbours on one side that do not keep ``value`` from being the rightmost smallest."""
    out = F.lit(most)
    for d in range(most, 0, -1):
        other = F.get(hashes, i + step * d) if step > 0 else F.when(i >= d, F.get(hashes, F.greatest(i - d, F.lit(0))))
        stops = other <= value if step > 0 else other < value
        out = F.when(F.coalesce(stops, F.lit(True)), d - 1).otherwise(out)
    return out


def anchors(hashes: Column, w: int) -> Column:
    """Positions of hashes that are the rightmost smallest of some ``w`` consecutive ones."""
    if w == 1:
        return F.when(F.size(hashes) > 0, F.sequence(F.lit(0), F.size(hashes) - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(
        F.size(hashes) >= w,
        F.filter(
            F.sequence(F.lit(0), F.size(hashes) - 1),
            lambda i: let(F.get(hashes, i), lambda v: _run(hashes, i, v, -1, w - 1) + _run(hashes, i, v, 1, w - 1) + 1 >= w),
        ),
    ).otherwise(F.array().cast("array<int>"))


def _shape(length: int, window: int, gram: int) -> tuple[int, int]:
    """``(k, w)`` for windows of a length: short ones are hashed whole."""
    k = min(gram, window) if length == window else length
    return k, length - k + 1


def benchmark_windows(items: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """``(item_id, window)``: distinct windows of every item, null ids as the empty text."""
    cut = let(
        words(F.col(text)),
        lambda w: F.when(F.size(w) >= window, F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda s: F.slice(w, s + 1, window)))
        .when(F.size(w) > 0, F.array(w))
        .otherwise(F.array().cast("array<array<string>>")),
    )
    return items.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item_id"), F.explode(cut).alias("window")
    ).distinct()


def _anchored(windows: DataFrame, lengths: list[int], window: int, gram: int) -> DataFrame:
    """Distinct windows with the hash and the place of their anchor."""

    def find(length: int) -> Column:
        k, _ = _shape(length, window, gram)
        return let(
            grams(F.transform("window", lambda x: F.xxhash64(x)), k, length),
            lambda g: let(
                F.array_max(F.transform(g, lambda h, i: F.struct((-i).alias("back"), h.alias("h")))) if length < window
                else F.array_min(F.transform(g, lambda h, i: F.struct(h.alias("h"), (-i).alias("back")))),
                lambda best: F.struct(best["h"].alias("h"), (-best["back"]).alias("place")),
            ),
        )

    out = F.lit(None).cast("struct<h:bigint,place:int>")
    for length in lengths:
        out = F.when(F.size("window") == length, find(length)).otherwise(out)
    return windows.select("window").distinct().withColumn("_a", out).select("window", "_a.h", "_a.place")


def _bit_table(anchored: DataFrame) -> tuple[int, Column]:
    """Size in bits (a power of two) and the table as a literal."""
    count = anchored.select("h").distinct().count()
    bits = min(TABLE_BITS, max(10, (16 * count).bit_length()))
    slot = F.col("h").bitwiseAND((1 << bits) - 1)
    filled = dict(
        anchored.groupBy(F.shiftright(slot, 6).alias("at"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(63).cast("int"))).alias("v"))
        .collect()
    )
    return bits, literal_longs([filled.get(i, 0) for i in range(1 << (bits - 6))])


def _bit(table: Column, bits: int, h: Column) -> Column:
    slot = h.bitwiseAND((1 << bits) - 1)
    word = F.get(table, F.shiftright(slot, 6).cast("int"))
    return F.call_function("getbit", word, slot.bitwiseAND(63).cast("int")) == 1


def hits(
    docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW, gram: int = GRAM,
) -> tuple[DataFrame, DataFrame]:
    """All occurrences of benchmark windows.

    Returns ``(doc, _key, start, window)``, the first word's number and the words of each distinct
    occurrence, and ``(item_id, window)``.  ``_key`` is a hash of the text, so that
    rows that share an id are told apart.
    """
    by_item = written(benchmark_windows(items, item, item_text, window), "benchmark-windows")
    lengths = sorted(r[0] for r in by_item.select(F.size("window")).distinct().collect())
    key = F.xxhash64(F.col(text)).alias("_key")
    if not lengths:
        schema = docs.select(doc, key, F.lit(0).alias("start")).schema
        none = docs.sparkSession.createDataFrame([], schema)
        return none.withColumn("window", F.array().cast("array<string>")), by_item
    anchored = written(_anchored(by_item, lengths, window, gram), "benchmark-anchors")
    bits, table = _bit_table(anchored)

    def found(w: Column, hashes: Column) -> Column:
        def of_length(length: int) -> Column:
            k, span = _shape(length, window, gram)
            return let(grams(hashes, k, length), lambda g: F.transform(
                F.filter(anchors(g, span), lambda i: _bit(table, bits, F.get(g, i))),
                lambda i: F.struct(
                    i.alias("pos"), F.get(g, i).alias("h"), F.least(i, F.lit(span - 1)).alias("lead"),
                    F.slice(w, F.greatest(i - (span - 1), F.lit(0)) + 1, k + 2 * (span - 1)).alias("near"),
                ),
            ))

        return reduce(F.concat, map(of_length, lengths))

    seen = let(words(F.col(text)), lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda hs: found(w, hs)))
    met = docs.select(doc, key, F.explode(seen).alias("_s")).select(doc, "_key", "_s.*").join(anchored, "h")
    shift = F.col("lead") - F.col("place")
    same = F.when(shift >= 0, F.slice("near", F.greatest(shift, F.lit(0)) + 1, F.size("window")) == F.col("window"))
    return (
        met.where(same).select(doc, "_key", (F.col("pos") - F.col("place")).alias("start"), "window").distinct(),
        by_item,
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW, gram: int = GRAM,
) -> DataFrame:
    """Words, hit words and benchmark items per document row.

    A word is hit if any occurrence of a benchmark window covers it.  Rows without text
    have no words; an item without words hits nothing; an item with a null id counts as
    the empty id; repeated rows get equal results; an empty benchmark hits nothing.
    Returns ``(doc, n_words, n_hit, n_items, items, contaminated)``, ``items`` sorted as texts.
    """
    found, by_item = hits(docs, items, doc, text, item, item_text, window, gram)
    found = written(found, "benchmark-hits")
    end = F.col("start") + F.size("window")
    order = Window.partitionBy(doc, "_key").orderBy("start", end.desc())
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    covered = (
        found.withColumn("_new", F.greatest(end - F.greatest(F.col("start"), F.coalesce(reach, F.lit(0))), F.lit(0)))
        .groupBy(doc, "_key").agg(F.sum("_new").cast("bigint").alias("n_hit"))
    )
    listed = (
        found.select(doc, "_key", "window").distinct().join(by_item, "window")
        .groupBy(doc, "_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    summary = (
        covered.alias("c").join(listed.alias("l"), [F.col(f"c.{doc}").eqNullSafe(F.col(f"l.{doc}")), F.col("c._key") == F.col("l._key")])
        .select(F.col(f"c.{doc}").alias("_doc"), F.col("c._key").alias("_hit_key"), "n_hit", "items")
    )
    base = docs.select(F.col(doc), F.xxhash64(F.col(text)).alias("_key"), F.size(words(F.col(text))).cast("bigint").alias("n_words"))
    items_or_none = F.coalesce("items", F.array().cast("array<string>"))
    return base.join(summary, [F.col(doc).eqNullSafe(F.col("_doc")), F.col("_key") == F.col("_hit_key")], "left").select(
        doc, "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(items_or_none).cast("bigint").alias("n_items"), items_or_none.alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def without_hits(
    docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW, gram: int = GRAM,
) -> DataFrame:
    """The rows, with all their columns, in which no window of the benchmark occurs."""
    found, _ = hits(docs, items, doc, text, item, item_text, window, gram)
    hit_doc, hit_key = fresh(docs, "_doc", "_hit_key")
    bad = written(found.select(F.col(doc).alias(hit_doc), F.col("_key").alias(hit_key)).distinct(), "benchmark-hits")
    return docs.join(bad, [F.col(doc).eqNullSafe(F.col(hit_doc)), F.xxhash64(F.col(text)) == F.col(hit_key)], "left_anti")


def decontamination_sql(window: int = WINDOW) -> str:
    """The digest of ``decontaminate`` in SQL, by comparing every window."""
    take = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"
    return f"""with iw as (select coalesce(cast(item_id as varchar), '') as item_id, {take} as w from benchmark),
    win as (select distinct item_id, len(p) as m, array_to_string(p, ' ') as t from (
      select item_id, unnest(case when len(w) >= {window} then list_transform(range(len(w) - {window - 1}), lambda s: w[s + 1 : s + {window}]) else [w] end) as p from iw where len(w) > 0)),
    dw as (select doc_id, {take} as w from documents),
    runs as (select doc_id, m, s, array_to_string(w[s + 1 : s + m], ' ') as t from (
      select doc_id, w, m, unnest(range(len(w) - m + 1)) as s from dw, (select distinct m from win) where len(w) >= m)),
    met as (select r.doc_id, r.s, r.m, win.item_id from runs r join win on win.m = r.m and win.t = r.t),
    hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + m)) as p from met) group by doc_id),
    lst as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as l from (select distinct doc_id, item_id from met) group by doc_id)
    select dw.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
      sha256(coalesce(l, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from dw left join hit using (doc_id) left join lst using (doc_id)"""

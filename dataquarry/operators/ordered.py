"""Exact order statistics and running totals without a one-task sort.

``exact_quantiles``   exact, interpolated quantiles of many columns at once.
``running_totals``    a running sum over the whole table in a given order.
``rank_cuts``         per group, the rows at given ranks of a reproducible order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataquarry.functions.hashing import key_hash
from dataquarry.runtime import materialise

# Buckets that a range is cut into: over the whole table, and over the rows that are left.
FIRST_BUCKETS, LATER_BUCKETS = 1024, 4096


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., feature, n, q)``: exact quantiles, linearly interpolated, nulls ignored, NaN largest.

    Every wanted rank has a range of values, at first all of its column.  The range is cut
    into buckets, a histogram that is combined on the map side finds the bucket of each
    rank in it, and its least and greatest values are the next range, until they are equal.
    The first round reads the table; the rows of the buckets it found are written and
    the later rounds read only those.  No task gets more than one histogram per range.
    """
    by, columns, probs = list(by), list(columns), [float(p) for p in probs]
    if not columns:
        raise ValueError("exact_quantiles needs at least one column")
    values = df.select(
        *by, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), _c(c).cast("double").alias("v")) for c in columns]))
    ).filter("v is not null")
    own = [*by, "feature"]
    ranges = values.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = F.array(*[
        F.struct(F.lit(2 * i + up).alias("which"), (F.ceil if up else F.floor)(F.lit(p) * (F.col("n") - 1)).cast("bigint").alias("rank"))
        for i, p in enumerate(probs) for up in (0, 1)
    ])
    # Written, so that the size is known: one row per group and column is broadcast when that is small.
    ranges = materialise(ranges, "ranges")
    targets = ranges.select(*own, "n", "lo", "hi", F.inline(wanted))
    targets = materialise(_narrow(values, ranges.filter(_open()).select(*own, "lo", "hi"), targets, own, FIRST_BUCKETS), "ranks")
    left = targets.filter(_open()).select(*own, "lo", "hi").distinct()
    rows, still = values, left
    while not still.isEmpty():
        rows = materialise(_within(rows, left, own).select(*own, "v"), "bracket")
        targets = materialise(_narrow(rows, left, targets, own, LATER_BUCKETS), "ranks")
        left = still = targets.filter(_open()).select(*own, "lo", "hi").distinct()
    position = F.element_at(F.lit(probs), (F.col("i") + 1).cast("int")) * (F.col("n") - 1)
    picked = (
        targets.withColumn("i", F.floor(F.col("which") / 2))
        .groupBy(*own, "n", "i")
        .agg(F.min(F.when(F.col("which") % 2 == 0, F.col("lo"))).alias("a"), F.min(F.when(F.col("which") % 2 == 1, F.col("lo"))).alias("b"))
        .withColumn("pos", position)
        .withColumn("value", F.when(F.expr("a = b"), F.col("a")).otherwise(F.expr("a + (pos - floor(pos)) * (b - a)")))
    )
    return picked.groupBy(*own, "n").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda s: s["value"]).alias("q")
    )


def _open() -> Column:
    return ~F.col("lo").eqNullSafe(F.col("hi"))


def _within(rows: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the ranges of their keys (null keys included) that hold them."""
    same = " and ".join(f"x.`{k}` <=> t.`{k}`" for k in keys)
    joined = rows.alias("x").join(targets.alias("t"), F.expr(f"{same} and x.v >= t.lo and x.v <= t.hi"))
    return joined.select(
        *[F.col(f"x.`{c}`").alias(c) for c in rows.columns], *[F.col(f"t.`{c}`").alias(c) for c in targets.columns if c not in rows.columns]
    )


def _scale(v: str) -> Column:
    """A rising function that spreads magnitudes: the binary logarithm with the sign, infinities and NaN beyond."""
    x = F.col(v)
    size = F.log2(F.abs(x)) + 1080
    return (
        F.when(F.isnan(x), 1e5).when(x == float("inf"), 5e4).when(x == float("-inf"), -5e4)
        .when(x == 0, 0.0).when(x > 0, size).otherwise(-size)
    )


def _narrow(rows: DataFrame, ranges: DataFrame, targets: DataFrame, own: list[str], buckets: int) -> DataFrame:
    """The targets, open ones with the range and the remaining rank of the bucket that holds them.

    One histogram serves all ranks that share a range.  Ranges within a factor of four are
    cut evenly, wider ones by magnitude; both ends always fall into different buckets.
    """
    even = F.expr("(lo > 0 and hi < 4 * lo and hi < double('infinity')) or (hi < 0 and lo > 4 * hi and lo > -double('infinity'))")
    # Halves keep the width of a range finite.
    place = F.when(even, (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)).otherwise(
        (_scale("v") - _scale("lo")) / (_scale("hi") - _scale("lo"))
    )
    bucket = F.least(F.floor(place * buckets), F.lit(buckets - 1)).cast("int")
    cells = (
        _within(rows, ranges, own).select(*own, "v", "lo", "hi", bucket.alias("bucket"))
        .groupBy(*own, "lo", "hi", "bucket")
        .agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("from"), F.max("v").alias("to"))
    )
    order = Window.partitionBy(*own, "lo", "hi").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("upto", F.sum("m").over(order))
    same = " and ".join(f"t.`{k}` <=> c.`{k}`" for k in [*own, "lo", "hi"])
    found = targets.filter(_open()).alias("t").join(cells.alias("c"), F.expr(f"{same} and t.rank < c.upto and t.rank >= c.upto - c.m")).select(
        *[F.col(f"t.`{k}`") for k in own], F.col("t.n"), F.col("c.from").alias("lo"), F.col("c.to").alias("hi"), F.col("t.which"),
        (F.col("t.rank") - (F.col("c.upto") - F.col("c.m"))).alias("rank"),
    )
    columns = [*own, "n", "lo", "hi", "which", "rank"]
    return targets.filter(~_open()).select(*columns).unionByName(found.select(*columns))


def quantiles_of(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Quantiles on the driver: one short list per column."""
    if not columns:
        return {}
    found = {r["feature"]: r["q"] for r in exact_quantiles(df, columns, probs).collect()}
    return {c: found.get(c) or [None] * len(probs) for c in columns}


def running_totals(df: DataFrame, order: Sequence[str], totals: dict[str, str], name: str = "running") -> DataFrame:
    """Add, for every ``out: column`` of ``totals``, the sum of all *earlier* rows.

    Two levels: the table is written range-partitioned by ``order`` (rows must be
    unique in it), each part gets an offset from the part sums, and a window runs
    inside the parts only.  The offset table has one row per part.
    """
    parts = materialise(
        df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()), name
    )
    offsets = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in totals.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(
        "_part", *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in totals]
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.join(F.broadcast(offsets), "_part")
    for o, c in totals.items():
        out = out.withColumn(o, F.col(f"_o_{o}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop("_part", *[f"_o_{o}" for o in totals])


# Hash buckets of the first level of rank_cuts: 2**20.
_SHIFT = 12


def rank_cuts(df: DataFrame, key: str, by: Sequence[str], ranks: Sequence[Column], salt: str) -> DataFrame:
    """``(by..., cuts)``: the ``(h, key)`` pairs at the given ranks of the hash order of each group.

    ``ranks`` are expressions over ``n``, the group size; a rank of 0 gives no cut
    (null).  A histogram of the hash locates the bucket of each rank, and only the
    rows of that bucket (about one in a million) are ranked.
    """
    by = list(by)
    hashed = df.select(*by, F.col(key).alias("_key"), key_hash(F.col(key), salt).alias("_h"))
    bins = hashed.groupBy(*by, F.shiftright("_h", _SHIFT).alias("_bin")).agg(F.count(F.lit(1)).alias("m"))
    group = Window.partitionBy(*by)
    bins = bins.withColumn("n", F.sum("m").over(group)).withColumn(
        "upto", F.sum("m").over(group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    )
    wanted = bins.select(
        *by, "_bin", "m", "upto",
        F.posexplode(F.array(*[r.cast("bigint") for r in ranks])).alias("which", "rank"),
    ).filter("rank > 0 and rank <= upto and rank > upto - m")
    # One row per group and rank; its known size lets Spark broadcast it.
    wanted = materialise(
        wanted.select(*by, "_bin", "which", (F.col("rank") - (F.col("upto") - F.col("m"))).alias("want")), "ranks"
    )
    hit = hashed.withColumn("_bin", F.shiftright("_h", _SHIFT)).join(wanted, [*by, "_bin"])
    inside = Window.partitionBy(*by, "which").orderBy("_h", "_key")
    cut = hit.withColumn("rn", F.row_number().over(inside)).filter("rn = want")
    cuts = cut.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("which", F.struct(F.col("_h").alias("h"), F.col("_key").alias("k"))))).alias("cuts")
    )
    return materialise(cuts, "cuts")

"""SimHash fingerprints and the search by permuted block tables, with DataFrame functions only.

Terms are pairs of neighbouring words (both ends of a text count as words), weighted by
their length, since short words are the common ones.  Every term has a 128-bit hash; each
bit votes with the term's weight for 1 or 0, and the majority is the fingerprint's bit.

The votes are counted four bits at a time: a multiplication spreads four bits over four
16-bit lanes of a long, so 32 sums count 128 bits inside generated code.  At most
``LANE_TERMS`` terms share a sum, which keeps every lane below 2^15; longer texts have
several sums, which are added bit by bit.

Search: fingerprints within Hamming distance ``radius`` agree in at least
``blocks - radius`` of ``blocks`` blocks, so one table for every choice of so many blocks,
keyed by them, holds each near pair in a common row.  From ``radius >= blocks`` on no block
need agree, but one differs in few bits (``allowances``): there every block has a table,
and a query asks it for all values within that block's allowance.

One replaced word changes two terms, about 81 / sqrt(words) bits of 128, so near copies
(four fifths of their five-word shingles) lie some ten bits apart and unrelated texts
about 64.  ``NEAR`` bits are the radius for near copies; with ``NEAR_BLOCKS`` tables each
block is asked for values within two bits.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataquarry.llm.common import let, literal_longs

BITS = 128
WORD = r"[\p{L}\p{M}\p{N}]+"
MOST_WEIGHT = 16
LANE_TERMS = 2_000
#: x * SPREAD & LANES puts bit j of x < 16 at bit 16 j (fixed values).
SPREAD, LANES = 0x0000200040008001, 0x0001000100010001
#: Groups of neighbouring documents per shuffle partition.
GROUPS = 16
#: Near copies differ in at most so many bits, searched in so many blocks.
NEAR, NEAR_BLOCKS = 23, 8


def terms(text: Column) -> Column:
    """``array<struct<one, two, weight>>``: the weighted term hashes of a text; null is empty."""
    words = F.concat(
        F.array(F.lit("^")), F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), F.array(F.lit("$"))
    )

    def pair(a: Column, b: Column) -> Column:
        return F.struct(
            F.xxhash64(a, b).alias("one"), F.xxhash64(b, a, F.lit(1)).alias("two"),
            F.least(F.length(a) + F.length(b), F.lit(MOST_WEIGHT)).cast("bigint").alias("weight"),
        )

    return let(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: pair(F.get(w, i), F.get(w, i + 1))))


def _lanes(half: str) -> list[Column]:
    return [
        F.sum(((F.shiftrightunsigned(half, 4 * j).bitwiseAND(15) * SPREAD).bitwiseAND(LANES)) * F.col("weight")) for j in range(16)
    ]


def _half(sums: Column, first: int) -> Column:
    """64 bits of the fingerprint from the lanes ``first ..`` of all sums."""

    def vote(bit: Column) -> Column:
        lane, shift = F.shiftright(bit, 2) + first, (bit.bitwiseAND(3) * 16).cast("int")
        ones = F.aggregate(
            sums, F.lit(0).cast("bigint"),
            lambda n, s: n + F.call_function("shiftright", F.get(s["lanes"], lane), shift).bitwiseAND(0xFFFF),
        )
        total = F.aggregate(sums, F.lit(0).cast("bigint"), lambda n, s: n + s["weight"])
        return F.when(2 * ones > total, F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda out, bit: out.bitwiseOR(vote(bit)))


def fingerprints(df: DataFrame, keys: list[str], texts: dict[str, str]) -> DataFrame:
    """``keys`` and, for ``{name: column}``, a struct ``name`` of ``hi``, ``lo`` (64 bits each).

    ``keys`` must tell the rows apart; other columns are left out.
    """
    variants = F.array(*[F.struct(F.lit(name).alias("name"), F.col(text).alias("text")) for name, text in texts.items()])
    rows = df.select(*keys, F.explode(variants).alias("_v")).select(
        *keys, F.col("_v.name").alias("_name"), F.posexplode(terms(F.col("_v.text"))).alias("_at", "_t")
    )
    votes = rows.select(*keys, "_name", F.floor(F.col("_at") / LANE_TERMS).alias("_part"), "_t.*")
    sums = votes.groupBy(*keys, "_name", "_part").agg(
        F.array(*_lanes("one"), *_lanes("two")).alias("lanes"), F.sum("weight").alias("weight")
    )
    gathered = sums.groupBy(*keys).agg(*[
        F.collect_list(F.when(F.col("_name") == name, F.struct("lanes", "weight"))).alias(name) for name in texts
    ])
    return gathered.select(*keys, *[F.struct(_half(F.col(n), 0).alias("hi"), _half(F.col(n), 16).alias("lo")).alias(n) for n in texts])


def as_text(fingerprint: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(fingerprint["hi"]), 16, "0"), F.lpad(F.hex(fingerprint["lo"]), 16, "0")))


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two fingerprints."""
    return F.bit_count(a["hi"].bitwiseXOR(b["hi"])) + F.bit_count(a["lo"].bitwiseXOR(b["lo"]))


def likeness(a: Column, b: Column) -> Column:
    return 1 - distance(a, b) / BITS


def allowances(radius: int, blocks: int) -> list[int]:
    """Bits by which each block may differ: a pair within the radius keeps to one of them at least."""
    even, more = divmod(radius + 1 - blocks, blocks)
    return [even + (i < more) for i in range(blocks)]


def _block(hi: Column, lo: Column, start: int, end: int) -> Column:
    """Bits ``start .. end - 1`` of a fingerprint, the highest first, as a number; at most 63 of them."""
    if start < 64 < end:
        high = hi.bitwiseAND((1 << (64 - start)) - 1)
        return F.shiftleft(high, end - 64).bitwiseOR(F.shiftrightunsigned(lo, 128 - end))
    half, end, start = (hi, end, start) if end <= 64 else (lo, end - 64, start - 64)
    return F.shiftrightunsigned(half, 64 - end).bitwiseAND((1 << (end - start)) - 1)


def _near_by_values(fingerprints_: DataFrame, queries: DataFrame, column: str, radius: int, blocks: int) -> DataFrame:
    """``near`` for ``radius >= blocks >= 3``: queries ask for every value a block may have within its allowance."""
    cut = [BITS * i // blocks for i in range(blocks + 1)]
    widest = max(cut[t + 1] - cut[t] for t in range(blocks))
    allowed = allowances(radius, blocks)
    long = lambda c, start: F.conv(F.substring(c, start, 16), 16, -10).cast("bigint")

    def tables(df: DataFrame, name: str, flips: list[int]) -> DataFrame:
        hi, lo = f"{name}_hi", f"{name}_lo"
        prints = df.where(F.col(column).isNotNull()).select(F.col(column).alias(name)).distinct()
        halves = prints.select(long(F.col(name), 1).alias(hi), long(F.col(name), 17).alias(lo))

        def values(t: int) -> Column:
            masks = [sum(1 << b for b in bits) | t << widest for k in range(flips[t] + 1) for bits in combinations(range(cut[t + 1] - cut[t]), k)]
            own = _block(F.col(hi), F.col(lo), cut[t], cut[t + 1])
            return let(own, lambda v: F.transform(literal_longs(masks), lambda m: v.bitwiseXOR(m)))

        return halves.select(hi, lo, F.explode(F.concat(*[values(t) for t in range(blocks)])).alias("key"))

    q, f = (F.col("query_hi"), F.col("query_lo")), (F.col("found_hi"), F.col("found_lo"))
    differ = q[0].bitwiseXOR(f[0]), q[1].bitwiseXOR(f[1])
    apart = F.bit_count(differ[0]) + F.bit_count(differ[1])
    first = F.lit(None).cast("int")
    for t in reversed(range(blocks)):
        first = F.when(F.bit_count(_block(*differ, cut[t], cut[t + 1])) <= allowed[t], F.lit(t)).otherwise(first)
    digits = lambda half: F.lower(F.concat(F.lpad(F.hex(half[0]), 16, "0"), F.lpad(F.hex(half[1]), 16, "0")))
    # Spark takes a table to be as small as before its explode, and would broadcast the thousandfold rows.
    return (
        tables(queries, "query", allowed).hint("merge").join(tables(fingerprints_, "found", [0] * blocks), "key")
        .where((apart > 0) & (apart <= radius) & (F.shiftright("key", widest) == first))
        .select(digits(q).alias("query"), digits(f).alias("found"), apart.alias("distance"))
    )


def near(fingerprints_: DataFrame, queries: DataFrame, column: str = "fingerprint", radius: int = 3, blocks: int = 4) -> DataFrame:
    """All pairs ``(query, found, distance)`` of different fingerprints within the radius.

    Both inputs hold fingerprints as 32 hexadecimal digits; copies are compared once, so
    membership of rows is by fingerprint.  A pair is taken from the first table that holds
    it.  Null fingerprints are near nothing.
    """
    if radius >= blocks:
        return _near_by_values(fingerprints_, queries, column, radius, blocks)
    digits = BITS // 4
    cut = [digits * i // blocks for i in range(blocks + 1)]
    choices = list(combinations(range(blocks), blocks - radius))

    def tables(df: DataFrame, name: str) -> DataFrame:
        f = F.col(column)
        part = [F.substring(f, cut[i] + 1, cut[i + 1] - cut[i]) for i in range(blocks)]
        keys = F.array(*[F.struct(F.lit(t).alias("t"), F.concat(*[part[i] for i in c]).alias("key")) for t, c in enumerate(choices)])
        return df.where(f.isNotNull()).select(f).distinct().select(f.alias(name), F.explode(keys).alias("_k")).select(name, "_k.*")

    long = lambda c, start: F.conv(F.substring(c, start, 16), 16, -10).cast("bigint")
    q, f = F.col("query"), F.col("found")
    apart = F.bit_count(long(q, 1).bitwiseXOR(long(f, 1))) + F.bit_count(long(q, 17).bitwiseXOR(long(f, 17)))
    agree = [F.substring(q, cut[i] + 1, cut[i + 1] - cut[i]) == F.substring(f, cut[i] + 1, cut[i + 1] - cut[i]) for i in range(blocks)]
    first = F.lit(None).cast("int")
    for t, choice in reversed(list(enumerate(choices))):
        every = agree[choice[0]]
        for i in choice[1:]:
            every = every & agree[i]
        first = F.when(every, F.lit(t)).otherwise(first)
    return (
        tables(queries, "query").join(tables(fingerprints_, "found"), ["t", "key"])
        .where((q != f) & (F.col("t") == first)).withColumn("distance", apart).where(F.col("distance") <= radius)
        .select("query", "found", "distance")
    )


def count_near(
    rows: DataFrame, queries: Column, column: str = "fingerprint", radius: int = 3, blocks: int = 4, out: str = "n_near"
) -> DataFrame:
    """``out``: for rows that are queries the number of other rows within the radius, else null.

    Copies are counted by fingerprint, and only different fingerprints are compared.
    """
    counts = rows.groupBy(column).agg(F.count("*").alias("_copies"))
    found = near(rows, rows.where(queries), column, radius, blocks).join(counts, F.col("found") == F.col(column))
    others = found.groupBy("query").agg(F.sum("_copies").alias("_others"))
    summary = counts.join(others, F.col(column) == F.col("query"), "left").select(
        F.col(column).alias("_print"), (F.col("_copies") - 1 + F.coalesce("_others", F.lit(0))).alias("_near")
    )
    return rows.join(summary, F.col(column) == F.col("_print"), "left").withColumn(out, F.when(queries, F.col("_near"))).drop("_print", "_near")


def neighbours(docs: DataFrame, key: str, text: str, groups: int | None = None) -> DataFrame:
    """Every row with the text that follows in the order of falling keys; the last is followed by the first.

    The order is cut into groups at keys picked by a hash, about ``groups`` of them; they
    only balance the work.  The head of every group also goes to the end of the group
    before it, so a group knows all its successors and texts are shuffled once.  Null
    keys come last; equal keys follow each other by a hash of the text.
    Returns ``_group, _row, _extra`` (``_extra``: a head that was added), the key, the text, ``next``.
    """
    spark = docs.sparkSession
    groups = groups or GROUPS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.coalesce(F.col(key).cast("bigint"), F.lit(-(2**63)))
    ids = docs.select(order.alias("k"))
    count, top = ids.agg(F.count("*"), F.max("k")).first()
    every = max(1, (count or 0) // groups)
    heads = sorted({r[0] for r in ids.where(F.pmod(F.xxhash64("k"), F.lit(every)) == 0).distinct().collect()} | {top or 0})
    table, n = literal_longs(heads), len(heads)
    steps = F.array(*[F.lit(1 << i) for i in range(n.bit_length(), -1, -1)])

    def below(k: Column) -> Column:
        """The number of heads smaller than a key, by bisection."""
        return F.aggregate(
            steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(table, at + step - 1) < k), at + step).otherwise(at)
        )

    placed = docs.select(F.col(key), F.col(text).alias("_text"), order.alias("_order"), below(order).alias("_own"))
    copies = F.when(
        F.get(table, F.col("_own")) == F.col("_order"),
        F.array(F.struct(F.col("_own").alias("g"), F.lit(0).alias("x")), F.struct(((F.col("_own") + 1) % n).alias("g"), F.lit(1).alias("x"))),
    ).otherwise(F.array(F.struct(F.col("_own").alias("g"), F.lit(0).alias("x"))))
    spread = placed.withColumn("_c", F.explode(copies)).select(
        F.col("_c.g").alias("_group"), F.col("_c.x").alias("_extra"), key, "_order", "_text"
    )
    falling = Window.partitionBy("_group").orderBy("_extra", F.col("_order").desc(), F.xxhash64("_text"))
    return spread.withColumns({"_row": F.row_number().over(falling), "next": F.lead("_text").over(falling)}).select(
        "_group", "_row", "_extra", key, F.col("_text").alias(text), "next"
    )


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited form and of the next document's text.

    The edited text has its last ``floor(n / 3)`` code points replaced by the first as many
    of the next document, by falling key.  Null texts are empty; the only document is its
    own successor; repeated rows are rows of their own.
    """
    own, other = F.coalesce(F.col(text), F.lit("")), F.coalesce("next", F.lit(""))
    part = F.floor(F.length(own) / 3).cast("int")
    rows = (
        neighbours(docs, key, text)
        .withColumn("_edited", F.concat(F.substr(own, F.lit(1), F.length(own) - part), F.substr(other, F.lit(1), part)))
        .withColumns({"n_chars": F.length(own).cast("bigint"), "edited_sha256": F.sha2(F.col("_edited").cast("binary"), 256)})
    )
    kept = ["_group", "_row", "_extra", key, "n_chars", "edited_sha256"]
    found = fingerprints(rows, kept, {"own": text, "edited": "_edited"})
    following = F.lead("own").over(Window.partitionBy("_group").orderBy("_row"))
    return found.withColumn("following", following).where("_extra = 0").select(
        key, "n_chars", "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )

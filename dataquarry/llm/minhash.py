"""Near-duplicates by MinHash: universal hash minima, banding, signature check, alternating stars.

1. A document is the set of hashes of its distinct word shingles.  ``BANDS * ROWS`` universal
   hashes give its minima; equal sets form a class, which its smallest id represents.
2. Representatives that agree in all rows of a band share a bucket.  A bucket is not
   expanded to pairs: its members are compared with its center, the member that meets most
   others over all buckets (an original has more in common with its copies than they with
   each other).
3. Signatures drop hopeless pairs; the others are decided on the full sets.
4. Two members that are linked to the center are connected already.  A member ``y`` that is
   linked, and ``x`` that is not, can only be linked if ``x`` is not too far from the center
   (triangle inequality) and if both differ from the center in common elements:
   with ``t = (100 - percent) / (100 + percent)``, a link means
   ``|x ^ y| <= t (|x| + |y|)``, while ``|x ^ c| > t (|x| + |c|)``; hence they share more than
   ``(1 - t) / 2`` of ``y``'s differences, and the more, the farther ``x`` is from the center.
   They are found by a join on differences, of which both show only those that a shared
   part of that size cannot avoid, and decided exactly.
5. Members of which none is linked to the center are joined on their rarest elements, of
   which linked sets must share one, if they are not in one component already.
6. Links are joined to components by alternating large-star and small-star.

So every pair that shares a bucket is decided or connected, and the pairs that are formed are
those with a center and those that share rare elements or rare differences.
With 64 bands of 8 rows, two sets of similarity 0.8 share no bucket with probability
(1 - 0.8^8)^64 = 8e-6, and a component needs only one path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataquarry.llm.common import literal_longs, remove, written

ROWS, BANDS = 8, 64
#: Minima that are kept for the signature check, one byte of each.
SIGNATURE = 256
SEED = 20_011
#: Standard deviations below the wanted similarity at which signatures still count as candidates.
SLACK = 6.0
#: Bits of the tables that tell a scan which rows may be needed.
TABLE_BITS = 23
WORD_CACHE = 500_000
MIXED = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # fixed values of a 64-bit mixer


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIXED[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIXED[1])
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, size: int, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; fewer words are one shingle, none no shingle.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` cuts at space and 9 to 13 only.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    run = min(size, len(words))
    x = np.full(len(words) - run + 1, np.uint64(run), np.uint64)
    for j in range(run):
        x = _mix(x + h[j : len(words) - run + 1 + j])
    return np.unique(x)


def universal(count: int = ROWS * BANDS) -> tuple[np.ndarray, np.ndarray]:
    """Fixed random coefficients of the hashes ``(a x + b) mod 2^32``, ``a`` odd."""
    draw = np.random.default_rng(SEED)
    return draw.integers(0, 2**31, count, np.uint32) * np.uint32(2) + np.uint32(1), draw.integers(0, 2**32, count, np.uint32)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 4096) -> np.ndarray:
    """The smallest value of every hash over the upper halves of the shingles."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), block):
        for i in range(0, len(a), 64):
            part = a[i : i + 64, None] * x[None, at : at + block]
            part += b[i : i + 64, None]
            np.minimum(best[i : i + 64], part.min(axis=1), out=best[i : i + 64])
    return best


def band_keys(best: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, of its number and its rows."""
    table = best.reshape(BANDS, ROWS).astype(np.uint64)
    keys = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for row in range(ROWS):
        keys = _mix(keys + table[:, row])
    return keys


def _lists(parts: list, kind: np.dtype) -> pa.ListArray:
    ends = np.cumsum([0, *(0 if p is None else len(p) for p in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, kind), *(p for p in parts if p is not None)])))


def _signer(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        a, b = universal()
        words = _WordHashes()
        for batch in batches:
            counts, keys, bands, signatures = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), size, words)
                best = minima(s, a, b) if len(s) else None
                counts.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(None if best is None else band_keys(best).view(np.int64))
                signatures.append(None if best is None else best[:SIGNATURE].astype(np.uint8).view(np.int8))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), _lists(bands, np.int64), _lists(signatures, np.int8)],
                ["id", "n", "set_key", "bands", "sig"],
            )

    return sign


def _setter(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        for batch in batches:
            found = [shingle_set(t.as_py(), size, words).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(found, np.int64)], ["id", "members"])

    return sets


def signatures(docs: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """``(id, n, set_key, bands, sig)`` per row: shingles, digest of the set, band keys, signature (empty without words)."""
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"))
    return rows.mapInArrow(_signer(size), "id bigint, n bigint, set_key binary, bands array<bigint>, sig array<tinyint>")


def among(values: DataFrame, of: Column) -> Column:
    """Whether a long may be among a table's values: a bit table of bounded size, before a join that decides."""
    name = values.columns[0]
    bits = min(TABLE_BITS, max(10, (8 * values.count()).bit_length()))
    place = lambda c: F.xxhash64(c).bitwiseAND((1 << bits) - 1)
    filled = dict(
        values.select(place(F.col(name)).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("at"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("p").bitwiseAND(63).cast("int"))).alias("v"))
        .collect()
    )
    table = literal_longs([filled.get(i, 0) for i in range(1 << (bits - 6))])
    word = F.get(table, F.shiftright(place(of), 6).cast("int"))
    return F.call_function("getbit", word, place(of).bitwiseAND(63).cast("int")) == 1


def likely(pairs: DataFrame, signed: DataFrame, level: float) -> DataFrame:
    """The pairs ``(a, b)`` whose signatures do not rule out a similarity of ``level``."""
    least = int(SIGNATURE * level - SLACK * (SIGNATURE * level * (1 - level)) ** 0.5)
    pairs = written(pairs, "minhash-pairs")
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "minhash-ids")
    near = signed.where(among(ids, F.col("id"))).select("id", "sig")
    side = lambda name: near.select(F.col("id").alias(name), F.col("sig").alias(f"sig_{name}"))
    equal = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda e: e))
    out = written(pairs.join(side("a"), "a").join(side("b"), "b").where(equal >= least).select("a", "b").distinct(), "minhash-likely")
    remove(ids)
    remove(pairs)
    return out


def with_sets(pairs: DataFrame, docs: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """The pairs ``(a, b)`` with their full sets; the texts of documents in pairs are read again.

    The set of ``b`` travels to ``a`` together with the pair.
    """
    own = F.col(key).cast("bigint")

    def side(name: str) -> DataFrame:
        ids = written(pairs.select(name).distinct(), "minhash-ids")
        chosen = docs.where(among(ids, own)).select(own.alias("id"), F.col(text).alias("t"))
        sets = chosen.mapInArrow(_setter(size), "id bigint, members array<bigint>")
        return sets.select(F.col("id").alias(name), F.col("members").alias(f"members_{name}"))

    return pairs.join(side("b"), "b").join(side("a"), "a")


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)``: the smallest id reachable over ``(a, b)``, by alternating large-star and small-star.

    A star step only needs the smallest neighbour of a node, so no neighbourhood is gathered.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars"
    )
    total = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint"))).first()
    while total[0]:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u > v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        step = written(small, "stars")
        after = step.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint"))).first()
        remove(now)
        now, done, total = step, after == total, after
        if done:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).distinct()


def buckets(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """``(bucket, c, b)``: buckets with several representatives ``b``, each with the bucket's center ``c``."""
    own = written(
        signed.join(classes, (signed.set_key == classes.set_key) & (signed.id == classes.rep)).select("rep", "bands"), "minhash-bands"
    )
    rows = own.select("rep", F.explode("bands").alias("bucket"))
    shared = written(
        rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("rep").alias("one"), F.max("rep").alias("two"))
        .where("one < two").select("bucket", "size"),
        "minhash-shared",
    )
    member = written(rows.where(among(shared, F.col("bucket"))).join(shared, "bucket").distinct(), "minhash-members")
    degree = member.groupBy("rep").agg(F.sum("size").alias("degree"))
    center = member.join(degree, "rep").groupBy("bucket").agg((-F.max(F.struct("degree", (-F.col("rep")).alias("r")))["r"]).alias("c"))
    out = written(member.join(center, "bucket").select("bucket", "c", F.col("rep").alias("b")), "minhash-buckets")
    for table in (own, shared, member):
        remove(table)
    return out


def _linked(common: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * common >= percent * (n_a + n_b - common)


def links(signed: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int, key: str, text: str) -> DataFrame:
    """Pairs ``(a, b)`` of linked representatives that connect all linked representatives."""
    member = buckets(signed, classes)
    level = percent / 100
    n_a, n_b = F.size("members_a"), F.size("members_b")
    common = F.size(F.array_intersect("members_a", "members_b"))
    # Differences from the center: added elements as they are, missing ones inverted.
    difference = F.concat(
        F.array_sort(F.array_except("members_b", "members_a")),
        F.transform(F.array_sort(F.array_except("members_a", "members_b")), lambda e: F.bitwise_not(e)),
    )
    stars = member.where("b <> c").select(F.col("c").alias("a"), "b").distinct()
    star = written(
        with_sets(likely(stars, signed, max(0.0, 2 * level - 1)), docs, size, key, text)
        .where(_linked(common, n_a, n_b, max(0, 2 * percent - 100)))
        .select("a", "b", n_a.alias("n_a"), n_b.alias("n"), _linked(common, n_a, n_b, percent).alias("linked"), difference.alias("difference")),
        "minhash-star",
    )
    first = star.where("linked").select("a", "b")

    # 4. One linked to the center, the other not, with common differences.  With ``over`` =
    # (100 + percent) |x ^ c| - (100 - percent) (|x| + |c|) > 0 a link needs at least over / 200 of them,
    # so ``x`` too need not show the last ones of the common order.  Counted from the first shared one,
    # both must have enough left.
    count = F.size("difference")
    over = (100 + percent) * count - (100 - percent) * (F.col("n") + F.col("n_a"))
    shown_y = F.slice("difference", 1, count - F.floor(count * percent / (100 + percent)).cast("int"))
    shown_x = F.slice("difference", 1, F.greatest(count - F.ceil(over / 200).cast("int") + 1, F.lit(0)))
    shown = lambda rows, name, part: rows.select(
        "a", F.col("b").alias(name), F.col("n").alias(f"n_{name}"), count.alias(f"size_{name}"), F.posexplode(part).alias(f"at_{name}", "e")
    )
    wanted = (100 + percent) * (F.col("size_x") + F.col("size_y")) - (100 - percent) * (F.col("n_x") + F.col("n_y"))
    rest_of_both = F.least(F.col("size_x") - F.col("at_x"), F.col("size_y") - F.col("at_y"))
    meet = (
        shown(star.where("not linked"), "x", shown_x).join(shown(star.where("linked"), "y", shown_y), ["a", "e"])
        .where(2 * (100 + percent) * rest_of_both >= wanted).select("a", "x", "y").distinct()
    )
    apart = F.size("difference_x") + F.size("difference_y") - 2 * F.size(F.array_intersect("difference_x", "difference_y"))
    side = lambda name: star.select(
        "a", F.col("b").alias(name), F.col("n").alias(f"n_{name}"), F.col("difference").alias(f"difference_{name}")
    )
    second = written(
        meet.join(side("x"), ["a", "x"]).join(side("y"), ["a", "y"])
        .where((100 + percent) * apart <= (100 - percent) * (F.col("n_x") + F.col("n_y"))).select(F.col("x").alias("a"), F.col("y").alias("b")),
        "minhash-second",
    )

    # 5. Neither linked to the center.  Two linked sets share an element among the first ones of both, in
    # any order of elements; the rarest come first, so few meet there.
    rest = member.where("b <> c").join(first.select(F.col("a").alias("c"), "b"), ["c", "b"], "left_anti").select("bucket", "b")
    several = rest.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").select("bucket")
    rest = written(rest.join(several, "bucket").select("b").distinct(), "minhash-rest")
    joined = written(components(first.union(second)), "minhash-joined")
    pairs = rare_pairs(rest, joined, docs, size, percent, key, text)
    close = likely(pairs, signed, level)
    third = written(with_sets(close, docs, size, key, text).where(_linked(common, n_a, n_b, percent)).select("a", "b"), "minhash-third")
    for table in (member, rest, joined, close):
        remove(table)
    return first.union(second).union(third)


def rare_pairs(ids: DataFrame, joined: DataFrame, docs: DataFrame, size: int, percent: int, key: str, text: str) -> DataFrame:
    """Pairs ``(a, b)`` of the documents ``ids`` that may be linked and are in different components of ``joined``.

    With n elements, those behind the first ``n - ceil(percent n / 100) + 1`` are too few to link a
    document, so linked ones share one of these, in the order of how many documents have an
    element.  At the shared element both must have enough left.  A set without partners in
    its rare elements makes no pair, however many documents share its common ones.
    """
    own = F.col(key).cast("bigint")
    chosen = docs.where(among(ids, own)).select(own.alias("b"), F.col(text).alias("t")).join(ids, "b", "left_semi")
    sets = written(
        chosen.select(F.col("b").alias("id"), "t").mapInArrow(_setter(size), "id bigint, members array<bigint>").dropDuplicates(["id"]), "minhash-sets"
    )
    elements = sets.select("id", F.size("members").alias("n"), F.explode("members").alias("e"))
    counted = elements.groupBy("e").agg(F.count("*").alias("f")).where("f > 1")
    ordered = elements.join(counted, "e").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("found"))
    # Elements of no other document come before all others.
    alone = F.col("n") - F.size("found")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    shown = (
        ordered.select("id", "n", alone.alias("alone"), F.posexplode(F.slice("found", 1, F.greatest(prefix - alone, F.lit(0)))).alias("i", "x"))
        .select("id", "n", F.col("x.e").alias("e"), (F.col("n") - F.col("alone") - F.col("i")).alias("left"))
        .join(joined, "id", "left").select("id", "n", "e", "left", F.coalesce("component", "id").alias("component"))
    )
    shown = written(shown, "minhash-rare")
    x, y = shown.alias("x"), shown.alias("y")
    enough = (100 + percent) * F.least("x.left", "y.left") >= percent * (F.col("x.n") + F.col("y.n"))
    met = x.join(y, (F.col("x.e") == F.col("y.e")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & enough)
    pairs = written(met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "minhash-rare-pairs")
    remove(sets)
    remove(shown)
    return pairs


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, n_shingles, component_id, kept)`` per row; ``kept`` marks the row whose key names its group.

    Documents with ``100 * intersection >= percent * union`` of their shingle sets are linked;
    a component's id is its smallest key.  Rows without words are linked with nothing.
    Rows that share a key count as one document and get the same component; a null key
    never represents a group, and a row with one is kept only if no document with a key
    has the same set.
    """
    signed = written(signatures(docs, shingle, key, text), "minhash-signatures")
    classes = written(
        signed.where("n > 0 and id is not null").groupBy("set_key").agg(F.min("id").alias("rep")), "minhash-classes"
    )
    final = components(links(signed, classes, docs, shingle, percent, key, text))
    labelled = classes.join(final.withColumnRenamed("id", "rep"), "rep", "left").select(
        "set_key", F.coalesce("component", "rep").alias("_component")
    )
    rows = signed.select("id", "n", F.when(F.col("n") > 0, F.col("set_key")).alias("set_key"))
    return rows.join(labelled, "set_key", "left").select(
        F.col("id").cast(docs.schema[key].dataType).alias(key), F.col("n").alias("n_shingles"),
        F.coalesce("_component", "id").alias("component_id"),
        F.col("id").eqNullSafe(F.coalesce("_component", "id")).alias("kept"),
    )

"""Fingerprints, sharding and decontamination against plain Python."""

import hashlib
import random
import re
import zlib

import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataquarry.llm import decontaminate, queries, sharding, simhash

MASK = (1 << 64) - 1


def spark_hash(*values):
    seed = 42
    for v in values:
        data = v.to_bytes(4, "little", signed=True) if isinstance(v, int) else v.encode()
        seed = xx_int(v, seed) if isinstance(v, int) else xxhash.xxh64_intdigest(data, seed=seed)
    return seed


def xx_int(value, seed):
    """XXH64 of a 4-byte integer."""
    return xxhash.xxh64_intdigest(value.to_bytes(4, "little", signed=True), seed=seed)


def fingerprint(text):
    words = ["^", *re.findall(r"[^\W_]+", (text or "").lower()), "$"]
    votes = [0] * 128
    for a, b in zip(words, words[1:]):
        one, two, weight = spark_hash(a, b), spark_hash(b, a, 1), min(16, len(a) + len(b))
        for i in range(64):
            votes[i] += weight if one >> i & 1 else -weight
            votes[64 + i] += weight if two >> i & 1 else -weight
    return sum(1 << i for i in range(64) if votes[i] > 0), sum(1 << i for i in range(64) if votes[64 + i] > 0)


def expected_fingerprints(rows):
    order = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -(2**63)))
    out = {}
    for i, (key, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        part = len(text) // 3
        edited = text[: len(text) - part] + following[:part]
        prints = [fingerprint(x) for x in (text, edited, following)]
        like = lambda p, q: 1 - ((p[0] ^ q[0]).bit_count() + (p[1] ^ q[1]).bit_count()) / 128
        out[key] = (
            len(text), hashlib.sha256(edited.encode()).hexdigest(), "%016x%016x" % prints[0], "%016x%016x" % prints[1],
            like(prints[0], prints[1]), like(prints[0], prints[2]),
        )
    return out


def test_fingerprints_of_documents(small_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    found = {r.doc_id: tuple(r)[1:] for r in simhash.edited_fingerprints(small_docs).collect()}
    assert found == expected_fingerprints(rows)


def test_fingerprints_of_odd_rows(spark, make_docs):
    long = " ".join(random.Random(1).choice(["alpha", "beta", "gamma", "delta"]) + str(i % 97) for i in range(9000))
    rows = [(7, None), (5, ""), (4, "one"), (3, "Ünï cödé 漢字 text"), (2, long), (1, "x" * 5000), (None, "no id")]
    df = make_docs(rows).withColumn("_text", F.lit("clash")).withColumn("next", F.lit(1))
    assert {r.doc_id: tuple(r)[1:] for r in simhash.edited_fingerprints(df).collect()} == expected_fingerprints(rows)
    assert simhash.edited_fingerprints(make_docs([])).count() == 0
    alone = simhash.edited_fingerprints(make_docs([(1, "only one here")])).first()
    assert alone.near_next == 1.0
    twice = simhash.edited_fingerprints(make_docs([(1, "the same"), (1, "the same"), (0, "another")])).collect()
    assert len(twice) == 3 and len({r.fingerprint for r in twice if r.doc_id == 1}) == 1


def test_block_tables_find_every_near_pair(spark):
    draw = random.Random(2)
    base = [draw.getrandbits(128) for _ in range(30)]
    prints = set(base)
    for b in base:
        for flips in range(1, 8):
            p = b
            for bit in draw.sample(range(128), flips):
                p ^= 1 << bit
            prints.add(p)
    df = spark.createDataFrame([("%032x" % p,) for p in prints] * 2 + [(None,)], "fingerprint string")
    for radius, blocks in ((3, 4), (3, 6), (5, 8)):
        expected = {("%032x" % p, "%032x" % q, (p ^ q).bit_count()) for p in prints for q in prints if p != q and (p ^ q).bit_count() <= radius}
        found = simhash.near(df, df, radius=radius, blocks=blocks).collect()
        assert len(found) == len(expected) and {tuple(r) for r in found} == expected


def test_values_within_allowances_find_every_near_pair(spark):
    draw = random.Random(21)
    base = [draw.getrandbits(128) for _ in range(12)]
    prints = set(base)
    for b in base:
        for flips in range(1, 32):
            prints.add(b ^ sum(1 << bit for bit in draw.sample(range(128), flips)))
            start = draw.randrange(128 - flips)
            prints.add(b ^ ((1 << flips) - 1) << start)
    df = spark.createDataFrame([("%032x" % p,) for p in prints] * 2 + [(None,)], "fingerprint string")
    for radius, blocks in ((simhash.NEAR, simhash.NEAR_BLOCKS), (18, 7), (13, 5), (4, 3)):
        assert sum(n + 1 for n in simhash.allowances(radius, blocks)) == radius + 1
        expected = {("%032x" % p, "%032x" % q, (p ^ q).bit_count()) for p in prints for q in prints if p != q and (p ^ q).bit_count() <= radius}
        found = simhash.near(df, df, radius=radius, blocks=blocks).collect()
        assert len(found) == len(expected) and {tuple(r) for r in found} == expected


def test_values_of_queries_are_not_broadcast(spark):
    """A query row becomes over a thousand, which Spark's estimate leaves out."""
    df = spark.createDataFrame([(f"{i:032x}",) for i in range(50)], "fingerprint string")
    found = simhash.near(df, df, radius=simhash.NEAR, blocks=simhash.NEAR_BLOCKS)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert found.count() == sum(a != b and (a ^ b).bit_count() <= simhash.NEAR for a in range(50) for b in range(50))


def test_query_finds_near_copies_of_documents(spark, make_docs, tmp_path):
    """Real documents with scattered words replaced, and with a run of words replaced, down to similarity 0.8."""
    draw = random.Random(22)
    shingles = lambda words: {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    long = [w for r in real if len(w := re.findall(r"[^\W_]+", (r.text or "").lower())) >= 60 and len(shingles(w)) > 0.9 * len(w)][:300]
    other_words = [w for words in long for w in words]
    rows, kinds = [], {}
    for n, words in enumerate(long):
        copy, best, own = list(words), None, shingles(words)
        at = draw.randrange(len(words) // 2)
        while True:
            copy[at if n % 2 else draw.randrange(len(words))] = draw.choice(other_words)
            at += 1
            other = shingles(copy)
            if len(own & other) < 0.8 * len(own | other):
                break
            best = list(copy)
        if best:
            kinds[20 * n] = n % 2
            rows += [(20 * n, " ".join(words)), (20 * n + 1, " ".join(best))]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in queries.op1(spark, str(tmp_path)).collect()}
    apart = {k: (int(found[k].fingerprint, 16) ^ int(found[k + 1].fingerprint, 16)).bit_count() for k in kinds}
    held = [k for k in kinds if found[k].n_near and apart[k] <= simhash.NEAR]
    recall = [sum(kinds[k] == kind for k in held) / sum(v == kind for v in kinds.values()) for kind in (0, 1)]
    print("recall of near copies: scattered, run", recall, len(kinds))
    assert len(kinds) > 200 and recall[0] >= 0.95 and recall[1] >= 0.85


def test_near_rows_are_counted(spark):
    draw = random.Random(16)
    base = draw.getrandbits(128)
    rows = [(i, "%032x" % (base ^ (1 << draw.randrange(128) if i % 3 else 0) ^ (draw.getrandbits(128) if i % 7 == 0 else 0))) for i in range(60)]
    found = simhash.count_near(spark.createDataFrame(rows, "doc_id bigint, fingerprint string"), F.col("doc_id") % 20 == 0).collect()
    apart = lambda p, q: (int(p, 16) ^ int(q, 16)).bit_count()
    assert {r.doc_id: r.n_near for r in found} == {
        i: sum(apart(p, q) <= 3 for j, q in rows if j != i) if i % 20 == 0 else None for i, p in rows
    }


def test_shards(spark, make_docs):
    df = make_docs([(i, "x" * (i % 7)) for i in range(3000)]).withColumn("shard", F.lit("clash")).withColumn("slot", F.lit(0))
    rows = sharding.shard_documents(df, rows_per_group=20).collect()
    assert len(rows) == 3000
    for shard in range(24):
        own = [r for r in rows if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own))) and 80 < len(own) < 175
    assert {r.grown_shard for r in rows if r.grown_shard != r.shard} == {24}
    moved = sum(r.grown_shard != r.shard for r in rows)
    assert 80 < moved < 170
    for r in rows[:50]:
        text = "x" * (r.doc_id % 7)
        assert (r["size"], r.text_crc32) == (len(text) + 8, zlib.crc32(text.encode()))


def test_weights_confine_movement(spark):
    before = sharding.tree(24, racks=2, per_rack=4)
    after = sharding.tree(24, racks=2, per_rack=4, weights={5: 3.0})
    rows = spark.range(4000).select(
        sharding.shard_of(F.col("id"), before).alias("a"), sharding.shard_of(F.col("id"), after).alias("b")
    ).collect()
    moved = [(r.a, r.b) for r in rows if r.a != r.b]
    # Shard 5 lies in rack 1 of region 0: rows enter that region, rack or shard, and nothing else moves.
    assert moved and all(b // 8 == 0 for _, b in moved)
    assert all(b // 4 == 1 for a, b in moved if a // 8 == 0) and all(b == 5 for a, b in moved if a // 4 == 1)
    share = sum(r.b == 5 for r in rows) / 4000
    assert abs(share - 3 / 26) < 0.03


def test_shards_of_odd_rows(make_docs):
    rows = sharding.shard_documents(make_docs([(None, None), (1, None), (1, None), (2, ""), (3, "é" * 40000)])).collect()
    assert len(rows) == 5 and {r["size"] for r in rows if r.doc_id in (None, 1, 2)} == {8}
    assert next(r["size"] for r in rows if r.doc_id == 3) == 80008
    pair = [r for r in rows if r.doc_id == 1]
    assert pair[0].shard == pair[1].shard and pair[0].slot != pair[1].slot
    assert sharding.shard_documents(make_docs([])).count() == 0


def expected_hits(docs, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, text in items:
        w = cut(text)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[s : s + window]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for key, text in docs:
        w, hit, found = cut(text), set(), set()
        for m in sizes:
            for s in range(len(w) - m + 1):
                names = windows.get(tuple(w[s : s + m]))
                if names:
                    hit.update(range(s, s + m))
                    found |= names
        out.append((key, len(w), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=str)


def test_windows_of_benchmark(spark, make_docs):
    draw = random.Random(3)
    vocab = ["the", "of", "a", "b1", "c", "ünd", "ça", "zz"]
    words = lambda n: [draw.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(words(n))) for i, n in enumerate([1, 2, 5, 9, 10, 11, 14, 30, 60])]
    items += [(20, "the " * 40), (21, None), (22, "!?"), (23, items[7][1].upper()), (24, items[7][1]), (24, items[8][1])]
    docs = [(i, " ".join(words(draw.choice([0, 3, 9, 10, 25, 200])))) for i in range(40)]
    for i in range(40, 80):
        source = draw.choice([t for _, t in items if t]).split()
        begin = draw.randrange(len(source))
        docs.append((i, " ".join(words(20)) + ", " + "; ".join(source[begin : begin + draw.randrange(1, 30)]) + ". " + " ".join(words(20))))
    docs += [(90, None), (91, ""), (92, "the " * 3000), (93, docs[50][1]), (93, docs[50][1]), (93, docs[51][1]), (None, docs[52][1])]
    bench = spark.createDataFrame(items, T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())]))
    df = make_docs(docs).withColumn("h", F.lit(1)).withColumn("window", F.lit("clash")).withColumn("item_id", F.lit(5))
    found = sorted((tuple(r) for r in decontaminate.decontaminate(df, bench).collect()), key=str)
    assert found == expected_hits(docs, items)
    clean = decontaminate.without_hits(df, bench)
    assert clean.columns == df.columns
    kept = [(d, t) for d, t in docs if not expected_hits([(d, t)], items)[0][-1]]
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted(kept, key=str)


def test_empty_benchmark_and_documents(spark, make_docs):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert [tuple(r) for r in decontaminate.decontaminate(make_docs([(1, "a b c")]), bench).collect()] == [(1, 3, 0, 0, [], False)]
    full = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert decontaminate.decontaminate(make_docs([]), full).count() == 0
    assert decontaminate.without_hits(make_docs([(1, "x"), (2, "A, b c!")]), full).collect()[0].doc_id == 1


def test_winnowing_keeps_an_anchor_in_every_window(spark):
    draw = random.Random(4)
    hashes = [draw.randrange(6) for _ in range(300)]
    df = spark.createDataFrame([(hashes,)], "h array<bigint>")
    found = df.select(decontaminate.anchors(F.col("h"), 6)).first()[0]
    expected = {max(i for i in range(s, s + 6) if hashes[i] == min(hashes[s : s + 6])) for s in range(295)}
    assert set(found) == expected

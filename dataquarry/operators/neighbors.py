"""Nearest neighbours and all-pairs summaries without all-pairs output.

``knn``         exact k nearest neighbours (cosine or Euclidean) by pivot cells.
``tile_pairs``  run a function on every pair of row blocks; what leaves a tile is
                a summary per row, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dataquarry.functions.vectors import as_array, l2_normalize
from dataquarry.runtime import ROWS_A_TASK, balance, materialise

NEIGHBORS = 15
# Rows per block: two blocks and their distance matrix fit easily in a task.
BLOCK_ROWS = 2048
# A side of a tile search is cut into at most so many blocks, so a row is copied no more often however
# large the table is, until a block would hold more numbers than this (64 MB).
MOST_BLOCKS = 16
BLOCK_VALUES = 1 << 23
# Distances, and candidates of a block, that are held at a time.
HELD = 1 << 20
# Pivots are broadcast and their statistics collected: at most this many.
MAX_PIVOTS = 2048


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.empty((0, 0))


def blocks_for(n: int, block_rows: int = BLOCK_ROWS) -> int:
    return max(1, math.ceil(n / block_rows))


def tiles_for(n: int, width: int, block_rows: int = BLOCK_ROWS) -> int:
    """Blocks of a side: of ``block_rows`` rows on small tables, a bounded number on large ones."""
    most = max(block_rows, BLOCK_VALUES // max(width, 1))
    return min(blocks_for(n, block_rows), max(MOST_BLOCKS, blocks_for(n, most)))


def _shape(rows: DataFrame) -> tuple[int, int]:
    """Rows, and the width of their vectors."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    return found["n"], found["width"] or 1


def tile_pairs(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, blocks: tuple[int, int],
    fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
) -> DataFrame:
    """Apply ``fn`` to every (left block, right block) pair, one bounded group each.

    Rows are spread over blocks by the hash of their key, so no key or cluster can
    make a block large.
    """
    nl, nr = blocks
    hashed = lambda key, n: F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.withColumn("_bl", hashed(left_key, nl)).withColumn("_br", every(nr))
    # Fresh column identities: both sides may be the same table.
    b = right.select(*[F.col(c).alias(c) for c in right.columns])
    b = b.withColumn("_br", hashed(right_key, nr)).withColumn("_bl", every(nl))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return fn(x, y)

    return a.groupBy("_bl", "_br").cogroup(b.groupBy("_bl", "_br")).applyInPandas(run, schema)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def distances_to_labels(df: DataFrame, key: str, vec: str, labels: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(key, which, own, label, n, total)``: summed Euclidean distances from every row to every label's rows.

    ``labels`` is an array column holding one label per labelling; ``which`` numbers
    the labellings.  The distances of a tile are computed once for all of them.
    Quadratic work, linear output: one number per row, labelling and label.
    """
    rows = materialise(
        df.select(F.col(key).alias("key"), F.col(labels).cast("array<int>").alias("labels"), as_array(df, vec).alias("v")), "pairs"
    )
    n = tiles_for(*_shape(rows), block_rows)

    def sums(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        names = ("key", "which", "own", "label", "n", "total")
        if x.empty or y.empty:
            return pd.DataFrame({c: [] for c in names})
        a, b = _stack(x["v"]), _stack(y["v"])
        centre = b.mean(axis=0)  # smaller norms keep more digits of near distances
        a, b = a - centre, b - centre
        mine, theirs = np.stack(x["labels"].to_numpy()), np.stack(y["labels"].to_numpy())
        heads, members = [], []
        for which in range(theirs.shape[1]):
            found, code = np.unique(theirs[:, which], return_inverse=True)
            heads += [(which, label, int(n)) for label, n in zip(found, np.bincount(code))]
            members.append(np.eye(len(found))[code])
        member = np.hstack(members)
        total = np.empty((len(a), len(heads)))
        step = max(1, HELD // len(b))
        for start in range(0, len(a), step):
            total[start:start + step] = np.sqrt(squared_distances(a[start:start + step], b)) @ member
        which, label, count = (np.array(h) for h in zip(*heads))
        k = len(heads)
        return pd.DataFrame({
            "key": np.repeat(x["key"].to_numpy(), k), "which": np.tile(which, len(a)), "own": mine[:, which].ravel(),
            "label": np.tile(label, len(a)), "n": np.tile(count, len(a)), "total": total.ravel(),
        })

    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, which int, own int, label int, n bigint, total double"
    parts = tile_pairs(rows, rows, "key", "key", (n, n), sums, schema)
    return parts.groupBy("key", "which", "own", "label").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _pivots(points: DataFrame, n: int, wanted: int) -> np.ndarray:
    """``wanted`` rows in hash order; a threshold keeps the sort small on large tables."""
    h = F.pmod(F.xxhash64("rep", F.lit("pivot")), F.lit(1 << 30))
    keep = points.withColumn("_h", h)
    if n > 8 * wanted:
        keep = keep.filter(F.col("_h") < int((1 << 30) * 4 * wanted / n))
    return np.stack([np.asarray(r["v"], dtype=float) for r in keep.orderBy("_h", "rep").limit(wanted).select("v").collect()])


def _top_in_block(k: int):
    """Per query the ``k`` nearest points of a block, ties included; identical rows are one point."""

    def run(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"rep": [], "nbr": [], "d2": []}
        if not q.empty and not p.empty:
            a, b = _stack(q["v"]), _stack(p["v"])
            reps, names = q["rep"].to_numpy(), p["rep"].to_numpy()
            step = max(1, HELD // len(b))
            for start in range(0, len(a), step):
                part, ids = a[start:start + step], reps[start:start + step]
                d = squared_distances(part, b)
                d[ids[:, None] == names[None, :]] = np.inf
                take = min(k, d.shape[1]) - 1
                limit = np.partition(d, take, axis=1)[:, take]
                limit = np.where(np.isinf(limit), np.finfo(float).max, limit * (1 + 1e-9) + 1e-9)
                i, j = np.nonzero(d <= limit[:, None])
                exact = ((part[i] - b[j]) ** 2).sum(axis=1)
                out["rep"].append(ids[i])
                out["nbr"].append(names[j])
                out["d2"].append(exact)
        empty = not out["rep"]
        return pd.DataFrame({c: ([] if empty else np.concatenate(v)) for c, v in out.items()})

    return run


def _nearest(row: np.ndarray, code: np.ndarray, d2: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` nearest candidates of every row, ties by code."""
    order = np.lexsort((code, d2, row))
    ranked = row[order]
    return order[np.arange(len(order)) - np.searchsorted(ranked, ranked) < k]


def _top_in_cells(k: int):
    """Per query the ``k`` nearest points of a block's open cells, none farther than its limit."""

    def run(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if q.empty or p.empty:
            return pd.DataFrame({"rep": [], "nbr": [], "d2": []})
        p = p.sort_values("cell", kind="stable")
        a, b = _stack(q["v"]), _stack(p["v"])
        reps, names, cell = q["rep"].to_numpy(), p["rep"].to_numpy(), p["cell"].to_numpy()
        code = pd.factorize(names, sort=True)[0]
        limit = q["limit"].to_numpy(dtype=float) ** 2
        lists = q["cells"].to_numpy()
        who = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        opened = np.concatenate(lists)
        by_cell = np.argsort(opened, kind="stable")
        who, opened = who[by_cell], opened[by_cell]
        kept = [np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)]
        fresh: list[tuple] = []

        def cut() -> None:
            nonlocal kept
            found = [np.concatenate(x) for x in zip(kept, *fresh)]
            at = _nearest(found[0], code[found[1]], found[2], k)
            kept = [x[at] for x in found]
            fresh.clear()
            # A row with k candidates needs nothing beyond the farthest of them.
            full = np.bincount(kept[0], minlength=len(a)) >= k
            far = np.zeros(len(a))
            np.maximum.at(far, kept[0], kept[2])
            limit[full] = np.minimum(limit[full], far[full])

        held = 0
        for c in np.unique(opened):
            lo, hi = np.searchsorted(cell, [c, c + 1])
            if lo == hi:
                continue
            asking = who[np.searchsorted(opened, c):np.searchsorted(opened, c + 1)]
            step = max(1, HELD // (hi - lo))
            for start in range(0, len(asking), step):
                i = asking[start:start + step]
                d = squared_distances(a[i], b[lo:hi])
                top = limit[i]
                free = np.isinf(top)
                if free.any() and hi - lo > k:
                    top[free] = np.partition(d[free], k - 1, axis=1)[:, k - 1]
                x, y = np.nonzero(d <= np.where(np.isinf(top), np.finfo(float).max, top * (1 + 1e-9) + 1e-9)[:, None])
                x, y = i[x], lo + y
                for begin in range(0, len(x), HELD):
                    u, w = x[begin:begin + HELD], y[begin:begin + HELD]
                    fresh.append((u, w, ((a[u] - b[w]) ** 2).sum(axis=1)))
                held += len(x)
                if held > HELD:
                    cut()
                    held = 0
        cut()
        return pd.DataFrame({"rep": reps[kept[0]], "nbr": names[kept[1]], "d2": kept[2]})

    return run


def _best(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("rep").orderBy("d2", "nbr")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _cell_search(queries: DataFrame, points: DataFrame, splits: DataFrame, k: int, key_type: str, name: str) -> DataFrame:
    """Search each ``(rep, v, cell)`` query in its cell; big cells are cut on both sides.

    A group is one part of a cell's points and one part of its queries, so neither
    a dense cell nor a popular one makes a large task.
    """
    q = (
        queries.join(F.broadcast(splits), "cell")
        .withColumn("qpart", F.pmod(F.xxhash64("rep", F.lit("q")), F.col("qparts")).cast("int"))
        .withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
        .select("rep", "v", "cell", "part", "qpart")
    )
    p = (
        points.select(*[F.col(c).alias(c) for c in ("rep", "v", "cell")])  # fresh identities
        .join(F.broadcast(splits), "cell")
        .withColumn("part", F.pmod(F.xxhash64("rep", F.lit("p")), F.col("parts")).cast("int"))
        .withColumn("qpart", F.explode(F.expr("sequence(0, qparts - 1)")))
        .select("rep", "v", F.col("cell").alias("cell"), F.col("part").alias("part"), "qpart")
    )
    found = (
        q.groupBy("cell", "part", "qpart")
        .cogroup(p.groupBy("cell", "part", "qpart"))
        .applyInPandas(_top_in_block(k), f"rep {key_type}, nbr {key_type}, d2 double")
    )
    return materialise(_best(found, k).select("rep", "nbr", "d2"), name)


def _splits(points: DataFrame, queries: DataFrame | None, block_rows: int) -> DataFrame:
    """``(cell, parts, qparts)``; one row per cell, at most MAX_PIVOTS rows."""
    n = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    m = n.withColumnRenamed("n", "m") if queries is None else queries.groupBy("cell").agg(F.count(F.lit(1)).alias("m"))
    return n.join(m, "cell").select(
        "cell",
        F.ceil(F.col("n") / block_rows).cast("int").alias("parts"),
        F.ceil(F.col("m") / block_rows).cast("int").alias("qparts"),
    )


def knn(
    df: DataFrame,
    key: str,
    vec: str,
    k: int = NEIGHBORS,
    metric: str = "cosine",
    block_rows: int = BLOCK_ROWS,
    probes: int | None = None,
) -> DataFrame:
    """``(src, dst, rank, dist)``: the ``k`` nearest other rows, ties by key.

    Identical vectors are searched once.  The distinct ones are assigned to the
    nearest of about ``n / block_rows`` pivots; a query searches its own cell
    first, then only the cells that can, by the triangle inequality, hold
    something closer.  ``probes`` bounds the search to that many nearest cells,
    which makes the result approximate; by default it is exact.
    """
    if metric not in {"cosine", "euclidean"}:
        raise ValueError("metric must be 'cosine' or 'euclidean'")
    raw = df.select(F.col(key).alias("key"), as_array(df, vec).alias("v"))
    if metric == "cosine":
        # One more coordinate tells the zero vector apart: it is at distance 1 from all others.
        zero = F.when(F.forall("v", lambda x: x == 0), 1.0).otherwise(0.0)
        raw = raw.select("key", F.concat(l2_normalize(F.col("v")), F.array(zero)).alias("v"))
    rows = materialise(raw, "knn-rows")
    key_type = rows.schema["key"].dataType.simpleString()
    points = materialise(rows.groupBy("v").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies")), "knn-points")
    n, width = _shape(points)
    copies = (points.agg(F.max("copies")).first()[0] or 0) > 1
    wanted = min(blocks_for(n, block_rows), MAX_PIVOTS)

    if wanted == 1:
        cells = points.select("rep", "v", F.lit(0).alias("cell"))
        near = _cell_search(cells, cells, _splits(cells, None, block_rows), k, key_type, "knn-best")
    else:
        near = _pivot_search(points, n, wanted, k, key_type, tiles_for(n, width, block_rows), probes)

    scale = (lambda d2: d2 / 2.0) if metric == "cosine" else F.sqrt
    if not copies:
        order = Window.partitionBy("rep").orderBy("d2", "nbr")
        return near.select(
            F.col("rep").alias("src"), F.col("nbr").alias("dst"),
            F.row_number().over(order).alias("rank"), scale(F.col("d2")).alias("dist"),
        )
    return _expand_copies(rows, points, near, k, scale)


def _cell_blocks(pivots: np.ndarray, sizes: np.ndarray, blocks: int) -> np.ndarray:
    """The block of every cell: neighbours along the widest direction, blocks near in size."""
    centred = pivots - pivots.mean(axis=0)
    order = np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")
    before = np.cumsum(sizes[order]) - sizes[order]
    out = np.empty(len(pivots), dtype=np.int32)
    out[order] = before * blocks // max(sizes.sum(), 1)
    return out


def _pivot_search(points, n, wanted, k, key_type, blocks, probes):
    """Own cells first, then the open ones.

    Cells are laid together in ``blocks`` blocks: a query goes once to a block that holds any of its
    open cells, a point once to each part of the queries, so both are copied ``blocks`` times at most.
    """
    spark = points.sparkSession
    # Every row is compared with all pivots, but the rows are few bytes that Spark puts into few parts.
    tasks = min(spark.sparkContext.defaultParallelism, math.ceil(n / ROWS_A_TASK))
    points = balance(points, "knn-points")
    pivots = _pivots(points, n, wanted)
    shared = spark.sparkContext.broadcast(pivots)

    @F.pandas_udf("cell int, r double")
    def assign(v: pd.Series) -> pd.DataFrame:
        d = np.sqrt(squared_distances(_stack(v), shared.value)) if len(v) else np.empty((0, 1))
        cell = d.argmin(axis=1) if len(v) else np.empty(0, dtype=int)
        return pd.DataFrame({"cell": cell, "r": d[np.arange(len(d)), cell]})

    cells = materialise(
        points.withColumn("_a", assign("v")).select("rep", "v", F.col("_a.cell").alias("cell"), F.col("_a.r").alias("r")),
        "knn-cells",
    )
    part_rows = math.ceil(n / blocks)
    own = _cell_search(cells, cells, _splits(cells, None, part_rows), k, key_type, "knn-own")
    reach = own.groupBy("rep").agg(F.count(F.lit(1)).alias("found"), F.max("d2").alias("d2"))
    limit = F.when(F.col("found") >= k, F.sqrt("d2")).otherwise(F.lit(float("inf")))
    open_queries = cells.join(reach, "rep", "left").select(
        "rep", "v", F.col("cell").alias("own_cell"), F.coalesce(limit, F.lit(float("inf"))).alias("limit")
    )
    radius, sizes = np.zeros(len(pivots)), np.zeros(len(pivots), dtype=np.int64)
    for r in cells.groupBy("cell").agg(F.max("r").alias("r"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["cell"]], sizes[r["cell"]] = r["r"], r["n"]
    block_of = _cell_blocks(pivots, sizes, blocks)
    gaps = np.sqrt(squared_distances(pivots, pivots))
    far = spark.sparkContext.broadcast((radius, gaps, block_of))

    def opened(x: pd.DataFrame) -> pd.DataFrame:
        radius, gaps, block_of = far.value
        d = np.sqrt(squared_distances(_stack(x["v"]), shared.value))
        at, block, cells = [], [], []
        for i, (row, c, reach) in enumerate(zip(d, x["own_cell"], x["limit"])):
            bound = row - radius
            with np.errstate(divide="ignore", invalid="ignore"):
                # Distance to the plane between the own and the other pivot.
                plane = (row**2 - row[c] ** 2) / (2.0 * gaps[c])
            bound = np.maximum(bound, np.where(np.isfinite(plane), plane, -np.inf))
            ok = bound <= reach * (1 + 1e-9) + 1e-9
            ok[c] = False
            pick = np.flatnonzero(ok)
            if probes is not None:
                pick = pick[np.argsort(row[pick], kind="stable")][: max(probes - 1, 0)]
            found = block_of[pick]
            for g in np.unique(found):
                at.append(i)
                block.append(g)
                cells.append(pick[found == g].astype(np.int32))
        parts = x[["rep", "v", "limit"]].iloc[at].reset_index(drop=True)
        return parts.assign(block=block, cells=cells)

    # Small batches: a query is repeated once a block.
    def more(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 1024):
                yield opened(batch.iloc[start:start + 1024])

    kind = f"rep {key_type}, v array<double>, limit double, block int, cells array<int>"
    of = lambda numbers, at: F.element_at(F.array(*[F.lit(int(x)) for x in numbers]), F.col(at) + 1)
    hashed = lambda salt, n: F.pmod(F.xxhash64("rep", F.lit(salt)), n).cast("int")
    # A cell may be larger than a block should be.
    parts = np.maximum(1, np.ceil(np.bincount(block_of, sizes, blocks) / part_rows))
    q = open_queries.repartition(tasks).mapInPandas(more, kind).withColumn("qpart", hashed("q", F.lit(blocks)))
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), of(parts, "block") - 1)))
    p = cells.select("rep", "v", "cell", of(block_of, "cell").alias("block"))
    p = p.withColumn("part", hashed("p", of(parts, "block")))
    p = p.withColumn("qpart", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rest = (
        q.groupBy("block", "part", "qpart").cogroup(p.groupBy("block", "part", "qpart"))
        .applyInPandas(_top_in_cells(k), f"rep {key_type}, nbr {key_type}, d2 double")
    )
    return materialise(_best(own.unionByName(rest), k).select("rep", "nbr", "d2"), "knn-best")


def _expand_copies(rows, points, near, k, scale):
    """Back from distinct vectors to rows: a vector stands for its smallest k + 1 keys.

    No row needs more than that of any copy group, so a group with a third of all
    rows contributes a short list; AQE splits the join of its rows with that list.
    """
    order = Window.partitionBy("v").orderBy("key")
    members = rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k + 1)
    members = members.join(points.select("v", "rep"), "v").select(F.col("rep").alias("nbr"), F.col("key").alias("dst"))
    own = points.select("rep", F.col("rep").alias("nbr"), F.lit(0.0).alias("d2"))
    cand = near.select("rep", "nbr", "d2").unionByName(own).join(members, "nbr")
    best = Window.partitionBy("rep").orderBy("d2", "dst")
    lists = (
        cand.withColumn("rn", F.row_number().over(best))
        .filter(F.col("rn") <= k + 1)
        .groupBy("rep")
        .agg(F.array_sort(F.collect_list(F.struct("d2", "dst"))).alias("near"))
    )
    mine = rows.join(points.select("v", "rep"), "v").select(F.col("key").alias("src"), "rep").join(lists, "rep")
    kept = F.slice(F.filter("near", lambda s: s["dst"] != F.col("src")), 1, k)
    return mine.select("src", F.posexplode(kept).alias("pos", "s")).select(
        "src", F.col("s.dst").alias("dst"), (F.col("pos") + 1).alias("rank"), scale(F.col("s.d2")).alias("dist")
    )

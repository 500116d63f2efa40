"""Topics: density clustering, merging of near topics, keywords and payloads."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataquarry.functions.vectors import as_array, l2_normalize
from dataquarry.operators.cluster import cluster_centroids, pca_reduce
from dataquarry.operators.graph import connected_components, follow_links
from dataquarry.operators.neighbors import _stack, blocks_for, knn, tile_pairs
from dataquarry.operators.ordered import quantiles_of, running_totals
from dataquarry.operators.sampling import sample_per_group
from dataquarry.operators.text import term_counts
from dataquarry.runtime import discard, distil, materialise

MIN_CLUSTER = 15
COMPONENTS = 5
MERGE_SIMILARITY = 0.85
KEYWORDS = 10
CONTEXTS = 3
# Density levels of the cluster hierarchy: quantiles of the edge lengths.
LEVELS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)


def topic_stats(df: DataFrame, topic: str) -> DataFrame:
    """``(n_topics, noise_pct, n_rows)``."""
    t = F.col(topic)
    return df.agg(
        F.count_distinct(F.when(t != -1, t)).alias("n_topics"),
        (F.avg((t == -1).cast("int")) * 100).alias("noise_pct"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def _cosines(x: pd.DataFrame, y: pd.DataFrame) -> np.ndarray:
    a, b = _stack(x["centroid"]), _stack(y["centroid"])
    size = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    return np.divide(a @ b.T, size, out=np.zeros_like(size), where=size > 0)


def _centroid_tiles(centroids: DataFrame, fn, schema: str) -> DataFrame:
    n = blocks_for(centroids.count())
    return tile_pairs(centroids, centroids, "label", "label", (n, n), fn, schema)


def centroid_similarity(df: DataFrame, vec: str, label: str) -> DataFrame:
    """``(i, j, sim)`` for every pair of labels i < j: cosine of their mean vectors."""
    centroids = materialise(cluster_centroids(df, vec, label), "centroids")

    def pairs(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"i": [], "j": [], "sim": []})
        a, b = x["label"].to_numpy(), y["label"].to_numpy()
        r, c = np.nonzero(a[:, None] < b[None, :])
        return pd.DataFrame({"i": a[r], "j": b[c], "sim": _cosines(x, y)[r, c]})

    return _centroid_tiles(centroids, pairs, "i int, j int, sim double")


def merge_map(df: DataFrame, vec: str, label: str, threshold: float = MERGE_SIMILARITY) -> DataFrame:
    """``(label, merged)``: each label moves to the next similar higher one, until there is none.

    Centroids stay fixed while labels move, so the moves form chains; only the first similar higher label leaves a tile.
    """
    centroids = materialise(cluster_centroids(df, vec, label), "centroids")

    def first_similar(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"node": [], "next": []})
        a, b = x["label"].to_numpy(), y["label"].to_numpy()
        near = (_cosines(x, y) > threshold) & (a[:, None] < b[None, :])
        target = np.where(near, b[None, :], np.iinfo(np.int32).max).min(axis=1)
        hit = near.any(axis=1)
        return pd.DataFrame({"node": a[hit], "next": target[hit]})

    links = _centroid_tiles(centroids, first_similar, "node int, next int").groupBy("node").agg(F.min("next").alias("next"))
    chains = centroids.select(F.col("label").alias("node")).join(links, "node", "left")
    return follow_links(chains).select(F.col("node").alias("label"), F.col("last").alias("merged"))


def merge_topics(df: DataFrame, vec: str, label: str, threshold: float = MERGE_SIMILARITY, merged: DataFrame | None = None) -> DataFrame:
    """Replace ``label`` by its merged label; noise stays -1.  ``merged`` hands over what ``merge_map`` has found already."""
    merged = merge_map(df, vec, label, threshold) if merged is None else merged
    kind = df.schema[label].dataType
    joined = df.join(merged.withColumnRenamed("label", "_label"), F.col(label) == F.col("_label"), "left")
    return joined.withColumn(label, F.coalesce("merged", label).cast(kind)).drop("_label", "merged")


def reduce_vectors(df: DataFrame, vec: str, components: int = COMPONENTS, out: str = "reduced") -> DataFrame:
    """Unit vectors projected on their first components; vectors under 10 dimensions pass unchanged.

    Cosine neighbours are Euclidean neighbours of unit vectors, so a linear
    projection keeps the neighbourhood structure as far as it is linear.
    """
    first = df.select(F.size(as_array(df, vec)).alias("d")).first()
    if first is None or first["d"] < 10:
        return df.withColumn(out, as_array(df, vec))
    unit = df.withColumn("_unit", l2_normalize(as_array(df, vec)))
    reduced, _, _ = pca_reduce(unit, "_unit", out="_r", k=min(components, first["d"]))
    return reduced.withColumn(out, as_array(reduced, "_r")).drop("_unit", "_r")


def _density_graph(df: DataFrame, key: str, vec: str, min_size: int, probes: int | None) -> tuple[DataFrame, DataFrame]:
    """Core distances ``(node, core)`` and mutual-reachability edges ``(src, dst, w)``."""
    graph = distil(df.sparkSession, lambda: knn(df, key, vec, k=min_size, metric="euclidean", probes=probes), "density-graph")
    # The distance to the last neighbour; rows with fewer neighbours have no core.
    core = materialise(
        graph.filter(F.col("rank") == min_size).select(F.col("src").alias("node"), F.col("dist").alias("core")), "cores"
    )
    edges = (
        graph.join(core.select(F.col("node").alias("src"), F.col("core").alias("cs")), "src")
        .join(core.select(F.col("node").alias("dst"), F.col("core").alias("cd")), "dst")
        .select("src", "dst", F.greatest("dist", "cs", "cd").alias("w"))
    )
    edges = materialise(edges, "density-edges")
    discard(graph)
    return core, edges


def relabel(members: DataFrame) -> DataFrame:
    """``(node, label)``: clusters numbered from 0 by size, largest first, then smallest member."""
    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.select("comp", (-F.col("size")).alias("order"), F.lit(1).alias("one"))
    numbered = running_totals(sizes, ["order", "comp"], {"label": "one"}, "cluster-order")
    numbered = materialise(numbered.select("comp", F.col("label").cast("int").alias("label")), "cluster-labels")
    return members.join(numbered, "comp").select("node", "label")


def density_cluster(
    df: DataFrame,
    key: str,
    vec: str,
    min_size: int = MIN_CLUSTER,
    epsilon: float | None = None,
    label: str = "label",
    probes: int | None = None,
) -> DataFrame:
    """``(key, label)``: dense groups of at least ``min_size`` rows, -1 for noise.

    With ``epsilon``: connected components of the mutual-reachability graph cut at
    that distance.  Without: the components at a grid of distances form a
    hierarchy, and the clusters with the greatest excess of mass are chosen from it.
    ``probes`` makes the neighbour search approximate (see ``knn``).
    """
    core, edges = _density_graph(df, key, vec, min_size, probes)
    if epsilon is not None:
        nodes = core.filter(F.col("core") <= epsilon).select("node")
        comps = connected_components(nodes, edges.filter(F.col("w") <= epsilon).select("src", "dst"))
        sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_size)
        chosen = comps.join(sizes.select("comp"), "comp", "left_semi")
    else:
        chosen = _excess_of_mass(core, edges, min_size)
    labels = relabel(chosen).withColumnRenamed("node", key)
    return df.select(key).join(labels, key, "left").select(key, F.coalesce("label", F.lit(-1)).alias(label))


def _excess_of_mass(core: DataFrame, edges: DataFrame, min_size: int) -> DataFrame:
    """``(node, comp)`` of the chosen clusters.

    Level 0 is the finest distance.  A cluster's mass is how long, in 1/distance,
    its rows stay dense; it is kept when its mass is at least that of the clusters
    it later splits into.  All levels are labelled in one propagation.
    """
    cuts = quantiles_of(edges, ["w"], list(LEVELS))["w"]
    cuts = sorted({float(c) for c in cuts if c is not None and c > 0})
    if not cuts:
        # All rows coincide with their neighbours: one level at distance 0.
        nodes = core.select("node")
        return connected_components(nodes, edges.select("src", "dst"))
    grid = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(c).alias("eps")) for i, c in enumerate(cuts)])
    at = lambda value: F.inline(F.filter(grid, lambda g: g["eps"] >= F.col(value)))
    nodes = core.select("node", "core", at("core"))
    # Both directions of an edge meet before the levels multiply it, so only the graph itself is shuffled.
    larger, smaller = F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")
    pairs = edges.filter("src <> dst").groupBy(larger, smaller).agg(F.min("w").alias("w"))
    levels = pairs.select("src", "dst", at("w")).select("level", "src", "dst")
    comps = distil(
        core.sparkSession, lambda: connected_components(nodes.select("level", "node"), levels, ["level"], ordered=True), "components"
    )
    lambdas = [1.0 / c for c in cuts]
    finest = 2.0 * lambdas[0]
    ceiling = F.array(*[F.lit(x) for x in [finest, *lambdas[:-1]]])
    floor = F.array(*[F.lit(x) for x in lambdas])
    dense = F.when(F.col("core") > 0, 1.0 / F.col("core")).otherwise(F.lit(finest))
    mass = F.greatest(F.least(dense, ceiling[F.col("level")]) - floor[F.col("level")], F.lit(0.0))
    members = materialise(
        comps.join(core, "node").select("level", "comp", "node", mass.alias("m")), "density-members"
    )
    clusters = members.groupBy("level", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("m"), F.min("node").alias("probe"))
    clusters = clusters.filter(F.col("n") >= min_size)
    up = members.select((F.col("level") - 1).alias("level"), F.col("comp").alias("parent"), F.col("node").alias("probe"))
    tree = materialise(clusters.join(up, ["level", "probe"], "left").select("level", "comp", "m", "parent"), "density-tree")

    # Upwards: own = mass while it is one cluster, best = what its subtree can give.
    # Each level is written, so no plan repeats the levels below it.
    best: list[DataFrame] = []
    for level in range(len(cuts)):
        here = tree.filter(F.col("level") == level)
        if level == 0:
            now = here.select("comp", "parent", F.col("m").alias("own"), F.col("m").alias("best"), F.lit(True).alias("keep"))
        else:
            kids = best[-1].groupBy(F.col("parent").alias("comp")).agg(
                F.count(F.lit(1)).alias("k"), F.sum("best").alias("kids"), F.max("own").alias("only")
            )
            own = F.col("m") + F.when(F.col("k") == 1, F.col("only")).otherwise(0.0)
            below = F.coalesce("kids", F.lit(0.0))
            now = here.join(kids, "comp", "left").select(
                "comp", "parent", own.alias("own"), F.greatest(own, below).alias("best"), (own >= below).alias("keep")
            )
        best.append(materialise(now, "density-best"))

    # Downwards: the first kept cluster on each branch wins.  A lone cluster at the
    # top, and its unbroken continuation, is the whole table and not a cluster.
    chosen: list[DataFrame] = []
    top = len(cuts) - 1
    open_ = best[top]
    root = open_.count() == 1
    for level in range(top, -1, -1):
        picked = open_.filter("keep") if not root else open_.limit(0)
        chosen.append(picked.select(F.lit(level).alias("level"), "comp"))
        if level == 0:
            break
        passed = (open_ if root else open_.filter(~F.col("keep"))).select(F.col("comp").alias("parent"))
        open_ = materialise(best[level - 1].join(passed, "parent", "left_semi"), "density-open")
        if root:
            root = open_.count() == 1
    picks = chosen[0]
    for c in chosen[1:]:
        picks = picks.unionByName(c)
    return members.join(picks, ["level", "comp"]).select("node", "comp")


def class_tfidf(df: DataFrame, topic: str, tokens: Column, terms: int = KEYWORDS, vocab: str = "global") -> DataFrame:
    """``(topic, term, score)``: TF-IDF with each topic as one document, noise left out.

    ``vocab='global'`` scores the ``terms`` most frequent terms of the corpus for
    every topic; ``'per_topic'`` scores every term of each topic.
    """
    if vocab not in {"global", "per_topic"}:
        raise ValueError("vocab must be 'global' or 'per_topic'")
    kept = df.filter(F.col(topic).isNotNull() & (F.col(topic) != -1))
    topics = kept.select(topic).distinct()
    n = topics.count()
    counts = materialise(term_counts(kept, topic, tokens), "topic-terms")
    totals = counts.groupBy("term").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("df"))
    if vocab == "global":
        totals = totals.orderBy(F.desc("total"), "term").limit(terms)
    idf = totals.select("term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    if vocab == "global":
        words = [r.asDict() for r in idf.collect()]
        if not words:
            return counts.select(topic, "term", F.lit(0.0).alias("score")).limit(0)
        listed = F.array(*[F.struct(F.lit(w["term"]).alias("term"), F.lit(w["idf"]).alias("idf")) for w in words])
        grid = topics.select(topic, F.inline(listed))
        weighted = grid.join(counts, [topic, "term"], "left").withColumn("w", F.coalesce("n", F.lit(0)) * F.col("idf"))
    else:
        weighted = counts.join(idf, "term").withColumn("w", F.col("n") * F.col("idf"))
    size = weighted.groupBy(topic).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    score = F.when(F.col("size") > 0, F.col("w") / F.col("size")).otherwise(0.0)
    return weighted.join(size, topic).select(topic, "term", score.alias("score"))


def topic_keywords(scores: DataFrame, topic: str, k: int = KEYWORDS) -> DataFrame:
    """``(topic, rank, term, score)``: the ``k`` best terms; equal scores in reverse alphabetical order."""
    order = Window.partitionBy(topic).orderBy(F.desc("score"), F.desc("term"))
    ranked = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(topic, "rank", "term", "score")


def class_tfidf_keywords(df: DataFrame, topic: str, tokens: Column, k: int = KEYWORDS, vocab: str = "global") -> DataFrame:
    return topic_keywords(class_tfidf(df, topic, tokens, k, vocab), topic, k)


def topic_payload(
    df: DataFrame, topic: str, key: str, text: str, tokens: Column, vocab: str = "global", keywords: DataFrame | None = None
) -> DataFrame:
    """``(topic, keywords, context)``: ranked keywords and up to three whole sample texts per topic.

    ``keywords`` hands over what ``class_tfidf_keywords`` has found already.
    """
    words = class_tfidf_keywords(df, topic, tokens, vocab=vocab) if keywords is None else keywords
    lists = words.groupBy(topic).agg(_in_order("rank", "term").alias("keywords"))
    samples = sample_per_group(df.filter(F.col(topic) != -1), [topic], key, CONTEXTS, text)
    context = samples.groupBy(topic).agg(_in_order("rank", text).alias("context"))
    none = F.array().cast("array<string>")
    return lists.join(context, topic, "left").withColumn("context", F.coalesce("context", none))


def _in_order(rank: str, value: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(rank, value))), lambda s: s[value])

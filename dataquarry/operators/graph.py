"""Iterative label propagation on edge tables; every round is a written table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataquarry.runtime import discard, materialise


def connected_components(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = (), ordered: bool = False) -> DataFrame:
    """``(by..., node, comp)``: the smallest node reachable from each node.

    ``nodes`` is ``(by..., node)``, ``edges`` is ``(by..., src, dst)`` in either
    direction between nodes; ``ordered`` says that each is there once, with ``src > dst``.  Each round points every node to its smallest neighbour, if that
    is smaller, follows the pointers to their ends, and goes on with the edges between different
    ends.  An end that took no node has a smaller neighbour in the next round, so the nodes that still
    have edges at least halve in two rounds on any graph, and edges shrink with them.  A hub receives
    one number per neighbour after partial aggregation.
    """
    by = list(by)
    larger, smaller = F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")
    first = edges.select(*by, "src", "dst") if ordered else edges.filter("src <> dst").select(*by, larger, smaller).distinct()
    rest = materialise(first, "cc-edges")
    ends: list[DataFrame] = []
    while not rest.isEmpty():
        links = rest.groupBy(*by, F.col("src").alias("node")).agg(F.min("dst").alias("next"))
        ends.append(follow_links(links, by))
        at = lambda side: ends[-1].select(*by, F.col("node").alias(side), F.col("last").alias(f"{side}_end"))
        moved = rest.join(at("src"), [*by, "src"]).join(at("dst"), [*by, "dst"], "left").select(
            *by, F.col("src_end").alias("src"), F.coalesce("dst_end", "dst").alias("dst")
        )
        before, rest = rest, materialise(moved.filter("src <> dst").select(*by, larger, smaller).distinct(), "cc-edges")
        discard(before)
    discard(rest)
    # Backwards: what a pointer ended at may have moved in later rounds.
    moves: DataFrame | None = None
    for found in reversed(ends):
        if moves is not None:
            later = moves.select(*by, F.col("node").alias("last"), F.col("last").alias("further"))
            found = found.join(later, [*by, "last"], "left").select(*by, "node", F.coalesce("further", "last").alias("last")).unionByName(moves)
            found = materialise(found, "cc")
        moves = found
    if moves is None:
        return nodes.select(*by, "node", F.col("node").alias("comp"))
    return materialise(nodes.join(moves, [*by, "node"], "left").select(*by, "node", F.coalesce("last", "node").alias("comp")), "cc")


def follow_links(links: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., node, last)`` for ``(by..., node, next)`` links without cycles: where each chain ends.

    Pointer jumping doubles the distance covered each round.
    """
    by = list(by)
    state = materialise(links.select(*by, "node", F.coalesce("next", "node").alias("last")), "links")
    while True:
        jump = state.select(*by, F.col("node").alias("last"), F.col("last").alias("further"))
        after = materialise(
            state.join(jump, [*by, "last"], "left").select(
                *by, "node", F.coalesce("further", "last").alias("last"),
                (F.coalesce("further", "last") != F.col("last")).alias("moved"),
            ),
            "links",
        )
        moved = after.filter("moved").limit(1).count()
        discard(state)
        state = after.select(*by, "node", "last")
        if not moved:
            return state

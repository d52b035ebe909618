"""Graphs whose edges are tables: connected components, and maximum matchings of bipartite ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.scratch import remove_stored, stored


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (its least node). edges: two columns of one type. Each round takes the least label among a node and its neighbours and then that label's own label; rounds grow with the logarithm of the longest path, about,
    and each is a stored table. Nulls join nothing; an edge may stand twice or both ways."""
    one = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = stored(one.union(one.select("other", "node")).distinct(), "edges")
    labels = stored(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("least"))
        told = labels.join(near, "node").select("node", "component", F.least("component", "least").alias("least"))
        hop = labels.select(F.col("node").alias("least"), F.col("component").alias("further"))
        next_ = stored(told.join(hop, "least", "left").select("node", F.least("least", "further").alias("component"), (F.least("least", "further") < F.col("component")).alias("moved")), "labels")
        remove_stored(labels)
        moved, labels = next_.where("moved").limit(1).count(), next_
        if not moved:
            remove_stored(both)
            return labels.drop("moved")


def matching(edges: dict[int, list[int]]) -> dict[int, int]:
    """The largest matching of left to right nodes that is first in order: each left node, in ascending order, takes the least right node that leaves the size as large as can be. Augmenting paths, without recursion."""
    left_of: dict[int, int] = {}
    right_of: dict[int, int] = {}
    fixed: set[int] = set()

    def augment(start: int, without: int | None = None) -> bool:
        """A path of alternating edges from a free left node to a free right node, turned round; fixed right nodes and one more stay out."""
        came: dict[int, int] = {}
        seen, stack = set(fixed) | ({without} if without is not None else set()), [start]
        while stack:
            u = stack.pop()
            for v in edges.get(u, ()):
                if v in seen:
                    continue
                seen.add(v)
                came[v] = u
                if v in left_of:
                    stack.append(left_of[v])
                    continue
                while True:
                    u = came[v]
                    before = right_of.get(u)
                    left_of[v], right_of[u] = u, v
                    if u == start:
                        return True
                    v = before
        return False

    for u in sorted(edges):
        augment(u)
    for u in sorted(edges):
        had = right_of.get(u)
        for v in sorted(edges[u]):
            if v in fixed:
                continue
            if v != had:
                loser = left_of.get(v)
                if loser is None and had is None:
                    continue  # the size would grow, which it cannot
                if had is not None:
                    del left_of[had]
                right_of[u], left_of[v] = v, u
                if loser is not None:
                    del right_of[loser]
                    free = (w for w in sorted(edges) if w > u and w not in right_of)  # the loser, or another that takes its part
                    if had is not None and not any(augment(w, v) for w in free):  # the size would shrink: as it was
                        left_of[v], right_of[loser] = loser, v
                        left_of[had], right_of[u] = u, had
                        continue
            fixed.add(v)
            break
    return right_of


def matched(edges: DataFrame, left: str, right: str) -> DataFrame:
    """left, right: the pairs of the first largest matching in the order of the nodes' names. One component is one task's work; components do not share nodes, so their matchings make up the whole."""
    named = edges.select(F.col(left).alias("_l"), F.col(right).alias("_r")).distinct()
    parts = components(named.select(F.concat(F.lit("l"), "_l").alias("a"), F.concat(F.lit("r"), "_r").alias("b")), "a", "b")
    rows = named.join(parts, F.concat(F.lit("l"), "_l") == F.col("node")).select("component", "_l", "_r")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        lefts, rights = sorted(group["_l"].unique()), sorted(group["_r"].unique())
        at, to = {x: k for k, x in enumerate(lefts)}, {x: k for k, x in enumerate(rights)}
        held: dict[int, list[int]] = {}
        for x, y in zip(group["_l"], group["_r"], strict=True):
            held.setdefault(at[x], []).append(to[y])
        pairs = matching({u: sorted(v) for u, v in held.items()})
        return pd.DataFrame({left: [lefts[u] for u in pairs], right: [rights[v] for v in pairs.values()]})

    return rows.groupBy("component").applyInPandas(run, f"{left} string, {right} string")

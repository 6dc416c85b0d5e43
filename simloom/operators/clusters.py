"""Density clustering: a spanning forest of the neighbour graph, condensed by weight, the most stable parts chosen."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .distance import Feature
from .neighbors import neighbour_table

#: Neighbour edges that one group may hold; beyond that clusters() raises instead of filling up a task.
MOST_EDGES = 20_000_000


def spanning_forest(edges: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Edges of a minimum spanning forest, lightest first; ties by the ends."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for w, a, b in sorted(edges):
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            out.append((w, a, b))
    return out


class _Node:
    """A cluster of the condensed hierarchy."""

    __slots__ = ("birth", "children", "falls", "stability")

    def __init__(self, birth: float):
        self.birth, self.children, self.falls, self.stability = birth, [], [], 0.0


def hierarchy_clusters(n: int, edges: list[tuple[float, int, int]], weight: Sequence[float], least_weight: float) -> list[int]:
    """A cluster number from 1 for each of n points, 0 for noise.

    The forest's merges, heaviest first, split a cluster into two where both sides weigh enough; else the lighter side
    falls out of it. A cluster's stability is the weight that leaves it times how much denser it is by then. Of a
    cluster and its parts the more stable is chosen; a single root never is, several roots may be.
    """
    tree: list[tuple[float, int, int]] = []  # merges: distance and two nodes; node n + i is merge i
    at, mass = list(range(n)), list(weight)
    own = list(range(n))

    def top(x: int) -> int:
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for w, a, b in spanning_forest(edges):
        x, y = top(a), top(b)
        at[x] = y
        tree.append((w, own[x], own[y]))
        mass.append(mass[own[x]] + mass[own[y]])
        own[y] = n + len(tree) - 1
    roots = sorted({own[top(i)] for i in range(n)} - set(range(n)))

    def points(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            x = stack.pop()
            if x < n:
                out.append(x)
            else:
                stack += tree[x - n][1:]
        return out

    nodes: list[_Node] = []
    starts = []
    for r in roots:
        if mass[r] >= least_weight:
            starts.append((r, _Node(0.0)))
            nodes.append(starts[-1][1])
    first = [c for _, c in starts]
    while starts:
        node, cluster = starts.pop()
        while node >= n:
            w, a, b = tree[node - n]
            lam = 1.0 / w if w > 0 else 1e300
            big = [x for x in (a, b) if mass[x] >= least_weight]
            if len(big) == 2:
                for x in (a, b):
                    child = _Node(lam)
                    cluster.children.append(child)
                    cluster.stability += mass[x] * (lam - cluster.birth)
                    nodes.append(child)
                    starts.append((x, child))
                break
            rest = [x for x in (a, b) if x not in big] if big else [a, b]
            for x in rest:
                cluster.stability += mass[x] * (lam - cluster.birth)
                cluster.falls += points(x)
            if not big:
                break
            node = big[0]
        else:
            cluster.falls.append(node)
    chosen: set[int] = set()
    value: dict[int, float] = {}
    for c in reversed(nodes):  # a part is made after the cluster that it is part of
        inner = sum(value[id(x)] for x in c.children)
        if (c not in first or len(first) > 1) and c.stability >= inner:
            chosen.add(id(c))
            value[id(c)] = c.stability
            stack = list(c.children)
            while stack:
                x = stack.pop()
                chosen.discard(id(x))
                stack += x.children
        else:
            value[id(c)] = inner
    labels = [0] * n
    stack = [(c, 0) for c in reversed(first)]
    found: list[list[int]] = []
    while stack:
        c, label = stack.pop()
        if not label and id(c) in chosen:
            found.append([])
            label = len(found)
        if label:
            found[label - 1] += c.falls
        stack += [(x, label) for x in c.children]
    found.sort(key=min)
    for k, members in enumerate(found, 1):
        for i in members:
            labels[i] = k
    return labels


def clusters(
    df: DataFrame, k: int | Sequence[float], least_weight: float, features: Sequence[Feature], p: float = 1.0, surprisal: bool = False,
    id_col: str = "id", weight: str | None = None,
) -> DataFrame:
    """(id, cluster): cluster numbers in the order of their smallest ids, 0 for noise.

    Neighbours, core distances and edges are made in parallel. The hierarchy takes all edges together, so one task
    gets rows times k edges; their number is checked against MOST_EDGES first.
    """
    near = neighbour_table(df, k, features, p, surprisal, id_col, weight, spare=0)
    near = near.filter(F.col("r") <= k) if isinstance(k, int) else near
    core = near.groupBy("i").agg(F.max("d").alias("core"), F.max("wi").alias("wi"))
    edges = near.select("i", "j", "d").join(core.select("i", "core"), "i").join(core.select(F.col("i").alias("j"), F.col("core").alias("other")), "j")
    edges = edges.select("i", "j", F.greatest("core", "other", "d").alias("d"), F.lit(None).cast("double").alias("w"))
    size = edges.count()
    if size > MOST_EDGES:
        raise ValueError(f"{size} neighbour edges; {MOST_EDGES} is the most that one task takes")
    own = df.select(F.col(id_col).alias("i"), F.col(id_col).alias("j"), F.lit(None).cast("double").alias("d"), (F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)).alias("w"))
    kind = df.schema[id_col].dataType.simpleString()

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = rows[rows["w"].notna()].sort_values("i")
        place = {x: n for n, x in enumerate(nodes["i"])}
        pairs = rows[rows["w"].isna()]
        links = [(d, min(place[a], place[b]), max(place[a], place[b])) for a, b, d in zip(pairs["i"], pairs["j"], pairs["d"], strict=True)]
        labels = hierarchy_clusters(len(nodes), links, nodes["w"].tolist(), least_weight)
        return pd.DataFrame({id_col: nodes["i"].to_numpy(), "cluster": labels})

    return edges.union(own).withColumn("_", F.lit(0)).groupBy("_").applyInPandas(lambda pdf: work(pdf), f"{id_col} {kind}, cluster int")

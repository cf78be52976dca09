"""Maximum one-to-one matching of predictions to annotations inside each document."""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame


def maximum_matching(edges: list[tuple]) -> int:
    """Size of a maximum matching: from every left node a breadth-first search for an augmenting path."""
    near = defaultdict(list)
    for a, b in dict.fromkeys(edges):
        near[a].append(b)
    left, right = {}, {}
    for root in near:
        came, queue, end = {}, deque([root]), None
        while queue and end is None:
            a = queue.popleft()
            for b in near[a]:
                if b in came:
                    continue
                came[b] = a
                if b not in right:
                    end = b
                    break
                queue.append(right[b])
        while end is not None:
            a = came[end]
            before = left.get(a)
            left[a], right[end], end = end, a, before
    return len(left)


def matched_counts(edges: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, matched: size of a maximum matching of a to b over the edges of each key. Groups are single documents."""
    kind = dict(edges.dtypes)[key]

    def one(k: tuple, p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [k[0]], "matched": [maximum_matching(list(zip(p[a], p[b])))]})

    return edges.select(key, a, b).dropna().groupBy(key).applyInPandas(one, f"{key} {kind}, matched int")

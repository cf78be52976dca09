"""Reading order of page blocks by recursive cuts along empty gaps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _widest_gap(intervals: list[tuple[float, float]], least: float) -> float | None:
    """Middle of the widest empty stretch between intervals, if any is at least ``least`` wide."""
    best, middle, reach = least, None, None
    for lo, hi in sorted(intervals):
        if reach is not None and lo - reach >= best and (middle is None or lo - reach > best):
            best, middle = lo - reach, (reach + lo) / 2
        reach = hi if reach is None else max(reach, hi)
    return middle


def xy_order(boxes: list[tuple[float, float, float, float]], gap: float = 8.0, depth: int = 12) -> list[int]:
    """Indices in reading order: cut at the widest gap, rows before columns, until no gap is left."""

    def walk(ids: list[int], level: int) -> list[int]:
        if len(ids) > 1 and level < depth:
            for axis in (1, 0):
                at = _widest_gap([(boxes[i][axis], boxes[i][axis + 2]) for i in ids], gap)
                if at is not None:
                    near = [i for i in ids if boxes[i][axis + 2] <= at]
                    return walk(near, level + 1) + walk([i for i in ids if i not in set(near)], level + 1)
        return sorted(ids, key=lambda i: (boxes[i][1], boxes[i][0], i))

    return walk(list(range(len(boxes))), 0)


def reading_order(blocks: DataFrame) -> DataFrame:
    """block_key, place: order within each page from the boxes. Blocks without a box are left out; groups are single pages."""
    good = blocks.where("size(bbox) = 4 and doc_id is not null and page is not null").select("doc_id", "run_id", "page", "block_key", "bbox")

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("block_key")
        order = xy_order([tuple(b) for b in p["bbox"]])
        return pd.DataFrame({"block_key": p["block_key"].to_numpy()[order], "place": range(len(order))})

    return good.groupBy("doc_id", "run_id", "page").applyInPandas(one, "block_key long, place int").withColumn("place", F.col("place").cast("int"))

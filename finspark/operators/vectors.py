"""Exact nearest neighbours by cosine, a stated query set against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block on the side of all rows, and queries that one pass sends to the workers.
BLOCK, QUERIES_PER_PASS = 8192, 20_000


def cosine_topk(vectors: DataFrame, k: int = 5, every: int = 20) -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest other rows of every row whose id is divisible by ``every``.

    Queries go out in passes of QUERIES_PER_PASS, which bounds what is sent; each task keeps k rows per query
    and a window ranks them. Ties go to the smaller id. Null or zero vectors are no neighbours and no queries.
    """
    good = vectors.where("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    asked = good.where(F.col("vec_id") % every == 0)
    n = asked.count()
    passes = max(1, -(-n // QUERIES_PER_PASS))
    out = None
    for p in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).toPandas()
        q = np.array([x for x in rows["e"]], dtype=float) if len(rows) else np.empty((0, 1))
        norm = np.linalg.norm(q, axis=1) if len(rows) else np.empty(0)
        ids, q = rows["vec_id"].to_numpy()[norm > 0], (q[norm > 0] / norm[norm > 0, None])

        def near(batches: Iterator[pd.DataFrame], ids: np.ndarray = ids, q: np.ndarray = q) -> Iterator[pd.DataFrame]:
            for b in batches:
                for at in range(0, len(b), BLOCK):
                    c = b.iloc[at : at + BLOCK]
                    x = np.array([v for v in c["e"]], dtype=float)
                    size = np.linalg.norm(x, axis=1)
                    x, keys = x[size > 0] / size[size > 0, None], c["vec_id"].to_numpy()[size > 0]
                    if not len(keys) or not len(ids):
                        continue
                    s = np.round(q @ x.T, 6)
                    s[ids[:, None] == keys[None, :]] = -9
                    order = np.lexsort((np.broadcast_to(keys, s.shape), -s), axis=1)[:, :k]
                    r = np.repeat(np.arange(len(ids)), order.shape[1])
                    o = order.ravel()
                    keep = s[r, o] > -9
                    yield pd.DataFrame({"query_id": ids[r][keep], "vec_id": keys[o][keep], "score": s[r, o][keep]})

        one = good.mapInPandas(near, "query_id long, vec_id long, score double")
        out = one if out is None else out.unionAll(one)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    top = out.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.select("query_id", "vec_id", F.col("score").cast("decimal(9,4)").alias("score"), "rank")

"""Ordered choice: first usable attempt, latest version, top k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in an order; the limit is pushed into the sort."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def latest(df: DataFrame, key: str, at: str, fields: list[str]) -> DataFrame:
    """(key, *fields) of the latest version of each key, by a partial aggregate rather than a sort."""
    return df.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(at, *fields)).alias("_r")).select(key, "_r.*")


def nearest(vectors: DataFrame, k: int, every: int, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 4096) -> DataFrame:
    """(query_id, id, similarity, rank): the k most similar vectors of every `every`-th one, against all rows.

    Rows and queries are packed into blocks by the executors; each block of rows meets each block of
    queries as one matrix product and keeps k rows a query, so nothing passes through the driver.
    """
    import numpy as np
    import pyarrow as pa

    def packed(batches):
        ids, parts, held = [], [], 0
        for batch in batches:
            live = batch.filter(pa.compute.and_(batch.column(0).is_valid(), batch.column(1).is_valid()))
            if not live.num_rows:
                continue
            m = np.array(live.column(1).to_pylist(), np.float64)
            ids.append(np.asarray(live.column(0), dtype=np.int64))
            parts.append(m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12))
            held += len(m)
            if held >= block:
                yield one(ids, parts)
                ids, parts, held = [], [], 0
        if held:
            yield one(ids, parts)

    def one(ids, parts):
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(parts).tobytes()], pa.binary())], names=["ids", "m"])

    def search(batches):
        for batch in batches:
            out = [[np.empty(0, t)] for t in (np.int64, np.int64, np.float64)]
            for q_ids, q, own, m in zip(*(batch.column(c).to_pylist() for c in ("q_ids", "q", "ids", "m"))):
                q_ids, own = np.frombuffer(q_ids, np.int64), np.frombuffer(own, np.int64)
                q, m = (np.frombuffer(x, np.float64).reshape(len(i), -1) for x, i in ((q, q_ids), (m, own)))
                s = q @ m.T
                s[q_ids[:, None] == own[None, :]] = -2
                n = min(k + 1, len(own))
                best = np.argpartition(-s, n - 1, axis=1)[:, :n]
                for o, x in zip(out, (np.repeat(q_ids, n), own[best].ravel(), np.take_along_axis(s, best, 1).ravel())):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["query_id", "id", "similarity"])

    import pyarrow.compute  # noqa: F401

    rows = vectors.select(id_col, vec_col)
    asked = rows.where(F.col(id_col) % every == 0).mapInArrow(packed, "ids binary, m binary").withColumnsRenamed({"ids": "q_ids", "m": "q"}).withColumn("b", F.monotonically_increasing_id())
    n = asked.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, id bigint, similarity double, rank int")
    # A block of rows goes to every block of queries: a stated set of queries against all rows.
    order = Window.orderBy("b")
    blocks = asked.select("q_ids", "q", (F.row_number().over(order) - 1).alias("at"))
    met = rows.mapInArrow(packed, "ids binary, m binary").withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(blocks, "at")
    found = met.select("q_ids", "q", "ids", "m").mapInArrow(search, "query_id bigint, id bigint, similarity double").where("similarity > -1.5")
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 6)), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).withColumn("similarity", F.round("similarity", 6))

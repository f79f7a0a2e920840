"""Exact top-k by inner product: term-at-a-time accumulation over blocks of rows.

A block of rows is turned into postings: for each component (term) the block's weights. A query's
non-zero components scatter their weight times the postings into a dense array of scores, one for
each row of the block; a partition selection keeps the best k of the block, and the blocks' bests
are merged for each query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.common import shared_dir, staged, unstaged

#: Queries of one pass and rows of one block: 64 components of 4096 queries are 2 MB.
QUERY_BLOCK, ROW_BLOCK = 4096, 8192


def scaled(embedding: Column, factor: int = 1024) -> Column:
    """floor(factor * x) of each component as double, clipped to the range of long."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(factor))))


def usable(embedding: Column) -> Column:
    """Not null, and all components finite."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return embedding.isNotNull() & ~F.exists(embedding, bad)


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    at = lists.offsets.to_numpy()
    n, out = np.diff(at), np.zeros((len(lists), width), np.int64)
    rows = np.repeat(np.arange(len(n)), n)
    cols = np.arange(at[-1] - at[0]) - np.repeat(at[:-1] - at[0], n)
    values, fits = lists.values.to_numpy()[at[0] : at[-1]], cols < width
    out[rows[fits], cols[fits]] = values[fits]
    return out


def accumulate(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Scores of each query (row) with each row of the block, one component after the other."""
    most = max(1, *(int(np.abs(x).max(initial=0)) for x in (queries, block)))
    exact = np.int64 if queries.shape[1] * most * most < 2**62 else object
    scores = np.zeros((len(queries), len(block)), exact)
    for term in range(queries.shape[1]):
        weight, posting = queries[:, term].astype(exact), block[:, term].astype(exact)
        rows, hits = np.flatnonzero(weight != 0), np.flatnonzero(posting != 0)
        if len(rows) and len(hits) == len(block) and len(rows) == len(queries):
            scores += weight[:, None] * posting[None]
        elif len(rows) and len(hits):
            scores[np.ix_(rows, hits)] += weight[rows, None] * posting[None, hits]
    return scores


def select(scores: np.ndarray, ids: np.ndarray, own: object, k: int) -> np.ndarray:
    """Places of the k best of one query's scores, ties to the smaller id; rows with the query's id are left out."""
    places = np.flatnonzero(ids != own)
    s = scores[places]
    if len(s) > k:
        s = np.asarray(s)
        least = np.partition(s, len(s) - k)[len(s) - k]
        places = places[s >= least]
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def top_k(queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score. Both inputs: vec_id long, v array<long>.

    Every query meets every row. Queries come to the driver in blocks of about half of QUERY_BLOCK (all at once up to QUERY_BLOCK), each a pass
    over the rows, so what is sent to the executors has a fixed size; queries are staged once, and each block's result is added to
    one table, so neither a scan nor a plan grows with the number of blocks. Shorter vectors count as
    filled up with zeros. Rows without an id are no queries and no candidates; a repeated id counts
    as one query, the first by its vector. Scores beyond long are clipped to it.
    """
    spark = rows.sparkSession
    q = staged(queries.where("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v")))
    n = q.count()
    blocks = -(-2 * n // QUERY_BLOCK) if n > QUERY_BLOCK else min(n, 1)
    q = q.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks))))
    best, path = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"), shared_dir(spark)
    kind = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], kind).write.parquet(path)
    for block in range(blocks):
        own = q.where(F.col("block") == block).select("vec_id", "v").toArrow().combine_chunks()
        v = own.column("v").combine_chunks()
        width = max((len(x) for x in v.to_pylist()), default=0)
        sent = spark.sparkContext.broadcast((own.column("vec_id").to_numpy(), _matrix(v, width)))

        def score(batches, sent=sent):
            ids, matrix = sent.value
            kept: list[list[np.ndarray]] = [[np.zeros(0, np.int64), np.zeros(0, np.int64)] for _ in ids]
            for big in batches:
                for at in range(0, big.num_rows, ROW_BLOCK):
                    b = big.slice(at, ROW_BLOCK)
                    rid, m = b.column("vec_id").to_numpy(), _matrix(b.column("v"), matrix.shape[1])
                    for lo in range(0, len(ids), 256):
                        scores = accumulate(matrix[lo : lo + 256], m)
                        for i, s in enumerate(scores, lo):
                            best = select(s, rid, ids[i], k)
                            top = np.clip(s[best], -(2**63), 2**63 - 1).astype(np.int64)
                            all_ids, all_s = np.concatenate([kept[i][0], rid[best]]), np.concatenate([kept[i][1], top])
                            order = np.lexsort((all_ids, -all_s))[:k]
                            kept[i] = [all_ids[order], all_s[order]]
            n = [len(x[0]) for x in kept]
            if sum(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate([x[0] for x in kept])), pa.array(np.concatenate([x[1] for x in kept]))], ["query_id", "vec_id", "score"])

        part = rows.where("vec_id is not null").select("vec_id", "v").mapInArrow(score, "query_id long, vec_id long, score long")
        ranked = part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        ranked.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        sent.unpersist()
    unstaged(q)
    return spark.read.schema(kind).parquet(path)


def search(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The k nearest rows of each row whose vec_id is divisible by every."""
    rows = embeddings.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), scaled(F.col("embedding")).alias("v"))
    return top_k(rows.where(F.col("vec_id") % every == 0), rows, k)


ORACLE = """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s) WHERE rank <= 10
"""

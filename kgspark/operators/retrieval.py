"""Similar pairs, top-k and greedy matches within a group, block against block.

A group of any size is dealt into blocks of about BLOCK rows. Each two blocks meet once, in one
matrix product in double precision, and only what passes the threshold or a block's own top k
leaves it: neither a pair of rows nor a whole group is ever one row or one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.staging import staged

#: Rows of a block.
BLOCK = 1024


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """Unit rows of a list column; a null, a list of another size and a zero vector become zeros."""
    out = np.zeros((len(column), size))
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == size:
            out[i] = [np.nan if x is None else x for x in v]
    norms = np.sqrt((out * out).sum(1, keepdims=True))
    ok = np.isfinite(norms) & (norms > 0)
    return np.where(ok, out / np.where(ok, norms, 1), 0)


def _runs(keys: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """Function of batches sorted by keys that hands each run of equal keys, whole, to work."""

    def run(batches):
        rest: list[pa.Table] = []
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            own = t.select(keys).to_pandas()
            cuts = [0, *np.flatnonzero((own != own.shift()).to_numpy()[1:].any(1)) + 1, t.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                part = t.slice(lo, hi - lo)
                if rest and rest[-1].select(keys).slice(0, 1).to_pylist() != part.select(keys).slice(0, 1).to_pylist():
                    yield from work(pa.concat_tables(rest))
                    rest = []
                rest.append(part)
        if rest:
            yield from work(pa.concat_tables(rest))

    return run


def _blocks(rows: DataFrame, group: str, name: str) -> DataFrame:
    """group, name: how many blocks the group's rows make."""
    return rows.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))


def pairs_within(rows: DataFrame, group: str, ordering: str, threshold: float) -> DataFrame:
    """a, b, similarity of rows(id, group, ordering, v) with a before b and cosine above the threshold. A null group has no pairs."""
    own = staged(rows.select(F.col(group).alias("_g"), F.col("id"), F.col(ordering).alias("_o"), F.col("v")).where("_g is not null"))
    dealt = own.join(_blocks(own, "_g", "_n"), "_g").withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    met = dealt.select("_g", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", "id", "_o", "v")
    met = met.repartition("_g", "_i", "_j").sortWithinPartitions("_g", "_i", "_j", "_own")

    def work(t: pa.Table):
        i, j, own_ = t["_i"][0].as_py(), t["_j"][0].as_py(), t["_own"].to_numpy()
        k = t.num_rows if i == j else int((own_ == i).sum())
        size = max((len(v) for v in t["v"].to_pylist() if v is not None), default=0)
        x, at, ids = _matrix(t["v"], size), t["_o"].to_numpy(zero_copy_only=False), t["id"]
        right = slice(0, k) if i == j else slice(k, None)
        sims = x[:k] @ x[right].T
        left, other = np.nonzero(sims > threshold)
        other_ = other + (0 if i == j else k)
        ok = at[left] < at[other_]
        if i != j:
            swap = at[left] > at[other_]
            ok, (left_, other_) = ok | swap, (np.where(swap, other_, left), np.where(swap, left, other_))
        else:
            left_ = left
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(left_[ok])).combine_chunks(), ids.take(pa.array(other_[ok])).combine_chunks(), pa.array(sims[left[ok], other[ok]])], ["a", "b", "similarity"])

    kind = rows.schema["id"].dataType.simpleString()
    return met.mapInArrow(_runs(["_g", "_i", "_j"], work), f"a {kind}, b {kind}, similarity double")


def pairs_across(left: DataFrame, right: DataFrame, group: str, threshold: float) -> DataFrame:
    """a, b, similarity of rows left(id, group, v) and right(id, group, v) of a group with a cosine above the threshold."""
    met, kq, kr = _meeting(left, right.withColumn("_order", F.lit(0)), group, "_order")[:3]

    def work(t: pa.Table):
        m = int((t["_side"].to_numpy() == 0).sum())
        if not m or m == t.num_rows:
            return
        size = max((len(v) for v in t["v"].to_pylist() if v is not None), default=0)
        x = _matrix(t["v"], size)
        sims = x[:m] @ x[m:].T
        a, b = np.nonzero(sims > threshold)
        yield pa.RecordBatch.from_arrays([t["query"].take(pa.array(a)).combine_chunks(), t["id"].take(pa.array(b + m)).combine_chunks(), pa.array(sims[a, b])], ["a", "b", "similarity"])

    return met.mapInArrow(_runs(["_g", "_i", "_j"], work), f"a {kq}, b {kr}, similarity double")


def _meeting(queries: DataFrame, rows: DataFrame, group: str, order: str) -> tuple[DataFrame, str, str, str]:
    """Rows by _g, _i, _j in which each block of queries meets each block of rows of its group once, queries (_side 0) first; the kinds of their columns."""
    q = staged(queries.select(F.col(group).alias("_g"), F.col("id").alias("query"), "v").where("_g is not null"))
    r = staged(rows.select(F.col(group).alias("_g"), "id", F.col(order).alias("_o"), "v").where("_g is not null"))
    both = _blocks(q, "_g", "_nq").join(_blocks(r, "_g", "_nr"), "_g")
    to = lambda x, key, n, other: x.join(both, "_g").select("*", F.pmod(F.xxhash64(key), F.col(n)).cast("int").alias("_own"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("_other"))
    kq, kr, ko = (d.schema[c].dataType.simpleString() for d, c in ((q, "query"), (r, "id"), (r, "_o")))
    left = to(q, "query", "_nq", "_nr").select("_g", F.col("_own").alias("_i"), F.col("_other").alias("_j"), F.lit(0).alias("_side"), "query", F.lit(None).cast(kr).alias("id"), F.lit(None).cast(ko).alias("_o"), "v")
    right = to(r, "id", "_nr", "_nq").select("_g", F.col("_other").alias("_i"), F.col("_own").alias("_j"), F.lit(1).alias("_side"), F.lit(None).cast(kq).alias("query"), "id", "_o", "v")
    met = left.unionByName(right).repartition("_g", "_i", "_j").sortWithinPartitions("_g", "_i", "_j", "_side")
    return met, kq, kr, ko


def top_within(queries: DataFrame, rows: DataFrame, group: str, k: int, later_first: bool = False, order: str = "id", above: float | None = None) -> DataFrame:
    """query, id, rank, similarity: the k nearest rows of the query's group; equals by order, the later first if so asked.

    queries(id, group, v) and rows(id, group, v, order); similarity is rounded to 6 places, of those above the bound if there is one.
    """
    met, kq, kr, ko = _meeting(queries, rows, group, order)

    def work(t: pa.Table):
        m = int((t["_side"].to_numpy() == 0).sum())
        if not m or m == t.num_rows:
            return
        size = max((len(v) for v in t["v"].to_pylist() if v is not None), default=0)
        x = _matrix(t["v"], size)
        sims = np.round(x[:m] @ x[m:].T, 6) + 0.0
        order_ = pd.Series(t["_o"].slice(m).to_pandas()).rank(method="first", ascending=not later_first).to_numpy()
        by_order = np.argsort(order_, kind="stable")
        best = by_order[np.argsort(-sims[:, by_order], 1, kind="stable")[:, :k]]
        at = np.repeat(np.arange(m), best.shape[1])
        s = np.take_along_axis(sims, best, 1).ravel()
        keep = np.ones(len(s), bool) if above is None else s > above
        yield pa.RecordBatch.from_arrays([t["query"].take(pa.array(at[keep])).combine_chunks(), t["id"].take(pa.array(best.ravel()[keep] + m)).combine_chunks(), t["_o"].take(pa.array(best.ravel()[keep] + m)).combine_chunks(), pa.array(s[keep])], ["query", "id", "_o", "similarity"])

    near = met.mapInArrow(_runs(["_g", "_i", "_j"], work), f"query {kq}, id {kr}, _o {ko}, similarity double")
    tie = F.col("_o").desc() if later_first else F.col("_o")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("similarity").desc(), tie))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "id", "rank", "similarity")


def greedy_matches(candidates: DataFrame, accept: Callable[[list, list], list[bool]], batch: int = 1) -> DataFrame:
    """std, found, similarity: for each std the first candidate in falling similarity that accept takes; found may serve several.

    candidates(std, found, similarity, left, right): accept gets the texts left and right of a few pairs at a time and is not
    asked further once a std has its match. One std's candidates come together, sorted, so equals go by found.
    """
    fields = candidates.schema
    kinds = {c: fields[c].dataType.simpleString() for c in ("std", "found")}

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["similarity", "found"], ascending=[False, True], kind="stable")
        for at in range(0, len(rows), batch):
            some = rows.iloc[at : at + batch]
            for ok, (_, row) in zip(accept(some["left"].tolist(), some["right"].tolist()), some.iterrows()):
                if ok:
                    return row.to_frame().T[["std", "found", "similarity"]].astype({"similarity": "float64"})
        return rows.iloc[:0][["std", "found", "similarity"]]

    return candidates.groupBy("std").applyInPandas(first, f"std {kinds['std']}, found {kinds['found']}, similarity double")

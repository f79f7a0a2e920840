"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket; the bucket in which a source's budget runs out is the
only one refined, with the next bits of the hash, until it holds one hash value. A threshold on the
hash then decides each document: no sort, and prefixes of the hash order are nested, so a larger
budget keeps what a smaller one took.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.common import byte_rows, free_name, in_batches, staged

HASH_BITS, LEVEL_BITS = 60, 6


def mix_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of md5 of the id's text and the text; nulls count as empty. So rows of one id, or of none, are told apart by their texts."""
    both = F.concat_ws("\n", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, 15), 16, 10).cast("long")


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, h. size: words [^\\x20\\x09-\\x0D]+ of the whole text; null text: 0."""

    def count(batches):
        for b in batches:
            sizes = [len(x.split()) for x in byte_rows(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(sizes, pa.int64()), b.column("h")], ["doc_id", "source", "size", "h"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"), mix_hash(F.col("doc_id").cast("long"), F.col("text")).alias("h"))
    return in_batches(rows, count, "doc_id long, source string, size long, h long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row for each source: source, source_size, weight, target.

    Sources in code-point order, null last, take the weights in turn. Targets are the shares of
    share * all sizes, stopped at most * the source's size, with the excess reshared by weight:
    target = min(most * size, weight * level), where level is found on the sources sorted by
    most * size / weight. The windows here run over one row for each source.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(order) - 1) % len(weights) + 1
    s = sums.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth))
    s = s.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("capped", F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"))
    s = s.withColumn("open", F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(whole) - F.col("capped")) / F.col("open"))
    over_all = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(over_all)
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * level, F.col("cap")))
    return s.select("source", "source_size", "weight", target.alias("target"))


def thresholds(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row for each source: s, source_size, target, base, h_at, last, rest.

    Every document of a source is taken floor(target / source_size) times and those whose hash is
    below the source's threshold once more. The document at the threshold is taken once more if
    that brings the sum nearer to the target. Rows of equal id and text have equal hashes and are treated
    alike; documents without words get the same rule and take 0 words; a null source is a source;
    an empty table gives an empty table. Sources are counted in thousands, not in documents: tables
    of one row for each source are joined as Spark sees fit (broadcast only while small).
    """
    t = source_targets(sized, weights, share, most)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = t.withColumn("base", base).withColumn("rest", F.greatest(F.col("target") - F.col("base") * F.col("source_size"), F.lit(0.0)))
    state = staged(state.select("source", "source_size", "target", "base", "rest", F.lit(0).cast("long").alias("path"), F.lit(1).alias("open")))
    rows, done = sized, []
    for at in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        bucket = F.shiftright("h", at)
        if at < HASH_BITS - LEVEL_BITS:
            s = state.select(F.col("source").alias("s"), "path")
            rows = staged(rows.join(s, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", at + LEVEL_BITS) == F.col("path"))).select(*sized.columns))
        hist = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
        s = state.select(F.col("source").alias("s"), "rest")
        w = Window.partitionBy("source").orderBy("bucket")
        cut = hist.join(s, F.col("source").eqNullSafe(F.col("s"))).withColumn("upto", F.sum("n").over(w))
        cut = cut.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest")) & (F.col("n") > 0))
        cut = cut.select(F.col("s").alias("s"), "bucket", (F.col("rest") - (F.col("upto") - F.col("n"))).alias("left"), F.col("n").alias("last"), "low", "high")
        new = state.drop("path", "open", "last", "h_at").join(cut, F.col("source").eqNullSafe(F.col("s")), "left")
        new = new.select("source", "source_size", "target", "base", F.coalesce("left", "rest").alias("rest"), F.col("bucket").alias("path"), F.when(F.col("bucket").isNull() | (F.col("low") == F.col("high")), 0).otherwise(1).alias("open"), "last", F.col("low").alias("h_at"))
        new = staged(new)
        done.append(new.where("open = 0"))
        state = new.where("open = 1")
        if state.isEmpty():
            break
    final = done[0]
    for x in done[1:]:
        final = final.unionByName(x)
    return final.select(F.col("source").alias("s"), "source_size", "target", "base", "h_at", "last", "rest")


def _copies(h: Column, name: dict[str, str] | None = None) -> Column:
    """How often a row is taken, from its hash and its source's threshold, whose columns may have other names."""
    base, h_at, last, rest = (F.col((name or {}).get(c, c)) for c in ("base", "h_at", "last", "rest"))
    more = F.when(h_at.isNull(), rest > 0).otherwise((h < h_at) | ((h == h_at) & (last < 2 * rest)))
    return base + more.cast("long")


def mix(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds source_size, target, copies and taken (= copies * size) to the rows of word_sizes()."""
    sized = staged(sized)
    out = sized.join(thresholds(sized, weights, share, most), F.col("source").eqNullSafe(F.col("s")))
    out = out.select(*sized.columns, "source_size", "target", _copies(F.col("h")).alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The documents of the mix: each row as often as it is taken (0, 1 or 2 times), columns unchanged, whatever their names."""
    f = thresholds(staged(word_sizes(docs)), weights, share, most)
    name = {c: free_name(c, docs.columns) for c in ("s", "base", "h_at", "last", "rest", "copies", "copy")}
    f = f.select(*[F.col(c).alias(name[c]) for c in ("s", "base", "h_at", "last", "rest")])
    out = docs.join(f, F.col("source").cast("string").eqNullSafe(F.col(name["s"])))
    out = out.withColumn(name["copies"], _copies(mix_hash(F.col("doc_id").cast("long"), F.col("text")), name))
    again = F.explode(F.sequence(F.lit(1), F.col(name["copies"]).cast("int")))
    return out.where(F.col(name["copies"]) > 0).withColumn(name["copy"], again).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = """
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s0),
s2 AS (SELECT *, 2.0::DOUBLE * source_size AS cap, (2.0::DOUBLE * source_size) / weight AS ratio FROM s1),
s3 AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - (sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap))
         / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
lv AS (SELECT arg_min(level, ratio) FILTER (WHERE level <= ratio) AS level FROM s3),
s4 AS (SELECT s3.source, source_size, least(cap, coalesce(weight * lv.level, cap)) AS target FROM s3, lv),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS base FROM s4),
g AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
c AS (SELECT g.*, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
k AS (SELECT c.source, c.h, CASE WHEN upto <= rest THEN rest > 0 ELSE upto - n <= rest AND n < 2 * (rest - (upto - n)) END AS more
      FROM c JOIN (SELECT source, greatest(target - base * source_size, 0) AS rest FROM s5) s ON c.source IS NOT DISTINCT FROM s.source)
SELECT d.doc_id, d.size, s5.source_size, s5.target, d.size * (s5.base + k.more::BIGINT) AS taken
FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h
"""

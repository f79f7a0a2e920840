"""Near-duplicates by MinHash bands with sequential Bayesian verification.

Equal sets become one class first. The classes' signatures are cut into bands; a band's values name
a bucket. Candidates are compared in rounds: each class with a leader of its buckets, then, where a
bucket still holds more than one component, with all that are left, until no pair of different
components is uncompared. So a group of thousands of copies costs a comparison or two for each
member, and no pair of a bucket is lost. A candidate's signatures are compared batch by batch;
it is dropped as soon as the posterior probability that its similarity reaches the threshold falls
below the miss probability. Survivors are verified on the full sets of 64-bit shingle hashes; in the last round
block by block, so that a pair becomes a row only if it is a link.
"""

from __future__ import annotations

from functools import cache
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import byte_rows, in_batches, in_pieces, release, staged, unstaged
from kgspark.operators.components import connected_components

#: Words of a shingle, rows of a band, and the probability at most that a pair at the threshold shares no band.
WORDS, ROWS, APART = 5, 5, 1e-7
#: Signature positions, how many are compared at a time, and the posterior probability below which a pair is dropped:
#: over all 32 looks, that drops a pair at the threshold with probability 8e-6 at most.
HASHES, BATCH, MISS = 640, 20, 4e-7
#: Percent of similarity that links.
PERCENT = 85
#: Rounds with one comparison for each class, and entries and bytes of sets of a bucket that meet in one block of the last round.
TURNS, BLOCK, BLOCK_BYTES = 3, 256, 8 << 20

#: Words whose hashes a worker keeps.
KNOWN = 250_000


def bands(percent: int) -> int:
    """How many bands a signature has: so many that APART holds at this percent."""
    return ceil(log(APART) / log1p(-((percent / 100) ** ROWS)))


def least(percent: int) -> int:
    """The least set that reaches this percent with another set that isn't equal: one shingle less than the other."""
    return -(-percent // (100 - percent))


_M = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 2**64)) for k in range(WORDS)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Shingles:
    """Sorted distinct 64-bit hashes of a text's shingles of five lower-cased (A-Z) words."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(len(w), WORDS)
        total = np.full(len(w) - n + 1, n, np.uint64)
        for k in range(n):
            total += w[k : len(w) - n + 1 + k] * _M[k]
        return np.unique(_mixed(total))


@cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, 2**31, (HASHES, 1), np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, (HASHES, 1), np.uint32)


def minhash(shingles: np.ndarray) -> np.ndarray:
    a, b = _permutations()
    x, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(out, (a * x[None, at : at + 2048] + b).min(axis=1), out=out)
    return out


def band_keys(mins: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    m = mins[: bands(percent) * ROWS].reshape(-1, ROWS).astype(np.uint64)
    key = np.arange(1, len(m) + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + m[:, k])
    return key.view(np.int64)


def sketches(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, fp1, fp2 (name the set), keys (its buckets), sig (8 bits of each minimum). Small sets have no keys."""

    def sketch(batches):
        shingles, smallest = Shingles(), least(percent)
        for batch in batches:
            for b in in_pieces(batch, "text"):
                rows = []
                for text in byte_rows(b.column("text")):
                    s = shingles(text)
                    fp1, fp2 = (int(x) for x in np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(_mixed(s), initial=np.uint64(0))]).view(np.int64))
                    mins = minhash(s) if len(s) >= smallest else None
                    rows.append((len(s), fp1, fp2, [] if mins is None else band_keys(mins, percent), b"" if mins is None else ((mins * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()))
                n, fp1, fp2, keys, sig = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())], ["doc_id", "n", "fp1", "fp2", "keys", "sig"])
        shingles.known.clear()
        release()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return in_batches(rows, sketch, "doc_id long, n long, fp1 long, fp2 long, keys array<long>, sig binary")


@cache
def least_matches(percent: int = PERCENT, miss: float = MISS) -> np.ndarray:
    """For each number of batches: matches below which the posterior P(similarity >= threshold) < miss.

    Uniform prior; positions agree with probability J + (1 - J) / 256, as 8 bits are kept of each.
    """
    j = (np.arange(4000) + 0.5) / 4000
    p = j + (1 - j) / 256
    out = []
    for k in range(BATCH, HASHES + 1, BATCH):
        m = np.arange(k + 1)[:, None]
        like = m * np.log(p) + (k - m) * np.log1p(-p)
        like = np.exp(like - like.max(1, keepdims=True))
        posterior = like[:, j >= percent / 100].sum(1) / like.sum(1)
        out.append(int(np.argmax(posterior >= miss)))
    return np.array(out)


def _alive(x: np.ndarray, y: np.ndarray, sig: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs sig[x], sig[y] no batch of the signatures rules out, and their matches."""
    alive, hits = np.arange(len(x)), np.zeros(len(x), np.int64)
    for k, need in enumerate(least_matches(percent)):
        part = sig[:, k * BATCH : (k + 1) * BATCH]
        hits[alive] += (part[x[alive]] == part[y[alive]]).sum(1)
        alive = alive[hits[alive] >= need]
    return alive, hits[alive]


def prune(pairs: DataFrame, sigs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that no batch of their signatures rules out, with their matches (hits)."""

    def check(batches):
        for b in batches:
            both = np.frombuffer(b"".join(b.column("sa").to_pylist() + b.column("sb").to_pylist()), np.uint8).reshape(2 * b.num_rows, -1)
            at = np.arange(b.num_rows)
            alive, hits = _alive(at, at + b.num_rows, both, percent)
            own = pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).take(pa.array(alive))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(hits)], ["a", "b", "hits"])

    s = sigs.select("id", "sig")
    both = pairs.join(s.withColumnsRenamed({"id": "a", "sig": "sa"}), "a").join(s.withColumnsRenamed({"id": "b", "sig": "sb"}), "b")
    return in_batches(both.select("a", "b", "sa", "sb"), check, "a long, b long, hits long")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def shingle_sets(texts: DataFrame) -> DataFrame:
    """id, hashes: each text's set as sorted little-endian 64-bit hashes."""

    def run(batches):
        shingles = Shingles()
        for batch in batches:
            for b in in_pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([shingles(t).astype("<u8").tobytes() for t in byte_rows(b.column("text"))], pa.binary())], ["id", "hashes"])

    return in_batches(texts, run, "id long, hashes binary")


def _runs(work, start: tuple[str, ...] = ("key", "i", "j")):
    """Function of sorted batches that hands work whole runs of equal key, i and j: a table and the rows at which its runs begin, with its end."""

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            cols = [t.column(c).to_numpy() for c in start]
            starts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)]) if t.num_rows else np.zeros(1, np.int64)
            if len(starts) > 1:
                yield from work(t, starts)
            rest = t.slice(int(starts[-1]))
        if rest is not None and rest.num_rows:
            yield from work(rest, np.array([0, rest.num_rows]))

    return run


def candidates(entries: DataFrame, sigs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """key, i, j, a, b: for each two blocks i and j of a bucket that meet, the ids of all pairs that aren't ruled out, in two arrays.

    Pairs of a bucket are of different components and near sizes, and their signatures don't rule them out. A bucket of more than
    BLOCK entries, or BLOCK_BYTES of sets, is dealt into blocks, and each two blocks meet by themselves in numpy arrays, so there is
    one row for two blocks and none for a pair. A pair counts in the first band whose key it shares (the 8 bits of a signature also agree where keys don't).
    """
    blocks = F.col("m")
    bytes_ = F.sum(F.col("n") * 8)
    sizes = staged(entries.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(bytes_ / BLOCK_BYTES)).cast("int").alias("m")))
    x = entries.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    x = x.select("key", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "n", "root")
    x = x.join(sigs.select("id", "sig", "keys"), "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "own")

    def found(t: pa.Table, cuts: np.ndarray):
        ids, n, root, band, key, i, j, own = (t.column(c).to_numpy() for c in ("id", "n", "root", "band", "key", "i", "j", "own"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if i[lo] == j[lo]:
                a, b = np.triu_indices(hi - lo, 1)
            else:
                k = int((own[lo:hi] == i[lo]).sum())
                a, b = (g.ravel() for g in np.indices((k, hi - lo - k)))
                b = b + k
            a, b = a + lo, b + lo
            ok = (root[a] != root[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
            a, b = a[ok], b[ok]
            keep, _ = _alive(a, b, sig, percent)
            a, b = a[keep], b[keep]
            keep = np.flatnonzero((keys[a] == keys[b]).argmax(1) == band[a])
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array([key[lo]]), pa.array([i[lo]], pa.int32()), pa.array([j[lo]], pa.int32()), *[pa.array([ids[side[keep]].astype("<i8").tobytes()], pa.binary()) for side in (a, b)]], ["key", "i", "j", "a", "b"])

    return in_batches(x, _runs(found), "key long, i int, j int, a binary, b binary")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The distinct links (a, b) among candidates(): each set that two blocks need comes to them once, and only links become rows."""

    def members(batches):
        for b in batches:
            for key, i, j, x, y in zip(*[c.to_pylist() for c in b.columns]):
                ids = np.unique(np.frombuffer(x + y, "<i8"))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(ids), pa.int64()), pa.array([i] * len(ids), pa.int32()), pa.array([j] * len(ids), pa.int32()), pa.array(ids)], ["key", "i", "j", "id"])

    need = staged(pairs.mapInArrow(members, "key long, i int, j int, id long"))
    sets = staged(shingle_sets(texts.join(need.select("id").distinct(), "id", "left_semi")))
    none = F.lit(None)
    rows = need.join(sets, "id").select("key", "i", "j", "id", "hashes", none.cast("binary").alias("a"), none.cast("binary").alias("b"))
    rows = rows.unionByName(pairs.select("key", "i", "j", none.cast("long").alias("id"), none.cast("binary").alias("hashes"), "a", "b"))
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")  # the pairs come first

    def check(t: pa.Table, cuts: np.ndarray):
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            own = t.slice(lo, hi - lo)
            sets_ = {k: np.frombuffer(h, "<u8") for k, h in zip(own.column("id").to_pylist(), own.column("hashes").to_pylist()) if k is not None}
            x, y = (np.frombuffer(own.column(c)[0].as_py(), "<i8") for c in ("a", "b"))
            keep = np.array([_similar(sets_[a], sets_[b], percent) for a, b in zip(x.tolist(), y.tolist())], bool)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[keep]), pa.array(np.maximum(x, y)[keep])], ["a", "b"])

    return in_batches(rows, _runs(check), "a long, b long").distinct()


def verify(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def check(batches):
        shingles = Shingles()
        for b in batches:
            keep, last, own = [], None, None
            for ta, tb in zip(byte_rows(b.column("ta")), byte_rows(b.column("tb"))):
                if ta != last:
                    last, own = ta, shingles(ta)
                other = shingles(tb)
                keep.append(_similar(own, other, percent))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep))

    both = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"id": "b", "text": "tb"}), "b")
    return in_batches(both.select("a", "b", "ta", "tb"), check, "a long, b long")


def _leaders(entries: DataFrame, turn: int) -> DataFrame:
    """key, a, na, ra: the entry that comes first in each bucket in this turn's order."""
    order = F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "n", "root")
    firsts = entries.groupBy("key").agg(F.min(order).alias("x"))
    return staged(firsts.select("key", F.col("x.id").alias("a"), F.col("x.n").alias("na"), F.col("x.root").alias("ra")))


def links(docs: DataFrame, reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) that join those of the classes reps(id, n, keys, sig) that links connect.

    The first TURNS rounds hold each class's signature against the leaders of its buckets and verify
    it with the likeliest one, which joins most groups at the cost of one comparison for each class. What still shares
    a bucket with another component is then compared in full.
    """
    entries = reps.where("size(keys) > 0").select("id", "n", F.posexplode("keys").alias("band", "key"))
    several = staged(entries.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"))
    entries = staged(entries.join(several, "key").select("key", "band", "id", "n", F.col("id").alias("root")))
    unstaged(several)
    labels = staged(entries.select("id", "root").distinct())
    sigs = staged(reps.select("id", "sig", "keys").join(labels.select("id"), "id", "left_semi"))
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = staged(own.join(labels.select("id"), "id", "left_semi"))
    near = (F.col("a") != F.col("id")) & (F.col("ra") != F.col("root")) & (100 * F.least("na", "n") >= percent * F.greatest("na", "n"))
    for turn in range(TURNS + 1):
        if entries.isEmpty():
            break
        if turn < TURNS:
            leaders = _leaders(entries, turn)
            star = entries.join(leaders, "key").where(near)
            likely = prune(star.select("a", F.col("id").alias("b")).distinct(), sigs, percent)
            best = likely.groupBy("b").agg(F.max(F.struct("hits", "a")).alias("x"))
            pairs = staged(best.select(F.least("b", "x.a").alias("a"), F.greatest("b", "x.a").alias("b")).distinct())
            linked = staged(verify(pairs, texts, percent))
            unstaged(leaders, pairs)
        else:
            pairs = staged(candidates(entries, sigs, percent))
            linked = staged(confirmed(pairs, texts, percent))
            unstaged(pairs)
        edges = linked.join(labels.withColumnsRenamed({"id": "a", "root": "ra"}), "a").join(labels.withColumnsRenamed({"id": "b", "root": "rb"}), "b")
        roots = connected_components(edges.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        moved = roots.select(F.col("id").alias("was"), F.col("root").alias("to"))
        old, labels = labels, staged(labels.join(moved, F.col("root") == F.col("was"), "left").select("id", F.coalesce("to", "root").alias("root")))
        unstaged(linked, roots, old)
        if turn < TURNS:
            left = staged(entries.drop("root").join(labels, "id").select("key", "band", "id", "n", "root"))
            mixed = staged(left.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key"))
            unstaged(entries)
            entries = staged(left.join(mixed, "key").select("key", "band", "id", "n", "root"))
            unstaged(left, mixed)
    unstaged(entries, sigs, texts)
    return labels.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of doc_id and text, linked at a similarity of percent (1 to 99).

    Rows without words or text have n_shingles 0 and are linked with nothing. Rows of equal doc_id
    count as one document for links. A null doc_id is linked with nothing: its component_id is null
    and it is kept. An empty table gives an empty table; other columns are not read. A link between
    different sets is missed only where no band agrees or a signature misleads (see APART, MISS).
    """
    sketch = staged(sketches(docs, percent))
    usable = sketch.where("n > 0 and doc_id is not null")
    classes = staged(usable.groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("id")))
    member = staged(usable.select("doc_id", "fp1", "fp2", "n").join(classes, ["fp1", "fp2", "n"]).select("doc_id", "id"))
    reps = usable.where(f"n >= {least(percent)}").withColumnRenamed("doc_id", "id").join(classes, ["fp1", "fp2", "n", "id"], "left_semi").select("id", "n", "keys", "sig")
    again = member.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("a", "b")
    roots = connected_components(links(docs, staged(reps), percent).unionByName(again))
    one = member.groupBy("doc_id").agg(F.min("id").alias("id"))
    place = staged(one.join(roots, "id", "left").select("doc_id", F.coalesce("root", "id").alias("component_id")))
    out = sketch.select("doc_id", F.col("n").alias("n_shingles")).join(place, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

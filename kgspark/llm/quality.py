"""Quality classifier: random-indexing word vectors, a two-layer network, calibrated by temperature.

Every token bucket has a sparse random index vector; its context vector adds the index vectors of
its neighbours in all documents. A document is the mean of its tokens' index and context
vectors. A network with one hidden layer, trained in numpy on labelled rows, gives the logit; a temperature fitted
on texts kept out of training turns it into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm import words
from kgspark.llm.common import crc_mod, crc_mod_value, free_name, in_batches, in_pieces, release

#: Token buckets, dimensions of an index vector, non-zero places in it, hidden units.
BUCKETS, DIM, PLACES, HIDDEN, SEED = 1 << 15, 48, 6, 32, 11
#: Labelled rows to fit on at most, taken by a hash of the id: the bound of the training sample.
TRAIN_ROWS = 6000
THRESHOLD = 0.3
#: Parts in which the context vectors are added up, and bytes of text at a time.
RANGES, PIECE = 64, 1_000_000

#: Classes of bytes: white space, letters (all of UTF-8 beyond ASCII), digits, other signs.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2


def token_ids(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of letters, digits and other signs of the rows' whole bytes, and how many each row has; case counts.

    A token equal to the one before it is bucket 0, one equal to the last but one is bucket 1: so
    repetition is a word of its own.
    """
    kind = _CLASS[raw]
    starts = np.ones(len(raw), bool)
    starts[1:] = kind[1:] != kind[:-1]
    starts[offsets[:-1][offsets[:-1] < len(raw)]] = True
    at = np.flatnonzero(starts)
    ends = np.append(at[1:], len(raw))
    some = kind[at] > 0
    s, e = at[some], ends[some]
    ids = (words.hashes(raw, s, e) & np.uint64(BUCKETS - 1)).astype(np.int32)
    n = np.diff(np.searchsorted(s, offsets))
    place = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
    out = ids.copy()
    out[2:][(ids[2:] == ids[:-2]) & (place[2:] >= 2)] = 1
    out[1:][(ids[1:] == ids[:-1]) & (place[1:] >= 1)] = 0
    return out, n


@cache
def index_places() -> tuple[np.ndarray, np.ndarray]:
    """The PLACES dimensions of each bucket's index vector and the sign, 1 or -1, at each."""
    rng = np.random.default_rng(SEED)
    pairs = [(rng.integers(0, DIM, BUCKETS), rng.choice(np.array([-1, 1]), BUCKETS)) for _ in range(PLACES)]
    return np.stack([p for p, _ in pairs], 1), np.stack([s for _, s in pairs], 1).astype(np.float64)


def index_vectors() -> np.ndarray:
    places, signs = index_places()
    out = np.zeros((BUCKETS, DIM), np.float32)
    for k in range(PLACES):
        out[np.arange(BUCKETS), places[:, k]] += signs[:, k]
    return out


def add_contexts(total: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
    """Add to total (BUCKETS x DIM) the index vectors of all tokens' neighbours; a neighbour before counts rotated by one place."""
    places, signs = index_places()
    same = np.ones(len(ids), bool)
    same[(np.cumsum(n) - n)[n > 0]] = False
    after, flat = np.flatnonzero(same), total.reshape(-1)
    for at in range(0, len(after), 65536):
        some = after[at : at + 65536]
        left, right = ids[some - 1].astype(np.int64), ids[some].astype(np.int64)
        for k in range(PLACES):
            np.add.at(flat, left * DIM + places[right, k], signs[right, k])
            np.add.at(flat, right * DIM + (places[left, k] + 1) % DIM, signs[left, k])


def context_sums(docs: DataFrame) -> np.ndarray:
    """Context vectors (BUCKETS x DIM) over all rows of docs(text). Sums of whole numbers, so their order doesn't matter."""

    def add(batches):
        total = np.zeros((BUCKETS, DIM))  # whole numbers, exact as such
        for batch in batches:
            for b in in_pieces(batch, "_text", PIECE):
                add_contexts(total, *token_ids(*words.buffers(b.column("_text"))))
        parts = [x.astype("<i8").tobytes() for x in np.split(total, RANGES)] if total.any() else []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["part", "sums"])
        release()

    def merge(batches):
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("part").to_pylist(), b.column("sums").to_pylist()):
                totals[k] = totals.get(k, 0) + np.frombuffer(x, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], ["part", "sums"])

    kind = "part int, sums binary"
    rows = in_batches(docs.select(F.col("text").cast("string").alias("_text")), add, kind).repartition(RANGES, "part").mapInArrow(merge, kind)
    out = np.zeros((BUCKETS, DIM))
    for r in rows.collect():  # RANGES rows, BUCKETS x DIM numbers
        out.reshape(RANGES, -1)[r.part] = np.frombuffer(r.sums, "<i8")
    return out


def word_vectors(contexts: np.ndarray) -> np.ndarray:
    """Index and unit context vectors side by side; logs of the sums, so that the commonest neighbours don't drown the others."""
    logs = np.sign(contexts) * np.log1p(np.abs(contexts))
    unit = logs / np.maximum(np.linalg.norm(logs, axis=1, keepdims=True), 1e-6)
    return np.concatenate([index_vectors() / np.sqrt(np.float32(PLACES)), unit.astype(np.float32)], 1)


def pooled(ids: np.ndarray, n: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean of each row's tokens' vectors; zeros for a row without tokens."""
    out = np.zeros((len(n), vectors.shape[1]))
    row = np.repeat(np.arange(len(n)), n)
    for at in range(0, len(ids), 4096):
        own = row[at : at + 4096]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[starts]] += np.add.reduceat(vectors[ids[at : at + 4096]], starts, 0)
    return (out / np.maximum(n, 1)[:, None]).astype(np.float32)


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, labels: np.ndarray, aside: np.ndarray, vectors: np.ndarray, epochs: int = 40) -> Model:
    """x: the rows' pooled vectors; aside: rows that only the temperature is fitted on. With no rows every score is 0.5."""
    y, train = labels.astype(np.float32), ~aside
    rng = np.random.default_rng(SEED)
    rate = (y.sum() + 1) / (len(y) + 2)
    scale = x[train].std(0) + 1e-3 if train.any() else np.ones(x.shape[1], np.float32)
    m = Model(vectors, x[train].mean(0) if train.any() else np.zeros(x.shape[1], np.float32), scale, rng.normal(0, 0.1, (x.shape[1], HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, 0.1, HIDDEN).astype(np.float32), float(np.log(rate / (1 - rate))))
    if not train.any():
        m.w2 *= 0
        return m
    xs, ys = ((x - m.mean) / m.scale)[train], y[train]
    params = [m.w1, m.b1, m.w2, np.array([m.b2], np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(xs))
        for at in range(0, len(order), 64):
            a, t = xs[order[at : at + 64]], ys[order[at : at + 64]]
            h = np.maximum(a @ params[0] + params[1], 0)
            d = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -30, 30))) - t) / len(t)
            dh = d[:, None] * params[2] * (h > 0)
            step += 1
            for p, g, v, s in zip(params, [a.T @ dh + 1e-3 * params[0], dh.sum(0), h.T @ d + 1e-3 * params[2], d.sum(keepdims=True)], first, second):
                v += 0.1 * (g - v)
                s += 0.001 * (g * g - s)
                p -= 0.003 * (v / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    m.b2 = float(params[3][0])
    if aside.any():
        z, t = m.logits(x[aside]), y[aside]
        grid = np.geomspace(0.25, 8, 60)
        loss = [np.mean(np.logaddexp(0, z / k) - t * z / k) for k in grid]
        m.temperature = float(grid[int(np.argmin(loss))])
    return m


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on train_rows labelled rows at most, of those whose crc32(doc_id) mod 5 is not 0; word vectors come from all documents.

    Rows of equal doc_id count once, the first by text. Texts are pooled on the executors: the driver gets a vector for each row.
    """
    ids = labels.where("doc_id is not null and quality in (0, 1)").where(crc_mod(F.col("doc_id"), 5) != 0)
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("quality").cast("int").alias("_quality"))
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    some = own.join(F.broadcast(ids), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.min("_quality").alias("_quality"))
    vectors = word_vectors(context_sums(docs))
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches):
        for batch in batches:
            for b in in_pieces(batch, "_text", PIECE):
                x = pooled(*token_ids(*words.buffers(b.column("_text"))), sent.value)
                yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_quality"), pa.array([r.tobytes() for r in x], pa.binary())], ["_id", "_quality", "x"])

    rows = sorted(in_batches(some.select("_id", "_quality", "_text"), features, "_id long, _quality int, x binary").collect())  # as many rows as the bound allows
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows], np.float32).reshape(len(rows), vectors.shape[1])
    aside = np.array([crc_mod_value(r._id, 25) % 5 == 1 and crc_mod_value(r._id, 7) < 2 for r in rows], bool)
    return fit(x, np.array([r._quality for r in rows], np.float32), aside, vectors)


def predict(docs: DataFrame, model: Model, keep: list[str] = (), score: str = "score") -> DataFrame:
    """Columns keep (as they are) and the score, by the name given, of each row's whole text; null counts as empty."""
    sent, text = docs.sparkSession.sparkContext.broadcast(model), free_name("text", [*keep, score])

    def run(batches):
        m = sent.value
        for batch in batches:
            for b in in_pieces(batch, text, PIECE):
                p = m.score(pooled(*token_ids(*words.buffers(b.column(text))), m.vectors))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(p.astype(np.float64))], [*keep, score])
        release()

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias(text))
    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return in_batches(rows, run, ", ".join([*fields, f"`{score}` double"]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = learn(docs, labels)
    own = docs.select(F.col("doc_id").cast("long"), (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    out = predict(own, model, ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

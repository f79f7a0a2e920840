"""A causal self-attention language model in numpy, and corpus-wide unigram scores beside it.

The model reads subword ids. A text is cut into blocks of BLOCK positions; a block's queries see the
block before it and, masked, their own: windows overlap by half and each token is scored once.
Attention, one hidden layer and a two-level softmax (class, then token within the class) run over
thousands of blocks at a time. A word's probability by its subwords is mixed with its share of the corpus, as counted
over all training texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm import words
from kgspark.llm.common import crc_mod, in_batches, in_pieces, release, staged
from kgspark.llm.token_files import word_encoder

#: Positions of a block, width, hidden units, classes and tokens in a class, steps and blocks of a step.
BLOCK, WIDTH, HIDDEN, SIDE, STEPS, BATCH, SEED = 16, 16, 32, 40, 800, 256, 3
#: Training texts at most, and bytes of each, for the network's start on the driver, by a hash of the id. All counts and the rounds cover every training text.
TRAIN_ROWS, START_BYTES = 1200, 65536
#: Rounds over the chunks, each training on its share of them, and the learning rates of the start and of a round.
ROUNDS, RATE, ROUND_RATE = 4, 0.01, 0.003
#: Rows of a product of matrices: those of a whole step at once take half as long again.
ROWS = 256
#: Share of the corpus's word counts in the score's mixture; the network has the rest.
SHARE = 0.1
#: Bytes of text whose words share one dictionary.
CHUNK = 6 << 20
#: Distinct words whose ids a worker keeps, words of chunks that meet in one bucket, and words of texts scored at a time.
KEEP, WORDS_MET, WORDS_SCORED = 500_000, 1_000_000, 100_000
#: Chunks are rows of several MB: as a row group each, executors write and read them one by one, and a round skips the others' chunks.
CHUNK_FILES = {"compression": "zstd", "parquet.block.row.count.limit": 1}
#: Counts are rows of a few kB to some 100 kB; by itself Parquet's writer first looks at its memory after 100 of them, and a reader takes whole row groups.
COUNT_FILES = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 10, "parquet.page.size.row.check.max": 100}


@dataclass
class Network:
    """Parameters by name; to_own maps subword ids to the network's own, of which 0 is any other id.

    rest: by subword id, the log of its share of all other ids' probability by their counts, over an even share; 0 for the network's own.
    """

    p: dict[str, np.ndarray]
    to_own: np.ndarray
    others: int
    rest: np.ndarray | None = None

    # own ids: 0 other, 1 .. SIDE * SIDE - 2 subwords, the last one the end; SIDE * SIDE is the start.


def _blocks(own: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets in blocks, target -1 where there is none, and whether a block starts a text.

    own: all texts' ids with their ends; n: ids of each text.
    """
    k = -(-n // BLOCK)
    starts = np.concatenate([[0], np.cumsum(k)])
    places = np.repeat(starts[:-1] * BLOCK - (np.cumsum(n) - n), n) + np.arange(len(own))
    target = np.full(int(starts[-1]) * BLOCK, -1, np.int32)
    target[places] = own
    source = np.empty_like(target)
    source[1:] = target[:-1]
    source[starts[:-1] * BLOCK] = SIDE * SIDE
    source[source < 0] = 0
    first = np.zeros(int(starts[-1]), bool)
    first[starts[:-1]] = True
    return source.reshape(-1, BLOCK), target.reshape(-1, BLOCK), first


_CAUSAL = np.concatenate([np.zeros((BLOCK, BLOCK), np.float32), np.triu(np.full((BLOCK, BLOCK), -1e9, np.float32), 1)], 1)


def _dense(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    """a @ w as products of ROWS rows; numpy would make one for each block, or one for all, and both take longer."""
    rows, w = a.reshape(-1, a.shape[-1]), np.ascontiguousarray(w)
    out, whole = np.empty((len(rows), w.shape[1]), np.result_type(a, w)), len(rows) // ROWS * ROWS
    np.matmul(rows[:whole].reshape(-1, ROWS, rows.shape[1]), w, out=out[:whole].reshape(-1, ROWS, w.shape[1]))
    np.matmul(rows[whole:], w, out=out[whole:])
    return out.reshape(*a.shape[:-1], w.shape[1])


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b over all rows of both, as a sum of products of ROWS rows."""
    a, b = a.reshape(-1, a.shape[-1]), b.reshape(-1, b.shape[-1])
    whole = len(a) // ROWS * ROWS
    out = (a[:whole].reshape(-1, ROWS, a.shape[1]).transpose(0, 2, 1) @ b[:whole].reshape(-1, ROWS, b.shape[1])).sum(0)
    out += a[whole:].T @ b[whole:]
    return out


def _exps(scores: Callable[[], np.ndarray], total: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """exp of the scores, of rows by the last axis, and total of that, a sum for each row; minus the row's maximum only where a sum is out of range."""
    with np.errstate(over="ignore", invalid="ignore"):
        e = scores()
        np.exp(e, out=e)
        sums = total(e)
        if sums.size and not (sums.min() > 1e-30 and sums.max() < 1e30):
            e = scores()
            e -= e.max(-1, keepdims=True)
            np.exp(e, out=e)
            sums = total(e)
    return e, sums


def _hidden(p: dict[str, np.ndarray], x: np.ndarray, before: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """All values on the way to the hidden states of the blocks x, for training; before: the block before each.

    One head as wide as the embedding needs one matrix from queries to keys (qk) and one from values to outputs (vo).
    The attention a is a row's exps, whose shares are a times each.
    """
    both, e, q = p["e"].take(np.concatenate([before, x], 1), 0), p["e"].take(x, 0), (p["e"] @ (p["qk"] * np.float32(WIDTH**-0.5))).take(x, 0)
    mask, ones = p["place"] + _CAUSAL, np.ones(2 * BLOCK, np.float32)

    def scores():
        s = q @ both.transpose(0, 2, 1)
        s += mask
        s[first, :, :BLOCK] = -1e9
        return s

    a, each = _exps(scores, lambda s: (s.reshape(-1, 2 * BLOCK) @ ones).reshape(*s.shape[:2], 1))
    each = 1 / each
    c = a @ both
    c *= each
    h = _dense(c, p["vo"])
    h += e
    f = _dense(h, p["w1"])
    block = f.reshape(len(f), -1)
    block += np.tile(p["b1"], BLOCK)
    np.maximum(f, 0, out=f)
    out = _dense(f, p["w2"])
    out += h
    return {"both": both, "e": e, "q": q, "a": a, "each": each, "c": c, "h": h, "f": f, "out": out}


def _windows(x: np.ndarray) -> np.ndarray:
    """Each block after the first, behind the block before it, as a view of blocks that follow each other."""
    return np.ndarray((len(x) - 1, 2 * BLOCK, x.shape[2]), x.dtype, x, 0, x.strides)


def _states(net: Network):
    """Function of blocks that follow each other to their hidden states; the first block only precedes the second.

    Queries and values depend on the id alone, so they are looked up in tables of all ids.
    """
    p = net.p
    e, q, v = p["e"], p["e"] @ (p["qk"] * np.float32(WIDTH**-0.5)), p["e"] @ p["vo"]
    mask, ones, bias = p["place"] + _CAUSAL, np.ones(2 * BLOCK, np.float32), np.tile(p["b1"], BLOCK)

    def states(x: np.ndarray, first: np.ndarray) -> np.ndarray:
        ex, vx, own = e.take(x, 0), v.take(x, 0), q.take(x[1:], 0)

        def scores():
            s = own @ _windows(ex).transpose(0, 2, 1)
            s += mask
            s[first, :, :BLOCK] = -1e9
            return s

        s, total = _exps(scores, lambda s: (s.reshape(-1, 2 * BLOCK) @ ones).reshape(*s.shape[:2], 1))
        h = s @ _windows(vx)
        h /= total
        h += ex[1:]
        f = _dense(h, p["w1"])
        block = f.reshape(len(f), -1)
        block += bias
        np.maximum(f, 0, out=f)
        h += _dense(f, p["w2"])
        return h.reshape(-1, WIDTH)

    return states


def log_probabilities(net: Network, own: np.ndarray, n: np.ndarray, at_once: int = 4096, blocks: int = 128) -> np.ndarray:
    """Natural log probability of each id, in order; an other id's share is spread over all of them.

    Attention runs over a few blocks at a time, which stay in the processor's cache, the softmax over the
    targets of at_once blocks, sorted by class. Both of its levels are one product: a class's scores are beside those of its tokens.
    The biases' exps are weights of the sums of exps, minus the scores' maximum only in rows where a sum is out of range.
    """
    p, states = net.p, _states(net)
    x, target, first = _blocks(own, n)
    out = np.zeros(target.size, np.float64)
    x = np.concatenate([x[:1], x])
    tokens, bias = p["t"].reshape(SIDE, SIDE, WIDTH), p["tb"].reshape(SIDE, SIDE)
    levels, weights = [np.concatenate([p["c"], t.T], 1) for t in tokens], np.zeros((SIDE, 2 * SIDE, 2), p["c"].dtype)
    weights[:, :SIDE, 0], weights[:, SIDE:, 1] = np.exp(p["cb"]), np.exp(bias)
    added = (p["cb"][:, None] + bias).ravel()
    for at in range(0, len(first), at_once):
        part = first[at : at + at_once]
        h = np.concatenate([states(x[at + i : at + i + blocks + 1][: len(part) - i + 1], part[i : i + blocks]) for i in range(0, len(part), blocks)])
        t = target[at : at + at_once].ravel()
        used = np.flatnonzero(t >= 0)
        cls = t.take(used) // SIDE
        order = np.argsort(cls.astype(np.int16), kind="stable")
        used, cls = used.take(order), cls.take(order)
        t = t.take(used)
        h, within = h.take(used, 0), t - cls * SIDE + SIDE
        cuts = np.searchsorted(cls, np.arange(SIDE + 1)).tolist()
        lp, totals = added.take(t), np.empty((len(used), 2), p["c"].dtype)
        for c, (i, j) in enumerate(zip(cuts, cuts[1:])):
            for u in range(i, j, 2 * ROWS):
                w = min(u + 2 * ROWS, j)
                z = h[u:w] @ levels[c]
                lp[u:w] += z[:, c]
                lp[u:w] += z[np.arange(w - u), within[u:w]]
                with np.errstate(over="ignore", invalid="ignore"):
                    np.exp(z, out=z)
                    np.matmul(z, weights[c], out=totals[u:w])
        odd = np.flatnonzero(~((totals > 1e-30) & (totals < 1e30)).all(1))
        for c in np.unique(cls.take(odd)):
            rows = odd[cls.take(odd) == c]
            z = h.take(rows, 0) @ levels[c]
            top = z.reshape(-1, 2, SIDE).max(2)
            lp[rows] -= top.sum(1)
            totals[rows] = np.exp(z - np.repeat(top, SIDE, 1)) @ weights[c]
        np.log(totals, out=totals)
        lp -= totals[:, 0]
        lp -= totals[:, 1]
        lp = lp.astype(np.float64)
        lp[t == 0] -= np.log(net.others)
        out[at * BLOCK + used] = lp
    return out[target.ravel() >= 0]


def id_scores(net: Network, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probabilities of texts' ids in a row, and of each text's end. n: ids of each text."""
    lp = log_probabilities(net, np.insert(net.to_own[ids], np.cumsum(n), SIDE * SIDE - 1), n + 1)
    last = np.cumsum(n + 1) - 1
    own = np.delete(lp, last)
    return (own if net.rest is None else own + net.rest[ids]), lp[last]


def text_scores(net: Network, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sum of log10 probabilities of each text's ids and its end."""
    own, ends = id_scores(net, ids, n)
    total = np.concatenate([[0], np.cumsum(own)])[np.concatenate([[0], np.cumsum(n)])]
    return (np.diff(total) + ends) / np.log(10)


def mixed_scores(words_: np.ndarray, count: np.ndarray, n: int, lowest: float, share: float = SHARE) -> np.ndarray:
    """Log10 probability of each word or end under the mixture of the network and the corpus's counts.

    words_: the network's natural log probability, nan for a word without subwords, which counts with the lowest base score; count: how
    often training texts have it, of n words and ends in all.
    """
    net = np.where(np.isnan(words_), lowest * np.log(10), words_)
    with np.errstate(divide="ignore"):
        known = np.log(count / max(n, 1))
    return np.logaddexp(np.log(share) + known, np.log1p(-share) + net) / np.log(10)


def fit(ids: np.ndarray, n: np.ndarray, size: int, steps: int = STEPS, count: np.ndarray | None = None, ends: int | None = None) -> Network:
    """Train on texts' subword ids (size: how many ids there are). Without texts the network stays near uniform.

    count and ends, how often each id and the end occur in the whole corpus, choose the vocabulary and set the first biases;
    without them those of the texts do.
    """
    rng = np.random.default_rng(SEED)
    count, ends = np.bincount(ids, minlength=size) if count is None else count, len(n) if ends is None else ends
    best = np.argsort(-count, kind="stable")[: SIDE * SIDE - 2]
    to_own = np.zeros(size, np.int32)
    to_own[best] = np.arange(1, len(best) + 1)
    end = SIDE * SIDE - 1
    own = np.insert(to_own[ids], np.cumsum(n), end) if len(n) else np.zeros(0, np.int32)
    init = lambda *shape: rng.normal(0, 0.3 / np.sqrt(shape[0]) if len(shape) > 1 else 0, shape).astype(np.float32)
    share = np.bincount(to_own, count, SIDE * SIDE)
    share[end] += ends
    share = share.astype(np.float32) + np.float32(0.5)
    p = {"e": rng.normal(0, 0.5, (SIDE * SIDE + 1, WIDTH)).astype(np.float32), "qk": init(WIDTH, WIDTH), "vo": init(WIDTH, WIDTH), "place": np.zeros((BLOCK, 2 * BLOCK), np.float32), "w1": init(WIDTH, HIDDEN), "b1": init(HIDDEN), "w2": init(HIDDEN, WIDTH), "c": init(WIDTH, SIDE), "cb": np.log(share.reshape(SIDE, SIDE).sum(1) / share.sum()), "t": rng.normal(0, 0.1, (SIDE * SIDE, WIDTH)).astype(np.float32), "tb": np.log(share / np.repeat(share.reshape(SIDE, SIDE).sum(1), SIDE))}
    other = to_own == 0
    rest = np.where(other, np.log((count + 1) * (max(1, other.sum()) / (count[other].sum() + max(1, other.sum())))), 0)
    net = Network(p, to_own, max(1, size - len(best)), rest)
    if len(own):
        x, target, first = _blocks(own, n + 1)
        _train(p, x, first, target, [rng.integers(0, len(x), min(BATCH, len(x))) for _ in range(steps)], RATE)
    return net


def _train(p: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, target: np.ndarray, picks: list[np.ndarray], top: float) -> None:
    """One step of Adam on p, in place, for each of picks, the places of its blocks; the rate rises to top and falls.

    All parameters are parts of one array, which a step goes over in place.
    """
    before, names = np.roll(x, 1, 0), list(p)
    every = np.concatenate([p[k].ravel() for k in names])
    own = {k: part.reshape(p[k].shape) for k, part in zip(names, np.split(every, np.cumsum([p[k].size for k in names])[:-1]))}
    m1, m2, g, by = (np.zeros_like(every) for _ in range(4))
    for step, pick in enumerate(picks, 1):
        of = _gradients(own, x.take(pick, 0), before.take(pick, 0), first.take(pick), target.take(pick, 0))
        np.concatenate([of[k].ravel() for k in names], out=g)
        rate = top * min(1, step / min(30, 1 + len(picks) // 4)) * (1 - 0.95 * step / len(picks))
        np.multiply(g, g, out=by)
        by *= 0.01
        m2 *= 0.99
        m2 += by
        g *= 0.1
        m1 *= 0.9
        m1 += g
        np.sqrt(m2, out=by)
        by *= (1 - 0.99**step) ** -0.5
        by += 1e-7
        np.divide(m1, by, out=by)
        by *= rate / (1 - 0.9**step)
        every -= by
    for k in names:
        p[k][...] = own[k]


def _summed(places: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """Add rows to out at places, which may repeat."""
    places = places.astype(np.int16)
    order = np.argsort(places, kind="stable")
    places = places.take(order)
    starts = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
    pairs = np.result_type(rows, np.complex64)  # two numbers as a complex one are added at once
    out[places.take(starts)] += np.add.reduceat(rows.take(order, 0).view(pairs), starts, 0).view(rows.dtype)


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, before: np.ndarray, first: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean loss of the targets, by each parameter.

    A softmax is its rows' exps without the biases (zc, zt), whose exps are weights (wc, wt), over the rows' totals: what weights and
    totals would do to all of a row's numbers they do to its few inputs or to the sums. A target's exp is less by what it is to be.
    """
    s = _hidden(p, x, before, first)
    t = target.ravel()
    used = np.flatnonzero(t >= 0)
    cls = t.take(used) // SIDE
    order = np.argsort(cls.astype(np.int16), kind="stable")
    used, cls = used.take(order), cls.take(order)
    t = t.take(used)
    h, within = s["out"].reshape(-1, WIDTH).take(used, 0), t - cls * SIDE
    rows, cuts = np.arange(len(used)), np.searchsorted(cls, np.arange(SIDE + 1)).tolist()
    share = h.dtype.type(1 / max(1, len(rows)))
    tokens, wc, wt = p["t"].reshape(SIDE, SIDE, WIDTH), np.exp(p["cb"]), np.exp(p["tb"]).reshape(SIDE, SIDE)
    spans = [(c, slice(k, min(k + 2 * ROWS, j))) for c, (i, j) in enumerate(zip(cuts, cuts[1:])) for k in range(i, j, 2 * ROWS)]
    across = tokens.transpose(0, 2, 1).copy()

    def of_tokens():
        z = np.empty((len(rows), SIDE), h.dtype)
        for c, i in spans:
            np.matmul(h[i], across[c], out=z[i])
        return z

    def totals(z):
        out = np.empty(len(rows), z.dtype)
        for c, i in spans:
            np.matmul(z[i], wt[c], out=out[i])
        return out

    zc, total = _exps(lambda: _dense(h, p["c"]), lambda z: z @ wc)
    zc[rows, cls] -= total / wc.take(cls)
    each = (share / total)[:, None]
    g = {"c": _product(h * each, zc) * wc, "cb": each[:, 0] @ zc * wc}
    dh = _dense(zc, (p["c"] * wc).T)
    dh *= each
    zt, total = _exps(of_tokens, totals)
    zt[rows, within] -= total / wt.ravel().take(t)
    each = share / total
    scaled, part, weighted = h * each[:, None], np.empty_like(h), tokens * wt[:, :, None]
    gt, gb = np.zeros((SIDE, SIDE, WIDTH), h.dtype), np.zeros((SIDE, SIDE), h.dtype)
    for c, i in spans:
        z = zt[i]
        gt[c] += z.T @ scaled[i]
        gb[c] += each[i] @ z
        np.matmul(z, weighted[c], out=part[i])
    part *= each[:, None]
    dh += part
    gt *= wt[:, :, None]
    gb *= wt
    g |= {"t": gt.reshape(-1, WIDTH), "tb": gb.ravel()}
    out = np.zeros((x.size, WIDTH), h.dtype)
    out[used] = dh
    out = out.reshape(*x.shape, WIDTH)
    df = _dense(out, p["w2"].T)
    df *= s["f"] > 0
    g |= {"w2": _product(s["f"], out), "w1": _product(s["h"], df), "b1": np.ones(x.size, np.float32) @ df.reshape(-1, HIDDEN)}
    out += _dense(df, p["w1"].T)
    g["vo"] = _product(s["c"], out)
    dc, both, a = _dense(out, p["vo"].T), s["both"], s["a"]
    dc *= s["each"]
    dboth = a.transpose(0, 2, 1) @ dc
    ds = dc @ both.transpose(0, 2, 1)
    ds -= np.einsum("bij,bij->bi", dc, s["c"])[:, :, None]  # each row's mean under its shares, as c is their product with both
    ds *= a
    g["place"] = ds.sum(0)
    dboth += ds.transpose(0, 2, 1) @ s["q"]
    dq = ds @ both
    dq *= np.float32(WIDTH**-0.5)
    g["qk"] = _product(s["e"], dq)
    out += _dense(dq, p["qk"].T)
    dboth[:, BLOCK:] += out
    ge = np.zeros_like(p["e"])
    _summed(np.concatenate([before, x], 1).ravel(), dboth.reshape(-1, WIDTH), ge)
    return g | {"e": ge}


def learn(training: DataFrame, tokenizer_path: str, count: np.ndarray, ends: int, train_rows: int = TRAIN_ROWS) -> Network:
    """Start the network on train_rows texts of START_BYTES at most, those first by a hash of doc_id, one an id; count and ends are the whole corpus's."""
    ids = training.where("text is not null and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
    some = training.where(F.octet_length("text") <= START_BYTES).join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    texts = [r.text.encode().lower() for r in sorted(some.groupBy("_id").agg(F.min("text").alias("text")).collect())]  # as many rows and bytes as the bounds allow
    encoder = word_encoder(tokenizer_path, KEEP)
    ids, n = encoder(pa.array(texts, pa.binary()))
    return fit(ids, n, len(encoder.ends), count=count, ends=ends)


def training_words(parts: DataFrame) -> int:
    """How many words all training texts have."""

    def add(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(int(np.frombuffer(x, "<i4").sum(dtype=np.int64)) for x in b.column("counts").to_pylist())], pa.int64())], ["n"])

    return parts.select("counts").mapInArrow(add, "n long").agg(F.sum("n")).first()[0] or 0


def subword_counts(parts: DataFrame, size: int) -> np.ndarray:
    """How often each subword id occurs in all training texts."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for k in range(b.num_rows):
                each, ids, lengths = (np.frombuffer(b.column(c)[k].as_py(), "<i4") for c in ("counts", "ids", "lengths"))
                total += np.bincount(ids, np.repeat(each, lengths), size).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "c"])
        release()

    sums = parts.select("counts", "ids", "lengths").mapInArrow(count, "id long, c long").groupBy("id").agg(F.sum("c").alias("c"))
    out = np.zeros(size, np.int64)
    for r in sums.collect():  # a row for each subword id at most
        out[r.id] = r.c
    return out


def _texts(b: pa.RecordBatch, k: int, start: int = 0, stop: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The subword ids of a chunk's texts from start to stop in a row, and how many each text has."""
    at, ids, lengths = (np.frombuffer(b.column(c)[k].as_py(), "<i4") for c in ("places", "ids", "lengths"))
    cuts = np.concatenate([[0], np.cumsum(b.column("n")[k].values.to_numpy())])[start : None if stop is None else stop + 1]
    at = at[cuts[0] : cuts[-1]]
    each = lengths[at]
    n = np.diff(np.concatenate([[0], np.cumsum(each, dtype=np.int64)])[cuts - cuts[0]])
    return words.take_ragged(ids, (np.cumsum(lengths) - lengths)[at], each), n


def spans(n: np.ndarray, at_most: int) -> list[tuple[int, int]]:
    """Texts of n words each in spans of at_most words, one text at least, from and to."""
    out, ends, start = [], np.cumsum(n), 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(ends, at_most + (ends[start - 1] if start else 0), "right")))
        out.append((start, stop))
        start = stop
    return out


def refine(parts: DataFrame, net: Network) -> Network:
    """Train on every training text: in each round the round's chunks go on from the same network, and their networks' mean,
    weighted by blocks, is the next. So texts and steps grow with the input and nothing but sums of parameters moves.
    """
    names, end = sorted(net.p), SIDE * SIDE - 1
    joined = lambda p: np.concatenate([p[k].ravel() for k in names])
    for turn in range(ROUNDS):
        sent = parts.sparkSession.sparkContext.broadcast(net)

        def train(batches, sent=sent):
            start = sent.value
            total, weight = np.zeros(sum(v.size for v in start.p.values())), 0
            for b in batches:
                for k in range(b.num_rows):
                    ids, n = _texts(b, k)
                    own = ~np.array(b.column("held_out")[k].as_py(), bool)
                    if not own.any():
                        continue
                    ids, n = start.to_own[ids[np.repeat(own, n)]], n[own]
                    x, target, first = _blocks(np.insert(ids, np.cumsum(n), end), n + 1)
                    order = np.random.default_rng(SEED).permutation(len(x))
                    p = {c: v.copy() for c, v in start.p.items()}
                    _train(p, x, first, target, [order[i : i + BATCH] for i in range(0, len(x), BATCH)], ROUND_RATE)
                    total += len(x) * joined(p).astype(np.float64)
                    weight += len(x)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([weight], pa.int64())], ["p", "w"])
            release()

        def add(batches):
            total, weight = 0, 0
            for b in batches:
                for raw, w in zip(b.column("p").to_pylist(), b.column("w").to_pylist()):
                    total, weight = total + np.frombuffer(raw), weight + w
            if weight:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([weight], pa.int64())], ["p", "w"])

        some = parts.where(F.col("turn") == turn).select("held_out", "n", "places", "ids", "lengths")
        sums = some.mapInArrow(train, "p binary, w long").where("w > 0").repartition(8).mapInArrow(add, "p binary, w long").collect()
        sent.unpersist()
        if weight := sum(r.w for r in sums):
            mean, at, p = sum(np.frombuffer(r.p) for r in sums) / weight, 0, {}
            for k in names:
                p[k] = mean[at : at + net.p[k].size].reshape(net.p[k].shape).astype(np.float32)
                at += net.p[k].size
            net = replace(net, p=p)
    return net


def _tokenized(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row for each chunk of text: its distinct words' hashes, training counts and subword ids, its words by place, its round (turn)."""

    def run(batches):
        encode, part = word_encoder(tokenizer_path, KEEP), TaskContext.get().partitionId()
        task = f"{part}-{uuid.uuid4().hex}"
        number, size, at, rows = 0, 0, [], []

        def chunk():
            every = np.concatenate([x for x, _ in at] or [np.zeros(0, np.int32)])
            counts = np.bincount(np.concatenate([x[own] for x, own in at] or [np.zeros(0, np.int32)]), minlength=len(encode.words))
            place = np.zeros(len(encode.words), np.int32)
            place[every] = 1
            used = np.flatnonzero(place)
            used = used[np.argsort(encode.words.keys[used])]  # in the order of their hashes, by which buckets are ranges
            place[used] = np.arange(len(used))
            ids, lengths = encode.word_ids.take(used)
            raw = {"hashes": (encode.words.keys[used], "<u8"), "counts": (counts[used], "<i4"), "places": (place[every], "<i4"), "ids": (ids, "<i4"), "lengths": (lengths, "<i4")}
            one = {"chunk": [f"{task}-{number}"], "doc_id": [[r[0] for r in rows]], "held_out": [[r[1] for r in rows]], "n": [[r[2] for r in rows]], "turn": [(part + number) % ROUNDS]}
            return pa.RecordBatch.from_pydict(one | {c: [x.astype(kind).tobytes()] for c, (x, kind) in raw.items()}, _CHUNKS)

        for batch in batches:
            for b in in_pieces(batch, "text", 2_000_000):
                raw, offsets = words.buffers(b.column("text"))
                own, m = encode.numbers(words.LOWER[raw], offsets)
                size += len(raw) + 8 * b.num_rows
                held = b.column("held_out").to_pylist()
                at.append((own, np.repeat(~np.array(held, bool), m)))
                rows += zip(b.column("doc_id").to_pylist(), held, m.tolist())
                if size >= CHUNK:
                    yield chunk()
                    number, size, at, rows = number + 1, 0, [], []
                    encode.room()
        if rows:
            yield chunk()
        encode.forget()  # the worker's memory is for the next stage
        release()

    return in_batches(docs, run, "chunk string, doc_id array<long>, held_out array<boolean>, n array<long>, turn int, hashes binary, counts binary, places binary, ids binary, lengths binary")


_CHUNKS = pa.schema([("chunk", pa.string()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("n", pa.list_(pa.int64())), ("turn", pa.int32()), *[(c, pa.binary()) for c in ("hashes", "counts", "places", "ids", "lengths")]])


def _ranges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's words begin among a chunk's, which are sorted by hash, with the end."""
    step = -(-(2**64) // buckets)
    return np.append(np.searchsorted(hashes, np.array([k * step for k in range(buckets)], np.uint64)), len(hashes))


def corpus_counts(parts: DataFrame, buckets: int) -> DataFrame:
    """chunk, bucket, totals, distinct: the counts in all chunks of each chunk's words, bucket by bucket.

    The words of all chunks meet by ranges of their hashes, in arrays; distinct is, once for each bucket, how many of its words occur
    in training texts. Which words there are is never in one place.
    """

    def deal(batches):
        for b in batches:
            for k in range(b.num_rows):
                hashes, counts = np.frombuffer(b.column("hashes")[k].as_py(), "<u8"), np.frombuffer(b.column("counts")[k].as_py(), "<i4")
                cuts = _ranges(hashes, buckets)
                some = np.flatnonzero(np.diff(cuts))
                pieces = [slice(cuts[i], cuts[i + 1]) for i in some]
                yield pa.RecordBatch.from_arrays([pa.array([b.column("chunk")[k].as_py()] * len(some)), pa.array(some, pa.int32()), pa.array([hashes[p].tobytes() for p in pieces], pa.binary()), pa.array([counts[p].tobytes() for p in pieces], pa.binary())], ["chunk", "bucket", "h", "c"])

    def add(batches):
        held: list[tuple] = []

        def totals():
            n = [len(h) // 8 for _, _, h, _ in held]
            hashes, counts = np.frombuffer(b"".join(x[2] for x in held), "<u8"), np.frombuffer(b"".join(x[3] for x in held), "<i4")
            own, which = np.unique(hashes, return_inverse=True)
            each = np.bincount(which.ravel(), counts, len(own)).astype(np.int64)
            out = np.split(each[which.ravel()], np.cumsum(n)[:-1])
            distinct = [int((each > 0).sum()), *[0] * (len(held) - 1)]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held]), pa.array([x[1] for x in held], pa.int32()), pa.array([x.tobytes() for x in out], pa.binary()), pa.array(distinct, pa.int64())], ["chunk", "bucket", "totals", "distinct"])

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if held and held[-1][1] != row[1]:
                    yield totals()
                    held = []
                held.append(row)
        if held:
            yield totals()
        held = []
        release()

    dealt = parts.select("chunk", "hashes", "counts").mapInArrow(deal, "chunk string, bucket int, h binary, c binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "chunk string, bucket int, totals binary, distinct long")


def score_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row's whole text.

    score is the sum of the log10 probabilities of the words and the end, each a mixture (SHARE) of the network's, the product
    of its subwords' given all before them in its window, and the word's share of all training tokens. base_score is the sum of
    log10((c + 1) / (N + V + 1)) of words and the end over the counts of all training texts. Words are counted within chunks of text, the
    chunks' counts are added by the words' hashes, and each chunk gets the counts of its own words
    back: neither the vocabulary nor the texts come together in one place. A null text is empty. Words are told apart by 64-bit hashes.
    """
    rows = docs.select(F.col("doc_id").cast("long"), (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"), F.col("text").cast("string"))
    parts = staged(_tokenized(rows, tokenizer_path), **CHUNK_FILES)
    size = parts.agg(F.count("*").alias("chunks"), F.sum(F.length("hashes") / 8).alias("words"), F.sum(F.size(F.filter("held_out", lambda x: ~x))).alias("ends")).first()
    ends, buckets = size.ends or 0, max(16, int((size.words or 0) // WORDS_MET) + 1)
    counted = staged(corpus_counts(parts, buckets), **COUNT_FILES)
    count = subword_counts(parts, len(word_encoder(tokenizer_path, KEEP).ends))
    n, v = training_words(parts) + ends, (counted.agg(F.sum("distinct")).first()[0] or 0) + (1 if ends else 0)
    net = learn(rows.where(~F.col("held_out")), tokenizer_path, count, ends)
    sent = docs.sparkSession.sparkContext.broadcast(refine(parts, net))
    own = parts.select("chunk", F.lit(-1).alias("bucket"), "doc_id", "held_out", "n", "places", "ids", "lengths")
    both = own.unionByName(counted.drop("distinct"), allowMissingColumns=True)  # a chunk's row, then its counts, one after the other
    both = both.repartition(size.chunks // 2 + 1, "chunk").sortWithinPartitions("chunk", "bucket")
    lowest = np.log10(n + v + 1.0)

    def scored(b, totals):
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        ids, held, own = (b.column(c)[0].values for c in ("doc_id", "held_out", "n"))
        count = np.append(np.frombuffer(b"".join(totals), "<i8"), ends)
        places, lengths = (np.frombuffer(b.column(c)[0].as_py(), "<i4") for c in ("places", "lengths"))
        cuts = np.concatenate([[0], np.cumsum(own.to_numpy())])
        for i, j in spans(np.diff(cuts), WORDS_SCORED):  # a text's score is its own, so this only bounds the memory
            m, place = np.diff(cuts[i : j + 1]), places[cuts[i] : cuts[j]]
            at = np.insert(place, np.cumsum(m), len(count) - 1)
            last = np.cumsum(m + 1)
            per_text = lambda x, last=last: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], last])])
            base = per_text(np.log10(count + 1.0)[at] - lowest)
            each = lengths[place]
            by_id, by_end = id_scores(sent.value, *_texts(b, 0, i, j))
            net = np.diff(np.concatenate([[0], np.cumsum(by_id)])[np.concatenate([[0], np.cumsum(each, dtype=np.int64)])])
            net[each == 0] = np.nan
            score = pa.array(per_text(mixed_scores(np.insert(net, np.cumsum(m), by_end), count[at], n, -lowest)))
            yield pa.RecordBatch.from_arrays([ids[i:j], held[i:j], pa.array(m + 1), pa.array(per_text(count[at] > 0), pa.int64()), pa.array(np.full(len(m), n)), pa.array(base), score], names)
        release()

    def sums(batches):
        release()  # of earlier stages
        chunk, totals = None, []
        for b in batches:
            for k, bucket in enumerate(b.column("bucket").to_pylist()):
                if bucket >= 0:
                    totals.append(b.column("totals")[k].as_py())
                    continue
                if chunk:
                    yield from scored(chunk, totals)
                chunk, totals = b.slice(k, 1), []
        if chunk:
            yield from scored(chunk, totals)

    return in_batches(both, sums, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

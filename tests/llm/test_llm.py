"""The ten operators and the pipeline on small fixtures, against plain versions and edge cases."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kgspark.llm import langid, lm, media, mixing, neardup, quality, sentencepiece_codec, token_counts, token_files, topk

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, id string, hits int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, s, None, "x", "y", "z", 1) for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    words = ["the", "and", "Haus", "straße", "été", "word.", "don't", "x1", "a", "<|endoftext|>"] + [f"w{k}" for k in range(60)]
    out = []
    for i in range(60):
        out.append((i * 3, " ".join(rng.choice(words, rng.integers(1, 80))), ["en", "de", None][i % 3], ["s0", "s0", "s1", None][i % 4]))
    base = rng.choice(words, 200).tolist()
    for k in range(12):
        near = list(base)
        near[k * 10] = f"edit{k}"
        out.append((1000 + k, " ".join(near), "en", "s0"))
    out += [(2000 + k, "same text of seven words in all", "de", "s0") for k in range(20)]
    out += [(3000, None, "en", "s1"), (3001, "", "en", "s1"), (3002, " \n\t ", None, None), (None, "no id here at all now", "en", "s0"), (3003, "long " * 30000, "en", "s2"), (3003, "long " * 30000, "en", "s2"), (3004, "é x\x1cy  z\r\n日本 😀 ▁▁q", "fr", "s1"), (3005, "123 !!", "en", "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).repartition(5).cache()


def words_of(t):
    return (t or "").encode().split()


def test_mix(docs, rows):
    got = mixing.mix(mixing.word_sizes(docs)).collect()
    assert len(got) == len(rows)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
        assert all(r.taken <= 2 * r.size for r in own)
    assert math.isclose(sum({r.source: r.target for r in got}.values()), 1.5 * sum(r.size for r in got))
    taken = Counter()
    for r in got:
        taken[r.doc_id, r.source] += r.copies
    assert +taken == Counter((r.doc_id, r.source) for r in mixing.mixed_documents(docs).collect())
    assert mixing.mix(mixing.word_sizes(docs.limit(0))).count() == 0


def test_sentencepiece(docs, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = sentencepiece_codec.encode(docs, PIECE, ["doc_id"]).collect()
    assert all(r.parity for r in got)
    want = Counter((i, tuple(sp.encode(t or ""))) for i, t, _, _ in rows)
    assert Counter((r.doc_id, tuple(r.pieces)) for r in got) == want
    texts = [t for _, t, _, _ in rows if t and "▁" not in t]
    assert sentencepiece_codec.decode([sp.encode(t) for t in texts], PIECE) == texts


def test_token_files(docs, rows):
    t = token_files.tokenizer(WORD)
    got = sorted((r for r in token_files.token_file_digests(docs, WORD).collect()), key=lambda r: r.start)
    start = 0
    for (i, text), r in zip(sorted(((i, t or "") for i, t, _, _ in rows), key=lambda x: (-1 if x[0] is None else x[0], x[1])), got):
        ids = t.encode(text, add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_language(docs, rows):
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[3000].lang_pred == by[3001].lang_pred == by[3005].lang_pred == "und" and by[2000].lang_pred in ("de", "en")
    assert by[5 * 3].held_out == (zlib.crc32(b"15") % 3 == 1)
    assert langid.identify(docs.limit(0)).count() == 0


def test_language_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.identify(d).where("held_out").join(d.select("doc_id", "lang"), "doc_id")
    assert held.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def sets_of(t):
    w = [bytes(x) for x in (t or "").encode().lower().split()]
    return frozenset([tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else []))


def test_near_duplicates(docs, rows):
    sets = [(i, sets_of(t)) for i, t, _, _ in rows if i is not None]
    root = {i: i for i, _ in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if s and u and 100 * len(s & u) >= 85 * len(s | u):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == find(r.doc_id) and r.kept == (r.doc_id == r.component_id)
            assert r.n_shingles == len(dict(sets)[r.doc_id])
        else:
            assert r.component_id is None and r.kept
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_pair_whose_signatures_agree_by_chance_in_an_earlier_band(spark):
    keys = np.arange(2 * neardup.bands(85)).reshape(2, -1)
    keys[:, 3] = 99
    sig = bytes(neardup.HASHES)  # all bands agree in 8 bits, only band 3 in its key
    sigs = spark.createDataFrame([(k, sig, keys[k].tolist()) for k in range(2)], "id long, sig binary, keys array<long>")
    entries = spark.createDataFrame([(99, 3, k, 50, k) for k in range(2)], "key long, band int, id long, n long, root long")
    found = neardup.candidates(entries, sigs).collect()
    assert [sorted(np.frombuffer(r.a + r.b, "<i8").tolist()) for r in found] == [[0, 1]]


@pytest.mark.parametrize("percent", [80, 85])
def test_drop_probability_over_all_looks(percent):
    q, size = percent / 100 + (1 - percent / 100) / 256, neardup.BATCH
    step = [math.comb(size, k) * q**k * (1 - q) ** (size - k) for k in range(size + 1)]
    left, lost = np.ones(1), 0.0
    for need in neardup.least_matches(percent):
        left = np.convolve(left, step)
        lost += left[:need].sum()
        left[:need] = 0
    assert lost < 1e-5


def test_pipeline_links_at_80_percent(spark):
    import corpus_pipeline

    words = [f"w{k}" for k in range(100)]
    near = list(words)
    near[30], near[60] = "x", "y"  # 86 of 106 shingles: 0.81
    short = "a b c d e f g h"  # 4 shingles against 5: 0.80
    docs = table(spark, [(1, " ".join(words), "en", "s"), (2, " ".join(near), "en", "s"), (3, short, "en", "s"), (4, short + " i", "en", "s")])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]
    assert (neardup.bands(85), neardup.least(85), neardup.least(80)) == (28, 6, 4) and (1 - 0.8**neardup.ROWS) ** neardup.bands(80) < 1e-7


def test_token_counts(docs, rows):
    from tokenizers import Tokenizer, models

    m = sentencepiece_codec.parse(PIECE)
    u = Tokenizer(models.Unigram(list(zip(m.pieces, m.scores)), 0, True))
    want = Counter((i, len(u.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0) for i, t, _, _ in rows)
    assert Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs, PIECE).collect()) == want


def test_media(spark, docs, rows, tmp_path):
    path = media.write_archives(docs, f"file://{tmp_path}/a", at_most=20_000)
    got = media.features(media.read_archives(spark, path, range_bytes=5_000)).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t, _, _ in rows:
        p = media.payload_of((t or "").encode())
        assert len(p) % 576 == 0 and media.decode_png(media.encode_png((t or "").encode())) == (len((t or "").encode()), p)
        want[i, len((t or "").encode()), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert media.media_features(docs.limit(0)).count() == 0


def test_members_are_read_again_by_themselves(docs, tmp_path):
    import io

    path = media.write_archives(docs.coalesce(1), f"file://{tmp_path}/a")
    reader = media.ArchiveReader({"path": path, "rangeBytes": 20_000, "tries": 3})
    store, folder = media._open(path)
    parts = reader.partitions()
    whole = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["offset"]) for part in parts for b in reader.read(part) for r in b.to_pylist())
    assert len(whole) == docs.count() and len(parts) > 1

    class Store:
        """Gives a broken file first, then real ones, and counts how often files are opened."""

        def __init__(self, broken):
            self.opened, self.broken = 0, broken

        def open_input_file(self, name):
            self.opened += 1
            raw = store.open_input_file(name).read()
            if self.opened == 1 or self.opened <= self.broken:
                raw = raw[:200] + bytes(50) + raw[250:]
            return io.BytesIO(raw)

    archive, start, end = parts[0].ranges[0]
    with store.open_input_file(f"{folder}/{archive}") as f:
        import zipfile

        members = zipfile.ZipFile(f).infolist()
    flaky = Store(1)
    first = flaky.open_input_file(f"{folder}/{archive}")
    got = [reader.read_member(flaky, f"{folder}/{archive}", first, m) for m in members[:5]]
    assert 1 < flaky.opened <= 3  # only what the broken bytes hit is read again
    assert [media.decode_png(x) for x in got]
    with pytest.raises(ValueError):
        bad = Store(99)
        for m in members[:5]:
            reader.read_member(bad, f"{folder}/{archive}", bad.open_input_file(f"{folder}/{archive}"), m)


def test_quality(spark, docs, rows):
    labels = spark.createDataFrame([(i, int(i >= 1000), 0) for i, _, _, _ in rows if i is not None and i < 2500], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_language_model(docs, rows):
    got = lm.score_documents(docs, WORD).collect()
    end = object()
    tokens = [(i, words_of((t or "").lower() if (t or "").isascii() else "".join(c.lower() if c.isascii() else c for c in t)) + [end]) for i, t, _, _ in rows]
    c = Counter(w for i, ws in tokens for w in ws if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2)
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for i, ws in tokens)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score_documents(docs.limit(0), WORD).count() == 0


def test_network_sees_training_texts_beyond_its_start(spark):
    ids = spark.range(4000).where(F.crc32(F.col("id").cast("string").cast("binary")) % 7 != 2).orderBy(F.xxhash64("id"), "id")
    ids = [r.id for r in ids.collect()]
    held = next(i for i in range(4000) if zlib.crc32(str(i).encode()) % 7 == 2)
    common, rare = "the house and the garden " * 40, "zebra quartz umbrella volcano " * 40

    def score(late):
        rows = [(i, common if k < lm.TRAIN_ROWS else late, "en", "s") for k, i in enumerate(ids)] + [(held, rare, "en", "s")]
        return lm.score_documents(table(spark, rows).repartition(4), WORD).where(F.col("doc_id") == held).first().score

    seen, unseen = score(rare), score(common)
    assert seen > unseen + 3, (seen, unseen)


def test_rare_subwords_have_shares_by_their_counts():
    count = np.ones(2000, np.int64)
    count[: lm.SIDE**2 - 2], count[1700], count[1800] = 5, 3, 0
    net = lm.fit(np.arange(50), np.array([50]), 2000, 2, count, 1)
    a, b = (lm.text_scores(net, np.array([i]), np.array([1]))[0] for i in (1700, 1800))
    assert abs(a - b - math.log10(4)) < 1e-4
    assert abs(np.exp(net.rest[net.to_own == 0]).sum() / net.others - 1) < 1e-6


def test_counts_and_texts_of_chunks_are_those_of_the_whole_texts(docs, rows):
    data = docs.select("doc_id", F.lit(False).alias("held_out"), "text")
    parts = lm._tokenized(data, WORD).cache()
    encoder = token_files.word_encoder(WORD)
    lowered = lambda ts: pa.array([(t or "").encode().lower() for t in ts], pa.binary())
    ids, _ = encoder(lowered([t for _, t, _, _ in rows]))
    assert lm.subword_counts(parts, len(encoder.ends)).tolist() == np.bincount(ids, minlength=len(encoder.ends)).tolist()
    by_text = Counter(encoder(lowered([t]))[0].tobytes() for _, t, _, _ in rows)
    got = Counter()
    for b in [parts.toArrow().combine_chunks().to_batches()[0]]:
        for k in range(b.num_rows):
            out, n = lm._texts(b, k)
            got.update(x.tobytes() for x in np.split(out, np.cumsum(n)[:-1]))
    assert got == by_text


def test_attention_is_causal_and_gradients_hold():
    rng = np.random.default_rng(0)
    ids, n = rng.integers(0, 50, 400).astype(np.int32), np.array([150, 250])
    net = lm.fit(ids, n, 60, steps=3)
    own = np.insert(net.to_own[ids], np.cumsum(n), lm.SIDE**2 - 1)
    lp = lm.log_probabilities(net, own, n + 1)
    changed = own.copy()
    changed[100] = 5
    assert np.allclose(lm.log_probabilities(net, changed, n + 1)[:100], lp[:100], atol=1e-4)
    x, t, first = lm._blocks(own, n + 1)
    p = {k: v.astype(np.float64) * (1 if k in ("cb", "tb") else 3) for k, v in net.p.items()}  # so that every part matters
    g = lm._gradients(p, x, np.roll(x, 1, 0), first, t)
    loss = lambda: -lm.log_probabilities(lm.Network(p, net.to_own, 1), own, n + 1).mean()
    for k in p:
        largest = np.argsort(-np.abs(g[k]).ravel())[:3]
        assert np.abs(g[k]).max() > 1e-3, k
        for at in zip(*np.unravel_index(largest, g[k].shape)):
            was = p[k][at]
            step = 1e-3 * max(1, abs(was))
            p[k][at] = was + step
            up = loss()
            p[k][at] = was - step
            down = loss()
            p[k][at] = was
            assert abs((up - down) / (2 * step) - g[k][at]) < 0.03 * abs(g[k][at]) + 2e-5, (k, at)


def test_gradients_and_scores_hold_where_exps_are_out_of_range():
    """In float32, with scores of attention, classes and tokens far beyond what exp can hold, as in float64 by rows minus their maximum."""
    rng = np.random.default_rng(4)
    ids, n = rng.integers(0, 50, 6000).astype(np.int32), np.array([2500, 3500])
    net = lm.fit(ids, n, 60, steps=2)
    own = np.insert(net.to_own[ids], np.cumsum(n), lm.SIDE**2 - 1)
    x, t, first = lm._blocks(own, n + 1)
    for name, times in (("qk", 300), ("c", 300), ("t", 2000)):
        p = net.p | {name: net.p[name] * np.float32(times)}
        wide = {k: v.astype(np.float64) for k, v in p.items()}
        got, want = (lm._gradients(q, x, np.roll(x, 1, 0), first, t) for q in (p, wide))
        for k in p:
            assert np.abs(got[k].reshape(-1) - want[k].reshape(-1)).max() < 2e-2 * np.abs(want[k]).max() + 1e-6, (name, k)
        e, both = wide["e"][x], wide["e"][np.concatenate([np.roll(x, 1, 0), x], 1)]
        a = e @ wide["qk"] @ both.transpose(0, 2, 1) / np.sqrt(lm.WIDTH) + wide["place"] + lm._CAUSAL
        a[first, :, : lm.BLOCK] = -1e9
        a = np.exp(a - a.max(2)[:, :, None])
        h = e + a / a.sum(2)[:, :, None] @ both @ wide["vo"]
        h = h + np.maximum(h @ wide["w1"] + wide["b1"], 0) @ wide["w2"]
        used = t.ravel() >= 0
        h, (c, k) = h.reshape(-1, lm.WIDTH)[used], np.divmod(t.ravel()[used], lm.SIDE)
        logsoft = lambda z: z - np.log(np.exp(z - z.max(1)[:, None]).sum(1))[:, None] - z.max(1)[:, None]
        rows, tokens = np.arange(len(h)), wide["t"].reshape(lm.SIDE, lm.SIDE, -1)
        plain = logsoft(h @ wide["c"] + wide["cb"])[rows, c] + logsoft(np.einsum("nw,nkw->nk", h, tokens[c]) + wide["tb"].reshape(lm.SIDE, -1)[c])[rows, k]
        assert np.allclose(lm.log_probabilities(lm.Network(p, net.to_own, 1), own, n + 1), plain, rtol=1e-3, atol=5e-2), name


def test_products_by_rows_are_those_of_whole_matrices():
    rng = np.random.default_rng(5)
    for n in (0, 16, 16 * (lm.ROWS + 3)):
        a, b, w = (rng.normal(size=s) for s in ((n // 16, 16, 5), (n // 16, 16, 7), (5, 7)))
        assert np.allclose(lm._dense(a, w), a @ w)
        assert np.allclose(lm._product(a, b), a.reshape(-1, 5).T @ b.reshape(-1, 7))


def test_scores_are_those_of_the_network_written_plainly():
    """Every token once, from the softmax over classes and tokens, with the attention written token by token."""
    rng = np.random.default_rng(6)
    ids, n = rng.integers(0, 2500, 300).astype(np.int32), np.array([1, 0, 40, 259])
    count = rng.integers(0, 50, 2500)
    net = lm.fit(ids, n, 2500, 5, count, 9)
    p = {k: v.astype(float) for k, v in net.p.items()}
    logsoft = lambda z: z - np.log(np.exp(z - z.max()).sum()) - z.max()
    want = []
    for text in np.split(ids, np.cumsum(n)[:-1]):
        target = [*net.to_own[text], lm.SIDE**2 - 1]
        x = [lm.SIDE**2, *target[:-1]]
        total = 0.0
        for i, t in enumerate(target):
            lo = max(0, (i // lm.BLOCK - 1) * lm.BLOCK)
            e, q = p["e"][x[i]], p["e"][x[i]] @ p["qk"]
            s = np.array([q @ p["e"][x[j]] / np.sqrt(lm.WIDTH) + p["place"][i % lm.BLOCK, j - (i // lm.BLOCK - 1) * lm.BLOCK] for j in range(lo, i + 1)])
            a = np.exp(s) / np.exp(s).sum()
            h = e + sum(w * p["e"][x[j]] for w, j in zip(a, range(lo, i + 1))) @ p["vo"]
            h = h + np.maximum(h @ p["w1"] + p["b1"], 0) @ p["w2"]
            c, k = divmod(int(t), lm.SIDE)
            lp = logsoft(h @ p["c"] + p["cb"])[c] + logsoft(p["t"].reshape(lm.SIDE, lm.SIDE, -1)[c] @ h + p["tb"].reshape(lm.SIDE, -1)[c])[k]
            total += lp
            if t == 0:
                total += np.log((count[text[i]] + 1) / (count[net.to_own == 0] + 1).sum())
        want.append(total / np.log(10))
    assert np.allclose(lm.text_scores(net, ids, n), want, rtol=2e-4, atol=2e-3)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.1, 8).round(2).tolist()) for i in range(250)] + [(900, None), (901, [1.0, None]), (902, [float("nan")]), (1000, [0.1] * 8), (1100, [0.1] * 8)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    v = {i: np.floor(1024 * np.array(x, np.float32).astype(np.float64)).astype(int) for i, x in rows if x and len(x) == 8}
    want = [(q, k + 1, i, -s) for q in v if q % 100 == 0 for k, (s, i) in enumerate(sorted((-int(v[q] @ v[i]), i) for i in v if i != q)[:10])]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    block, topk.QUERY_BLOCK = topk.QUERY_BLOCK, 2  # several passes
    try:
        again = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    finally:
        topk.QUERY_BLOCK = block
    assert sorted(map(tuple, again)) == sorted(want)


def test_pipeline(spark):
    """The whole pipeline: its rows are those of its stages in turn, and nothing else."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
    want = Counter((r.doc_id, r.source, r.n_pieces, r.ids_crc32, r.parity) for r in docs.collect())
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[:2] == ["doc_id", "source"]
    assert Counter((r.doc_id, r.source, r.n_pieces, r.ids_crc32, r.parity) for r in out.collect()) == want and all(k[4] for k in want)


def test_chunks_are_written_one_by_one_and_meet_their_counts_in_a_stream(spark, docs, tmp_path):
    """A task's memory holds a chunk, however many it has: no row groups of many chunks, no aggregate or join that gathers them."""
    import pyarrow.parquet as pq

    out = lm.score_documents(docs, WORD)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Aggregate", "Join"))
    rows = spark.range(0, 12, 1, 1).select("id", F.repeat(F.lit("x"), 1000).alias("x"))
    rows.write.options(**lm.CHUNK_FILES).parquet(f"{tmp_path}/chunks")
    assert [pq.ParquetFile(f).num_row_groups for f in (tmp_path / "chunks").glob("*.parquet")] == [12]
    rows.withColumn("x", F.repeat("x", 1000)).withColumn("x", F.concat("x", "id")).write.options(**lm.COUNT_FILES, compression="none").parquet(f"{tmp_path}/counts")
    assert [pq.ParquetFile(f).num_row_groups for f in (tmp_path / "counts").glob("*.parquet")] == [2]


def test_spans_of_texts(docs):
    assert lm.spans(np.array([3, 0, 2, 9, 1, 1]), 5) == [(0, 3), (3, 4), (4, 6)]
    assert lm.spans(np.zeros(0, np.int64), 5) == []
    parts = lm._tokenized(docs.select("doc_id", F.lit(False).alias("held_out"), "text"), WORD)
    (b,) = parts.toArrow().combine_chunks().to_batches()
    for k in range(b.num_rows):
        ids, n = lm._texts(b, k)
        some = [lm._texts(b, k, i, j) for i, j in lm.spans(b.column("n")[k].values.to_numpy(), 50)]
        assert len(some) > 1
        assert np.array_equal(np.concatenate([x for x, _ in some]), ids) and np.array_equal(np.concatenate([m for _, m in some]), n)

"""Each pipeline stage against a plain version, on rows with nulls, repeats, ties, hot groups and clashing column names; models of many kinds."""

import re
import struct
import zlib
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kgspark.llm import langid, mixing, neardup, quality, sentencepiece_codec, token_files, words

CLASH = ["score", "lang_pred", "_text", "text_", "place", "s", "base", "h_at", "last", "rest", "copies", "copy", "score_", "kept"]
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASH)


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    de, en = ["haus", "und", "straße", "der", "über", "nicht"], ["the", "house", "and", "with", "thing", "of"]
    out = []
    for i in range(80):
        own = (de, en)[i % 2]
        out.append((i, " ".join(rng.choice(own, rng.integers(6, 60))) + (" !!" if i % 3 else ""), ("de", "en")[i % 2] if i % 5 else None, ["s0", "s0", "s0", "s1", None][i % 5]))
    base = rng.choice(en, 300).tolist()
    for k in range(15):
        near = list(base)
        near[(k * 17) % 300], near[(k * 31) % 300] = f"edit{k}", f"more{k}"
        out.append((200 + k, " ".join(near), "en", "s0"))
    out += [(300 + k, "one same text of many words here", "en", "s0") for k in range(30)]
    out += [(400, None, "en", "s1"), (401, "", "de", "s1"), (402, "123 !?", None, None), (403, "word", "en", None)]
    out += [(404, "twice the same row and words", "en", "s1")] * 2 + [(405, "first text of this number", "en", "s1"), (405, "another text of this number", "en", "s1")]
    out += [(None, "no number at all here now", "en", "s0")] * 2 + [(None, None, None, None), (None, "other words without any number", "en", "s0")]
    out += [(406, "long words " * 20000, "en", "s2"), (407, "ö" * 5000, "de", "s2"), (408, "日本語 だけ です", None, "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).repartition(6).cache()


def counted(df):
    return Counter((r.doc_id, r.text, r.lang, r.source) for r in df.collect())


def test_stages_keep_columns_and_empty_tables(spark, docs, tmp_path):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, str(tmp_path))
            if name != "sentencepiece":
                assert out.columns == docs.columns, name
                assert {tuple(r)[4:] for r in out.collect()} <= {("x",) * len(CLASH)}
            else:
                assert out.count() == d.count()


def test_language_stage(spark, docs, rows):
    counts = {}
    for i, t, lang, _ in rows:
        if t and lang and zlib.crc32(b"" if i is None else str(i).encode()) % 3 != 1:
            counts.setdefault(lang, Counter()).update(langid.trigrams(t).tolist())
    vector = lambda c: sum(n * langid.bind(np.array([k]))[0].astype(float) for k, n in c.items())
    protos = {g: vector(c) for g, c in counts.items()}
    protos = {g: v / np.linalg.norm(v) for g, v in protos.items()}
    mean = sum(protos.values()) / len(protos)
    protos = {g: (v - mean) / np.linalg.norm(v - mean) for g, v in protos.items()}
    want = Counter()
    for r in rows:
        codes = langid.trigrams(r[1] or "")
        if len(codes):
            v = vector(Counter(codes.tolist()))
            if max(float(v @ p) / np.linalg.norm(v) for p in protos.values()) > 0:
                want[r] += 1
    got = counted(corpus_pipeline.language_id(spark, docs, ""))
    assert got == want and 0 < sum(got.values()) < len(rows)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert sum(counted(corpus_pipeline.language_id(spark, unlabelled, "")).values()) == sum(bool(re.search(r"[^\W\d_]", r[1] or "")) for r in rows)


def plain_tokens(text):
    ids = [int(words.hashes(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0]) & (quality.BUCKETS - 1) for t in re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\x09-\x0d A-Za-z0-9\x80-\xff]+", text)]
    return [0 if k and x == ids[k - 1] else 1 if k > 1 and x == ids[k - 2] else x for k, x in enumerate(ids)]


def test_quality_tokens_and_contexts(rows):
    texts = [(t or "").encode()[:3000] for _, t, _, _ in rows] + [b"a a a b a b 12 12!", b"", b"\xff\x00 x"]
    raw, offsets = words.buffers(pa.array(texts, pa.binary()))
    ids, n = quality.token_ids(raw, offsets)
    want = [plain_tokens(t) for t in texts]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    got = np.zeros((quality.BUCKETS, quality.DIM))
    quality.add_contexts(got, ids, n)
    index, total = quality.index_vectors(), np.zeros((quality.BUCKETS, quality.DIM))
    for x in want:
        for a, b in zip(x, x[1:]):
            total[a] += index[b]
            total[b] += np.roll(index[a], 1)
    assert np.array_equal(got, total)


def test_quality_stage(spark, docs, rows, tmp_path):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] + [(3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    m = quality.learn(docs, labels)
    assert np.array_equal(m.vectors, quality.learn(docs.repartition(3), labels).vectors)

    def score(text):
        ids = plain_tokens((text or "").encode())
        x = sum((m.vectors[i].astype(float) for i in ids), np.zeros(m.vectors.shape[1])) / max(1, len(ids))
        h = np.maximum((x - m.mean) / m.scale @ m.w1 + m.b1, 0)
        return 1 / (1 + np.exp(-(h @ m.w2 + m.b2) / m.temperature))

    want = Counter(r for r in rows if score(r[1]) >= 0.3)
    got = counted(corpus_pipeline.quality_classifier(spark, docs, str(tmp_path)))
    assert got == want and 0 < sum(got.values()) < len(rows)
    by_text = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    assert all(abs(by_text[r[0]] - score(r[1])) < 1e-5 for r in rows if r[0] not in (None, 405))
    empty = labels.limit(0)
    assert {r.score for r in quality.classify(docs, empty).collect()} == {0.5}


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset([tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else []))


def test_near_duplicate_stage(spark, docs, rows):
    sets = [(i, shingles(t)) for i, t, _, _ in rows if i is not None]
    root = {i: i for i, _ in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if s and u and 100 * len(s & u) >= 80 * len(s | u):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    first = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or "")):
        first.setdefault(r[0], r)
    want = Counter(r for i, r in first.items() if find(i) == i) + Counter(dict.fromkeys([r for r in rows if r[0] is None], 1))
    assert counted(corpus_pipeline.near_duplicates(spark, docs, "")) == want


def test_near_duplicates_of_one_crowded_bucket(spark):
    """Hundreds of texts that share half of their shingles or more, most pairs just below the threshold: the last round must find all links."""
    rng = np.random.default_rng(8)
    base, texts = [f"w{k}" for k in range(160)], []
    for k in range(260):
        own = list(base)
        for at in rng.choice(160, 1 + k % 4, replace=False):
            own[at] = f"x{k}y{at}"
        texts.append(" ".join(own))
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    turns, neardup.TURNS = neardup.TURNS, 0  # the last round alone
    try:
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    finally:
        neardup.TURNS = turns
    assert got == {i: find(i) for i in range(len(sets))}
    assert got == {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}


def test_mix_stage(spark, docs, rows):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "source": pa.array([r[3] for r in rows], pa.string())}))
    taken = Counter()
    for doc_id, size, *_, n in con.execute(mixing.ORACLE).fetchall():
        taken[doc_id, size] += n
    got = Counter()
    for r in corpus_pipeline.source_mix(spark, docs, "").collect():
        size = len((r.text or "").encode().split())
        got[r.doc_id, size] += size
    assert +got == +taken
    with_copies = Counter()
    for r in mixing.mix(mixing.word_sizes(docs)).collect():
        with_copies[r.doc_id, r.source] += r.copies
    assert +with_copies == Counter((r.doc_id, r.source) for r in mixing.mixed_documents(docs).collect())


def test_sentencepiece_stage(spark, docs, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = Counter((r.doc_id, r.source, tuple(r.pieces), r.parity) for r in corpus_pipeline.sentencepiece(spark, docs, "").collect())
    assert got == Counter((i, s, tuple(sp.encode(t or "")), True) for i, t, _, s in rows)


def field(number, value):
    varint = lambda n: bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def model_file(path, pieces, kind, byte_fallback, normal, prefix, extra):
    """Write a model by hand: pieces (text, score, kind) and the settings that matter."""
    import sentencepiece

    charsmap = b""
    if normal:
        own = sentencepiece.SentencePieceNormalizer(rule_name=normal)
        spec = dict(sentencepiece_codec._fields(dict(sentencepiece_codec._fields(own.serialized_model_proto()))[3]))
        charsmap = spec[2]
    out = b"".join(field(1, field(1, p.encode()) + field(2, float(s)) + field(3, k)) for p, s, k in pieces)
    out += field(2, field(3, kind) + field(35, int(byte_fallback)))
    out += field(3, field(1, (normal or "identity").encode()) + field(2, charsmap) + field(3, int(prefix)) + field(4, int(extra)) + field(5, 1))
    path.write_bytes(out)
    return str(path)


def pieces_of(kind, byte_fallback):
    rng = np.random.default_rng(kind)
    out = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if byte_fallback:
        out += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    letters = list("▁abcdetins.é1")
    merged, known = [], list(letters)
    while len(merged) < 60:
        a, b = rng.choice(known, 2)
        if "▁" not in b and a + b not in known and len(a + b) < 6:
            merged.append(a + b)
            known.append(a + b)
    if kind == sentencepiece_codec.MERGES:
        out += [(p, -float(i), 1) for i, p in enumerate(merged)] + [(p, -1000.0 - i, 1) for i, p in enumerate(letters)]
    else:
        out += [(p, -float(rng.uniform(2, 12)), 1) for p in letters + merged]
    return out


TEXTS = ["abc dist 1", "  two  spaces and\ttab ", "", " ", "ＡＢＣ ﬁne é é", "x　y", "▁mark ▁▁ed", "日本 ab", "a", "endless" * 50, "​zero", "te st\n\nline", "tin " * 30]


@pytest.mark.parametrize("kind", [sentencepiece_codec.UNIGRAM, sentencepiece_codec.MERGES])
@pytest.mark.parametrize("byte_fallback", [True, False])
@pytest.mark.parametrize("normal", [None, "nmt_nfkc"])
@pytest.mark.parametrize(("prefix", "extra"), [(True, False), (True, True), (False, True)])
def test_models_written_by_hand(tmp_path, kind, byte_fallback, normal, prefix, extra):
    import sentencepiece

    path = model_file(tmp_path / "m.model", pieces_of(kind, byte_fallback), kind, byte_fallback, normal, prefix, extra)
    rng = np.random.default_rng(3)
    texts = TEXTS + ["".join(rng.choice(list("abcdetins. é1  "), 40)) for _ in range(60)]
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    raw, same = sentencepiece_codec.Codec(path)([t.encode() for t in texts])
    ids = [np.frombuffer(x, "<i4").tolist() for x in raw]
    want = sp.encode(texts)
    wrong = [t for t, a, b in zip(texts, ids, want) if a != b]
    assert not wrong
    assert all(same)


def test_parity_sees_a_difference_and_unknown_features_raise(tmp_path):
    pieces = pieces_of(sentencepiece_codec.UNIGRAM, True)
    for n, (normal, extra) in enumerate([(None, False), ("nmt_nfkc", True)]):
        path = model_file(tmp_path / f"m{n}.model", pieces, 1, True, normal, True, extra)
        codec = sentencepiece_codec.Codec(path)
        real = codec.tokenizer
        codec.tokenizer = SimpleNamespace(encode_batch_fast=lambda ts, **k: [SimpleNamespace(ids=e.ids[:-1] or [5]) for e in real.encode_batch_fast(ts, **k)])
        assert codec([b"abc dist", b"tin"])[1] == [False, False]
    odd = [("user", 0.0, 4), ("a▁b", -3.0, 1)]
    for n, extra in enumerate(odd):
        path = model_file(tmp_path / f"o{n}.model", [*pieces, extra], 1, True, None, True, False)
        with pytest.raises(ValueError):
            sentencepiece_codec.Codec(path)


def test_token_file_layout_and_selective_reads(spark, docs, tmp_path):
    import pyarrow.parquet as pq

    path = token_files.write_tokens(docs.unionByName(docs), public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/t")
    for f in (tmp_path / "t").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        assert meta.num_row_groups >= 1 and all(meta.row_group(g).total_byte_size <= 24 << 20 for g in range(meta.num_row_groups))
        for c in range(meta.num_columns):
            column = meta.row_group(0).column(c)
            assert column.has_offset_index and column.has_column_index and column.compression == "ZSTD"
            assert {"RLE_DICTIONARY", "PLAIN_DICTIONARY", "DELTA_BINARY_PACKED"} & set(column.encodings)
    some = token_files.read_tokens(spark, path).where("doc_id between 10 and 20").select("doc_id", "n_tokens")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,10)" in plan and "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan
    assert sorted(r.doc_id for r in some.collect()) == sorted([*range(10, 21)] * 2)
    empty = token_files.write_tokens(docs.limit(0), public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/e")
    assert token_files.read_digests(spark, empty).count() == 0


def test_another_tokenizer_raises():
    with pytest.raises(ValueError):
        token_files.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_words_are_those_of_split():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.choice(list(b"ab \t\n\x0b\x0c\r\x1c\xc3\xa9,"), rng.integers(0, 40)).astype(np.uint8)) for _ in range(300)] + [b"", b"x" * (words.SEGMENT + 5) + b" y", b"z"]
    raw, offsets = words.buffers(pa.array([*texts, None], pa.binary()))
    s, e, n = words.spans(raw, offsets)
    flat = [w for t in texts for w in t.split()]
    assert [bytes(raw[i:j]) for i, j in zip(s, e)] == flat and n.tolist() == [len(t.split()) for t in texts] + [0]
    h = words.hashes(raw, s, e).tolist()
    assert len(set(h)) == len(set(flat)) == len(set(zip(h, flat)))
    numbers = words.Numbers()
    got = np.concatenate([numbers.add(np.array(h[k : k + 50], np.uint64))[0] for k in range(0, len(h), 50)])
    assert len(numbers) == len(set(h)) and numbers.keys[got].tolist() == h
    many = np.random.default_rng(1).integers(0, 2**63, 200_000).astype(np.uint64)
    first, _ = numbers.add(many)
    assert np.array_equal(numbers.find(many), first) and np.array_equal(numbers.keys[first], many)


def test_mixture_of_network_and_counts():
    from kgspark.llm import lm

    words_, count = np.log(np.array([0.5, 1e-9, np.nan, 1e-3])), np.array([4, 0, 0, 1])
    got = lm.mixed_scores(words_, count, 10, -7.0, 0.25)
    want = [0.25 * 0.4 + 0.75 * 0.5, 0.75e-9, 0.75e-7, 0.25 * 0.1 + 0.75e-3]
    assert np.allclose(got, np.log10(want))
    assert np.isfinite(lm.mixed_scores(np.array([np.nan]), np.array([0]), 0, -1.0, 0.25)).all()

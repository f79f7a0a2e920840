"""SentencePiece models run by the tokenizers library.

The model's protobuf is parsed here; the normaliser, the metaspace marker, pieces, scores and byte fallback are
rebuilt as a tokenizers model: unigram models keep their scores, merge models get the merges that
their scores imply. A text is normalised, its white space collapsed if the model says so, and cut before each
run of spaces. Every distinct chunk that a worker meets is encoded in multithreaded
batches, held against the sentencepiece library and decoded again, once; where a model treats a chunk by itself
unlike the same chunk within a text, whole texts are held against the library instead. Models with features
that are not rebuilt raise an error.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import byte_rows, free_name, in_batches, in_pieces, release

MARK = "▁"
#: A byte that no UTF-8 text has.
NO_MARK = b"\xff"
# Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            value: object = varint()
        elif key & 7 == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        else:
            n = 4 if key & 7 == 5 else 8
            value, at = data[at : at + n], at + n
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    dummy_prefix: bool = True
    remove_extra: bool = True
    charsmap: bytes = b""
    escape_spaces: bool = True
    mark_last: bool = False

    def check(self) -> None:
        """Raise ValueError for what isn't rebuilt here."""
        if self.kind not in (UNIGRAM, MERGES):
            raise ValueError("only unigram and merge models are supported")
        if any(k in (USER_DEFINED, UNUSED) for k in self.kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        if not self.escape_spaces or self.mark_last:
            raise ValueError("spaces must be marked, before words")
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece of the model crosses words")

    @property
    def by_chunk(self) -> bool:
        """Whether the library can be asked for a chunk by itself: it puts the mark before it and changes nothing else."""
        return self.dummy_prefix and not self.charsmap


@cache
def parse(path: str) -> Model:
    m = Model()
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            m.pieces.append(own[1].decode())
            m.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
            m.kinds.append(own.get(3, 1))
        elif number == 2:
            own = dict(_fields(value))
            m.kind, m.byte_fallback, m.mark_last = own.get(3, UNIGRAM), bool(own.get(35, 0)), bool(own.get(24, 0))
        elif number == 3:
            own = dict(_fields(value))
            m.charsmap, m.dummy_prefix, m.remove_extra = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
            m.escape_spaces = bool(own.get(5, 1))
    return m


@cache
def backend(path: str):
    """The tokenizers model of the file; it expects text that is normalised, and marks its spaces."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    os.environ.setdefault("RAYON_NUM_THREADS", "2")
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    m = parse(path)
    unknown = m.kinds.index(UNKNOWN)
    if m.kind == UNIGRAM:
        model = models.Unigram(list(zip(m.pieces, m.scores)), unknown, m.byte_fallback)
    else:
        vocabulary = {p: i for i, p in enumerate(m.pieces)}
        merges = []
        for p, s, k in zip(m.pieces, m.scores, m.kinds):
            if k not in (UNKNOWN, CONTROL, BYTE):
                merges += [(-s, i, p) for i in range(1, len(p)) if p[:i] in vocabulary and p[i:] in vocabulary]
        merges.sort()
        model = models.BPE(vocabulary, [(p[:i], p[i:]) for _, i, p in merges], unk_token=m.pieces[unknown], fuse_unk=True, byte_fallback=m.byte_fallback)
    t = Tokenizer(model)
    t.pre_tokenizer = pre_tokenizers.Metaspace(MARK, prepend_scheme="never", split=False)
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return t


@cache
def normaliser(path: str):
    """Function of a text to its normal form, by the model's character map; None where there is no map."""
    from tokenizers import normalizers

    m = parse(path)
    return normalizers.Precompiled(m.charsmap).normalize_str if m.charsmap else None


_CHUNK = re.compile(" *[^ ]+| +")


def chunks(text: bytes, model: Model, normal=None) -> list[bytes]:
    """The normal form of the text, cut before each run of spaces; a chunk's first space is left out.

    No piece has a mark after another character (Model.check() makes sure), so no piece crosses a cut. A
    text that is empty when normalised has no chunks. A chunk that starts without a space begins with NO_MARK here.
    """
    if not text:
        return []
    if normal or model.remove_extra or not model.dummy_prefix or b"  " in text or MARK.encode() in text or text[:1] == b" " or text[-1:] == b" ":
        t = text.decode("utf-8", "replace")
        t = normal(t) if normal else t
        if model.remove_extra:
            t = re.sub(" +", " ", t).lstrip(" ")
        t = ((" " if model.dummy_prefix and t else "") + t).replace(MARK, " ")
        if model.remove_extra:  # at the end, marks that the text itself has go too
            t = t.rstrip(" ")
        return [c[1:].encode() if c[0] == " " else NO_MARK + c.encode() for c in _CHUNK.findall(t)]
    return text.split(b" ")


class Codec:
    """Ids of whole texts, each distinct chunk encoded, compared and decoded once; up to keep chunks are kept."""

    def __init__(self, path: str, keep: int = 250_000):
        import sentencepiece

        self.model, self.tokenizer, self.keep, self.normal = parse(path), backend(path), keep, normaliser(path)
        self.model.check()
        self.other = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(p[1:-1], 16)]) if k == BYTE else p.encode() for p, k in zip(self.model.pieces, self.model.kinds)]
        self.exact = self.model.byte_fallback
        self.known: dict[bytes, bytes] = {}
        self.bad: set[bytes] = set()

    def _learn(self, new: list[bytes]) -> None:
        for at in range(0, len(new), 8192):
            some = new[at : at + 8192]
            texts = [c[1:].decode("utf-8", "replace") if c[:1] == NO_MARK else " " + c.decode("utf-8", "replace") for c in some]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            wrong: set[bytes] = set()
            if self.model.by_chunk:
                asked = [k for k, t in enumerate(texts) if t[:1] == " " and t != " "]  # a space alone is no text to the library
                theirs = self.other.encode([texts[k][1:].replace(" ", MARK) for k in asked], num_threads=1)
                wrong = {some[k] for k, x in zip(asked, theirs) if x != ids[k]}
            if self.exact:
                wrong |= {c for c, i, t in zip(some, ids, texts) if b"".join([self.bytes[k] for k in i]) != t.replace(" ", MARK).encode()}
            self.bad |= wrong
            self.known.update(zip(some, [np.array(i, "<i4").tobytes() for i in ids]))

    def __call__(self, texts: list[bytes]) -> tuple[list[bytes], list[bool]]:
        """The ids of each text as little-endian int32, and whether they are the sentencepiece library's and decode to the text.

        Chunks that the library can't be asked for by themselves make their whole text be asked for.
        """
        if len(self.known) > self.keep:
            self.known.clear()
            self.bad.clear()
        cut = [chunks(t, self.model, self.normal) for t in texts]
        if new := [c for c in set().union(*cut) if c not in self.known]:
            self._learn(new)
        get = self.known.__getitem__
        out = [b"".join(map(get, c)) for c in cut]
        same = [not self.bad or self.bad.isdisjoint(c) for c in cut]
        whole = [k for k, c in enumerate(cut) if not self.model.by_chunk or b"" in c]
        if whole:
            theirs = self.other.encode([texts[k].decode("utf-8", "replace") for k in whole], num_threads=1)
            for k, x in zip(whole, theirs):
                same[k] = same[k] and np.array(x, "<i4").tobytes() == out[k]
        return out, same


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """Columns keep, and pieces (array<int>), n_pieces, ids_crc32, parity for each row's whole text.

    A null or empty text has no ids. parity: the ids are those that the sentencepiece library gives, and where the
    model can spell every byte, they decode to the normalised text.
    """
    text = free_name("text", keep)

    def run(batches):
        own = codec(path)
        for batch in batches:
            for b in in_pieces(batch, text, 2_000_000):
                raw, same = own(byte_rows(b.column(text)))
                n = np.array([len(x) // 4 for x in raw], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], lists, pa.array(n), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(same)], [*keep, "pieces", "n_pieces", "ids_crc32", "parity"])
        release()

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias(text))
    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return in_batches(rows, run, ", ".join([*fields, "pieces array<int>, n_pieces long, ids_crc32 long, parity boolean"]))


def decode(ids: list[list[int]], path: str) -> list[str]:
    """Texts of id lists; the space of the dummy prefix is taken off."""
    m = parse(path)
    out = backend(path).decode_batch(ids, skip_special_tokens=False)
    return [x[1:] if m.dummy_prefix and x[:1] == " " else x for x in out]


def encoded_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, parity; the ids themselves are in encode()."""
    return encode(docs.select(F.col("doc_id").cast("long"), "text"), path, ["doc_id"]).drop("pieces")

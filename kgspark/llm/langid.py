"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters'
vectors, each permuted by its place; a text's vector bundles (adds) its trigrams' vectors; a
language's prototype bundles those of its training texts. A text gets the language whose centred
prototype has the highest cosine with it.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import crc_mod, free_name, in_batches, release

#: Letters a-z have classes 1-26, all other letters share 27-63 by code point; 0 stands between words.
CLASSES, DIM, SEED = 64, 512, 7


@cache
def class_table() -> np.ndarray:
    """Class of each code point, case folded to a single character."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        if chr(cp).isalpha():
            c = ord(chr(cp).lower()[0])
            out[cp] = c - 96 if 97 <= c <= 122 else 27 + c % 37
    return out


@cache
def letter_vectors() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (CLASSES, DIM))


@cache
def trigram_vectors() -> np.ndarray:
    """Vector of each pair of a trigram's first two letters; the third is bound when needed."""
    v = letter_vectors()
    return (np.roll(v, 2, 1)[:, None] * np.roll(v, 1, 1)[None]).reshape(-1, DIM)


def bind(codes: np.ndarray) -> np.ndarray:
    return trigram_vectors()[codes // CLASSES] * letter_vectors()[codes % CLASSES]


def trigrams(text: str) -> np.ndarray:
    """Codes of all trigrams of the whole text; runs of other characters are one boundary."""
    x = class_table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    x = np.concatenate([[0], x, [0]]).astype(np.int32)
    x = x[np.concatenate([[True], (x[1:] > 0) | (x[:-1] > 0)])]
    return (x[:-2] * CLASSES + x[1:-1]) * CLASSES + x[2:] if len(x) > 2 else x[:0]


def trigram_counts(training: DataFrame) -> DataFrame:
    """lang, code, n over all rows: added up within each task first, so a language of any size is a few rows a task."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                if len(codes := trigrams(text)):
                    np.add.at(sums.setdefault(lang, np.zeros(CLASSES**3, np.int64)), *np.unique(codes, return_counts=True))
        release()
        for lang, n in sums.items():
            codes = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int32()), pa.array(n[codes])], ["lang", "code", "n"])

    return in_batches(training, count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def learn(training: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, the prototypes' mean taken off, from lang and text.

    All rows with a text and a lang count. What comes to the driver has at most 64^3 rows for each
    language, however many documents there are.
    """
    rows = training.where("lang is not null and text is not null").select("lang", "text")
    table = trigram_counts(rows).toPandas()
    langs = sorted(table["lang"].unique())
    protos = np.zeros((len(langs), DIM))
    for i, lang in enumerate(langs):
        own = table[table["lang"] == lang]
        codes, n = own["code"].to_numpy(), own["n"].to_numpy(np.float64)
        for k in range(0, len(codes), 16384):
            protos[i] += n[k : k + 16384] @ bind(codes[k : k + 16384])
    protos /= np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-12)
    if len(langs) > 1:
        protos -= protos.mean(0)
    return langs, protos / np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns keep (as they are), and the language and score, by the names given, of each row's whole text.

    score is the cosine, 0 if it is below 0. A null text, a text without a letter and any text
    while no language has been learned get 'und' and 0. Ties go to the language first in order.
    """
    langs, protos = model
    to, text_ = protos.T.astype(np.float32), free_name("text", [*keep, *names])

    def label(batches):
        for b in batches:
            found, scores = [], []
            for text in b.column(text_).to_pylist():
                codes, n = np.unique(trigrams(text or ""), return_counts=True)
                if not len(codes) or not langs:
                    found.append("und")
                    scores.append(0.0)
                    continue
                v = np.zeros(DIM, np.float32)
                for k in range(0, len(codes), 4096):
                    v += n[k : k + 4096].astype(np.float32) @ bind(codes[k : k + 4096])
                cos = v @ to / max(float(np.linalg.norm(v)), 1e-12)
                found.append(langs[best := int(np.argmax(cos))])
                scores.append(min(1.0, max(0.0, float(cos[best]))))
            own = [b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*keep, *names])
        release()

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias(text_))
    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return in_batches(rows, label, ", ".join([*fields, f"`{names[0]}` string", f"`{names[1]}` double"]))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    held = crc_mod(F.col("doc_id"), 3) == 1
    model = learn(docs.where(~held).select(F.col("lang").cast("string"), F.col("text").cast("string")))
    out = predict(docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text"), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")

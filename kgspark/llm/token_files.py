"""Token ids in Parquet list columns: chosen encoding, row groups and page indexes.

Documents are dealt out by ranges of doc_id and sorted, so part files follow each other in doc_id
order and each row knows its place: part, first (its first id's place within the part) and n_tokens.
Row groups are small and pages are indexed (Parquet writes column and offset indexes), so a range
of documents, or the metadata alone, is read without the rest.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.llm import words
from kgspark.llm.common import in_batches, in_pieces, shared_dir

SCHEMA = "doc_id long, part int, first long, n_tokens long, ids array<int>"
#: Parquet writer settings: row groups of 16 MB, pages of 64 kB, dictionary pages that fall back to delta encoding (writer v2).
LAYOUT = {"parquet.block.size": 16 << 20, "parquet.page.size": 64 << 10, "parquet.enable.dictionary": "true", "parquet.writer.version": "v2", "compression": "zstd"}


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# What the tokenizer's file must say for its words to be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
WORD_END = "</w>"

#: Classes of bytes: letters a to z, ASCII signs other than ' and <, the lead byte of the Latin letters below, newline, all else.
_BREAK, _LETTER, _SIGN, _LEAD, _ODD = 0, 1, 2, 3, 4
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[list(range(97, 123))], _CLASS[0xC3], _CLASS[10] = _LETTER, _LEAD, _BREAK
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<"]] = _SIGN
#: Second bytes of the lower-case letters from U+00DF to U+00FF, which NFC leaves alone.
_SECOND = np.zeros(256, bool)
_SECOND[0x9F:0xC0] = True
_SECOND[0xB7] = False


def _word_parts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lines: where each begins, its letters end and it ends itself, and whether it is anything but small letters and then signs."""
    kind = _CLASS[raw]
    lead = np.flatnonzero(kind == _LEAD)
    if len(lead):
        after = np.minimum(lead + 1, len(raw) - 1)
        ok = _SECOND[raw[after]] & (after > lead)
        kind[lead[ok]] = kind[after[ok]] = _LETTER
        kind[lead[~ok]] = _ODD
    bad = kind == _ODD
    bad[1:] |= (kind[1:] == _LETTER) & (kind[:-1] == _SIGN)
    ends = np.append(np.flatnonzero(kind == _BREAK), len(raw))
    begins = np.concatenate([[0], ends[:-1] + 1])
    odd = np.zeros(len(ends), bool)
    odd[np.searchsorted(ends, np.flatnonzero(bad))] = True
    signs = np.concatenate([[0], np.cumsum(kind == _SIGN, dtype=np.int64)])
    return begins, ends - (signs[ends] - signs[begins]), ends, odd


class WordEncoder:
    """Encodes whole texts word by word, each distinct word once.

    Only for a tokenizer of which no token spans white space, whose pre-tokenizer and normaliser
    see no further than the next white space, and which ends each pre-token with a mark, as
    word_bpe_49k.json does; the file is checked for that, and another raises. Then the ids of a text are the ids
    of its words in turn, and those of a word of letters and signs are the ids of the letters and of the signs. Words
    are cut at ASCII white space only; whatever other white space they hold is left to the tokenizer. Words and runs
    of letters or signs are numbers (see words.py) and their ids one array. New runs are
    encoded many at a time and cut at the end marks. The tests hold this against encoding
    whole texts. What is known is kept for the worker's later tasks, up to a fixed number of words.
    """

    def __init__(self, path: str, keep: int = 800_000):
        self.tokenizer, self.keep = tokenizer(path), keep
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        first = (own.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        if own.get("normalizer") != NORMALIZER or first != SPLIT or own["model"].get("end_of_word_suffix") != WORD_END:
            raise ValueError("the tokenizer's words can't be encoded one by one")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.forget()

    def forget(self) -> None:
        self.words, self.word_ids = words.Numbers(), words.Lists()
        self.runs, self.run_ids, self.run_places = words.Numbers(), words.Lists(), np.zeros(0, np.int64)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def _learn_runs(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        ids, sizes = [], []
        for at in range(0, len(s), 2000):
            size = e[at : at + 2000] - s[at : at + 2000]
            some = words.take_ragged(raw, s[at : at + 2000], size)
            gaps = np.cumsum(size)[:-1]
            got = self._encode(np.insert(some, gaps, 32).tobytes().decode())
            cuts = np.flatnonzero(self.ends[got]) + 1
            if len(cuts) == len(size):
                ids.append(got)
                sizes.append(np.diff(cuts, prepend=0))
            else:
                each = [self._encode(x.tobytes().decode()) for x in np.split(some, gaps)]
                ids += each
                sizes.append(np.array([len(x) for x in each], np.int64))
        if ids:
            self.run_ids.add(np.concatenate(ids), np.concatenate(sizes))

    def _numbered_runs(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The place in run_ids of each span."""
        number, new = self.runs.add(words.hashes(raw, s, e))
        self.run_places = np.concatenate([self.run_places, len(self.run_ids.size) + np.arange(len(new))])
        self._learn_runs(raw, s[new], e[new])
        return self.run_places[number]

    def _learn(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        """Learn the words of these spans, whose numbers follow those known."""
        size = e - s
        text = np.insert(words.take_ragged(raw, s, size), np.cumsum(size)[:-1], 10).tobytes().decode("utf-8", "replace")
        low = np.frombuffer(text.lower().encode(), np.uint8)
        begins, middle, ends, odd = _word_parts(low)
        both = np.full((len(s), 2), -1, np.int64)
        for side, (a, b) in enumerate(((begins, middle), (middle, ends))):
            some = np.flatnonzero(~odd & (b > a))
            both[some, side] = self._numbered_runs(low, a[some], b[some])
        strange = np.flatnonzero(odd)
        if len(strange):
            lines = text.split("\n")
            each = [self._encode(lines[k]) for k in strange]
            both[strange, 0] = len(self.run_ids.size) + np.arange(len(strange))
            self.run_ids.add(np.concatenate(each), np.array([len(x) for x in each], np.int64))
        sizes = np.where(both >= 0, self.run_ids.size[both], 0) if len(self.run_ids.size) else np.zeros_like(both)
        starts = np.where(both >= 0, self.run_ids.start[both], 0) if len(self.run_ids.size) else np.zeros_like(both)
        self.word_ids.add(words.take_ragged(self.run_ids.ids, starts.ravel(), sizes.ravel()), sizes.sum(1))

    def numbers(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of the rows, by which word_ids knows their ids, and how many words each row has.

        Numbers hold until forget() or room(), which makes room between batches.
        """
        s, e, n = words.spans(raw, offsets)
        at, new = self.words.add(words.hashes(raw, s, e))
        if len(new):
            self._learn(raw, s[new], e[new])
        return at, n

    def room(self) -> None:
        if len(self.words) > self.keep or len(self.runs) > self.keep:
            self.forget()

    def __call__(self, column: pa.Array, end: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a text column in a row, each row's followed by end, and the number of ids of each row."""
        self.room()
        at, n = self.numbers(*words.buffers(column))
        ids, size = self.word_ids.take(at)
        last = np.concatenate([[0], np.cumsum(size)])[np.cumsum(n)]
        total = np.diff(last, prepend=0)
        if end:
            ids = np.insert(ids, np.repeat(last, len(end)), np.tile(np.array(end, np.int32), len(n)))
        return ids, total + len(end)


@cache
def word_encoder(path: str, keep: int = 800_000) -> WordEncoder:
    return WordEncoder(path, keep)


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1) -> str:
    """Encode doc_id and text of docs to Parquet files below path; returns path.

    A null text is empty and becomes the end id alone; rows without a doc_id come first; rows of
    equal doc_id follow each other in the order of a hash of their texts, then of the texts, so that a number of any
    size is dealt over several tasks. Other columns are not read.
    """

    def encode(batches):
        part, first, known = TaskContext.get().partitionId(), 0, word_encoder(tokenizer_path)
        for batch in batches:
            for b in in_pieces(batch, "text"):
                ids, n = known(b.column("text"), (end_id,))
                at = np.concatenate([[0], np.cumsum(n)])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.full(len(n), part), pa.int32()), pa.array(first + at[:-1], pa.int64()), pa.array(n, pa.int64()), lists], ["doc_id", "part", "first", "n_tokens", "ids"])
                first += int(at[-1])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    in_batches(rows, encode, SCHEMA).write.options(**LAYOUT).parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; a filter on doc_id or a choice of columns reaches the row groups and pages."""
    return spark.read.schema(SCHEMA).parquet(path)


def token_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, base: the ids in all parts before it. One row for each part file; only metadata columns are read."""
    sums = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what the files hold."""

    def digest(batches):
        for b in batches:
            lists = b.column("ids")
            at, raw = lists.offsets.to_pylist(), memoryview(lists.values.to_numpy().astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "part", "first", "n_tokens")], pa.array(crc, pa.int64())], ["doc_id", "part", "first", "n_tokens", "ids_crc32"])

    rows = in_batches(read_tokens(spark, path), digest, "doc_id long, part int, first long, n_tokens long, ids_crc32 long")
    starts = token_starts(spark, path)
    return rows.join(starts, "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def token_file_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write all token ids to the shared folder and give back the digests of the files' rows."""
    spark = docs.sparkSession
    return read_digests(spark, write_tokens(docs, tokenizer_path, shared_dir(spark), end_id))

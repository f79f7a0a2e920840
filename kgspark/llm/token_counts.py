"""Token counts under a unigram model, by dynamic programming shared along a trie.

Distinct pre-tokens are put in a trie: in sorted order they are its paths, so a stack of states,
one for each character of the path, is the trie. The best score of a prefix, its number of tokens
and the pieces still open at it are computed once for all pre-tokens that share the prefix, and a
pre-token's count is stored at its end.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import byte_rows, in_batches, in_pieces
from kgspark.llm.sentencepiece_codec import BYTE, CONTROL, MARK, NO_MARK, UNKNOWN, chunks, normaliser, parse

#: What an unknown character costs beyond the worst piece, a fixed value of unigram models.
PENALTY = 10.0


class Counter:
    """Counts of the best segmentation by the sum of piece scores; an unknown character counts its UTF-8 bytes."""

    def __init__(self, path: str, keep: int = 300_000):
        self.model, self.keep, self.normal = parse(path), keep, normaliser(path)
        self.model.check()
        self.root: dict = {}
        scores = []
        for piece, score, kind in zip(self.model.pieces, self.model.scores, self.model.kinds):
            if kind not in (UNKNOWN, CONTROL, BYTE):
                node = self.root
                for c in piece:
                    node = node.setdefault(c, {})
                node[None] = score
                scores.append(score)
        self.unknown = min(scores) - PENALTY
        self.known: dict[bytes, int] = {}

    def count_sorted(self, words: list[str]) -> list[int]:
        """Token counts of words in sorted order: each shared prefix is computed once."""
        root, out = self.root, []
        states = [(0.0, 0, ())]
        last = ""
        for word in words:
            k, most = 0, min(len(word), len(last))
            while k < most and word[k] == last[k]:
                k += 1
            del states[k + 1 :]
            for at in range(k, len(word)):
                c = word[at]
                best, count, opened = states[at]
                top, n, still = None, 0, []
                for score, tokens, node in opened:
                    if (node := node.get(c)) is not None:
                        still.append((score, tokens, node))
                        if None in node and (top is None or score + node[None] > top):
                            top, n = score + node[None], tokens + 1
                node = root.get(c)
                if node is not None:
                    still.append((best, count, node))
                own = None if node is None else node.get(None)
                value, more = (best + self.unknown, len(c.encode("utf-8", "replace"))) if own is None else (best + own, 1)
                if top is None or value > top:
                    top, n = value, count + more
                states.append((top, n, still))
            out.append(states[len(word)][1])
            last = word
        return out

    def __call__(self, texts: list[bytes]) -> tuple[list[int], list[int]]:
        """Pre-tokens and tokens of each text."""
        if len(self.known) > self.keep:
            self.known.clear()
        cut = [chunks(t, self.model, self.normal) for t in texts]
        new = {c: c[1:].decode("utf-8", "replace").replace(" ", MARK) if c[:1] == NO_MARK else MARK + c.decode("utf-8", "replace").replace(" ", MARK) for c in set().union(*cut) if c not in self.known}
        order = sorted(new, key=new.__getitem__)
        self.known.update(zip(order, self.count_sorted([new[c] for c in order])))
        get = self.known.__getitem__
        return [len(c) for c in cut], [sum(map(get, c)) for c in cut]


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of each row's whole text; 0 and 0 for a null or empty text."""

    def run(batches):
        own = counter(path)
        for batch in batches:
            for b in in_pieces(batch, "text", 8_000_000):
                words, tokens = own(byte_rows(b.column("text")))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(words, np.int64)), pa.array(np.array(tokens, np.int64))], ["doc_id", "n_pretokens", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return in_batches(rows, run, "doc_id long, n_pretokens long, n_tokens long")

"""What the graph construction asks of models, and an answer that needs none."""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

RELATIONSHIPS = "array<struct<relation:string,target_name:string,target_type:string,target_description:string,relation_description:string>>"


RELATION_FIELDS = ("relation", "target_name", "target_type", "target_description", "relation_description")
WORDS = "array<struct<page:int,word:string,x0:double,x1:double,top:double,width:double,height:double>>"


class Rules:
    """Provider by rules: hashed letter trigrams, capitalised names, sentences that two names share.

    A model provider has the same methods and must be picklable.
    """

    size = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v, t = [0.0] * self.size, f" {t.lower()} "
            for i in range(len(t) - 2):
                v[zlib.crc32(t[i : i + 3].encode()) % self.size] += 1.0
            out.append(v)
        return out

    def mentions(self, text: str) -> list[dict[str, str]]:
        names = dict.fromkeys(re.findall(r"\b[A-Z]\w+(?: [A-Z]\w+)*", text))
        return [{"name": n, "type": "Thing", "description": text} for n in names]

    def same(self, a: str, b: str) -> bool:
        return sorted(a.lower().split()) == sorted(b.lower().split())

    def subgraph(self, text: str, name: str) -> list[dict[str, str]]:
        others = [m["name"] for m in self.mentions(text) if m["name"] != name]
        return [{"relation": "mentioned with", "target_name": n, "target_type": "Thing", "target_description": "", "relation_description": ""} for n in others]

    def attributes(self, text: str, name: str) -> list[dict[str, str]]:
        return [{"key": "mentions", "value": str(text.count(name))}] if name in text else []

    def contains(self, answer: str, context: str) -> int:
        return int(set(re.findall(r"\w+", answer.lower())) <= set(re.findall(r"\w+", context.lower())))

    def relation_similarity(self, a: str, b: str) -> float:
        x, y = (set(re.findall(r"\w+", t.lower())) for t in (a, b))
        return len(x & y) / len(x | y) if x | y else 0.0

    def faithful(self, output: str, context: str) -> tuple[float, str]:
        """Share of the output's words that the context has, and the words that it lacks."""
        said = [w for w in re.findall(r"\w+", output.lower()) if w not in {"central_entity", "name", "type", "attributes", "relationships", "key", "value", *RELATION_FIELDS}]
        known = set(re.findall(r"\w+", context.lower()))
        lacking = sorted({w for w in said if w not in known})
        return (1 - sum(w not in known for w in said) / len(said) if said else 1.0), ", ".join(lacking)

    def translate(self, text: str, source: str, target: str) -> str:
        return " ".join(text.split()).lower()

    def classify(self, entity: str, kinds: list[str]) -> str:
        """The first kind whose words the entity's text holds, else Other."""
        words = set(re.findall(r"\w+", entity.lower()))
        return next((k for k in kinds if set(re.findall(r"\w+", k.lower())) <= words), "Other")

    def pages(self, content: bytes) -> list[dict]:
        """Words of a page-per-form-feed, plain-text document, ten points a character and line."""
        out = []
        for p, page in enumerate(content.decode("utf-8", "replace").split("\f")):
            for y, line in enumerate(page.split("\n")):
                out += [{"page": p + 1, "word": m[0], "x0": 10.0 * m.start(), "x1": 10.0 * m.end(), "top": 10.0 * y, "width": 600.0, "height": 800.0} for m in re.finditer(r"\S+", line)]
        return out

    def read_area(self, image: bytes, box: list[float]) -> str:
        return image.decode("utf-8", "replace")


def attempt(f: Callable, *args, tries: int = 3, wait: float = 3.0, failed=None):
    """f(*args), tried again after waits that double; failed when no try succeeds."""
    for k in range(tries):
        try:
            return f(*args)
        except Exception:
            if k + 1 < tries:
                time.sleep(min(30.0, wait * 2**k))
    return failed


def embedding(provider):
    """Column function: a text's vector. Null counts as empty; a batch is one call, and its failure fails the task."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(provider.embed(texts.fillna("").tolist()))

    return run


def mentions(provider):
    """Column function: the entities a text names; none where the provider fails."""

    @F.pandas_udf("array<struct<name:string,type:string,description:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: attempt(provider.mentions, t, failed=[]))

    return run


def same_entity(provider):
    """Column function of two texts; false where the provider fails."""

    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([attempt(provider.same, x, y, failed=False) for x, y in zip(a.fillna(""), b.fillna(""))], dtype=bool)

    return run


def subgraph(provider):
    """Column function of a context and a name: the name's relationships; none where the provider fails."""

    @F.pandas_udf(RELATIONSHIPS)
    def run(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([attempt(provider.subgraph, t, n, failed=[]) for t, n in zip(texts.fillna(""), names.fillna(""))], dtype=object)

    return run


def contains_answer(provider):
    """Column function of an answer and a context: 1, 0, or null where the provider fails."""

    @F.pandas_udf("int")
    def run(answers: pd.Series, contexts: pd.Series) -> pd.Series:
        return pd.Series([attempt(provider.contains, a, c) for a, c in zip(answers.fillna(""), contexts.fillna(""))], dtype="Int32")

    return run


def _scored(kind: str, call: Callable, failed):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([attempt(call, x, y, failed=failed) for x, y in zip(a.fillna(""), b.fillna(""))])

    return run


def relation_similarity(provider):
    """Column function of two texts of relations: 0 to 1; 0 where the provider fails."""
    return _scored("double", provider.relation_similarity, 0.0)


def faithfulness(provider):
    """Column function of an output and its context: struct score, reason, passed at 0.7 and at 0.9; null where the provider fails."""

    @F.pandas_udf("score double, reason string")
    def run(outputs: pd.Series, contexts: pd.Series) -> pd.DataFrame:
        rows = [attempt(provider.faithful, x, y, failed=(None, None)) for x, y in zip(outputs.fillna(""), contexts.fillna(""))]
        return pd.DataFrame(rows, columns=["score", "reason"]).astype({"score": "float64"})

    return run


def translation(provider, source: str = "auto", target: str = "en", tries: int = 5, wait: float = 1.0, pause: float = 0.0):
    """Column function of a text: struct text, error. Tried again after waits that double, with a pause between calls."""

    def one(text: str) -> tuple[str | None, str | None]:
        for k in range(tries):
            try:
                out = provider.translate(text, source, target)
                time.sleep(pause)
                return out, None
            except Exception as e:
                if k + 1 < tries:
                    time.sleep(min(30.0, wait * 2**k))
                said = f"{type(e).__name__}: {e}"
        return None, said

    @F.pandas_udf("text string, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts.fillna("")], columns=["text", "error"], dtype=object)

    return run


def classification(provider, kinds: list[str]):
    """Column function of an entity's text: one of the kinds or Other; an empty text where the provider fails."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: attempt(provider.classify, t, kinds, failed=""))

    return run


def attributes(provider):
    """Column function of a context and a name: the name's attributes; none where the provider fails."""

    @F.pandas_udf("array<struct<key:string,value:string>>")
    def run(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([attempt(provider.attributes, t, n, failed=[]) for t, n in zip(texts.fillna(""), names.fillna(""))], dtype=object)

    return run


def page_words(provider):
    """Column function of a file's bytes: its words with their places; none where the provider fails."""

    @F.pandas_udf(WORDS)
    def run(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: attempt(provider.pages, c or b"", failed=[]))

    return run


def area_text(provider):
    """Column function of a page's image and a box: the text read there; empty where the provider fails."""

    @F.pandas_udf("string")
    def run(images: pd.Series, boxes: pd.Series) -> pd.Series:
        return pd.Series([attempt(provider.read_area, i or b"", list(b), failed="") for i, b in zip(images, boxes)], dtype=object)

    return run

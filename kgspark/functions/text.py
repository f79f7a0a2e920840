"""Sentences, labels and tags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"(?U)^\s+|\s+$"
# The signs that end a sentence before white space; they define the operator.
SENTENCE_END = r"(?U)((?<!\b[A-Za-z])\.|[!?。！？])\s+"
#: Stands at sentence ends while a text is cut.
CUT = "\u0001"


def falsy(c: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(c, F.lit(""))


def sentences(text: Column) -> Column:
    """Array of trimmed sentences; a single initial's full stop doesn't end one.

    The pattern begins with the sign, so it is tried at signs only. Marks in the text itself are doubled meanwhile.
    """
    own = F.replace(F.regexp_replace(text, SPACE, ""), F.lit(CUT), F.lit(CUT * 2))
    parts = F.split(F.regexp_replace(own, SENTENCE_END, f"$1 {CUT} "), f" {CUT} ")
    return F.filter(F.transform(parts, lambda x: F.replace(x, F.lit(CUT * 2), F.lit(CUT))), lambda x: x != "")


def type_label(c: Column) -> Column:
    """Underscores, hyphens and runs of spaces become one space; words with Latin letters are capitalised."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"[_\-]+", " "), r"\s+", " ")), " ")
    word = lambda x: F.when(x.rlike("[A-Za-z]"), F.concat(F.upper(F.substring(x, 1, 1)), F.lower(x.substr(F.lit(2), F.length(x))))).otherwise(x)
    return F.array_join(F.transform(words, word), " ")


def last_tag(c: Column) -> Column:
    """Text in the last brackets, or empty."""
    return F.coalesce(F.trim(F.try_element_at(F.regexp_extract_all(c, F.lit(r"\(([^()]*)\)"), 1), F.lit(-1))), F.lit(""))


def strip_quotes(c: Column) -> Column:
    """The trimmed text without one pair of quotes that match, and trimmed again."""
    trimmed = F.regexp_replace(c, SPACE, "")
    ends = F.concat(F.substring(trimmed, 1, 1), F.substring(trimmed, -1, 1))
    return F.when(ends.isin("''", '""', "“”"), F.regexp_replace(trimmed.substr(F.lit(2), F.length(trimmed) - 2), SPACE, "")).otherwise(trimmed)


def canonical_quotes(c: Column) -> Column:
    return F.replace(c, F.lit("'"), F.lit('"'))


def quotes_in_values(c: Column, kind: T.DataType) -> Column:
    """The column with quotes changed in every text value of its lists, structs and maps; keys and field names stay."""
    if isinstance(kind, T.StringType):
        return canonical_quotes(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: quotes_in_values(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: quotes_in_values(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[quotes_in_values(c[f.name], f.dataType).alias(f.name) for f in kind]))
    return c


def canonical(rows: DataFrame) -> DataFrame:
    """All columns with quotes changed in their text values."""
    return rows.select(*[quotes_in_values(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema])


def percent(c: Column) -> Column:
    return F.format_string("%.2f%%", c)


def percent_value(c: Column) -> Column:
    """The number of a text such as 80.00%; null where there is none."""
    return F.regexp_replace(c, "%$", "").try_cast("double")


def shortened(c: Column) -> Column:
    """A text of more than 20 characters as its first 10, its length and its last 10."""
    return F.when(F.length(c) <= 20, c).otherwise(F.concat(F.substring(c, 1, 10), F.length(c).cast("string"), c.substr(F.length(c) - 9, F.lit(10))))


def signature(key: Column, secret: Column, text: Column, salt: Column, time: Column) -> Column:
    """Hex sha256 by which a translation service knows a request."""
    return F.sha2(F.concat(key, shortened(text), salt, time, secret), 256)


def branch_path(branch: Column, edition: Column, version: Column) -> Column:
    return F.coalesce(falsy(branch), F.concat_ws("/", edition, falsy(version)))


def name_part(path: Column, place: int) -> Column:
    """The place-th part of a file name between underscores, from the end if negative; null where there is none."""
    return F.try_element_at(F.split(path, "_"), F.lit(place))


def base_name(path: Column) -> Column:
    """File name without folders and its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def relation_lines(relations: Column) -> Column:
    """Text of an array of relations (head, relation, tail, description); the word undefine counts as no description."""
    told = lambda r: F.nullif(F.coalesce(r["description"], F.lit("")), F.lit("undefine"))
    line = lambda r: F.regexp_replace(F.concat(r["head"], F.lit(" --"), r["relation"], F.lit("-> "), r["tail"], F.lit(" "), F.coalesce(told(r), F.lit(""))), SPACE, "")
    return F.coalesce(falsy(F.array_join(F.transform(relations, line), "\n")), F.lit("No relationships"))


#: Parts of an entity that its embedding reads, by what compares it: mentions, graph nodes, nodes of plain triples, reference graphs.
EMBEDDED = {"mentions": ["name", "type"], "nodes": ["name", "type"], "triples": ["name"], "reference": ["name", "type", "description"]}


def embedded_text(flavour: str) -> Column:
    """Text of an entity row for its embedding; nodes leave empty parts out, the others keep their spaces."""
    if flavour == "nodes":
        return entity_text(*map(F.col, EMBEDDED[flavour]))
    return F.array_join(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in EMBEDDED[flavour]]), " ")


def topic_content(sentences_: Column) -> Column:
    """Content of a topic from sentences that were extracted before: joined by blank lines, in back-ticks."""
    return F.concat(F.lit("```"), F.array_join(sentences_, "\n\n"), F.lit("```"))


def entity_text(*columns: Column) -> Column:
    """Non-empty parts joined by a space, as the embedding's input."""
    return F.concat_ws(" ", *[falsy(c) for c in columns])


def overlapping(c: Column, size: int, overlap: int) -> Column:
    """Array of pieces of size characters, each sharing overlap with the one before; none for an empty text."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(c) - overlap) / step).cast("int") - 1)
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: c.substr(i * step + 1, F.lit(size)))
    return F.when(c != "", pieces)

"""Type cleaning as column expressions: demotion, over-specific labels, parents. Lists and rules come from a profile."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from kgspark.functions import profiles
from kgspark.functions.profiles import PACKAGE, Profile
from kgspark.functions.text import SPACE, falsy


def found(c: Column, pattern: str) -> Column:
    """Whether the pattern is found, in any case, with word ends by Unicode."""
    return c.rlike(f"(?iU){pattern}")


def any_token(c: Column, tokens: list[str]) -> Column:
    """Whether the lower-cased text holds any of the tokens as a substring."""
    return reduce(or_, [F.contains(F.lower(c), F.lit(t.lower())) for t in tokens])


def fine_grained_signs(c: Column, profile: Profile = PACKAGE) -> dict[str, Column]:
    """The eight signs of an over-specific label. Tokens count as substrings: an i or v anywhere is a degree."""
    p, label = profiles, F.regexp_replace(c, SPACE, "")
    return {
        "long": F.size(F.split(label, r"(?U)\s+")) >= 4,
        "colour": any_token(label, p.COLOURS),
        "side": any_token(label, profile.sides),
        "degree": any_token(label, p.DEGREES) | found(label, p.ROMAN) | found(label, p.DEGREE),
        "place": any_token(label, p.PLACES),
        "time": any_token(label, p.TIMES),
        "sign": reduce(or_, [F.contains(label, F.lit(s)) for s in profile.signs]),
        "preposition": found(label, p.PREPOSITIONS),
    }


def fine_grained_score(c: Column, profile: Profile = PACKAGE) -> Column:
    return reduce(add, [s.cast("int") for s in fine_grained_signs(c, profile).values()])


def is_fine_grained(c: Column, profile: Profile = PACKAGE) -> Column:
    return fine_grained_score(c, profile) >= 2


def first_rule(c: Column, rules: list[tuple[str, str]], default: str = "Thing") -> Column:
    """Label of the first pattern that the text matches."""
    return F.coalesce(*[F.when(found(c, p), F.lit(label)) for p, label in rules], F.lit(default))


def suggest_parent(c: Column, profile: Profile = PACKAGE) -> Column:
    return first_rule(c, profile.parents)


def is_non_entity(c: Column, profile: Profile = PACKAGE) -> Column:
    """Whether a label names a figure or the like: by the profile's pattern, else by prefixes in this case."""
    if profile.non_entity:
        return found(c, profile.non_entity)
    return reduce(or_, [c.startswith(p) for p in profiles.NON_ENTITY_PREFIXES])


def semantic_type(c: Column) -> Column:
    """The semantic type of a parent label; null for any other label."""
    return F.coalesce(*[F.when(c == label, F.lit(to)) for label, to in profiles.SEMANTIC_TYPES.items()])


def best_rule(c: Column, rules: list[tuple[str, str, float]], default: str = "UNMAPPED") -> Column:
    """struct<score, label> of the highest-scored pattern that matches; the first of equals."""
    own = [F.when(found(c, p), F.struct(F.lit(s).alias("score"), F.lit(-i).alias("place"), F.lit(label).alias("label"))) for i, (p, label, s) in enumerate(rules)]
    best = F.array_max(F.array(*own))
    return F.struct(F.coalesce(best["score"], F.lit(0.0)).alias("score"), F.coalesce(best["label"], F.lit(default)).alias("label"))


def mapped_type(name: Column, kind: Column, description: Column) -> Column:
    """struct<score, label> of an entity: by its name, else by the best rule for its whole text, else a target label keeps itself."""
    pair = lambda score, label: F.struct(F.lit(score).alias("score"), label.alias("label"))
    named = F.coalesce(*[F.when(name == n, pair(score, F.lit(label))) for n, (label, score) in profiles.NAMED_TYPES.items()])
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (name, kind, description)])
    ruled = best_rule(text, [("|".join(words), label, score) for words, label, score in profiles.SCORED_RULES])
    own = F.when(kind.isin(profiles.TARGET_TYPES), pair(0.7, kind)).otherwise(ruled)
    return F.coalesce(named, F.when(ruled["score"] > 0, ruled).when(kind.isin(profiles.UNMAPPED_TYPES), ruled).otherwise(own))


def cleaned_type(c: Column, label: Column, profile: Profile = PACKAGE) -> dict[str, Column]:
    """Columns of the first cleaning step from a type c and its normalised label; nothing is set where c is empty."""
    kind = F.when(falsy(c).isNotNull(), label).otherwise(c)
    gone = F.coalesce(is_non_entity(kind, profile) & (kind != ""), F.lit(False))
    return {"type_original": falsy(c), "type": F.when(gone, F.lit("Thing")).otherwise(kind), "subTypeLabel": F.when(gone, kind), "demoted_reason": F.when(gone, F.lit("non_entity_like_type"))}

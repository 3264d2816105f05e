"""Similarity measures and scores."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodestone.functions.text import given, has_parenthetical

#: Weights of the rerank score (fixed values).
RERANK = {"exact": 0.35, "overlap": 0.20, "preferred_overlap": 0.15, "parenthetical": 0.10, "sequence": 0.05, "is_preferred": 0.03}


def word_set(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(given(x)), r"(?U)\s+"), lambda w: w != ""))


def set_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def token_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(word_set(a), word_set(b))


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def plain_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same without the shortcut for frequent characters."""
    return pd.Series([SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def passage_gate(a: Column, b: Column) -> Column:
    """What can be said without comparing: 1 if equal but for case, 0 if lengths differ too much, short / long if one
    holds the other; else null."""
    x, y = F.lower(given(a)), F.lower(given(b))
    short, long = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    return (F.when(x == y, 1.0).when((long == 0) | (short / long < 0.82), 0.0)
            .when(x.contains(y) | y.contains(x), short / long))


def passage_threshold(x: Column) -> Column:
    return F.when(F.length(x) >= 80, 0.94).otherwise(0.88)


def abbreviation_threshold(key: Column) -> Column:
    return F.when(F.length(key) <= 4, 1.0).when(F.length(key) <= 7, 0.95).otherwise(0.90)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """A vector of length 1; zeros stay."""
    n = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))


def rerank(cosine: Column, query: Column, name: Column, preferred: Column, is_preferred: Column, sequence: Column) -> Column:
    """Score of a candidate name: its embedding, equality, shared words, parentheses, spelling and kind."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    w = RERANK
    return (cosine - 1 + w["exact"] * flag(F.lower(given(query)) == F.lower(given(name))) + w["overlap"] * token_jaccard(query, name)
            + w["preferred_overlap"] * token_jaccard(query, preferred) + w["parenthetical"] * flag(has_parenthetical(query, name))
            + w["sequence"] * sequence + w["is_preferred"] * flag(is_preferred))

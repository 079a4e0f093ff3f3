"""Normalising, tokenising and comparing short texts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as text libraries know it: Unicode's, and the four separators among control characters.
_BLANK = r"[\s\x1c-\x1f]"


def without_mentions(text: Column) -> Column:
    """Lower case, each @ and what follows it up to white space taken out, inside words too."""
    return F.regexp_replace(F.lower(text), r"(?U)@[^\s\x1c-\x1f]*", "")


def normalise(text: Column) -> Column:
    """Lower case, no mentions, runs of white space as one blank, none at the ends. Null stays null."""
    return F.trim(F.regexp_replace(without_mentions(text), rf"(?U){_BLANK}+", " "))


def tokens(text: Column) -> Column:
    """Sorted distinct tokens of a text without mentions: runs of letters, marks, digits and underscores, and every other
    visible character by itself. Stays in the JVM; differs from word_tokens in words such as don't and 3.14."""
    found = F.regexp_extract_all(without_mentions(text), F.lit(r"(?U)([\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_])"), F.lit(0))
    return F.sort_array(F.array_distinct(found))


def word_tokens(text: Column) -> Column:
    """Sorted distinct tokens at Unicode's default word boundaries, by the regex library in Arrow batches."""
    import regex

    # Where words are cut (a boundary, the blanks after it, one apostrophe).
    cut = regex.compile(r"\b\p{Word_Break=WSegSpace}*'?", flags=regex.WORD | regex.UNICODE | regex.V1)

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        def one(t):
            # A token that holds white space falls apart where token sets are read from their joined form.
            return None if t is None else sorted({w for part in cut.split(t) if part for w in part.split()})

        return texts.map(one)

    return split(without_mentions(text))


def jaccard(a: Column, b: Column) -> Column:
    """Shared by all tokens of two sets; two empty sets: null."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


jaccard.least_jaccard = lambda threshold: threshold  #: so that it is not tried on all pairs where it is given as one's own


def jaccard_of_size(least: int) -> Callable[[Column, Column], Column]:
    """Jaccard that is 0 if either set has fewer than ``least`` tokens; without a bound for 0 or less."""
    if least <= 0:
        return jaccard
    return lambda a, b: F.when((F.size(a) < least) | (F.size(b) < least), F.lit(0.0)).otherwise(jaccard(a, b))

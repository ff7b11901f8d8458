"""Token sets and Jaccard similarity as built-in array expressions (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the token separator. Any run of characters that are neither letters nor digits (Unicode
# classes, so accented words stay whole; Java's \W is ASCII-only).
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: str | Column) -> Column:
    """Lower-cased distinct word set of a text; null or empty text gives an empty array."""
    words = F.split(F.lower(F.coalesce(_col(text), F.lit(""))), TOKEN_SPLIT)
    return F.array_distinct(F.filter(words, lambda w: w != F.lit("")))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """``|A ∩ B| / |A ∪ B|`` of two distinct-element arrays; 0.0 when either side is empty or null."""
    a, b = _col(a), _col(b)
    inter = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(
        a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(b) > 0), inter.cast("double") / union
    ).otherwise(F.lit(0.0))


def jaccard_from_sizes(inter: str | Column, size_a: str | Column, size_b: str | Column) -> Column:
    """Jaccard from an intersection count and the two set sizes: ``i / (|A| + |B| - i)``."""
    i, sa, sb = _col(inter), _col(size_a), _col(size_b)
    return F.when((sa > 0) & (sb > 0), i.cast("double") / (sa + sb - i)).otherwise(F.lit(0.0))


def pooled_jaccard(input_set: str | Column, set_list: str | Column) -> Column:
    """``Σ|A ∩ Sᵢ| / Σ|A ∪ Sᵢ|`` of one set against a list of sets; 0.0 if either side is empty."""
    a, sets = _col(input_set), _col(set_list)
    inter = F.aggregate(sets, F.lit(0), lambda acc, s: acc + F.size(F.array_intersect(a, s)))
    union = F.aggregate(sets, F.lit(0), lambda acc, s: acc + F.size(F.array_union(a, s)))
    return F.when(
        a.isNotNull() & sets.isNotNull() & (F.size(a) > 0) & (F.size(sets) > 0) & (union > 0),
        inter.cast("double") / union,
    ).otherwise(F.lit(0.0))

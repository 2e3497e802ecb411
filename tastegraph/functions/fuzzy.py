"""Token similarity ratios from 0 to 100, as Column expressions.

``ratio(a, b) = 100 * 2 * LCS(a, b) / (|a| + |b|)``. The longest common subsequence is found bit-parallel in Arrow batches (``ratio``), or row by row in
nested folds without Python (``native_ratio``): on titles of some twenty characters the former takes microseconds a pair, the latter some hundred.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings (as wide as the second: put the shorter there)."""
    chars = lambda s: F.filter(F.split(s, ""), lambda x: x != "")
    other = chars(b)

    def row(before: Column, x: Column) -> Column:
        # value at j: the best of the row before, of the cell to the left, and of the diagonal plus one where characters agree
        step = lambda acc, y_i: F.struct(
            F.array_append(acc["cells"], F.greatest(F.element_at(acc["cells"], -1), F.get(before, y_i["i"] + 1), F.when(y_i["y"] == x, F.get(before, y_i["i"]) + 1).otherwise(F.lit(0)))).alias("cells")
        )
        return F.aggregate(F.transform(other, lambda y, i: F.struct(y.alias("y"), i.alias("i"))), F.struct(F.array(F.lit(0)).alias("cells")), step)["cells"]

    last = F.aggregate(chars(a), F.array_repeat(F.lit(0), F.size(other) + 1), row)
    return F.element_at(last, -1)


def native_ratio(a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs(a, b) / total)


@lru_cache(maxsize=4096)
def _places(s: str) -> dict[str, int]:
    """For each character the bits of the places where it stands."""
    out: dict[str, int] = {}
    for i, c in enumerate(s):
        out[c] = out.get(c, 0) | 1 << i
    return out


def lcs_length(a: str, b: str) -> int:
    """A row of the table of prefixes is one integer: a zero bit where the row steps up."""
    places, full = _places(a), (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: Column, b: Column) -> Column:
    """Null where either is null, so that pairs which needn't be compared cost next to nothing."""

    def compare(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        return 200.0 * lcs_length(x, y) / (len(x) + len(y)) if x or y else 100.0

    @F.pandas_udf("double")
    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([compare(x, y) for x, y in zip(left, right, strict=True)], dtype="float64")

    return of(a, b)


def bound(a: Column, b: Column) -> Column:
    """What ratio can be at most, by length."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * F.least(F.length(a), F.length(b)) / total)


def _tokens(s: Column) -> Column:
    return F.filter(F.split(s, " "), lambda x: x != "")


def sorted_tokens(s: Column) -> Column:
    return F.array_join(F.array_sort(_tokens(s)), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(sorted_tokens(a), sorted_tokens(b))


def token_set_ratio(a: Column, b: Column) -> Column:
    """100 if one's tokens are all in the other; else the best ratio among shared tokens alone and with each rest. Null where either is null."""
    x, y = F.array_distinct(_tokens(a)), F.array_distinct(_tokens(b))
    shared, left, right = F.array_sort(F.array_intersect(x, y)), F.array_sort(F.array_except(x, y)), F.array_sort(F.array_except(y, x))
    text = lambda *parts: F.array_join(F.concat(*parts), " ")
    some, whole = F.size(shared) > 0, (F.size(left) == 0) | (F.size(right) == 0)
    both = ratio(F.when(~(some & whole), text(shared, left)), text(shared, right))
    common = F.length(text(shared))  # the shared tokens begin the longer text, so they are the longest common subsequence
    one = lambda rest: F.when(some, F.lit(200.0) * common / (common + F.length(text(shared, rest)))).otherwise(F.lit(0.0))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).when(some & whole, F.lit(100.0)).otherwise(F.greatest(both, one(left), one(right)))

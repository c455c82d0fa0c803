"""Token overlap, classification metrics and edit distance."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _scores(both: Column, predicted: Column, actual: Column) -> dict[str, Column]:
    precision, recall = _ratio(both, predicted), _ratio(both, actual)
    return {"precision": precision, "recall": recall, "f1": _ratio(2.0 * precision * recall, precision + recall)}


def token_overlap(predicted: Column, actual: Column) -> dict[str, Column]:
    """precision, recall, f1 of the sets of two token arrays; 0 over 0 is 0."""
    return _scores(F.size(F.array_intersect(predicted, actual)), F.size(F.array_distinct(predicted)), F.size(F.array_distinct(actual)))


def token_overlap_counted(rows: DataFrame, key: str, predicted: str, actual: str) -> DataFrame:
    """(key, precision, recall, f1) where a token counts as often as it occurs."""
    one = lambda c, side: rows.select(key, F.explode(c).alias("token"), F.lit(side).alias("side"))
    counts = one(predicted, 1).unionByName(one(actual, 0)).groupBy(key, "token").agg(F.sum("side").alias("p"), F.sum(1 - F.col("side")).alias("a"))
    sums = counts.groupBy(key).agg(F.sum(F.least("p", "a")).alias("both"), F.sum("p").alias("p"), F.sum("a").alias("a"))
    filled = rows.select(key).join(sums, key, "left").fillna(0, ["both", "p", "a"])
    return filled.select(key, *[c.alias(n) for n, c in _scores(F.col("both"), F.col("p"), F.col("a")).items()])


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared tokens over all tokens; null if there are none."""
    whole = F.size(F.array_union(a, b))
    return F.when(whole > 0, F.size(F.array_intersect(a, b)) / whole)


def classification(rows: DataFrame, actual: str, predicted: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Weighted accuracy, precision, recall and f1 of 0/1 columns, by group."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    a, p = F.col(actual) > 0, F.col(predicted) > 0
    part = lambda where: F.coalesce(F.sum(F.when(where, w)), F.lit(0.0))
    sums = rows.groupBy(*by).agg(part(a & p).alias("tp"), part(~a & p).alias("fp"), part(a & ~p).alias("fn"), part(a == p).alias("right"), part(F.lit(True)).alias("all"))
    scores = _scores(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"))
    return sums.select(*by, _ratio(F.col("right"), F.col("all")).alias("accuracy"), *[c.alias(n) for n, c in scores.items()])


def osa(a: Sequence, b: Sequence) -> int:
    """Edit distance with swaps of neighbours, each place edited at most once."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
    return row[-1]


@F.pandas_udf(T.IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """``osa`` of two strings or two arrays; null if either is."""
    return pd.Series([None if x is None or y is None else osa(list(x), list(y)) for x, y in zip(a, b)], dtype="Int32")

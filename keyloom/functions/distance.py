"""Edit distances and whole-text edits that Spark lacks, as Arrow-batched functions over distinct pairs."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def osa(a: str, b: str) -> int:
    """Optimal string alignment: insertions, deletions, substitutions and exchanges of neighbours, one each."""
    before, last, row = [], [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, last, row = last, row, [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, before[j - 2] + 1)
            row.append(best)
    return row[-1]


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def _pairs(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype="Int32")

    return F.pandas_udf(run, T.IntegerType())


def osa_distance(a, b):
    return _pairs(osa)(a, b)


def lcs_length(a, b):
    return _pairs(lcs)(a, b)


def _edit(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    rows = []
    for x, y in zip(a, b):
        if x is None or y is None:
            rows.append((None, None, None))
            continue
        lead = len(os.path.commonprefix((x, y)))
        tail = len(os.path.commonprefix((x[lead:][::-1], y[lead:][::-1])))
        rows.append((tail, len(x) - lead - tail, y[lead : len(y) - tail]))
    return pd.DataFrame(rows, columns=["move_left", "backspaces", "insert"]).astype({"move_left": "Int64", "backspaces": "Int64", "insert": object})


def whole_text_edit(a, b):
    """X.common_affix_edit in time by the texts' lengths; nulls if either is null."""
    kind = "struct<move_left:long,backspaces:long,insert:string>"
    return F.pandas_udf(_edit, kind)(a, b)

"""Similarity of texts and vectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is zero."""
    x, y = F.transform(a, lambda v: v.cast("double")), F.transform(b, lambda v: v.cast("double"))
    total = lambda z: F.aggregate(z, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    norm = F.sqrt(total(F.transform(x, lambda v: v * v))) * F.sqrt(total(F.transform(y, lambda v: v * v)))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot / norm).otherwise(0.0)


def shared_run(a: str | None, b: str | None) -> int:
    """The length of the longest common substring, by a suffix automaton of the shorter text: linear in both."""
    a, b = sorted((a or "", b or ""), key=len)
    step, link, size, last = [{}], [-1], [0], 0
    for ch in a:
        cur = len(size)
        step.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and ch not in step[p]:
            step[p][ch] = cur
            p = link[p]
        if p >= 0:
            q = step[p][ch]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                twin = len(size)
                step.append(dict(step[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(ch) == q:
                    step[p][ch] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    best = at = n = 0
    for ch in b:
        while at and ch not in step[at]:
            at = link[at]
            n = size[at]
        if ch in step[at]:
            at, n = step[at][ch], n + 1
            best = max(best, n)
        else:
            n = 0
    return best


def shared_text(a: str, b: str) -> str:
    """The first longest common substring in a's order of ends."""
    n = shared_run(a, b)
    return next((a[i : i + n] for i in range(len(a) - n + 1) if a[i : i + n] in b), "") if n else ""


@F.pandas_udf(IntegerType())
def shared_run_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """F18, on candidate pairs only."""
    return pd.Series([shared_run(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(ArrayType(IntegerType()))
def choice_runs(stem: pd.Series, choices: pd.Series) -> pd.Series:
    """For each choice the run it shares with the stem, then the run that all choices share in turn."""
    out = []
    for s, cs in zip(stem, choices, strict=True):
        cs = [c or "" for c in cs] if cs is not None else []
        common = cs[0] if cs else ""
        for c in cs[1:]:
            common = shared_text(common, c)
        out.append([*[shared_run(s, c) for c in cs], len(common)])
    return pd.Series(out)

"""Comparing spoken with written words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = "ok boolean, error string, diff array<struct<op:string,expected:string,heard:string>>"

Step = tuple[str, str | None, str | None]


def align(expected: list[str], heard: list[str]) -> list[Step]:
    """Edit steps along a longest common subsequence; neighbouring deletions and insertions pair up.

    One integer holds a row of the table of subsequence lengths, a bit a place: zero where the length grows.
    So the table of two texts of 20,000 words takes 50 MB.
    """
    places: dict[str, int] = {}
    for j, b in enumerate(heard):
        places[b] = places.get(b, 0) | 1 << j
    full = (1 << len(heard)) - 1
    rows = [full]
    for a in expected:
        same = rows[-1] & places.get(a, 0)
        rows.append((rows[-1] + same | rows[-1] - same) & full)
    length = lambda i, j: j - (rows[i] & (1 << j) - 1).bit_count()
    steps: list[Step] = []
    i, j = len(expected), len(heard)
    while i or j:
        if i and j and expected[i - 1] == heard[j - 1]:
            i, j = i - 1, j - 1
            steps.append(("equal", expected[i], heard[j]))
        elif j and (not i or length(i, j - 1) >= length(i - 1, j)):
            j -= 1
            steps.append(("insert", None, heard[j]))
        else:
            i -= 1
            steps.append(("delete", expected[i], None))
    out: list[Step] = []
    for step in reversed(steps):
        if out and {out[-1][0], step[0]} == {"delete", "insert"}:
            last = out.pop()
            out.append(("replace", last[1] or step[1], last[2] or step[2]))
        else:
            out.append(step)
    return out


def compare(expected: list[str] | None, heard: list[str] | None) -> dict:
    """ok, error and steps of one pair; two sides without words are the error `empty`."""
    a, b = list(expected) if expected is not None else [], list(heard) if heard is not None else []
    if not a and not b:
        return {"ok": False, "error": "empty", "diff": None}
    return {"ok": True, "error": None, "diff": [dict(zip(("op", "expected", "heard"), s, strict=True)) for s in align(a, b)]}


def token_diff(expected: Column, heard: Column) -> Column:
    """Struct of ok, error and diff, the steps between two arrays of tokens; a side a step lacks is null, a null array is empty."""

    @F.pandas_udf(STEPS)
    def diff(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([compare(x, y) for x, y in zip(a, b, strict=True)], columns=["ok", "error", "diff"])

    return diff(expected, heard)

"""Fuzzy subsequence score of a name against a query: best affine-gap alignment in which every query character is found in order."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MATCH, BOUNDARY, GAP_OPEN, GAP_EXTEND = 16, 8, 3, 1
_NONE = -(10**9)


def _plain(s: str) -> str:
    """Lower-cased, without accents."""
    return s.lower() if s.isascii() else "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))


def _subsequence(atom: str, name: str) -> bool:
    rest = iter(name)
    return all(c in rest for c in atom)


def align(atom: str, name: str) -> int:
    """Score of the best alignment of all of ``atom`` in order within ``name``; below 0 if there is none."""
    last: list[int] | None = None
    for i, q in enumerate(atom):
        row, best, carried = [_NONE] * len(name), _NONE, _NONE
        for j, c in enumerate(name):
            if i == 0:
                before = 0
            else:
                # adjacent to the last match, or after a gap of any length
                if j > 1:
                    best = max(best - GAP_EXTEND, last[j - 2] - GAP_OPEN)
                before = max(last[j - 1] if j else _NONE, best)
            if c == q and before > _NONE // 2:
                edge = j == 0 or not name[j - 1].isalnum()
                row[j] = before + MATCH + (BOUNDARY if edge else 0)
        last = row
        if max(last, default=_NONE) <= _NONE // 2:
            return -1
    return max(last) if last else 0


def score(query: str, name: str) -> int:
    """Sum of the atoms' scores; every white-space separated atom must match, against the name or its separators as spaces."""
    name = _plain(name)
    total = 0
    for atom in _plain(query).split():
        if not _subsequence(atom, name):
            return -1
        total += align(atom, name)
    return total


def may_match(name: Column, query: str) -> Column:
    """False for names that cannot hold the query's characters in order; what is not ASCII is left to the score."""
    apart = lambda atom: "(?s)" + ".*".join("\\Q" + c + "\\E" if c != "\\" else r"\\" for c in atom)
    low = F.lower(name)
    held = reduce(and_, (low.rlike(apart(a)) for a in _plain(query).split()), F.lit(True))
    return held | ~name.rlike(r"\A\p{ASCII}*\z")


def fuzzy_score(query: str):
    @F.pandas_udf(T.IntegerType())
    def scores(names: pd.Series) -> pd.Series:
        return names.map(lambda n: -1 if n is None else score(query, n)).astype("int32")

    return scores

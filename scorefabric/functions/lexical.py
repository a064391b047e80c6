"""Moving type-token ratio in Arrow batches: linear in the text, where the expression form looks at every window's words."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_TOKEN = re.compile("[a-z0-9']+")


def moving_ttr(toks: list[str], window: int = 50) -> float:
    """The mean over windows of distinct tokens / window. A token counts in the windows that hold it but not its last occurrence before."""
    n = len(toks)
    if n <= window:
        return len(set(toks)) / n if n else 0.0
    known: dict[str, int] = {}
    code = np.fromiter((known.setdefault(t, len(known)) for t in toks), np.int64, n)
    order = np.argsort(code, kind="stable")
    before = np.full(n, -1)
    same = code[order[1:]] == code[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    at = np.arange(n)
    first = np.maximum(np.maximum(at - window + 1, 0), before + 1)
    last = np.minimum(at, n - window)
    return float(np.maximum(last - first + 1, 0).sum() / (window * (n - window + 1)))


def mattr_of(text, window: int = 50):
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([moving_ttr(_TOKEN.findall((t or "").lower()), window) for t in texts])

    return run(text)

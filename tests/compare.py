"""Comparison of result sets."""

import pandas as pd


def _plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if x is None or x is pd.NA:
        return "~"
    if isinstance(x, float):
        return "~" if x != x else repr(x)
    return str(x)


def same_rows(a, b) -> bool:
    """Whether two pandas frames hold the same rows, whatever their order."""
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    rows = lambda d: sorted(tuple(_plain(x) for x in r) for r in d[columns].itertuples(index=False))
    return rows(a) == rows(b)

"""Comparing results."""

import numbers

import pandas as pd


def same(ours, theirs) -> None:
    """Equal columns and rows, in any order; numbers to six places."""

    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "null"
        if isinstance(v, numbers.Real) and not isinstance(v, bool) and abs(v) < 2**53:
            return repr(round(float(v), 6))
        return str(v)

    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    rows = lambda t: sorted(tuple(map(plain, r)) for r in t[columns].itertuples(index=False))
    assert rows(ours) == rows(theirs)

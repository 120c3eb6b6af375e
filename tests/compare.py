"""Rows of Spark and DuckDB in one comparable form."""

import math

import pandas as pd


def cell(x):
    if isinstance(x, (list, tuple)) or (hasattr(x, "tolist") and hasattr(x, "__len__")):
        return [cell(y) for y in x]
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return round(float(x), 9)
    return x


def rows(frame: pd.DataFrame) -> list[str]:
    columns = sorted(frame.columns)
    return sorted(repr([cell(x) for x in r]) for r in frame[columns].itertuples(index=False))

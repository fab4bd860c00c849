import math

import pandas as pd


def norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def table(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(norm(x) for x in rec) for rec in pdf[cols].itertuples(index=False)]
    return cols, sorted(rows, key=repr)

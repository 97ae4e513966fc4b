"""Order-insensitive comparison of a Spark result with a DuckDB result."""
import math

import pandas as pd


def _norm(v, digits):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, digits)
    return v


def canonical(pdf: pd.DataFrame, digits: int = 6):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x, digits) for x in r) for r in pdf[cols].itertuples(index=False)]
    key = lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t)
    return cols, sorted(rows, key=key)


def assert_same(spark_pdf: pd.DataFrame, sql_pdf: pd.DataFrame, digits: int = 6):
    sc, sr = canonical(spark_pdf, digits)
    dc, dr = canonical(sql_pdf, digits)
    assert sc == dc, f"columns differ: {sc} vs {dc}"
    assert len(sr) == len(dr), f"row counts differ: {len(sr)} vs {len(dr)}"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    assert not bad, f"{len(bad)} rows differ, first: {bad[0]}"

"""Small builders for the oracle SQL text (string assembly only)."""

from __future__ import annotations


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def long_sql(view: str, columns, keep=(), cast: str | None = "DOUBLE", var: str = "variable", val: str = "value") -> str:
    """``(keep..., variable, value)`` rows, one per input row and listed column."""
    parts = []
    for c in columns:
        v = f"CAST({c} AS {cast})" if cast else c
        k = "".join(f"{x}, " for x in keep)
        parts.append(f"SELECT {k}{lit(c)} AS {var}, {v} AS {val} FROM {view}")
    return "\nUNION ALL ".join(parts)


def mode_sql(source: str, group_cols, value: str = "value", out: str = "mode") -> str:
    """Most frequent value per group, smallest value on ties."""
    g = ", ".join(group_cols)
    part = f"PARTITION BY {g} " if group_cols else ""
    sel = f"{g}, " if group_cols else ""
    return (f"SELECT {sel}{value} AS {out} FROM (SELECT {sel}{value}, ROW_NUMBER() OVER ({part}ORDER BY COUNT(*) DESC, {value}) AS rn "
            f"FROM {source} GROUP BY {sel}{value}) WHERE rn = 1")


def case_map(col: str, mapping: dict, default=None) -> str:
    whens = " ".join(f"WHEN {col} = {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    tail = f" ELSE {lit(default)}" if default is not None else ""
    return f"CASE {whens}{tail} END"


def bins_case(col: str, edges, labels) -> str:
    whens = " ".join(f"WHEN {col} > {lo} AND {col} <= {hi} THEN {lit(lab)}"
                     for lo, hi, lab in zip(edges[:-1], edges[1:], labels))
    return f"CASE {whens} END"


def values_table(rows, names) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(names)}))"


def tiers(value: str, steps, default: str) -> str:
    """CASE over descending (threshold, text) steps."""
    whens = " ".join(f"WHEN {value} >= {th} THEN {lit(text)}" for th, text in steps)
    return f"CASE {whens} ELSE {lit(default)} END"

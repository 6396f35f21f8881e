"""Rows of two results, as sorted lists of text, for comparison."""

import math


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6g}"
    if hasattr(v, "item") and not hasattr(v, "__len__"):
        return cell(v.item())
    return str(v)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())


def duck_rows(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    columns = sorted(names)
    return columns, sorted(tuple(cell(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall())

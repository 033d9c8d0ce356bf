"""Run a registered query and its SQL on the same tables and compare all rows."""

from __future__ import annotations

import math
import os

import duckdb
import pyarrow as pa

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        return None if math.isnan(v) else (v + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def rows(table: pa.Table, cols):
    data = [table.column(c).to_pylist() for c in cols]
    return sorted((tuple(canon(v) for v in r) for r in zip(*data)), key=repr)


def kind(t):
    if pa.types.is_integer(t):
        return "int"
    if pa.types.is_floating(t):
        return "float"
    if pa.types.is_decimal(t):
        return "decimal"
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return "str"
    return str(t)


def compare(df, sql: str, con, empty_ok: bool = False) -> str | None:
    """None when equal, otherwise a short description of the first difference."""
    got = df.toArrow()
    res = con.execute(sql)
    want = res.to_arrow_table() if hasattr(res, "to_arrow_table") else res.fetch_arrow_table()
    a, b = sorted(got.column_names), sorted(want.column_names)
    if a != b:
        return f"columns {a} vs {b}"
    types = {c: (kind(got.schema.field(c).type), kind(want.schema.field(c).type)) for c in a}
    bad = {c: t for c, t in types.items() if t[0] != t[1]}
    if bad:
        return f"types {bad}"
    if got.num_rows != want.num_rows:
        return f"rows {got.num_rows} vs {want.num_rows}"
    if not got.num_rows and not empty_ok:
        return "no rows"
    ra, rb = rows(got, a), rows(want, a)
    diff = [(x, y) for x, y in zip(ra, rb) if x != y]
    if diff:
        return f"{len(diff)} of {len(ra)} rows differ, columns {a}: {diff[0][0]} vs {diff[0][1]}"
    return None

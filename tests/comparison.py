"""Whether a Spark result holds the rows that DuckDB's SQL gives on the same tables."""

import decimal
import glob
import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def database(sf_dir: str = SF):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(value):
    """A value as text; floats to nine significant digits."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else f"{float(value):.9g}".replace("-0", "0") if value == 0 else f"{float(value):.9g}"
    if isinstance(value, int):
        return f"{value:.9g}" if abs(value) < 1e9 else str(value)
    if isinstance(value, dict):
        return str(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, sql: str, con) -> str:
    """Empty if columns and rows agree; else what doesn't."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} for {sorted(names)}"
    want, got = rows_of(names, found.fetchall()), rows_of(df.columns, df.collect())
    if want == got:
        return ""
    a, b = set(got) - set(want), set(want) - set(got)
    return f"{len(got)} rows for {len(want)}; {len(a)} not expected, such as {sorted(a)[:2]}; {len(b)} missing, such as {sorted(b)[:2]}"

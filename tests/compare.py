"""Compares queries with their SQL, as the driver does: python tests/compare.py FOLDER [NAME...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and not isinstance(x, (int, float, str, bytes)) and getattr(x, "ndim", 0):
            return tuple(cell(y) for y in x)
        if x is None or x is pd.NaT or isinstance(x, float) and math.isnan(x) or x is pd.NA:
            return "∅"
        if hasattr(x, "item"):
            x = x.item()
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, float):
            return repr(round(x, 6)) if x != int(x) else repr(int(x))
        return str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(x) for x in row) for row in frame.itertuples(index=False))


def same(left: pd.DataFrame, right: pd.DataFrame) -> str:
    """Empty if both hold the same rows under the same column names, else what differs."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} and {sorted(right.columns)}"
    a, b = canonical(left), canonical(right)
    if a == b:
        return ""
    only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} and {len(b)} rows; only in the query {only_a}; only in the SQL {only_b}"


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as entry

    from tessellar.session import build_session

    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql, con, bad = entry.queries(), entry.oracle_sql(), connect(folder), 0
    for name in names or list(queries):
        t = time.time()
        try:
            rows = queries[name](spark, folder).toPandas()
            took = time.time() - t
            said = same(rows, con.execute(sql[name]).df()) if name in sql else f"no SQL; {len(rows)} rows"
            bad += bool(said and name in sql)
        except Exception as e:  # noqa: BLE001
            took, said, bad = time.time() - t, f"{type(e).__name__}: {str(e)[:1500]}", bad + 1
        print(f"{name}: {took:.1f} s, {len(rows) if 'rows' in dir() else '-'} rows: {said or 'equal'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))

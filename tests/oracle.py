"""python tests/oracle.py [NAME...]: compare registered queries with their SQL on sf0.01."""

from __future__ import annotations

import sys
import time
from fnmatch import fnmatch
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tonalis.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.01"


def canon(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def connection(folder: str = DATA) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def compare(spark, name: str, folder: str = DATA) -> str:
    """Empty if the rows are equal, else what differs."""
    df = entry.queries()[name](spark, folder)
    got = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return ""
    cur = connection(folder).execute(sql)
    cols = [x[0] for x in cur.description]
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(cols)}"
    order = sorted(cols)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "array<string>": "VARCHAR[]", "array<bigint>": "BIGINT[]", "tinyint": "TINYINT"}
    types = {x[0]: str(x[1]) for x in cur.description}
    odd = [(c, k, types[c]) for c, k in df.dtypes if kinds.get(k, k) != types[c]]
    if odd:
        return f"types {odd}"
    want = sorted(tuple(canon(r[cols.index(c)]) for c in order) for r in cur.fetchall())
    have = sorted(tuple(canon(r[c]) for c in order) for r in got)
    if want == have:
        return ""
    only = [r for r in have if r not in set(want)][:3], [r for r in want if r not in set(have)][:3]
    return f"{len(have)} rows against {len(want)}; only here {only[0]}; only in SQL {only[1]}"


if __name__ == "__main__":
    session = local_session(8)
    bad = 0
    wanted = [k for k in entry.queries() if not sys.argv[1:] or any(fnmatch(k, a) for a in sys.argv[1:])]
    for key in wanted:
        began = time.time()
        try:
            said = compare(session, key)
        except Exception as e:  # report and go on
            said = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(said)
        if said or time.time() - began > 8:
            print(key, f"{time.time() - began:.1f} s", "sql" if key in entry.oracle_sql() else "no sql", said or "ok", flush=True)
    print("failed", bad, "of", len(wanted))

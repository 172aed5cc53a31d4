"""Run registered queries next to their SQL twins.

``python tests/parity.py [sf] [name-prefix ...]`` prints one line per query.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        if math.isnan(v):
            return ("f", "nan")
        return ("f", repr(v))
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, (list, tuple)):
        return ("l", tuple(_norm(x) for x in v))
    if isinstance(v, dict):
        return ("m", tuple(sorted((k, _norm(x)) for k, x in v.items())))
    return (type(v).__name__, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"rows-only {len(got)}"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}"
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}\n   spark {got[:2]}\n   duck  {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)}/{len(got)} differ, first\n   spark {bad[0][0]}\n   duck  {bad[0][1]}"
    if not got:
        return False, "no rows"
    return True, f"rows {len(got)}"


def main(argv):
    import __spark_entry__ as entry
    from hyperlake.session import local_session

    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    if os.environ.get("ROWS_PER_CHUNK"):
        spark.conf.set("hyperlake.rowsPerChunk", os.environ["ROWS_PER_CHUNK"])
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            ok, note = compare(spark, con, sf_dir, fn, oracle.get(name))
        except Exception as exc:  # report and go on
            lines = traceback.format_exc().strip().splitlines()
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:600]}\n   " + "\n   ".join(
                l for l in lines if "hyperlake" in l)[-600:]
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {time.time() - t:6.2f}s {name}: {note}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])

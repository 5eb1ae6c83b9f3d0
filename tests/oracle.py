"""Compare registered queries with their SQL counterparts row by row.

Run as a script:  python tests/oracle.py [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return repr(float(v))
    if isinstance(v, float):
        return "null" if math.isnan(v) else repr(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    try:
        return repr(float(v)) if type(v).__name__ == "Decimal" else str(v)
    except ValueError:
        return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got, gcols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got) > 0, f"{len(got)} rows (no SQL)"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    exp, ecols = rows_of(cols, cur.fetchall())
    if gcols != ecols:
        return False, f"columns differ: {sorted(set(gcols) ^ set(ecols))}"
    if got == exp:
        return len(got) > 0, f"{len(got)} rows"
    only_got, only_exp = [r for r in got if r not in set(exp)], [r for r in exp if r not in set(got)]
    detail = f"rows {len(got)} vs {len(exp)}; {len(only_got)} differ\n    {gcols}"
    for a in only_got[:3]:
        detail += f"\n    spark {a}"
    for a in only_exp[:3]:
        detail += f"\n    sql   {a}"
    return False, detail


def main(argv):
    import __spark_entry__ as entry
    from spreadlab.session import build_session

    sf_dir = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    spark, con = build_session("oracle"), connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    bad = []
    for n in names:
        t = time.time()
        try:
            ok, note = compare(spark, con, queries[n], sqls.get(n), sf_dir)
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:900]}"
        print(f"{'ok  ' if ok else 'FAIL'} {n} {time.time() - t:.1f}s {note}", flush=True)
        if not ok:
            bad.append(n)
    print(f"{len(names) - len(bad)}/{len(names)} match; failing: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""Run catalog queries against DuckDB on the same Parquet files and compare.

    python -m tests.oracle [prefix ...] [--sf sf0.01]
"""

from __future__ import annotations

import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
ROOT = "/root/testdata"


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


KIND = {
    "int": "i", "bigint": "i", "smallint": "i", "INTEGER": "i", "BIGINT": "i", "double": "f", "DOUBLE": "f", "string": "s",
    "VARCHAR": "s", "date": "d", "DATE": "d", "boolean": "b", "BOOLEAN": "b",
}


def norm(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if type(v).__name__ == "Decimal":
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        v = round(v, 9) + 0.0
        return int(v) if v.is_integer() else v
    return str(v) if not isinstance(v, (int, str)) else v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted([tuple(norm(r[i]) for i in order) for r in rows], key=repr)


def compare(spark_df, con, sql):
    """Empty text when equal, else what differs."""
    got_cols = spark_df.columns
    got = rows_of(got_cols, [tuple(x) for x in spark_df.collect()])
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = rows_of(want_cols, cur.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(set(got_cols) ^ set(want_cols))}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} rows differ, cols {sorted(got_cols)}\n   got  {bad[0][0]}\n   want {bad[0][1]}", len(got)
    kinds = {d[0]: KIND.get(str(d[1]), str(d[1])) for d in cur.description}
    odd = [f"{c}:{t}/{kinds[c]}" for c, t in spark_df.dtypes if KIND.get(t, t) != kinds[c] or KIND.get(t) is None]
    return (f"types {odd}" if odd else ""), len(got)


def main(argv):
    from chartline import session
    from chartline.catalog import base, load

    sf = argv[argv.index("--sf") + 1] if "--sf" in argv else "sf0.01"
    only = [a for a in argv if not a.startswith("--") and a != sf]
    folder = f"{ROOT}/{sf}"
    spark = session.build("local[8]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, fails = duck(folder), []
    for name, q in load().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t0 = time.time()
        try:
            df = q.run(base.Tables(spark, folder))
            if q.sql is None:
                msg, n = "", df.count()
            else:
                msg, n = compare(df, con, q.sql)
        except Exception as e:  # noqa: BLE001 - report and go on to the next query
            msg, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        print(f"{'ok  ' if not msg else 'FAIL'} {name:34s} rows={n:<7d} {time.time() - t0:5.1f}s"
              f"{'' if q.sql else ' (no sql)'} {msg}", flush=True)
        if msg or n == 0:
            fails.append(name if msg else f"{name} (empty)")
    print("failed:", fails)
    return 1 if fails else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

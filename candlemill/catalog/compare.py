"""Run registered queries next to their SQL and report differences (developer tool and test)."""

from __future__ import annotations

import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def check(name, fn, sql, spark, con, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = df.columns
    got = _rows(cols, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return True, f"{name}: rows-only {len(got)} rows, {t1 - t0:.2f}s"
    rel = con.execute(sql)
    wcols = [c[0] for c in rel.description]
    want = _rows(wcols, rel.fetchall())
    t2 = time.time()
    if sorted(cols) != sorted(wcols):
        return False, f"{name}: columns {sorted(cols)} vs {sorted(wcols)}"
    if got == want:
        return True, f"{name}: ok {len(got)} rows, spark {t1 - t0:.2f}s sql {t2 - t1:.2f}s"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return False, f"{name}: DIFF rows {len(got)} vs {len(want)}, {len(bad)} differ, cols {sorted(cols)}\n   got  {bad[:3] and bad[0][0]}\n   want {bad[:3] and bad[0][1]}"


def main(argv):
    from candlemill.catalog.load import queries, sql
    from candlemill.session import build_session

    sf_dir, wanted = argv[0], argv[1:]
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(sf_dir)
    qs, text = queries(), sql()
    failed = 0
    for name, fn in qs.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, msg = check(name, fn, text.get(name), spark, con, sf_dir)
        except Exception as exc:  # noqa: BLE001
            ok, msg = False, f"{name}: {type(exc).__name__} {str(exc)[:1500]}"
        failed += not ok
        print(("  " if ok else "!! ") + msg, flush=True)
    print("failed", failed)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])

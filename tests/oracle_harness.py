"""Run registered queries on Spark and their oracle SQL on DuckDB, compare like the driver does:
row count, column names, and an order-insensitive hash of the values (columns sorted by name).

CLI: ``python tests/oracle_harness.py [sf_dir] [key ...]``
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return str(v)


def digest(columns: list[str], rows: list[tuple]) -> tuple[list[str], str, int]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return cols, hashlib.sha256("\n".join(lines).encode()).hexdigest(), len(lines)


def compare(spark, sf_dir: str, keys=None, verbose=True):
    import __spark_entry__ as E

    qs, oracle = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for k in keys or sorted(qs):
        t0 = time.time()
        try:
            df = qs[k](spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            results[k] = ("spark-error", str(e)[:400])
            if verbose:
                print(f"{k:32s} SPARK ERROR {str(e)[:300]}")
            continue
        ts = time.time() - t0
        if k not in oracle:
            results[k] = ("no-oracle", len(srows))
            if verbose:
                print(f"{k:32s} rows={len(srows):7d} (no oracle) {ts:.1f}s")
            continue
        try:
            r = con.execute(oracle[k])
            ocols = [d[0] for d in r.description]
            orows = r.fetchall()
        except Exception as e:  # noqa: BLE001
            results[k] = ("oracle-error", str(e)[:400])
            if verbose:
                print(f"{k:32s} ORACLE ERROR {str(e)[:300]}")
            continue
        sc, sh, sn = digest(scols, srows)
        oc, oh, on = digest(ocols, orows)
        ok = sc == oc and sh == oh and sn == on
        results[k] = ("ok" if ok else "mismatch", sn, on, sc, oc)
        if verbose:
            print(f"{k:32s} {'OK ' if ok else 'BAD'} rows={sn}/{on} {ts:.1f}s" + ("" if sc == oc else f" cols {sc} vs {oc}"))
            if not ok and sc == oc and sn == on and verbose:
                order = sorted(range(len(scols)), key=lambda i: scols[i])
                oorder = sorted(range(len(ocols)), key=lambda i: ocols[i])
                a = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in srows)
                b = sorted(repr(tuple(_norm(r[i]) for i in oorder)) for r in orows)
                diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
                for x, y in diffs:
                    print("    spark :", x[:300])
                    print("    oracle:", y[:300])
    return results


if __name__ == "__main__":
    from finlake.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or None
    spark = local_session(8, 8)
    res = compare(spark, sf, keys)
    bad = [k for k, v in res.items() if v[0] not in ("ok", "no-oracle")]
    print(f"\n{len(res) - len(bad)}/{len(res)} ok; bad: {bad}")

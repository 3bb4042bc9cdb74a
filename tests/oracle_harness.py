"""Run registered queries against their DuckDB oracle (as the driver does)."""
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(tuple(v))
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def check(spark, name, fn, sql, sf_dir, con, verbose=True):
    t = time.time()
    sdf = fn(spark, sf_dir)
    srows = sdf.collect()
    scols = sdf.columns
    ts = time.time() - t
    if sql is None:
        return {"name": name, "rows": len(srows), "oracle": None, "sec": ts}
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    ok_cols = sorted(scols) == sorted(dcols)
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    out = {"name": name, "rows": len(srows), "oracle_rows": len(drows), "cols": ok_cols, "match": a == b, "sec": ts}
    if verbose and not (ok_cols and a == b):
        print("MISMATCH", name, scols, dcols, len(a), len(b))
        diff_a = [x for x in a if x not in set(b)][:3]
        diff_b = [x for x in b if x not in set(a)][:3]
        print("  spark only:", [repr(x)[:300] for x in diff_a])
        print("  oracle only:", [repr(x)[:300] for x in diff_b])
    return out


def main(names=None, sf_dir="/root/testdata/sf0.01"):
    from webloom.session import get_session
    import __spark_entry__ as E
    spark = get_session("local[8]", 8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    res = []
    for n, fn in qs.items():
        if names and n not in names:
            continue
        try:
            r = check(spark, n, fn, sqls.get(n), sf_dir, con)
        except Exception as e:  # report and continue
            r = {"name": n, "error": repr(e)[:500]}
        print(r, flush=True)
        res.append(r)
    return res


if __name__ == "__main__":
    main(sys.argv[1:] or None)

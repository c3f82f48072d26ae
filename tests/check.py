"""Compare registered queries with their SQL in DuckDB: python tests/check.py SF [name-prefix ...]"""
import math
import sys
import time

import duckdb

sys.path.insert(0, "/root/repo")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else (0.0 if v == 0 else v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def main(sf, prefixes):
    import __spark_entry__ as E
    from tallygrid.session import local_session
    spark = local_session(__import__("os").environ.get("CHECK_CPUS", "8"))
    d = sf if sf.startswith("/") else f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    q, s = E.queries(), E.oracle_sql()
    bad = []
    for name, fn in q.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, d)
            cols = sorted(df.columns)
            rows = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
            t1 = time.time() - t0
            if name not in s:
                print(f"ROWS {name} {len(rows)} {t1:.1f}s")
                continue
            rel = con.execute(s[name])
            desc = {x[0]: str(x[1]) for x in rel.description}
            oc = sorted(desc)
            idx = [[x[0] for x in rel.description].index(c) for c in oc]
            orows = [tuple(norm(r[i]) for i in idx) for r in rel.fetchall()]
            types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
            note = ""
            tm = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER", "date": "DATE"}
            diff = [(c, types[c], desc.get(c)) for c in cols if tm.get(types[c]) != desc.get(c)]
            if diff:
                note = f" TYPES {diff}"
            key = lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, (int, float)) or isinstance(x, bool) else (x is not None, "n", x) for x in r)
            a, b = sorted(rows, key=key), sorted(orows, key=key)
            ok = cols == oc and a == b
            print(f"{'OK  ' if ok else 'FAIL'} {name} {len(rows)} {t1:.1f}s{note}", flush=True)
            if not ok:
                bad.append(name)
                if cols != oc:
                    print("   columns", cols, oc)
                else:
                    sa, sb = set(a), set(b)
                    print("   rows", len(a), len(b), "\n   spark only", [r for r in a if r not in sb][:3], "\n   sql only", [r for r in b if r not in sa][:3])
        except Exception as e:
            bad.append(name)
            print(f"ERR  {name} {type(e).__name__} {str(e)[:700]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])

"""Compare each registered query with its check SQL on the same parquet files.

``python -m tests.compare [-d DIR] [key-prefix ...]``
"""

from __future__ import annotations

import sys
import time
import traceback
from datetime import datetime

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
SPARK_TO_SQL = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
                "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT"}


def open_db(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for row in rows:
        vals = []
        for i in order:
            v = row[i]
            if v is None or (isinstance(v, float) and v != v):
                vals.append("\0")
            elif isinstance(v, float):
                vals.append(repr(round(v, 9) + 0.0))
            elif isinstance(v, datetime):
                vals.append(v.isoformat())
            else:
                vals.append(str(v))
        out.append(tuple(vals))
    return sorted(out)


def compare(spark, con, sf_dir: str, key: str, fn, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf_dir)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return len(got) > 0, f"rows={len(got)} no-sql {took:.2f}s"
    rel = con.execute(sql)
    desc = {d[0]: str(d[1]) for d in rel.description}
    want, names = rel.fetchall(), [d[0] for d in rel.description]
    if sorted(types) != sorted(desc):
        return False, f"columns {sorted(types)} vs {sorted(desc)}"
    bad = [f"{n}: {types[n]} vs {desc[n]}" for n in types if SPARK_TO_SQL.get(types[n]) != desc[n].upper()]
    a, b = norm(df.columns, got), norm(names, want)
    if a != b:
        set_a, set_b = set(a), set(b)
        only_a = [x for x in a if x not in set_b][:3]
        only_b = [x for x in b if x not in set_a][:3]
        return False, f"rows {len(a)} vs {len(b)} types={bad} cols={sorted(types)}\n   spark-only {only_a}\n   sql-only   {only_b}"
    if bad:
        return False, f"types {bad}"
    return len(a) > 0, f"rows={len(a)} {took:.2f}s"


def main(argv: list[str]) -> int:
    from logwarden.session import local_session
    import __spark_entry__ as e

    sf_dir = "/root/testdata/sf0.01"
    if argv and argv[0] == "-d":
        sf_dir, argv = argv[1], argv[2:]
    spark, con = local_session(), open_db(sf_dir)
    queries, oracles = e.queries(), e.oracle_sql()
    failed, ran = [], 0
    for key, fn in queries.items():
        if argv and not any(key.startswith(p) for p in argv):
            continue
        ran += 1
        try:
            ok, note = compare(spark, con, sf_dir, key, fn, oracles.get(key))
        except Exception as err:  # noqa: BLE001
            ok, note = False, f"{type(err).__name__}: {str(err)[:600]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        slow = note.endswith("s") and float(note.rsplit(" ", 1)[1][:-1]) > 3
        if not ok or slow or "no-sql" in note:
            print(("ok   " if ok else "FAIL ") + key, note, flush=True)
        if not ok:
            failed.append(key)
    print(f"ran {ran}, failed {len(failed)}: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

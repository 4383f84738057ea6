"""Run registered queries in Spark and in the check engine and compare the rows."""

from __future__ import annotations

import math
import time

import duckdb

from nearby_engine.plans.views import TABLES

TYPES = {"long": "BIGINT", "integer": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _key(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return repr(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_key(row[i]) for i in order) for row in rows)


def differences(frame, con, sql: str) -> list[str]:
    """Empty when columns, types and rows agree."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    theirs = result.fetchall()
    mine = frame.collect()
    found = []
    if sorted(frame.columns) != sorted(names):
        return [f"columns {sorted(frame.columns)} != {sorted(names)}"]
    for field in frame.schema:
        kind = field.dataType.typeName()
        if TYPES.get(kind) != kinds[field.name]:
            found.append(f"type of {field.name}: {kind} != {kinds[field.name]}")
    left, right = _rows(frame.columns, mine), _rows(names, theirs)
    if len(left) != len(right):
        found.append(f"row count {len(left)} != {len(right)}")
    if left != right:
        only = [r for r in left if r not in set(right)][:2]
        other = [r for r in right if r not in set(left)][:2]
        found.append(f"columns {sorted(names)} only here {only} only there {other}")
    return found


def check(spark, catalog, folder: str, wanted=None) -> dict[str, list[str]]:
    con = connect(folder)
    report = {}
    for name, entry in catalog.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if entry.sql is None:
                count = entry.plan(spark, folder).count()
                report[name] = [] if count else ["no rows"]
            else:
                report[name] = differences(entry.plan(spark, folder), con, entry.sql)
                count = con.execute(f"SELECT count(*) FROM ({entry.sql})").fetchall()[0][0]
        except Exception as error:  # noqa: BLE001
            count = -1
            report[name] = [f"{type(error).__name__}: {str(error)[:1500]}"]
        print(f"{name:32s} rows {count:7d} {time.time() - start:6.1f}s {'ok' if not report[name] else report[name]}", flush=True)
    return report


if __name__ == "__main__":
    import sys

    from nearby_engine.plans import load_catalog
    from nearby_engine.plans.catalog import CATALOG
    from nearby_engine.session import local_session

    load_catalog()
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    bad = {n: d for n, d in check(local_session("8"), CATALOG, folder, set(sys.argv[2:])).items() if d}
    print(f"{len(bad)} differ: {sorted(bad)}")

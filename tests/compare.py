"""Run the registered queries against their SQL: ``python -m tests.compare [sf_dir] [names...]``."""

from __future__ import annotations

import decimal
import math
import sys
import time

import duckdb

import __spark_entry__ as registered

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


SPARK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def cell(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, int):
        return repr(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def check(spark, sf_dir, name):
    """(rows, differing rows from Spark, differing rows from SQL, columns of unequal type, Spark seconds, SQL seconds)."""
    begin = time.time()
    df = registered.queries()[name](spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    middle = time.time()
    sql = registered.oracle_sql().get(name)
    if sql is None:
        return len(mine), [], [], [], middle - begin, 0.0
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = rows_of(columns, result.fetchall())
    end = time.time()
    assert sorted(columns) == sorted(df.columns), (sorted(columns), sorted(df.columns))
    only_mine, only_theirs = _difference(mine, theirs), _difference(theirs, mine)
    sql_types = {d[0]: str(d[1]) for d in result.description}
    unequal = [(c, kind, sql_types[c]) for c, kind in df.dtypes if SPARK_TYPES.get(kind, kind) != sql_types[c]]
    return len(mine), only_mine, only_theirs, unequal, middle - begin, end - middle


def _difference(left, right):
    from collections import Counter

    return list((Counter(left) - Counter(right)).elements())


def main():
    from tests.conftest import make_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(registered.queries())
    spark = make_session()
    bad = []
    for name in names:
        try:
            count, mine, theirs, unequal, spark_s, sql_s = check(spark, sf_dir, name)
            state = "ok  " if not mine and not theirs else "DIFF"
            print(f"{state} {name:30} rows={count:7} spark={spark_s:6.2f}s sql={sql_s:6.2f}s", flush=True)
            if unequal:
                print("   types", unequal, flush=True)
            if state == "DIFF":
                bad.append(name)
                print("   spark", len(mine), mine[:3])
                print("   sql  ", len(theirs), theirs[:3], flush=True)
        except Exception as error:
            bad.append(name)
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:700]}", flush=True)
    print("not matching:", bad)


if __name__ == "__main__":
    main()

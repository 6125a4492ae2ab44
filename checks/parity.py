"""Compare registered queries with their SQL: names, types, row counts and every value."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

TYPES = {
    "INTEGER": "int",
    "BIGINT": "bigint",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
    "DATE": "date",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _text(value) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.date().isoformat()
    return str(value)


def rows_of(columns, rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(_text(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, fn, sql: str) -> list[str]:
    """The list of differences; empty when both agree."""
    df = fn(spark, sf_dir)
    got = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in cur.description}
    want = cur.fetchall()
    out = [] if want else ["empty result"]
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema}
    if spark_types != types:
        diff = {k: (spark_types.get(k), types.get(k)) for k in spark_types.keys() | types.keys()}
        out.append(f"schema {({k: v for k, v in diff.items() if v[0] != v[1]})}")
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        only_a = sorted(set(a) - set(b))[:2]
        only_b = sorted(set(b) - set(a))[:2]
        out.append(f"values, columns {sorted(names)}\n   spark {only_a}\n   sql   {only_b}")
    return out


def main() -> None:
    from checks.oracles import ORACLES
    from checks.queries import QUERIES
    from fieldcount.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    con = connect(sf_dir)
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            if name in ORACLES:
                problems = compare(spark, con, sf_dir, QUERIES[name], ORACLES[name])
            else:
                problems = [] if QUERIES[name](spark, sf_dir).collect() else ["no rows"]
        except Exception as error:  # report and go on to the next query
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(problems)
        state = "FAIL" if problems else "ok" if name in ORACLES else "rows"
        print(f"{state:5}{time.time() - start:6.2f}s {name}", *problems, sep="\n      " if problems else " ")
    print(f"{len(chosen) - bad} of {len(chosen)} agree")


if __name__ == "__main__":
    main()

"""Runs a registered query and its SQL on the same tables and compares names, types, counts and values."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return value


def key(row) -> tuple:
    return tuple((v is None, str(type(v) is bool), str(v)) for v in row)


SAME = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP", "float": "FLOAT", "date": "DATE",
}


def compare(df, con, sql: str) -> list[str]:
    problems = []
    names = sorted(df.columns)
    rows = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=key)
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    expected = sorted(
        (tuple(plain(r[columns.index(n)]) for n in names) for r in result.fetchall()) if sorted(columns) == names else [],
        key=key,
    )
    if sorted(columns) != names:
        problems.append(f"columns {names} != {sorted(columns)}")
    for field in df.schema:
        want = SAME.get(field.dataType.simpleString())
        if want and types.get(field.name) not in (want, "STRING" if want == "VARCHAR" else want, "NUMBER"):
            problems.append(f"type of {field.name}: {field.dataType.simpleString()} vs {types.get(field.name)}")
    if len(rows) != len(expected):
        problems.append(f"{len(rows)} rows != {len(expected)}")
    wrong = [(a, b) for a, b in zip(rows, expected) if a != b]
    if wrong:
        problems.append(f"{len(wrong)} of {len(rows)} rows differ, first {wrong[0]}"[:700])
    if not rows:
        problems.append("no rows")
    return problems


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from quillstone.session import build_session

    folder = "/root/testdata/sf0.01"
    wanted = sys.argv[1:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in oracles:
                problems = compare(df, con, oracles[name])
            else:
                n = len(df.collect())
                problems = [] if n else ["no rows"]
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:900]}"]
        bad += bool(problems)
        print(f"{'BAD ' if problems else 'ok  '}{name} {time.time() - start:.1f}s{'' if name in oracles else ' (rows only)'}", flush=True)
        for p in problems:
            print("     ", p)
    print("bad:", bad)


if __name__ == "__main__":
    main()

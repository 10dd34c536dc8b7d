"""Compare a registered query with its SQL on the same Parquet tables, columns by name and rows in any order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NOTHING = "the SQL finds no row, so that nothing is compared"


def normal(value):
    if isinstance(value, float):
        return "nan" if value != value else float(f"{value:.9g}")
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat() if hasattr(value, "tzinfo") else value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(normal, value))
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    want = table([c[0] for c in found.description], found.fetchall())
    if not want[1]:
        return NOTHING
    frame = query(spark, sf_dir)
    got = table(frame.columns, [tuple(r) for r in frame.collect()])
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    wrong = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else ""

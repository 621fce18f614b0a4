"""Row-by-row comparison of a query with its SQL in DuckDB."""

import datetime
import decimal
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float) and value == int(value):
        return str(int(value))
    if isinstance(value, decimal.Decimal):
        return str(int(value)) if value == int(value) else str(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)[:19]
    return None if value is None else str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda r: tuple((x is not None, x or "") for x in r))


def duck(sql, sf_dir=SF):
    db = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            db.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    found = db.sql(sql)
    return sorted(found.columns), rows(found.columns, found.fetchall())


def spark_rows(df):
    return sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()])

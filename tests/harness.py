"""Run a query beside its SQL and compare rows."""

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return ("f", round(v, 6))
    if isinstance(v, decimal.Decimal):
        return ("d", format(v.normalize(), "f"))
    if isinstance(v, datetime.datetime):
        return ("t", str(v.replace(tzinfo=None)))
    return ("n", "") if v is None else (type(v).__name__, str(v))


def compare(spark, sf_dir, query, sql):
    rows = query(spark, sf_dir).collect()
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.sql(sql)
    names = sorted(found.columns)
    assert rows == [] or sorted(rows[0].__fields__) == names
    place = [found.columns.index(n) for n in names]
    got = sorted(tuple(plain(r[n]) for n in names) for r in rows)
    want = sorted(tuple(plain(r[i]) for i in place) for r in found.fetchall())
    assert got == want

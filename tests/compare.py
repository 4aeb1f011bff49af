"""Rows of a query against rows of another engine: names, and values as multisets."""

import math

import duckdb

from lakeloom.sources.tables import TABLES

_open = {}


def connection(folder):
    if folder not in _open:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
        _open[folder] = con
    return _open[folder]


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(normal(r[c]) for c in names) for r in df.collect()), key=repr)


def rows_of_sql(sql, folder):
    found = connection(folder).execute(sql)
    names = [x[0] for x in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(normal(r[i]) for i in order) for r in found.fetchall()), key=repr)

"""Comparison of a DataFrame with SQL, independent of row and column order."""

from collections import Counter


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())


def sql_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())

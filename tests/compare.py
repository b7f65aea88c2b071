"""Rows as values that two engines agree on."""

import decimal
import math


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, decimal.Decimal):
        return round(float(x), 9)
    if isinstance(x, list | tuple):
        return tuple(map(value, x))
    return x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(value(r[k]) for k in order) for r in found), key=repr)


def same(df, con, sql):
    made = con.execute(sql)
    names = [d[0] for d in made.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, made.fetchall())

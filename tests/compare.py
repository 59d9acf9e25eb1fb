import decimal


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.6g}"
    return str(value)


def same_rows(spark_df, duck, sql):
    """Assert equal columns and equal rows, whatever their order."""
    columns = sorted(spark_df.columns)
    rows = spark_df.select(*[f"`{c}`" for c in columns]).collect()
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    left = sorted(tuple(plain(v) for v in r) for r in rows)
    right = sorted(tuple(plain(r[k]) for k in at) for r in found.fetchall())
    assert left == right

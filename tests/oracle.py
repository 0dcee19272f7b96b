"""Rows of a query and of its SQL, in one form that can be compared."""

from pathlib import Path

import duckdb


def connect(sf: str):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    plain = lambda x: None if x is None or x != x else x.item() if hasattr(x, "item") else x
    return sorted((tuple(map(plain, r)) for r in pdf.itertuples(index=False)), key=repr)


def compare(df, sql: str, sf: str) -> int:
    """The number of rows; raises where the two differ."""
    theirs = connect(sf).execute(sql)
    names = sorted(d[0] for d in theirs.description)
    assert sorted(df.columns) == names
    a, b = rows(df.toPandas()), rows(theirs.df())
    assert len(a) == len(b), (len(a), len(b))
    for x, y in zip(a, b):
        assert x == y, (x, y)
        assert [type(v) for v in x] == [type(v) for v in y], (x, y)
    return len(a)

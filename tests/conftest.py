import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tessera.plans.session import build_session, ship

    session = build_session("local[4]", 4, spark__driver__memory="3g", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for file in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def plain(v):
    """A value in a form that compares across engines."""
    import datetime
    import decimal
    import math

    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((str(k), plain(x)) for k, x in sorted(v.items(), key=str))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, (int, datetime.date)):
        return v
    return str(v)


@pytest.fixture(scope="session")
def same(spark, data, duck):
    """Compare a query with its SQL, rows in any order, columns by name."""

    def check(query, sql):
        df = query(spark, data)
        names = sorted(df.columns)
        mine = sorted((tuple(plain(v) for v in row) for row in df.select(*[f"`{c}`" for c in names]).collect()), key=repr)
        found = duck.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(columns) == names
        order = [columns.index(c) for c in names]
        theirs = sorted((tuple(plain(row[i]) for i in order) for row in found.fetchall()), key=repr)
        assert len(mine) == len(theirs)
        assert [r for r in mine if r not in set(theirs)][:3] == []
        assert mine == theirs

    return check

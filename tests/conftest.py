import datetime as dt

import pytest

from barloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def panel(spark):
    """panel(close=[..], vol=[..], code="A"): one or several series of consecutive days."""

    def make(series=None, **columns):
        series = series or {"A": columns}
        names = list(next(iter(series.values())))
        rows = []
        for code, cols in series.items():
            for i, values in enumerate(zip(*cols.values())):
                day = dt.date(2024, 1, 1) + dt.timedelta(days=i)
                rows.append((code, day, *(None if v is None else float(v) for v in values)))
        return spark.createDataFrame(rows, "ts_code string, trade_date date, " + ", ".join(f"{n} double" for n in names))

    return make


@pytest.fixture
def column():
    """Values of one expression in date order."""

    def values(df, expr):
        rows = df.withColumn("_out", expr).orderBy("ts_code", "trade_date").collect()
        return [None if r["_out"] is None else round(float(r["_out"]), 6) for r in rows]

    return values

"""Every query of the pack against its DuckDB counterpart on the smallest tables."""

import duckdb
import pytest

from terravox.plans.pack import PACK

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = [tuple(None if v != v or v is None else v.item() if hasattr(v, "item") else v for v in r) for r in frame.itertuples(index=False)]
    return list(frame.columns), sorted(plain, key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", PACK)
def test_query(spark, duck, name):
    run, sql = PACK[name]
    names, got = rows(run(spark, SF).toPandas())
    assert len(set(names)) == len(names)
    if sql:
        assert (names, got) == rows(duck.execute(sql).fetch_df())

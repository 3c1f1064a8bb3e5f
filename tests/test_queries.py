import duckdb
import pytest

from terralex.plans.catalog import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted((tuple(None if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    want = db.sql(ORACLES[name])
    assert names == sorted(want.columns)
    want = db.sql(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from ({ORACLES[name]})").fetchall()
    assert plain(tuple(r) for r in df.select(*names).collect()) == plain(want)

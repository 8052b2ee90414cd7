"""Every registered query of the pattern engine against its SQL, on the smallest tables."""

from pathlib import Path

import pytest

from seqlattice import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def comparable(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in frame[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    if name in queries.ORACLE_SQL:
        assert comparable(got) == comparable(con.execute(queries.ORACLE_SQL[name]).df())
    else:
        assert len(got)


@pytest.fixture(scope="module")
def mixed(tmp_path_factory):
    """Events twice, the second time with other users and ids behind all others: later batches hold earlier times."""
    import duckdb

    at, c = tmp_path_factory.mktemp("mixed"), duckdb.connect()
    c.execute(f"COPY (SELECT event_id + k * 1000 AS event_id, ts, user_id + k * 2000 AS user_id, event_type, value, props FROM '{DATA}/events.parquet', range(2) t(k)) TO '{at}/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{at}/events.parquet'")
    return str(at), c


@pytest.mark.parametrize("name", ["incremental_answer", "firing_every_k", "batch_identity_gate"])
def test_batches_that_are_not_in_the_order_of_time(spark, mixed, name):
    """F7 to F9: refused, though the SQL has an answer."""
    at, con = mixed
    got, want = comparable(queries.QUERIES[name](spark, at).toPandas()), comparable(con.execute(queries.ORACLE_SQL[name]).df())
    assert got == want and want[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 81
    assert set(e.oracle_sql()) <= set(e.queries())

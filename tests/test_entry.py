import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as e
from routescope.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings records qrels payloads layers eval_items".split()
CHECKED = sorted(registry.QUERIES)
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")


def canon(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    return sorted([tuple("nan" if isinstance(v, float) and v != v else round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in frame.itertuples(index=False, name=None)], key=repr)


def test_entry_has_rows(spark):
    assert e.entry(spark).count() > 0


def test_every_core_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE)
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = pd.DataFrame(e.queries()[name](spark, DATA).toArrow().to_pydict())
    want = pd.DataFrame(con.sql(e.oracle_sql()[name]).to_arrow_table().to_pydict())
    assert canon(got) == canon(want)

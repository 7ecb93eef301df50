import os

import duckdb
import pandas as pd
import pytest

from routescope.llm import queries

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings records qrels payloads layers eval_items".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")


def canon(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    return sorted([tuple("nan" if isinstance(v, float) and v != v else round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in frame.itertuples(index=False, name=None)], key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    if name not in queries.ORACLE:
        assert got.count() > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = pd.DataFrame(con.sql(queries.ORACLE[name]).to_arrow_table().to_pydict())
    assert canon(pd.DataFrame(got.toArrow().to_pydict())) == canon(want)

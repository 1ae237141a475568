"""Every corpus query over a small folder of tables, and its SQL in DuckDB."""

import os

import duckdb
import pytest

from vellum.llm import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")

ROWS = {"1": "pages", "2": "pages", "3": "documents", "4": "documents", "5": "documents", "7": "documents", "8": "documents", "10": "documents"}


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, name):
    got = registry.QUERIES[name](spark, SF)
    rows = [tuple(r[c] for c in sorted(got.columns)) for r in got.collect()]
    if table := ROWS.get(name[2:].split("_")[0]):
        assert len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name in registry.SQL:
        with duckdb.connect() as db:
            for t in ("documents", "pages", "embeddings"):
                db.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
            want = db.execute(registry.SQL[name])
            names = [d[0] for d in want.description]
            plain = lambda r: [round(x, 9) if isinstance(x, float) else x for x in r]
            assert sorted(names) == sorted(got.columns)
            assert sorted(map(str, map(plain, rows))) == sorted(str(plain(r[names.index(c)] for c in sorted(names))) for r in want.fetchall())

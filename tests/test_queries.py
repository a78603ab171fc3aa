"""Every registered query against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lemmaflow.plans import registry

DATA = Path("/root/testdata/sf0.001")
if not DATA.exists():
    pytest.skip("the driver's tables are not here", allow_module_level=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    got, want = registry.QUERIES[name](spark, str(DATA)).toArrow(), duck.sql(registry.ORACLES[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    got, want = (sorted(repr([float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v for v in r.values()]) for r in t.select(columns).to_pylist()) for t in (got, want))
    assert got == want


def test_static_tokens_of_texts_without_tokens(spark, tmp_path):
    rows = list(enumerate(["", "\u0434\u043e\u043c", None, ":$", " ", "a:$i b"]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["static_tokens"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.sql(registry.ORACLES["static_tokens"]).fetchall())


@pytest.mark.parametrize("name", ["batch_documents", "batch_symbol_map", "tree_tags"])
def test_batches_of_events_without_user(spark, tmp_path, name):
    events = spark.read.parquet(str(DATA / "events.parquet"))
    events.withColumn("user_id", F.when(F.col("event_id") % 9 != 4, F.col("user_id"))).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got, want = registry.QUERIES[name](spark, str(tmp_path)).toArrow(), con.sql(registry.ORACLES[name]).to_arrow_table()
    assert sorted(map(repr, got.select(want.column_names).to_pylist())) == sorted(map(repr, want.to_pylist()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Plan shape and registry contract."""

import io
from contextlib import redirect_stdout

import duckdb
import pytest

import __spark_entry__ as entry
from barloom.operators import features as X
from barloom.session import cut_lineage
from tools.check import connect, rows_of

SMALL = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


def test_feature_packs_share_one_shuffle_and_sort(walk):
    bars = cut_lineage(walk[1])
    text = plan(X.features(bars, *X.ALPHA))
    assert text.count("Exchange hashpartitioning(symbol") - text.count("_fine") <= 3
    windows = [line for line in text.splitlines() if "Exchange hashpartitioning(symbol" in line and "_chunk" in line]
    assert len(windows) == 1
    assert "SinglePartition" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_is_pruned_and_filtered(spark):
    text = plan(spark.read.parquet(f"{SMALL}/events.parquet").where("event_type = 'click'").select("ts", "value"))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in text and "props" not in text


def test_registry_contract():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 5 and "sharpe" in df.columns


@pytest.mark.parametrize("name", ["bars_1h", "asof_funding", "sma_pack", "triple_barrier_long", "feature_auc", "trade_equity", "macd", "book_large", "stream_features", "weekday_effect"])
def test_matches_sql(spark, name):
    df = entry.queries()[name](spark, SMALL)
    got = rows_of(df.columns, df.collect())
    res = connect(SMALL).execute(entry.oracle_sql()[name])
    assert got == rows_of([d[0] for d in res.description], res.fetchall())


def test_oracles_parse():
    con: duckdb.DuckDBPyConnection = connect(SMALL)
    for name, text in entry.oracle_sql().items():
        con.execute("EXPLAIN " + text)

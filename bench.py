"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "bars_1h", "asof_funding", "sma_pack", "hurst_100", "entropy_48", "book_proxies", "triple_barrier_long", "mae_mfe", "wf_splits",
    "perf_stats", "strategy_compare", "sltp_grid", "trailing_exits", "trade_stats", "macd", "feature_auc", "weekday_effect",
    "daily_rule_stats", "book_imbalance", "stream_closed_bars",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from barloom.operators import features as X
    from barloom.operators.sweep import Grid, sweep
    from barloom.plans import catalog
    from barloom.plans.q_sources import bars_with_funding
    from barloom.session import local_session
    from barloom.sources import bars as B
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.range(1).count()

    def clock(run) -> float:
        start = time.time()
        run().write.format("noop").mode("overwrite").save()
        return round(time.time() - start, 3)

    times = {name: clock(lambda: catalog.QUERIES[name](spark, folder)) for name in HEADLINE}
    times["feature_pack_all"] = clock(lambda: X.features(B.stored_bars(spark, folder), *X.ALPHA))
    grid = Grid()
    times["sweep_7680"] = clock(lambda: sweep(bars_with_funding(spark, folder), grid))
    n_bars = B.bars_1h(spark, folder).count()
    symbols = B.bars_1h(spark, folder).select("symbol").distinct().count()
    print(json.dumps({
        "metric": "headline queries, total wall clock", "value": round(sum(times.values()), 2), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")),
        "sweep_configs_per_sec": round(grid.size() * symbols / times["sweep_7680"], 1),
        "feature_rows_per_sec": round(n_bars / times["feature_pack_all"], 1),
        "barrier_rows_per_sec": round(n_bars / times["triple_barrier_long"], 1),
    }))


if __name__ == "__main__":
    main()

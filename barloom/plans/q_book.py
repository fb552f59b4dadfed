"""Order-book snapshots and their features."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import book as K
from barloom.functions.rolling import c
from barloom.plans.registry import query, report
from barloom.plans.sqltext import cols, sql
from barloom.sources import bars as B

LEVELS = 50
LARGE = 80.0


def snapshots(spark, folder):
    """One snapshot per symbol and hour from all its ticks: levels of 0.2% around the mean price, sizes summed.

    A tick rests at the level that its number names. Ticks are summed per level before they move, so a snapshot has LEVELS levels at most,
    however many ticks an hour has.
    """
    ticks = B.ticks(spark, folder).withColumn("ts", F.date_trunc("hour", "ts"))
    levels = ticks.groupBy("symbol", "ts", (c("ord") % LEVELS + 1).alias("i")).agg(
        F.sum("qty").alias("bid"), F.sum((c("qty") * 7) % 101).alias("ask"), F.sum("price").alias("_p"), F.count(F.lit(1)).alias("_n"))
    books = levels.groupBy("symbol", "ts").agg(
        F.sort_array(F.collect_list(F.struct("i", "bid", "ask"))).alias("_l"), (F.sum("_p") / F.sum("_n") * 10).alias("mid"))
    side = lambda s, size: F.transform("_l", lambda x: F.struct((c("mid") * F.exp(s * 0.002 * x["i"])).alias("price"), x[size].alias("qty")))
    return books.select("symbol", "ts", side(-1, "bid").alias("bids"), side(1, "ask").alias("asks"))


BOOK = [("tk", "SELECT symbol, date_trunc('hour', ts) AS ts, ord, price, qty FROM ticks"),
        ("md", "SELECT symbol, ts, avg(price) * 10 AS mid FROM tk GROUP BY 1, 2"),
        ("lv", f"SELECT symbol, ts, ord % {LEVELS} + 1 AS lvl, sum(qty) AS qty, sum((qty * 7) % 101) AS aq FROM tk GROUP BY 1, 2, 3"),
        ("bl", "SELECT lv.*, row_number() OVER (PARTITION BY lv.symbol, lv.ts ORDER BY lvl) AS i, mid * exp(-0.002::DOUBLE * lvl) AS bp, mid * exp(0.002::DOUBLE * lvl) AS ap FROM lv JOIN md USING (symbol, ts)"),
        ("bk", "SELECT *, (max(bp) OVER (PARTITION BY symbol, ts) + min(ap) OVER (PARTITION BY symbol, ts)) / 2 AS m FROM bl")]


def booked(name, exprs, ints="", nums=""):
    body = "SELECT symbol, ts, " + ", ".join(f"{e} AS {n}" for n, e in exprs.items()) + " FROM bk GROUP BY symbol, ts"
    names = [*ints.split(), *nums.split()]

    @query(name, sql("ticks", *BOOK, ("out_", body), out=cols("out_", ints=ints, nums=nums)))
    def run(spark, folder):
        features = {**K.all_features(LARGE)}
        df = snapshots(spark, folder).select("symbol", "ts", *[features[n.split(":")[0]].alias(n.split(":")[0]) for n in names])
        return report(df, "symbol", "ts", *names)

    return run


booked("book_spread", {"ob_best_bid": "arg_min(bp, i)", "ob_best_ask": "arg_min(ap, i)", "ob_spread_abs": "arg_min(ap - bp, i)",
                       "ob_spread_pct": "arg_min((ap - bp) / bp * 100, i)", "ob_mid_price": "any_value(m)"},
       nums="ob_best_bid ob_best_ask ob_spread_abs ob_spread_pct ob_mid_price")
_imb = {}
for n in (5, 10, 20):
    b, a = f"sum(qty) FILTER (WHERE i <= {n})", f"sum(aq) FILTER (WHERE i <= {n})"
    _imb.update({f"ob_bid_volume_{n}": b, f"ob_ask_volume_{n}": a, f"ob_total_volume_{n}": f"{b} + {a}",
                 f"ob_imbalance_pct_{n}": f"coalesce(({b} - {a}) / nullif({b} + {a}, 0) * 100, 0)", f"ob_imbalance_ratio_{n}": f"coalesce({b} / nullif({a}, 0), 1)",
                 f"ob_bid_vwap_{n}": f"coalesce(sum(bp * qty) FILTER (WHERE i <= {n}) / nullif({b}, 0), 0)",
                 f"ob_ask_vwap_{n}": f"coalesce(sum(ap * aq) FILTER (WHERE i <= {n}) / nullif({a}, 0), 0)"})
booked("book_imbalance", _imb, nums=" ".join(_imb))
_dep = {}
for p in (0.5, 1.0, 2.0):
    t = f"{int(p * 100)}bp"
    bl, al = f"bp >= m * (1 - {p}::DOUBLE / 100)", f"ap <= m * (1 + {p}::DOUBLE / 100)"
    _dep.update({f"ob_bid_depth_{t}": f"coalesce(sum(qty) FILTER (WHERE {bl}), 0)", f"ob_ask_depth_{t}": f"coalesce(sum(aq) FILTER (WHERE {al}), 0)",
                 f"ob_depth_imbalance_{t}": f"coalesce(sum(qty) FILTER (WHERE {bl}), 0) - coalesce(sum(aq) FILTER (WHERE {al}), 0)"})
booked("book_depth", _dep, nums=" ".join(_dep))
_big, _biga = f"FILTER (WHERE qty >= {LARGE})", f"FILTER (WHERE aq >= {LARGE})"
booked("book_large", {"ob_large_bid_count": f"count(*) {_big}", "ob_large_ask_count": f"count(*) {_biga}", "ob_large_imbalance": f"count(*) {_big} - count(*) {_biga}",
                      "ob_large_bid_volume": f"coalesce(sum(qty) {_big}, 0)", "ob_large_ask_volume": f"coalesce(sum(aq) {_biga}, 0)",
                      "ob_large_bid_dist_pct": f"coalesce((any_value(m) - max(bp) {_big}) / any_value(m) * 100, 0)",
                      "ob_large_ask_dist_pct": f"coalesce((min(ap) {_biga} - any_value(m)) / any_value(m) * 100, 0)"},
       ints="ob_large_bid_count ob_large_ask_count ob_large_imbalance",
       nums="ob_large_bid_volume ob_large_ask_volume ob_large_bid_dist_pct ob_large_ask_dist_pct")
booked("book_round_levels", {"ob_round_bid_volume": "coalesce(sum(qty) FILTER (WHERE trunc(bp)::INT % 100 = 0), 0)", "ob_round_ask_volume": "coalesce(sum(aq) FILTER (WHERE trunc(ap)::INT % 100 = 0), 0)",
                             "ob_round_bid_pct": "coalesce(sum(qty) FILTER (WHERE trunc(bp)::INT % 100 = 0) / nullif(sum(qty), 0) * 100, 0)",
                             "ob_round_ask_pct": "coalesce(sum(aq) FILTER (WHERE trunc(ap)::INT % 100 = 0) / nullif(sum(aq), 0) * 100, 0)"},
       nums="ob_round_bid_volume ob_round_ask_volume ob_round_bid_pct ob_round_ask_pct")

"""Order-book features over ``bids`` / ``asks``: arrays of (price, qty), best level first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.rolling import c, div


def total(levels: Column, value) -> Column:
    return F.aggregate(levels, F.lit(0.0), lambda a, x: a + value(x))


def qty(x):
    return x["qty"]


def mid() -> Column:
    return (c("bids")[0]["price"] + c("asks")[0]["price"]) / 2


def spread() -> dict:
    bid, ask = c("bids")[0]["price"], c("asks")[0]["price"]
    return {"ob_best_bid": bid, "ob_best_ask": ask, "ob_spread_abs": ask - bid, "ob_spread_pct": div(ask - bid, bid) * 100,
            "ob_mid_price": (bid + ask) / 2}


def imbalance(n: int) -> dict:
    """Volume balance and volume-weighted prices of the best ``n`` levels."""
    bids, asks = F.slice("bids", 1, n), F.slice("asks", 1, n)
    b, a = total(bids, qty), total(asks, qty)
    value = lambda x: x["price"] * x["qty"]
    return {
        f"ob_imbalance_ratio_{n}": F.coalesce(div(b, a), F.lit(1.0)),
        f"ob_imbalance_pct_{n}": F.coalesce(div(b - a, b + a) * 100, F.lit(0.0)),
        f"ob_bid_volume_{n}": b, f"ob_ask_volume_{n}": a, f"ob_total_volume_{n}": b + a,
        f"ob_bid_vwap_{n}": F.coalesce(div(total(bids, value), b), F.lit(0.0)),
        f"ob_ask_vwap_{n}": F.coalesce(div(total(asks, value), a), F.lit(0.0)),
    }


def large_orders(threshold: float) -> dict:
    big = lambda side: F.filter(c(side), lambda x: x["qty"] >= threshold)
    bids, asks = big("bids"), big("asks")
    price = lambda x: x["price"]
    near_bid, near_ask = F.array_max(F.transform(bids, price)), F.array_min(F.transform(asks, price))
    return {
        "ob_large_bid_count": F.size(bids), "ob_large_ask_count": F.size(asks),
        "ob_large_bid_volume": total(bids, qty), "ob_large_ask_volume": total(asks, qty),
        "ob_large_bid_dist_pct": F.coalesce(div(mid() - near_bid, mid()) * 100, F.lit(0.0)),
        "ob_large_ask_dist_pct": F.coalesce(div(near_ask - mid(), mid()) * 100, F.lit(0.0)),
        "ob_large_imbalance": F.size(bids) - F.size(asks),
    }


def depth(percent: float) -> dict:
    """Volume and level count within a percentage of the mid price."""
    tag = f"{int(percent * 100)}bp"
    bids = F.filter("bids", lambda x: x["price"] >= mid() * (1 - percent / 100))
    asks = F.filter("asks", lambda x: x["price"] <= mid() * (1 + percent / 100))
    b, a = total(bids, qty), total(asks, qty)
    return {f"ob_bid_depth_{tag}": b, f"ob_ask_depth_{tag}": a, f"ob_depth_imbalance_{tag}": b - a,
            f"ob_bid_levels_{tag}": F.size(bids), f"ob_ask_levels_{tag}": F.size(asks)}


def round_levels() -> dict:
    """Volume resting at whole hundreds."""
    at = lambda side: F.filter(c(side), lambda x: x["price"].cast("int") % 100 == 0)
    b, a = total(at("bids"), qty), total(at("asks"), qty)
    return {
        "ob_round_bid_volume": b, "ob_round_ask_volume": a,
        "ob_round_bid_pct": F.coalesce(div(b, total(c("bids"), qty)) * 100, F.lit(0.0)),
        "ob_round_ask_pct": F.coalesce(div(a, total(c("asks"), qty)) * 100, F.lit(0.0)),
    }


def all_features(large: float = 10.0) -> dict:
    out = {**spread(), **large_orders(large), **round_levels()}
    for n in (5, 10, 20):
        out.update(imbalance(n))
    for p in (0.5, 1.0, 2.0):
        out.update(depth(p))
    return out

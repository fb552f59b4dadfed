"""Building blocks of the oracle SQL: the market tables as CTEs and frame shorthands."""

from __future__ import annotations

CTES = {
    "ticks": """SELECT event_type AS symbol, ts, event_id AS ord, value AS price,
  CAST(props::json->>'k' AS DOUBLE) AS qty FROM events""",
    "bars": """SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(price, ord) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, ord) AS close, sum(qty) AS volume FROM ticks GROUP BY 1, 2""",
    "daily_src": """SELECT l_returnflag AS symbol, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS ts,
  l_extendedprice / l_quantity AS price, l_quantity AS qty,
  row_number() OVER (PARTITION BY l_returnflag, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber,
    l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS ord FROM lineitem""",
    "daily": """SELECT symbol, ts, arg_min(price, ord) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, ord) AS close, sum(qty) AS volume FROM daily_src GROUP BY 1, 2""",
    "vix_src": """SELECT CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS ts, avg(o_totalprice) AS lvl
  FROM orders GROUP BY 1""",
    "vix": "SELECT ts, 10 + 25 * lvl / (SELECT max(lvl) FROM vix_src) AS vix FROM vix_src",
    "donors": """SELECT symbol AS taker, coalesce(lead(symbol) OVER (ORDER BY symbol), min(symbol) OVER ()) AS donor
  FROM (SELECT DISTINCT event_type AS symbol FROM events)""",
    "funding": """SELECT d.taker AS symbol, make_timestamp(((b.block + 1) * 28800000000)::BIGINT) AS ts,
  (b.price - 50) / 1e5 AS funding_rate
  FROM (SELECT symbol, CAST(floor(epoch(ts) / 28800) AS BIGINT) AS block, arg_max(price, ord) AS price
        FROM ticks GROUP BY 1, 2) b JOIN donors d ON d.donor = b.symbol""",
    "open_interest": """SELECT symbol, ts, sum(n) OVER (PARTITION BY symbol ORDER BY ts) AS open_interest FROM
  (SELECT symbol, date_trunc('hour', ts) AS ts, count(*) AS n FROM ticks GROUP BY 1, 2)""",
    "bars_f": """SELECT b.*, f.funding_rate, o.open_interest FROM bars b
  ASOF LEFT JOIN funding f ON b.symbol = f.symbol AND b.ts >= f.ts
  ASOF LEFT JOIN open_interest o ON b.symbol = o.symbol AND b.ts >= o.ts""",
}
NEEDS = {
    "bars": ["ticks"], "daily": ["daily_src"], "vix": ["vix_src"], "funding": ["ticks", "donors"],
    "open_interest": ["ticks"], "bars_f": ["bars", "funding", "open_interest"],
}
P = "PARTITION BY symbol ORDER BY ts"


def _expand(names, seen):
    for name in names:
        _expand(NEEDS.get(name, []), seen)
        if name not in seen:
            seen.append(name)
    return seen


def sql(base: str, *steps: tuple, out: str) -> str:
    """WITH the named market tables, then ``(name, body)`` steps, then the final SELECT."""
    parts = [f"{n} AS ({CTES[n]})" for n in _expand(base.split(), [])]
    parts += [f"{name} AS ({body})" for name, body in steps]
    return "WITH " + ",\n".join(parts) + "\n" + out


def cols(source: str, keys: str = "symbol", ts: str = "ts", ints: str = "", nums: str = "",
         where: str = "", digits: int = 6) -> str:
    """Final SELECT in the same shape as ``registry.report``."""
    items = [k for k in keys.split()]
    items += [f"strftime({t}, '%Y-%m-%d %H:%M:%S') AS {t}" for t in ts.split()]
    items += [f"CAST({i} AS BIGINT) AS {i}" for i in ints.split()]
    for x in nums.split():
        name, _, places = x.partition(":")
        items.append(f"round(CAST({name} AS DOUBLE), {places or digits}) + CAST(0 AS DOUBLE) AS {name}")
    tail = f" WHERE {where}" if where else ""
    return f"SELECT {', '.join(items)} FROM {source}{tail}"


def lag(x: str, k: int = 1, p: str = P) -> str:
    return f"lag({x}, {k}) OVER ({p})"


def lead(x: str, k: int = 1, p: str = P) -> str:
    return f"lead({x}, {k}) OVER ({p})"


def roll(agg: str, x: str, n: int, p: str = P) -> str:
    """Rolling aggregate over the last n rows, however many are present."""
    return f"{agg}({x}) OVER ({p} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int, need: int | None = None, p: str = P) -> str:
    """Rolling aggregate that is NULL below ``need`` (default n) non-null values."""
    return f"(CASE WHEN {roll('count', x, n, p)} >= {need or n} THEN {roll(agg, x, n, p)} END)"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"

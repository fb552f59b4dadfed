"""Strategy sweeps: what differs between configurations is computed once per distinct part.

Exits depend only on (target, stop, exit mode, trail, hold, slippage), entries only on (percentile,
direction, hour filter), sizes only on the sizing rule. Entry rows are multiplied by each part
where it starts to matter; bars are never collected.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.rolling import c, div, flag
from barloom.operators import trades as T
from barloom.operators.chunks import HOURLY, Span, chunked, clean
from barloom.operators.features import LOOKBACK, atr, scores
from barloom.operators.ranks import quantiles, unpivoted
from barloom.session import cut_lineage


@dataclass(frozen=True)
class Grid:
    """Axes of a sweep; the configurations are their product."""

    barriers: tuple = ((1.5, 1.0), (2.0, 1.0), (2.0, 1.5), (2.5, 1.5), (3.0, 1.5))
    percentiles: tuple = (0.05, 0.10, 0.20)
    fees: tuple = (("maker", 0.02, 0.01), ("vip", 0.01, 0.005), ("zero_fee", 0.0, 0.003), ("rebate", -0.002, 0.002))
    exits: tuple = (("fixed", 1.0), ("trailing", 0.75), ("trailing", 1.0), ("breakeven", 1.0))
    directions: tuple = ("both", "short")
    holds: tuple = (12, 18)
    hours: tuple = (("allhours", -1, -1), ("skip0610", 6, 10))
    sizings: tuple = ((False, False), (True, False), (False, True), (True, True))
    win_rate: float = 0.50
    payoff: float = 1.65
    capital: float = 25_000.0
    risk: float = 0.01
    cooldown: int = 0

    def size(self) -> int:
        axes = (self.barriers, self.percentiles, self.fees, self.exits, self.directions, self.holds, self.hours, self.sizings)
        return reduce(lambda n, a: n * len(a), axes, 1)

    def entry_rows(self) -> list:
        return [(p, d, h, a, b) for p in self.percentiles for d in self.directions for h, a, b in self.hours]

    def exit_rows(self) -> list:
        return [(tp, sl, m, t, h, f, fee, slip) for tp, sl in self.barriers for m, t in self.exits for h in self.holds for f, fee, slip in self.fees]


SMALL = Grid(barriers=((2.0, 1.0), (3.0, 1.5)), percentiles=(0.10, 0.20), fees=(("maker", 0.02, 0.01),),
             exits=(("fixed", 1.0), ("trailing", 0.75)), directions=("both", "short"), holds=(12,),
             hours=(("allhours", -1, -1),), sizings=((False, False), (False, True)))


def _axis(rows: list, names: list):
    """Literal array of structs, exploded next to each row: the grid never needs a join."""
    return F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows]))


def scored_frame(bars: DataFrame, hold: int, span: Span = HOURLY) -> DataFrame:
    """Bars with ATR, scores, row number, hour and the next ``hold`` bars."""
    df = chunked(bars, before=LOOKBACK["scores"], after=hold, span=span)
    df = T.with_future(scores(atr(df)), hold)
    return df.where("_own").select(
        "symbol", "ts", F.col("_rn").alias("entry_rn"), "close", "atr_14", "atr_pct", "long_prob", "short_prob",
        F.hour("ts").alias("hour"), "_future")


def entry_signals(frame: DataFrame, thresholds: DataFrame, grid: Grid) -> DataFrame:
    """One row per entry, side and signal configuration; the stronger side wins a conflict."""
    names = {p: f"{int(round(p * 100))}" for p in grid.percentiles}
    rows = [(i, *r) for i, r in enumerate(grid.entry_rows())]
    low = names[max(grid.percentiles)]
    df = frame.join(thresholds, "symbol").where(
        (c("atr_14") > 0) & ((c("long_prob") >= c(f"l_{low}")) | (c("short_prob") >= c(f"s_{low}"))))
    df = df.withColumn("_g", _axis(rows, ["e", "percentile", "direction", "hours", "skip_from", "skip_to"])).select("*", "_g.*")
    cut = lambda kind: reduce(
        lambda a, p: F.when(c("percentile") == p, c(f"{kind}_{names[p]}")).otherwise(a), grid.percentiles, F.lit(None).cast("double"))
    df = df.withColumns({
        "_long": flag((c("long_prob") >= cut("l")) & (c("direction") != "short")),
        "_short": flag((c("short_prob") >= cut("s")) & (c("direction") != "long")),
    })
    side = F.when((c("_long") == 1) & ((c("_short") == 0) | (c("long_prob") >= c("short_prob"))), 1).when(c("_short") == 1, -1)
    open_hour = ~((c("hour") >= c("skip_from")) & (c("hour") < c("skip_to")))
    return df.withColumn("side", side).where(c("side").isNotNull() & open_hour).drop(
        "_g", "_long", "_short", *[x for x in df.columns if x.startswith(("l_", "s_"))])


def score_thresholds(frame: DataFrame, percentiles) -> DataFrame:
    """Exact per-symbol cut-offs of both scores, columns ``l_5``, ``s_5`` ..."""
    tall = unpivoted(frame, ["long_prob", "short_prob"], ["symbol"])
    cuts = quantiles(tall, "x", {f"_{int(round(p * 100))}": 1 - p for p in percentiles}, ["symbol", "feature"])
    side = lambda k, p: F.max(F.when(F.col("feature") == k, F.col(f"_{int(round(p * 100))}"))).alias(f"{k[0]}_{int(round(p * 100))}")
    return cuts.groupBy("symbol").agg(*[side(k, p) for k in ("long_prob", "short_prob") for p in percentiles])


#: Numbers of a run's entry rule, exit rule and size rule; rows are shuffled by these and named at the end.
RUN = ["symbol", "e", "x"]
ENTRY, EXIT, SIZE = ["percentile", "direction", "hours"], ["tp_mult", "sl_mult", "exit_mode", "trail_mult", "hold", "fee_tier"], ["kelly", "vol_scale"]
CONFIG = [*ENTRY, *EXIT, *SIZE]


def named(df: DataFrame, grid: Grid) -> DataFrame:
    """The settings of each run instead of its numbers."""
    for number, names, rows in (("e", ENTRY, grid.entry_rows()), ("x", EXIT, grid.exit_rows()), ("z", SIZE, list(grid.sizings))):
        at = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])
        df = df.withColumn("_s", F.element_at(at, c(number) + 1)).withColumns({n: c(f"_s.{n}") for n in names}).drop("_s", number)
    return df


def _numbered_trades(bars: DataFrame, grid: Grid, span: Span) -> DataFrame:
    hold = max(grid.holds)
    frame = cut_lineage(scored_frame(bars, hold, span))
    slim = frame.select("symbol", "long_prob", "short_prob", "atr_pct")
    entries = cut_lineage(entry_signals(frame.drop("_future"), score_thresholds(slim, grid.percentiles), grid).select("symbol", "entry_rn", "side", "e"))

    candidates = entries.select("symbol", "entry_rn", "side").distinct().join(
        frame.select("symbol", "entry_rn", "ts", "close", "atr_14", "atr_pct", "_future"), ["symbol", "entry_rn"])
    candidates = candidates.withColumn("_x", _axis([(i, *r) for i, r in enumerate(grid.exit_rows())], ["x", *EXIT, "fee", "slip"])).select("*", "_x.*").drop("_x")
    candidates = candidates.withColumns({
        "entry_price": c("close") * (1 + c("side") * c("slip") / 100), "atr_entry": c("atr_14"),
        "cost": 2 * (c("fee") + c("slip")) / 100,
    })
    exits = T.resolve_exits(candidates).select(
        "symbol", "entry_rn", "side", "x", "ts", "atr_pct", "entry_price", "atr_entry", "sl_mult", "cost", "bars_held", "reason", "gross_ret", "funding_ret")
    # Rows of a run meet by its numbers first; what the trades look like is joined to those that are taken.
    runs = cut_lineage(exits)
    taken = T.one_at_a_time(entries.join(runs.select("symbol", "entry_rn", "side", "x", "bars_held"), ["symbol", "entry_rn", "side"]), RUN, hold, grid.cooldown)
    taken = taken.where("bars_held is not null").drop("bars_held").join(runs, ["symbol", "entry_rn", "side", "x"])

    median = quantiles(slim, "atr_pct", {"atr_median": 0.5}, ["symbol"])
    sized = taken.join(median, "symbol").withColumn("_z", _axis([(i, *r) for i, r in enumerate(grid.sizings)], ["z", *SIZE])).select("*", "_z.*").drop("_z")
    kelly = T.half_kelly(F.lit(grid.win_rate), F.lit(grid.payoff))
    risk = F.when(c("kelly"), kelly).otherwise(grid.risk) * F.when(
        c("vol_scale"), T.volatility_scale(c("atr_pct"), c("atr_median"))).otherwise(1.0)
    sized = sized.withColumn("share", T.risk_fraction(risk)).withColumn(
        "growth", c("share") * (c("gross_ret") + c("funding_ret") - c("cost"))).drop("sl_mult", *SIZE)
    return clean(T.account_curve(cut_lineage(sized), "growth", [*RUN, "z"], grid.capital))


def sweep_trades(bars: DataFrame, grid: Grid, span: Span = HOURLY) -> DataFrame:
    """Every trade of every configuration, with compounded capital and the drawdown stop applied."""
    return named(_numbered_trades(bars, grid, span), grid)


def sweep(bars: DataFrame, grid: Grid = Grid(), span: Span = HOURLY) -> DataFrame:
    """One row of statistics per symbol and configuration."""
    stats = T.trade_stats(_numbered_trades(bars, grid, span), [*RUN, "z"], grid.capital)
    return named(stats, grid).select("symbol", *CONFIG, *[x for x in stats.columns if x not in (*RUN, "z")])

"""From signals and entries to trades, equity curves and performance, without bar loops."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.rolling import ahead, c, div, flag, lag, lead
from barloom.operators.chunks import HOURLY, SharedWindow, Span, chunked, owned, prefix
from barloom.session import cut_lineage

W = SharedWindow()
NEVER = 9_000_000_000_000_000_000
ROWS_PER_PART = 512
HOURS_PER_YEAR = 365.25 * 24


# --- signal backtest ------------------------------------------------------------------------

def running_product(df: DataFrame, factor: str, out: str, key=("symbol",), order=("ts",)) -> DataFrame:
    """Cumulative product by a scan of logs; negative and zero factors are tracked apart."""
    x = c(factor)
    df = prefix(df, {
        "_log": ("sum", F.when(x != 0, F.ln(F.abs(x))).otherwise(0.0)),
        "_neg": ("sum", F.when(x < 0, 1).otherwise(0)),
        "_nil": ("sum", F.when(x == 0, 1).otherwise(0)),
    }, key=key, order=order)
    sign = F.when(c("_neg") % 2 == 1, -1.0).otherwise(1.0)
    return df.withColumn(out, F.when(c("_nil") > 0, 0.0).otherwise(sign * F.exp("_log"))).drop("_log", "_neg", "_nil")


def signal_backtest(df: DataFrame, signal: str = "signal", fee: float = 0.0004, capital: float = 10_000.0,
                    price: str = "open", span: Span = HOURLY, key=("symbol",)) -> DataFrame:
    """Trade the signal on the next bar and earn from the bar after; fee on every position change.

    Keeps ``_chunk`` and ``_rn`` for a following scan.
    """
    df = chunked(df, before=3, span=span, key=key)
    w = W if tuple(key) == ("symbol",) else _window(key)
    df = df.withColumn("position", F.coalesce(lag(F.coalesce(c(signal), F.lit(0)), 1, w), F.lit(0)))
    df = df.withColumns({"_before": lag("position", 1, w), "_move": div(price, lag(price, 1, w)) - 1})
    df = df.withColumns({
        "position_change": c("position") - F.coalesce(c("_before"), F.lit(0)),
        "strategy_ret": c("_before") * c("_move"),
    })
    df = df.withColumn("net_ret", c("strategy_ret") - F.when(c("position_change") != 0, fee).otherwise(0.0))
    df = owned(df.withColumn("_factor", F.coalesce(1 + c("net_ret"), F.lit(1.0))).drop("_before", "_move"))
    df = running_product(df, "_factor", "_growth", key=key)
    return df.withColumn("equity", capital * c("_growth")).drop("_factor", "_growth")


def _window(key):
    from barloom.operators.chunks import ordered
    return ordered("ts", key)


def position_trades(positions: DataFrame, fee: float = 0.0004, capital: float = 10_000.0, price: str = "open",
                    span: Span = HOURLY, key=("symbol",)) -> DataFrame:
    """Runs of one position become trades; a flip closes and reopens, an open tail is left out."""
    w = W if tuple(key) == ("symbol",) else _window(key)
    turns = positions.where("position_change <> 0").select(
        *key, "ts", F.col("_rn").alias("row"), "position", F.col(price).alias("entry_price"))
    turns = chunked(turns, after=1, span=span, key=key).withColumns({
        "exit_price": lead("entry_price", 1, w), "exit_ts": lead("ts", 1, w), "exit_row": lead("row", 1, w),
    })
    runs = owned(turns).where("position <> 0 and exit_row is not null").drop("_chunk", "_rn")
    gain = F.when(c("position") == 1, div("exit_price", "entry_price") - 1).otherwise(div("entry_price", "exit_price") - 1)
    return runs.withColumn("pnl_pct", gain - 2 * fee).select(
        *key, F.col("ts").alias("entry_ts"), "exit_ts", "position", "entry_price", "exit_price",
        (c("exit_row") - c("row")).alias("duration"), "pnl_pct", (c("pnl_pct") * capital).alias("pnl"))


def drawdowns(curve: DataFrame, equity: str = "equity", key=("symbol",), order=("ts",), position: str = "_rn") -> DataFrame:
    """Running peak, drawdown share, and bars since the drawdown was last within 1%."""
    df = prefix(curve, {"peak": ("max", equity)}, key=key, order=order)
    df = df.withColumn("drawdown", div(c(equity) - c("peak"), "peak"))
    deep = c("drawdown") < -0.01
    df = prefix(df, {"_calm": ("last", F.when(~deep, c(position)))}, key=key, order=order)
    return df.withColumn(
        "dd_bars", F.when(deep, c(position) - F.coalesce(c("_calm"), F.lit(-1))).otherwise(0)).drop("_calm")


def performance(curve: DataFrame, trades: DataFrame, periods: float = HOURS_PER_YEAR, key=("symbol",)) -> DataFrame:
    """One row per run: growth, volatility, Sharpe, Calmar, drawdown and trade statistics."""
    keys = list(key)
    net = F.coalesce(c("net_ret"), F.lit(0.0))
    bars = curve.groupBy(*keys).agg(
        F.max_by("equity", "ts").alias("final_equity"), F.min_by("equity", "ts").alias("_first"),
        (F.count(F.lit(1)) - 1).alias("_steps"), F.avg(net).alias("_mean"), F.stddev_samp(net).alias("_std"),
        F.min("drawdown").alias("max_drawdown"), F.max("dd_bars").alias("max_dd_bars"))
    won, lost = F.when(c("pnl") > 0, c("pnl")), F.when(c("pnl") < 0, c("pnl"))
    log = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"), F.count(won).alias("_wins"), F.avg(won).alias("avg_win"),
        F.avg(lost).alias("avg_loss"), F.sum(won).alias("_won"), F.sum(lost).alias("_lost"),
        F.count(lost).alias("n_losses"), F.avg("duration").alias("avg_duration"), F.max("duration").alias("max_duration"))
    df = bars.join(log, keys, "left")
    growth, years = div("final_equity", "_first"), c("_steps") / periods
    return df.withColumns({
        "total_return": growth - 1,
        "cagr_log": F.when(years > 0, div(F.ln(growth), years)),
        "volatility": c("_std") * F.lit(periods ** 0.5),
        "sharpe": div(c("_mean") * periods, c("_std") * F.lit(periods ** 0.5)),
        "win_rate": div("_wins", "n_trades"),
        "profit_factor": F.abs(div("_won", "_lost")),
    }).withColumns({
        "n_trades": F.coalesce(c("n_trades"), F.lit(0)),
        "cagr": F.exp("cagr_log") - 1,
        "calmar": F.abs(div(F.exp("cagr_log") - 1, "max_drawdown")),
    }).drop("_first", "_steps", "_mean", "_std", "_wins", "_won", "_lost")


# --- barrier exits --------------------------------------------------------------------------

def with_future(df: DataFrame, hold: int) -> DataFrame:
    """The next ``hold`` bars as an array; the frame must be chunked with ``after >= hold``."""
    cost = F.coalesce(c("funding_rate"), F.lit(0.0)) if "funding_rate" in df.columns else F.lit(0.0)
    bar = F.struct("high", "low", "close", cost.alias("funding"))
    return df.withColumn("_future", F.collect_list(bar).over(ahead(W, hold)))


def resolve_exits(df: DataFrame) -> DataFrame:
    """Exit of every entry from its future bars.

    Reads ``side`` (+1/-1), ``entry_price``, ``atr_entry``, ``tp_mult``, ``sl_mult``, ``hold``,
    ``exit_mode`` (fixed / trailing / breakeven), ``trail_mult`` and ``_future``. Within a bar the
    stop is tested first, then the target, then the time limit; a trailing or break-even stop moves
    only after the bar has been tested. Entries whose series ends first stay open (NULL exit).
    """
    s, atr, entry = c("side"), c("atr_entry"), c("entry_price")
    df = df.withColumns({
        "_tp": entry + s * c("tp_mult") * atr,
        "_sl": entry - s * c("sl_mult") * atr,
        "_gap": c("trail_mult") * atr,
    })
    state = F.struct(
        F.lit(0).alias("k"), c("_sl").alias("stop"), F.lit(0).alias("at"),
        F.lit(None).cast("double").alias("price"), F.lit(None).cast("string").alias("reason"))

    def step(a, bar):
        best = F.when(s > 0, bar["high"]).otherwise(bar["low"])
        worst = F.when(s > 0, bar["low"]).otherwise(bar["high"])
        k = a["k"] + 1
        stopped, reached = s * (worst - a["stop"]) <= 0, s * (best - c("_tp")) >= 0
        late = k >= c("hold")
        trailed = s * F.greatest(s * a["stop"], s * (best - s * c("_gap")))
        secured = F.when(s * (best - (entry + s * c("_gap"))) >= 0, s * F.greatest(s * a["stop"], s * entry)).otherwise(a["stop"])
        moved = F.when(c("exit_mode") == "trailing", trailed).when(c("exit_mode") == "breakeven", secured).otherwise(a["stop"])
        ends = stopped | reached | late
        fresh = F.struct(
            k.alias("k"), moved.alias("stop"), F.when(ends, k).otherwise(0).alias("at"),
            F.when(stopped, a["stop"]).when(reached, c("_tp")).when(late, bar["close"]).alias("price"),
            F.when(stopped, "SL").when(reached, "TP").when(late, "TIMEOUT").alias("reason"))
        return F.when(a["at"] > 0, a).otherwise(fresh)

    df = df.withColumn("_exit", F.aggregate("_future", state, step))
    held = F.when(c("_exit.at") > 0, c("_exit.at"))
    return df.withColumns({
        "bars_held": held, "exit_price": c("_exit.price"), "reason": c("_exit.reason"),
    }).withColumn(
        "gross_ret", div(s * (c("exit_price") - entry), entry)
    ).withColumn(
        "funding_ret",
        -s * F.aggregate(F.slice("_future", 1, F.coalesce("bars_held", F.lit(0))), F.lit(0.0), lambda a, b: a + b["funding"])
    ).drop("_exit", "_tp", "_sl", "_gap", "_future")


class _Parts:
    """Whole (run, part) groups of an Arrow table sorted by row number, and for every entry the next one it leaves free."""

    PLACE = 1 << 40  # row numbers are below it

    def __init__(self, table: pa.Table):
        self.first = np.flatnonzero(table["_first"].to_numpy(zero_copy_only=False))
        self.end = np.append(self.first[1:], table.num_rows)
        self.group = np.repeat(np.arange(len(self.first)), self.end - self.first)
        self.rn, self.free = (table[x].to_numpy(zero_copy_only=False).astype(np.int64) for x in ("entry_rn", "_free"))
        self.order = self.group * self.PLACE + self.rn
        self.next = self.find(self.group, self.free)

    def find(self, group: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first entry of a group at or after a row number; the number of entries if there is none."""
        at = np.searchsorted(self.order, group * self.PLACE + np.minimum(place, self.PLACE - 1))
        return np.where(at < self.end[group], at, len(self.rn))

    def leaving(self) -> np.ndarray:
        """The row from which the account is free after the part, if it takes the entry: links are doubled until all have ended."""
        here = np.arange(len(self.rn))
        last = np.where(self.next < len(here), self.next, here)
        while True:
            further = last[last]
            if np.array_equal(further, last):
                return self.free[last]
            last = further

    def taken(self, free: np.ndarray) -> np.ndarray:
        """Which entries are taken if the account of each group is free from row ``free``; all groups go on hand in hand."""
        kept = np.zeros(len(self.rn), bool)
        at = self.find(np.arange(len(self.first)), free)
        while len(at := at[at < len(kept)]):
            kept[at] = True
            at = self.next[at]
        return kept


def _by_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups: a row with ``_first`` begins one, and a group may reach over batches."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        begins = np.flatnonzero(batch.column("_first").to_numpy(zero_copy_only=False))
        if len(begins):
            if held or begins[-1]:
                yield pa.Table.from_batches([*held, batch.slice(0, begins[-1])]).combine_chunks()
            held = [batch.slice(begins[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def one_at_a_time(entries: DataFrame, key, max_hold: int, cooldown: int = 0) -> DataFrame:
    """Keep the entries a trader holding one position at a time would take.

    ``entry_rn`` and ``bars_held`` (NULL: never closes) say when each entry frees the account. Every entry links to the next one
    after that row; links are doubled inside parts of ROWS_PER_PART rows. The account state at the edge of a part is "free from row
    x", and x is less than ``max_hold`` + cooldown rows past the edge, so a part is a table of that many states. These tables are
    chained along a run, and each part is gone through with its true state. The work is linear in the entries.
    """
    key, names = list(key), entries.columns
    reach = max_hold + cooldown + 1
    group = [*key, "_part"]
    free = F.coalesce(c("entry_rn") + c("bars_held") + 1 + cooldown, F.lit(NEVER))
    placed = entries.withColumns({
        "entry_rn": c("entry_rn").cast("bigint"), "_free": free.cast("bigint"),
        "_part": F.floor(c("entry_rn") / F.lit(ROWS_PER_PART)).cast("bigint")})
    first = F.row_number().over(Window.partitionBy(*group).orderBy("entry_rn")) == 1

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_groups(batches):
            parts = _Parts(table)
            out = parts.leaving()
            groups = np.arange(len(parts.first))
            edge = parts.rn[parts.first] // ROWS_PER_PART * ROWS_PER_PART
            states = edge[:, None] + np.arange(reach + 1)
            at = parts.find(np.repeat(groups, reach + 1), states.ravel())
            after = np.where(at < len(out), out[np.minimum(at, len(out) - 1)], states.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(groups) + 1) * (reach + 1), pa.int32()), pa.array(after))
            rows = table.select(group).take(pa.array(parts.first))
            yield from rows.append_column("after", lists).to_batches()

    slim = placed.select(*group, "entry_rn", "_free").withColumn("_first", first)
    fields = [f for f in placed.schema.fields if f.name in group]
    summary = slim.mapInArrow(summed, T.StructType([*sorted(fields, key=lambda f: group.index(f.name)), T.StructField("after", T.ArrayType(T.LongType()))]))
    chain = summary.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(c("_part").alias("part"), "after"))).alias("_chain"))
    start = F.struct(F.lit(0).cast("bigint").alias("free"), F.expr("cast(array() as array<struct<part: bigint, free: bigint>>)").alias("seen"))

    def link(a, s):
        late = F.greatest(a["free"] - s["part"] * ROWS_PER_PART, F.lit(0))
        left = F.when(late > reach, a["free"]).otherwise(F.element_at(s["after"], (F.least(late, F.lit(reach)) + 1).cast("int")))
        seen = F.array_append(a["seen"], F.struct(s["part"].alias("part"), a["free"].alias("free")))
        return F.struct(left.alias("free"), seen.alias("seen"))

    states = chain.select(*key, F.explode(F.aggregate("_chain", start, link, lambda a: a["seen"])).alias("_s")).select(
        *key, c("_s.part").alias("_part"), c("_s.free").alias("_in"))

    def gone_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_groups(batches):
            parts = _Parts(table)
            kept = parts.taken(table["_in"].to_numpy(zero_copy_only=False).astype(np.int64)[parts.first])
            yield from table.select(names).filter(pa.array(kept)).to_batches()

    joined = placed.join(states, group).withColumn("_first", first)
    return joined.mapInArrow(gone_through, placed.select(*names).schema)


# --- sizing, equity, statistics -------------------------------------------------------------

def risk_fraction(risk: Column, max_share: float = 0.25) -> Column:
    """Share of capital whose loss at the stop equals the risk, capped."""
    distance = div(c("sl_mult") * c("atr_entry"), "entry_price")
    return F.least(risk / F.greatest(distance, F.lit(1e-6)), F.lit(max_share))


def half_kelly(win_rate: Column, payoff: Column) -> Column:
    full_kelly = (win_rate * payoff - (1 - win_rate)) / payoff
    return F.greatest(F.lit(0.005), F.least(full_kelly, F.lit(0.25))) * 0.5


def volatility_scale(atr_pct: Column, median: Column) -> Column:
    """Smaller size when volatility is above its median, between half and double."""
    return F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.coalesce(div(F.lit(1.0), atr_pct / (median + 1e-10)), F.lit(2.0))))


def trade_equity(trades: DataFrame, growth: str, key, capital: float, order: str = "entry_rn") -> DataFrame:
    """Compounded equity after each trade from its capital growth share; keeps ``_chunk``."""
    df = trades.withColumn("_chunk", F.floor(c(order) / F.lit(ROWS_PER_PART)).cast("bigint")).withColumn("_f", 1 + c(growth))
    df = running_product(df, "_f", "_g", key=key, order=order)
    return df.withColumn("capital", capital * c("_g")).drop("_f", "_g")


def stop_at_drawdown(df: DataFrame, key, limit: float = 0.10, capital: float = 25_000.0, order: str = "entry_rn") -> DataFrame:
    """Keep trades up to and including the first one that breaches the drawdown limit."""
    df = prefix(df, {"peak": ("max", "capital")}, key=key, order=order)
    df = df.withColumn("peak", F.greatest("peak", F.lit(capital)))
    broke = flag(c("capital") < c("peak") * (1 - limit))
    df = prefix(df, {"_broke": ("sum", broke)}, key=key, order=order)
    df = df.withColumn("_earlier", c("_broke") - broke)
    return df.where("_earlier = 0").withColumn("dd", (c("peak") - c("capital")) / (c("peak") + 1e-10)).drop("_broke", "_earlier")


def account_curve(trades: DataFrame, growth: str, key, capital: float = 25_000.0, limit: float = 0.10, order: str = "entry_rn") -> DataFrame:
    """``capital``, ``pnl``, ``peak`` and ``dd`` of each trade, up to and including the first that breaches the drawdown limit.

    Equals ``trade_equity`` followed by ``stop_at_drawdown`` with one scan for both: a part of a run is the sum of its log factors and
    their highest running sum, and these compose. A factor of zero or less is a breach, so nothing after it matters. ``trades`` is
    read twice: give a written table.
    """
    key = list(key)
    rows = trades.withColumn("_chunk", F.floor(c(order) / F.lit(ROWS_PER_PART)).cast("bigint")).withColumn("_f", 1 + c(growth))
    log = F.when(c("_f") > 0, F.ln("_f")).otherwise(0.0)
    w = Window.partitionBy(*key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum(log).over(w)).withColumn("_top", F.max("_sum").over(w))
    parts = rows.groupBy(*key, "_chunk").agg(F.max_by("_sum", order).alias("_s"), F.max("_sum").alias("_t"))
    before = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_in", F.coalesce(F.sum("_s").over(before), F.lit(0.0)))
    parts = parts.withColumn("_high", F.greatest(F.coalesce(F.max(c("_in") + c("_t")).over(before), F.lit(0.0)), F.lit(0.0)))
    rows = rows.join(parts.select(*key, "_chunk", "_in", "_high"), [*key, "_chunk"])
    rows = rows.withColumns({
        "capital": capital * F.exp(c("_in") + c("_sum")) * F.when(c("_f") > 0, 1.0).otherwise(c("_f")),
        "peak": capital * F.exp(F.greatest(c("_high"), c("_in") + c("_top")))})
    rows = rows.withColumn("_broke", F.when(c("capital") < c("peak") * (1 - limit), c(order)))
    broke = rows.groupBy(*key).agg(F.min("_broke").alias("_stop"))
    rows = rows.join(broke, key).where(c("_stop").isNull() | (c(order) <= c("_stop")))
    return rows.withColumns({
        "pnl": c("capital") - F.when(c("_f") != 0, c("capital") / c("_f")), "dd": (c("peak") - c("capital")) / (c("peak") + 1e-10),
    }).drop("_chunk", "_f", "_sum", "_top", "_in", "_high", "_broke", "_stop")


def trade_stats(trades: DataFrame, key, capital: float = 25_000.0, order: str = "entry_rn") -> DataFrame:
    """Per run: counts by side and reason, win rate, profit factor, drawdown, Sharpe."""
    won, lost = F.when(c("pnl") > 0, c("pnl")), F.when(~(c("pnl") > 0), c("pnl"))
    ret = c("pnl") / capital
    return trades.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg(flag(c("pnl") > 0)).alias("win_rate"),
        F.try_divide(F.sum(won), F.abs(F.sum(lost))).alias("profit_factor"),
        F.max_by("capital", order).alias("final_capital"), (F.max("dd") * 100).alias("max_dd"),
        (F.avg(ret) / (F.stddev_pop(ret) + 1e-10) * F.lit((365 * 2) ** 0.5)).alias("sharpe"),
        F.avg("pnl").alias("avg_pnl"), F.avg(won).alias("avg_win"), F.avg(lost).alias("avg_loss"),
        F.sum(flag(c("side") > 0)).alias("n_long"), F.sum(flag(c("side") < 0)).alias("n_short"),
        F.sum(flag(c("reason") == "TP")).alias("n_tp"), F.sum(flag(c("reason") == "SL")).alias("n_sl"),
        F.sum(flag(c("reason") == "TIMEOUT")).alias("n_timeout"),
    )


def return_stats(trades: DataFrame, key, order: str = "entry_rn") -> DataFrame:
    """Per run, on the returns ``growth`` of its trades: count, win rate, averages, profit factor, drawdown, reasons and log of the growth."""
    won, lost = F.when(c("growth") > 0, c("growth")), F.when(~(c("growth") > 0), c("growth"))
    return trades.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg(flag(c("growth") > 0)).alias("win_rate"), F.avg("growth").alias("avg_ret"),
        F.avg(won).alias("avg_win"), F.avg(lost).alias("avg_loss"), F.try_divide(F.sum(won), F.abs(F.sum(lost))).alias("profit_factor"),
        F.sum(F.ln(1 + c("growth"))).alias("log_growth"), (F.max("dd") * 100).alias("max_dd"),
        *[F.sum(flag(c("reason") == x)).alias(f"n_{x.lower()}") for x in ("TP", "SL", "TIMEOUT")])


# --- excursion grids ------------------------------------------------------------------------

def sltp_grid(moves: DataFrame, stops, targets, by=()) -> DataFrame:
    """Outcome of every stop / target pair over the excursions; the grid is exploded, not joined."""
    by = list(by)
    cells = F.array(*[F.struct(F.lit(float(s)).alias("sl_pct"), F.lit(float(t)).alias("tp_pct")) for s in stops for t in targets])
    df = moves.where("mae is not null and mfe is not null").select(*by, "mae", "mfe", F.explode(cells).alias("_g")).select(*by, "mae", "mfe", "_g.*")
    lost = c("mae") <= -c("sl_pct")
    reached = c("mfe") >= c("tp_pct")
    df = df.groupBy(*by, "sl_pct", "tp_pct").agg(
        F.sum(flag(~lost & reached)).alias("wins"), F.sum(flag(lost)).alias("losses"), F.sum(flag(lost & reached)).alias("premature_stops"))
    df = df.withColumns({
        "total_trades": c("wins") + c("losses"), "reward_risk": c("tp_pct") / c("sl_pct"),
        "total_profit": c("wins") * c("tp_pct"), "total_loss": c("losses") * c("sl_pct"),
    }).where("total_trades > 0").withColumn("win_rate", c("wins") / c("total_trades"))
    return df.withColumns({
        "profit_factor": F.coalesce(div("total_profit", "total_loss"), F.lit(0.0)),
        "expectancy": c("win_rate") * c("tp_pct") - (1 - c("win_rate")) * c("sl_pct"),
        "premature_pct": F.coalesce(div("premature_stops", "losses"), F.lit(0.0)),
        "net_profit": c("total_profit") - c("total_loss"),
    })


def volatility_buckets(df: DataFrame, x: str = "atr_pct", low: float = 0.33, high: float = 0.67) -> DataFrame:
    """Low / normal / high by exact per-symbol quantiles."""
    from barloom.operators.ranks import quantiles
    cuts = quantiles(df, x, {"_lo": low, "_hi": high}, ["symbol"])
    return df.join(cuts, "symbol").withColumn(
        "regime", F.when(c(x) < c("_lo"), "low").when(c(x) < c("_hi"), "normal").when(c(x) >= c("_hi"), "high")
    ).where("regime is not null").drop("_lo", "_hi")


def best_by_regime(grid: DataFrame) -> DataFrame:
    """Best cell per regime by expectancy; the smaller stop, then the smaller target, wins a tie."""
    order = F.struct("expectancy", (-c("sl_pct")).alias("a"), (-c("tp_pct")).alias("b"))
    rest = [x for x in grid.columns if x != "regime"]
    return grid.groupBy("regime").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("regime", "_r.*")


# --- other exits and account reports --------------------------------------------------------

def hysteresis(df: DataFrame, stop: float = 0.05, target: float = 0.10, leave: float = 0.45, hold: int = 24) -> DataFrame:
    """Exit at stop, target, a weak score or the time limit, whichever bar comes first."""
    low, high = c("close") * (1 - stop), c("close") * (1 + target)

    def outcome(x, i):
        why = (F.when(x["low"] <= low, "SL").when(x["high"] >= high, "TP").when(x["p"] < leave, "SIGNAL").when(i + 1 >= hold, "TIMEOUT"))
        price = F.when(x["low"] <= low, low).when(x["high"] >= high, high).otherwise(x["close"])
        return F.struct(why.alias("reason"), price.alias("price"), (i + 1).alias("k"))

    df = df.withColumn("_all", F.transform("_next", outcome))
    df = df.withColumn("_x", F.filter("_all", lambda x: x["reason"].isNotNull())).where(F.size("_x") > 0)
    first = F.element_at("_x", 1)
    return df.select("symbol", "ts", first["reason"].alias("reason"), first["k"].alias("bars_held"), (div(first["price"], "close") - 1).alias("gross_ret"))


# Upper ATR share of the close, stop and target share; above the last ones, the wide pair.
ATR_STOPS = ((0.0025, 0.05, 0.02), (0.005, 0.05, 0.03))
WIDE_STOPS = (0.08, 0.04)


def hysteresis_trades(df: DataFrame, enter: float = 0.55, leave: float = 0.45, hold: int = 72, fee: float = 0.0006) -> DataFrame:
    """Trades of one position at a time that enters above ``enter`` and leaves at stop, target or below ``leave``.

    ``df`` has one row a bar: symbol, ts, entry_rn, close, ``p``, ``atr_share`` (sets stop and target) and ``_next``, the following
    ``hold`` bars. After ``hold`` bars a position is closed at the close (TIMEOUT); one that the end of the series leaves open is closed
    at the last close (EOD). ``growth`` pays the fee on both fills.
    """
    low_share, share = F.lit(WIDE_STOPS[0]), F.lit(WIDE_STOPS[1])
    for below, stop, target in reversed(ATR_STOPS):
        low_share = F.when(c("atr_share") < below, stop).otherwise(low_share)
        share = F.when(c("atr_share") < below, target).otherwise(share)
    df = df.where(c("p") > enter).withColumns({"_low": c("close") * (1 - low_share), "_high": c("close") * (1 + share)})

    def outcome(x, i):
        why = F.when(x["low"] <= c("_low"), "SL").when(x["high"] >= c("_high"), "TP").when(x["p"] < leave, "SIGNAL").when(i + 1 >= hold, "TIMEOUT")
        price = F.when(x["low"] <= c("_low"), c("_low")).when(x["high"] >= c("_high"), c("_high")).otherwise(x["close"])
        return F.struct(why.alias("reason"), price.alias("price"), (i + 1).alias("k"))

    last = F.when(F.size("_next") > 0, F.try_element_at("_next", F.lit(-1))["close"]).otherwise(c("close"))
    open_end = F.struct(F.lit("EOD").alias("reason"), last.alias("price"), F.size("_next").alias("k"))
    ends = F.filter(F.transform("_next", outcome), lambda x: x["reason"].isNotNull())
    df = df.withColumn("_x", F.coalesce(F.try_element_at(ends, F.lit(1)), open_end))
    exits = df.select("symbol", "ts", "entry_rn", F.lit(1).alias("side"), c("close").alias("entry_price"), c("_x.reason").alias("reason"),
                      c("_x.k").alias("bars_held"), c("_x.price").alias("exit_price"))
    exits = exits.withColumn("gross_ret", div("exit_price", "entry_price") - 1)
    exits = exits.withColumn("growth", (1 - fee) * (1 - fee) * (1 + c("gross_ret")) - 1)
    return one_at_a_time(cut_lineage(exits), ["symbol"], hold)


def label_trades(df: DataFrame, prob: str, threshold: float, tp: float = 2.0, sl: float = 1.0, cost: float = 0.0019) -> DataFrame:
    """Every labelled bar whose score is above the threshold, paid by its barrier label: target, stop or nothing, less ``cost``.

    ``tp`` and ``sl`` are the ATR multiples that made ``tb_label``; ``cost`` is fee and slippage of both fills. Trades may overlap.
    """
    share = div("atr_14", "close")
    move = F.when(c("tb_label") == 1, tp * share).when(c("tb_label") == -1, -sl * share).otherwise(0.0)
    return df.where((c(prob) > threshold) & c("tb_label").isNotNull()).withColumns({
        "side": F.lit(1), "reason": F.when(c("tb_label") == 1, "TP").when(c("tb_label") == -1, "SL").otherwise("TIMEOUT"), "growth": move - cost})


def with_partial(df: DataFrame, share: float = 0.5) -> DataFrame:
    """Resolve exits where ``share`` leaves at +``trail_mult`` ATR and the stop moves to the entry.

    Such a trade is a break-even trade plus, when the level was reached before the exit, the gain of
    the part that left there.
    """
    s, entry, level = c("side"), c("entry_price"), c("entry_price") + c("side") * c("trail_mult") * c("atr_entry")
    reached = F.transform("_future", lambda b: s * (F.when(s > 0, b["high"]).otherwise(b["low"]) - level) >= 0)
    df = df.withColumn("_at", F.array_position(reached, True))
    df = resolve_exits(df.withColumn("exit_mode", F.lit("breakeven")))
    # the bar that ends the trade is tested before the partial exit
    taken = (c("_at") > 0) & (c("_at") < c("bars_held"))
    part = div(s * (level - entry), entry)
    return df.withColumns({
        "partial_taken": flag(taken), "total_ret": F.when(taken, share * part + (1 - share) * c("gross_ret")).otherwise(c("gross_ret")),
    }).drop("_at")


def longest_runs(trades: DataFrame, order: str = "entry_rn") -> DataFrame:
    """Longest winning and losing run of trades per symbol, from the last trade of the other kind."""
    df = trades.withColumn("_chunk", F.floor(c(order) / F.lit(ROWS_PER_PART)).cast("bigint"))
    won = c("pnl") > 0
    df = prefix(df, {"_i": ("sum", F.lit(1))}, order=order)
    df = prefix(df, {"_lw": ("last", F.when(won, c("_i"))), "_ll": ("last", F.when(~won, c("_i")))}, order=order)
    return df.groupBy("symbol").agg(
        F.max(F.when(won, c("_i") - F.coalesce("_ll", F.lit(0))).otherwise(0)).alias("longest_win"),
        F.max(F.when(won, 0).otherwise(c("_i") - F.coalesce("_lw", F.lit(0)))).alias("longest_loss"))


def account_rules(trades: DataFrame, capital: float = 25_000.0, max_trailing: float = 1000.0) -> DataFrame:
    """Day-based account limits: trailing end-of-day drawdown, best-day share, worst day, trade count."""
    days = trades.groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("n"))
    df = days.withColumn("_chunk", F.year("day").cast("bigint"))
    df = prefix(df, {"_sum": ("sum", "pnl")}, order="day").withColumn("balance", capital + c("_sum"))
    df = prefix(df, {"_peak": ("max", "balance")}, order="day").withColumn("trail", F.greatest("_peak", F.lit(capital)) - c("balance"))
    return df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("days"), F.max("trail").alias("max_trailing_dd"), F.try_divide(F.max("pnl"), F.sum("pnl")).alias("best_day_share"),
        F.min("pnl").alias("worst_day"), F.max("n").alias("most_trades"), (F.max("trail") <= max_trailing).alias("within_drawdown"))

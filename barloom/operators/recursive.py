"""Recursive indicators as parallel scans over chunks of one series.

``y[t] = keep * y[t-1] + u[t]`` is linear: a run of rows maps its incoming value x to ``a * x + b``, and such maps compose.
Inside a block of rows, short enough for the powers of ``keep``, it is a weighted window sum. The maps of the blocks are composed
in groups, those of the groups in the chunk, and those of the chunks along the series. Parabolic SAR is not linear; its chunks are run from guessed states in
parallel and rerun until every guess equals what the chunk before really produced.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.rolling import c, div, full, lag
from barloom.operators.chunks import HOURLY, START, SharedWindow, Span, chunked, clean, ordered, owned
from barloom.session import cut_lineage

W = SharedWindow()
KEY = ["symbol"]


#: Rows of a block at most, and blocks of a group: maps are composed one after the other within a group only.
BLOCK_ROWS, GROUP = 256, 256
#: Largest natural logarithm of a weight inside a block.
WEIGHT = 200.0


def _composed(maps: str, more: str = "") -> str:
    """Folds an ordered array of maps (a, b): all of them as one, and for each the map of those before it (``seen``)."""
    extra, kind = (f", '{more}', e.{more}", f", {more}: array<struct<a: double, b: double>>") if more else ("", "")
    return (f"aggregate({maps}, named_struct('a', 1D, 'b', 0D, 'seen', cast(array() AS array<struct<a: double, b: double{kind}>>)), "
            f"(s, e) -> named_struct('a', e.a * s.a, 'b', e.a * s.b + e.b, 'seen', array_append(s.seen, named_struct('a', s.a, 'b', s.b{extra}))))")


def affine_scan(df: DataFrame, add: str, keep: float, out: str, key=("symbol",)) -> DataFrame:
    """``out[t] = keep * out[t-1] + add[t]`` from 0, NULL adds nothing. ``df`` has ``_chunk`` and ``_rn``.

    Holds for any density of the series: no weight exceeds ``exp(WEIGHT)``, whatever number of rows a chunk has. Rows keep their
    place in (key, chunk); one row a chunk is chained along the series.
    """
    if not 0 <= keep <= 1:
        raise ValueError("keep must lie in [0, 1]")
    if keep == 0:
        return df.withColumn(out, F.coalesce(c(add), F.lit(0.0)))
    keys = list(key)
    rows = max(1, min(BLOCK_ROWS, int(WEIGHT / max(-math.log(keep), 1e-300))))
    df = df.withColumn("_at", c("_rn") - F.min("_rn").over(ordered("_rn", key).rowsBetween(START, 0)))
    df = df.withColumns({"_block": F.expr(f"_at div {rows}"), "_at": c("_at") % rows})
    weight = F.pow(F.lit(keep), -c("_at").cast("double"))
    inside = ordered("_rn", [*keys, "_block"]).rowsBetween(START, 0)
    df = df.withColumn("_local", F.sum(F.coalesce(c(add), F.lit(0.0)) * weight).over(inside) / weight)
    blocks = df.groupBy(*keys, "_chunk", "_block").agg(F.count(F.lit(1)).alias("_n"), F.max_by("_local", "_rn").alias("b"))
    blocks = blocks.withColumns({"a": F.pow(F.lit(keep), c("_n").cast("double")), "_group": F.expr(f"_block div {GROUP}")})
    groups = blocks.groupBy(*keys, "_chunk", "_group").agg(F.sort_array(F.collect_list(F.struct("_block", "a", "b"))).alias("_m"))
    groups = groups.select(*keys, "_chunk", "_group", F.expr(_composed("_m")).alias("_g"))
    chunks = groups.groupBy(*keys, "_chunk").agg(F.sort_array(F.collect_list(F.struct("_group", "_g.a", "_g.b", c("_g.seen").alias("blocks")))).alias("_m"))
    chunks = chunks.select(*keys, "_chunk", F.expr(_composed("_m", "blocks")).alias("_g"))
    chain = chunks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_chunk", "_g.a", "_g.b"))).alias("_m"))
    entering = chain.select(*keys, F.expr(f"inline(arrays_zip(transform(_m, e -> e._chunk), transform({_composed('_m')}.seen, e -> e.b)))").alias("_chunk", "_in"))
    carries = chunks.join(entering, [*keys, "_chunk"]).select(*keys, "_chunk", c("_g.seen").alias("_groups"), "_in")
    joined = df.join(carries, [*keys, "_chunk"])
    group = f"element_at(_groups, cast(_block div {GROUP} + 1 AS int))"
    block = f"element_at({group}.blocks, cast(_block % {GROUP} + 1 AS int))"
    start = F.expr(f"{block}.a * ({group}.a * _in + {group}.b) + {block}.b")
    return joined.withColumn(out, c("_local") + start * F.pow(F.lit(keep), c("_at") + 1)).drop("_at", "_block", "_local", "_groups", "_in")


def seeded(df: DataFrame, x: str, n: int, first: int, keep: float, gain: float, out: str) -> DataFrame:
    """Scan seeded with the mean of the ``n`` values up to row ``first``; NULL before it.

    ``df`` has halo rows for the seed frame; they are dropped here.
    """
    seed = F.avg(x).over(W.rowsBetween(-(n - 1), 0))
    df = df.withColumn("_u", F.when(c("_rn") == first, seed).when(c("_rn") > first, gain * c(x)))
    df = owned(df) if "_own" in df.columns else df
    df = affine_scan(df, "_u", keep, "_y")
    return df.withColumn(out, F.when(c("_rn") >= first, c("_y"))).drop("_u", "_y")


def ema(bars: DataFrame, n: int, x: str = "close", out: str | None = None, span: Span = HOURLY) -> DataFrame:
    """Exponential mean seeded with the simple mean of the first ``n`` values."""
    a = 2.0 / (n + 1)
    return clean(seeded(chunked(bars, before=n, span=span), x, n, n - 1, 1 - a, a, out or f"ema_{n}"))


def _rechunk(df: DataFrame, before: int, span: Span) -> DataFrame:
    return chunked(cut_lineage(clean(df)), before=before, span=span)


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, span: Span = HOURLY) -> DataFrame:
    """MACD line, signal and histogram; all means are seeded so that the line starts at row slow - 1."""
    first = slow - 1
    df = chunked(bars, before=slow, span=span)
    seeds = {n: F.avg("close").over(W.rowsBetween(-(n - 1), 0)) for n in (fast, slow)}
    df = df.withColumns({
        f"_u{n}": F.when(c("_rn") == first, seeds[n]).when(c("_rn") > first, 2.0 / (n + 1) * c("close")) for n in (fast, slow)})
    df = owned(df)
    for n in (fast, slow):
        df = affine_scan(df, f"_u{n}", 1 - 2.0 / (n + 1), f"_y{n}")
    df = df.withColumn("macd", F.when(c("_rn") >= first, c(f"_y{fast}") - c(f"_y{slow}")))
    df = seeded(_rechunk(df, signal, span), "macd", signal, first + signal - 1, 1 - 2.0 / (signal + 1), 2.0 / (signal + 1), "macd_signal")
    df = df.withColumn("macd_hist", c("macd") - c("macd_signal"))
    return clean(df.withColumn("macd", F.when(c("macd_signal").isNotNull(), c("macd"))))


def wilder_rsi(bars: DataFrame, n: int = 14, x: str = "close", skip: int = 0, out: str = "rsi", span: Span = HOURLY) -> DataFrame:
    """RSI with Wilder smoothing; ``skip`` leading rows of ``x`` are NULL."""
    first = n + skip
    df = chunked(bars, before=n + 1, span=span).withColumn("_d", c(x) - lag(x, 1, W))
    df = df.withColumns({"_gain": F.greatest(c("_d"), F.lit(0.0)), "_loss": F.greatest(-c("_d"), F.lit(0.0))})
    for name in ("_gain", "_loss"):
        df = df.withColumn(f"_u{name}", F.when(c("_rn") == first, F.avg(name).over(W.rowsBetween(-(n - 1), 0))).when(c("_rn") > first, c(name) / n))
    df = owned(df)
    for name in ("_gain", "_loss"):
        df = affine_scan(df, f"_u{name}", (n - 1) / n, f"_y{name}")
    total = c("_y_gain") + c("_y_loss")
    return clean(df.withColumn(out, F.when(c("_rn") >= first, F.coalesce(100 * div("_y_gain", total), F.lit(0.0)))))


def wilder_atr_adx(bars: DataFrame, n: int = 14, span: Span = HOURLY) -> DataFrame:
    """Wilder ATR and ADX: smoothed true range and directional moves, then the smoothed index."""
    df = chunked(bars, before=n + 2, span=span)
    up, down = c("high") - lag("high", 1, W), lag("low", 1, W) - c("low")
    before = lag("close", 1, W)
    df = df.withColumns({
        "_tr": F.when(before.isNotNull(), F.greatest(c("high") - c("low"), F.abs(c("high") - before), F.abs(c("low") - before))),
        "_pdm": F.when((up > 0) & (up > down), up).otherwise(0.0), "_mdm": F.when((down > 0) & (down > up), down).otherwise(0.0)})
    # directional sums start from n - 1 rows and lose 1/n per row; ATR starts from the mean of n rows
    for name in ("_tr", "_pdm", "_mdm"):
        start = F.sum(F.when(c("_rn") >= 1, c(name))).over(W.rowsBetween(-(n - 2), 0))
        df = df.withColumn(f"_u{name}", F.when(c("_rn") == n - 1, start).when(c("_rn") > n - 1, c(name)))
    df = df.withColumn("_uatr", F.when(c("_rn") == n, F.avg("_tr").over(W.rowsBetween(-(n - 1), 0))).when(c("_rn") > n, c("_tr") / n))
    df = owned(df)
    for name in ("_tr", "_pdm", "_mdm", "atr"):
        df = affine_scan(df, f"_u{name}", (n - 1) / n, f"_y{name}")
    plus, minus = div("_y_pdm", "_y_tr") * 100, div("_y_mdm", "_y_tr") * 100
    df = df.withColumns({
        "atr": F.when(c("_rn") >= n, c("_yatr")),
        "dx": F.when(c("_rn") >= n, F.coalesce(div(F.abs(plus - minus), plus + minus) * 100, F.lit(0.0)))})
    df = seeded(_rechunk(df, n, span), "dx", n, 2 * n - 1, (n - 1) / n, 1.0 / n, "adx")
    return clean(df)


# --- parabolic SAR --------------------------------------------------------------------------

STATE = ["st_up", "st_level", "st_ep", "st_af", "st_ph", "st_pl"]


UNDECIDED = 2.0


def _sar_rows(high, low, state, step: float, top: float):
    """Sequential kernel over one chunk; ``state`` None starts the series."""
    out = []
    for h, l in zip(high, low):  # noqa: E741
        if state is None:
            state = (UNDECIDED, l, h, step, h, l)
            out.append(None)
            continue
        up, sar, ep, af, ph, pl = state
        if up == UNDECIDED:  # second bar of the series: falling only when the downward move is the larger one
            up = 0.0 if pl - l > 0 and h - ph < pl - l else 1.0
            sar, ep = (pl, h) if up else (ph, l)
            ph, pl = h, l
        if up:
            if l <= sar:
                up, shown = 0.0, max(ep, ph, h)
                ep, af = l, step
                sar = max(shown + af * (ep - shown), ph, h)
            else:
                shown = sar
                if h > ep:
                    ep, af = h, min(af + step, top)
                sar = min(sar + af * (ep - sar), pl, l)
        else:
            if h >= sar:
                up, shown = 1.0, min(ep, pl, l)
                ep, af = h, step
                sar = min(shown + af * (ep - shown), pl, l)
            else:
                shown = sar
                if l < ep:
                    ep, af = l, min(af + step, top)
                sar = max(sar + af * (ep - sar), ph, h)
        state = (up, sar, ep, af, h, l)
        out.append(shown)
    return out, state


def parabolic_sar(bars: DataFrame, step: float = 0.02, top: float = 0.2, span: Span = HOURLY, rounds: int | None = None) -> DataFrame:
    """Parabolic SAR, exact, with one task per chunk.

    Every chunk runs from a guessed incoming state; the rounds stop when no chunk received a state
    other than its guess. A reversal forgets the past, so few rounds are needed; the first chunk is
    always right, so round k fixes at least chunk k and the loop ends.
    """
    rows = cut_lineage(owned(chunked(bars.select("symbol", "ts", "high", "low"), span=span)))
    fields = ", ".join(f"{x} double" for x in STATE)
    states = rows.select("symbol", "_chunk").distinct().select("symbol", "_chunk", *[F.lit(None).cast("double").alias(x) for x in STATE])
    states = cut_lineage(states)

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("_rn")
        guess = None if right.empty or pd.isna(right["st_up"].iloc[0]) else tuple(float(right[x].iloc[0]) for x in STATE)
        sar, end = _sar_rows(left["high"].tolist(), left["low"].tolist(), guess, step, top)
        frame = pd.DataFrame({"symbol": key[0], "_chunk": key[1], "_rn": left["_rn"].values, "ts": left["ts"].values,
                              "sar": pd.Series(sar, dtype="float64").values})
        for name, value in zip(STATE, end):
            frame[name] = float(value)
        return frame

    schema = f"symbol string, _chunk bigint, _rn bigint, ts timestamp, sar double, {fields}"
    from pyspark.sql import Window
    seq = Window.partitionBy("symbol").orderBy("_chunk")
    done = 0
    while True:
        result = cut_lineage(rows.groupBy("symbol", "_chunk").cogroup(states.groupBy("symbol", "_chunk")).applyInPandas(run, schema))
        ends = result.groupBy("symbol", "_chunk").agg(*[F.max_by(x, "_rn").alias(x) for x in STATE])
        fresh = cut_lineage(ends.select("symbol", "_chunk", *[F.lag(x).over(seq).alias(x) for x in STATE]))
        other = states.select("symbol", "_chunk", F.struct(*STATE).alias("_old"))
        moved = fresh.join(other, ["symbol", "_chunk"]).where(~F.struct(*STATE).eqNullSafe(c("_old"))).limit(1).count()
        done += 1
        if moved == 0 or (rounds and done >= rounds):
            return result.select("symbol", "ts", F.when(~F.isnan("sar"), c("sar")).alias("sar"))
        states = fresh

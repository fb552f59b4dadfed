"""Event studies and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import tdist
from barloom.functions.rolling import c, flag
from barloom.operators import features as X
from barloom.operators import ranks as K
from barloom.operators import stats as A
from barloom.operators import studies as E
from barloom.operators.align import asof
from barloom.operators.chunks import DAILY, chunked, clean
from barloom.plans.q_features import RET, alias
from barloom.plans.registry import query, report
from barloom.plans.sqltext import P, cols, full, lag, lead, sql
from barloom.session import cut_lineage
from barloom.sources import bars as B

NUMS = "mean median std pos_share t_stat sharpe"


def stats_sql(source, by, value="ret"):
    return ("out_", f"""SELECT {by}, count({value}) AS n, avg({value}) AS mean, median({value}) AS median, stddev_samp({value}) AS std,
  avg(({value} > 0)::INT) AS pos_share, avg({value}) / nullif(stddev_samp({value}) / sqrt(count({value})), 0) AS t_stat,
  avg({value}) / nullif(stddev_samp({value}), 0) * sqrt(252) AS sharpe FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL""")


def stats_report(df, *by):
    return report(A.group_stats(df, "ret", by), *by, "n", *NUMS.split())


R1 = ("r1", alias({"ret": f"close / {lag('close')} - 1"}))


def hourly(spark, folder):
    bars = B.stored_bars(spark, folder)
    return cut_lineage(clean(chunked(bars, before=1).withColumn("ret", F.try_divide("close", F.lag("close").over(X.W())) - 1)))


@query("hour_effect", sql("bars", R1, ("h", "SELECT *, hour(timezone('America/New_York', timezone('UTC', ts))) AS eastern_hour FROM r1"), stats_sql("h", "eastern_hour"),
    out=cols("out_", keys="", ts="", ints="eastern_hour n", nums=NUMS)))
def hour_effect(spark, folder):
    df = hourly(spark, folder).withColumn("eastern_hour", F.hour(F.from_utc_timestamp("ts", "America/New_York")))
    return stats_report(df, "eastern_hour")


D1 = ("d1", f"SELECT *, close / {lag('close')} - 1 AS ret FROM daily")


def days(spark, folder):
    daily = B.stored_daily(spark, folder)
    return cut_lineage(clean(chunked(daily, before=1, span=DAILY).withColumn("ret", F.try_divide("close", F.lag("close").over(X.W())) - 1)))


@query("weekday_effect", sql("daily", D1, ("h", "SELECT *, isodow(ts) - 1 AS dow FROM d1"), stats_sql("h", "symbol, dow"),
    out=cols("out_", ts="", ints="dow n", nums=NUMS)))
def weekday_effect(spark, folder):
    return stats_report(days(spark, folder).withColumn("dow", F.weekday("ts")), "symbol", "dow")


@query("month_effect", sql("daily", D1, ("h", "SELECT *, month(ts) AS month FROM d1"), stats_sql("h", "symbol, month"),
    out=cols("out_", ts="", ints="month n", nums=NUMS)))
def month_effect(spark, folder):
    return stats_report(days(spark, folder).withColumn("month", F.month("ts")), "symbol", "month")


SESSION_SQL = "CASE " + " ".join(f"WHEN hour(ts) BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in E.SESSIONS) + " END"


@query("session_returns", sql("bars", ("s", f"SELECT symbol, date_trunc('day', ts) AS d, {SESSION_SQL} AS session, arg_max(close, ts) / arg_min(open, ts) - 1 AS ret FROM bars WHERE {SESSION_SQL} IS NOT NULL GROUP BY 1, 2, 3"),
    stats_sql("s", "symbol, session"), out=cols("out_", keys="symbol session", ts="", ints="n", nums=NUMS)))
def session_returns(spark, folder):
    return stats_report(cut_lineage(E.session_returns(B.bars_1h(spark, folder))), "symbol", "session")


@query("entry_horizons", sql("bars", ("l", alias({f"c{k}": lead("close", k) for k in (1, 2, 3, 4, 6)})),
    ("u", "SELECT symbol, ts, close, horizon, later FROM (UNPIVOT (SELECT symbol, ts, close, hour(ts) AS h, c1, c2, c3, c4, c6 FROM l WHERE hour(ts) = 9) ON c1, c2, c3, c4, c6 INTO NAME hn VALUE later) , LATERAL (SELECT CAST(hn[2:] AS INT) AS horizon)"),
    ("b", "SELECT horizon, side, CASE side WHEN 'long' THEN later / close - 1 ELSE -(later / close - 1) END AS ret FROM u, (VALUES ('long'), ('short')) v(side)"),
    stats_sql("b", "horizon, side"), out=cols("out_", keys="side", ts="", ints="horizon n", nums=NUMS)))
def entry_horizons(spark, folder):
    return stats_report(cut_lineage(E.entry_exit_horizons(B.stored_bars(spark, folder))), "side", "horizon")


@query("premarket_momentum", sql("bars", ("d", """SELECT symbol, date_trunc('day', ts) AS d, max(open) FILTER (WHERE hour(ts) = 4) AS a, max(close) FILTER (WHERE hour(ts) = 8) AS b,
  max(close) FILTER (WHERE hour(ts) = 12) AS x FROM bars GROUP BY 1, 2"""),
    ("m", "SELECT symbol, CASE WHEN b > a THEN 'up' ELSE 'down' END AS direction, x / b - 1 AS ret FROM d WHERE a IS NOT NULL AND b IS NOT NULL AND x IS NOT NULL"),
    stats_sql("m", "direction"), out=cols("out_", keys="direction", ts="", ints="n", nums=NUMS)))
def premarket_momentum(spark, folder):
    h = F.hour("ts")
    day = B.bars_1h(spark, folder).where(h.isin(4, 8, 12)).groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(
        F.max(F.when(h == 4, c("open"))).alias("a"), F.max(F.when(h == 8, c("close"))).alias("b"), F.max(F.when(h == 12, c("close"))).alias("x"))
    df = day.dropna(subset=["a", "b", "x"]).select(F.when(c("b") > c("a"), "up").otherwise("down").alias("direction"), (F.try_divide("x", "b") - 1).alias("ret"))
    return stats_report(cut_lineage(df), "direction")


GAPS = [0.1, 0.25, 0.5, 1.0, 1.5, 2.0]


@query("gap_study", sql("daily", ("g", f"SELECT *, (open / {lag('close')} - 1) * 100 AS gap, (close / open - 1) * 100 AS intraday, {lag('close')} AS prev FROM daily"),
    ("t", f"SELECT *, CASE WHEN gap > 0 THEN 'up' ELSE 'down' END AS side, CASE WHEN gap > 0 THEN (low <= prev)::INT ELSE (high >= prev)::INT END AS filled, CASE WHEN gap > 0 THEN -intraday ELSE intraday END AS fade FROM g, (SELECT unnest({GAPS})::DOUBLE AS threshold) WHERE prev IS NOT NULL AND abs(gap) > threshold"),
    ("out_", "SELECT symbol, threshold, side, count(*) AS n, avg(filled) AS fill_rate, avg(intraday) AS avg_intraday, avg(fade) AS avg_fade, avg(fade) / nullif(stddev_samp(fade) / sqrt(count(fade)), 0) AS t_stat FROM t GROUP BY ALL"),
    out=cols("out_", keys="symbol side", ts="", ints="n", nums="threshold fill_rate avg_intraday avg_fade t_stat")))
def gap_study(spark, folder):
    return report(E.gap_study(B.stored_daily(spark, folder), GAPS), "symbol", "side", "n", "threshold", "fill_rate", "avg_intraday", "avg_fade", "t_stat")


@query("large_move_reversion", sql("bars", R1, ("n", alias({"nxt": f"{lead('ret')}"}, "r1")),
    ("t", "SELECT threshold, CASE WHEN ret > 0 THEN 'up' ELSE 'down' END AS side, nxt AS ret FROM n, (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS threshold) WHERE abs(ret) > threshold"),
    stats_sql("t", "threshold, side"), out=cols("out_", keys="side", ts="", ints="n", nums="threshold " + NUMS)))
def large_move_reversion(spark, folder):
    df = clean(chunked(hourly(spark, folder), after=1).withColumn("nxt", F.lead("ret").over(X.W())))
    df = df.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in (0.5, 1.0, 2.0)]))).where(F.abs("ret") > c("threshold"))
    df = df.select("threshold", F.when(c("ret") > 0, "up").otherwise("down").alias("side"), c("nxt").alias("ret"))
    return stats_report(cut_lineage(df), "threshold", "side")


@query("vix_regime", sql("daily vix", D1, ("j", "SELECT d.*, v.vix FROM d1 d ASOF LEFT JOIN vix v ON d.ts >= v.ts"),
    ("b", "SELECT *, CASE WHEN vix < 20 THEN 'calm' WHEN vix < 25 THEN 'normal' WHEN vix >= 25 THEN 'high' ELSE 'none' END AS band FROM j"),
    stats_sql("b", "symbol, band"), out=cols("out_", keys="symbol band", ts="", ints="n", nums=NUMS)))
def vix_regime(spark, folder):
    df = asof(days(spark, folder), cut_lineage(B.volatility_index(spark, folder)), ["vix"], key=(), span=DAILY)
    band = F.when(c("vix") < 20, "calm").when(c("vix") < 25, "normal").when(c("vix") >= 25, "high").otherwise("none")
    return stats_report(cut_lineage(df.withColumn("band", band)), "symbol", "band")


@query("first_bar_rest", sql("bars", ("d", """SELECT symbol, date_trunc('day', ts) AS d, max(open) FILTER (WHERE hour(ts) = 9) AS o, max(close) FILTER (WHERE hour(ts) = 9) AS c,
  arg_max(close, ts) FILTER (WHERE hour(ts) BETWEEN 10 AND 15) AS z, count(*) FILTER (WHERE hour(ts) BETWEEN 10 AND 15) AS n FROM bars GROUP BY 1, 2"""),
    ("f", "SELECT CASE WHEN c > o THEN 'up' ELSE 'down' END AS first_dir, CASE WHEN c > o THEN z / c - 1 ELSE -(z / c - 1) END AS ret FROM d WHERE c IS NOT NULL AND n > 1"),
    stats_sql("f", "first_dir"), out=cols("out_", keys="first_dir", ts="", ints="n", nums=NUMS)))
def first_bar_rest(spark, folder):
    df = E.first_bar_study(B.bars_1h(spark, folder)).withColumnRenamed("continuation", "ret")
    return stats_report(cut_lineage(df), "first_dir")


STREAK = [("k1", f"SELECT *, coalesce(sign(ret), 0) AS s FROM d1"),
          ("k2", f"SELECT *, CASE WHEN s IS DISTINCT FROM {lag('s')} THEN 1 ELSE 0 END AS turn FROM k1"),
          ("k3", f"SELECT *, sum(turn) OVER ({P}) AS run FROM k2"),
          ("k4", "SELECT *, CASE WHEN s = 0 THEN 0 ELSE s * row_number() OVER (PARTITION BY symbol, run ORDER BY ts) END AS streak, CASE WHEN s = 0 THEN 0 ELSE sum(coalesce(ret, 0)) OVER (PARTITION BY symbol, run ORDER BY ts) * 100 END AS streak_move FROM k3")]


@query("streaks", sql("daily", D1, *STREAK, out=cols("k4", ints="streak", nums="streak_move:3")))
def streaks(spark, folder):
    return report(E.streaks(B.stored_daily(spark, folder)), "symbol", "ts", "streak", "streak_move:3")


@query("streak_next_day", sql("daily", D1, *STREAK, ("n", f"SELECT greatest(-4, least(4, {lag('streak')})) AS after, ret FROM k4"), ("m", "SELECT after, ret FROM n WHERE after IS NOT NULL"),
    stats_sql("m", "after"), out=cols("out_", keys="", ts="", ints="after n", nums=NUMS)))
def streak_next_day(spark, folder):
    df = cut_lineage(E.streaks(B.stored_daily(spark, folder)).drop("_chunk", "_rn"))
    df = clean(chunked(df, before=1, span=DAILY).withColumn("after", F.greatest(F.lit(-4), F.least(F.lit(4), F.lag("streak").over(X.W())))))
    return stats_report(cut_lineage(df.where(F.col("after").isNotNull())), "after")


@query("orb", sql("bars", ("d", """SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS ts, max(high) FILTER (WHERE hour(ts) BETWEEN 9 AND 10) AS oh, min(low) FILTER (WHERE hour(ts) BETWEEN 9 AND 10) AS ol,
  count(*) FILTER (WHERE hour(ts) BETWEEN 9 AND 10) AS no, count(*) FILTER (WHERE hour(ts) BETWEEN 11 AND 15) AS nr, max(high) FILTER (WHERE hour(ts) BETWEEN 11 AND 15) AS th,
  min(low) FILTER (WHERE hour(ts) BETWEEN 11 AND 15) AS tl, arg_max(close, ts) FILTER (WHERE hour(ts) BETWEEN 11 AND 15) AS z FROM bars GROUP BY symbol, date_trunc('day', ts)"""),
    ("out_", "SELECT symbol, ts, (oh - ol) / ol * 100 AS or_range, (th > oh)::INT AS broke_up, (tl < ol)::INT AS broke_down, CASE WHEN th > oh THEN (z / oh - 1) * 100 END AS long_ret, CASE WHEN tl < ol THEN (1 - z / ol) * 100 END AS short_ret FROM d WHERE no > 0 AND nr > 1"),
    out=cols("out_", ints="broke_up broke_down", nums="or_range long_ret short_ret")))
def orb(spark, folder):
    return report(E.opening_range(B.bars_1h(spark, folder)), "symbol", "ts", "broke_up", "broke_down", "or_range", "long_ret", "short_ret")


SPIKE = [R1, ("v", alias({"vr": f"volume / nullif({full('avg', 'volume', 20)}, 0)", "fwd": f"{lead('close', 4)} / close - 1"}, "r1"))]


@query("volume_spike_study", sql("bars", *SPIKE, ("w", "SELECT symbol, count(fwd) FILTER (WHERE vr > 1.5) AS n_event, avg(fwd) FILTER (WHERE vr > 1.5) AS m1, var_samp(fwd) FILTER (WHERE vr > 1.5) AS v1, count(fwd) AS n_all, avg(fwd) AS m2, var_samp(fwd) AS v2 FROM v WHERE fwd IS NOT NULL GROUP BY 1"),
    ("out_", "SELECT symbol, n_event, n_all, m1 - m2 AS diff, (m1 - m2) / sqrt(v1 / n_event + v2 / n_all) AS t_stat, (v1 / n_event + v2 / n_all) ^ 2 / ((v1 / n_event) ^ 2 / (n_event - 1) + (v2 / n_all) ^ 2 / (n_all - 1)) AS dof FROM w WHERE n_event > 1"),
    out=cols("out_", ts="", ints="n_event n_all", nums="diff t_stat dof")))
def volume_spike_study(spark, folder):
    return report(volume_events(spark, folder), "symbol", "n_event", "n_all", "diff", "t_stat", "dof")


def volume_events(spark, folder):
    from barloom.functions.rolling import div, full as full_
    df = chunked(B.stored_bars(spark, folder), before=20, after=4)
    df = clean(df.withColumns({"vr": div("volume", full_(F.avg, "volume", 20, X.W)), "fwd": F.try_divide(F.lead("close", 4).over(X.W()), c("close")) - 1}))
    return A.welch(df.withColumn("event", F.coalesce(c("vr") > 1.5, F.lit(False))), "fwd", "event", ["symbol"])


@query("ttest_pvalues")
def ttest_pvalues(spark, folder):
    df = volume_events(spark, folder)
    df = df.withColumn("p", tdist.p_value(c("t_stat"), c("dof")))
    return report(df.withColumn("stars", tdist.stars(c("p"))), "symbol", "t_stat", "dof", "p", "stars")


# --- statistics -----------------------------------------------------------------------------

LAB = [RET, ("f0", alias({"atr_src": "high - low", "m12": f"close / {lag('close', 12)} - 1", "vr": f"volume / nullif({full('avg', 'volume', 20)}, 0)", "rng": "(high - low) / close",
                                     "fwd": f"{lead('close', 4)} / close - 1"}, "r")),
       ("f1", "SELECT symbol, ts, r, m12, vr, rng, fwd, (fwd > 0)::INT AS label FROM f0 WHERE fwd IS NOT NULL")]
FEATS = ["r", "m12", "vr", "rng"]


def labeled(spark, folder):
    from barloom.functions.rolling import div, full as full_, lag as lag_, lead as lead_
    df = chunked(B.stored_bars(spark, folder), before=21, after=4)
    df = clean(df.withColumns({
        "r": F.ln(div("close", lag_("close", 1, X.W))), "m12": div("close", lag_("close", 12, X.W)) - 1,
        "vr": div("volume", full_(F.avg, "volume", 20, X.W)), "rng": div(c("high") - c("low"), "close"),
        "fwd": div(lead_("close", 4, X.W), "close") - 1}))
    return cut_lineage(df.where("fwd is not null").withColumn("label", flag(c("fwd") > 0)).select("symbol", "ts", *FEATS, "fwd", "label"))


def rank_auc_sql(x, by):
    k = f"{by}, " if by else ""
    return f"SELECT {k}'{x}' AS feature, count(*) AS n, (sum(CASE WHEN label = 1 THEN rk ELSE 0 END) - sum(label) * (sum(label) + 1) / 2) / nullif(sum(label) * (count(*) - sum(label)), 0) AS auc FROM (SELECT *, rank() OVER (PARTITION BY {by or 1} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}{x}) - 1) / 2 AS rk FROM f1 WHERE {x} IS NOT NULL) GROUP BY ALL"


@query("feature_auc", sql("bars", *LAB, ("out_", " UNION ALL ".join(rank_auc_sql(x, "symbol") for x in FEATS)), out=cols("out_", keys="symbol feature", ts="", ints="n", nums="auc")))
def feature_auc(spark, folder):
    tall = K.unpivoted(labeled(spark, folder), FEATS, ["symbol", "label"])
    return report(K.auc(tall, "x", "label", ["symbol", "feature"]), "symbol", "feature", "n", "auc")


HOLDOUT = [("tall", " UNION ALL ".join(f"SELECT symbol, ts, label, '{x}' AS feature, {x} AS x FROM f1 WHERE {x} IS NOT NULL" for x in FEATS)),
           ("nn", "SELECT *, row_number() OVER (PARTITION BY symbol, feature ORDER BY ts) - 1 AS i, count(*) OVER w AS n, sum(label) OVER w AS p FROM tall WINDOW w AS (PARTITION BY symbol, feature)"),
           ("te", "SELECT *, rank() OVER (PARTITION BY symbol, feature ORDER BY x) + (count(*) OVER (PARTITION BY symbol, feature, x) - 1) / 2 AS rk FROM nn WHERE i >= floor(n * 0.7::DOUBLE)"),
           ("ag", "SELECT symbol, feature, max(n) AS n, count(*) AS n_test, max(p) AS p, sum(label) AS q, (sum(CASE WHEN label = 1 THEN rk ELSE 0 END) - sum(label) * (sum(label) + 1) / 2) / nullif(sum(label) * (count(*) - sum(label)), 0) AS a FROM te GROUP BY 1, 2"),
           ("ok", "SELECT *, n >= 500 AND p >= 50 AND n - p >= 50 AND q >= 10 AND n_test - q >= 10 AS good FROM ag"),
           ("out_", "SELECT symbol, feature, n, n_test, CASE WHEN good THEN greatest(a, 1 - a) END AS auc, CASE WHEN good THEN CASE WHEN a < 0.5 THEN -1 ELSE 1 END END AS direction FROM ok")]


@query("feature_auc_holdout", sql("bars", *LAB, *HOLDOUT, out=cols("out_", keys="symbol feature", ts="", ints="n n_test direction", nums="auc")))
def feature_auc_holdout(spark, folder):
    """Each feature as a score on the last 30 % of its rows in time, with the direction in which it ranks."""
    tall = K.unpivoted(labeled(spark, folder), FEATS, ["symbol", "ts", "label"])
    return report(K.holdout_auc(tall, "x", "label", ["symbol", "feature"]), "symbol", "feature", "n", "n_test", "auc", "direction")


def profile_sql(columns, target):
    return " UNION ALL ".join(f"SELECT '{x}' AS feature, avg(({x} IS NULL)::INT) AS null_share, avg({x}) AS mean, stddev_samp({x}) AS std, min({x}) AS low, max({x}) AS high, corr({x}, {target}) AS corr FROM f1" for x in columns)


@query("feature_corr", sql("bars", *LAB, ("out_", profile_sql(FEATS, "fwd")), out=cols("out_", keys="feature", ts="", nums="null_share mean std low high corr")))
def feature_corr(spark, folder):
    return report(A.column_profile(labeled(spark, folder), FEATS, "fwd"))


@query("correlation_pairs", sql("bars", *LAB, ("out_", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM f1" for i, a in enumerate(FEATS) for b in FEATS[i + 1:])),
    out=cols("out_", keys="a b", ts="", nums="corr")))
def correlation_pairs(spark, folder):
    return report(A.correlation_pairs(labeled(spark, folder), FEATS))


@query("redundant_features")
def redundant_features(spark, folder):
    df = labeled(spark, folder).withColumn("r_copy", c("r") * 2 + 1)
    names = [*FEATS, "r_copy"]
    dropped = A.redundant_features(A.correlation_pairs(df, names), names)
    return spark.createDataFrame([(x, x in dropped) for x in names], "feature string, dropped boolean")


@query("spearman_lags", sql("bars", *LAB, ("l", " UNION ALL ".join(f"SELECT symbol, {k} AS lag_bars, lag(m12, {k}) OVER ({P}) AS x, fwd AS y FROM f1" for k in (0, 1, 4))),
    ("k", "SELECT *, rank() OVER (PARTITION BY symbol, lag_bars ORDER BY x) + (count(*) OVER (PARTITION BY symbol, lag_bars, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY symbol, lag_bars ORDER BY y) + (count(*) OVER (PARTITION BY symbol, lag_bars, y) - 1) / 2 AS ry FROM l WHERE x IS NOT NULL AND y IS NOT NULL"),
    ("out_", "SELECT symbol, lag_bars, corr(rx, ry) AS rho, count(*) AS n FROM k GROUP BY ALL"), out=cols("out_", ts="", ints="lag_bars n", nums="rho")))
def spearman_lags(spark, folder):
    df = chunked(labeled(spark, folder), before=4)
    lags = F.array(*[F.struct(F.lit(k).alias("lag_bars"), (F.lag("m12", k).over(X.W()) if k else c("m12")).alias("x")) for k in (0, 1, 4)])
    df = clean(df.withColumn("lags", lags)).select("symbol", c("fwd").alias("y"), F.explode("lags").alias("_l")).select("symbol", "y", "_l.*")
    return report(K.spearman(cut_lineage(df), "x", "y", ["symbol", "lag_bars"]), "symbol", "lag_bars", "n", "rho")


@query("binned_mi", sql("bars", *LAB, *[(f"b_{x}", f"SELECT label, len(list_filter((SELECT quantile_cont({x}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FROM f1), lambda e: e < {x})) AS b FROM f1 WHERE {x} IS NOT NULL") for x in FEATS],
    ("out_", " UNION ALL ".join(f"SELECT '{x}' AS feature, sum(n / t * ln(n * t / (nb * ny))) AS mi FROM (SELECT *, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER (PARTITION BY label) AS ny FROM (SELECT b, label, count(*) AS n FROM b_{x} GROUP BY 1, 2))" for x in FEATS)),
    out=cols("out_", keys="feature", ts="", nums="mi")))
def binned_mi(spark, folder):
    return report(A.mutual_information(labeled(spark, folder), FEATS, "label"))


@query("dataset_validation", sql("bars", *LAB, ("out_", "SELECT count(*) AS n_rows, sum((r IS NULL)::INT + (m12 IS NULL)::INT + (vr IS NULL)::INT + (rng IS NULL)::INT) AS n_nulls, 0 AS n_constant, count(DISTINCT label) AS n_labels, avg(label) AS positive_share, 0 AS valid FROM f1"),
    out=cols("out_", keys="", ts="", ints="n_rows n_nulls n_constant n_labels valid", nums="positive_share")))
def dataset_validation(spark, folder):
    return report(A.validation_report(labeled(spark, folder), FEATS, "label"), "n_rows", "n_nulls", "n_constant", "n_labels", "valid", "positive_share")


@query("clip_standardize", sql("bars", *LAB, ("q", "SELECT quantile_cont(m12, 0.01) AS a1, quantile_cont(m12, 0.99) AS b1, quantile_cont(rng, 0.01) AS a2, quantile_cont(rng, 0.99) AS b2 FROM f1"),
    ("k", "SELECT symbol, ts, CASE WHEN m12 IS NOT NULL THEN greatest(a1, least(b1, m12)) END AS m, CASE WHEN rng IS NOT NULL THEN greatest(a2, least(b2, rng)) END AS g FROM f1, q"),
    ("out_", "SELECT symbol, ts, (m - avg(m) OVER ()) / stddev_pop(m) OVER () AS m12, (g - avg(g) OVER ()) / stddev_pop(g) OVER () AS rng FROM k"), out=cols("out_", nums="m12 rng")))
def clip_standardize(spark, folder):
    return report(A.clip_and_scale(labeled(spark, folder), ["m12", "rng"]), "symbol", "ts", "m12", "rng")


@query("classification_metrics", sql("bars", *LAB, ("p", "SELECT *, 1 / (1 + exp(-m12)) AS prob FROM f1 WHERE m12 IS NOT NULL"),
    ("rk", "SELECT symbol, (sum(CASE WHEN label = 1 THEN rk ELSE 0 END) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) AS auc FROM (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY prob) + (count(*) OVER (PARTITION BY symbol, prob) - 1) / 2 AS rk FROM p) GROUP BY 1"),
    ("k", "SELECT symbol, sum((prob >= 0.5)::INT * label) AS tp, sum((prob >= 0.5)::INT * (1 - label)) AS fp, sum((prob < 0.5)::INT * label) AS fn, sum((prob < 0.5)::INT * (1 - label)) AS tn, avg((prob - label) ^ 2) AS brier FROM p GROUP BY 1"),
    ("out_", "SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, tn / (tn + fp) AS specificity, 2 * tp / (2 * tp + fp + fn) AS f1 FROM k JOIN rk USING (symbol)"),
    out=cols("out_", ts="", ints="tp fp fn tn", nums="brier accuracy precision recall specificity f1 auc")))
def classification_metrics(spark, folder):
    df = labeled(spark, folder).where("m12 is not null").withColumn("prob", 1 / (1 + F.exp(-c("m12"))))
    return report(A.classification_report(df, "prob", "label", ["symbol"]), "symbol", "tp", "fp", "fn", "tn", "brier", "accuracy", "precision", "recall", "specificity", "f1", "auc")


@query("quantile_report", sql("bars", *LAB, ("out_", "SELECT symbol, quantile_cont(fwd, 0.05) AS q05, quantile_cont(fwd, 0.25) AS q25, median(fwd) AS q50, quantile_cont(fwd, 0.75) AS q75, quantile_cont(fwd, 0.95) AS q95, quantile_cont(fwd, 0.9) - quantile_cont(fwd, 0.1) AS spread FROM f1 GROUP BY 1"),
    out=cols("out_", ts="", nums="q05 q25 q50 q75 q95 spread")))
def quantile_report(spark, folder):
    q = {"q05": .05, "q25": .25, "q50": .5, "q75": .75, "q95": .95, "q10": .1, "q90": .9}
    df = K.quantiles(labeled(spark, folder), "fwd", q, ["symbol"]).withColumn("spread", c("q90") - c("q10"))
    return report(df, "symbol", "q05", "q25", "q50", "q75", "q95", "spread")


@query("threshold_coverage", sql("bars", *LAB, ("p", "SELECT *, 1 / (1 + exp(-m12)) AS prob FROM f1 WHERE m12 IS NOT NULL"),
    ("out_", "SELECT threshold, avg((prob >= threshold)::INT) AS coverage, avg(label) FILTER (WHERE prob >= threshold) AS hit_rate FROM p, (SELECT unnest([0.5, 0.55, 0.6, 0.7])::DOUBLE AS threshold) GROUP BY 1"),
    out=cols("out_", keys="", ts="", nums="threshold coverage hit_rate")))
def threshold_coverage(spark, folder):
    df = labeled(spark, folder).where("m12 is not null").withColumn("prob", 1 / (1 + F.exp(-c("m12"))))
    df = df.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in (0.5, 0.55, 0.6, 0.7)])))
    hit = c("prob") >= c("threshold")
    return report(df.groupBy("threshold").agg(F.avg(hit.cast("int")).alias("coverage"), F.avg(F.when(hit, c("label"))).alias("hit_rate")))


@query("label_distribution", sql("bars", *LAB, ("out_", "SELECT symbol, label, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY symbol) AS share FROM f1 GROUP BY 1, 2"), out=cols("out_", ts="", ints="label n", nums="share")))
def label_distribution(spark, folder):
    from pyspark.sql import Window
    counts = labeled(spark, folder).groupBy("symbol", "label").agg(F.count(F.lit(1)).alias("n"))
    return report(counts.withColumn("share", c("n") / F.sum("n").over(Window.partitionBy("symbol"))))


REG = [("g0", f"SELECT *, close / {lag('close', 20)} - 1 AS m, close / {lag('close')} - 1 AS ret FROM daily"),
       ("g1", "SELECT *, CASE WHEN m > 0.5 THEN 'bull' WHEN m < -0.3 THEN 'bear' WHEN m IS NULL THEN 'unknown' ELSE 'sideways' END AS regime FROM g0"),
       ("g2", f"SELECT *, {lead('regime')} AS nxt FROM g1")]


def regimes(spark, folder):
    df = E.daily_frame(B.stored_daily(spark, folder))
    df = chunked(cut_lineage(df), before=1, after=1, span=DAILY)
    return cut_lineage(clean(df.withColumns({"ret": F.try_divide("close", F.lag("close").over(X.W())) - 1, "nxt": F.lead("regime").over(X.W())})))


@query("regime_transition", sql("daily", *REG, ("t", "SELECT regime, nxt, count(*) AS n FROM g2 WHERE nxt IS NOT NULL GROUP BY 1, 2"),
    ("out_", "SELECT regime, nxt, n, n / sum(n) OVER (PARTITION BY regime) AS share FROM t"), out=cols("out_", keys="regime nxt", ts="", ints="n", nums="share")))
def regime_transition(spark, folder):
    from pyspark.sql import Window
    counts = regimes(spark, folder).where("nxt is not null").groupBy("regime", "nxt").agg(F.count(F.lit(1)).alias("n"))
    return report(counts.withColumn("share", c("n") / F.sum("n").over(Window.partitionBy("regime"))))


@query("regime_profile", sql("daily", *REG, ("out_", "SELECT regime, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS std, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, avg((ret > 0)::INT) AS up_share FROM g2 GROUP BY 1"),
    out=cols("out_", keys="regime", ts="", ints="n", nums="mean std sharpe up_share")))
def regime_profile(spark, folder):
    df = regimes(spark, folder).groupBy("regime").agg(
        F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"),
        (F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * F.lit(252 ** 0.5)).alias("sharpe"), F.avg((c("ret") > 0).cast("int")).alias("up_share"))
    return report(df)


@query("return_histogram", sql("daily", *REG, ("out_", "SELECT regime, CAST(least(51, greatest(0, floor((ret + 1) / 0.1::DOUBLE) + 1)) AS BIGINT) AS bin, count(*) AS n FROM g2 WHERE ret IS NOT NULL GROUP BY 1, 2"), out=cols("out_", keys="regime", ts="", ints="bin n")))
def return_histogram(spark, folder):
    df = regimes(spark, folder).where("ret is not null")
    bin_ = F.least(F.lit(51), F.greatest(F.lit(0), F.floor((c("ret") + 1) / 0.1) + 1)).cast("bigint")
    return report(df.groupBy("regime", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n")))


@query("ensemble_weights", sql("bars", *LAB, ("e", "SELECT sqrt(avg((fwd - 0.1 * m12) ^ 2)) AS e1, sqrt(avg((fwd - 0.1 * rng) ^ 2)) AS e2 FROM f1 WHERE m12 IS NOT NULL"),
    ("out_", "SELECT e1 AS rmse_a, e2 AS rmse_b, (1 / e1) / (1 / e1 + 1 / e2) AS weight_a, (1 / e2) / (1 / e1 + 1 / e2) AS weight_b FROM e"), out=cols("out_", keys="", ts="", nums="rmse_a rmse_b weight_a weight_b")))
def ensemble_weights(spark, folder):
    err = lambda x: F.sqrt(F.avg((c("fwd") - 0.1 * c(x)) * (c("fwd") - 0.1 * c(x))))
    df = labeled(spark, folder).where("m12 is not null").agg(err("m12").alias("rmse_a"), err("rng").alias("rmse_b"))
    a, b = 1 / c("rmse_a"), 1 / c("rmse_b")
    return report(df.withColumns({"weight_a": a / (a + b), "weight_b": b / (a + b)}))


@query("fold_auc_summary", sql("bars", *LAB, ("n", f"SELECT *, (row_number() OVER ({P}) - 1) // 100 AS fold FROM f1 WHERE m12 IS NOT NULL"),
    ("rk", "SELECT fold, count(*) AS n, (sum(CASE WHEN label = 1 THEN rk ELSE 0 END) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) AS auc FROM (SELECT *, rank() OVER (PARTITION BY fold ORDER BY m12) + (count(*) OVER (PARTITION BY fold, m12) - 1) / 2 AS rk FROM n) GROUP BY 1"),
    ("out_", "SELECT count(*) AS folds, avg(auc) AS mean_auc, stddev_pop(auc) AS std_auc, sum(n * auc) / sum(n) AS weighted_auc FROM rk"), out=cols("out_", keys="", ts="", ints="folds", nums="mean_auc std_auc weighted_auc")))
def fold_auc_summary(spark, folder):
    df = clean(chunked(labeled(spark, folder).where("m12 is not null")).withColumn("fold", F.floor(c("_rn") / 100).cast("bigint")))
    folds = K.auc(df, "m12", "label", ["fold"])
    return report(folds.agg(F.count(F.lit(1)).alias("folds"), F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"), (F.sum(c("n") * c("auc")) / F.sum("n")).alias("weighted_auc")))

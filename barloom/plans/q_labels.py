"""Targets, splits and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import features as X
from barloom.operators import labels as L
from barloom.operators import splits as V

from barloom.plans.q_features import RET, TRS, alias
from barloom.plans.registry import query, report
from barloom.plans.sqltext import P, cols, full, lead, sql
from barloom.session import cut_lineage
from barloom.sources import bars as B

HORIZONS = (1, 2, 4, 6, 8, 12, 24, 48)


@query("horizon_label", sql("bars", ("f", alias({"fwd_ret": f"ln({lead('close', 4)} / close)"})),
    ("out_", "SELECT *, (fwd_ret > 0)::INT AS label FROM f WHERE fwd_ret IS NOT NULL"), out=cols("out_", ints="label", nums="fwd_ret")))
def horizon_label(spark, folder):
    return report(L.horizon_label(B.stored_bars(spark, folder)), "symbol", "ts", "label", "fwd_ret")


@query("labeled_dataset", sql("bars", ("f", alias({"fwd_ret": f"ln({lead('close', 4)} / close)", "ma_20": full("avg", "close", 20), "vol": full("stddev_samp", "close", 24)})),
    ("out_", "SELECT *, (fwd_ret > 0)::INT AS label FROM f WHERE fwd_ret IS NOT NULL AND ma_20 IS NOT NULL AND vol IS NOT NULL"), out=cols("out_", ints="label", nums="close ma_20 vol")))
def labeled_dataset(spark, folder):
    from barloom.functions.rolling import full as full_
    bars = B.stored_bars(spark, folder)
    df = X.chunked(bars, before=24, after=4)
    df = df.withColumns({"ma_20": full_(F.avg, "close", 20, X.W), "vol": full_(F.stddev_samp, "close", 24, X.W),
                         "fwd_ret": F.ln(F.try_divide(F.lead("close", 4).over(X.W()), F.col("close")))})
    df = X.clean(df).where("fwd_ret is not null").dropna(subset=["ma_20", "vol"])
    return report(df.withColumn("label", (F.col("fwd_ret") > 0).cast("int")), "symbol", "ts", "label", "close", "ma_20", "vol")


@query("forward_returns", sql("bars", ("out_", alias({f"fwd_{k}": f"ln({lead('close', k)} / close)" for k in HORIZONS})),
    out=cols("out_", nums=" ".join(f"fwd_{k}" for k in HORIZONS))))
def forward_returns(spark, folder):
    return report(L.forward_returns(B.stored_bars(spark, folder)), "symbol", "ts", *[f"fwd_{k}" for k in HORIZONS])


def barrier_sql(side):
    s = 1 if side == "long" else -1
    tp_hit = "b.high >= a.tpp" if s > 0 else "b.low <= a.tpp"
    sl_hit = "b.low <= a.slp" if s > 0 else "b.high >= a.slp"
    return sql("bars", TRS, ("a", alias({"atr": full("avg", "tr", 14), "rn": f"row_number() OVER ({P})", "n": "count(*) OVER (PARTITION BY symbol)"}, "tr")),
        ("l", f"SELECT *, CASE WHEN atr > 0 THEN close + {s} * 2 * atr END AS tpp, CASE WHEN atr > 0 THEN close - {s} * atr END AS slp FROM a"),
        ("h", f"""SELECT a.symbol, a.rn, min(CASE WHEN {tp_hit} THEN b.rn - a.rn END) AS t, min(CASE WHEN {sl_hit} THEN b.rn - a.rn END) AS s
  FROM l a JOIN l b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn + 1 AND a.rn + 23 WHERE a.atr > 0 GROUP BY 1, 2"""),
        ("out_", """SELECT l.symbol, l.ts, l.tpp AS tb_barrier_tp, l.slp AS tb_barrier_sl,
  CASE WHEN l.atr > 0 AND l.rn - 1 + 24 <= l.n THEN CASE WHEN h.s IS NOT NULL AND (h.t IS NULL OR h.s <= h.t) THEN -1 WHEN h.t IS NOT NULL THEN 1 ELSE 0 END END AS tb_label,
  CASE WHEN l.atr > 0 AND l.rn - 1 + 24 <= l.n THEN coalesce(least(h.s, h.t), 24) END AS tb_holding
  FROM l LEFT JOIN h ON l.symbol = h.symbol AND l.rn = h.rn"""),
        out=cols("(SELECT *, CASE WHEN tb_label IS NOT NULL THEN (tb_label = 1)::INT END AS tb_binary FROM out_)", ints="tb_label tb_binary tb_holding", nums="tb_barrier_tp tb_barrier_sl"))


for _side in ("long", "short"):
    @query(f"triple_barrier_{_side}", barrier_sql(_side))
    def triple_barrier(spark, folder, side=_side):
        return report(L.triple_barrier(B.stored_bars(spark, folder), side), "symbol", "ts", "tb_label", "tb_binary", "tb_holding", "tb_barrier_tp", "tb_barrier_sl")


@query("barrier_dataset", barrier_sql("long").replace("ELSE NULL", "ELSE NULL") + " WHERE tb_label IS NOT NULL")
def barrier_dataset(spark, folder):
    return report(L.triple_barrier(B.stored_bars(spark, folder)).where("tb_label is not null"),
                  "symbol", "ts", "tb_label", "tb_binary", "tb_holding", "tb_barrier_tp", "tb_barrier_sl")


@query("vol_norm_target", sql("bars", RET, ("f", alias({"fwd_ret": f"ln({lead('close', 8)} / close)", "v": full("stddev_samp", "r", 24, 12)}, "r")),
    ("g", "SELECT *, fwd_ret / (v + 1e-10) AS raw FROM f"),
    ("b", "SELECT symbol, avg(raw) AS mu, stddev_samp(raw) AS sd FROM g GROUP BY 1"),
    ("out_", "SELECT g.symbol, g.ts, fwd_ret, CASE WHEN raw IS NOT NULL THEN greatest(mu - 3 * sd, least(mu + 3 * sd, raw)) END AS target FROM g JOIN b USING (symbol)"),
    out=cols("out_", nums="fwd_ret target")))
def vol_norm_target(spark, folder):
    return report(L.volatility_target(B.stored_bars(spark, folder)), "symbol", "ts", "fwd_ret", "target")


FW = f"OVER ({P} ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING)"
EXC = ("exc", alias({"mae": f"CASE WHEN count(close) {FW} = 24 THEN (min(low) {FW} - close) / close * 100 END",
                     "mfe": f"CASE WHEN count(close) {FW} = 24 THEN (max(high) {FW} - close) / close * 100 END"}))


@query("mae_mfe", sql("bars", EXC, out=cols("exc", nums="mae mfe")))
def mae_mfe(spark, folder):
    return report(L.excursions(B.stored_bars(spark, folder)), "symbol", "ts", "mae", "mfe")


@query("move_targets", sql("bars", TRS, ("f", alias({"fr": f"{lead('close', 8)} / close - 1", "atr": full("avg", "tr", 14)}, "tr")),
    ("out_", "SELECT symbol, ts, fr / (atr / close * 100 / 100 + 1e-10) AS vol_adjusted, CASE WHEN fr IS NOT NULL THEN (abs(fr) > 0.02)::INT END AS big_move FROM f"),
    out=cols("out_", ints="big_move", nums="vol_adjusted")))
def move_targets(spark, folder):
    return report(L.move_targets(B.stored_bars(spark, folder)), "symbol", "ts", "big_move", "vol_adjusted")


@query("regime_target", sql("bars", ("s", alias({"up4": f"{lead('close', 4)} > close", "m": f"close / lag(close, 24) OVER ({P}) - 1"})),
    ("out_", "SELECT CASE WHEN m > 0 THEN 'up' ELSE 'down' END AS regime, count(*) AS n, avg(up4::INT) AS up_share FROM s WHERE up4 IS NOT NULL AND m IS NOT NULL GROUP BY 1"),
    out=cols("out_", keys="regime", ts="", ints="n", nums="up_share")))
def regime_target(spark, folder):
    df = X.chunked(B.stored_bars(spark, folder), before=24, after=4)
    df = df.withColumns({"up4": F.lead("close", 4).over(X.W()) > F.col("close"), "m": F.try_divide(F.col("close"), F.lag("close", 24).over(X.W())) - 1})
    df = X.clean(df).where("up4 is not null and m is not null")
    return report(df.groupBy(F.when(F.col("m") > 0, "up").otherwise("down").alias("regime")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("up4").cast("int")).alias("up_share")))


@query("sequence_windows", sql("bars", RET, ("w", f"SELECT symbol, ts, list(r) OVER ({P} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS rs, list(volume) OVER ({P} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS vs, count(r) OVER ({P} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS k FROM r"),
    ("out_", "SELECT symbol, ts, len(rs) AS length, rs[1] AS first_ret, rs[24] AS last_ret, list_sum(vs) AS volume FROM w WHERE k = 24"),
    out=cols("out_", ints="length", nums="first_ret last_ret volume")))
def sequence_windows(spark, folder):
    bars = X.features(B.stored_bars(spark, folder), X.returns).where("ret_1 is not null").select("symbol", "ts", "ret_1", "volume")
    df = L.sequences(bars, ["ret_1", "volume"])
    return report(df.select(
        "symbol", "ts", F.size("sequence").alias("length"), F.col("sequence")[0][0].alias("first_ret"),
        F.col("sequence")[23][0].alias("last_ret"),
        F.aggregate("sequence", F.lit(0.0), lambda a, v: a + v[1]).alias("volume")))


# --- splits ---------------------------------------------------------------------------------

NUM = ("n", f"SELECT symbol, ts, row_number() OVER ({P}) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars")


def fold_report(df, *keys):
    return report(df.groupBy("symbol", *keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))


FOLD_OUT = "SELECT symbol, {k}, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM f GROUP BY ALL"


@query("chrono_split", sql("bars", NUM, ("f", "SELECT *, CASE WHEN rn < floor(n * 0.7::DOUBLE) THEN 'train' WHEN rn < floor(n * 0.85::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM n"),
    ("out_", FOLD_OUT.format(k="split")), out=cols("out_", keys="symbol split", ts="first_ts last_ts", ints="n_rows")))
def chrono_split(spark, folder):
    return fold_report(V.chronological(V.numbered(B.stored_bars(spark, folder))), "split")


def folds_sql(ranges, k, extra=""):
    return sql("bars", NUM, ("rg", f"SELECT DISTINCT symbol, n, i AS fold FROM n, (SELECT unnest(range(0, {k})) AS i)"), ("r2", ranges),
        ("f", f"SELECT n.symbol, n.ts, r2.fold, r2.role FROM n JOIN r2 ON n.symbol = r2.symbol AND n.rn >= r2.lo AND n.rn < r2.hi{extra}"),
        ("out_", FOLD_OUT.format(k="fold, role")), out=cols("out_", keys="symbol role", ts="first_ts last_ts", ints="fold n_rows"))


@query("wf_splits", folds_sql("""SELECT symbol, fold, role, CASE role WHEN 'train' THEN 0 ELSE s END AS lo, CASE role WHEN 'train' THEN s - 12 ELSE least(s + t, n) END AS hi
  FROM (SELECT *, n - (7 - fold) * t AS s FROM (SELECT *, CAST(floor(n * 0.1::DOUBLE) AS BIGINT) AS t FROM rg)), (VALUES ('train'), ('test')) v(role) WHERE s >= t AND s - 12 >= 100""", 7))
def wf_splits(spark, folder):
    return fold_report(V.purged_walk_forward(V.numbered(B.stored_bars(spark, folder))), "fold", "role")


@query("gap_splits", folds_sql("""SELECT symbol, fold, role, CASE role WHEN 'train' THEN 0 ELSE s END AS lo, CASE role WHEN 'train' THEN s - 24 ELSE s + t END AS hi
  FROM (SELECT *, n - t - fold * (t // 5) AS s FROM (SELECT *, CAST(floor(n * 0.2::DOUBLE) AS BIGINT) AS t FROM rg)), (VALUES ('train'), ('test')) v(role) WHERE s >= t AND s - 24 > 0""", 5))
def gap_splits(spark, folder):
    return fold_report(V.gap_splits(V.numbered(B.stored_bars(spark, folder))), "fold", "role")


@query("three_way_splits", folds_sql("""SELECT symbol, fold, role, CASE role WHEN 'train' THEN 0 WHEN 'valid' THEN a ELSE b END AS lo, CASE role WHEN 'train' THEN a WHEN 'valid' THEN b ELSE c END AS hi
  FROM (SELECT *, least(b + st // 2, n) AS c FROM (SELECT *, least(a + st // 2, n) AS b FROM (SELECT *, (fold + 1) * st AS a FROM (SELECT *, n // 6 AS st FROM rg)))), (VALUES ('train'), ('valid'), ('test')) v(role)""", 5))
def three_way_splits(spark, folder):
    return fold_report(V.three_way_splits(V.numbered(B.stored_bars(spark, folder))), "fold", "role")


@query("calendar_split", sql("daily", ("f", "SELECT d.symbol, d.ts, CASE WHEN d.ts < e.a + INTERVAL 48 MONTHS THEN 'train' ELSE 'test' END AS split FROM daily d JOIN (SELECT symbol, min(ts) AS a FROM daily GROUP BY 1) e USING (symbol)"),
    ("out_", FOLD_OUT.format(k="split")), out=cols("out_", keys="symbol split", ts="first_ts last_ts", ints="n_rows")))
def calendar_split(spark, folder):
    return fold_report(V.calendar_split(B.stored_daily(spark, folder), 48), "split")


@query("decay_weights", sql("bars", NUM, ("w", "SELECT *, exp(-ln(2) / 8000 * (n - 1 - rn)) AS raw FROM n"),
    ("out_", "SELECT symbol, ts, raw / avg(raw) OVER (PARTITION BY symbol) AS weight FROM w"), out=cols("out_", nums="weight")))
def decay_weights(spark, folder):
    return report(V.decay_weights(V.numbered(B.stored_bars(spark, folder))), "symbol", "ts", "weight")


@query("class_weights", sql("bars", ("f", alias({"fwd_ret": f"ln({lead('close', 4)} / close)"})),
    ("l", "SELECT *, (fwd_ret > 0)::INT AS label FROM f WHERE fwd_ret IS NOT NULL"),
    ("out_", "SELECT symbol, ts, label, CASE WHEN label = 1 THEN (count(*) OVER (PARTITION BY symbol) - sum(label) OVER (PARTITION BY symbol)) / sum(label) OVER (PARTITION BY symbol) ELSE 1 END AS class_weight FROM l"),
    out=cols("out_", ints="label", nums="class_weight")))
def class_weights(spark, folder):
    return report(V.class_weights(L.horizon_label(B.stored_bars(spark, folder))), "symbol", "ts", "label", "class_weight")


@query("stratified_split", sql("bars", ("f", alias({"fwd_ret": f"ln({lead('close', 4)} / close)"})),
    ("l", "SELECT symbol, ts, (fwd_ret > 0)::INT AS label FROM f WHERE fwd_ret IS NOT NULL"),
    ("h", "SELECT *, md5(symbol || '|' || epoch_us(ts) || '|' || label || '|42') AS h FROM l"),
    ("r", "SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS p, count(*) OVER (PARTITION BY label) AS n FROM h"),
    ("out_", "SELECT symbol, ts, label, CASE WHEN p <= (n * 20 + 50) // 100 THEN 'test' ELSE 'train' END AS split FROM r"),
    out=cols("out_", keys="symbol split", ints="label")))
def stratified_split(spark, folder):
    return report(V.stratified_split(cut_lineage(L.horizon_label(B.stored_bars(spark, folder)))), "symbol", "split", "ts", "label")

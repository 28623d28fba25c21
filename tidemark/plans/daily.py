"""Queries over daily bars: scans, indicators, cross-sections and forward outcomes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import dedupe, patterns, portfolio, recursive
from ..operators import series as S
from ..sources.tables import table

PRICES = ["open", "high", "low", "close"]
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Bars as the indicators take them: surviving deliveries with finite positive prices and a volume.
BASE = """s AS (SELECT symbol, date, open, high, low, close, volume FROM bars QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY fetched_at DESC) = 1),
b AS (SELECT * FROM s WHERE isfinite(open) AND isfinite(high) AND isfinite(low) AND isfinite(close) AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0)"""


def query(name: str, sql: str | None = None):
    """Registers a query; ``sql`` follows the common table expressions of ``BASE`` where it begins with a comma or SELECT."""

    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql if sql.startswith("WITH ") else f"WITH {BASE}{sql}" if sql.startswith(",") else f"WITH {BASE} {sql}"
        return f

    return add


def surviving(spark: SparkSession, root: str) -> DataFrame:
    bars = table(spark, root, "bars", ["symbol", "date", *PRICES, "volume", "fetched_at"])
    return dedupe.keep_last_figures(bars, ["symbol", "date"], "fetched_at", [*PRICES, "volume"])


def finite(c: str) -> F.Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))


def clean_bars(spark: SparkSession, root: str) -> DataFrame:
    df = surviving(spark, root)
    for c in PRICES:
        df = df.where(finite(c) & (F.col(c) > 0))
    return df.where("volume >= 0")


def r6(c, name: str) -> F.Column:
    return F.round(c, 6).alias(name)


@query("bars_scan", "SELECT symbol, date, open, high, low, close, volume FROM b")
def bars_scan(spark, root):
    return clean_bars(spark, root)


@query("bars_asof", "SELECT symbol, date, close, volume FROM b WHERE date BETWEEN DATE '2024-06-01' AND least(DATE '2024-12-31', DATE '2024-11-15')")
def bars_asof(spark, root):
    """Bars of a period, none later than the as-of day. The bounds reach the Parquet scan."""
    lit = lambda d: F.lit(d).cast("date")
    b = clean_bars(spark, root).select("symbol", "date", "close", "volume")
    return b.where(F.col("date").between(lit("2024-06-01"), F.least(lit("2024-12-31"), lit("2024-11-15"))))


@query("bars_earliest_latest", "SELECT symbol, min(date) AS first_date, max(date) AS last_date, arg_max(close, date) AS last_close, count(*) AS n FROM b GROUP BY symbol")
def bars_earliest_latest(spark, root):
    return clean_bars(spark, root).groupBy("symbol").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max_by("close", "date").alias("last_close"), F.count("*").alias("n")
    )


@query("backfill_due", "SELECT symbol, first_date FROM (SELECT symbol, min(date) AS first_date FROM bars GROUP BY symbol) WHERE first_date > (SELECT min(date) FROM bars) + 7")
def backfill_due(spark, root):
    """Symbols whose history begins more than a week after the table's."""
    b = table(spark, root, "bars", ["symbol", "date"])
    first = b.groupBy("symbol").agg(F.min("date").alias("first_date"))
    start = b.agg(F.min("date").alias("start"))
    return first.join(F.broadcast(start), F.col("first_date") > F.date_add("start", 7)).select("symbol", "first_date")


@query("row_validation", """WITH t AS (SELECT symbol, count(*) AS n_rows, count(*) - count(DISTINCT date) AS n_repeated,
 count(*) FILTER (WHERE NOT isfinite(open) OR NOT isfinite(high) OR NOT isfinite(low) OR NOT isfinite(close)) AS n_non_finite FROM bars GROUP BY symbol)
SELECT symbol, n_rows, n_repeated, n_non_finite, n_repeated = 0 AND n_non_finite = 0 AS accepted FROM t""")
def row_validation(spark, root):
    """Per symbol: repeated days and non-finite cells; a symbol with either is rejected as a whole."""
    b = table(spark, root, "bars", ["symbol", "date", *PRICES])
    bad = ~(finite("open") & finite("high") & finite("low") & finite("close"))
    # Rows per (symbol, day) first: a distinct count that combines map-side.
    per_day = b.groupBy("symbol", "date").agg(F.count("*").alias("k"), F.count_if(bad).alias("bad"))
    t = per_day.groupBy("symbol").agg(
        F.sum("k").alias("n_rows"), (F.sum("k") - F.count("date")).alias("n_repeated"), F.sum("bad").alias("n_non_finite")
    )
    return t.withColumn("accepted", (F.col("n_repeated") == 0) & (F.col("n_non_finite") == 0))


@query("non_finite_rows", """WITH x AS (SELECT symbol, date, unnest(['open', 'high', 'low', 'close']) AS field, unnest([open, high, low, close]) AS value FROM bars)
SELECT symbol, date, field, CASE WHEN isnan(value) THEN 'nan' ELSE 'inf' END AS kind, count(*) AS n FROM x WHERE NOT isfinite(value) GROUP BY ALL""")
def non_finite_rows(spark, root):
    b = table(spark, root, "bars", ["symbol", "date", *PRICES])
    x = b.unpivot(["symbol", "date"], PRICES, "field", "value").where(F.col("value").isNotNull() & ~finite("value"))
    return x.groupBy("symbol", "date", "field", F.when(F.isnan("value"), "nan").otherwise("inf").alias("kind")).agg(F.count("*").alias("n"))


@query("bars_upsert_keep_last", """WITH u AS (SELECT symbol, date, close, volume, fetched_at, CASE WHEN fetched_at < TIMESTAMPTZ '2025-01-01 00:00:00+00' THEN 0 ELSE 1 END AS batch FROM bars)
SELECT symbol, date, close, CAST(volume AS DOUBLE) AS volume, batch FROM u QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY batch DESC, fetched_at DESC) = 1""")
def bars_upsert_keep_last(spark, root):
    """A later batch merged into what was there: the last delivery of each key stays."""
    b = table(spark, root, "bars", ["symbol", "date", "close", "volume", "fetched_at"])
    cut = F.lit("2025-01-01 00:00:00").cast("timestamp")
    old, new = b.where(F.col("fetched_at") < cut), b.where(F.col("fetched_at") >= cut)
    both = old.withColumn("batch", F.lit(0)).unionByName(new.withColumn("batch", F.lit(1)))
    return dedupe.keep_last(both, ["symbol", "date"], ["batch", "fetched_at"]).select("symbol", "date", "close", F.col("volume").cast("double"), "batch")


_ROWS = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
_ORD = "OVER (PARTITION BY symbol ORDER BY date)"


@query("sma_50_200", f""", t AS (SELECT symbol, date, CASE WHEN count(close) {_ROWS.format(49)} = 50 THEN avg(close) {_ROWS.format(49)} END AS a,
 CASE WHEN count(close) {_ROWS.format(199)} = 200 THEN avg(close) {_ROWS.format(199)} END AS c FROM b)
SELECT symbol, date, round(a, 6) AS sma50, round(c, 6) AS sma200 FROM t""")
def sma_50_200(spark, root):
    return clean_bars(spark, root).select("symbol", "date", r6(S.sma("close", 50), "sma50"), r6(S.sma("close", 200), "sma200"))


@query("trailing_volume_20", f"WITH {BASE} SELECT symbol, date, CASE WHEN count(*) {_ROWS.format(19)} = 20 THEN round(avg(volume) {_ROWS.format(19)}, 4) END AS avg_volume20 FROM s")
def trailing_volume_20(spark, root):
    """Mean of the volumes there are in the last 20 bars."""
    return surviving(spark, root).select("symbol", "date", F.round(S.trailing_mean("volume", 20), 4).alias("avg_volume20"))


@query("returns_ladder", "SELECT symbol, date, " + ", ".join(f"round(close / lag(close, {n}) {_ORD} - 1, 6) AS r{n}" for n in (1, 5, 21, 63)) + " FROM b")
def returns_ladder(spark, root):
    return clean_bars(spark, root).select("symbol", "date", *[r6(S.pct_change("close", n), f"r{n}") for n in (1, 5, 21, 63)])


@query("high_low_252", f""", t AS (SELECT symbol, date, close, count(close) {_ROWS.format(251)} AS n, max(close) {_ROWS.format(251)} AS hi, min(close) {_ROWS.format(251)} AS lo FROM b)
SELECT symbol, date, CASE WHEN n >= 100 THEN hi END AS high_252, CASE WHEN n >= 100 THEN lo END AS low_252, CASE WHEN n >= 100 THEN round(close / hi - 1, 6) END AS below_high FROM t""")
def high_low_252(spark, root):
    hi, lo = S.rolling_extreme("close", 252, 100, "max"), S.rolling_extreme("close", 252, 100, "min")
    return clean_bars(spark, root).select("symbol", "date", hi.alias("high_252"), lo.alias("low_252"), r6(F.col("close") / hi - 1, "below_high"))


@query("rising_streak_sma20", f""", t AS (SELECT symbol, date, CASE WHEN count(close) {_ROWS.format(19)} = 20 THEN round(avg(close) {_ROWS.format(19)}, 6) END AS m FROM b),
u AS (SELECT symbol, date, CASE WHEN m > lag(m) {_ORD} THEN 1 ELSE 0 END AS rose FROM t WHERE m IS NOT NULL),
v AS (SELECT *, sum(1 - rose) {_ORD} AS island FROM u)
SELECT symbol, date, CAST(sum(rose) OVER (PARTITION BY symbol, island ORDER BY date) AS BIGINT) AS streak FROM v""")
def rising_streak_sma20(spark, root):
    t = clean_bars(spark, root).select("symbol", "date", r6(S.sma("close", 20), "m"))
    return S.rising_streak(t, "m", "streak").select("symbol", "date", "streak")


@query("running_max_drawdown", f""", t AS (SELECT symbol, date, close, max(close) {_ORD} AS top FROM b)
SELECT symbol, round(max((top - close) / top), 6) AS max_drawdown, count(*) AS n FROM t GROUP BY symbol""")
def running_max_drawdown(spark, root):
    t = clean_bars(spark, root).select("symbol", S.drawdown("close").alias("d"))
    return t.groupBy("symbol").agg(r6(F.max("d"), "max_drawdown"), F.count("*").alias("n"))


@query("recovery_after_fall", f""", t AS (SELECT symbol, date, close, close / lag(close) {_ORD} - 1 AS r, max(close) OVER (PARTITION BY symbol ORDER BY date DESC) AS later FROM b)
SELECT symbol, date, round(r, 6) AS fall, later / close - 1 >= 0.05 AS recovered FROM t WHERE r <= -0.02""")
def recovery_after_fall(spark, root):
    """Falls of 2 % and whether any later close stands 5 % above."""
    t = clean_bars(spark, root).select("symbol", "date", "close", S.pct_change("close").alias("r"), S.suffix_max("close").alias("later"))
    return t.where("r <= -0.02").select("symbol", "date", r6(F.col("r"), "fall"), (F.col("later") / F.col("close") - 1 >= 0.05).alias("recovered"))


@query("distribution_days", f""", t AS (SELECT symbol, date, CASE WHEN volume > lag(volume) {_ORD} AND close / lag(close) {_ORD} - 1 <= -0.002 THEN 1.0
 WHEN volume > lag(volume) {_ORD} AND abs(close / lag(close) {_ORD} - 1) < 0.001 THEN 0.5 ELSE 0.0 END AS d FROM b)
SELECT symbol, date, """ + ", ".join(f"CAST(sum(d) {_ROWS.format(n - 1)} AS DOUBLE) AS d{n}" for n in (25, 15, 5)) + " FROM t")
def distribution_days(spark, root):
    """Weighted days of falling price on rising volume among the last 25, 15 and 5 bars."""
    w = S.by("symbol", "date")
    up, r = F.col("volume") > F.lag("volume").over(w), S.pct_change("close")
    d = F.when(up & (r <= -0.002), 1.0).when(up & (F.abs(r) < 0.001), 0.5).otherwise(0.0)
    t = clean_bars(spark, root).withColumn("d", d)
    return t.select("symbol", "date", *[F.sum("d").over(w.rowsBetween(1 - n, 0)).alias(f"d{n}") for n in (25, 15, 5)])


@query("trend_episodes", f""", t AS (SELECT symbol, date, close, CASE WHEN count(close) {_ROWS.format(49)} < 50 THEN 'unknown' WHEN close >= round(avg(close) {_ROWS.format(49)}, 6) THEN 'above' ELSE 'below' END AS level FROM b),
u AS (SELECT *, CASE WHEN lag(level) {_ORD} IS NOT DISTINCT FROM level AND row_number() {_ORD} > 1 THEN 0 ELSE 1 END AS new FROM t),
e AS (SELECT *, sum(new) {_ORD} AS episode FROM u)
SELECT symbol, CAST(episode AS BIGINT) AS episode, level, min(date) AS first_date, max(date) AS last_date, count(*) AS n_bars FROM e GROUP BY symbol, episode, level""")
def trend_episodes(spark, root):
    """Runs of bars above or below the 50-bar mean."""
    m = F.round(S.sma("close", 50), 6)
    t = clean_bars(spark, root).withColumn("m", m)
    t = t.select("symbol", "date", F.when(F.col("m").isNull(), "unknown").when(F.col("close") >= F.col("m"), "above").otherwise("below").alias("level"))
    e = S.episodes(t, "level", "episode")
    return e.groupBy("symbol", "episode", "level").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_bars"))


_LEAD = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {} FOLLOWING)"


@query("forward_outcomes", "SELECT symbol, date, " + ", ".join(
    f"round(lead(close, {h}) {_ORD} / close - 1, 6) AS ret_{h}, CASE WHEN count(close) {_LEAD.format(h)} = {h} THEN round(least(0.0, min(close) {_LEAD.format(h)} / close - 1), 6) END AS worst_{h}" for h in (5, 20)) + " FROM b")
def forward_outcomes(spark, root):
    cols = []
    for h in (5, 20):
        cols += [r6(S.forward_return("close", h), f"ret_{h}"), r6(S.forward_worst("close", h), f"worst_{h}")]
    return clean_bars(spark, root).select("symbol", "date", *cols)


@query("percentile_ties", """, m AS (SELECT date, symbol, round(close / open - 1, 3) AS x FROM b), k AS (SELECT date, x, count(*) AS k FROM m GROUP BY date, x),
p AS (SELECT date, x, k, sum(k) OVER (PARTITION BY date ORDER BY x) AS upto, sum(k) OVER (PARTITION BY date) AS n FROM k)
SELECT m.date, m.symbol, m.x, round(CASE WHEN n = 1 THEN 0.5 ELSE (upto - (k + 1) / 2.0) / (n - 1) END, 6) AS pct FROM m JOIN p ON p.date = m.date AND p.x = m.x""")
def percentile_ties(spark, root):
    """Cross-sectional percentile of the day's move, equal moves sharing their mean rank."""
    t = clean_bars(spark, root).select("date", "symbol", F.round(F.col("close") / F.col("open") - 1, 3).alias("x"))
    return S.percentile_rank(t, "x", ["date"], "pct").select("date", "symbol", "x", r6(F.col("pct"), "pct"))


def _strength_sql(lags: tuple[int, ...]) -> str:
    parts = " + ".join(f"{w} * (close / lag(close, {n}) {_ORD} - 1)" for w, n in zip(_WEIGHTS, lags))
    return f""", l AS (SELECT symbol, date, round({parts}, 6) AS rs FROM b),
m AS (SELECT * FROM l WHERE rs IS NOT NULL), k AS (SELECT date, rs, count(*) AS k FROM m GROUP BY date, rs),
p AS (SELECT date, rs, k, sum(k) OVER (PARTITION BY date ORDER BY rs) AS upto, sum(k) OVER (PARTITION BY date) AS n FROM k)
SELECT m.date, m.symbol, m.rs, round(100 * CASE WHEN n = 1 THEN 0.5 ELSE (upto - (k + 1) / 2.0) / (n - 1) END, 4) AS rs_pct FROM m JOIN p ON p.date = m.date AND p.rs = m.rs"""


_WEIGHTS = (0.4, 0.2, 0.2, 0.2)
_QUARTERS, _MONTHS = (63, 126, 189, 252), (21, 42, 63, 84)


def _strength(spark, root, lags: tuple[int, ...]) -> DataFrame:
    parts = [w * S.pct_change("close", n) for w, n in zip(_WEIGHTS, lags)]
    t = clean_bars(spark, root).select("date", "symbol", r6(parts[0] + parts[1] + parts[2] + parts[3], "rs")).where("rs IS NOT NULL")
    return S.percentile_rank(t, "rs", ["date"], "p").select("date", "symbol", "rs", F.round(100 * F.col("p"), 4).alias("rs_pct"))


@query("relative_strength", _strength_sql(_QUARTERS))
def relative_strength(spark, root):
    """Weighted sum of the returns over one to four quarters as a percentile of the day's symbols; 253 bars are needed."""
    return _strength(spark, root, _QUARTERS)


@query("relative_strength_monthly", _strength_sql(_MONTHS))
def relative_strength_monthly(spark, root):
    """The same over one to four months."""
    return _strength(spark, root, _MONTHS)


def _recursion(step: str, first: str, tables: str, columns: str) -> str:
    return f"""WITH RECURSIVE {BASE}{tables}, rec AS (SELECT {first} FROM x WHERE rn = 1 UNION ALL SELECT {step} FROM rec JOIN x ON x.symbol = rec.symbol AND x.rn = rec.rn + 1) SELECT {columns} FROM rec"""


@query("wilder_rsi14", _recursion(
    "x.symbol, x.date, x.rn, rec.g + (x.up - rec.g) / 14, rec.l + (x.dn - rec.l) / 14", "symbol, date, rn, up AS g, dn AS l",
    f", d AS (SELECT symbol, date, close - lag(close) {_ORD} AS m FROM b), x AS (SELECT symbol, date, greatest(m, 0.0) AS up, greatest(-m, 0.0) AS dn, row_number() {_ORD} AS rn FROM d WHERE m IS NOT NULL)",
    "symbol, date, CASE WHEN rn >= 14 THEN round(CASE WHEN l = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + g / l) END, 6) END AS rsi14").replace("FROM rec", "FROM rec", 1)
    + " UNION ALL SELECT symbol, min(date), NULL FROM b GROUP BY symbol")
def wilder_rsi14(spark, root):
    t = recursive.smoothed_indicators(clean_bars(spark, root))
    return t.select("symbol", "date", r6(F.col("rsi"), "rsi14"))


@query("wilder_atr14", _recursion(
    "x.symbol, x.date, x.rn, rec.a + (x.tr - rec.a) / 14", "symbol, date, rn, tr AS a",
    f", x AS (SELECT symbol, date, row_number() {_ORD} AS rn, greatest(high - low, coalesce(abs(high - lag(close) {_ORD}), 0.0), coalesce(abs(low - lag(close) {_ORD}), 0.0)) AS tr FROM b)",
    "symbol, date, CASE WHEN rn >= 14 THEN round(a, 6) END AS atr14"))
def wilder_atr14(spark, root):
    t = recursive.smoothed_indicators(clean_bars(spark, root))
    return t.select("symbol", "date", r6(F.col("atr"), "atr14"))


@query("ema_seeded_21", _recursion(
    "x.symbol, x.date, x.rn, CASE WHEN x.rn < 21 THEN 0.0 WHEN x.rn = 21 THEN x.seed ELSE rec.e + (x.close - rec.e) * (2.0::DOUBLE / 22) END", "symbol, date, rn, 0.0::DOUBLE AS e",
    f", x AS (SELECT symbol, date, close, row_number() {_ORD} AS rn, avg(close) {_ROWS.format(20)} AS seed FROM b)",
    "symbol, date, CASE WHEN rn >= 41 THEN round(e, 6) END AS ema21"))
def ema_seeded_21(spark, root):
    t = recursive.smoothed_indicators(clean_bars(spark, root))
    return t.select("symbol", "date", r6(F.col("ema"), "ema21"))


@query("turning_points")
def turning_points(spark, root):
    return recursive.turning_points(clean_bars(spark, root))


@query("contractions")
def contractions(spark, root):
    """Falls between turning points and how they tighten."""
    t = patterns.contractions(recursive.turning_points(clean_bars(spark, root)))
    return t.withColumns({c: F.round(c, 6) for c in ("depth", "ratio")})


@query("rally_states")
def rally_states(spark, root):
    """Transitions of each symbol's rally automaton."""
    return patterns.fold_days(clean_bars(spark, root), "symbol", "date", ["low", "close", "volume"], patterns.rally_step, None)


def _trades(spark, root) -> DataFrame:
    """Portfolios of the ranked screen: one for each number of slots."""
    o = ranked_screen(spark, root).select("date", "symbol", "rank")
    o = o.select(F.explode(F.array(*[F.lit(f"top{n}") for n in (3, 5, 10)])).alias("portfolio"), "*")
    o = o.where(F.col("rank") <= F.replace("portfolio", F.lit("top")).cast("int"))
    return portfolio.simulated_trades(o, clean_bars(spark, root))


@query("portfolio_trades")
def portfolio_trades(spark, root):
    t = _trades(spark, root)
    return t.withColumns({c: F.round(c, 6) for c in ("entry", "exit", "pnl")})


@query("portfolio_metrics")
def portfolio_metrics(spark, root):
    return portfolio.trade_metrics(_trades(spark, root))


@query("equal_weight_basket", f""", r AS (SELECT date, close / lag(close) {_ORD} - 1 AS r FROM b), d AS (SELECT date, coalesce(avg(r), 0.0) AS m, count(r) AS n FROM r GROUP BY date)
SELECT date, n, round(m, 6) AS mean_move, round(exp(sum(ln(1 + m)) OVER (ORDER BY date)), 4) AS level FROM d""")
def equal_weight_basket(spark, root):
    """Mean move of all symbols per day and its cumulative product. The last window runs over one row per day only."""
    r = clean_bars(spark, root).select("date", S.pct_change("close").alias("r"))
    d = r.groupBy("date").agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("m"), F.count("r").alias("n"))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("date", "n", r6(F.col("m"), "mean_move"), F.round(F.exp(F.sum(F.log(1 + F.col("m"))).over(w)), 4).alias("level"))


@query("trailing_stop", f""", t AS (SELECT symbol, date, close, max(close) {_ROWS.format(20)} * 0.92 AS stop FROM b)
SELECT symbol, date, round(stop, 6) AS stop, coalesce(close < lag(stop) {_ORD}, false) AS hit FROM t""")
def trailing_stop(spark, root):
    """A stop 8 % under the highest close of 21 bars, and whether the next close falls below it."""
    t = clean_bars(spark, root).withColumn("stop", S.rolling_extreme("close", 21, 1, "max") * 0.92)
    return t.select("symbol", "date", r6(F.col("stop"), "stop"), F.coalesce(F.col("close") < F.lag("stop").over(S.by("symbol", "date")), F.lit(False)).alias("hit"))


@query("sharpe_by_symbol", f""", r AS (SELECT symbol, close / lag(close) {_ORD} - 1 AS r FROM b)
SELECT symbol, count(r) AS n, CASE WHEN count(r) >= 2 AND stddev_samp(r) > 0 THEN round(avg(r) / stddev_samp(r) * sqrt(252), 4) END AS sharpe FROM r GROUP BY symbol""")
def sharpe_by_symbol(spark, root):
    r = clean_bars(spark, root).select("symbol", S.pct_change("close").alias("r"))
    sd = F.stddev_samp("r")
    return r.groupBy("symbol").agg(
        F.count("r").alias("n"), F.when((F.count("r") >= 2) & (sd > 0), F.round(F.avg("r") / sd * F.sqrt(F.lit(252.0)), 4)).alias("sharpe")
    )


_CHECKS = f"""t AS (SELECT symbol, date, close, volume, count(close) {_ROWS.format(49)} AS n, round(avg(close) {_ROWS.format(49)}, 6) AS m50, round(avg(close) {_ROWS.format(19)}, 6) AS m20, avg(volume) {_ROWS.format(19)} AS v20, round(close / lag(close, 21) {_ORD} - 1, 6) AS r21 FROM b),
c AS (SELECT symbol, date, unnest(['liquid', 'above_mean', 'mean_rising', 'month_up']) AS name,
 unnest([v20 > 500000, CASE WHEN n = 50 THEN close > m50 END, CASE WHEN n = 50 THEN m20 > m50 END, r21 > 0]) AS passed FROM t)"""


def _checks(spark, root) -> DataFrame:
    """Four independent checks of every symbol and day, one row each; null where data is missing."""
    w = S.by("symbol", "date")
    m50 = F.round(F.avg("close").over(w.rowsBetween(-49, 0)), 6)
    enough = F.count("close").over(w.rowsBetween(-49, 0)) == 50
    m20 = F.round(F.avg("close").over(w.rowsBetween(-19, 0)), 6)
    t = clean_bars(spark, root).select(
        "symbol", "date",
        (F.avg("volume").over(w.rowsBetween(-19, 0)) > 500000).alias("liquid"),
        F.when(enough, F.col("close") > m50).alias("above_mean"),
        F.when(enough, m20 > m50).alias("mean_rising"),
        (F.round(S.pct_change("close", 21), 6) > 0).alias("month_up"),
    )
    return t.unpivot(["symbol", "date"], ["liquid", "above_mean", "mean_rising", "month_up"], "name", "passed")


@query("check_statistics", f""", {_CHECKS}, f AS (SELECT *, count(*) FILTER (WHERE passed = false) OVER (PARTITION BY symbol, date) AS failed FROM c)
SELECT name, count(*) FILTER (WHERE passed) AS n_passed, count(*) FILTER (WHERE passed = false) AS n_failed, count(*) FILTER (WHERE passed IS NULL) AS n_no_data, count(*) FILTER (WHERE passed = false AND failed = 1) AS n_sole FROM f GROUP BY name""")
def check_statistics(spark, root):
    """How often each check passes, fails, lacks data, and is the only one that fails."""
    c = _checks(spark, root)
    failed = F.count_if(~F.col("passed")).over(Window.partitionBy("symbol", "date"))
    return c.withColumn("failed", failed).groupBy("name").agg(
        F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed"),
        F.count_if(F.col("passed").isNull()).alias("n_no_data"), F.count_if(~F.col("passed") & (F.col("failed") == 1)).alias("n_sole"),
    )


@query("co_blocked_pairs", f""", {_CHECKS}, l AS (SELECT symbol, date, list(name ORDER BY name) AS names FROM c WHERE passed = false GROUP BY symbol, date),
p AS (SELECT unnest(list_filter(flatten([[{{'a': x, 'b': y}} for y in names] for x in names]), lambda z: z.a < z.b)) AS pair FROM l)
SELECT pair.a AS first_check, pair.b AS second_check, count(*) AS n FROM p GROUP BY ALL""")
def co_blocked_pairs(spark, root):
    """Unordered pairs of checks that fail together. The pairs are of the four checks of a row, never of rows."""
    names = F.array_sort(F.collect_list("name"))
    f = _checks(spark, root).where(~F.col("passed")).groupBy("symbol", "date").agg(names.alias("names"))
    pairs = F.flatten(F.transform("names", lambda a: F.transform(F.filter("names", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    p = f.select(F.explode(pairs).alias("p"))
    return p.groupBy(F.col("p.a").alias("first_check"), F.col("p.b").alias("second_check")).agg(F.count("*").alias("n"))


@query("first_rejection", f""", {_CHECKS}, o AS (SELECT *, CASE name WHEN 'liquid' THEN 1 WHEN 'above_mean' THEN 2 WHEN 'mean_rising' THEN 3 ELSE 4 END AS k FROM c),
r AS (SELECT date, symbol, coalesce(arg_min(CASE WHEN passed IS NULL THEN name || '_no_data' ELSE name END, k) FILTER (WHERE passed IS DISTINCT FROM true), 'passed') AS reason FROM o GROUP BY date, symbol)
SELECT date, reason, count(*) AS n FROM r GROUP BY date, reason""")
def first_rejection(spark, root):
    """Symbols per day by the first check, in order, that they do not pass."""
    order = F.when(F.col("name") == "liquid", 1).when(F.col("name") == "above_mean", 2).when(F.col("name") == "mean_rising", 3).otherwise(4)
    c = _checks(spark, root).withColumn("k", F.when(~F.coalesce("passed", F.lit(False)), order))
    label = F.when(F.col("passed").isNull(), F.concat("name", F.lit("_no_data"))).otherwise(F.col("name"))
    r = c.groupBy("date", "symbol").agg(F.coalesce(F.min_by(label, "k"), F.lit("passed")).alias("reason"))
    return r.groupBy("date", "reason").agg(F.count("*").alias("n"))


@query("ranked_screen", f""", t AS (SELECT symbol, date, close, avg(volume) {_ROWS.format(19)} AS v20, count(*) {_ROWS.format(49)} AS n, round(avg(close) {_ROWS.format(49)}, 6) AS m50, round(close / lag(close, 21) {_ORD} - 1, 6) AS r21 FROM b),
h AS (SELECT date, symbol, r21, round(close / m50 - 1, 6) AS gap FROM t WHERE n = 50 AND close > m50 AND v20 > 500000 AND r21 IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY r21 DESC, symbol) AS rank, count(*) OVER (PARTITION BY date) AS n_hits FROM h)
SELECT date, symbol, r21, gap, CAST(rank AS INTEGER) AS rank, n_hits FROM k WHERE rank <= 10""")
def ranked_screen(spark, root):
    """Per day the ten strongest symbols that pass the screen, with the number that passed."""
    w = S.by("symbol", "date")
    m50 = F.round(F.avg("close").over(w.rowsBetween(-49, 0)), 6)
    t = clean_bars(spark, root).select(
        "symbol", "date", "close", F.avg("volume").over(w.rowsBetween(-19, 0)).alias("v20"), F.count("*").over(w.rowsBetween(-49, 0)).alias("n"),
        m50.alias("m50"), F.round(S.pct_change("close", 21), 6).alias("r21"),
    )
    h = t.where("n = 50 AND close > m50 AND v20 > 500000 AND r21 IS NOT NULL").withColumn("gap", F.round(F.col("close") / F.col("m50") - 1, 6))
    hits = h.groupBy("date").agg(F.count("*").alias("n_hits"))
    # row_number <= 10 becomes a group limit before the shuffle.
    best = h.withColumn("rank", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("r21"), "symbol"))).where("rank <= 10")
    return best.join(hits, "date").select("date", "symbol", "r21", "gap", "rank", "n_hits")


@query("session_lookup", """, c AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM b))
SELECT c.date, p.date AS five_back, n.date AS twenty_on FROM c LEFT JOIN c p ON p.k = c.k - 5 LEFT JOIN c n ON n.k = c.k + 20""")
def session_lookup(spark, root):
    """The session 5 back and 20 on from every session. One row per day: the single-partition window is bounded by the calendar."""
    w = Window.orderBy("date")
    return clean_bars(spark, root).select("date").distinct().select("date", F.lag("date", 5).over(w).alias("five_back"), F.lead("date", 20).over(w).alias("twenty_on"))


@query("parameter_grid", """WITH a AS (SELECT unnest([3, 5, 8]) AS fast), s AS (SELECT unnest([5, 8, 13, 21]) AS slow), x AS (SELECT unnest([0.5, 1.0, 1.5]) AS width)
SELECT fast, slow, CAST(width AS DOUBLE) AS width FROM a, s, x WHERE fast < slow""")
def parameter_grid(spark, root):
    """All allowed combinations of three short parameter lists."""
    grid = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in (3, 5, 8)])).alias("fast"))
    grid = grid.select("fast", F.explode(F.array(*[F.lit(x) for x in (5, 8, 13, 21)])).alias("slow")).where("fast < slow")
    return grid.select("fast", "slow", F.explode(F.array(*[F.lit(x) for x in (0.5, 1.0, 1.5)])).alias("width"))


@query("grid_sweep", f""", g AS (SELECT unnest([3, 5, 8]) AS k), t AS (SELECT symbol, date, close / lag(close) {_ORD} - 1 AS r, lead(close, 5) {_ORD} / close - 1 AS f FROM b)
SELECT k, count(*) FILTER (WHERE r <= -k / 100.0) AS n, round(avg(f) FILTER (WHERE r <= -k / 100.0), 6) AS mean_fwd FROM t, g GROUP BY k""")
def grid_sweep(spark, root):
    """One threshold at several values in a single pass: conditional aggregates, not a pass per value."""
    t = clean_bars(spark, root).select(S.pct_change("close").alias("r"), S.forward_return("close", 5).alias("f"))
    aggs = []
    for k in (3, 5, 8):
        hit = F.col("r") <= -k / 100.0
        aggs += [F.count_if(hit).alias(f"n{k}"), F.round(F.avg(F.when(hit, F.col("f"))), 6).alias(f"m{k}")]
    one = t.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"n{k}").alias("n"), F.col(f"m{k}").alias("mean_fwd")) for k in (3, 5, 8)])
    return one.select(F.inline(rows))


@query("frame_digest", """, h AS (SELECT md5(concat_ws('|', symbol, strftime(date, '%Y-%m-%d'), CAST(CAST(round(close * 100) AS BIGINT) AS VARCHAR), CAST(volume AS VARCHAR))) AS h FROM b)
SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS VARCHAR) AS total, CAST(bit_xor(CAST('0x' || substr(h, 13, 12) AS BIGINT)) AS BIGINT) AS mixed FROM h""")
def frame_digest(spark, root):
    """A digest that does not depend on row order, made by commutative aggregates instead of a sort."""
    h = F.md5(F.concat_ws("|", "symbol", F.date_format("date", "yyyy-MM-dd"), F.round(F.col("close") * 100).cast("long").cast("string"), F.col("volume").cast("string")))
    t = clean_bars(spark, root).select(h.alias("h"))
    part = lambda a: F.conv(F.substring("h", a, 12), 16, 10)
    return t.agg(
        F.count("*").alias("n"), F.sum(part(1).cast("decimal(20,0)")).cast("string").alias("total"), F.bit_xor(part(13).cast("long")).alias("mixed")
    )


@query("month_pivot", """, m AS (SELECT strftime(date, '%Y-%m') AS month, dayofweek(date) AS d, close / open - 1 AS r FROM b)
SELECT month, """ + ", ".join(f"round(avg(r) FILTER (WHERE d = {k}), 6) AS {n}" for k, n in ((1, "mon"), (2, "tue"), (3, "wed"), (4, "thu"), (5, "fri"))) + " FROM m GROUP BY month")
def month_pivot(spark, root):
    """Mean move by month and weekday as a matrix; the pivot values are given, so no extra pass finds them."""
    t = clean_bars(spark, root).select(
        F.date_format("date", "yyyy-MM").alias("month"), F.dayofweek("date").alias("d"), (F.col("close") / F.col("open") - 1).alias("r")
    )
    p = t.groupBy("month").pivot("d", [2, 3, 4, 5, 6]).agg(F.round(F.avg("r"), 6))
    return p.select("month", *[F.col(f"`{k}`").alias(n) for k, n in ((2, "mon"), (3, "tue"), (4, "wed"), (5, "thu"), (6, "fri"))])


QUERIES = Q

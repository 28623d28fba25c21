"""Queries over tracked positions, screens as rule ladders, composed statistics and text budgets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import positions, recursive, screens
from ..operators import series as S
from ..sources.tables import table
from . import daily
from .daily import _ORD, _ROWS, BASE, clean_bars, r6
from .ledger import OUT, RUN, VER, last_runs, outcomes, verdicts

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


day = lambda c: F.date_format(c, "yyyy-MM-dd")
HOLD, KEEP = 20, 0.92

# Tracked positions ----------------------------------------------------------------------------------------------------------

_MARKS = f"""{BASE}, nb AS (SELECT symbol, date, open, low, close, row_number() {_ORD} AS rn FROM b),
seed AS (SELECT v.run_id, v.symbol, nb.date AS as_of, nb.close AS entry, nb.rn AS rn0 FROM (SELECT DISTINCT run_id, symbol, as_of FROM verdicts WHERE recommendation = 'proceed') v JOIN nb ON nb.symbol = v.symbol AND nb.date = v.as_of),
ps AS (SELECT seed.*, nb.date, nb.open, nb.low, nb.close, nb.rn - rn0 AS k, greatest(entry * 0.92, coalesce(max(nb.close * 0.92) OVER (PARTITION BY seed.run_id, seed.symbol ORDER BY nb.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS stop
 FROM seed JOIN nb ON nb.symbol = seed.symbol AND nb.rn > rn0 AND nb.rn <= rn0 + 20),
ev AS (SELECT *, CASE WHEN open <= stop THEN 'gap_stop' WHEN low <= stop THEN 'stop' WHEN k >= 20 THEN 'max_hold' END AS reason FROM ps),
fi AS (SELECT *, min(k) FILTER (WHERE reason IS NOT NULL) OVER (PARTITION BY run_id, symbol) AS last FROM ev),
mk AS (SELECT run_id, symbol, as_of, entry, date, k, reason, CASE reason WHEN 'gap_stop' THEN open WHEN 'stop' THEN stop ELSE close END AS price FROM fi WHERE last IS NULL OR k <= last),
tp AS (SELECT seed.run_id, seed.symbol, seed.as_of, seed.entry, coalesce(max(mk.k), 0) AS held, max(mk.date) AS marked, arg_max(mk.price, mk.k) AS price, max(mk.reason) AS reason FROM seed LEFT JOIN mk ON mk.run_id = seed.run_id AND mk.symbol = seed.symbol GROUP BY ALL)"""


def _seeds(spark, root) -> DataFrame:
    """Positions at the close of the verdict's day, with a stop a part below it."""
    v = table(spark, root, "verdicts", ["run_id", "symbol", "as_of", "recommendation"]).where("recommendation = 'proceed'").select("run_id", "symbol", "as_of").distinct()
    b = clean_bars(spark, root).select("symbol", F.col("date").alias("as_of"), F.col("close").alias("entry"))
    none = lambda t: F.lit(None).cast(t)
    return v.join(b, ["symbol", "as_of"]).select(
        "run_id", "symbol", "as_of", "entry", (F.col("entry") * KEEP).alias("stop"), F.lit(0).alias("held"), F.col("as_of").alias("marked"), none("double").alias("price"), none("string").alias("reason")
    )


def _wanted_bars(spark, root, seeds: DataFrame) -> DataFrame:
    return clean_bars(spark, root).join(seeds.select("symbol").distinct(), "symbol", "left_semi")


def _marks(spark, root) -> DataFrame:
    s = _seeds(spark, root)
    return positions.marks(s, _wanted_bars(spark, root, s), ["run_id"], HOLD, KEEP)


def _tracked(spark, root) -> DataFrame:
    s = _seeds(spark, root)
    return positions.advance(s, _wanted_bars(spark, root, s), ["run_id"], HOLD, KEEP)


@query("tracked_positions", f"WITH {_MARKS} SELECT run_id, symbol, entry, CAST(held AS INTEGER) AS held, strftime(coalesce(marked, as_of), '%Y-%m-%d') AS marked, round(price, 6) AS price, coalesce(reason, 'open') AS status, round(100 * (price / entry - 1), 6) AS pct FROM tp")
def tracked_positions(spark, root):
    """Each position carried on bar by bar to its exit or the last bar."""
    t = _tracked(spark, root)
    return t.select("run_id", "symbol", "entry", "held", day("marked").alias("marked"), r6(F.col("price"), "price"), F.coalesce("reason", F.lit("open")).alias("status"), r6(100 * (F.col("price") / F.col("entry") - 1), "pct"))


@query("position_marks", f"WITH {_MARKS} SELECT run_id, symbol, strftime(date, '%Y-%m-%d') AS day, CAST(k AS INTEGER) AS held, round(price, 6) AS price, round(100 * (price / entry - 1), 6) AS pct FROM mk")
def position_marks(spark, root):
    """The value of each position on every day that it is held."""
    return _marks(spark, root).select("run_id", "symbol", day("date").alias("day"), "held", r6(F.col("price"), "price"), r6(100 * (F.col("price") / F.col("entry") - 1), "pct"))


@query("mark_to_market", f"WITH {_MARKS} SELECT strftime(date, '%Y-%m-%d') AS day, count(*) AS n_open, round(sum(price / entry), 5) AS equity, round(avg(price / entry - 1), 6) AS mean_pct FROM mk GROUP BY date")
def mark_to_market(spark, root):
    """Value per day of a unit in every open position."""
    rel = F.col("price") / F.col("entry")
    return _marks(spark, root).groupBy("date").agg(F.count("*").alias("n_open"), F.round(F.sum(rel), 5).alias("equity"), r6(F.avg(rel - 1), "mean_pct")).select(day("date").alias("day"), "n_open", "equity", "mean_pct")


@query("exposure_summary", f"WITH {_MARKS}, d AS (SELECT date, count(*) AS n FROM mk GROUP BY date), a AS (SELECT count(DISTINCT date) AS days FROM b) SELECT max(n) AS max_concurrent, round(sum(n)::DOUBLE / max(days), 6) AS mean_open, round(count(*)::DOUBLE / max(days), 6) AS invested_days FROM d, a")
def exposure_summary(spark, root):
    """Most positions at once, their mean number over all days and the share of days with any."""
    d = _marks(spark, root).groupBy("date").agg(F.count("*").alias("n")).agg(F.max("n").alias("max_concurrent"), F.sum("n").alias("total"), F.count("*").alias("some"))
    a = clean_bars(spark, root).select("date").distinct().agg(F.count("*").alias("days"))
    return d.crossJoin(F.broadcast(a)).select("max_concurrent", r6(F.col("total") / F.col("days"), "mean_open"), r6(F.when(F.col("days") > 0, F.col("some") / F.col("days")), "invested_days"))


@query("exit_statistics", f"""WITH {_MARKS}, r AS (SELECT *, (price - entry) / (entry - entry * 0.92) AS rm FROM tp WHERE reason IS NOT NULL)
SELECT count(*) AS n_closed, count(*) FILTER (WHERE reason = 'gap_stop') AS n_gap_stop, count(*) FILTER (WHERE reason = 'stop') AS n_stop, count(*) FILTER (WHERE reason = 'max_hold') AS n_max_hold,
 round(avg(CASE WHEN reason = 'max_hold' THEN 1.0 ELSE 0.0 END), 6) AS hold_binding, round(avg(rm), 5) AS mean_r, round(avg(held), 6) AS mean_held FROM r""")
def exit_statistics(spark, root):
    """Exits by reason, how often the holding limit binds and the mean multiple of the risk taken."""
    t = _tracked(spark, root).where("reason IS NOT NULL").withColumn("rm", (F.col("price") - F.col("entry")) / (F.col("entry") - F.col("entry") * KEEP))
    of = lambda r: F.count_if(F.col("reason") == r).alias(f"n_{r}")
    return t.agg(F.count("*").alias("n_closed"), of("gap_stop"), of("stop"), of("max_hold"), r6(F.avg((F.col("reason") == "max_hold").cast("double")), "hold_binding"), F.round(F.avg("rm"), 5).alias("mean_r"), r6(F.avg("held"), "mean_held"))


@query("tracked_strata", f"""WITH {_MARKS}, j AS (SELECT tp.reason, tp.price / tp.entry - 1 AS r, v.strategy_key, v.news_supply_level FROM tp JOIN (SELECT DISTINCT run_id, symbol, strategy_key, news_supply_level FROM verdicts) v ON v.run_id = tp.run_id AND v.symbol = tp.symbol WHERE tp.price IS NOT NULL),
sa AS (SELECT 'all' AS stratum, * FROM j UNION ALL SELECT 'strategy:' || split_part(strategy_key, '_', 1), * FROM j UNION ALL SELECT 'supply:' || coalesce(news_supply_level, 'unknown'), * FROM j UNION ALL SELECT CASE WHEN reason IS NULL THEN 'open' ELSE 'closed' END, * FROM j)
SELECT stratum, count(*) AS n, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(r), 6) AS mean_r, round(max(r), 6) AS best, round(min(r), 6) AS worst FROM sa GROUP BY stratum""")
def tracked_strata(spark, root):
    """The same figures over strata that overlap: a position counts in each that it belongs to. One row per stratum is emitted before the aggregate."""
    v = table(spark, root, "verdicts", ["run_id", "symbol", "strategy_key", "news_supply_level"]).distinct()
    j = _tracked(spark, root).where("price IS NOT NULL").join(v, ["run_id", "symbol"]).withColumn("r", F.col("price") / F.col("entry") - 1)
    kinds = F.array(
        F.lit("all"), F.concat(F.lit("strategy:"), F.substring_index("strategy_key", "_", 1)), F.concat(F.lit("supply:"), F.coalesce("news_supply_level", F.lit("unknown"))),
        F.when(F.col("reason").isNull(), "open").otherwise("closed"),
    )
    return j.select("r", F.explode(kinds).alias("stratum")).groupBy("stratum").agg(
        F.count("*").alias("n"), r6(F.avg((F.col("r") > 0).cast("double")), "win_rate"), r6(F.avg("r"), "mean_r"), r6(F.max("r"), "best"), r6(F.min("r"), "worst")
    )


@query("pending_slices", f"""WITH {OUT}, {RUN}, m AS (SELECT run_id, count(*) AS n, count(DISTINCT symbol) AS n_symbols FROM o GROUP BY run_id)
SELECT m.run_id, m.n FROM m LEFT JOIN run ON run.run_id = m.run_id AND run.status = 'success' WHERE run.run_id IS NULL""")
def pending_slices(spark, root):
    """Runs whose outcomes are complete and that no finished record holds yet: what is left to evaluate."""
    m = outcomes(spark, root).groupBy("run_id").agg(F.count("*").alias("n"))
    recorded = last_runs(spark, root).where("status = 'success'").select("run_id")
    return m.join(recorded, "run_id", "left_anti")


@query("horizon_catch_up", f"""WITH {BASE}, {VER}, ds AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM b)), hz AS (SELECT unnest([5, 20]) AS h),
t AS (SELECT DISTINCT as_of FROM ver), x AS (SELECT t.as_of, hz.h, n.date AS scored FROM t JOIN ds ON ds.date = t.as_of, hz LEFT JOIN ds n ON n.k = ds.k + hz.h)
SELECT strftime(as_of, '%Y-%m-%d') AS run_day, CAST(h AS INTEGER) AS horizon, strftime(scored, '%Y-%m-%d') AS scored_day FROM x""")
def horizon_catch_up(spark, root):
    """On which session each day's verdicts are scored, by horizon; null while it is to come. One row per day of the calendar is numbered."""
    ds = clean_bars(spark, root).select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date")))
    t = verdicts(spark, root).select(F.col("as_of").alias("date")).distinct().join(ds, "date").withColumn("h", F.explode(F.array(F.lit(5), F.lit(20))))
    n = ds.select(F.col("date").alias("scored"), F.col("k").alias("to"))
    return t.join(n, F.col("to") == F.col("k") + F.col("h"), "left").select(day("date").alias("run_day"), F.col("h").alias("horizon"), day("scored").alias("scored_day"))


# Composed statistics --------------------------------------------------------------------------------------------------------

_TWO = f"""{BASE}, {VER}, fw AS (SELECT symbol, date, round(100 * (lead(close, 5) {_ORD} / close - 1), 6) AS r5, round(100 * (lead(close, 20) {_ORD} / close - 1), 6) AS r20 FROM b),
o2 AS (SELECT ver.strategy_key, ver.recommendation, fw.r5, fw.r20 FROM (SELECT DISTINCT run_id, symbol, as_of, strategy_key, recommendation FROM ver) ver JOIN fw ON fw.symbol = ver.symbol AND fw.date = ver.as_of)"""


def _two_horizons(spark, root) -> DataFrame:
    v = verdicts(spark, root).select("run_id", "symbol", F.col("as_of").alias("date"), "strategy_key", "recommendation").distinct()
    bars = clean_bars(spark, root).join(v.select("symbol").distinct(), "symbol", "left_semi")
    f = bars.select("symbol", "date", *[r6(100 * S.forward_return("close", h), f"r{h}") for h in (5, 20)])
    return v.join(f, ["symbol", "date"])


@query("composed_means", f"""WITH {_TWO}, g AS (SELECT strategy_key, recommendation, avg(r5) AS m5, avg(r20) AS m20, count(r5) AS n5, count(r20) AS n20, avg(CASE WHEN r5 > 0 THEN 1.0 WHEN r5 <= 0 THEN 0.0 END) AS h5, avg(CASE WHEN r20 > 0 THEN 1.0 WHEN r20 <= 0 THEN 0.0 END) AS h20 FROM o2 GROUP BY ALL)
SELECT strategy_key, recommendation, n5, n20, round(m5, 5) AS mean_5, round(m20, 5) AS mean_20,
 round((coalesce(0.6 * m5, 0) + coalesce(0.4 * m20, 0)) / nullif((CASE WHEN m5 IS NULL THEN 0 ELSE 0.6 END) + (CASE WHEN m20 IS NULL THEN 0 ELSE 0.4 END), 0), 5) AS composed_mean,
 round((coalesce(0.6 * n5 * h5, 0) + coalesce(0.4 * n20 * h20, 0)) / nullif(0.6 * n5 + 0.4 * n20, 0), 5) AS composed_rate FROM g""")
def composed_means(spark, root):
    """Means of two horizons and their weighted mean, the weights scaled to the horizons that have a value; the rate by weighted counts."""
    pos = lambda c: F.avg(F.when(F.col(c) > 0, 1.0).when(F.col(c) <= 0, 0.0))
    g = _two_horizons(spark, root).groupBy("strategy_key", "recommendation").agg(
        F.avg("r5").alias("m5"), F.avg("r20").alias("m20"), F.count("r5").alias("n5"), F.count("r20").alias("n20"), pos("r5").alias("h5"), pos("r20").alias("h20"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    weight = F.when(F.col("m5").isNull(), 0.0).otherwise(0.6) + F.when(F.col("m20").isNull(), 0.0).otherwise(0.4)
    cases = 0.6 * F.col("n5") + 0.4 * F.col("n20")
    r5 = lambda c, n: F.round(c, 5).alias(n)
    return g.select("strategy_key", "recommendation", "n5", "n20", r5(F.col("m5"), "mean_5"), r5(F.col("m20"), "mean_20"),
                    r5(F.when(weight > 0, (zero(0.6 * F.col("m5")) + zero(0.4 * F.col("m20"))) / weight), "composed_mean"),
                    r5(F.when(cases > 0, (zero(0.6 * F.col("n5") * F.col("h5")) + zero(0.4 * F.col("n20") * F.col("h20"))) / cases), "composed_rate"))


@query("input_coverage", f"""WITH {OUT}, c AS (SELECT DISTINCT run_id, symbol, news_supply_collected_items AS got, news_supply_exported_items AS sent FROM verdicts),
j AS (SELECT o.recommendation, o.r, CASE WHEN c.got IS NULL OR c.sent IS NULL THEN 'unknown' WHEN c.got = 0 THEN 'none' WHEN c.sent < c.got THEN 'cut' ELSE 'whole' END AS coverage FROM o JOIN c ON c.run_id = o.run_id AND c.symbol = o.symbol)
SELECT coverage, count(*) AS n, count(*) FILTER (WHERE recommendation = 'proceed') AS n_proceed, count(*) FILTER (WHERE recommendation = 'proceed' AND r <= -2) AS n_severe, bool_or(r > 5) AS any_strong, bool_and(r > -20) AS none_crashed FROM j GROUP BY coverage""")
def input_coverage(spark, root):
    """Outcomes by how much of the collected input a verdict saw."""
    c = table(spark, root, "verdicts", ["run_id", "symbol", "news_supply_collected_items", "news_supply_exported_items"]).distinct()
    got, sent = F.col("news_supply_collected_items"), F.col("news_supply_exported_items")
    kind = F.when(got.isNull() | sent.isNull(), "unknown").when(got == 0, "none").when(sent < got, "cut").otherwise("whole")
    j = outcomes(spark, root).join(c, ["run_id", "symbol"]).withColumn("coverage", kind)
    p = F.col("recommendation") == "proceed"
    return j.groupBy("coverage").agg(F.count("*").alias("n"), F.count_if(p).alias("n_proceed"), F.count_if(p & (F.col("r") <= -2)).alias("n_severe"), F.bool_or(F.col("r") > 5).alias("any_strong"), F.bool_and(F.col("r") > -20).alias("none_crashed"))


@query("severe_flags", f"""WITH {OUT}, g AS (SELECT strategy_key, count(*) FILTER (WHERE recommendation = 'proceed') AS n, count(*) FILTER (WHERE recommendation = 'proceed' AND r <= -2) AS k, avg(CASE WHEN r <= -2 THEN 1.0 ELSE 0.0 END) AS base FROM o GROUP BY strategy_key)
SELECT strategy_key, n, k, round(k::DOUBLE / nullif(n, 0), 6) AS rate, round(base, 6) AS baseline, coalesce(n >= 5 AND k::DOUBLE / nullif(n, 0) > 1.1 * base, false) AS flagged FROM g""")
def severe_flags(spark, root):
    """Severe misses against the baseline of all outcomes, flagged where there are enough and they exceed it."""
    p = F.col("recommendation") == "proceed"
    g = outcomes(spark, root).groupBy("strategy_key").agg(F.count_if(p).alias("n"), F.count_if(p & (F.col("r") <= -2)).alias("k"), F.avg(F.when(F.col("r") <= -2, 1.0).otherwise(0.0)).alias("base"))
    rate = F.when(F.col("n") > 0, F.col("k") / F.col("n"))
    return g.select("strategy_key", "n", "k", r6(rate, "rate"), r6(F.col("base"), "baseline"), F.coalesce((F.col("n") >= 5) & (rate > 1.1 * F.col("base")), F.lit(False)).alias("flagged"))


@query("failure_history", f"""WITH {RUN}, d AS (SELECT DISTINCT run_date FROM run ORDER BY run_date DESC NULLS LAST LIMIT 10), j AS (SELECT run.run_date, run.status FROM run SEMI JOIN d ON d.run_date = run.run_date)
SELECT strftime(run_date, '%Y-%m-%d') AS run_day, count(*) AS n, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'degraded') AS degraded, count(*) FILTER (WHERE status = 'running') AS running FROM j GROUP BY run_date""")
def failure_history(spark, root):
    """Runs by state over the ten newest dates."""
    r = last_runs(spark, root)
    d = r.select("run_date").where("run_date IS NOT NULL").distinct().orderBy(F.desc("run_date")).limit(10)
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return r.join(d, "run_date", "left_semi").groupBy("run_date").agg(F.count("*").alias("n"), of("failed"), of("degraded"), of("running")).select(day("run_date").alias("run_day"), "n", "failed", "degraded", "running")


# Screens as rule ladders ----------------------------------------------------------------------------------------------------

_SEVEN = f"""{BASE}, t1 AS (SELECT symbol, date, close, CASE WHEN count(close) {_ROWS.format(49)} = 50 THEN round(avg(close) {_ROWS.format(49)}, 6) END AS m50, CASE WHEN count(close) {_ROWS.format(99)} = 100 THEN round(avg(close) {_ROWS.format(99)}, 6) END AS m100,
 CASE WHEN count(close) {_ROWS.format(149)} = 150 THEN round(avg(close) {_ROWS.format(149)}, 6) END AS m150, CASE WHEN count(close) {_ROWS.format(149)} >= 100 THEN min(close) {_ROWS.format(149)} END AS lo, CASE WHEN count(close) {_ROWS.format(149)} >= 100 THEN max(close) {_ROWS.format(149)} END AS hi FROM b),
t2 AS (SELECT *, lag(m150, 10) {_ORD} AS before FROM t1),
t3 AS (SELECT symbol, date, [close > m100 AND close > m150, m100 > m150, m150 > before, close > m50, close >= 1.25 * lo, close >= 0.75 * hi] AS c FROM t2)"""


@query("trend_template", f"""WITH {_SEVEN} SELECT symbol, strftime(date, '%Y-%m-%d') AS day, CAST(len(list_filter(c, lambda x: x)) AS INTEGER) AS met, CAST(len(list_filter(c, lambda x: x IS NULL)) AS INTEGER) AS no_data, round(len(list_filter(c, lambda x: x)) / 6.0, 6) AS strength,
 CASE WHEN len(list_filter(c, lambda x: x)) >= 5 THEN 'hit' WHEN len(list_filter(c, lambda x: x IS NULL)) > 0 THEN 'no_data' ELSE 'miss' END AS state FROM t3""")
def trend_template(spark, root):
    """A template of conditions on closes, means and extremes: how many hold, how many lack data, and what follows. A condition without data doesn't hold."""
    t = clean_bars(spark, root)
    t = t.select("symbol", "date", "close", *[r6(S.sma("close", n), f"m{n}") for n in (50, 100, 150)], S.rolling_extreme("close", 150, 100, "min").alias("lo"), S.rolling_extreme("close", 150, 100, "max").alias("hi"))
    t = t.withColumn("before", F.lag("m150", 10).over(S.by("symbol", "date")))
    c = F.array(*[F.expr(e) for e in ("close > m100 AND close > m150", "m100 > m150", "m150 > before", "close > m50", "close >= 1.25 * lo", "close >= 0.75 * hi")])
    t = t.select("symbol", day("date").alias("day"), c.alias("c")).withColumns({"met": F.size(F.filter("c", lambda x: x)), "no_data": F.size(F.filter("c", lambda x: x.isNull()))})
    state = F.when(F.col("met") >= 5, "hit").when(F.col("no_data") > 0, "no_data").otherwise("miss")
    return t.select("symbol", "day", "met", "no_data", r6(F.col("met") / 6, "strength"), state.alias("state"))


_IND = f"SELECT symbol, date, rsi14 FROM ({daily.SQL['wilder_rsi14']})", f"SELECT symbol, date, atr14 FROM ({daily.SQL['wilder_atr14']})"
_BAND = f"""{BASE}, rs AS ({_IND[0]}), tr AS ({_IND[1]}), ma AS (SELECT symbol, date, close, CASE WHEN count(close) {_ROWS.format(49)} = 50 THEN round(avg(close) {_ROWS.format(49)}, 6) END AS m50, avg(volume) {_ROWS.format(19)} AS v20 FROM b),
bd AS (SELECT ma.*, rs.rsi14, tr.atr14 FROM ma LEFT JOIN rs ON rs.symbol = ma.symbol AND rs.date = ma.date LEFT JOIN tr ON tr.symbol = ma.symbol AND tr.date = ma.date)"""


def _band(spark, root) -> DataFrame:
    bars = clean_bars(spark, root)
    i = recursive.smoothed_indicators(bars).select("symbol", "date", r6(F.col("rsi"), "rsi14"), r6(F.col("atr"), "atr14"))
    w = S.by("symbol", "date").rowsBetween(-19, 0)
    m = bars.select("symbol", "date", "close", r6(S.sma("close", 50), "m50"), F.avg("volume").over(w).alias("v20"))
    return m.join(i, ["symbol", "date"], "left")


@query("pullback_bands", f"""WITH {_BAND} SELECT symbol, strftime(date, '%Y-%m-%d') AS day,
 CASE WHEN rsi14 IS NULL OR m50 IS NULL THEN 'no_data' WHEN rsi14 < 45 AND abs(close - m50) / m50 <= 0.03 THEN 'hit' ELSE 'miss' END AS by_share,
 CASE WHEN rsi14 IS NULL OR m50 IS NULL OR atr14 IS NULL OR atr14 <= 0 THEN 'no_data' WHEN rsi14 < 45 AND abs(close - m50) / atr14 <= 1.5 THEN 'hit' ELSE 'miss' END AS by_range FROM bd""")
def pullback_bands(spark, root):
    """A low oscillator near a mean, the distance once as a part of the mean and once in true ranges."""
    far = F.abs(F.col("close") - F.col("m50"))
    low = F.col("rsi14") < 45
    a = F.when(F.expr("rsi14 IS NULL OR m50 IS NULL"), "no_data").when(low & (far / F.col("m50") <= 0.03), "hit").otherwise("miss")
    b = F.when(F.expr("rsi14 IS NULL OR m50 IS NULL OR atr14 IS NULL OR atr14 <= 0"), "no_data").when(low & (far / F.col("atr14") <= 1.5), "hit").otherwise("miss")
    return _band(spark, root).select("symbol", day("date").alias("day"), a.alias("by_share"), b.alias("by_range"))


@query("score_components", f"""WITH {_BAND}, x AS (SELECT *, count(v20) OVER (PARTITION BY date) AS n, (rank() OVER (PARTITION BY date ORDER BY v20) + (count(*) OVER (PARTITION BY date, v20) - 1) / 2.0 - 1) AS at_ FROM bd WHERE rsi14 IS NOT NULL AND atr14 IS NOT NULL AND m50 IS NOT NULL),
sk AS (SELECT symbol, date, greatest(0.0, least(1.0, (45 - rsi14) / 45)) AS c1, greatest(0.0, least(1.0, (close / m50 - 1) / 0.10)) AS c2, CASE WHEN n = 1 THEN 0.5 ELSE at_ / (n - 1) END AS c3, greatest(0.0, least(1.0, (atr14 / close) / 0.06)) AS c4 FROM x)
SELECT symbol, strftime(date, '%Y-%m-%d') AS day, round(c1, 6) AS reversal, round(c2, 6) AS trend, round(c3, 6) AS liquidity, round(c4, 6) AS range, round(0.3 * c1 + 0.3 * c2 + 0.2 * c3 + 0.2 * c4, 6) AS score FROM sk""")
def score_components(spark, root):
    """Components cut to [0, 1] and their weighted sum; rows that lack any indicator are left out."""
    t = _band(spark, root).where("rsi14 IS NOT NULL AND atr14 IS NOT NULL AND m50 IS NOT NULL")
    t = S.percentile_rank(t, "v20", ["date"], "c3")
    cut = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    t = t.withColumns({"c1": cut((45 - F.col("rsi14")) / 45), "c2": cut((F.col("close") / F.col("m50") - 1) / 0.10), "c4": cut((F.col("atr14") / F.col("close")) / 0.06)})
    score = 0.3 * F.col("c1") + 0.3 * F.col("c2") + 0.2 * F.col("c3") + 0.2 * F.col("c4")
    return t.select("symbol", day("date").alias("day"), r6(F.col("c1"), "reversal"), r6(F.col("c2"), "trend"), r6(F.col("c3"), "liquidity"), r6(F.col("c4"), "range"), r6(score, "score"))


@query("pivot_proximity", f"""WITH {BASE}, t AS (SELECT symbol, date, close, max(high) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS pv, count(high) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS n FROM b)
SELECT symbol, strftime(date, '%Y-%m-%d') AS day, CASE WHEN n < 20 THEN 0.0 ELSE round(greatest(0.0, least(1.0, 1 - abs(close - pv) / pv / 0.05)), 6) END AS proximity FROM t""")
def pivot_proximity(spark, root):
    """Nearness of the close to the highest of the twenty bars before, 0 without one."""
    w = S.by("symbol", "date").rowsBetween(-20, -1)
    t = clean_bars(spark, root).select("symbol", "date", "close", F.max("high").over(w).alias("pivot"), F.count("high").over(w).alias("n"))
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(F.col("close") - F.col("pivot")) / F.col("pivot") / 0.05))
    return t.select("symbol", day("date").alias("day"), F.when(F.col("n") < 20, 0.0).otherwise(F.round(near, 6)).alias("proximity"))


@query("ranked_tail", f"""WITH {BASE}, t AS (SELECT symbol, date, round(close / lag(close, 21) {_ORD} - 1, 6) AS r FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY r DESC, symbol) AS rank FROM t WHERE r IS NOT NULL)
SELECT strftime(date, '%Y-%m-%d') AS day, count(*) FILTER (WHERE rank > 10) AS n_cut, min(rank) FILTER (WHERE rank > 10) AS first_cut, max(rank) AS n_ranked, max(r) FILTER (WHERE rank > 10) AS best_cut FROM k GROUP BY date""")
def ranked_tail(spark, root):
    """What a cut after ten leaves out: the ranks go on beyond it."""
    t = clean_bars(spark, root).select("symbol", "date", r6(S.pct_change("close", 21), "r")).where("r IS NOT NULL")
    k = t.withColumn("rank", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("r"), "symbol")))
    tail = F.when(F.col("rank") > 10, F.col("rank"))
    return k.groupBy("date").agg(F.count(tail).alias("n_cut"), F.min(tail).alias("first_cut"), F.max("rank").alias("n_ranked"), F.max(F.when(F.col("rank") > 10, F.col("r"))).alias("best_cut")).select(day("date").alias("day"), "n_cut", "first_cut", "n_ranked", "best_cut")


_GRID = f"""{BASE}, gr AS (SELECT k, w FROM (SELECT unnest([2, 3, 4, 5, 6, 7, 8]) AS k), (SELECT unnest([1, 3, 5]) AS w)), mv AS (SELECT symbol, date, close / lag(close) {_ORD} - 1 AS r1, close / lag(close, 3) {_ORD} - 1 AS r3, close / lag(close, 5) {_ORD} - 1 AS r5, round(lead(close, 5) {_ORD} / close - 1, 6) AS f FROM b),
un AS (SELECT 1 AS w, r1 AS r, f FROM mv UNION ALL SELECT 3, r3, f FROM mv UNION ALL SELECT 5, r5, f FROM mv),
ce AS (SELECT gr.k, gr.w, count(*) FILTER (WHERE r <= -k / 100.0) AS n, round(count(*) FILTER (WHERE r <= -k / 100.0)::DOUBLE / count(*), 6) AS share, round(avg(f) FILTER (WHERE r <= -k / 100.0) - avg(f), 5) AS gap FROM gr JOIN un ON un.w = gr.w WHERE r IS NOT NULL AND f IS NOT NULL GROUP BY gr.k, gr.w)"""


def _grid(spark, root) -> DataFrame:
    """Cells of a grid of cutoffs and lengths. Rows are binned once; a cell adds up the bins beyond its cutoff, so the data isn't multiplied by the grid."""
    b = clean_bars(spark, root)
    mv = b.select("symbol", "date", *[S.pct_change("close", n).alias(f"r{n}") for n in (1, 3, 5)], r6(S.forward_return("close", 5), "f"))
    un = mv.selectExpr("f", "stack(3, 1, r1, 3, r3, 5, r5) AS (w, r)").where("r IS NOT NULL AND f IS NOT NULL")
    deepest = F.coalesce(*[F.when(F.col("r") <= -k / 100.0, F.lit(k)) for k in (8, 7, 6, 5, 4, 3, 2)], F.lit(0))
    bins = un.withColumn("bin", deepest).groupBy("w", "bin").agg(F.count("*").alias("n"), F.sum("f").alias("s"))
    totals = bins.groupBy("w").agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
    cells = bins.withColumn("k", F.explode(F.sequence(F.lit(2), F.lit(8)))).groupBy("w", "k").agg(
        F.coalesce(F.sum(F.when(F.col("bin") >= F.col("k"), F.col("n"))), F.lit(0)).alias("n"), F.sum(F.when(F.col("bin") >= F.col("k"), F.col("s"))).alias("s"))
    t = cells.join(totals, "w")
    return t.select("k", "w", "n", r6(F.col("n") / F.col("all_n"), "share"), F.round(F.col("s") / F.col("n") - F.col("all_s") / F.col("all_n"), 5).alias("gap"))


@query("grid_ranked", f"WITH {_GRID}, q AS (SELECT *, row_number() OVER (PARTITION BY share, gap ORDER BY k, w) AS same FROM ce WHERE n >= 10 AND share <= 0.35 AND gap IS NOT NULL) SELECT CAST(k AS INTEGER) AS k, CAST(w AS INTEGER) AS w, n, share, gap, row_number() OVER (ORDER BY gap DESC, k, w) AS place FROM q WHERE same = 1")
def grid_ranked(spark, root):
    """Cells of the grid that meet the constraints, best first; of cells with the same figures the first counts. The window runs over the grid's cells only."""
    c = _grid(spark, root).where("n >= 10 AND share <= 0.35 AND gap IS NOT NULL")
    c = c.withColumn("same", F.row_number().over(Window.partitionBy("share", "gap").orderBy("k", "w"))).where("same = 1")
    return c.withColumn("place", F.row_number().over(Window.orderBy(F.desc("gap"), "k", "w"))).select("k", "w", "n", "share", "gap", "place")


@query("grid_best_cell", f"""WITH {_GRID}, best AS (SELECT k, w, gap FROM ce WHERE n >= 10 AND gap IS NOT NULL ORDER BY gap DESC, k, w LIMIT 1)
SELECT CAST(best.k AS INTEGER) AS k, CAST(best.w AS INTEGER) AS w, best.gap, count(ce.gap) AS n_near, round(avg(ce.gap), 5) AS near_mean, CASE WHEN count(ce.gap) = 0 THEN 'alone' WHEN avg(ce.gap) >= 0.5 * best.gap THEN 'plateau' ELSE 'spike' END AS shape
FROM best LEFT JOIN ce ON ce.w = best.w AND abs(ce.k - best.k) = 1 AND ce.n >= 10 GROUP BY best.k, best.w, best.gap""")
def grid_best_cell(spark, root):
    """The best cell and whether its neighbours agree with it."""
    c = _grid(spark, root).where("n >= 10")
    best = c.where("gap IS NOT NULL").orderBy(F.desc("gap"), "k", "w").limit(1).select(F.col("k").alias("bk"), F.col("w").alias("bw"), F.col("gap").alias("bg"))
    j = best.join(c.select("k", "w", "gap"), (F.col("w") == F.col("bw")) & (F.abs(F.col("k") - F.col("bk")) == 1), "left")
    g = j.groupBy("bk", "bw", "bg").agg(F.count("gap").alias("n_near"), F.avg("gap").alias("m"))
    shape = F.when(F.col("n_near") == 0, "alone").when(F.col("m") >= 0.5 * F.col("bg"), "plateau").otherwise("spike")
    return g.select(F.col("bk").alias("k"), F.col("bw").alias("w"), F.col("bg").alias("gap"), "n_near", F.round("m", 5).alias("near_mean"), shape.alias("shape"))


FILTERS, SIGNALS = screens.Registry(), screens.Registry()
_v20 = {"v20": lambda: S.trailing_mean("volume", 20)}
_m50 = {"m50": lambda: F.round(S.sma("close", 50), 6)}
FILTERS.add(screens.Rule("liquid", _v20, lambda: F.col("__v20") >= 500_000, 20))
FILTERS.add(screens.Rule("above_mean", _m50, lambda: F.col("close") > F.col("__m50"), 50))
SIGNALS.add(screens.Rule("month_up", {"r21": lambda: F.round(S.pct_change("close", 21), 6)}, lambda: F.col("__r21") > 0.05, 22))
SIGNALS.add(screens.Rule("near_mean", _m50, lambda: F.abs(F.col("close") - F.col("__m50")) / F.col("__m50") <= 0.02, 50))
TREND = screens.compose("trend", ["liquid", "above_mean"], ["month_up", "near_mean"], FILTERS, SIGNALS)


@query("strategy_hits", f"""WITH {BASE}, t AS (SELECT symbol, date, close, CASE WHEN count(*) {_ROWS.format(19)} = 20 THEN avg(volume) {_ROWS.format(19)} END AS v20, CASE WHEN count(close) {_ROWS.format(49)} = 50 THEN round(avg(close) {_ROWS.format(49)}, 6) END AS m50, round(close / lag(close, 21) {_ORD} - 1, 6) AS r21 FROM b),
k AS (SELECT symbol, date, v20 >= 500000 AS f1, close > m50 AS f2, r21 > 0.05 AS s1, abs(close - m50) / m50 <= 0.02 AS s2 FROM t),
h AS (SELECT *, CASE WHEN f1 IS NOT TRUE THEN 'liquid' WHEN f2 IS NOT TRUE THEN 'above_mean' END AS rejected_by FROM k)
SELECT symbol, strftime(date, '%Y-%m-%d') AS day, CASE WHEN rejected_by IS NULL AND (s1 IS TRUE OR s2 IS TRUE) THEN 'hit' WHEN f1 IS NULL OR f2 IS NULL OR s1 IS NULL OR s2 IS NULL THEN 'no_data' WHEN rejected_by IS NOT NULL THEN 'filtered' ELSE 'miss' END AS state, rejected_by,
 CASE WHEN rejected_by IS NULL THEN concat_ws(',', CASE WHEN s1 THEN 'month_up' END, CASE WHEN s2 THEN 'near_mean' END) ELSE '' END AS signals FROM h""")
def strategy_hits(spark, root):
    """A strategy composed of registered filters and signals, over every bar."""
    t = screens.screen(clean_bars(spark, root), TREND)
    return t.select("symbol", day("date").alias("day"), "state", "rejected_by", F.array_join("signals", ",").alias("signals"))


QUERIES = Q

"""Queries that combine several sources: levels and outcomes, alignment to the calendar, proximity, streaks, adjustment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exact, stats
from ..operators import asof, quantiles
from ..operators import series as S
from ..sources.tables import table
from .daily import _ORD, _ROWS, BASE, clean_bars, r6
from .ledger import FIL, OUT, VER, filings, outcomes, verdicts

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_LEVEL = f"""{BASE}, l AS (SELECT symbol, date, CASE WHEN count(close) {_ROWS.format(49)} < 50 THEN 'unknown' WHEN close >= round(avg(close) {_ROWS.format(49)}, 6) THEN 'above' ELSE 'below' END AS level,
 round(lead(close, 5) {_ORD} / close - 1, 6) AS r5, round(lead(close, 20) {_ORD} / close - 1, 6) AS r20, CASE WHEN volume > lag(volume) {_ORD} THEN 'rising' ELSE 'falling' END AS flow FROM b),
e AS (SELECT *, sum(CASE WHEN level IS NOT DISTINCT FROM before THEN 0 ELSE 1 END) {_ORD} AS episode FROM (SELECT *, lag(level) {_ORD} AS before FROM l))"""


def _levels(spark, root) -> DataFrame:
    m = F.round(S.sma("close", 50), 6)
    w = S.by("symbol", "date")
    t = clean_bars(spark, root).withColumn("m", m).select(
        "symbol", "date",
        F.when(F.col("m").isNull(), "unknown").when(F.col("close") >= F.col("m"), "above").otherwise("below").alias("level"),
        r6(S.forward_return("close", 5), "r5"), r6(S.forward_return("close", 20), "r20"),
        F.when(F.col("volume") > F.lag("volume").over(w), "rising").otherwise("falling").alias("flow"),
    )
    return S.episodes(t, "level", "episode")


@query("level_statistics", f"WITH {_LEVEL} SELECT level, count(r5) AS n, count(DISTINCT symbol || '/' || CAST(CAST(episode AS BIGINT) AS VARCHAR)) AS n_episodes, round(avg(r5), 6) AS mean_r5, round(median(r5), 7) AS median_r5, round(avg(CASE WHEN r5 > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive, min(r5) AS worst FROM e WHERE r5 IS NOT NULL GROUP BY level")
def level_statistics(spark, root):
    """Outcomes per level, with the number of separate episodes behind them."""
    t = _levels(spark, root).where("r5 IS NOT NULL")
    # An episode is counted at its first row, so the count needs no second distinct.
    a = t.groupBy("level", "symbol", "episode").agg(
        F.count("*").alias("n"), F.sum("r5").alias("total"), F.count_if(F.col("r5") > 0).alias("up"), F.min("r5").alias("worst")
    ).groupBy("level").agg(
        F.sum("n").alias("n"), F.count("*").alias("n_episodes"), r6(F.sum("total") / F.sum("n"), "mean_r5"), r6(F.sum("up") / F.sum("n"), "positive"), F.min("worst").alias("worst")
    )
    q = quantiles.exact_quantiles(t, ["level"], "r5", [0.5]).select("level", F.round(F.col("quantiles")[0], 7).alias("median_r5"))
    return a.join(q, "level").select("level", "n", "n_episodes", "mean_r5", "median_r5", "positive", "worst")


@query("level_flow_pivot", f"WITH {_LEVEL} SELECT level, count(r20) FILTER (WHERE flow = 'rising') AS rising_n, round(avg(r20) FILTER (WHERE flow = 'rising'), 6) AS rising_mean, count(r20) FILTER (WHERE flow = 'falling') AS falling_n, round(avg(r20) FILTER (WHERE flow = 'falling'), 6) AS falling_mean FROM e GROUP BY level")
def level_flow_pivot(spark, root):
    """Mean outcome and count as a matrix of two classes."""
    t = _levels(spark, root)
    return t.groupBy("level").pivot("flow", ["rising", "falling"]).agg(F.count("r20").alias("n"), F.round(F.avg("r20"), 6).alias("mean"))


@query("day_weighted_gap", f"WITH {_LEVEL}, d AS (SELECT level, date, count(*) AS n, avg(r5) AS r FROM e WHERE r5 IS NOT NULL AND level <> 'unknown' GROUP BY ALL) SELECT round(sum(n * r) FILTER (WHERE level = 'above') / sum(n) FILTER (WHERE level = 'above') - sum(n * r) FILTER (WHERE level = 'below') / sum(n) FILTER (WHERE level = 'below'), 6) AS gap, count(DISTINCT date) AS n_days FROM d")
def day_weighted_gap(spark, root):
    """Difference of two classes' daily means, weighted by their days' rows."""
    d = _levels(spark, root).where("r5 IS NOT NULL AND level <> 'unknown'").groupBy("level", "date").agg(F.count("*").alias("n"), F.avg("r5").alias("r"))
    side = lambda c: F.sum(F.when(F.col("level") == c, F.col("n") * F.col("r"))) / F.sum(F.when(F.col("level") == c, F.col("n")))
    return d.agg(r6(side("above") - side("below"), "gap"), F.count_distinct("date").alias("n_days"))


@query("missing_sessions", f"""WITH {BASE}, c AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM b)), j AS (SELECT b.symbol, b.date, c.k FROM b JOIN c ON c.date = b.date)
SELECT symbol, count(*) AS n_bars, max(k) - min(k) + 1 AS n_sessions, max(k) - min(k) + 1 - count(*) AS n_missing FROM j GROUP BY symbol""")
def missing_sessions(spark, root):
    """Bars of each symbol against the sessions of its span. The calendar is one row per day."""
    b = clean_bars(spark, root).select("symbol", "date")
    c = b.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date")))
    span = (F.max("k") - F.min("k") + 1).cast("long")
    return b.join(c, "date").groupBy("symbol").agg(F.count("*").alias("n_bars"), span.alias("n_sessions"), (span - F.count("*")).alias("n_missing"))


@query("calendar_aligned", f"""WITH {BASE}, c AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM b)), j AS (SELECT b.symbol, b.close, c.k, lead(c.k) OVER (PARTITION BY b.symbol ORDER BY c.k) AS nxt FROM b JOIN c ON c.date = b.date),
x AS (SELECT symbol, close, k, CAST(unnest(generate_series(k, coalesce(nxt, k + 1) - 1)) AS BIGINT) AS at FROM j)
SELECT x.symbol, strftime(c.date, '%Y-%m-%d') AS day, x.close AS last_close, x.at - x.k AS age FROM x JOIN c ON c.k = x.at""")
def calendar_aligned(spark, root):
    """Every symbol on every session of its span, with the last close there is. A row lays out the sessions up to the next row, so
    symbols and days are never crossed."""
    b = clean_bars(spark, root).select("symbol", "date", "close")
    c = b.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date")).cast("long"))
    j = b.join(c, "date")
    last = F.coalesce(F.lead("k").over(Window.partitionBy("symbol").orderBy("k")), F.col("k") + 1) - 1
    x = j.withColumn("last", last).select("symbol", "close", "k", F.explode(F.sequence("k", "last")).alias("at"))
    day = c.select(F.col("k").alias("at"), F.date_format("date", "yyyy-MM-dd").alias("day"))
    return x.join(day, "at").select("symbol", "day", F.col("close").alias("last_close"), (F.col("at") - F.col("k")).alias("age"))


@query("latest_change", f"WITH {BASE}, t AS (SELECT symbol, date, close, lag(close) {_ORD} AS before, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM b) SELECT symbol, strftime(date, '%Y-%m-%d') AS day, close, round(close / before - 1, 6) AS change FROM t WHERE k = 1")
def latest_change(spark, root):
    """Last close and its change, by keeping the two newest bars of each symbol."""
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    two = clean_bars(spark, root).select("symbol", "date", "close").withColumn("k", F.row_number().over(w)).where("k <= 2")
    g = two.groupBy("symbol").agg(F.max(F.struct("date", "close")).alias("a"), F.max(F.when(F.col("k") == 2, F.col("close"))).alias("before"))
    return g.select("symbol", F.date_format("a.date", "yyyy-MM-dd").alias("day"), "a.close", r6(F.try_divide("a.close", "before") - 1, "change"))


@query("filing_proximity", f"""WITH {VER}, {FIL}, v AS (SELECT DISTINCT run_id, symbol, as_of FROM ver), f AS (SELECT DISTINCT symbol, CAST(filed_at AS DATE) AS day FROM fil),
j AS (SELECT v.run_id, v.symbol, v.as_of, max(f.day) AS last_filed FROM v LEFT JOIN f ON f.symbol = v.symbol AND f.day <= v.as_of GROUP BY ALL),
n AS (SELECT *, CASE WHEN last_filed IS NULL THEN NULL WHEN as_of <= last_filed THEN 0 ELSE len(list_filter(generate_series(last_filed + 1, as_of, INTERVAL 1 DAY), lambda d: isodow(d) <= 5)) END AS days FROM j)
SELECT run_id, symbol, CAST(coalesce(days, -1) AS INTEGER) AS business_days, CASE WHEN days IS NULL THEN 'none' WHEN days <= 3 THEN 'recent' WHEN days <= 20 THEN 'near' ELSE 'clear' END AS class FROM n""")
def filing_proximity(spark, root):
    """Weekdays since the last filing that was known on a verdict's day, -1 for none."""
    v = verdicts(spark, root).select("run_id", "symbol", "as_of").distinct()
    f = filings(spark, root).select("symbol", F.to_date("filed_at").alias("day")).distinct().withColumn("last_filed", F.col("day"))
    t = asof.known_as_of(v, f, ["symbol"], "as_of", "day", ["day"], ["last_filed"])
    t = t.withColumn("n", stats.business_days(F.col("last_filed"), F.col("as_of")))
    n = F.col("n")
    return t.select("run_id", "symbol", F.coalesce(n, F.lit(-1)).alias("business_days"), F.when(n.isNull(), "none").when(n <= 3, "recent").when(n <= 20, "near").otherwise("clear").alias("class"))


@query("loss_streaks", f"""WITH {OUT}, d AS (SELECT DISTINCT strategy_key, as_of, symbol, run_id, r FROM o), t AS (SELECT *, CASE WHEN r < 0 THEN 1 ELSE 0 END AS lost, sum(CASE WHEN r < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY strategy_key ORDER BY as_of, symbol, run_id) AS island FROM d),
st AS (SELECT strategy_key, island, sum(lost) AS n, round(sum(r) FILTER (WHERE lost = 1), 5) AS total FROM t GROUP BY ALL)
SELECT strategy_key, CAST(max(n) AS BIGINT) AS longest, min(total) AS worst FROM st GROUP BY strategy_key""")
def loss_streaks(spark, root):
    """Longest run of losses per strategy and the worst total of one."""
    d = outcomes(spark, root).select("strategy_key", "as_of", "symbol", "run_id", "r").distinct()
    # Within a day first: runs inside it, the losses before its first win and after its last one. Then over the days, of which there are as many
    # as the calendar has, whatever the number of outcomes.
    day = Window.partitionBy("strategy_key", "as_of").orderBy("symbol", "run_id").rowsBetween(Window.unboundedPreceding, 0)
    lost = (F.col("r") < 0).cast("long")
    t = d.withColumn("lost", lost).withColumn("island", F.sum(1 - lost).over(day))
    s = t.groupBy("strategy_key", "as_of", "island").agg(F.sum("lost").alias("n"), F.coalesce(F.sum(F.when(F.col("lost") == 1, F.col("r"))), F.lit(0.0)).alias("total"))
    ends = s.withColumn("last", F.max("island").over(Window.partitionBy("strategy_key", "as_of")))
    days = Window.partitionBy("strategy_key").orderBy("as_of", "island").rowsBetween(Window.unboundedPreceding, 0)
    # Only a day's first and last runs may go on beyond it; a first run (island 0) joins the one before.
    edge = ends.where("island = 0 OR island = last").withColumn("run", F.sum((F.col("island") > 0).cast("long")).over(days))
    joined = edge.groupBy("strategy_key", "run").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    inside = ends.where("island > 0 AND island < last").groupBy("strategy_key").agg(F.max("n").alias("n"), F.min("total").alias("total"))
    every = joined.select("strategy_key", "n", "total").unionByName(inside).withColumn("total", F.when(F.col("n") > 0, F.round("total", 5)))
    return every.groupBy("strategy_key").agg(F.max("n").alias("longest"), F.min("total").alias("worst"))


@query("split_adjusted", f"""WITH {BASE}, t AS (SELECT symbol, date, close, open / lag(close) {_ORD} AS jump FROM b), f AS (SELECT *, CASE WHEN jump < 0.6 OR jump > 1.6 THEN ln(jump) ELSE 0.0 END AS l FROM t)
SELECT symbol, strftime(date, '%Y-%m-%d') AS day, close, round(close * exp(sum(l) OVER (PARTITION BY symbol ORDER BY date DESC) - l), 4) AS adjusted FROM f""")
def split_adjusted(spark, root):
    """Closes rebased past overnight jumps that no ordinary move explains, to the scale of the last bar."""
    t = clean_bars(spark, root).withColumn("jump", F.col("open") / F.lag("close").over(S.by("symbol", "date")))
    t = t.withColumn("l", F.when((F.col("jump") < 0.6) | (F.col("jump") > 1.6), F.log("jump")).otherwise(0.0))
    down = Window.partitionBy("symbol").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
    return t.select("symbol", F.date_format("date", "yyyy-MM-dd").alias("day"), "close", F.round(F.col("close") * F.exp(F.sum("l").over(down) - F.col("l")), 4).alias("adjusted"))


@query("position_sizes", f"WITH {BASE} SELECT symbol, strftime(date, '%Y-%m-%d') AS day, CAST(greatest(0, least(floor(100000.0::DOUBLE * 0.01::DOUBLE / (close - close * 0.92::DOUBLE)), floor(100000.0::DOUBLE * 0.2::DOUBLE / close))) AS BIGINT) AS shares FROM b")
def position_sizes(spark, root):
    """Shares that a risk budget and a cap allow, floored exactly."""
    t = clean_bars(spark, root).withColumn("stop", F.col("close") * 0.92)
    size = exact.shares(F.lit(100_000.0), F.col("close"), F.col("stop"), F.lit(0.01), F.lit(0.2))
    return t.select("symbol", F.date_format("date", "yyyy-MM-dd").alias("day"), size.alias("shares"))


@query("canonical_digests")
def canonical_digests(spark, root):
    """Configurations by the digest of their canonical form: key order, blanks and wrapping do not count."""
    c = table(spark, root, "config_versions", ["config_hash", "sections_json"])
    return c.select("config_hash", exact.canonical_digest("sections_json").alias("digest"))


QUERIES = Q

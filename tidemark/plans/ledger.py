"""Queries over filings, universe, signals, runs and verdicts: as-of reads, joins, set operations, statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.text import blank_to_null, spelling_key
from ..operators import asof, dedupe, quantiles, sampling
from ..operators import series as S
from ..sources.tables import table
from .daily import BASE, clean_bars, r6

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_SPELL = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"
#: Surviving filings, one verdict per key, runs in their last state, one membership row per key.
FIL = "fil AS (SELECT accession_no, symbol, form, fiscal_period_end, filed_at, revenue, net_income, equity, assets, shares FROM fundamentals QUALIFY row_number() OVER (PARTITION BY accession_no ORDER BY fetched_at DESC, revenue DESC NULLS LAST, net_income DESC NULLS LAST, fcf DESC NULLS LAST, equity DESC NULLS LAST, assets DESC NULLS LAST) = 1)"
VER = "ver AS (SELECT DISTINCT run_id, symbol, as_of, strategy_key, recommendation, no_trade, news_supply_level, reasons_json FROM verdicts)"
RUN = "run AS (SELECT run_id, run_date, mode, config_hash, status, started_at, completed_at FROM runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY completed_at DESC NULLS LAST, status DESC NULLS LAST, started_at DESC NULLS LAST) = 1)"
MEM = f"mem AS (SELECT snapshot_date, symbol, max({_SPELL.format('gics_sector')}) AS sector FROM universe_membership GROUP BY snapshot_date, symbol)"
SIG = "sig AS (SELECT run_date, strategy_key, symbol, signal_name, max(strength) AS strength FROM signals WHERE isfinite(strength) GROUP BY ALL)"
#: Verdicts with the return over the five bars after their day.
OUT = f"""{BASE}, {VER}, fw AS (SELECT symbol, date, round(100 * (lead(close, 5) OVER (PARTITION BY symbol ORDER BY date) / close - 1), 6) AS r FROM b),
o AS (SELECT ver.run_id, ver.symbol, ver.as_of, ver.strategy_key, ver.recommendation, fw.r FROM ver JOIN fw ON fw.symbol = ver.symbol AND fw.date = ver.as_of WHERE fw.r IS NOT NULL)"""


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def filings(spark, root) -> DataFrame:
    f = table(spark, root, "fundamentals", ["accession_no", "symbol", "form", "fiscal_period_end", "filed_at", "revenue", "net_income", "fcf", "equity", "assets", "shares", "fetched_at"])
    return dedupe.keep_last(f, ["accession_no"], ["fetched_at", "revenue", "net_income", "fcf", "equity", "assets"])


def verdicts(spark, root) -> DataFrame:
    return table(spark, root, "verdicts", ["run_id", "symbol", "as_of", "strategy_key", "recommendation", "no_trade", "news_supply_level", "reasons_json"]).distinct()


def last_runs(spark, root) -> DataFrame:
    r = table(spark, root, "runs", ["run_id", "run_date", "mode", "config_hash", "status", "started_at", "completed_at"])
    return dedupe.keep_last(r, ["run_id"], ["completed_at", "status", "started_at"])


def members(spark, root) -> DataFrame:
    m = table(spark, root, "universe_membership", ["snapshot_date", "symbol", "gics_sector"])
    return m.groupBy("snapshot_date", "symbol").agg(F.max(spelling_key(F.col("gics_sector"))).alias("sector"))


def best_signals(spark, root) -> DataFrame:
    s = table(spark, root, "signals", ["run_date", "strategy_key", "symbol", "signal_name", "strength"])
    ok = F.col("strength").isNotNull() & ~F.isnan("strength") & (F.abs("strength") != float("inf"))
    return s.where(ok).groupBy("run_date", "strategy_key", "symbol", "signal_name").agg(F.max("strength").alias("strength"))


def outcomes(spark, root) -> DataFrame:
    v = verdicts(spark, root).select("run_id", "symbol", "as_of", "strategy_key", "recommendation")
    # Only the symbols that have verdicts go through the window.
    bars = clean_bars(spark, root).join(v.select("symbol").distinct(), "symbol", "left_semi")
    f = bars.select("symbol", F.col("date").alias("as_of"), F.round(100 * S.forward_return("close", 5), 6).alias("r"))
    return v.join(f.where("r IS NOT NULL"), ["symbol", "as_of"])


@query("fundamentals_asof", f"WITH {FIL} SELECT accession_no, symbol, form, fiscal_period_end FROM fil WHERE CAST(filed_at AS DATE) <= DATE '2024-12-31'")
def fundamentals_asof(spark, root):
    """Filings known by a day: by filing time, whatever period they report on."""
    return filings(spark, root).where(F.to_date("filed_at") <= F.lit("2024-12-31").cast("date")).select("accession_no", "symbol", "form", "fiscal_period_end")


@query("fundamentals_latest", f"WITH {FIL} SELECT symbol, accession_no, fiscal_period_end FROM fil WHERE CAST(filed_at AS DATE) <= DATE '2024-12-31' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY filed_at DESC, fiscal_period_end DESC, accession_no DESC) = 1")
def fundamentals_latest(spark, root):
    f = filings(spark, root).where(F.to_date("filed_at") <= F.lit("2024-12-31").cast("date"))
    best = f.groupBy("symbol").agg(F.max(F.struct("filed_at", "fiscal_period_end", "accession_no")).alias("m"))
    return best.select("symbol", "m.accession_no", "m.fiscal_period_end")


@query("filing_latest", "SELECT symbol, max(CAST(filed_at AS DATE)) AS last_filed FROM fundamentals WHERE form IN ('10-Q', '10-K') GROUP BY symbol")
def filing_latest(spark, root):
    f = table(spark, root, "fundamentals", ["symbol", "form", "filed_at"]).where(F.col("form").isin("10-Q", "10-K"))
    return f.groupBy("symbol").agg(F.max(F.to_date("filed_at")).alias("last_filed"))


@query("filing_first_per_period", "SELECT symbol, fiscal_period_end, min(CAST(filed_at AS DATE)) AS first_filed FROM fundamentals GROUP BY symbol, fiscal_period_end")
def filing_first_per_period(spark, root):
    """First filing of each period; amendments fall together with it."""
    f = table(spark, root, "fundamentals", ["symbol", "fiscal_period_end", "filed_at"])
    return f.groupBy("symbol", "fiscal_period_end").agg(F.min(F.to_date("filed_at")).alias("first_filed"))


@query("reporting_gap_projection", """WITH p AS (SELECT symbol, fiscal_period_end, min(CAST(filed_at AS DATE)) AS d FROM fundamentals GROUP BY ALL), u AS (SELECT DISTINCT symbol, d FROM p),
g AS (SELECT symbol, d, d - lag(d) OVER (PARTITION BY symbol ORDER BY d) AS gap FROM u),
m AS (SELECT symbol, max(d) AS last_filed, median(gap) FILTER (WHERE gap BETWEEN 45 AND 200) AS med, count(*) AS n FROM g GROUP BY symbol)
SELECT symbol, last_filed, n, round(med, 2) AS median_gap, last_filed + CAST(floor(med + 0.5) AS INTEGER) AS next_expected FROM m""")
def reporting_gap_projection(spark, root):
    """Next expected filing: the last one plus the median of the usual gaps."""
    u = filing_first_per_period(spark, root).select("symbol", F.col("first_filed").alias("d")).distinct()
    gap = F.datediff("d", F.lag("d").over(Window.partitionBy("symbol").orderBy("d")))
    m = u.withColumn("gap", gap).groupBy("symbol").agg(
        F.max("d").alias("last_filed"), F.median(F.when(F.col("gap").between(45, 200), F.col("gap"))).alias("med"), F.count("*").alias("n")
    )
    return m.select("symbol", "last_filed", "n", F.round("med", 2).alias("median_gap"), F.date_add("last_filed", F.floor(F.col("med") + 0.5).cast("int")).alias("next_expected"))


@query("quality_filter", f"""WITH {FIL}, k AS (SELECT * FROM fil WHERE CAST(filed_at AS DATE) <= DATE '2025-03-31' QUALIFY row_number() OVER (PARTITION BY symbol, fiscal_period_end ORDER BY filed_at DESC, accession_no DESC) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY fiscal_period_end DESC) AS k FROM k)
SELECT symbol, count(*) AS n_periods, count(*) FILTER (WHERE net_income > 0) AS n_positive, round(max(equity / nullif(assets, 0)) FILTER (WHERE k = 1), 6) AS equity_ratio FROM n WHERE k <= 4 GROUP BY symbol""")
def quality_filter(spark, root):
    """Latest filing of each period known by a day, then the newest four periods of each symbol."""
    f = filings(spark, root).where(F.to_date("filed_at") <= F.lit("2025-03-31").cast("date"))
    k = f.groupBy("symbol", "fiscal_period_end").agg(F.max(F.struct("filed_at", "accession_no", "net_income", "equity", "assets")).alias("m"))
    n = k.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("fiscal_period_end")))).where("k <= 4")
    ratio = F.try_divide("m.equity", F.when(F.col("m.assets") != 0, F.col("m.assets")))
    return n.groupBy("symbol").agg(F.count("*").alias("n_periods"), F.count_if(F.col("m.net_income") > 0).alias("n_positive"), r6(F.max(F.when(F.col("k") == 1, ratio)), "equity_ratio"))


@query("membership_latest_asof", f"WITH {MEM} SELECT snapshot_date, symbol, sector FROM mem WHERE snapshot_date = (SELECT max(snapshot_date) FROM universe_membership WHERE snapshot_date <= DATE '2024-10-15')")
def membership_latest_asof(spark, root):
    """The whole snapshot that was the latest on a day."""
    m = members(spark, root)
    last = table(spark, root, "universe_membership", ["snapshot_date"]).where(F.col("snapshot_date") <= F.lit("2024-10-15").cast("date")).agg(F.max("snapshot_date").alias("snapshot_date"))
    return m.join(F.broadcast(last), "snapshot_date").select("snapshot_date", "symbol", "sector")


@query("symbol_sector_asof", f"WITH {VER}, {MEM} SELECT ver.run_id, ver.symbol, mem.snapshot_date, mem.sector FROM (SELECT DISTINCT run_id, symbol, as_of FROM ver) ver ASOF LEFT JOIN mem ON mem.symbol = ver.symbol AND mem.snapshot_date <= ver.as_of")
def symbol_sector_asof(spark, root):
    v = verdicts(spark, root).select("run_id", "symbol", "as_of").distinct()
    t = asof.known_as_of(v, members(spark, root), ["symbol"], "as_of", "snapshot_date", ["snapshot_date"], ["snapshot_date", "sector"])
    return t.select("run_id", "symbol", "snapshot_date", "sector")


@query("verdict_scorecard", f"""WITH {OUT}, {RUN}, {MEM}, {SIG}, ss AS (SELECT run_date, symbol, count(*) AS n_signals, max(strength) AS top_strength FROM sig GROUP BY ALL),
v AS (SELECT DISTINCT run_id, symbol, as_of, strategy_key, recommendation FROM ver)
SELECT v.run_id, v.symbol, v.as_of, v.strategy_key, v.recommendation, run.mode, run.status, o.r, coalesce(ss.n_signals, 0) AS n_signals, ss.top_strength FROM v
JOIN run USING (run_id) LEFT JOIN (SELECT DISTINCT run_id, symbol, r FROM o) o ON o.run_id = v.run_id AND o.symbol = v.symbol LEFT JOIN ss ON ss.run_date = v.as_of AND ss.symbol = v.symbol""")
def verdict_scorecard(spark, root):
    """Verdicts with their run, outcome and signals. Many-sided tables are aggregated to the join key first, so no join fans out."""
    v = verdicts(spark, root).select("run_id", "symbol", "as_of", "strategy_key", "recommendation").distinct()
    s = best_signals(spark, root).groupBy("run_date", "symbol").agg(F.count("*").alias("n_signals"), F.max("strength").alias("top_strength"))
    o = outcomes(spark, root).select("run_id", "symbol", "r").distinct()
    t = v.join(last_runs(spark, root).select("run_id", "mode", "status"), "run_id").join(o, ["run_id", "symbol"], "left")
    t = t.join(s.withColumnRenamed("run_date", "as_of"), ["as_of", "symbol"], "left")
    return t.select("run_id", "symbol", "as_of", "strategy_key", "recommendation", "mode", "status", "r", F.coalesce("n_signals", F.lit(0)).alias("n_signals"), "top_strength")


@query("runs_without_verdicts", f"WITH {RUN} SELECT run_id, run_date, status FROM run WHERE NOT EXISTS (SELECT 1 FROM verdicts v WHERE v.run_id = run.run_id)")
def runs_without_verdicts(spark, root):
    return last_runs(spark, root).join(table(spark, root, "verdicts", ["run_id"]).distinct(), "run_id", "left_anti").select("run_id", "run_date", "status")


@query("orphan_config_runs", f"WITH {RUN} SELECT run.run_id, run.config_hash FROM run LEFT JOIN config_versions c ON c.config_hash = run.config_hash WHERE c.config_hash IS NULL")
def orphan_config_runs(spark, root):
    c = table(spark, root, "config_versions", ["config_hash"])
    return last_runs(spark, root).join(c, "config_hash", "left_anti").select("run_id", "config_hash")


@query("symbols_with_recent_filing", "SELECT DISTINCT symbol FROM verdicts WHERE symbol IN (SELECT DISTINCT symbol FROM fundamentals WHERE CAST(filed_at AS DATE) BETWEEN DATE '2024-10-01' AND DATE '2024-12-31')")
def symbols_with_recent_filing(spark, root):
    f = table(spark, root, "fundamentals", ["symbol", "filed_at"])
    window = F.to_date("filed_at").between(F.lit("2024-10-01").cast("date"), F.lit("2024-12-31").cast("date"))
    return table(spark, root, "verdicts", ["symbol"]).distinct().join(f.where(window).select("symbol").distinct(), "symbol", "left_semi")


@query("newest_sessions_semi", "SELECT run_date, strategy_key, count(*) AS n FROM signals WHERE run_date IN (SELECT DISTINCT run_date FROM signals ORDER BY run_date DESC LIMIT 5) GROUP BY ALL")
def newest_sessions_semi(spark, root):
    """Rows of the newest five sessions; the list of sessions is five rows whatever the table."""
    s = table(spark, root, "signals", ["run_date", "strategy_key"])
    five = s.select("run_date").distinct().orderBy(F.desc("run_date")).limit(5)
    return s.join(F.broadcast(five), "run_date", "left_semi").groupBy("run_date", "strategy_key").agg(F.count("*").alias("n"))


@query("drifted_deliveries", f"WITH {FIL} SELECT d.accession_no, count(*) AS n_differing FROM fundamentals d JOIN fil ON fil.accession_no = d.accession_no AND d.revenue <> fil.revenue GROUP BY d.accession_no")
def drifted_deliveries(spark, root):
    """Deliveries that differ from the surviving one: an equality and an inequality in one join."""
    d = table(spark, root, "fundamentals", ["accession_no", "revenue"])
    f = filings(spark, root).select("accession_no", F.col("revenue").alias("kept"))
    return d.join(f, "accession_no").where("revenue <> kept").groupBy("accession_no").agg(F.count("*").alias("n_differing"))


@query("prior_verdicts_topn", f"""WITH {VER}, v AS (SELECT DISTINCT run_id, symbol, strategy_key, as_of, recommendation FROM ver), d AS (SELECT symbol, strategy_key, as_of, min(run_id) AS run_id, count(*) AS n FROM v GROUP BY ALL),
p AS (SELECT symbol, strategy_key, as_of, lag(as_of, 1) OVER w AS prior_1, lag(as_of, 2) OVER w AS prior_2, lag(as_of, 3) OVER w AS prior_3 FROM d WINDOW w AS (PARTITION BY symbol, strategy_key ORDER BY as_of))
SELECT * FROM p""")
def prior_verdicts_topn(spark, root):
    """The three earlier verdict days of the same symbol and strategy."""
    d = verdicts(spark, root).select("symbol", "strategy_key", "as_of").distinct()
    w = Window.partitionBy("symbol", "strategy_key").orderBy("as_of")
    return d.select("symbol", "strategy_key", "as_of", *[F.lag("as_of", k).over(w).alias(f"prior_{k}") for k in (1, 2, 3)])


@query("run_configs", f"WITH {RUN} SELECT run.run_id, run.run_date, run.config_hash, c.first_seen_run_date, c.snapshot_hash IS NOT NULL AS known FROM run LEFT JOIN config_versions c ON c.config_hash = run.config_hash")
def run_configs(spark, root):
    c = table(spark, root, "config_versions", ["config_hash", "first_seen_run_date", "snapshot_hash"])
    return last_runs(spark, root).join(c, "config_hash", "left").select("run_id", "run_date", "config_hash", "first_seen_run_date", F.col("snapshot_hash").isNotNull().alias("known"))


@query("list_runs", f"""WITH {RUN}, v AS (SELECT run_id, count(*) AS n FROM (SELECT DISTINCT run_id, symbol FROM verdicts) GROUP BY run_id), s AS (SELECT run_date, count(*) AS n FROM signals GROUP BY run_date)
SELECT run.run_id, run.run_date, run.status, coalesce(v.n, 0) AS n_verdicts, coalesce(s.n, 0) AS n_signals FROM run LEFT JOIN v USING (run_id) LEFT JOIN s ON s.run_date = run.run_date""")
def list_runs(spark, root):
    v = table(spark, root, "verdicts", ["run_id", "symbol"]).distinct().groupBy("run_id").agg(F.count("*").alias("nv"))
    s = table(spark, root, "signals", ["run_date"]).groupBy("run_date").agg(F.count("*").alias("ns"))
    t = last_runs(spark, root).join(v, "run_id", "left").join(s, "run_date", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return t.select("run_id", "run_date", "status", zero("nv").alias("n_verdicts"), zero("ns").alias("n_signals"))


@query("latest_run_per_date", f"WITH {RUN} SELECT run_date, run_id, mode, status FROM run QUALIFY row_number() OVER (PARTITION BY run_date ORDER BY started_at DESC NULLS LAST, run_id DESC) = 1")
def latest_run_per_date(spark, root):
    """One adopted run per date: the last started, then the greatest id."""
    best = last_runs(spark, root).groupBy("run_date").agg(F.max(F.struct("started_at", "run_id", "mode", "status")).alias("m"))
    return best.select("run_date", "m.run_id", "m.mode", "m.status")


@query("drop_contested_runs", f"WITH {RUN}, a AS (SELECT run_date, count(*) AS n, max(started_at) AS last FROM run GROUP BY run_date) SELECT run.run_id, run.run_date FROM run JOIN a ON a.run_date = run.run_date WHERE a.n = 1 OR run.started_at = a.last")
def drop_contested_runs(spark, root):
    """Runs whose date is theirs alone, or that were started last on it."""
    r = last_runs(spark, root)
    a = r.groupBy("run_date").agg(F.count("*").alias("n"), F.max("started_at").alias("last"))
    return r.join(a, "run_date").where("n = 1 OR started_at = last").select("run_id", "run_date")


@query("stale_runs", f"""WITH {RUN}, c AS (SELECT max(started_at) - INTERVAL 24 HOUR AS cutoff FROM run)
SELECT run_id, status, CASE WHEN completed_at IS NULL AND started_at < cutoff THEN 'failed' ELSE status END AS swept FROM run, c""")
def stale_runs(spark, root):
    """Runs in their last state; those that have not ended a day before the newest start are swept to ``failed``."""
    r = last_runs(spark, root)
    cutoff = r.agg((F.max("started_at") - F.expr("INTERVAL 24 HOURS")).alias("cutoff"))
    stale = F.col("completed_at").isNull() & (F.col("started_at") < F.col("cutoff"))
    return r.crossJoin(F.broadcast(cutoff)).select("run_id", "status", F.when(stale, "failed").otherwise(F.col("status")).alias("swept"))


_LATER = "completed_at DESC NULLS LAST, started_at DESC NULLS LAST, status DESC NULLS LAST"


@query("run_deliveries", "SELECT run_id, count(*) AS deliveries, count(DISTINCT status) AS n_states, max(completed_at) IS NULL AS open FROM runs GROUP BY run_id")
def run_deliveries(spark, root):
    r = table(spark, root, "runs", ["run_id", "status", "completed_at"])
    return r.groupBy("run_id").agg(F.count("*").alias("deliveries"), F.count_distinct("status").alias("n_states"), F.max("completed_at").isNull().alias("open"))


@query("fetch_log_coalesce_merge", f"""SELECT run_id, strftime(max(completed_at), '%Y-%m-%d %H:%M:%S') AS completed_at, first(status ORDER BY {_LATER}) AS status,
 first(error_summary ORDER BY {_LATER}, error_summary DESC) FILTER (WHERE error_summary IS NOT NULL) AS error_summary, first(report_path ORDER BY {_LATER}, report_path DESC) FILTER (WHERE report_path IS NOT NULL) AS report_path, count(*) AS n FROM runs GROUP BY run_id""")
def fetch_log_coalesce_merge(spark, root):
    """Later deliveries update a row, but a null never replaces what was known: of each column the last delivery that has a value counts."""
    r = table(spark, root, "runs", ["run_id", "started_at", "completed_at", "status", "error_summary", "report_path"])
    when = ["completed_at", "started_at", "status"]
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(*when, c)))[c].alias(c)
    return r.groupBy("run_id").agg(
        F.date_format(F.max("completed_at"), "yyyy-MM-dd HH:mm:ss").alias("completed_at"), F.max(F.struct(*when))["status"].alias("status"),
        last("error_summary"), last("report_path"), F.count("*").alias("n"),
    )


@query("signal_min_max_argmin", f"WITH {SIG} SELECT run_date, strategy_key, count(*) AS n, min(strength) AS lo, max(strength) AS hi, first(symbol ORDER BY strength, symbol, signal_name) AS weakest FROM sig GROUP BY ALL")
def signal_min_max_argmin(spark, root):
    return best_signals(spark, root).groupBy("run_date", "strategy_key").agg(
        F.count("*").alias("n"), F.min("strength").alias("lo"), F.max("strength").alias("hi"), F.min(F.struct("strength", "symbol", "signal_name"))["symbol"].alias("weakest")
    )


@query("signal_performance", f"""WITH {BASE}, {SIG}, fw AS (SELECT symbol, date, round(100 * (lead(close, 5) OVER (PARTITION BY symbol ORDER BY date) / close - 1), 6) AS r5, round(100 * (lead(close, 20) OVER (PARTITION BY symbol ORDER BY date) / close - 1), 6) AS r20 FROM b),
j AS (SELECT sig.signal_name, fw.r5, fw.r20 FROM sig JOIN fw ON fw.symbol = sig.symbol AND fw.date = sig.run_date)
SELECT signal_name, count(*) AS n, count(*) FILTER (WHERE r5 > 1) AS tp5, count(*) FILTER (WHERE r5 < -1) AS fp5, count(*) FILTER (WHERE r20 > 1) AS tp20, count(*) FILTER (WHERE r20 < -1) AS fp20,
 round((0.6 * count(*) FILTER (WHERE r5 > 1) + 0.4 * count(*) FILTER (WHERE r20 > 1)) / nullif(0.6 * count(*) FILTER (WHERE abs(r5) > 1) + 0.4 * count(*) FILTER (WHERE abs(r20) > 1), 0), 6) AS hit_rate FROM j GROUP BY signal_name""")
def signal_performance(spark, root):
    """Weighted hit rate of each signal over two horizons."""
    f = clean_bars(spark, root).select("symbol", F.col("date").alias("run_date"), *[F.round(100 * S.forward_return("close", h), 6).alias(f"r{h}") for h in (5, 20)])
    j = best_signals(spark, root).join(f, ["symbol", "run_date"])
    c = lambda e: F.count_if(F.expr(e))
    top = 0.6 * c("r5 > 1") + 0.4 * c("r20 > 1")
    den = 0.6 * c("abs(r5) > 1") + 0.4 * c("abs(r20) > 1")
    return j.groupBy("signal_name").agg(
        F.count("*").alias("n"), c("r5 > 1").alias("tp5"), c("r5 < -1").alias("fp5"), c("r20 > 1").alias("tp20"), c("r20 < -1").alias("fp20"),
        r6(F.when(den > 0, top / den), "hit_rate"),
    )


@query("separation_welch", f"""WITH {OUT}, g AS (SELECT strategy_key, avg(r) FILTER (WHERE recommendation = 'proceed') AS a, avg(r) FILTER (WHERE recommendation = 'skip') AS s, var_samp(r) FILTER (WHERE recommendation = 'proceed') AS va, var_samp(r) FILTER (WHERE recommendation = 'skip') AS vs,
 count(*) FILTER (WHERE recommendation = 'proceed') AS na, count(*) FILTER (WHERE recommendation = 'skip') AS ns FROM o GROUP BY strategy_key), e AS (SELECT *, CASE WHEN na >= 2 AND ns >= 2 THEN sqrt(va / na + vs / ns) END AS se FROM g)
SELECT strategy_key, na AS n_proceed, ns AS n_skip, round(a - s, 5) AS gap, round(se, 5) AS se, round(a - s - 1.959963984540054 * se, 5) AS lower, round(a - s + 1.959963984540054 * se, 5) AS upper FROM e""")
def separation_welch(spark, root):
    """Mean outcome of one class against the other per strategy, with its standard error and interval."""
    o = outcomes(spark, root)
    of = lambda c: F.when(F.col("recommendation") == c, F.col("r"))
    g = o.groupBy("strategy_key").agg(
        F.avg(of("proceed")).alias("a"), F.avg(of("skip")).alias("s"), F.var_samp(of("proceed")).alias("va"), F.var_samp(of("skip")).alias("vs"),
        F.count(of("proceed")).alias("na"), F.count(of("skip")).alias("ns"),
    )
    g = g.withColumn("se", stats.welch_error(F.col("va"), F.col("na"), F.col("vs"), F.col("ns"))).withColumn("gap", F.col("a") - F.col("s"))
    r5 = lambda c, n: F.round(c, 5).alias(n)
    return g.select("strategy_key", F.col("na").alias("n_proceed"), F.col("ns").alias("n_skip"), r5(F.col("gap"), "gap"), r5(F.col("se"), "se"),
                    r5(F.col("gap") - stats.Z95 * F.col("se"), "lower"), r5(F.col("gap") + stats.Z95 * F.col("se"), "upper"))


@query("separation_paired", f"""WITH {OUT}, d AS (SELECT as_of, avg(r) FILTER (WHERE recommendation = 'proceed') - avg(r) FILTER (WHERE recommendation = 'skip') AS gap FROM o GROUP BY as_of)
SELECT count(gap) AS n_days, count(*) - count(gap) AS n_left_out, round(avg(gap), 5) AS mean_gap, CASE WHEN count(gap) >= 2 THEN round(stddev_samp(gap) / sqrt(count(gap)), 5) END AS se FROM d""")
def separation_paired(spark, root):
    """Mean of the daily gaps; days that lack a side are left out and counted."""
    of = lambda c: F.avg(F.when(F.col("recommendation") == c, F.col("r")))
    d = outcomes(spark, root).groupBy("as_of").agg((of("proceed") - of("skip")).alias("gap"))
    n = F.count("gap")
    return d.agg(n.alias("n_days"), (F.count("*") - n).alias("n_left_out"), F.round(F.avg("gap"), 5).alias("mean_gap"), F.round(stats.mean_error(F.stddev_samp("gap"), n), 5).alias("se"))


@query("separation_paired_excess", f"""WITH {OUT}, m AS (SELECT date, avg(r) AS bench FROM fw WHERE r IS NOT NULL GROUP BY date),
d AS (SELECT o.as_of, avg(o.r - m.bench) FILTER (WHERE recommendation = 'proceed') - avg(o.r - m.bench) FILTER (WHERE recommendation = 'skip') AS gap FROM o JOIN m ON m.date = o.as_of GROUP BY o.as_of)
SELECT count(gap) AS n_days, round(avg(gap), 5) AS mean_gap FROM d""")
def separation_paired_excess(spark, root):
    """The same on outcomes above the day's mean of all symbols."""
    f = clean_bars(spark, root).select(F.col("date").alias("as_of"), F.round(100 * S.forward_return("close", 5), 6).alias("b"))
    bench = f.groupBy("as_of").agg(F.avg("b").alias("bench"))
    o = outcomes(spark, root).join(bench, "as_of").withColumn("x", F.col("r") - F.col("bench"))
    of = lambda c: F.avg(F.when(F.col("recommendation") == c, F.col("x")))
    d = o.groupBy("as_of").agg((of("proceed") - of("skip")).alias("gap"))
    return d.agg(F.count("gap").alias("n_days"), F.round(F.avg("gap"), 5).alias("mean_gap"))


def _wilson_sql(h: str, n: str) -> str:
    z = "1.959963984540054"
    p = f"({h}::DOUBLE / {n})"
    mid = f"(({p} + {z} * {z} / (2 * {n})) / (1 + {z} * {z} / {n}))"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0 * {n} * {n})) / (1 + {z} * {z} / {n}))"
    return f"round(greatest(0.0, {mid} - {half}), 6) AS lower, round(least(1.0, {mid} + {half}), 6) AS upper"


@query("wilson_rates", f"""WITH {OUT}, g AS (SELECT strategy_key, recommendation, count(*) AS n, count(*) FILTER (WHERE CASE WHEN recommendation = 'proceed' THEN r > -0.5 ELSE r <= -0.5 END) AS hits FROM o GROUP BY ALL)
SELECT strategy_key, recommendation, n, hits, round(hits::DOUBLE / n, 6) AS rate, {_wilson_sql('hits', 'n')} FROM g""")
def wilson_rates(spark, root):
    hit = F.when(F.col("recommendation") == "proceed", F.col("r") > -0.5).otherwise(F.col("r") <= -0.5)
    g = outcomes(spark, root).groupBy("strategy_key", "recommendation").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    lo, hi = stats.wilson(F.col("hits"), F.col("n"))
    return g.select("strategy_key", "recommendation", "n", "hits", r6(F.col("hits") / F.col("n"), "rate"), r6(lo, "lower"), r6(hi, "upper"))


@query("severe_misses", f"""WITH {OUT} SELECT strategy_key, count(*) FILTER (WHERE recommendation = 'proceed') AS n_proceed, count(*) FILTER (WHERE recommendation = 'proceed' AND r <= -2) AS n_severe, round(avg(CASE WHEN r <= -2 THEN 1.0 ELSE 0.0 END), 6) AS baseline FROM o GROUP BY strategy_key""")
def severe_misses(spark, root):
    o = outcomes(spark, root)
    p = F.col("recommendation") == "proceed"
    return o.groupBy("strategy_key").agg(F.count_if(p).alias("n_proceed"), F.count_if(p & (F.col("r") <= -2)).alias("n_severe"), r6(F.avg(F.when(F.col("r") <= -2, 1.0).otherwise(0.0)), "baseline"))


@query("outcome_metrics", f"""WITH {OUT}, p AS (SELECT strategy_key, r FROM o WHERE recommendation = 'proceed')
SELECT strategy_key, count(*) AS n, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(sum(r) FILTER (WHERE r > 0) / nullif(-sum(r) FILTER (WHERE r < 0), 0), 5) AS profit_factor, round(avg(r), 5) AS expectancy,
 round(quantile_cont(r, 0.25), 8) AS q1, round(quantile_cont(r, 0.5), 8) AS q2, round(quantile_cont(r, 0.75), 8) AS q3 FROM p GROUP BY strategy_key""")
def outcome_metrics(spark, root):
    """Win rate, profit factor, expectancy and linear quartiles per strategy."""
    p = outcomes(spark, root).where("recommendation = 'proceed'")
    loss = -F.sum(F.when(F.col("r") < 0, F.col("r")))
    t = p.groupBy("strategy_key").agg(
        F.count("*").alias("n"), r6(F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)), "win_rate"),
        F.round(F.when(loss != 0, F.sum(F.when(F.col("r") > 0, F.col("r"))) / loss), 5).alias("profit_factor"), F.round(F.avg("r"), 5).alias("expectancy"),
    )
    q = quantiles.exact_quantiles(p, ["strategy_key"], "r", [0.25, 0.5, 0.75]).drop("n").withColumnRenamed("strategy_key", "key")
    t = t.join(q, F.col("key").eqNullSafe(F.col("strategy_key")))
    return t.select("strategy_key", "n", "win_rate", "profit_factor", "expectancy", *[F.round(F.col("quantiles")[k], 8).alias(f"q{k + 1}") for k in range(3)])


@query("verdict_mix", f"""WITH {VER}, v AS (SELECT DISTINCT run_id, symbol, recommendation, no_trade FROM ver) SELECT recommendation, count(*) AS n, count(DISTINCT run_id) AS n_runs, count(*) FILTER (WHERE no_trade) AS n_no_trade FROM v GROUP BY recommendation""")
def verdict_mix(spark, root):
    v = verdicts(spark, root).select("run_id", "symbol", "recommendation", "no_trade").distinct()
    return v.groupBy("recommendation").agg(F.count("*").alias("n"), F.count_distinct("run_id").alias("n_runs"), F.count_if("no_trade").alias("n_no_trade"))


@query("news_supply_cube", f"""WITH {VER}, v AS (SELECT DISTINCT run_id, symbol, coalesce(news_supply_level, 'unrecorded') AS level, recommendation FROM ver)
SELECT level, recommendation, grouping(level) AS g_level, grouping(recommendation) AS g_rec, count(*) AS n FROM v GROUP BY CUBE (level, recommendation)""")
def news_supply_cube(spark, root):
    """Cross table with margins; a null level is its own class before the cube."""
    v = verdicts(spark, root).select("run_id", "symbol", F.coalesce("news_supply_level", F.lit("unrecorded")).alias("level"), "recommendation").distinct()
    g = lambda c: F.grouping(c).cast("long")
    return v.cube("level", "recommendation").agg(g("level").alias("g_level"), g("recommendation").alias("g_rec"), F.count("*").alias("n"))


_REASONS = f"""WITH {VER}, d AS (SELECT DISTINCT run_id, symbol, recommendation, reasons_json AS j FROM ver),
p AS (SELECT run_id, symbol, recommendation, CASE WHEN json_valid(j) THEN CASE json_type(j::JSON) WHEN 'ARRAY' THEN j::JSON WHEN 'OBJECT' THEN json_extract(j::JSON, '$.reasons') END END AS a FROM d),
e AS (SELECT run_id, symbol, recommendation, unnest(CAST(a AS JSON[])) AS x FROM p WHERE a IS NOT NULL)"""


def reasons(spark, root) -> DataFrame:
    """Reasons of the readable documents, as an array or under ``reasons``; one row each, decoded in the JVM."""
    item = "array<struct<text:string,basis:string,source_ids:array<string>>>"
    v = verdicts(spark, root).select("run_id", "symbol", "recommendation", "reasons_json").distinct()
    j = F.try_parse_json("reasons_json")
    schema = F.schema_of_variant(j)
    arr = F.when(schema.startswith("ARRAY"), F.col("reasons_json")).when(schema.startswith("OBJECT"), F.get_json_object("reasons_json", "$.reasons"))
    return v.select("run_id", "symbol", "recommendation", F.explode(F.from_json(arr, item)).alias("x"))


@query("basis_contribution", _REASONS + "SELECT coalesce(json_extract_string(x, '$.basis'), 'untagged') AS basis, recommendation, count(*) AS n FROM e GROUP BY ALL")
def basis_contribution(spark, root):
    t = reasons(spark, root).select(F.coalesce("x.basis", F.lit("untagged")).alias("basis"), "recommendation")
    return t.groupBy("basis", "recommendation").agg(F.count("*").alias("n"))


@query("source_contribution", _REASONS + ", s AS (SELECT recommendation, unnest(CAST(json_extract_string(x, '$.source_ids[*]') AS VARCHAR[])) AS id FROM e) SELECT split_part(id, ':', 1) AS provider, recommendation, count(*) AS n FROM s GROUP BY ALL")
def source_contribution(spark, root):
    """Citations by provider, the part of a source id before its colon."""
    t = reasons(spark, root).select("recommendation", F.explode("x.source_ids").alias("id"))
    return t.groupBy(F.split_part("id", F.lit(":"), F.lit(1)).alias("provider"), "recommendation").agg(F.count("*").alias("n"))


@query("verdicts_without_reasons", f"WITH {VER}, k AS (SELECT DISTINCT run_id, symbol FROM ver), h AS (SELECT DISTINCT run_id, symbol FROM ver WHERE json_valid(reasons_json)) SELECT run_id, symbol FROM k WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.run_id = k.run_id AND h.symbol = k.symbol)")
def verdicts_without_reasons(spark, root):
    """Verdicts of which no delivery has a readable document."""
    v = verdicts(spark, root)
    readable = v.where(F.try_parse_json("reasons_json").isNotNull()).select("run_id", "symbol").distinct()
    return v.select("run_id", "symbol").distinct().join(readable, ["run_id", "symbol"], "left_anti")


@query("config_sliced_outcomes", f"WITH {OUT}, {RUN} SELECT run.config_hash, o.recommendation, count(*) AS n, round(avg(o.r), 5) AS mean_r FROM o JOIN run USING (run_id) WHERE run.config_hash IN (SELECT config_hash FROM config_versions) GROUP BY ALL")
def config_sliced_outcomes(spark, root):
    c = table(spark, root, "config_versions", ["config_hash"]).distinct()
    t = outcomes(spark, root).join(last_runs(spark, root).select("run_id", "config_hash"), "run_id").join(c, "config_hash", "left_semi")
    return t.groupBy("config_hash", "recommendation").agg(F.count("*").alias("n"), F.round(F.avg("r"), 5).alias("mean_r"))


@query("surprise_topk", f"WITH {OUT}, sp AS (SELECT run_id, symbol, max(abs(r)) AS peak FROM o WHERE recommendation = 'proceed' AND r <= -2 GROUP BY ALL) SELECT run_id, symbol, peak FROM sp ORDER BY peak DESC, run_id, symbol LIMIT 25")
def surprise_topk(spark, root):
    """The 25 largest misses: the limit is the report."""
    s = outcomes(spark, root).where("recommendation = 'proceed' AND r <= -2").groupBy("run_id", "symbol").agg(F.max(F.abs("r")).alias("peak"))
    return s.orderBy(F.desc("peak"), "run_id", "symbol").limit(25)


@query("sector_counts", f"WITH {MEM} SELECT snapshot_date, coalesce(sector, 'unknown') AS sector, count(*) AS n FROM mem GROUP BY ALL")
def sector_counts(spark, root):
    return members(spark, root).groupBy("snapshot_date", F.coalesce("sector", F.lit("unknown")).alias("sector")).agg(F.count("*").alias("n"))


@query("sector_rollup", f"WITH {MEM} SELECT strftime(snapshot_date, '%Y') AS year, coalesce(sector, 'unknown') AS sector, count(*) AS n, count(DISTINCT symbol) AS n_symbols FROM mem GROUP BY ROLLUP (strftime(snapshot_date, '%Y'), coalesce(sector, 'unknown'))")
def sector_rollup(spark, root):
    m = members(spark, root).select(F.date_format("snapshot_date", "yyyy").alias("year"), F.coalesce("sector", F.lit("unknown")).alias("sector"), "symbol")
    return m.rollup("year", "sector").agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("n_symbols"))


@query("control_group_union", """WITH u AS (SELECT as_of AS day, symbol, 1 AS class FROM verdicts UNION ALL SELECT run_date, symbol, 2 FROM signals UNION ALL SELECT date, symbol, 3 FROM bars)
SELECT day, symbol, min(class) AS class FROM u GROUP BY day, symbol""")
def control_group_union(spark, root):
    """Union of three groups; the first class that names a (day, symbol) wins."""
    a = table(spark, root, "verdicts", ["as_of", "symbol"]).select(F.col("as_of").alias("day"), "symbol", F.lit(1).alias("class"))
    b = table(spark, root, "signals", ["run_date", "symbol"]).select("run_date", "symbol", F.lit(2))
    c = table(spark, root, "bars", ["date", "symbol"]).select("date", "symbol", F.lit(3))
    return a.union(b).union(c).groupBy("day", "symbol").agg(F.min("class").alias("class"))


@query("symbol_set_algebra", """WITH a AS (SELECT DISTINCT symbol FROM signals), m AS (SELECT DISTINCT symbol FROM universe_membership), f AS (SELECT DISTINCT symbol FROM fundamentals)
SELECT 'signals_not_members' AS relation, count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM m) UNION ALL SELECT 'signals_and_filings', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM f) UNION ALL SELECT 'any', count(*) FROM (SELECT * FROM a UNION SELECT * FROM m UNION SELECT * FROM f)""")
def symbol_set_algebra(spark, root):
    a, m, f = (table(spark, root, t, ["symbol"]) for t in ("signals", "universe_membership", "fundamentals"))
    n = lambda df, name: df.agg(F.lit(name).alias("relation"), F.count("*").alias("n"))
    any_ = a.union(m).union(f).distinct()
    return n(a.subtract(m), "signals_not_members").union(n(a.intersect(f), "signals_and_filings")).union(n(any_, "any"))


_BASE_STRATA = f"WITH {MEM}, k AS (SELECT symbol, coalesce(arg_max(sector, snapshot_date), 'unknown') AS sector FROM mem GROUP BY symbol)"
_QUOTA = _BASE_STRATA + """, z AS (SELECT sector, count(*) AS size FROM k GROUP BY sector), y AS (SELECT *, sum(size) OVER () AS total FROM z),
w AS (SELECT sector, size, (20 * size) // total AS whole, (20 * size) % total AS rest FROM y), q AS (SELECT sector, size, least(size, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, sector) <= 20 - sum(whole) OVER () THEN 1 ELSE 0 END) AS quota FROM w)"""


def _strata(spark, root) -> DataFrame:
    m = members(spark, root).where("sector IS NOT NULL")
    known = m.groupBy("symbol").agg(F.max_by("sector", "snapshot_date").alias("sector"))
    every = table(spark, root, "universe_membership", ["symbol"]).distinct()
    return every.join(known, "symbol", "left").select("symbol", F.coalesce("sector", F.lit("unknown")).alias("sector"))


@query("largest_remainder_quota", _QUOTA + " SELECT sector, size, CAST(quota AS BIGINT) AS quota FROM q")
def largest_remainder_quota(spark, root):
    return sampling.quotas(_strata(spark, root), "sector", 20)


@query("stratified_sample", _QUOTA + ", r AS (SELECT symbol, sector, row_number() OVER (PARTITION BY sector ORDER BY sha256('s1' || symbol), symbol) AS n FROM k) SELECT r.symbol, r.sector FROM r JOIN q ON q.sector = r.sector WHERE r.n <= q.quota")
def stratified_sample(spark, root):
    return sampling.stratified_sample(_strata(spark, root), "sector", "symbol", 20, "s1").select("symbol", "sector")


@query("metrics_json_extract", """SELECT strategy_key, count(*) AS n, count(TRY_CAST(json_extract_string(metrics_json, '$.close') AS DOUBLE)) AS n_close, count(TRY_CAST(json_extract_string(metrics_json, '$.depth.d1') AS DOUBLE)) AS n_depth,
 round(max(TRY_CAST(json_extract_string(metrics_json, '$.close') AS DOUBLE)), 4) AS max_close FROM (SELECT strategy_key, CASE WHEN json_valid(metrics_json) THEN metrics_json END AS metrics_json FROM signals) GROUP BY strategy_key""")
def metrics_json_extract(spark, root):
    """Numbers at two paths of a JSON column; unreadable documents and other types are null."""
    s = table(spark, root, "signals", ["strategy_key", "metrics_json"])
    j = F.try_parse_json("metrics_json")
    num = lambda p: F.try_variant_get(j, p, "double")
    t = s.select("strategy_key", num("$.close").alias("c"), num("$.depth.d1").alias("d"))
    return t.groupBy("strategy_key").agg(F.count("*").alias("n"), F.count("c").alias("n_close"), F.count("d").alias("n_depth"), F.round(F.max("c"), 4).alias("max_close"))


@query("business_days_to_filing", f"""WITH {FIL}, p AS (SELECT accession_no, fiscal_period_end AS a, CAST(filed_at AS DATE) AS z FROM fil)
SELECT accession_no, CAST(CASE WHEN z <= a THEN 0 ELSE len(list_filter(generate_series(a + 1, z, INTERVAL 1 DAY), lambda d: isodow(d) <= 5)) END AS INTEGER) AS business_days FROM p""")
def business_days_to_filing(spark, root):
    """Weekdays from a period's end to its filing, by arithmetic."""
    f = filings(spark, root)
    return f.select("accession_no", stats.business_days(F.col("fiscal_period_end"), F.to_date("filed_at")).alias("business_days"))


@query("events_windowed", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_windowed(spark, root):
    """The batch form of the event-time aggregation in the streaming package."""
    e = table(spark, root, "events", ["ts", "event_type", "value"])
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.col("w.start").alias("window_start"), "event_type", "n", "total"
    )


@query("revenue_by_nation", """SELECT n.n_name, r.r_name, count(DISTINCT o.o_orderkey) AS n_orders, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY ALL""")
def revenue_by_nation(spark, root):
    """Star join: orders are reduced to one row each before the dimensions are met."""
    l = table(spark, root, "lineitem", ["l_orderkey", "l_extendedprice", "l_discount"])  # noqa: E741
    per_order = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    o = table(spark, root, "orders", ["o_orderkey", "o_custkey"]).join(per_order, "o_orderkey")
    c = table(spark, root, "customer", ["c_custkey", "c_nationkey"])
    t = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey").agg(F.count("*").alias("n_orders"), F.sum("rev").alias("rev"))
    n = table(spark, root, "nation").join(table(spark, root, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "r_name", "n_orders", F.round("rev", 2).alias("revenue"))


QUERIES = Q
__all__ = ["QUERIES", "SQL", "blank_to_null"]

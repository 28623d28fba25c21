"""Queries that select and measure texts within budgets, verify citations and settle symbols, facts and schedules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import nested
from ..sources.tables import table
from .corpus_core import _TREE, _p2_sources, p3_reasons
from . import daily
from .daily import _ORD, BASE, clean_bars, r6
from .derived import _LEVEL, _levels
from .ledger import FIL, RUN, filings, last_runs
from .tracking import _MARKS, _marks, _tracked, day

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# Texts ----------------------------------------------------------------------------------------------------------------------


@query("budgeted_texts", """WITH d AS (SELECT symbol, doc_id, published_at, length(text) AS n, least(length(text), 2000) AS want FROM documents WHERE symbol IS NOT NULL AND text IS NOT NULL AND source_type = 'filing'),
s AS (SELECT *, coalesce(sum(want) OVER (PARTITION BY symbol ORDER BY published_at DESC NULLS LAST, doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM d)
SELECT symbol, doc_id, CAST(n AS BIGINT) AS n_chars, CAST(greatest(0, least(want, 5000 - used)) AS BIGINT) AS taken, want < n OR 5000 - used < want AS is_cut FROM s""")
def budgeted_texts(spark, root):
    """Characters that each filing gets: the newest first, at most 2,000 a text and 5,000 a symbol. Lengths are shuffled, not texts."""
    d = table(spark, root, "documents", ["symbol", "doc_id", "published_at", "text", "source_type"]).where("symbol IS NOT NULL AND text IS NOT NULL AND source_type = 'filing'")
    d = d.select("symbol", "doc_id", "published_at", F.length("text").cast("long").alias("n_chars"))
    w = Window.partitionBy("symbol").orderBy(F.desc_nulls_last("published_at"), F.desc("doc_id")).rowsBetween(Window.unboundedPreceding, -1)
    want = F.least("n_chars", F.lit(2000).cast("long"))
    left = 5000 - F.coalesce(F.sum("want").over(w), F.lit(0))
    d = d.withColumn("want", want).withColumn("left", left)
    return d.select("symbol", "doc_id", "n_chars", F.greatest(F.lit(0).cast("long"), F.least("want", "left")).alias("taken"), ((F.col("want") < F.col("n_chars")) | (F.col("left") < F.col("want"))).alias("is_cut"))


@query("section_quotas", """WITH a AS (SELECT symbol, source_type, CAST(sum(length(text)) AS BIGINT) AS avail FROM documents WHERE symbol IS NOT NULL AND text IS NOT NULL GROUP BY ALL),
q AS (SELECT *, least(avail, CASE source_type WHEN 'filing' THEN 1500 WHEN 'news' THEN 900 ELSE 600 END) AS base FROM a), s AS (SELECT *, 3000 - sum(base) OVER (PARTITION BY symbol) AS slack, sum(avail - base) OVER (PARTITION BY symbol) AS short FROM q)
SELECT symbol, source_type, avail, CAST(base + CASE WHEN short > 0 THEN least(avail - base, slack * (avail - base) // short) ELSE 0 END AS BIGINT) AS allotted FROM s""")
def section_quotas(spark, root):
    """A symbol's 3,000 characters by kind of source: fixed quotas first, what they leave in proportion to what is short."""
    d = table(spark, root, "documents", ["symbol", "source_type", "text"]).where("symbol IS NOT NULL AND text IS NOT NULL")
    a = d.groupBy("symbol", "source_type").agg(F.sum(F.length("text")).alias("avail"))
    quota = F.when(F.col("source_type") == "filing", 1500).when(F.col("source_type") == "news", 900).otherwise(600).cast("long")
    w = Window.partitionBy("symbol")
    s = a.withColumn("base", F.least("avail", quota)).withColumns({"slack": 3000 - F.sum("base").over(w), "short": F.sum(F.col("avail") - F.col("base")).over(w)})
    more = F.when(F.col("short") > 0, F.least(F.col("avail") - F.col("base"), F.expr("slack * (avail - base) div short"))).otherwise(F.lit(0))
    return s.select("symbol", "source_type", "avail", (F.col("base") + more).cast("long").alias("allotted"))


@query("packed_blocks", r"""WITH p AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS bs FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, generate_subscripts(bs, 1) AS i, unnest(bs) AS block FROM p),
r AS (SELECT doc_id, i, length(block) AS n, CASE WHEN 2 * len(list_filter(string_split(block, chr(10)), lambda x: contains(x, '|'))) > len(string_split(block, chr(10))) THEN 0 WHEN regexp_matches(lower(block), 'forward-looking|no obligation|safe harbor') THEN 2 ELSE 1 END AS rank FROM b),
s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY rank, i) AS upto FROM r)
SELECT doc_id, count(*) AS n_blocks, count(*) FILTER (WHERE rank = 0) AS n_tables, count(*) FILTER (WHERE rank = 2) AS n_stock, count(*) FILTER (WHERE upto <= 800) AS n_kept, CAST(coalesce(sum(n) FILTER (WHERE upto <= 800), 0) AS BIGINT) AS kept_chars FROM s GROUP BY doc_id""")
def packed_blocks(spark, root):
    """Blocks of a text by value (tables, prose, stock wording), packed in that order into 800 characters."""
    d = table(spark, root, "documents", ["doc_id", "text"]).where("text IS NOT NULL")
    b = d.select("doc_id", F.posexplode(F.split("text", "\n\n", -1)).alias("i", "block"))
    lines = F.split("block", "\n", -1)
    rank = F.when(2 * F.size(F.filter(lines, lambda x: F.contains(x, F.lit("|")))) > F.size(lines), 0).when(F.lower("block").rlike("forward-looking|no obligation|safe harbor"), 2).otherwise(1)
    s = b.select("doc_id", "i", F.length("block").alias("n"), rank.alias("rank")).withColumn("upto", F.sum("n").over(Window.partitionBy("doc_id").orderBy("rank", "i")))
    fits = F.col("upto") <= 800
    return s.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("rank") == 0).alias("n_tables"), F.count_if(F.col("rank") == 2).alias("n_stock"), F.count_if(fits).alias("n_kept"), F.coalesce(F.sum(F.when(fits, F.col("n"))), F.lit(0)).alias("kept_chars"))


@query("header_parts", r"""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM p),
h AS (SELECT doc_id, i, length(line) AS n, CASE WHEN regexp_matches(line, '^(#+ |[A-Z][A-Z ]{7,}$|Item [0-9])') THEN 1 ELSE 0 END AS header FROM l), g AS (SELECT *, sum(header) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM h),
a AS (SELECT doc_id, part, max(header) AS headed, count(*) AS n_lines, sum(n) AS n FROM g GROUP BY ALL)
SELECT doc_id, count(*) AS n_parts, count(*) FILTER (WHERE headed = 1) AS n_headed, max(n_lines) AS most_lines, CAST(max(n) AS BIGINT) AS most_chars FROM a GROUP BY doc_id""")
def header_parts(spark, root):
    """Parts of a text that begin at its header lines."""
    d = table(spark, root, "documents", ["doc_id", "text"]).where("text IS NOT NULL")
    h = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    h = h.select("doc_id", "i", F.length("line").alias("n"), F.col("line").rlike(r"^(#+ |[A-Z][A-Z ]{7,}\z|Item [0-9])").cast("int").alias("header"))
    g = h.withColumn("part", F.sum("header").over(Window.partitionBy("doc_id").orderBy("i")))
    a = g.groupBy("doc_id", "part").agg(F.max("header").alias("headed"), F.count("*").alias("n_lines"), F.sum("n").alias("n"))
    return a.groupBy("doc_id").agg(F.count("*").alias("n_parts"), F.count_if(F.col("headed") == 1).alias("n_headed"), F.max("n_lines").alias("most_lines"), F.max("n").alias("most_chars"))


_FIGURE = r"([0-9]+[.][0-9]+) (million|billion)"


@query("magnitudes", f"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_FIGURE}', 1)) AS a, unnest(regexp_extract_all(text, '{_FIGURE}', 2)) AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) AS n, round(max(CAST(a AS DOUBLE) * CASE s WHEN 'million' THEN 1.0 ELSE 1000.0 END), 4) AS greatest, round(sum(CAST(a AS DOUBLE) * CASE s WHEN 'million' THEN 1.0 ELSE 1000.0 END), 3) AS total FROM f GROUP BY doc_id""")
def magnitudes(spark, root):
    """Figures with a scale word, in millions."""
    d = table(spark, root, "documents", ["doc_id", "text"]).where("text IS NOT NULL")
    part = lambda k: F.regexp_extract_all("text", F.lit(_FIGURE), F.lit(k))
    f = d.select("doc_id", F.explode(F.arrays_zip(part(1).alias("a"), part(2).alias("s"))).alias("x"))
    value = F.col("x.a").cast("double") * F.when(F.col("x.s") == "million", 1.0).otherwise(1000.0)
    return f.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.max(value), 4).alias("greatest"), F.round(F.sum(value), 3).alias("total"))


_QUOTES = (
    _TREE.replace("e.type,", "e.type, e.value, k.doc_id,").replace("SELECT root_table, root_key, CASE", "SELECT root_table, root_key, md5(root_key || chr(10) || j) AS doc_id, CASE").rstrip().rstrip(",")
    + r""", ev AS (SELECT root_key, doc_id, path, json_extract_string(value, '$.source_id') AS source_id FROM t WHERE root_table = 'verdicts' AND type = 'OBJECT' AND regexp_matches(path, '(^|[.])evidence\[[0-9]+\]$')),
qu AS (SELECT doc_id, path, regexp_replace(path, '[.]quotes\[[0-9]+\]$', '') AS parent, TRY_CAST(json_extract_string(value, '$.start') AS BIGINT) AS s, TRY_CAST(json_extract_string(value, '$.end') AS BIGINT) AS e FROM t WHERE root_table = 'verdicts' AND type = 'OBJECT' AND regexp_matches(path, '[.]quotes\[[0-9]+\]$')),
bo AS (SELECT source || ':' || CAST(doc_id AS VARCHAR) AS source_id, length(text) AS n FROM documents WHERE text IS NOT NULL)
SELECT ev.root_key, qu.path, ev.source_id, bo.n IS NOT NULL AS is_known, coalesce(bo.n IS NOT NULL AND s >= 0 AND e >= s AND e <= bo.n, false) AS is_contained FROM qu JOIN ev ON ev.doc_id = qu.doc_id AND ev.path = qu.parent LEFT JOIN bo ON bo.source_id = ev.source_id"""
)


@query("evidence_spans", _QUOTES)
def evidence_spans(spark, root):
    """Whether every quoted span lies inside the text that it cites. The related tables are joined by their keys."""
    (args,) = [s for s in _p2_sources(spark, root) if s[1] == "verdicts"]
    rows = nested.shred(*args).where("is_object and in_array")
    e = nested.table_of(rows, "evidence", ["source_id"]).select("root_key", "doc_id", F.col("path").alias("parent_path"), "source_id")
    q = nested.table_of(rows, "quotes", ["start", "end"]).select("doc_id", "path", "parent_path", F.col("start").try_cast("long").alias("s"), F.col("end").try_cast("long").alias("e"))
    d = table(spark, root, "documents", ["doc_id", "source", "text"]).where("text IS NOT NULL")
    d = d.select(F.concat("source", F.lit(":"), F.col("doc_id").cast("string")).alias("source_id"), F.length("text").alias("n"))
    j = q.join(e, ["doc_id", "parent_path"]).join(d, "source_id", "left")
    return j.select("root_key", "path", "source_id", F.col("n").isNotNull().alias("is_known"), F.coalesce(F.expr("n IS NOT NULL AND s >= 0 AND e >= s AND e <= n"), F.lit(False)).alias("is_contained"))


@query("step_orders", r"""SELECT doc_id, string_agg(status, '>' ORDER BY o) AS states FROM (SELECT k AS doc_id, status, min(o) AS o FROM (
 SELECT k.doc_id AS k, json_extract_string(e.value, '$.status') AS status, CAST(regexp_extract(e.fullkey, '\[([0-9]+)\]$', 1) AS BIGINT) AS o FROM (SELECT DISTINCT md5(coalesce(run_id, '') || chr(10) || metadata_json) AS doc_id,
 CASE WHEN json_type(metadata_json) = 'VARCHAR' THEN json_extract_string(metadata_json, '$') ELSE metadata_json END AS j FROM runs WHERE json_valid(metadata_json)) k, json_tree(k.j) e WHERE e.type = 'OBJECT' AND regexp_matches(e.fullkey, '[.]steps\[[0-9]+\]$')) WHERE status IS NOT NULL GROUP BY ALL) GROUP BY doc_id""")
def step_orders(spark, root):
    """The distinct states of a run's steps in the order in which they first occur."""
    (args,) = [s for s in _p2_sources(spark, root) if s[1] == "runs"]
    t = nested.table_of(nested.shred(*args).where("is_object and in_array"), "steps", ["status"]).where("status IS NOT NULL")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "status"))), lambda x: x["status"])
    return t.groupBy("doc_id").agg(F.array_join(F.array_distinct(in_order), ">").alias("states"))


# Symbols, facts, schedules ---------------------------------------------------------------------------------------------------


@query("symbols_normalised", """SELECT name AS symbol, count(*) AS n, count(DISTINCT source_symbol) AS n_spellings, coalesce(bool_and(name = symbol), false) AS agrees FROM (SELECT *, replace(trim(source_symbol), '.', '-') AS name FROM universe_membership) GROUP BY name""")
def symbols_normalised(spark, root):
    u = table(spark, root, "universe_membership", ["symbol", "source_symbol"])
    s = F.replace(F.trim("source_symbol"), F.lit("."), F.lit("-"))
    return u.groupBy(s.alias("name")).agg(F.count("*").alias("n"), F.count_distinct("source_symbol").alias("n_spellings"), F.coalesce(F.bool_and(s == F.col("symbol")), F.lit(False)).alias("agrees")).withColumnRenamed("name", "symbol")


@query("overridden_universe", """WITH l AS (SELECT symbol, max(snapshot_date) AS s FROM universe_membership GROUP BY symbol), last AS (SELECT max(snapshot_date) AS s FROM universe_membership), m AS (SELECT DISTINCT u.symbol, first(u.gics_sector ORDER BY u.gics_sector NULLS LAST) AS sector FROM universe_membership u, last WHERE u.snapshot_date = last.s AND u.symbol IS NOT NULL GROUP BY u.symbol),
ex AS (SELECT DISTINCT symbol FROM verdicts WHERE no_trade), inc AS (SELECT DISTINCT symbol FROM bars WHERE symbol IS NOT NULL)
SELECT symbol, coalesce(sector, 'Unknown') AS sector, false AS is_added FROM m WHERE symbol NOT IN (SELECT symbol FROM ex WHERE symbol IS NOT NULL) UNION ALL SELECT symbol, 'Unknown', true FROM inc WHERE symbol NOT IN (SELECT symbol FROM m) AND symbol NOT IN (SELECT symbol FROM ex WHERE symbol IS NOT NULL)""")
def overridden_universe(spark, root):
    """The newest members without those excluded by hand, and the includes that are missing in it."""
    u = table(spark, root, "universe_membership", ["snapshot_date", "symbol", "gics_sector"])
    last = u.agg(F.max("snapshot_date").alias("snapshot_date"))
    m = u.where("symbol IS NOT NULL").join(F.broadcast(last), "snapshot_date").groupBy("symbol").agg(F.min("gics_sector").alias("sector"))
    out = table(spark, root, "verdicts", ["symbol", "no_trade"]).where("no_trade AND symbol IS NOT NULL").select("symbol").distinct()
    inc = table(spark, root, "bars", ["symbol"]).where("symbol IS NOT NULL").distinct()
    kept = m.join(out, "symbol", "left_anti").select("symbol", F.coalesce("sector", F.lit("Unknown")).alias("sector"), F.lit(False).alias("is_added"))
    new = inc.join(m, "symbol", "left_anti").join(out, "symbol", "left_anti").select("symbol", F.lit("Unknown").alias("sector"), F.lit(True).alias("is_added"))
    return kept.unionByName(new)


@query("held_first", f"""WITH {_MARKS}, he AS (SELECT DISTINCT symbol FROM tp WHERE reason IS NULL), ca AS (SELECT DISTINCT symbol FROM verdicts WHERE symbol IS NOT NULL AND symbol NOT IN (SELECT symbol FROM he)),
al AS (SELECT 0 AS prio, symbol FROM he UNION ALL SELECT 1, symbol FROM ca) SELECT symbol, prio = 0 AS is_held, row_number() OVER (ORDER BY prio, symbol) AS place FROM al QUALIFY place <= 25""")
def held_first(spark, root):
    """The first 25 symbols: those held, then the other candidates, each in order."""
    held = _tracked(spark, root).where("reason IS NULL").select("symbol").distinct()
    other = table(spark, root, "verdicts", ["symbol"]).where("symbol IS NOT NULL").distinct().join(held, "symbol", "left_anti")
    first = held.withColumn("prio", F.lit(0)).unionByName(other.withColumn("prio", F.lit(1))).orderBy("prio", "symbol").limit(25)
    return first.select("symbol", (F.col("prio") == 0).alias("is_held"), F.row_number().over(Window.orderBy("prio", "symbol")).alias("place"))


@query("tidy_bars", f"WITH {BASE} SELECT symbol, strftime(date, '%Y-%m-%d') AS day, field, value FROM (UNPIVOT (SELECT symbol, date, open, high, low, close FROM b) ON open, high, low, close INTO NAME field VALUE value)")
def tidy_bars(spark, root):
    """Wide prices as one row per field."""
    return clean_bars(spark, root).unpivot(["symbol", "date"], ["open", "high", "low", "close"], "field", "value").select("symbol", day("date").alias("day"), "field", "value")


@query("picked_facts", f"WITH {FIL} SELECT accession_no, CASE WHEN net_income IS NOT NULL THEN 'net_income' WHEN revenue IS NOT NULL THEN 'revenue' WHEN assets IS NOT NULL THEN 'assets' END AS concept, coalesce(net_income, revenue, assets) AS value FROM fil")
def picked_facts(spark, root):
    """Of each filing's facts the first in order of priority that has a value. The facts are rows, as a source of facts delivers them."""
    f = filings(spark, root).select("accession_no", "net_income", "revenue", "assets")
    facts = f.unpivot("accession_no", ["net_income", "revenue", "assets"], "concept", "value")
    at = F.when(F.col("value").isNotNull(), F.array_position(F.array(*map(F.lit, ("net_income", "revenue", "assets"))), F.col("concept")))
    p = facts.groupBy("accession_no").agg(F.min(F.when(at.isNotNull(), F.struct(at.alias("at"), "concept", "value"))).alias("m"))
    return p.select("accession_no", "m.concept", "m.value")


@query("latest_and_prior", f"WITH {BASE}, k AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM b) SELECT symbol, strftime(max(date) FILTER (WHERE n = 1), '%Y-%m-%d') AS latest_day, max(close) FILTER (WHERE n = 1) AS latest, max(close) FILTER (WHERE n = 2) AS prior, round(max(close) FILTER (WHERE n = 1) - max(close) FILTER (WHERE n = 2), 6) AS delta FROM k WHERE n <= 2 GROUP BY symbol")
def latest_and_prior(spark, root):
    """The newest two readings of each source and their difference."""
    k = clean_bars(spark, root).withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where("n <= 2")
    of = lambda c, n: F.max(F.when(F.col("n") == n, F.col(c)))
    return k.groupBy("symbol").agg(day(of("date", 1)).alias("latest_day"), of("close", 1).alias("latest"), of("close", 2).alias("prior"), r6(of("close", 1) - of("close", 2), "delta"))


@query("fetch_due", """WITH n AS (SELECT max(CAST(fetched_at AS DATE)) AS today FROM fundamentals), a AS (SELECT symbol, accession_no, min(fetched_at) AS first_seen FROM fundamentals GROUP BY ALL), g AS (SELECT symbol, max(first_seen) AS news FROM a GROUP BY symbol),
s AS (SELECT f.symbol, max(CAST(f.fetched_at AS DATE)) AS last, count(*) FILTER (WHERE f.fetched_at > g.news) AS empties FROM fundamentals f JOIN g ON g.symbol = f.symbol GROUP BY f.symbol)
SELECT symbol, strftime(last, '%Y-%m-%d') AS last_day, empties, date_diff('day', last, today) >= 7 * 2 ** least(empties, 4) AS is_due FROM s, n""")
def fetch_due(spark, root):
    """Sources due for a fetch: after a week, doubled for every delivery since that brought no new filing."""
    f = table(spark, root, "fundamentals", ["symbol", "accession_no", "fetched_at"])
    today = f.agg(F.max(F.to_date("fetched_at")).alias("today"))
    news = f.groupBy("symbol", "accession_no").agg(F.min("fetched_at").alias("seen")).groupBy("symbol").agg(F.max("seen").alias("news"))
    s = f.join(news, "symbol").groupBy("symbol").agg(F.max(F.to_date("fetched_at")).alias("last"), F.count_if(F.col("fetched_at") > F.col("news")).alias("empties"))
    s = s.crossJoin(F.broadcast(today))
    return s.select("symbol", day("last").alias("last_day"), "empties", (F.date_diff("today", "last") >= 7 * F.pow(F.lit(2), F.least("empties", F.lit(4)))).alias("is_due"))


@query("run_cutoffs", f"WITH {RUN} SELECT run_id, strftime(run_date, '%Y-%m-%d') || ' 23:59:59' AS cutoff, started_at > run_date + INTERVAL 1 DAY AS is_late, strftime(run_date - 400, '%Y-%m-%d') AS history_from, strftime(run_date + (5 + 5) * 3, '%Y-%m-%d') AS window_to FROM run")
def run_cutoffs(spark, root):
    """Last moment of a run's day, whether it started later, and the calendar windows that its bars and horizons need."""
    r = last_runs(spark, root)
    return r.select("run_id", F.concat(day("run_date"), F.lit(" 23:59:59")).alias("cutoff"), (F.col("started_at") > F.to_timestamp(F.date_add("run_date", 1))).alias("is_late"), day(F.date_sub("run_date", 400)).alias("history_from"), day(F.date_add("run_date", (5 + 5) * 3)).alias("window_to"))


@query("position_view", f"""WITH {_MARKS}, {RUN}, im AS (SELECT run_id, symbol, arg_min(price, k) AS first_price, min(date) AS first_day FROM mk GROUP BY ALL), c AS (SELECT config_hash, min(first_seen_run_date) AS seen FROM config_versions GROUP BY config_hash)
SELECT tp.run_id, tp.symbol, run.mode, coalesce(run.status, 'unknown') AS run_status, strftime(c.seen, '%Y-%m-%d') AS config_seen, strftime(im.first_day, '%Y-%m-%d') AS first_day, round(im.first_price, 6) AS first_price, coalesce(tp.reason, 'open') AS status
FROM tp LEFT JOIN run ON run.run_id = tp.run_id LEFT JOIN c ON c.config_hash = run.config_hash LEFT JOIN im ON im.run_id = tp.run_id AND im.symbol = tp.symbol""")
def position_view(spark, root):
    """Positions with their run, its configuration and their first mark, each of them where it exists."""
    first = _marks(spark, root).groupBy("run_id", "symbol").agg(F.min(F.struct("held", "date", "price")).alias("f"))
    c = table(spark, root, "config_versions", ["config_hash", "first_seen_run_date"]).groupBy("config_hash").agg(F.min("first_seen_run_date").alias("seen"))
    r = last_runs(spark, root).select("run_id", "mode", F.col("status").alias("run_status"), "config_hash")
    t = _tracked(spark, root).select("run_id", "symbol", "reason").join(r, "run_id", "left").join(c, "config_hash", "left").join(first, ["run_id", "symbol"], "left")
    return t.select("run_id", "symbol", "mode", F.coalesce("run_status", F.lit("unknown")).alias("run_status"), day("seen").alias("config_seen"), day("f.date").alias("first_day"), r6(F.col("f.price"), "first_price"), F.coalesce("reason", F.lit("open")).alias("status"))


@query("config_digests", "SELECT config_hash, sha256(concat_ws('|', config_hash, coalesce(snapshot_hash, ''), coalesce(strftime(first_seen_run_date, '%Y-%m-%d'), ''))) AS digest FROM config_versions")
def config_digests(spark, root):
    """One digest of what identifies a configuration and its universe."""
    c = table(spark, root, "config_versions", ["config_hash", "snapshot_hash", "first_seen_run_date"])
    return c.select("config_hash", F.sha2(F.concat_ws("|", "config_hash", F.coalesce("snapshot_hash", F.lit("")), F.coalesce(day("first_seen_run_date"), F.lit(""))), 256).alias("digest"))


_REASONS = ("liquid", "above_mean", "mean_rising", "month_up", "passed")


@query("entry_blocks", f"""WITH f AS ({daily.SQL['first_rejection']}), r AS (SELECT unnest({list(_REASONS)}) AS reason UNION SELECT reason FROM f)
SELECT r.reason, CAST(coalesce(sum(f.n), 0) AS BIGINT) AS n, count(DISTINCT f.date) AS n_days FROM r LEFT JOIN f ON f.reason = r.reason GROUP BY r.reason""")
def entry_blocks(spark, root):
    """How often each reason blocks, those that never do included, and on how many days."""
    f = daily.Q["first_rejection"](spark, root)
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, _REASONS))).alias("reason"))
    # One zero row a reason, so that the aggregate needs no join.
    t = f.select("reason", "n", "date").unionByName(every.select("reason", F.lit(0).cast("long").alias("n"), F.lit(None).cast("date").alias("date")))
    return t.groupBy("reason").agg(F.sum("n").alias("n"), F.count_distinct("date").alias("n_days"))


@query("newest_events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_type FROM events WHERE ts IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 20")
def newest_events(spark, root):
    """The twenty newest entries of a calendar of events."""
    e = table(spark, root, "events", ["event_id", "ts", "event_type"]).where("ts IS NOT NULL").orderBy(F.desc("ts"), F.desc("event_id")).limit(20)
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "event_type")


_LOST = ("[... omitted", "[truncated", "(continued)", "...")


@query("loss_markers", "SELECT source, count(*) AS n, count(*) FILTER (WHERE " + " OR ".join(f"contains(text, '{m}')" for m in _LOST) + ") AS n_cut FROM documents WHERE text IS NOT NULL GROUP BY source")
def loss_markers(spark, root):
    """Texts that carry a mark of something left out, by source."""
    d = table(spark, root, "documents", ["source", "text"]).where("text IS NOT NULL")
    hit = F.lit(False)
    for m in _LOST:
        hit = hit | F.contains("text", F.lit(m))
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(hit).alias("n_cut"))


@query("positions_in_order", f"WITH {_MARKS} SELECT run_id, symbol, row_number() OVER (PARTITION BY symbol ORDER BY reason IS NULL DESC, as_of DESC, run_id) AS place, coalesce(reason, 'open') AS status FROM tp")
def positions_in_order(spark, root):
    """A symbol's positions as they are shown: the open ones first, the newest first."""
    v = table(spark, root, "verdicts", ["run_id", "symbol", "as_of"]).distinct()
    t = _tracked(spark, root).join(v, ["run_id", "symbol"])
    w = Window.partitionBy("symbol").orderBy(F.desc(F.col("reason").isNull()), F.desc("as_of"), "run_id")
    return t.select("run_id", "symbol", F.row_number().over(w).alias("place"), F.coalesce("reason", F.lit("open")).alias("status"))


@query("level_shares", f"WITH {_LEVEL}, a AS (SELECT level, count(*) AS n, count(DISTINCT date) AS n_days, count(DISTINCT symbol) AS n_symbols, min(r20) AS worst_20, max(r20) AS best_20 FROM e GROUP BY level) SELECT level, n, round(n::DOUBLE / sum(n) OVER (), 6) AS share, n_days, n_symbols, worst_20, best_20 FROM a")
def level_shares(spark, root):
    """Rows, share, days and symbols of each level and the extremes that followed. The share is taken over one row per level."""
    a = _levels(spark, root).groupBy("level").agg(
        F.count("*").alias("n"), F.count_distinct("date").alias("n_days"), F.count_distinct("symbol").alias("n_symbols"), F.min("r20").alias("worst_20"), F.max("r20").alias("best_20"))
    return a.select("level", "n", r6(F.col("n") / F.sum("n").over(Window.partitionBy()), "share"), "n_days", "n_symbols", "worst_20", "best_20")


# The part of problem 3 that SQL can say --------------------------------------------------------------------------------------


@query("p3_rules", f"""WITH s AS (SELECT symbol, date, open, high, low, close, volume FROM bars WHERE symbol IS NOT NULL AND date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY fetched_at DESC) = 1),
f AS (SELECT *, (NOT isfinite(open) OR open <= 0) IS TRUE OR (NOT isfinite(high) OR high <= 0) IS TRUE OR (NOT isfinite(low) OR low <= 0) IS TRUE OR (NOT isfinite(close) OR close <= 0) IS TRUE AS bad FROM s),
r AS (SELECT *, NOT bad AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND (high < greatest(open, close, low) - 1e-9 * close OR low > least(open, close, high) + 1e-9 * close) AS against,
 CASE WHEN isfinite(close) THEN close END AS c, CASE WHEN volume <> 0 THEN volume END AS v FROM f),
i AS (SELECT *, sum(CASE WHEN c = pc THEN 0 ELSE 1 END) {_ORD} AS ci, sum(CASE WHEN v = pv THEN 0 ELSE 1 END) {_ORD} AS vi FROM (SELECT *, lag(c) {_ORD} AS pc, lag(v) {_ORD} AS pv FROM r)),
k AS (SELECT *, count(*) OVER (PARTITION BY symbol, ci) AS cn, count(*) OVER (PARTITION BY symbol, vi) AS vn FROM i)
SELECT symbol, strftime(date, '%Y-%m-%d') AS day, reason FROM (SELECT symbol, date, unnest(list_filter([CASE WHEN bad OR volume < 0 THEN 'limit' END, CASE WHEN against THEN 'contradiction' END, CASE WHEN c = pc AND cn >= 5 THEN 'stuck_close' END, CASE WHEN v = pv AND vn >= 5 THEN 'stuck_volume' END], lambda x: x IS NOT NULL)) AS reason FROM k)""")
def p3_rules(spark, root):
    """The reasons of ``p3_reasons`` that no model decides: limits, contradictions and stuck readings."""
    return p3_reasons(spark, root).where(F.col("reason").isin("limit", "contradiction", "stuck_close", "stuck_volume"))


QUERIES = Q

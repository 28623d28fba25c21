"""Queries of the data-preparation problems 1 to 5."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import day_string, spelling_key
from ..operators import asof, dedupe, nested, rolling, snapshots, spikes
from ..sources.tables import table

LENGTHS = [7, 30]


def surviving_bars(spark: SparkSession, root: str, values: list[str]) -> DataFrame:
    """The delivery with the latest ``fetched_at`` of each (symbol, date)."""
    bars = table(spark, root, "bars", ["symbol", "date", *values, "fetched_at"])
    return dedupe.keep_last_figures(bars, ["symbol", "date"], "fetched_at", values)


def p1_rolling(spark: SparkSession, root: str) -> DataFrame:
    """Total and average volume and average close over 7 and 30 days, on every calendar day."""
    daily = surviving_bars(spark, root, ["volume", "close"])
    t = rolling.trailing_totals(daily, "symbol", "date", ["volume", "close"], LENGTHS)
    cols = []
    for n in LENGTHS:
        cols += [
            F.col(f"volume_sum_{n}").alias(f"volume_{n}d"),
            F.round(F.col(f"volume_sum_{n}") / n, 4).alias(f"volume_avg_{n}d"),
            F.round(F.try_divide(f"close_sum_{n}", f"close_cnt_{n}"), 6).alias(f"close_avg_{n}d"),
        ]
    return t.select("symbol", day_string(F.col("date")).alias("day"), *cols)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    daily = surviving_bars(spark, root, ["volume"])
    t = rolling.trailing_totals(daily, "symbol", "date", ["volume"], LENGTHS)
    big = lambda n: F.col(f"volume_sum_{n}").cast("decimal(25,0)")
    kind = F.when(F.col("volume_sum_7") == 0, "quiet").when(
        (F.col("volume_sum_7") > 0) & (big(7) * 10 >= big(30) * 7), "surge"
    )
    full = t.where(F.col("age") >= 29)
    return full.select("symbol", day_string(F.col("date")).alias("day"), kind.alias("kind")).where("kind is not null")


def _p2_sources(spark: SparkSession, root: str) -> list[tuple[DataFrame, str, F.Column, str]]:
    v = table(spark, root, "verdicts", ["run_id", "symbol", "reasons_json"])
    r = table(spark, root, "runs", ["run_id", "metadata_json"])
    c = table(spark, root, "config_versions", ["config_hash", "sections_json"])
    none = F.lit("")
    return [
        (v, "verdicts", F.concat(F.coalesce("run_id", none), F.lit("/"), F.coalesce("symbol", none)), "reasons_json"),
        (r, "runs", F.coalesce("run_id", none), "metadata_json"),
        (c, "config_versions", F.coalesce("config_hash", none), "sections_json"),
    ]


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    parts = [nested.nested_objects(*s) for s in _p2_sources(spark, root)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p2_tables(spark: SparkSession, root: str) -> DataFrame:
    """Rows and objects of each related table of repeated elements."""
    parts = [nested.shred(*s) for s in _p2_sources(spark, root)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.where("in_array").groupBy("root_table", "table_name").agg(F.count("*").alias("n_rows"), F.count_if("is_object").alias("n_objects"))


#: Related tables that are queries of their own: source, element, scalars of text and of numbers.
RELATED: dict[str, tuple[str, str, list[str], list[str]]] = {
    "p2_steps": ("runs", "steps", ["step", "status"], ["duration.total_s"]),
    "p2_providers": ("runs", "providers", ["name"], []),
    "p2_attempts": ("runs", "attempts", [], ["n"]),
    "p2_errors": ("runs", "errors", ["message"], ["code"]),
    "p2_evidence": ("verdicts", "evidence", ["source_id"], []),
    "p2_strategies": ("config_versions", "strategies", ["key"], []),
    "p2_filters": ("config_versions", "filters", ["field", "op"], ["value"]),
    "p2_tiers": ("config_versions", "tiers", [], ["upto", "pct"]),
}


def _related(source: str, element: str, texts: list[str], numbers: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, root: str) -> DataFrame:
        """One related table: key (doc_id, path), foreign key (doc_id, parent_path), source row root_key."""
        (args,) = [s for s in _p2_sources(spark, root) if s[1] == source]
        rows = nested.shred(*args).where("is_object and in_array")
        t = nested.table_of(rows, element, [*texts, *numbers]).drop("parent_table")
        return t.withColumns({c.replace(".", "_"): F.col(c.replace(".", "_")).try_cast("double") for c in numbers})

    return run


def _p3_readings(spark: SparkSession, root: str) -> DataFrame:
    bars = surviving_bars(spark, root, ["open", "high", "low", "close", "volume"])
    return spikes.implausible_readings(bars, "symbol", "date", ("open", "high", "low", "close"), "volume")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return _p3_readings(spark, root).select("symbol", day_string(F.col("date")).alias("day"))


def p3_reasons(spark: SparkSession, root: str) -> DataFrame:
    """Flagged bars by reason."""
    return (
        _p3_readings(spark, root)
        .select("symbol", day_string(F.col("date")).alias("day"), F.explode("reasons").alias("reason"))
    )


def p4_changes(spark: SparkSession, root: str) -> DataFrame:
    """Changes with old and new values, spelling noise aside."""
    return _membership_changes(spark, root, ["gics_sector"]).select(
        day_string(F.col("snapshot_date")).alias("snapshot_day"),
        "symbol",
        "change",
        spelling_key(F.col("old_gics_sector")).alias("old_sector"),
        spelling_key(F.col("new_gics_sector")).alias("new_sector"),
    )


def _membership_changes(spark: SparkSession, root: str, values: list[str]) -> DataFrame:
    m = table(spark, root, "universe_membership", ["snapshot_date", "symbol", "company_name", "gics_sector"])
    compared = {c: spelling_key(F.col(c)) for c in ("company_name", "gics_sector")}
    return snapshots.snapshot_changes(m, "snapshot_date", ["symbol"], compared, values)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    d = _membership_changes(spark, root, [])
    return d.select(day_string(F.col("snapshot_date")).alias("snapshot_day"), "symbol", "change")


def _p5_pairs(spark: SparkSession, root: str) -> DataFrame:
    return (
        table(spark, root, "verdicts", ["run_id", "symbol", "as_of"])
        .groupBy("run_id", "symbol")
        .agg(F.max("as_of").alias("as_of"))
    )


def p5_attributes(spark: SparkSession, root: str) -> DataFrame:
    """Each (run, symbol) with its filing and membership row as known on ``as_of``."""
    v = _p5_pairs(spark, root)
    f = table(spark, root, "fundamentals", ["accession_no", "symbol", "fiscal_period_end", "filed_at"]).withColumn(
        "filed_day", F.to_date("filed_at")
    )
    u = table(spark, root, "universe_membership", ["snapshot_date", "symbol", "gics_sector"]).withColumn(
        "gics_sector", spelling_key(F.col("gics_sector"))
    )
    asked = table(spark, root, "verdicts", ["symbol", "as_of"])
    with_filing = asof.known_as_of(
        v, f, ["symbol"], "as_of", "filed_day",
        ["fiscal_period_end", "filed_at", "accession_no"],
        ["accession_no", "filed_at", "fiscal_period_end"],
        asked_from=asked,
    )
    return asof.known_as_of(
        with_filing, u, ["symbol"], "as_of", "snapshot_date", ["snapshot_date"], ["snapshot_date", "gics_sector"], asked_from=asked
    )


def p5_figures(spark: SparkSession, root: str) -> DataFrame:
    """Each (run, symbol) with the newest filing's revenue as it had been delivered by ``as_of``: a figure that was
    corrected later comes out uncorrected."""
    v = _p5_pairs(spark, root)
    f = table(spark, root, "fundamentals", ["accession_no", "symbol", "fiscal_period_end", "filed_at", "fetched_at", "revenue"]).withColumn(
        "fetched_day", F.to_date("fetched_at")
    )
    t = asof.known_as_of(
        v, f, ["symbol"], "as_of", "fetched_day", ["fiscal_period_end", "filed_at", "accession_no"], ["fetched_at", "accession_no", "revenue"],
        asked_from=table(spark, root, "verdicts", ["symbol", "as_of"]),
    )
    return t.select("run_id", "symbol", "accession_no", day_string(F.to_date("fetched_at")).alias("fetched_day"), "revenue")


def p5_asof(spark: SparkSession, root: str) -> DataFrame:
    t = p5_attributes(spark, root)
    return t.select(
        "run_id",
        "symbol",
        "accession_no",
        F.date_format("filed_at", "yyyy-MM-dd HH:mm:ss").alias("filed_at"),
        day_string(F.col("fiscal_period_end")).alias("fiscal_period_end"),
        day_string(F.col("snapshot_date")).alias("snapshot_day"),
        F.col("gics_sector").alias("sector"),
    )


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    t = p5_attributes(spark, root)
    return t.select(
        "run_id",
        "symbol",
        F.coalesce("accession_no", F.lit("")).alias("accession_no"),
        F.coalesce(day_string(F.col("snapshot_date")), F.lit("")).alias("snapshot_day"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_rolling": p1_rolling,
    "p2_found": p2_found,
    "p2_tables": p2_tables,
    **{name: _related(*spec) for name, spec in RELATED.items()},
    "p3_found": p3_found,
    "p3_reasons": p3_reasons,
    "p4_found": p4_found,
    "p4_changes": p4_changes,
    "p5_found": p5_found,
    "p5_asof": p5_asof,
    "p5_figures": p5_figures,
}

_BARS = "(SELECT symbol, date, volume, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY fetched_at DESC) = 1)"
_DENSE = f"""b AS {_BARS},
span AS (SELECT symbol, min(date) AS lo, max(date) AS hi FROM b GROUP BY symbol),
cal AS (SELECT symbol, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM span),
dense AS (SELECT cal.symbol, cal.lo, cal.date, b.volume, b.close FROM cal LEFT JOIN b ON b.symbol = cal.symbol AND b.date = cal.date)"""
_W = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
_SPELL = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"

_CHANGES = f"""m AS (
 SELECT DISTINCT snapshot_date, symbol, {_SPELL.format('company_name')} AS c, {_SPELL.format('gics_sector')} AS g FROM universe_membership
), d AS (SELECT snapshot_date, lag(snapshot_date) OVER (ORDER BY snapshot_date) AS before FROM (SELECT DISTINCT snapshot_date FROM m)),
cur AS (SELECT d.snapshot_date AS s, m.symbol, m.c, m.g FROM m JOIN d USING (snapshot_date) WHERE d.before IS NOT NULL),
old AS (SELECT d.snapshot_date AS s, m.symbol, m.c, m.g FROM d JOIN m ON m.snapshot_date = d.before),
ch AS (
 SELECT coalesce(cur.s, old.s) AS s, coalesce(cur.symbol, old.symbol) AS symbol,
  CASE WHEN old.symbol IS NULL THEN 'added' WHEN cur.symbol IS NULL THEN 'removed' ELSE 'changed' END AS change, old.g AS old_sector, cur.g AS new_sector
 FROM cur FULL JOIN old ON cur.s = old.s AND cur.symbol = old.symbol
 WHERE old.symbol IS NULL OR cur.symbol IS NULL OR cur.c IS DISTINCT FROM old.c OR cur.g IS DISTINCT FROM old.g)"""

_ASOF = f"""v AS (SELECT run_id, symbol, max(as_of) AS as_of FROM verdicts GROUP BY run_id, symbol),
f AS (SELECT DISTINCT accession_no, symbol, fiscal_period_end, filed_at FROM fundamentals),
u AS (SELECT snapshot_date, symbol, max({_SPELL.format('gics_sector')}) AS g FROM universe_membership GROUP BY snapshot_date, symbol),
vf AS (SELECT v.*, f.accession_no, f.filed_at, f.fiscal_period_end FROM v LEFT JOIN f ON f.symbol = v.symbol AND CAST(f.filed_at AS DATE) <= v.as_of
 QUALIFY row_number() OVER (PARTITION BY v.run_id, v.symbol ORDER BY f.fiscal_period_end DESC NULLS LAST, f.filed_at DESC NULLS LAST, f.accession_no DESC NULLS LAST) = 1),
a AS (SELECT vf.*, u.snapshot_date, u.g FROM vf LEFT JOIN u ON u.symbol = vf.symbol AND u.snapshot_date <= vf.as_of
 QUALIFY row_number() OVER (PARTITION BY vf.run_id, vf.symbol ORDER BY u.snapshot_date DESC NULLS LAST) = 1)"""

_OBJECTS = r"""WITH RECURSIVE d AS (
 SELECT 'verdicts' AS root_table, coalesce(run_id, '') || '/' || coalesce(symbol, '') AS root_key, reasons_json AS j FROM verdicts
 UNION SELECT 'runs', coalesce(run_id, ''), metadata_json FROM runs
 UNION SELECT 'config_versions', coalesce(config_hash, ''), sections_json FROM config_versions
), u AS (SELECT root_table, root_key, CASE WHEN json_type(j) = 'VARCHAR' THEN json_extract_string(j, '$') ELSE j END AS j FROM d WHERE json_valid(j)),
k AS (SELECT *, row_number() OVER (ORDER BY root_table, root_key, j) AS doc FROM u WHERE json_valid(j)),
t AS (SELECT k.root_table, k.root_key, k.doc, e.id, e.parent, e.type, regexp_replace(e.fullkey, '^[$][.]?', '') AS path FROM k, json_tree(k.j) e),
o AS (SELECT t.root_table, t.root_key, t.doc, t.id, t.parent, t.path, t.type = 'OBJECT' AND coalesce(p.type = 'ARRAY', false) AS hit FROM t LEFT JOIN t p ON p.doc = t.doc AND p.id = t.parent),
up AS (SELECT doc, id, parent AS cur FROM o WHERE hit UNION ALL SELECT up.doc, up.id, o.parent FROM up JOIN o ON o.doc = up.doc AND o.id = up.cur WHERE NOT o.hit),
near AS (SELECT up.doc, up.id, o.path FROM up JOIN o ON o.doc = up.doc AND o.id = up.cur WHERE o.hit)
SELECT DISTINCT o.root_table, o.root_key, o.path, coalesce(near.path, '') AS parent_path FROM o LEFT JOIN near ON near.doc = o.doc AND near.id = o.id WHERE o.hit"""

_TREE = _OBJECTS[: _OBJECTS.index("o AS (")]


def _related_sql(source: str, element: str, texts: list[str], numbers: list[str]) -> str:
    read = lambda c: f"json_extract_string(t.value, '$.{c}')"
    cols = [f"{read(c)} AS {c}" for c in texts] + [f"TRY_CAST({read(c)} AS DOUBLE) AS {c.replace('.', '_')}" for c in numbers]
    tree = _TREE.replace("e.type,", "e.type, e.value, k.doc_id,").replace("SELECT root_table, root_key, CASE", "SELECT root_table, root_key, md5(root_key || chr(10) || j) AS doc_id, CASE")
    return (
        f"{tree.rstrip().rstrip(',')} SELECT t.root_key, t.doc_id, t.path, regexp_replace(regexp_replace(t.path, '[.]?{element}\\[[0-9]+\\]$', ''), '[^\\]]*$', '') AS parent_path, "
        f"CAST(regexp_extract(t.path, '\\[([0-9]+)\\]$', 1) AS BIGINT) AS ordinal, {', '.join(cols)} "
        f"FROM t WHERE t.root_table = '{source}' AND t.type = 'OBJECT' AND regexp_matches(t.path, '(^|[.]){element}\\[[0-9]+\\]$')"
    )


SQL: dict[str, str] = {
    "p2_found": _OBJECTS,
    "p2_tables": f"""{_TREE} a AS (SELECT t.root_table, t.path, t.type FROM t JOIN t p ON p.doc = t.doc AND p.id = t.parent WHERE p.type = 'ARRAY'),
n AS (SELECT root_table, type, CASE WHEN path LIKE '[%' AND NOT contains(path, '.') THEN '$' ELSE regexp_extract(path, '([^.\\[\\]]*)(\\[[0-9]+\\])+$', 1) END AS table_name FROM a)
SELECT root_table, table_name, count(*) AS n_rows, count(*) FILTER (WHERE type = 'OBJECT') AS n_objects FROM n GROUP BY root_table, table_name""",
    **{name: _related_sql(*spec) for name, spec in RELATED.items()},
    "p1_found": f"""WITH {_DENSE}, t AS (SELECT symbol, lo, date, sum(coalesce(volume, 0)) {_W.format(6)} AS v7, sum(coalesce(volume, 0)) {_W.format(29)} AS v30 FROM dense)
SELECT symbol, strftime(date, '%Y-%m-%d') AS day, CASE WHEN v7 = 0 THEN 'quiet' ELSE 'surge' END AS kind FROM t
WHERE date >= lo + 29 AND (v7 = 0 OR (v7 > 0 AND 10 * v7 >= 7 * v30))""",
    "p1_rolling": f"""WITH {_DENSE}, t AS (SELECT symbol, date, """
    + ", ".join(
        f"sum(coalesce(volume, 0)) {_W.format(n - 1)} AS v{n}, avg(close) {_W.format(n - 1)} AS c{n}" for n in LENGTHS
    )
    + """ FROM dense) SELECT symbol, strftime(date, '%Y-%m-%d') AS day, """
    + ", ".join(
        f"CAST(v{n} AS BIGINT) AS volume_{n}d, round(CAST(v{n} AS DOUBLE) / {n}, 4) AS volume_avg_{n}d, round(c{n}, 6) AS close_avg_{n}d"
        for n in LENGTHS
    )
    + " FROM t",
    "p4_found": f"WITH {_CHANGES} SELECT strftime(s, '%Y-%m-%d') AS snapshot_day, symbol, change FROM ch",
    "p4_changes": f"WITH {_CHANGES} SELECT strftime(s, '%Y-%m-%d') AS snapshot_day, symbol, change, old_sector, new_sector FROM ch",
    "p5_found": f"WITH {_ASOF} SELECT run_id, symbol, coalesce(accession_no, '') AS accession_no, coalesce(strftime(snapshot_date, '%Y-%m-%d'), '') AS snapshot_day FROM a",
    "p5_asof": f"WITH {_ASOF} SELECT run_id, symbol, accession_no, strftime(filed_at, '%Y-%m-%d %H:%M:%S') AS filed_at, strftime(fiscal_period_end, '%Y-%m-%d') AS fiscal_period_end, strftime(snapshot_date, '%Y-%m-%d') AS snapshot_day, g AS sector FROM a",
    "p5_figures": """WITH v AS (SELECT run_id, symbol, max(as_of) AS as_of FROM verdicts GROUP BY run_id, symbol)
SELECT v.run_id, v.symbol, f.accession_no, strftime(f.fetched_at, '%Y-%m-%d') AS fetched_day, f.revenue
FROM v LEFT JOIN fundamentals f ON f.symbol = v.symbol AND CAST(f.fetched_at AS DATE) <= v.as_of
QUALIFY row_number() OVER (PARTITION BY v.run_id, v.symbol ORDER BY f.fiscal_period_end DESC NULLS LAST, f.filed_at DESC NULLS LAST, f.accession_no DESC NULLS LAST, f.fetched_at DESC NULLS LAST, f.revenue DESC NULLS LAST) = 1""",
}

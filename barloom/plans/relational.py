"""Queries of scans, projections, joins, data health, upserts, set operations and relational kernels of services."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barloom.functions import clean, market as K, series as S
from barloom.operators import panel as P, quality
from barloom.operators.asof import known_at
from barloom.plans.base import B, D, W, bars, day, dense, lag, q6, r2, r6, sql, table
from barloom.plans.problems import SQL_REPORTS, reports
from barloom.sources import standardize as Z
from barloom.sources.store import incremental_start, keep_last, merge_bars, search_instruments

QUERIES: dict = {}
SQL: dict = {}


def C():
    return F.col("close")


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text is not None:
            SQL[name] = text
        return f

    return add


# Scans.


@query("s01_load_bars", sql(f"SELECT symbol, {D}, {q6('open * f / base')} AS open, {q6('close * f / base')} AS close, volume FROM (SELECT b.*, coalesce(adj_factor, 1) AS f, coalesce(nullif(l.lf, 0), 1) AS base FROM b LEFT JOIN l USING (symbol)) WHERE d BETWEEN DATE '2023-01-01' AND DATE '2023-12-31'", "l AS (SELECT symbol, arg_max(adj_factor, d) FILTER (adj_factor IS NOT NULL) AS lf FROM b GROUP BY symbol)"))
def s01_load_bars(spark: SparkSession, sf: str) -> DataFrame:
    """A year of bars, forward-adjusted on the factor of the full history."""
    whole = bars(spark, sf)
    df = P.adjust(whole.where(F.col("date").between("2023-01-01", "2023-12-31")), "qfq", whole)
    return df.select("symbol", day().alias("date"), r6("open").alias("open"), r6("close").alias("close"), "volume")


@query("s02_prune_symbols", sql(f"SELECT symbol, {D}, close FROM b WHERE symbol LIKE '60%'"))
def s02_prune_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).where(F.col("symbol").startswith("60")).select("symbol", day().alias("date"), "close")


@query("s03_symbols", "SELECT DISTINCT symbol FROM daily_bars ORDER BY symbol")
def s03_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "daily_bars").select("symbol").distinct().orderBy("symbol")


@query("s04_last_date", "SELECT symbol, strftime(max(date), '%Y-%m-%d') AS last_date FROM daily_bars GROUP BY symbol")
def s04_last_date(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "daily_bars").groupBy("symbol").agg(day(F.max("date")).alias("last_date"))


@query("s05_row_count", sql("SELECT symbol, count(*) AS n_rows FROM b GROUP BY ROLLUP (symbol)"))
def s05_row_count(spark: SparkSession, sf: str) -> DataFrame:
    """Per symbol, and in all (null symbol)."""
    return bars(spark, sf).rollup("symbol").agg(F.count(F.lit(1)).alias("n_rows"))


@query("s06_latest_factor", sql("SELECT symbol, arg_max(adj_factor, d) FILTER (adj_factor IS NOT NULL) AS latest_factor FROM b GROUP BY symbol"))
def s06_latest_factor(spark: SparkSession, sf: str) -> DataFrame:
    return P.latest_factor(bars(spark, sf))


@query("s07_calendar", "SELECT strftime(date, '%Y-%m-%d') AS date, row_number() OVER (ORDER BY date) - 1 AS ord FROM (SELECT DISTINCT date FROM calendar WHERE date IS NOT NULL)")
def s07_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return P.trading_days(table(spark, sf, "calendar")).select(day().alias("date"), "ord")


@query("s07_instruments", "SELECT symbol, trim(name) AS name, exchange, asset_type, strftime(list_date, '%Y-%m-%d') AS list_date, float_shares FROM instruments")
def s07_instruments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "instruments").select("symbol", F.trim("name").alias("name"), "exchange", "asset_type", day("list_date").alias("list_date"), "float_shares")


@query("s08_search_instruments", "SELECT symbol, name FROM instruments WHERE contains(upper(symbol), '60') OR coalesce(contains(name, '60'), false) ORDER BY symbol LIMIT 20")
def s08_search_instruments(spark: SparkSession, sf: str) -> DataFrame:
    return search_instruments(table(spark, sf, "instruments"), "60", 20).select("symbol", "name")


@query("s09_provenance", "SELECT symbol, count(*) AS n_rows, strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') AS updated_at FROM daily_bars GROUP BY symbol")
def s09_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "daily_bars").groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.date_format(F.max("updated_at"), "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


HFQ = f"z AS (SELECT symbol, d, close, pre_close, volume, amount, turnover_rate, adj_factor, CASE WHEN close > 0 THEN close * adj_factor / close END AS ratio, {lag('close')} AS prev FROM b)"
FILLED = f"coalesce(last_value(ratio IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), first_value(ratio IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


def landing(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A raw feed table and its adjusted closes, made from the store."""
    b = bars(spark, sf)
    raw = b.select("symbol", "date", "open", "high", "low", "close", "volume", "amount", (C() - F.col("pre_close")).alias("change"), (F.col("turnover_rate") / 100).alias("turnover"))
    return raw, b.select("symbol", "date", (C() * F.col("adj_factor")).alias("close"))


@query("s14_with_change", sql(f"SELECT symbol, {D}, {q6('close - (close - pre_close)')} AS pre_close, {q6(FILLED)} AS adj_factor FROM z", HFQ))
def s14_with_change(spark: SparkSession, sf: str) -> DataFrame:
    raw, adjusted = landing(spark, sf)
    return Z.with_change(raw, adjusted).select("symbol", day().alias("date"), r6("pre_close").alias("pre_close"), r6("adj_factor").alias("adj_factor"))


@query("s15_in_shares", sql(f"SELECT symbol, {D}, {q6('prev * ratio / nullif(' + lag('ratio') + ', 0)')} AS pre_close, {q6('volume / 100')} AS volume, {q6('turnover_rate / 100 * 100')} AS turnover_rate, {q6(FILLED)} AS adj_factor FROM z", HFQ))
def s15_in_shares(spark: SparkSession, sf: str) -> DataFrame:
    raw, adjusted = landing(spark, sf)
    return Z.in_shares(raw, adjusted).select("symbol", day().alias("date"), r6("pre_close").alias("pre_close"), r6("volume").alias("volume"), r6("turnover_rate").alias("turnover_rate"), r6("adj_factor").alias("adj_factor"))


@query("s16_fund_index", sql(f"SELECT 'fund' AS kind, symbol, {D}, prev AS pre_close, {q6('volume / 100')} AS volume, NULL::DOUBLE AS adj_factor FROM z UNION ALL SELECT 'index', symbol, {D}, prev, volume, 1.0 FROM z", HFQ))
def s16_fund_index(spark: SparkSession, sf: str) -> DataFrame:
    raw, _ = landing(spark, sf)
    cols = ["symbol", day().alias("date"), "pre_close", r6("volume").alias("volume"), "adj_factor"]
    return Z.fund(raw).select(F.lit("fund").alias("kind"), *cols).unionByName(Z.index(raw).select(F.lit("index").alias("kind"), *cols))


@query("s17_minutes", """WITH h AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS t, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume, sum(value) AS amount FROM events GROUP BY ALL)
    SELECT symbol, strftime(t, '%Y-%m-%d %H:%M') AS bar, open, high, low, close, lag(close) OVER (PARTITION BY symbol ORDER BY t) AS pre_close, volume / 100 AS volume, round(amount, 6) AS amount FROM h""")
def s17_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """Intraday bars of a stream of values, in the schema of the store."""
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("date")).agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"), F.sum("value").alias("amount"))
    return Z.minutes(e, shares=True).select("symbol", F.date_format("date", "yyyy-MM-dd HH:mm").alias("bar"), "open", "high", "low", "close", "pre_close", "volume", F.round("amount", 6).alias("amount"))


@query("s18_futures_daily", sql(f"SELECT symbol, {D}, close, prev AS pre_close, volume AS open_interest, 1.0::DOUBLE AS adj_factor FROM z", HFQ))
def s18_futures_daily(spark: SparkSession, sf: str) -> DataFrame:
    raw, _ = landing(spark, sf)
    return Z.minutes(raw.withColumn("hold", F.col("volume")), futures=True).select("symbol", day().alias("date"), "close", "pre_close", "open_interest", "adj_factor")


@query("s19_compact", sql(f"SELECT symbol, {D}, pre_close, volume, round(amount / 1000 * 1000, 2) AS amount, {q6(FILLED.replace('ratio', 'adj_factor'))} AS adj_factor FROM b"))
def s19_compact(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf)
    raw = b.select("symbol", F.date_format("date", "yyyyMMdd").alias("trade_date"), "open", "high", "low", "close", "pre_close", F.col("volume").alias("vol"), (F.col("amount") / 1000).alias("amount"))
    factor = b.select("symbol", F.date_format("date", "yyyyMMdd").alias("trade_date"), "adj_factor").where("adj_factor is not null")
    return Z.compact(raw, factor).select("symbol", day().alias("date"), "pre_close", "volume", F.round("amount", 2).alias("amount"), r6("adj_factor").alias("adj_factor"))


@query("s21_landed_pages", "SELECT regexp_extract(symbol, '([0-9]{6})', 1) AS code, strftime(date, '%Y-%m-%d') AS date, source, arg_max(close, (fetched_at, delivery_id)) AS close, count(*) AS deliveries FROM source_bars GROUP BY ALL")
def s21_landed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping pages of a feed: the last delivery of each bar."""
    s = table(spark, sf, "source_bars").select(clean.canon_code("symbol").alias("code"), day().alias("date"), "source", "close", "fetched_at", "delivery_id")
    return s.groupBy("code", "date", "source").agg(F.max_by("close", F.struct("fetched_at", "delivery_id")).alias("close"), F.count(F.lit(1)).alias("deliveries"))


# Projections and predicates.


@query("pr01_date_range", sql(f"SELECT symbol, {D}, close FROM b WHERE d BETWEEN DATE '2022-06-01' AND DATE '2022-06-30'"))
def pr01_date_range(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).where(F.col("date").between("2022-06-01", "2022-06-30")).select("symbol", day().alias("date"), "close")


@query("pr03_validation", f"WITH {B} SELECT count(*) AS n_rows, count(*) FILTER (high + 1e-6 < low OR greatest(open, close) > high + 1e-6 OR least(open, close) < low - 1e-6) AS broken_prices, count(*) FILTER (symbol IS NULL OR d IS NULL) AS missing_key FROM b")
def pr03_validation(spark: SparkSession, sf: str) -> DataFrame:
    """All rules of the bar schema in one pass."""
    df = bars(spark, sf)
    _, rules = quality.coerce_bars(df)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), rules["broken prices"].alias("broken_prices"), rules["missing key"].alias("missing_key"))


@query("pr04_adjust", sql(f"SELECT symbol, {D}, close AS raw, {q6('close * coalesce(adj_factor, 1)')} AS hfq, {q6('close * coalesce(adj_factor, 1) / coalesce(nullif(lf, 0), 1)')} AS qfq FROM b LEFT JOIN l USING (symbol)", "l AS (SELECT symbol, arg_max(adj_factor, d) FILTER (adj_factor IS NOT NULL) AS lf FROM b GROUP BY symbol)"))
def pr04_adjust(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).withColumn("raw", C())
    q = P.adjust(b, "qfq").withColumn("h", F.col("raw") * F.coalesce("adj_factor", F.lit(1.0)))
    return q.select("symbol", day().alias("date"), "raw", r6("h").alias("hfq"), r6("close").alias("qfq"))


@query("pr05_hfq_close", sql(f"SELECT symbol, {D}, {q6('close * coalesce(adj_factor, 1)')} AS h FROM b"))
def pr05_hfq_close(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select("symbol", day().alias("date"), r6(P.hfq()).alias("h"))


@query("pr06_symbols", """SELECT symbol, split_part(symbol, '.', 1) AS code, split_part(symbol, '.', 2) AS place,
    CASE WHEN symbol LIKE '%.SH' THEN CASE WHEN substr(symbol, 1, 2) IN ('50', '51', '56', '58') THEN 'etf' WHEN substr(symbol, 1, 2) IN ('60', '68') THEN 'stock' ELSE 'index' END
         WHEN symbol LIKE '%.SZ' THEN CASE WHEN symbol LIKE '399%' THEN 'index' WHEN substr(symbol, 1, 2) IN ('15', '16', '18') THEN 'etf' ELSE 'stock' END
         WHEN symbol LIKE '899%' THEN 'index' ELSE 'stock' END AS kind,
    (symbol LIKE '%.SH' AND substr(symbol, 1, 3) IN ('511', '513', '518')) OR substr(symbol, 1, 6) IN ('159920', '159941', '159934', '159937', '159942', '159980', '159985', '159981') AS same_day,
    symbol SIMILAR TO '[0-9]{6}\\.(SH|SZ|BJ)' AS valid FROM instruments""")
def pr06_symbols(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("symbol")
    return table(spark, sf, "instruments").select("symbol", K.code_of(s).alias("code"), K.exchange_of(s).alias("place"), K.asset_type(s).alias("kind"), K.is_same_day(s).alias("same_day"), K.is_valid_symbol(s).alias("valid"))


LIMIT = "CASE WHEN symbol LIKE '%.BJ' THEN 0.3 WHEN symbol SIMILAR TO '(688|689).*SH' OR symbol SIMILAR TO '(300|301).*SZ' THEN 0.2 ELSE 0.1 END"


@query("pr07_limit_ratio", f"SELECT symbol, ({LIMIT})::DOUBLE AS limit_ratio FROM instruments")
def pr07_limit_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "instruments").select("symbol", K.limit_ratio(F.col("symbol")).alias("limit_ratio"))


@query("pr08_round_cents", sql(f"SELECT symbol, {D}, floor(pre_close * 1.1 * 100 + 0.5) / 100 AS cents FROM b"))
def pr08_round_cents(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select("symbol", day().alias("date"), K.round_cents(F.col("pre_close") * 1.1).alias("cents"))


@query("pr09_limits", sql(f"SELECT symbol, {D}, floor(pre_close * (1 + k) * 100 + 0.5) / 100 AS up, floor(pre_close * (1 - k) * 100 + 0.5) / 100 AS down FROM (SELECT *, ({LIMIT})::DOUBLE AS k FROM b)"))
def pr09_limits(spark: SparkSession, sf: str) -> DataFrame:
    k = K.limit_ratio(F.col("symbol"))
    return bars(spark, sf).select("symbol", day().alias("date"), K.limit_up(F.col("pre_close"), k).alias("up"), K.limit_down(F.col("pre_close"), k).alias("down"))


@query("pr10_costs", "SELECT signal_id, side, round(CASE WHEN side = 'buy' THEN 10 * (1 + 2 / 1e4) ELSE 10 * (1 - 2 / 1e4) END, 6) AS price, round(greatest(v * 2.5e-4, 5) + CASE WHEN side = 'sell' THEN v * 5e-4 ELSE 0 END + v * 1e-5, 6) AS fees FROM (SELECT signal_id, side, (signal_id % 97) * 1000.0 + 100 AS v FROM signals WHERE side IS NOT NULL)")
def pr10_costs(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "signals").where("side is not null").withColumn("v", (F.col("signal_id") % 97) * 1000.0 + 100)
    return s.select("signal_id", "side", F.round(K.slipped(F.lit(10.0), F.col("side")), 6).alias("price"), F.round(K.stock_fees(F.col("v"), F.col("side")), 6).alias("fees"))


@query("pr11_futures_fees", "SELECT signal_id, round(o * 1e-4 + greatest(c - t, 0) * 1e-4 + least(greatest(t, 0), c) * 5e-4, 6) AS fees FROM (SELECT signal_id, (signal_id % 7) * 1000.0 AS o, (signal_id % 11) * 500.0 AS c, (signal_id % 5) * 700.0 AS t FROM signals)")
def pr11_futures_fees(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("signal_id")
    return table(spark, sf, "signals").select("signal_id", F.round(K.futures_fees((i % 7) * 1000.0, (i % 11) * 500.0, (i % 5) * 700.0), 6).alias("fees"))


FUT = "f AS (SELECT p_partkey, (['RB', 'TA', 'IF', 'AU', 'ZZ', 'IM'])[p_partkey % 6 + 1] || CASE WHEN p_partkey % 6 = 1 THEN (p_partkey % 10)::VARCHAR || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') WHEN p_partkey % 13 = 0 THEN '' ELSE '2' || (p_partkey % 10)::VARCHAR || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') END || CASE WHEN p_partkey % 6 IN (2, 5) THEN '.CFE' ELSE '.SHFE' END AS symbol FROM part)"
SPECS = "(VALUES " + ", ".join(f"('{p}', {m}, {g}, {l})" for p, m, g, _, _, _, l in K.CONTRACTS) + ") s(product, m, g, l)"


def contract_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Contract codes made from part keys."""
    k = F.col("p_partkey")
    month = F.lpad((k % 12 + 1).cast("string"), 2, "0")
    code = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("RB", "TA", "IF", "AU", "ZZ", "IM")]), (k % 6 + 1).cast("int")), F.when(k % 6 == 1, F.concat((k % 10).cast("string"), month)).when(k % 13 == 0, "").otherwise(F.concat(F.lit("2"), (k % 10).cast("string"), month)))
    return table(spark, sf, "part").select("p_partkey", F.concat(code, F.when((k % 6).isin(2, 5), ".CFE").otherwise(".SHFE")).alias("symbol"))


@query("pr12_contracts", f"WITH {FUT} SELECT p_partkey, symbol, coalesce(m, 10.0)::DOUBLE AS multiplier, coalesce(g, 0.12)::DOUBLE AS margin, coalesce(l, 0.10)::DOUBLE AS price_limit FROM f LEFT JOIN {SPECS} ON s.product = regexp_extract(f.symbol, '^([A-Z]+?)[0-9.]', 1)")
def pr12_contracts(spark: SparkSession, sf: str) -> DataFrame:
    return K.with_contract(contract_symbols(spark, sf)).select("p_partkey", "symbol", "multiplier", "margin", "price_limit")


@query("pr13_expiry", f"""WITH {FUT}, m AS (SELECT p_partkey, symbol, CASE WHEN length(g) = 4 THEN make_date(2000 + substr(g, 1, 2)::INT, substr(g, 3, 2)::INT, 1) WHEN length(g) = 3 THEN make_date(2020 + substr(g, 1, 1)::INT, substr(g, 2, 2)::INT, 1) END AS first FROM (SELECT *, regexp_extract(symbol, '([0-9]+)\\.', 1) AS g FROM f))
    SELECT p_partkey, symbol, strftime(CASE WHEN symbol LIKE '%.CFE' THEN first + ((5 - isodow(first) + 7) % 7 + 14)::INT ELSE first + 14 END, '%Y-%m-%d') AS expiry FROM m""")
def pr13_expiry(spark: SparkSession, sf: str) -> DataFrame:
    return contract_symbols(spark, sf).select("p_partkey", "symbol", day(K.contract_expiry(F.col("symbol"))).alias("expiry"))


@query("pr14_json_safe", "SELECT delivery_id, CASE WHEN close::VARCHAR NOT IN ('nan', 'inf', '-inf') THEN close END AS close, strftime(fetched_at, '%Y-%m-%dT%H:%M:%S') AS fetched_at FROM source_bars")
def pr14_json_safe(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("close")
    return table(spark, sf, "source_bars").select("delivery_id", F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias("close"), F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss").alias("fetched_at"))


@query("pr15_event_filters", "SELECT signal_id, symbol, strategy FROM signals WHERE contains(strategy, 'reversal') AND (symbol LIKE '60%' OR symbol LIKE '00%' OR symbol LIKE '92%') AND symbol IN (SELECT symbol FROM instruments)")
def pr15_event_filters(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "signals").where(F.col("strategy").contains("reversal") & F.substring("symbol", 1, 2).isin("60", "00", "92"))
    return s.join(table(spark, sf, "instruments").select("symbol").distinct(), "symbol", "left_semi").select("signal_id", "symbol", "strategy")


# Joins and alignment.


@query("j06_restrict", sql(f"SELECT s.symbol, strftime(s.d, '%Y-%m-%d') AS date, count(b.symbol) AS bars FROM (SELECT symbol, ts::DATE AS d FROM signals WHERE symbol IN (SELECT symbol FROM b)) s LEFT JOIN b ON b.symbol = s.symbol AND b.d = s.d GROUP BY ALL"))
def j06_restrict(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols known on both sides; dates of the left side, with or without a bar."""
    b = bars(spark, sf).select("symbol", "date", F.lit(1).alias("hit"))
    s = table(spark, sf, "signals").select("symbol", F.col("ts").cast("date").alias("date")).join(b.select("symbol").distinct(), "symbol", "left_semi")
    return s.join(b, ["symbol", "date"], "left").groupBy("symbol", "date").agg(F.count("hit").alias("bars")).withColumn("date", day())


@query("j08_densify", sql("SELECT symbol, count(*) AS cells, count(close) AS bars FROM p0 GROUP BY symbol", panel=True))
def j08_densify(spark: SparkSession, sf: str) -> DataFrame:
    return dense(spark, sf, ["close"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("cells"), F.count("close").alias("bars"))


@query("j10_asof", f"""SELECT symbol, strftime(date::DATE, '%Y-%m-%d') AS date, roe FROM (SELECT DISTINCT symbol, date::DATE AS date, substr(symbol, 1, 6) AS code FROM daily_bars) q
    ASOF LEFT JOIN (SELECT code, ann_date, arg_max(roe, (period, report_id)) AS roe FROM ({SQL_REPORTS}) WHERE roe IS NOT NULL AND ann_date > period AND code IS NOT NULL GROUP BY ALL) r ON q.code = r.code AND q.date >= r.ann_date""")
def j10_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Figures last announced at or before each bar, whatever their period."""
    said = reports(spark, sf).where("code is not null and roe is not null and ann_date > period")
    b = table(spark, sf, "daily_bars").select("symbol", F.col("date").cast("date").alias("date")).distinct().withColumn("code", F.substring("symbol", 1, 6))
    return known_at(b, said, event_entity="code", event_time="date", entity="code", known="ann_date", rank=["ann_date", "period", "report_id"], attributes=["roe"]).select("symbol", day().alias("date"), "roe")


@query("j13_membership", "WITH t AS (SELECT snapshot_tag, min(taken_at)::DATE AS taken FROM bar_snapshots GROUP BY 1), m AS (SELECT DISTINCT t.taken, upper(trim(symbol)) AS member FROM bar_snapshots JOIN t USING (snapshot_tag)), c AS (SELECT DISTINCT date FROM calendar WHERE date IS NOT NULL) SELECT strftime(c.date, '%Y-%m-%d') AS date, count(*) AS members FROM c JOIN m ON m.taken = (SELECT max(taken) FROM t WHERE taken <= c.date) GROUP BY 1")
def j13_membership(spark: SparkSession, sf: str) -> DataFrame:
    """How many symbols the latest snapshot before each day holds."""
    snaps = table(spark, sf, "bar_snapshots").select(F.col("taken_at").alias("taken"), clean.canon_symbol("symbol").alias("member")).distinct()
    dates = table(spark, sf, "calendar").where("date is not null").select("date").distinct()
    return P.membership(dates, snaps).groupBy("date").agg(F.count(F.lit(1)).alias("members")).withColumn("date", day())


EVENTS = f"""e AS (SELECT DISTINCT code, ann_date AS a FROM ({SQL_REPORTS}) WHERE ann_date > period AND code IS NOT NULL),
    s AS (SELECT symbol, substr(symbol, 1, 6) AS code, d, close, row_number() OVER (PARTITION BY symbol ORDER BY d) - 1 AS o FROM b),
    ax AS (SELECT s.symbol, e.a, min(s.o) AS o FROM e JOIN s ON s.code = e.code AND s.d >= e.a GROUP BY ALL),
    w AS (SELECT ax.symbol, ax.a, CASE WHEN x.close > 0 THEN y.close / x.close - 1 END AS ret_near, CASE WHEN z.close > 0 THEN u.close / z.close - 1 END AS ret_far FROM ax
          LEFT JOIN s x ON x.symbol = ax.symbol AND x.o = ax.o - 1 LEFT JOIN s y ON y.symbol = ax.symbol AND y.o = ax.o + 1
          LEFT JOIN s z ON z.symbol = ax.symbol AND z.o = ax.o + 1 LEFT JOIN s u ON u.symbol = ax.symbol AND u.o = ax.o + 21)"""


def announced(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf)
    codes = b.select("symbol").distinct().withColumn("code", F.substring("symbol", 1, 6))
    events = reports(spark, sf).where("ann_date > period and code is not null").select("code", F.col("ann_date").alias("announced")).distinct().join(codes, "code").select("symbol", "announced")
    return P.event_windows(events, b, [("ret_near", -1, 1), ("ret_far", 1, 21)])


@query("j14_event_windows", sql(f"SELECT symbol, strftime(a, '%Y-%m-%d') AS announced, {q6('ret_near')} AS ret_near, {q6('ret_far')} AS ret_far FROM w", EVENTS))
def j14_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    return announced(spark, sf).select("symbol", day("announced").alias("announced"), r6("ret_near").alias("ret_near"), r6("ret_far").alias("ret_far"))


@query("a17_event_stats", sql(f"SELECT split_part(symbol, '.', 2) AS place, count(*) AS n, {q6('avg(ret_near)')} AS near_mean, {q6('median(ret_near)')} AS near_median, {q6('avg((ret_near > 0)::INT)')} AS near_win, {q6('avg(ret_far)')} AS far_mean, {q6('median(ret_far)')} AS far_median, {q6('avg((ret_far > 0)::INT)')} AS far_win FROM w WHERE ret_near IS NOT NULL AND ret_far IS NOT NULL GROUP BY 1", EVENTS))
def a17_event_stats(spark: SparkSession, sf: str) -> DataFrame:
    w = announced(spark, sf).where("ret_near is not null and ret_far is not null")
    cols = [x for n in ("near", "far") for x in (r6(F.avg(f"ret_{n}")).alias(f"{n}_mean"), r6(F.median(f"ret_{n}")).alias(f"{n}_median"), r6(F.avg((F.col(f"ret_{n}") > 0).cast("double"))).alias(f"{n}_win"))]
    return w.groupBy(K.exchange_of(F.col("symbol")).alias("place")).agg(F.count(F.lit(1)).alias("n"), *cols)


@query("a18_event_pivot", sql(f"SELECT year(a)::INT AS y, {q6('avg(ret_far) FILTER (symbol LIKE $$%.SH$$)')} AS SH, {q6('avg(ret_far) FILTER (symbol LIKE $$%.SZ$$)')} AS SZ, {q6('avg(ret_far) FILTER (symbol LIKE $$%.BJ$$)')} AS BJ FROM w WHERE ret_near IS NOT NULL AND ret_far IS NOT NULL GROUP BY 1", EVENTS))
def a18_event_pivot(spark: SparkSession, sf: str) -> DataFrame:
    w = announced(spark, sf).where("ret_near is not null and ret_far is not null").select(F.year("announced").alias("y"), K.exchange_of(F.col("symbol")).alias("place"), "ret_far")
    wide = w.groupBy("y").pivot("place", ["SH", "SZ", "BJ"]).agg(F.avg("ret_far"))
    return wide.select("y", *[r6(c).alias(c) for c in ("SH", "SZ", "BJ")])


@query("j15_excess", sql(f"SELECT symbol, strftime(a, '%Y-%m-%d') AS announced, {q6('(1 + ret_near) / nullif(1 + m, 0) - 1')} AS excess FROM w JOIN (SELECT a, avg(ret_near) AS m FROM w GROUP BY a) USING (a) WHERE ret_near IS NOT NULL", EVENTS))
def j15_excess(spark: SparkSession, sf: str) -> DataFrame:
    """Return around an announcement over that of all announced on the day."""
    w = announced(spark, sf)
    m = w.groupBy(F.col("announced").alias("a")).agg(F.avg("ret_near").alias("m"))
    j = w.where("ret_near is not null").join(m, F.col("announced") == F.col("a"))
    return j.select("symbol", day("announced").alias("announced"), r6(F.try_divide(1 + F.col("ret_near"), 1 + F.col("m")) - 1).alias("excess"))


@query("j17_trading_days", "WITH c AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS o FROM (SELECT DISTINCT date FROM calendar WHERE date IS NOT NULL)) SELECT signal_id, strftime((SELECT n.date FROM c n WHERE n.o = (SELECT max(o) FROM c WHERE date <= ts::DATE) + 3), '%Y-%m-%d') AS third_after, strftime((SELECT n.date FROM c n WHERE n.o = (SELECT max(o) FROM c WHERE date < ts::DATE) - 1), '%Y-%m-%d') AS second_before FROM signals")
def j17_trading_days(spark: SparkSession, sf: str) -> DataFrame:
    cal = table(spark, sf, "calendar")
    s = table(spark, sf, "signals").select("signal_id", F.col("ts").cast("date").alias("day"))
    after = P.shift_days(s, "day", cal, 3).withColumnRenamed("shifted", "third_after")
    both = P.shift_days(after, "day", cal, -2).withColumnRenamed("shifted", "second_before")
    return both.select("signal_id", day("third_after").alias("third_after"), day("second_before").alias("second_before"))


@query("w18_ttm", f"""WITH r AS (SELECT code, period, arg_max(profit, (ann_date, report_id)) AS profit FROM (SELECT y.report_id, z.code, z.period, z.ann_date, CASE WHEN y.profit::VARCHAR <> 'nan' THEN y.profit END AS profit FROM yjbb y JOIN ({SQL_REPORTS}) z USING (report_id)) WHERE profit IS NOT NULL AND ann_date IS NOT NULL AND code IS NOT NULL AND period IS NOT NULL GROUP BY ALL),
    q AS (SELECT *, lag(profit) OVER w AS pp, lag(period) OVER w AS pd FROM r WINDOW w AS (PARTITION BY code ORDER BY period)),
    s AS (SELECT code, period, profit - CASE WHEN year(pd) = year(period) AND quarter(pd) = quarter(period) - 1 THEN pp ELSE 0 END AS single FROM q)
    SELECT code, strftime(period, '%Y-%m-%d') AS period, round(single, 2) AS single, CASE WHEN count(*) OVER f = 4 THEN round(sum(single) OVER f, 1) END AS ttm FROM s WINDOW f AS (PARTITION BY code ORDER BY period ROWS 3 PRECEDING)""")
def w18_ttm(spark: SparkSession, sf: str) -> DataFrame:
    """Cumulative profits to single quarters and the sum of the last four."""
    y = table(spark, sf, "yjbb").select(F.col("report_id").alias("__id"), clean.present("profit").alias("profit"))
    r = reports(spark, sf).join(y, F.col("report_id") == F.col("__id")).where("profit is not null and ann_date is not null and code is not null and period is not null")
    r = r.groupBy("code", "period").agg(F.max_by("profit", F.struct("ann_date", "report_id")).alias("profit"))
    w = Window.partitionBy("code").orderBy("period")
    before = F.lag("period").over(w)
    same = (F.year(before) == F.year("period")) & (F.quarter(before) == F.quarter("period") - 1)
    s = r.withColumn("single", F.col("profit") - F.when(same, F.lag("profit").over(w)).otherwise(0.0))
    return s.select("code", day("period").alias("period"), r2("single").alias("single"), F.round(S.rolling(F.sum, F.col("single"), 4, w), 1).alias("ttm"))


@query("f08_fundamentals", f"""SELECT q.symbol, strftime(q.d, '%Y-%m-%d') AS date, roe, gpm, round(CASE WHEN q.close > 0 THEN bvps / q.close END, 6) AS bp FROM (SELECT symbol, date::DATE AS d, max_by(close, updated_at) AS close FROM daily_bars GROUP BY ALL) q
    ASOF LEFT JOIN (SELECT z.code, z.ann_date, arg_max({{'roe': CASE WHEN y.roe::VARCHAR <> 'nan' THEN y.roe END, 'gpm': CASE WHEN y.gpm::VARCHAR <> 'nan' THEN y.gpm END, 'bvps': CASE WHEN y.bvps::VARCHAR <> 'nan' THEN y.bvps END}}, (z.period, report_id)) AS v FROM yjbb y JOIN ({SQL_REPORTS}) z USING (report_id) WHERE z.ann_date > z.period AND z.code IS NOT NULL GROUP BY ALL) r ON substr(q.symbol, 1, 6) = r.code AND q.d >= r.ann_date""".replace("roe, gpm, round(CASE WHEN q.close > 0 THEN bvps / q.close END, 6) AS bp FROM", "v.roe AS roe, v.gpm AS gpm, round(CASE WHEN q.close > 0 THEN v.bvps / q.close END, 6) AS bp FROM"))
def f08_fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    """Figures as last announced before each bar, and book value over price."""
    y = table(spark, sf, "yjbb").select(F.col("report_id").alias("__id"), clean.present("gpm").alias("gpm"), clean.present("bvps").alias("bvps"))
    said = reports(spark, sf).where("code is not null and ann_date > period").join(y, F.col("report_id") == F.col("__id"))
    b = bars(spark, sf).select("symbol", "date", "close", F.substring("symbol", 1, 6).alias("code"))
    k = known_at(b, said, event_entity="code", event_time="date", entity="code", known="ann_date", rank=["ann_date", "period", "report_id"], attributes=["roe", "gpm", "bvps"])
    return k.select("symbol", day().alias("date"), "roe", "gpm", F.round(F.when(C() > 0, F.col("bvps") / C()), 6).alias("bp"))


# Health, upserts, set operations.


@query("a15_health", sql(
    f"SELECT symbol, n_rows, first, last, missing_calendar_days, ohlc_violations, null_closes, factor_missing, coalesce(idle_days, 0) AS idle_days, coalesce(big_jumps, '') AS big_jumps FROM h LEFT JOIN st USING (symbol) LEFT JOIN mi USING (symbol) LEFT JOIN jp USING (symbol)",
    "h AS (SELECT symbol, count(*) AS n_rows, strftime(min(d), '%Y-%m-%d') AS first, strftime(max(d), '%Y-%m-%d') AS last, count(*) FILTER (high + 1e-6 < low OR greatest(open, close) > high + 1e-6 OR least(open, close) < low - 1e-6) AS ohlc_violations, count(*) FILTER (close IS NULL OR isnan(close)) AS null_closes, round(avg((adj_factor IS NULL)::INT), 6) AS factor_missing FROM b GROUP BY symbol)",
    "c AS (SELECT DISTINCT date FROM calendar WHERE date IS NOT NULL)", "mi AS (SELECT s.symbol, count(c.date) - count(b.d) AS missing_calendar_days FROM (SELECT symbol, min(d) AS a, max(d) AS z FROM b GROUP BY 1) s LEFT JOIN c ON c.date BETWEEN a AND z LEFT JOIN b ON b.symbol = s.symbol AND b.d = c.date GROUP BY 1)",
    "i1 AS (SELECT symbol, d, coalesce(volume <= 0, false)::INT AS z FROM b)", f"i2 AS (SELECT *, CASE WHEN z = {lag('z')} THEN 0 ELSE 1 END AS new FROM i1)", f"i3 AS (SELECT *, sum(new) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM i2)", "st AS (SELECT symbol, max(n) AS idle_days FROM (SELECT symbol, run, sum(z) AS n FROM i3 GROUP BY ALL) GROUP BY symbol)",
    f"jm AS (SELECT symbol, d FROM (SELECT symbol, d, abs(close / nullif({lag('close')}, 0) - 1) AS m FROM b) WHERE m > 0.2 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d) <= 3)", "jp AS (SELECT symbol, string_agg(strftime(d, '%Y-%m-%d'), ',' ORDER BY d) AS big_jumps FROM jm GROUP BY symbol)"))
def a15_health(spark: SparkSession, sf: str) -> DataFrame:
    h = quality.health(bars(spark, sf), table(spark, sf, "calendar"))
    return h.withColumns({"first": day("first"), "last": day("last"), "factor_missing": r6("factor_missing")})


@query("j09_calendar_gaps", sql("SELECT s.symbol, strftime(c.date, '%Y-%m-%d') AS date FROM (SELECT symbol, min(d) AS a, max(d) AS z FROM b GROUP BY 1) s JOIN (SELECT DISTINCT date FROM calendar) c ON c.date BETWEEN a AND z ANTI JOIN b ON b.symbol = s.symbol AND b.d = c.date"))
def j09_calendar_gaps(spark: SparkSession, sf: str) -> DataFrame:
    from barloom.operators.regrid import regularize

    g = regularize(table(spark, sf, "daily_bars"), table(spark, sf, "calendar"), "symbol", "date", [])
    return g.where("is_missing").select("symbol", day().alias("date"))


UP = "old AS (SELECT * FROM b WHERE d <= DATE '2024-06-30'), new AS (SELECT symbol, d, close, NULL::DOUBLE AS pre_close, CASE WHEN hash_ THEN adj_factor END AS adj_factor, volume FROM (SELECT *, day(d) % 2 = 0 AS hash_ FROM b) WHERE d >= DATE '2024-06-01')"


@query("k02_upsert", sql(f"SELECT symbol, {D}, close, pre_close, adj_factor, volume FROM (SELECT coalesce(n.symbol, o.symbol) AS symbol, coalesce(n.d, o.d) AS d, CASE WHEN n.d IS NOT NULL THEN n.close ELSE o.close END AS close, coalesce(n.pre_close, o.pre_close) AS pre_close, coalesce(n.adj_factor, o.adj_factor) AS adj_factor, CASE WHEN n.d IS NOT NULL THEN n.volume ELSE o.volume END AS volume FROM old o FULL JOIN new n ON o.symbol = n.symbol AND o.d = n.d)", UP))
def k02_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Later bars merged into earlier ones; previous close and factor keep old values where new ones are missing."""
    b = bars(spark, sf).select("symbol", "date", "close", "pre_close", "adj_factor", "volume")
    old, new = b.where("date <= '2024-06-30'"), b.where("date >= '2024-06-01'")
    new = new.withColumns({"pre_close": F.lit(None).cast("double"), "adj_factor": F.when(F.day("date") % 2 == 0, F.col("adj_factor"))})
    return merge_bars(old, new).select("symbol", day().alias("date"), "close", "pre_close", "adj_factor", "volume")


@query("k05_calendar", "SELECT DISTINCT strftime(date, '%Y-%m-%d') AS date FROM calendar WHERE date IS NOT NULL")
def k05_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "calendar").select(F.col("date").cast("date").alias("date")).where("date is not null").distinct().select(day().alias("date"))


@query("k06_incremental_start", "SELECT strftime(min(d) + 1, '%Y-%m-%d') AS start FROM (SELECT max(date::DATE) AS d FROM daily_bars GROUP BY symbol)")
def k06_incremental_start(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "daily_bars")
    last = b.groupBy("symbol").agg(F.max("date").alias("date"))
    return incremental_start(b, last.select("symbol")).select(day("start").alias("start"))


@query("o01_union_sources", "SELECT source, count(*) AS n FROM (SELECT source FROM source_bars UNION ALL SELECT source FROM bar_versions) GROUP BY source")
def o01_union_sources(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "source_bars").select("source", "delivery_id").unionByName(table(spark, sf, "bar_versions").select("source", "version_id"), allowMissingColumns=True)
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("o02_keep_last", "SELECT arg_max(version_id, (updated_at, version_id)) AS version_id FROM bar_versions GROUP BY regexp_extract(symbol, '([0-9]{6})', 1), date::DATE")
def o02_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "bar_versions").select("version_id", "updated_at", clean.canon_code("symbol").alias("code"), F.col("date").cast("date").alias("day"))
    return keep_last(v, ["code", "day"], ["updated_at", "version_id"]).select("version_id")


@query("o03_intersect", "SELECT DISTINCT substr(symbol, 1, 6) AS code FROM daily_bars WHERE substr(symbol, 1, 6) IN (SELECT lpad(trim(code), 6, '0') FROM yjbb)")
def o03_intersect(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "daily_bars").select(F.substring("symbol", 1, 6).alias("code"))
    return a.intersect(table(spark, sf, "yjbb").select(clean.canon_code("code").alias("code")))


@query("o04_except", "SELECT symbol FROM instruments EXCEPT SELECT symbol FROM signals")
def o04_except(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "instruments").select("symbol").subtract(table(spark, sf, "signals").select("symbol"))


@query("o05_sort", sql(f"SELECT symbol, {D}, close FROM b ORDER BY symbol, d"))
def o05_sort(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).orderBy("symbol", "date").select("symbol", day().alias("date"), "close")


@query("o06_top_amount", sql(f"SELECT symbol, {D}, amount FROM b WHERE amount IS NOT NULL ORDER BY amount DESC, symbol, d LIMIT 25"))
def o06_top_amount(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).where("amount is not null").orderBy(F.desc("amount"), "symbol", "date").limit(25).select("symbol", day().alias("date"), "amount")


@query("a21_last_of_day", "SELECT event_type, strftime(ts, '%Y-%m-%d') AS date, arg_max(value, ts) AS value FROM events GROUP BY ALL")
def a21_last_of_day(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type", day("ts").alias("date")).agg(F.max_by("value", "ts").alias("value"))


@query("a27_overview", sql("SELECT split_part(symbol, '.', 2) AS place, count(DISTINCT symbol) AS symbols, count(*) AS n_rows, strftime(min(d), '%Y-%m-%d') AS first, strftime(max(d), '%Y-%m-%d') AS last FROM b GROUP BY 1"))
def a27_overview(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).groupBy(K.exchange_of(F.col("symbol")).alias("place")).agg(F.countDistinct("symbol").alias("symbols"), F.count(F.lit(1)).alias("n_rows"), day(F.min("date")).alias("first"), day(F.max("date")).alias("last"))


@query("a16_codes", "SELECT side, strategy, count(*) AS n FROM signals GROUP BY ALL")
def a16_codes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "signals").groupBy("side", "strategy").agg(F.count(F.lit(1)).alias("n"))


@query("w09_warm_up", "WITH c AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS o FROM (SELECT DISTINCT date FROM calendar WHERE date IS NOT NULL)) SELECT strftime(x.date, '%Y-%m-%d') AS date, strftime(y.date, '%Y-%m-%d') AS load_from FROM c x JOIN c y ON y.o = greatest(x.o - 60, 0)")
def w09_warm_up(spark: SparkSession, sf: str) -> DataFrame:
    """First day to load so that 60 rows come before each day."""
    d = P.trading_days(table(spark, sf, "calendar"))
    other = d.select(F.col("ord").alias("o"), F.col("date").alias("load_from"))
    return d.withColumn("k", F.greatest(F.col("ord") - 60, F.lit(0))).join(other, F.col("k") == F.col("o")).select(day().alias("date"), day("load_from").alias("load_from"))


@query("w10_day_edges", "SELECT user_id, strftime(ts, '%Y-%m-%d') AS date, min(event_id) FILTER (f = 1) AS first_event, min(event_id) FILTER (l = 1) AS last_event, count(*) FILTER (strftime(ts, '%H:%M') >= '09:30') AS after_open FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts) AS f, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC) AS l FROM events) GROUP BY ALL")
def w10_day_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy("user_id", day("ts").alias("date")).agg(F.min_by("event_id", "ts").alias("first_event"), F.max_by("event_id", "ts").alias("last_event"), F.count_if(F.date_format("ts", "HH:mm") >= "09:30").alias("after_open"))


@query("w11_benchmark_base", sql(f"SELECT symbol, {D}, {q6('close / nullif(base, 0)')} AS rel FROM b JOIN (SELECT symbol, arg_max(close, d) AS base FROM b WHERE d < DATE '2024-06-01' GROUP BY symbol) USING (symbol) WHERE d >= DATE '2024-06-01'"))
def w11_benchmark_base(spark: SparkSession, sf: str) -> DataFrame:
    """Closes over the last close before the start."""
    b = bars(spark, sf)
    base = b.where("date < '2024-06-01'").groupBy("symbol").agg(F.max_by("close", "date").alias("base"))
    return b.where("date >= '2024-06-01'").join(base, "symbol").select("symbol", day().alias("date"), r6(F.try_divide(C(), F.col("base"))).alias("rel"))


@query("t04_duplicate_orders", "SELECT signal_id, repeated FROM (SELECT signal_id, coalesce(date_diff('second', lag(ts) OVER (PARTITION BY symbol, strategy, side ORDER BY ts, signal_id), ts) <= 86400, false) AS repeated FROM signals)")
def t04_duplicate_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Signals that repeat the one before them with the same fingerprint within a day."""
    w = Window.partitionBy("symbol", "strategy", "side").orderBy("ts", "signal_id")
    gap = F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts"))
    return table(spark, sf, "signals").select("signal_id", F.coalesce(gap <= 86400, F.lit(False)).alias("repeated"))


@query("t07_session", "SELECT signal_id, isodow(ts) < 6 AND (strftime(ts, '%H:%M:%S') BETWEEN '09:15:00' AND '11:30:00' OR strftime(ts, '%H:%M:%S') BETWEEN '13:00:00' AND '15:05:00') AS in_session FROM signals")
def t07_session(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "signals").select("signal_id", K.in_session(F.col("ts")).alias("in_session"))


@query("v05_reconcile", sql("SELECT symbol, CASE WHEN t IS NULL THEN 'untracked' WHEN t - a >= 100 THEN 'buy' WHEN t < a AND least(a - t, av) > 0 THEN 'sell' ELSE 'hold' END AS action, CASE WHEN t IS NULL THEN 0 WHEN t - a >= 100 THEN floor((t - a) / 100) * 100 WHEN t < a THEN least(a - t, av) ELSE 0 END::BIGINT AS qty FROM x",
    "x AS (SELECT coalesce(g.symbol, h.symbol) AS symbol, g.t, coalesce(h.a, 0) AS a, coalesce(h.av, 0) AS av FROM (SELECT symbol, count(*) * 130 AS t FROM signals WHERE side = 'buy' GROUP BY 1) g FULL JOIN (SELECT symbol, count(*) * 10 AS a, count(*) * 6 AS av FROM b GROUP BY 1) h ON g.symbol = h.symbol)"))
def v05_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    from barloom.operators.reconcile import reconcile

    target = table(spark, sf, "signals").where("side = 'buy'").groupBy("symbol").agg((F.count(F.lit(1)) * 130).alias("target"))
    actual = bars(spark, sf).groupBy("symbol").agg((F.count(F.lit(1)) * 10).alias("shares"), (F.count(F.lit(1)) * 6).alias("available"))
    return reconcile(target, actual).select("symbol", "action", "qty")


@query("v06_guard", sql("SELECT signal_id, CASE WHEN s.symbol NOT IN (SELECT symbol FROM b) THEN 'NOT_LISTED' WHEN NOT (isodow(ts) < 6 AND (strftime(ts, '%H:%M:%S') BETWEEN '09:15:00' AND '11:30:00' OR strftime(ts, '%H:%M:%S') BETWEEN '13:00:00' AND '15:05:00')) THEN 'CLOSED' WHEN signal_id % 1000 * 100 > 90000 THEN 'TOO_LARGE' ELSE 'OK' END AS verdict FROM signals s"))
def v06_guard(spark: SparkSession, sf: str) -> DataFrame:
    from barloom.operators.reconcile import guard

    orders = table(spark, sf, "signals").select("signal_id", "symbol", "ts", ((F.col("signal_id") % 1000) * 100).alias("notional"))
    return guard(orders, bars(spark, sf).select("symbol").distinct(), 90000.0).select("signal_id", "verdict")


@query("v08_compare_runs", "WITH m AS (SELECT strategy, count(*)::DOUBLE AS n, avg((side = 'buy')::INT) AS buys, count(DISTINCT symbol)::DOUBLE AS symbols FROM signals GROUP BY 1) SELECT k AS metric, round(max(v) FILTER (strategy = 'slow_growth'), 6) AS slow_growth, round(max(v) FILTER (strategy = 'pair_drift'), 6) AS pair_drift FROM (SELECT strategy, 'n' AS k, n AS v FROM m UNION ALL SELECT strategy, 'buys', buys FROM m UNION ALL SELECT strategy, 'symbols', symbols FROM m) GROUP BY k")
def v08_compare_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Measures of named runs side by side."""
    from barloom.operators.reconcile import compare_runs

    m = table(spark, sf, "signals").groupBy("strategy").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg((F.col("side") == "buy").cast("double")).alias("buys"), F.countDistinct("symbol").cast("double").alias("symbols"))
    runs = m.select(F.col("strategy").alias("run_id"), F.create_map(F.lit("n"), "n", F.lit("buys"), "buys", F.lit("symbols"), "symbols").alias("metrics"))
    wide = compare_runs(runs, ["slow_growth", "pair_drift"])
    return wide.select("metric", F.round("slow_growth", 6).alias("slow_growth"), F.round("pair_drift", 6).alias("pair_drift"))



"""Queries of the general data problems, whole tables, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.functions import clean
from barloom.functions.units import BARE, BASES, CONVERSIONS, MULTIPLIED, MULTIPLIERS
from barloom.operators.asof import known_at
from barloom.operators.copydiff import diff_copies
from barloom.operators.regrid import regularize, regularize_steps
from barloom.operators.snapshots import series_changes
from barloom.operators.spikes import flag_bars
from barloom.operators.units import Relation, UnitHarmonizer, conversion_table


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bar_copies(spark: SparkSession, sf: str, repeats: str) -> DataFrame:
    bars = table(spark, sf, "daily_bars").select("symbol", F.col("date").cast("date").alias("day"), "adj_factor", "pre_close")
    xdxr = table(spark, sf, "factor_xdxr").select(clean.canon_symbol("symbol").alias("symbol"), F.col("date").alias("day"), "adj_factor", "pre_close")
    return diff_copies(bars, xdxr, ["symbol", "day"], ["adj_factor", "pre_close"], repeats=repeats)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("kind") == "only_left", "only_bars").when(F.col("kind") == "only_right", "only_xdxr").when(F.col("kind") == "value", F.col("field"))
    # copies left over beyond the number of the other side are repeats of a row there, which count once
    return bar_copies(spark, sf, "count").select("symbol", clean.day_text("day").alias("date"), kind.alias("diff_kind")).where("diff_kind is not null").distinct()


def p1_differences(spark: SparkSession, sf: str) -> DataFrame:
    return bar_copies(spark, sf, "once").select("symbol", clean.day_text("day").alias("date"), "kind", "field", F.col("left_value").try_cast("double").alias("bars_value"), F.col("right_value").try_cast("double").alias("xdxr_value"), "n")


def p1_crowded(spark: SparkSession, sf: str) -> DataFrame:
    """The factors of a symbol's month as a bag: many rows a key on both sides, exact at four decimals; differences by symbol, month and kind."""
    def side(name: str, symbol: Column) -> DataFrame:
        rows = table(spark, sf, name).select(symbol.alias("symbol"), F.col("date").cast("date").alias("day"), F.round(clean.present("adj_factor"), 4).alias("adj_factor"))
        return rows.select("symbol", F.date_format("day", "yyyy-MM").alias("month"), "adj_factor")

    found = diff_copies(side("daily_bars", F.col("symbol")), side("factor_xdxr", clean.canon_symbol("symbol")), ["symbol", "month"], ["adj_factor"], tolerance=0.0)
    return found.groupBy("symbol", "month", "kind").agg(F.sum("n").alias("n"))


FIGURES = ("volume", "amount", "turnover_rate")


class BarUnits(UnitHarmonizer):
    """Bars: volume in lots, amount in yuan, turnover in percent of the float. Without ``figures``, rows have no say and only links do."""

    def __init__(self, figures: bool = True):
        super().__init__(
            {"volume": ("volume", "volume_unit"), "amount": ("amount", "amount_unit"), "turnover_rate": ("turnover_rate", "turnover_unit")},
            [
                Relation("volume", "amount", "log10(case when close > 0 then close end) + 2"),
                Relation("volume", "turnover_rate", "4 - log10(case when float_shares > 0 then cast(float_shares as double) end)"),
                Relation("amount", "turnover_rate", "2 - log10(case when float_shares > 0 then cast(float_shares as double) end) - log10(case when close > 0 then close end)"),
            ] if figures else [],
            row_id="delivery_id", source="source", entity=["__sym", "date"], delivered="fetched_at",
        )


def deliveries(spark: SparkSession, sf: str) -> DataFrame:
    bars = table(spark, sf, "source_bars")
    return bars.select("delivery_id", "source", clean.canon_symbol("symbol").alias("__sym"), "date", clean.present("close").alias("close"), "volume", "volume_unit", "amount", "amount_unit", "turnover_rate", "turnover_unit", "fetched_at")


def common_units(spark: SparkSession, sf: str, figures: bool = True) -> DataFrame:
    floats = table(spark, sf, "instruments").where("symbol is not null").groupBy(clean.canon_symbol("symbol").alias("__sym")).agg(F.max("float_shares").alias("float_shares"))
    return BarUnits(figures).harmonize(deliveries(spark, sf), table(spark, sf, "feed_units"), context=floats, context_key="__sym", keep=["close"])


def powers(units: DataFrame, asked: str, *more: str) -> DataFrame:
    """(delivery_id, field, power) of the figures for which the condition holds, and more columns kept per field."""
    each = F.array(*[F.when(F.expr(asked.format(f)), F.struct(F.lit(f).alias("field"), F.col(f"p_{f}").cast("bigint").alias("power"), *[F.col(f"{m}_{f}").alias(m) for m in more])) for f in FIGURES])
    return units.select("delivery_id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("delivery_id", "x.field", "x.power", *[f"x.{m}" for m in more])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return powers(common_units(spark, sf), "p_{0} <> 0")


def p2_linked(spark: SparkSession, sf: str) -> DataFrame:
    """How often the graph of sources alone comes to what the row's figures say: inferred figures by field, both powers, and whether other sources have a value."""
    alone = powers(common_units(spark, sf, figures=False), "i_{0}", "l").select(F.col("delivery_id").alias("__d"), F.col("field").alias("__f"), F.col("power").alias("by_links"), F.col("l").alias("linked"))
    both = powers(common_units(spark, sf), "i_{0}").join(alone, (F.col("delivery_id") == F.col("__d")) & (F.col("field") == F.col("__f")))
    return both.groupBy("field", "linked", F.col("power").alias("by_figures"), "by_links").agg(F.count(F.lit(1)).alias("n"))


def p2_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every delivery in lots, yuan and percent; which figures' units were inferred."""
    return common_units(spark, sf).select("delivery_id", "source", *[F.round(f"v_{f}", 6).alias(f) for f in FIGURES], F.concat_ws(",", *[F.when(F.col(f"i_{f}"), F.lit(f)) for f in FIGURES]).alias("inferred"))


def p2_conversions(spark: SparkSession, sf: str) -> DataFrame:
    """Conversions that links to other sources show for figures without stated units: one row per source, field and power."""
    units = BarUnits()
    _, pairs = units.links(units.read(deliveries(spark, sf), table(spark, sf, "feed_units"), []))
    return spark.createDataFrame(conversion_table(units.graph(pairs)[0]), "source string, field string, power int, share double")


def gridded(spark: SparkSession, sf: str, fields: list[str]) -> DataFrame:
    bars = table(spark, sf, "daily_bars").select("symbol", "date", "updated_at", *fields)
    return regularize(bars, table(spark, sf, "calendar"), "symbol", "date", fields, version="updated_at")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return gridded(spark, sf, []).where("is_missing").select("symbol", clean.day_text("date").alias("date"))


def p3_grid(spark: SparkSession, sf: str) -> DataFrame:
    return gridded(spark, sf, ["close", "adj_factor", "volume"]).withColumn("date", clean.day_text("date"))


def p3_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Readings at any moment on a grid of hours: the last value of each kind of event in each hour, filled and marked."""
    g = regularize_steps(table(spark, sf, "events"), "event_type", "ts", ["value"], 3600)
    return g.select("event_type", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("hour"), "is_missing", "value", "value_filled", "steps_since")


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """Reports with read keys and days; usable ones have roe and were announced after the end of their period."""
    y = table(spark, sf, "yjbb")
    return y.select("report_id", clean.canon_code("code").alias("code"), clean.parse_period("period").alias("period"), clean.parse_day("ann_date").alias("ann_date"), clean.present("roe").alias("roe"))


def signals_known(spark: SparkSession, sf: str, how: str) -> DataFrame:
    usable = reports(spark, sf).where("code is not null and roe is not null and ann_date > period")
    events = table(spark, sf, "signals").withColumn("code", clean.canon_code("symbol"))
    return known_at(events, usable, event_entity="code", event_time="ts", entity="code", known="ann_date", rank=["period", "ann_date", "report_id"], attributes=["report_id", "period", "ann_date", "roe"], how=how)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return signals_known(spark, sf, "inner").select("signal_id", "report_id")


def p4_signals(spark: SparkSession, sf: str) -> DataFrame:
    return signals_known(spark, sf, "left").select("signal_id", "symbol", "strategy", "side", "report_id", clean.day_text("period").alias("period"), clean.day_text("ann_date").alias("ann_date"), "roe")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return flag_bars(table(spark, sf, "daily_bars")).select("symbol", clean.day_text("date").alias("date"), "fault_kind")


def p6_changes(spark: SparkSession, sf: str) -> DataFrame:
    snaps = table(spark, sf, "bar_snapshots").withColumn("symbol", clean.canon_symbol("symbol"))
    changes = series_changes(snaps, "snapshot_tag", "taken_at", ["symbol", "date"], ["close", "adj_factor"])
    return changes.select("snapshot_tag", "symbol", clean.day_text("date").alias("date"), "change_kind", F.array_join("changed_fields", ",").alias("changed_fields"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_changes(spark, sf).drop("changed_fields")


QUERIES = {f.__name__: f for f in (p1_found, p1_differences, p1_crowded, p2_found, p2_linked, p2_values, p2_conversions, p3_found, p3_grid, p3_hours, p4_found, p4_signals, p5_found, p6_found, p6_changes)}

#: DuckDB expressions for the raw forms.
SQL_SYMBOL = "regexp_extract({0}, '([0-9]{{6}})', 1) || '.' || regexp_extract(upper({0}), '(SH|SZ|BJ)', 1)"
SQL_VALUE = "CASE WHEN {0}::VARCHAR <> 'nan' THEN {0} END"
SQL_DIFFER = "CASE WHEN {0} IS NULL OR {1} IS NULL THEN ({0} IS NULL) <> ({1} IS NULL) ELSE abs({0} - {1}) > 1e-5 * greatest(abs({0}), abs({1})) END"
SQL_NARROW = "translate({0}, '０１２３４５６７８９－／', '0123456789-/')"
SQL_DAY = f"""CASE
    WHEN trim({SQL_NARROW}) SIMILAR TO '[0-9]{{{{8}}}}' THEN try_strptime(trim({SQL_NARROW}), '%Y%m%d')::DATE
    WHEN trim({SQL_NARROW}) SIMILAR TO '[0-9]{{{{1,2}}}} [A-Z][a-z]{{{{2}}}} [0-9]{{{{4}}}}' THEN try_strptime(trim({SQL_NARROW}), '%d %b %Y')::DATE
    ELSE try_cast(regexp_replace(regexp_extract(trim({SQL_NARROW}), '^([0-9]{{{{4}}}}[-/年][0-9]{{{{1,2}}}}[-/月][0-9]{{{{1,2}}}})', 1), '[/年月]', '-', 'g') AS DATE) END"""
SQL_PERIOD = f"""coalesce({SQL_DAY}, try_cast(substr({{0}}, 1, 4) || CASE
    WHEN {{0}} LIKE '%Q1' OR {{0}} LIKE '%一季报' THEN '-03-31' WHEN {{0}} LIKE '%Q2' OR {{0}} LIKE '%中报' THEN '-06-30'
    WHEN {{0}} LIKE '%Q3' OR {{0}} LIKE '%三季报' THEN '-09-30' WHEN {{0}} LIKE '%Q4' OR {{0}} LIKE '%年报' THEN '-12-31' END AS DATE))"""
SQL_REPORTS = f"""SELECT report_id, lpad(trim(code), 6, '0') AS code, {SQL_PERIOD.format('period')} AS period, {SQL_DAY.format('ann_date')} AS ann_date, {SQL_VALUE.format('roe')} AS roe FROM yjbb"""



def _sql_powers() -> str:
    """(field, unit, power) of every multiple before every unit."""
    rows = []
    for f, bases in BASES.items():
        rows += [(f, b, p) for b, p in bases.items()]
        if f in MULTIPLIED:
            rows += [(f, m + b, x + p) for m, x in MULTIPLIERS.items() for b, p in bases.items()]
        if f in BARE:
            rows += [(f, m, x) for m, x in MULTIPLIERS.items()]
    return "VALUES " + ", ".join(f"('{f}', '{u}', {p})" for f, u, p in rows)


def _sql_units() -> str:
    """p: delivery_id, source, n_, p_ (power, inferred from the figures of the row where it isn't stated) and i_ per field."""
    unit = f"lower(regexp_replace(translate({{0}}, '０１２３４５６７８９－／．，＋　：％', '0123456789-/.,+ :%'), '[\\s\u00a0]+', '', 'g'))"
    number = r"^([+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?)"
    read = " UNION ALL ".join(f"""SELECT delivery_id, source, fetched_at::DATE AS d, '{f}' AS field, {unit.format(f)} AS u, {unit.format(c)} AS c FROM source_bars""" for f, c in zip(FIGURES, ("volume_unit", "amount_unit", "turnover_unit")))
    wide = ", ".join(f"max(n) FILTER (field = '{f}') AS n{i}, max(p) FILTER (field = '{f}') AS p{i}" for i, f in enumerate(FIGURES))
    sets = " CROSS JOIN ".join(f"(SELECT unnest({list(CONVERSIONS[f])}) AS c{i})" for i, f in enumerate(FIGURES))
    open_ = " AND ".join(f"((p{i} IS NULL AND n{i} IS NOT NULL) OR c{i} = (SELECT min(x) FROM (SELECT unnest({list(CONVERSIONS[f])}) AS x)))" for i, f in enumerate(FIGURES))
    at = [f"(CASE WHEN n{i} > 0 THEN log10(n{i}) END + CASE WHEN p{i} IS NULL THEN c{i} ELSE p{i} END)" for i in range(3)]
    price, held = "log10(CASE WHEN close > 0 THEN close END)", "log10(CASE WHEN float_shares > 0 THEN float_shares::DOUBLE END)"
    own = " + ".join(f"coalesce(abs({x}), 0)" for x in (f"{at[0]} - {at[1]} + {price} + 2", f"{at[0]} - {at[2]} + 4 - {held}", f"{at[1]} - {at[2]} + 2 - {held} - {price}"))
    linked = " + ".join(f"CASE WHEN p{i} IS NULL AND n{i} IS NOT NULL THEN coalesce(abs({at[i]} - m{i}), 0) ELSE 0 END" for i in range(3))
    means = ", ".join(f"avg(avg(CASE WHEN n{i} > 0 THEN log10(n{i}) + p{i} END)) OVER (PARTITION BY symbol, date) AS m{i}" for i in range(3))
    return f"""
    units(field, u, p) AS ({_sql_powers()}),
    raw AS ({read}),
    cut AS (SELECT *, regexp_extract(u, '{number}', 1) AS digits FROM raw),
    num AS (SELECT delivery_id, source, d, field, c, try_cast(replace(digits, ',', '') AS DOUBLE) AS n, substr(u, length(digits) + 1) AS b FROM cut WHERE digits <> ''),
    told AS (SELECT n.delivery_id, n.field, arg_max(u.p, coalesce(f.valid_from, DATE '0001-01-01')) AS p FROM num n JOIN feed_units f ON f.source = n.source AND f.field = n.field AND n.d >= coalesce(f.valid_from, DATE '0001-01-01') AND n.d < coalesce(f.valid_to, DATE '9999-12-31')
        JOIN units u ON u.field = f.field AND u.u = lower(regexp_replace(f.unit, '\\s+', '', 'g')) GROUP BY ALL),
    st AS (SELECT n.*, CASE WHEN b <> '' THEN x.p ELSE coalesce(y.p, t.p) END AS p FROM num n LEFT JOIN units x ON x.field = n.field AND x.u = n.b LEFT JOIN units y ON y.field = n.field AND y.u = n.c AND n.c <> '' LEFT JOIN told t ON t.delivery_id = n.delivery_id AND t.field = n.field
        WHERE n.b = '' OR x.p IS NOT NULL),
    fl AS (SELECT {SQL_SYMBOL.format('symbol')} AS symbol, max(float_shares) AS float_shares FROM instruments WHERE symbol IS NOT NULL GROUP BY 1),
    w AS (SELECT s.delivery_id, s.source, {SQL_SYMBOL.format('s.symbol')} AS symbol, s.date, CASE WHEN s.close::VARCHAR <> 'nan' THEN s.close END AS close, v.* EXCLUDE (delivery_id) FROM source_bars s JOIN (SELECT delivery_id, {wide} FROM st GROUP BY 1) v USING (delivery_id)),
    lk AS (SELECT DISTINCT symbol, date, m0, m1, m2 FROM (SELECT symbol, date, {means} FROM w GROUP BY symbol, date, source)),
    best AS (SELECT delivery_id, arg_min({{'c0': c0, 'c1': c1, 'c2': c2}}, {{'a': round(({own}) * 2), 'b': {linked}}}) AS c
        FROM (SELECT * FROM w WHERE {' OR '.join(f'(n{i} IS NOT NULL AND p{i} IS NULL)' for i in range(3))}) w LEFT JOIN lk USING (symbol, date) LEFT JOIN fl USING (symbol) CROSS JOIN {sets} WHERE {open_} GROUP BY 1),
    p AS ({' UNION ALL '.join(f"SELECT delivery_id, '{f}' AS field, n{i} AS n, coalesce(p{i}, b.c.c{i})::BIGINT AS power, p{i} IS NULL AS inferred FROM w LEFT JOIN best b USING (delivery_id) WHERE n{i} IS NOT NULL" for i, f in enumerate(FIGURES))})"""


_COPIES = f"""
    b AS (SELECT DISTINCT symbol, date::DATE AS d, {SQL_VALUE.format('adj_factor')} AS f, {SQL_VALUE.format('pre_close')} AS p FROM daily_bars),
    x AS (SELECT DISTINCT {SQL_SYMBOL.format('symbol')} AS symbol, date AS d, {SQL_VALUE.format('adj_factor')} AS f, {SQL_VALUE.format('pre_close')} AS p FROM factor_xdxr),
    m AS (SELECT coalesce(b.symbol, x.symbol) AS symbol, coalesce(b.d, x.d) AS d, b.symbol IS NULL AS nob, x.symbol IS NULL AS nox, b.f AS bf, x.f AS xf, b.p AS bp, x.p AS xp
          FROM b FULL JOIN x ON b.symbol = x.symbol AND b.d = x.d)"""
_GRID = """
    bars AS (SELECT symbol, date::DATE AS d, max_by(struct_pack(close := close, adj_factor := CASE WHEN adj_factor::VARCHAR <> 'nan' THEN adj_factor END, volume := CASE WHEN volume::VARCHAR <> 'nan' THEN volume END), updated_at) AS v FROM daily_bars GROUP BY ALL),
    span AS (SELECT symbol, min(d) AS a, max(d) AS z FROM bars GROUP BY 1),
    grid AS (SELECT symbol, c.date AS d FROM span JOIN (SELECT DISTINCT date FROM calendar WHERE date IS NOT NULL) c ON c.date BETWEEN a AND z)"""
_SNAPS = f"""
    tags AS (SELECT snapshot_tag, row_number() OVER (ORDER BY min(taken_at)) AS k FROM bar_snapshots GROUP BY 1),
    rows AS (SELECT DISTINCT ON (k, symbol, date) * FROM (SELECT k, upper(trim(symbol)) AS symbol, date, {SQL_VALUE.format('close')} AS c, {SQL_VALUE.format('adj_factor')} AS f FROM bar_snapshots JOIN tags USING (snapshot_tag))),
    old AS (SELECT k + 1 AS k, symbol, date, c, f FROM rows WHERE k < (SELECT max(k) FROM tags)),
    new AS (SELECT * FROM rows WHERE k > 1),
    m AS (SELECT coalesce(o.k, n.k) AS k, coalesce(o.symbol, n.symbol) AS symbol, coalesce(o.date, n.date) AS date,
          CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN {SQL_DIFFER.format('o.c', 'n.c')} OR {SQL_DIFFER.format('o.f', 'n.f')} THEN 'changed' END AS change_kind,
          concat_ws(',', CASE WHEN o.k IS NOT NULL AND n.k IS NOT NULL AND {SQL_DIFFER.format('o.c', 'n.c')} THEN 'close' END, CASE WHEN o.k IS NOT NULL AND n.k IS NOT NULL AND {SQL_DIFFER.format('o.f', 'n.f')} THEN 'adj_factor' END) AS changed_fields
          FROM old o FULL JOIN new n ON o.k = n.k AND o.symbol = n.symbol AND o.date = n.date)"""
_KNOWN = f"""
    r AS (SELECT * FROM ({SQL_REPORTS}) WHERE roe IS NOT NULL AND ann_date > period),
    k AS (SELECT s.signal_id, s.symbol, s.strategy, s.side, r.report_id, r.period, r.ann_date, r.roe,
          row_number() OVER (PARTITION BY s.signal_id ORDER BY r.period DESC NULLS LAST, r.ann_date DESC, r.report_id DESC) AS rn
          FROM signals s LEFT JOIN r ON r.code = substr(s.symbol, 1, 6) AND r.ann_date <= s.ts::DATE)"""

SQL = {
    "p1_found": f"""WITH {_COPIES}
        SELECT symbol, strftime(d, '%Y-%m-%d') AS date, 'only_bars' AS diff_kind FROM m WHERE nox
        UNION ALL SELECT symbol, strftime(d, '%Y-%m-%d'), 'only_xdxr' FROM m WHERE nob
        UNION ALL SELECT symbol, strftime(d, '%Y-%m-%d'), 'adj_factor' FROM m WHERE NOT nob AND NOT nox AND {SQL_DIFFER.format('bf', 'xf')}
        UNION ALL SELECT symbol, strftime(d, '%Y-%m-%d'), 'pre_close' FROM m WHERE NOT nob AND NOT nox AND {SQL_DIFFER.format('bp', 'xp')}""",
    "p1_differences": f"""WITH {_COPIES}
        SELECT symbol, strftime(d, '%Y-%m-%d') AS date, 'only_left' AS kind, NULL::VARCHAR AS field, NULL::DOUBLE AS bars_value, NULL::DOUBLE AS xdxr_value, 1::BIGINT AS n FROM m WHERE nox
        UNION ALL SELECT symbol, strftime(d, '%Y-%m-%d'), 'only_right', NULL, NULL, NULL, 1 FROM m WHERE nob
        UNION ALL SELECT symbol, strftime(d, '%Y-%m-%d'), 'value', 'adj_factor', bf, xf, 1 FROM m WHERE NOT nob AND NOT nox AND {SQL_DIFFER.format('bf', 'xf')}
        UNION ALL SELECT symbol, strftime(d, '%Y-%m-%d'), 'value', 'pre_close', bp, xp, 1 FROM m WHERE NOT nob AND NOT nox AND {SQL_DIFFER.format('bp', 'xp')}""",
    "p1_crowded": f"""WITH l AS (SELECT symbol, strftime(date, '%Y-%m') AS month, round({SQL_VALUE.format('adj_factor')}, 4) AS f, 1 AS l, 0 AS r FROM daily_bars
        UNION ALL SELECT {SQL_SYMBOL.format('symbol')}, strftime(date, '%Y-%m'), round({SQL_VALUE.format('adj_factor')}, 4), 0, 1 FROM factor_xdxr),
        c AS (SELECT symbol, month, f, sum(l) AS l, sum(r) AS r FROM l GROUP BY ALL),
        k AS (SELECT symbol, month, sum(l)::BIGINT AS nl, sum(r)::BIGINT AS nr, sum(greatest(l - r, 0))::BIGINT AS a, sum(greatest(r - l, 0))::BIGINT AS b FROM c GROUP BY ALL)
        SELECT symbol, month, 'only_left' AS kind, nl AS n FROM k WHERE nr = 0 UNION ALL SELECT symbol, month, 'only_right', nr FROM k WHERE nl = 0
        UNION ALL SELECT symbol, month, 'value', least(a, b) FROM k WHERE nl > 0 AND nr > 0 AND least(a, b) > 0
        UNION ALL SELECT symbol, month, 'surplus_left', a - b FROM k WHERE nl > 0 AND nr > 0 AND a > b UNION ALL SELECT symbol, month, 'surplus_right', b - a FROM k WHERE nl > 0 AND nr > 0 AND b > a""",
    "p2_found": f"WITH {_sql_units()} SELECT delivery_id, field, power FROM p WHERE power <> 0",
    "p2_values": f"WITH {_sql_units()} SELECT s.delivery_id, s.source, " + ", ".join(f"round(max(p.n * pow(10.0, p.power)) FILTER (field = '{f}'), 6) AS {f}" for f in FIGURES) + ", concat_ws(',', " + ", ".join(f"max(CASE WHEN p.inferred AND field = '{f}' THEN field END)" for f in FIGURES) + ") AS inferred FROM source_bars s LEFT JOIN p USING (delivery_id) GROUP BY 1, 2",
    "p3_found": f"""WITH {_GRID}
        SELECT g.symbol, strftime(g.d, '%Y-%m-%d') AS date FROM grid g ANTI JOIN bars b ON g.symbol = b.symbol AND g.d = b.d""",
    "p3_grid": f"""WITH {_GRID},
        u AS (SELECT coalesce(g.symbol, b.symbol) AS symbol, coalesce(g.d, b.d) AS d, g.d IS NOT NULL AS on_grid, b.d AS read, b.v.close AS close, b.v.adj_factor AS adj_factor, b.v.volume AS volume FROM grid g FULL JOIN bars b ON g.symbol = b.symbol AND g.d = b.d),
        w AS (SELECT *, last_value(close IGNORE NULLS) OVER w AS close_filled, last_value(adj_factor IGNORE NULLS) OVER w AS adj_factor_filled, last_value(volume IGNORE NULLS) OVER w AS volume_filled, last_value(read IGNORE NULLS) OVER w AS seen
              FROM u WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS UNBOUNDED PRECEDING))
        SELECT symbol, strftime(d, '%Y-%m-%d') AS date, read IS NULL AS is_missing, close, adj_factor, volume, close_filled, adj_factor_filled, volume_filled, (d - seen)::INT AS days_since FROM w WHERE on_grid""",
    "p3_hours": f"""WITH r AS (SELECT event_type, date_trunc('hour', ts) AS h, arg_max({SQL_VALUE.format('value')}, ts) AS value FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
        g AS (SELECT event_type, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS h FROM (SELECT event_type, min(h) AS a, max(h) AS z FROM r GROUP BY 1)),
        u AS (SELECT g.event_type, g.h, r.h AS read, r.value FROM g LEFT JOIN r ON r.event_type = g.event_type AND r.h = g.h)
        SELECT event_type, strftime(h, '%Y-%m-%d %H:%M') AS hour, read IS NULL AS is_missing, value, last_value(value IGNORE NULLS) OVER w AS value_filled, date_diff('hour', last_value(read IGNORE NULLS) OVER w, h)::INT AS steps_since
        FROM u WINDOW w AS (PARTITION BY event_type ORDER BY h ROWS UNBOUNDED PRECEDING)""",
    "p4_found": f"WITH {_KNOWN} SELECT signal_id, report_id FROM k WHERE rn = 1 AND report_id IS NOT NULL",
    "p4_signals": f"WITH {_KNOWN} SELECT signal_id, symbol, strategy, side, report_id, strftime(period, '%Y-%m-%d') AS period, strftime(ann_date, '%Y-%m-%d') AS ann_date, roe FROM k WHERE rn = 1",
    "p6_found": f"WITH {_SNAPS} SELECT t.snapshot_tag, symbol, strftime(date, '%Y-%m-%d') AS date, change_kind FROM m JOIN tags t USING (k) WHERE change_kind IS NOT NULL",
    "p6_changes": f"WITH {_SNAPS} SELECT t.snapshot_tag, symbol, strftime(date, '%Y-%m-%d') AS date, change_kind, changed_fields FROM m JOIN tags t USING (k) WHERE change_kind IS NOT NULL",
}

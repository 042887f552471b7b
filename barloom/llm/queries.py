"""Queries of the text problems and of best representatives, whole tables, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.functions import clean
from barloom.llm.canonical import canonical_documents, lookalike_classes, lookalike_pairs
from barloom.llm.mixing import mix_documents
from barloom.llm.packing import pack_documents
from barloom.llm.survivors import Bundle, Dependency, survivors
from barloom.plans.problems import SQL_PERIOD, SQL_DAY, SQL_SYMBOL, SQL_VALUE, reports, table

#: Tokens of a sequence.
CAPACITY = 2048


def versions(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "bar_versions").select("version_id", clean.canon_symbol("symbol").alias("symbol"), F.col("date").cast("date").alias("day"), "source", "updated_at", *[clean.present(c).alias(c) for c in ("close", "pre_close", "adj_factor", "turnover_rate", "amount")])
    trust = table(spark, sf, "feeds").groupBy(F.col("source").alias("__feed")).agg(F.min("trust").alias("trust"))
    return v.join(trust, F.col("source") == F.col("__feed"), "left").withColumn("trusted", F.coalesce(-F.col("trust"), F.lit(-(2**31))))


TRUST = ("trusted", "updated_at")


def _rows(found: DataFrame, name: str, fields: list[str]) -> DataFrame:
    each = F.array(*[F.when(F.col(f"{f}_row").isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f"{f}_row").alias("row_id"))) for f in fields])
    return found.select(F.lit(name).alias("table_name"), F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("table_name", "x.field", "x.row_id")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    bars = survivors(versions(spark, sf), ["symbol", "day"], "version_id", [Bundle(f, (f,), f"{f} > 0", TRUST) for f in ("pre_close", "adj_factor")], least_rows=2)
    usable = "ann_date > period"
    said = survivors(reports(spark, sf), ["code", "period"], "report_id", [Bundle("ann_date", ("ann_date",), usable, ("ann_date",)), Bundle("roe", ("roe",), f"{usable} and roe is not null", ("ann_date",))], least_rows=2)
    return _rows(bars, "bar_versions", ["pre_close", "adj_factor"]).unionByName(_rows(said, "yjbb", ["ann_date", "roe"]))


def p7_records(spark: SparkSession, sf: str) -> DataFrame:
    """One whole bar per (symbol, day). Figures of the trading day come from one row; what comes from the same source comes from the same delivery of it."""
    bundles = [
        Bundle("figures", ("close", "amount", "turnover_rate"), "close > 0 and amount > 0", TRUST),
        Bundle("basis", ("pre_close",), "pre_close > 0", TRUST),
        Bundle("factor", ("adj_factor",), "adj_factor > 0", TRUST),
    ]
    return survivors(versions(spark, sf), ["symbol", "day"], "version_id", bundles, [Dependency("source", "updated_at")]).withColumn("day", clean.day_text("day"))


def p8_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents"), CAPACITY)


def p8_use(spark: SparkSession, sf: str) -> DataFrame:
    """How full the sequences are: sequences by twentieths of the capacity used."""
    bins = p8_packing(spark, sf).groupBy("bin_id").agg(F.sum("units").alias("units"), F.count(F.lit(1)).alias("pieces"))
    twentieth = F.ceil(F.col("units") * 20 / CAPACITY).cast("int").alias("twentieths_used")
    return bins.groupBy(twentieth).agg(F.count(F.lit(1)).alias("sequences"), F.sum("units").alias("tokens"), F.sum("pieces").alias("pieces"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix_documents(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mix_documents(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike_pairs(lookalike_classes(table(spark, sf, "documents")))


def p10_classes(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike_classes(table(spark, sf, "documents"))


def p10_canonical(spark: SparkSession, sf: str) -> DataFrame:
    docs = canonical_documents(table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "canonical_text", (F.col("canonical_text") != F.col("text")).alias("was_changed"))


QUERIES = {f.__name__: f for f in (p7_found, p7_records, p8_packing, p8_use, p9_mix, p9_shares, p10_found, p10_classes, p10_canonical)}

_VERSIONS = f"""v AS (SELECT version_id, {SQL_SYMBOL.format('symbol')} AS symbol, date::DATE AS d, source, coalesce(-trust, -2147483648) AS t, updated_at, {SQL_VALUE.format('pre_close')} AS pre_close, {SQL_VALUE.format('adj_factor')} AS adj_factor
    FROM bar_versions LEFT JOIN (SELECT source, min(trust) AS trust FROM feeds GROUP BY 1) USING (source)),
    g AS (SELECT symbol, d FROM v GROUP BY ALL HAVING count(*) > 1),
    y AS (SELECT report_id, lpad(trim(code), 6, '0') AS code, {SQL_PERIOD.format('period')} AS period, {SQL_DAY.format('ann_date')} AS a, {SQL_VALUE.format('roe')} AS roe FROM yjbb),
    h AS (SELECT code, period FROM y GROUP BY ALL HAVING count(*) > 1)"""

SQL = {
    "p7_found": f"""WITH {_VERSIONS}
        SELECT 'bar_versions' AS table_name, 'pre_close' AS field, arg_max(version_id, (t, updated_at, version_id)) AS row_id FROM v JOIN g USING (symbol, d) WHERE pre_close > 0 GROUP BY symbol, d
        UNION ALL SELECT 'bar_versions', 'adj_factor', arg_max(version_id, (t, updated_at, version_id)) FROM v JOIN g USING (symbol, d) WHERE adj_factor > 0 GROUP BY symbol, d
        UNION ALL SELECT 'yjbb', 'ann_date', arg_max(report_id, (a, report_id)) FROM y JOIN h USING (code, period) WHERE a > period GROUP BY code, period
        UNION ALL SELECT 'yjbb', 'roe', arg_max(report_id, (a, report_id)) FROM y JOIN h USING (code, period) WHERE a > period AND roe IS NOT NULL GROUP BY code, period""",
    "p7_records": f"""WITH v AS (SELECT version_id, {SQL_SYMBOL.format('symbol')} AS symbol, date::DATE AS d, source, coalesce(-trust, -2147483648) AS t, updated_at, {', '.join(SQL_VALUE.format(c) + ' AS ' + c for c in ('close', 'pre_close', 'adj_factor', 'turnover_rate', 'amount'))}
            FROM bar_versions LEFT JOIN (SELECT source, min(trust) AS trust FROM feeds GROUP BY 1) USING (source)),
        g AS (SELECT symbol, d, count(*) AS n_rows FROM v WHERE symbol IS NOT NULL AND d IS NOT NULL GROUP BY ALL),
        c AS (SELECT b, symbol, d, source, updated_at, version_id, t FROM v, (VALUES (1), (2), (3)) x(b)
            WHERE CASE b WHEN 1 THEN close > 0 AND amount > 0 WHEN 2 THEN pre_close > 0 ELSE adj_factor > 0 END),
        e AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY b, symbol, d, source, updated_at ORDER BY t DESC NULLS LAST, version_id DESC) = 1),
        o AS (SELECT b, symbol, d, source, updated_at, version_id, row_number() OVER (PARTITION BY b, symbol, d ORDER BY t DESC NULLS LAST, updated_at DESC NULLS LAST, version_id DESC) - 1 AS place FROM e),
        n AS (SELECT symbol, d, count(*) AS n FROM o GROUP BY ALL),
        a AS (SELECT * FROM o UNION ALL SELECT x.b, g.symbol, g.d, NULL, NULL, NULL, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.b = x.b AND o.symbol = g.symbol AND o.d = g.d) THEN n.n ELSE 0 END FROM g LEFT JOIN n USING (symbol, d), (VALUES (1), (2), (3)) x(b)),
        m AS (SELECT symbol, d, x.version_id AS i, y.version_id AS j, z.version_id AS k, row_number() OVER (PARTITION BY symbol, d ORDER BY x.place + y.place + z.place, x.place, y.place, z.place) AS rn
            FROM a x JOIN a y USING (symbol, d) JOIN a z USING (symbol, d) WHERE x.b = 1 AND y.b = 2 AND z.b = 3
            AND {' AND '.join(f"NOT coalesce({p}.source = {q}.source AND {p}.updated_at IS DISTINCT FROM {q}.updated_at, false)" for p, q in (('x', 'y'), ('x', 'z'), ('y', 'z')))})
        SELECT m.symbol, strftime(m.d, '%Y-%m-%d') AS day, g.n_rows, x.close, x.amount, x.turnover_rate, i AS figures_row, y.pre_close, j AS basis_row, z.adj_factor, k AS factor_row
        FROM m JOIN g USING (symbol, d) LEFT JOIN v x ON x.version_id = i LEFT JOIN v y ON y.version_id = j LEFT JOIN v z ON z.version_id = k WHERE rn = 1""",
}

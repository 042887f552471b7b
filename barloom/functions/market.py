"""Market rules as Column expressions: symbols, price limits, rounding, costs, contracts, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Exchanges by kind.
STOCK_EXCHANGES = ("SH", "SZ", "BJ")
FUTURES_EXCHANGES = ("SHFE", "DCE", "CZCE", "CFE", "INE", "GFEX")
OVERSEAS_EXCHANGES = ("NYSE", "NASDAQ", "AMEX", "HKEX", "TSE", "LSE")

# Funds that may be sold on the day they were bought.
SAME_DAY_SH_PREFIXES = ("511", "513", "518")
SAME_DAY_SZ_CODES = ("159920", "159941", "159934", "159937", "159942", "159980", "159985", "159981")

# Costs of a stock fill and of a futures fill.
COMMISSION, LEAST_COMMISSION, STAMP, TRANSFER, SLIPPAGE_BPS = 2.5e-4, 5.0, 5e-4, 1e-5, 2.0
FUTURES_OPEN, FUTURES_CLOSE, FUTURES_CLOSE_TODAY, FUTURES_SLIPPAGE_BPS = 1e-4, 1e-4, 5e-4, 1.0

# Product, multiplier, margin, fees for open, close and close-today, daily limit.
CONTRACTS = [
    ("RB", 10.0, 0.13, 1e-4, 1e-4, 5e-4, 0.07), ("HC", 10.0, 0.13, 1e-4, 1e-4, 5e-4, 0.07), ("I", 100.0, 0.15, 1e-4, 1e-4, 5e-4, 0.08),
    ("J", 60.0, 0.20, 1.2e-4, 1.2e-4, 6e-4, 0.08), ("JM", 60.0, 0.20, 1.2e-4, 1.2e-4, 6e-4, 0.08),
    ("M", 10.0, 0.08, 1.5e-4, 1.5e-4, 3e-4, 0.07), ("Y", 10.0, 0.08, 1.5e-4, 1.5e-4, 3e-4, 0.07),
    ("TA", 5.0, 0.08, 3e-4, 3e-4, 6e-4, 0.06), ("MA", 10.0, 0.09, 3e-4, 3e-4, 6e-4, 0.07), ("SR", 10.0, 0.07, 3e-4, 3e-4, 6e-4, 0.06),
    ("CU", 5.0, 0.10, 5e-5, 5e-5, 5e-5, 0.08), ("AU", 1000.0, 0.09, 5e-5, 5e-5, 1.5e-4, 0.08), ("AG", 15.0, 0.10, 5e-5, 5e-5, 1.5e-4, 0.09),
    ("IF", 300.0, 0.12, 2.3e-5, 2.3e-5, 3.45e-4, 0.10), ("IH", 300.0, 0.12, 2.3e-5, 2.3e-5, 3.45e-4, 0.10),
    ("IC", 200.0, 0.12, 2.3e-5, 2.3e-5, 3.45e-4, 0.10), ("IM", 200.0, 0.12, 2.3e-5, 2.3e-5, 3.45e-4, 0.10),
]
OTHER_CONTRACT = (10.0, 0.12, 1e-4, 1e-4, 5e-4, 0.10)
CONTRACT_FIELDS = ("multiplier", "margin", "fee_open", "fee_close", "fee_close_today", "price_limit")


def code_of(symbol: Column) -> Column:
    return F.substring_index(symbol, ".", 1)


def exchange_of(symbol: Column) -> Column:
    return F.substring_index(symbol, ".", -1)


def is_valid_symbol(symbol: Column) -> Column:
    """Exactly one dot, a known exchange, and a code of the form that exchange uses."""
    s = F.upper(F.trim(symbol))
    code, place = code_of(s), exchange_of(s)
    form = F.when(place.isin(*FUTURES_EXCHANGES), code.rlike(r"^([A-Z]{1,2}\d{3,4}|[A-Z]+)$")).when(place.isin(*OVERSEAS_EXCHANGES), code.rlike(r"^[A-Z0-9]{1,6}$")).when(place.isin(*STOCK_EXCHANGES), code.rlike(r"^\d{6}$"))
    return F.coalesce((F.length(s) - F.length(F.replace(s, F.lit("."))) == 1) & form, F.lit(False))


def asset_type(symbol: Column) -> Column:
    code, place = code_of(symbol), exchange_of(symbol)
    two, three = F.substring(code, 1, 2), F.substring(code, 1, 3)
    return (
        F.when(place.isin(*FUTURES_EXCHANGES), F.when(code.rlike("^[A-Z]+$"), "futures_continuous").otherwise("futures"))
        .when(place == "SH", F.when(two.isin("50", "51", "56", "58"), "etf").when(two.isin("60", "68"), "stock").otherwise("index"))
        .when(place == "SZ", F.when(three == "399", "index").when(two.isin("15", "16", "18"), "etf").otherwise("stock"))
        .when(place == "BJ", F.when(three == "899", "index").otherwise("stock"))
        .when(place.isin(*OVERSEAS_EXCHANGES), "stock")
    )


def is_same_day(symbol: Column) -> Column:
    """Whether what was bought may be sold on the same day."""
    kind, code, place = asset_type(symbol), code_of(symbol), exchange_of(symbol)
    fund = (kind == "etf") & (((place == "SH") & F.substring(code, 1, 3).isin(*SAME_DAY_SH_PREFIXES)) | code.isin(*SAME_DAY_SZ_CODES))
    return F.coalesce(place.isin(*FUTURES_EXCHANGES) | fund, F.lit(False))


def limit_ratio(symbol: Column) -> Column:
    """Daily price limit of the board a stock is listed on."""
    code, place = code_of(symbol), exchange_of(symbol)
    head = F.substring(code, 1, 3)
    return F.when(place == "BJ", 0.30).when((place == "SH") & head.isin("688", "689"), 0.20).when((place == "SZ") & head.isin("300", "301"), 0.20).otherwise(0.10)


def round_cents(x: Column) -> Column:
    """Half up to cents."""
    return F.floor(x * 100 + 0.5) / 100


def limit_up(before: Column, ratio: Column) -> Column:
    return round_cents(before * (1 + ratio))


def limit_down(before: Column, ratio: Column) -> Column:
    return round_cents(before * (1 - ratio))


def slipped(price: Column, side: Column, bps: float = SLIPPAGE_BPS) -> Column:
    return price * F.when(side == "buy", 1 + bps / 1e4).otherwise(1 - bps / 1e4)


def stock_fees(value: Column, side: Column) -> Column:
    """Commission with its minimum, stamp duty on sales, transfer fee; nothing on nothing."""
    fee = F.greatest(value * COMMISSION, F.lit(LEAST_COMMISSION)) + F.when(side == "sell", value * STAMP).otherwise(0.0) + value * TRANSFER
    return F.when(value > 0, fee).otherwise(0.0)


def futures_fees(opened: Column, closed: Column, closed_today: Column, rates: tuple[float, float, float] = (FUTURES_OPEN, FUTURES_CLOSE, FUTURES_CLOSE_TODAY)) -> Column:
    """By value: opening, closing of earlier days, closing of today's."""
    zero = F.lit(0.0)
    return opened * rates[0] + F.greatest(closed - closed_today, zero) * rates[1] + F.least(F.greatest(closed_today, zero), closed) * rates[2]


def contracts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONTRACTS, "product string, " + ", ".join(f"{f} double" for f in CONTRACT_FIELDS))


def product_of(symbol: Column) -> Column:
    return F.regexp_extract(F.upper(code_of(symbol)), r"^([A-Z]+)", 1)


def with_contract(df: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Contract fields of each symbol's product, the general ones for unknown products."""
    specs = contracts(df.sparkSession).withColumnRenamed("product", "__product")
    joined = df.join(specs, product_of(F.col(symbol)) == F.col("__product"), "left")
    return joined.select(*df.columns, *[F.coalesce(f, F.lit(v)).alias(f) for f, v in zip(CONTRACT_FIELDS, OTHER_CONTRACT)])


def contract_expiry(symbol: Column) -> Column:
    """The 15th of the delivery month, or its third Friday on the financial exchange; NULL for continuous contracts and impossible months."""
    digits = F.regexp_extract(code_of(symbol), r"(\d+)$", 1)
    long = F.length(digits) == 4
    year = F.when(long, F.lit(2000) + F.substring(digits, 1, 2).try_cast("int")).otherwise(F.lit(2020) + F.substring(digits, 1, 1).try_cast("int"))
    month = F.when(long, F.substring(digits, 3, 2).try_cast("int")).otherwise(F.substring(digits, 2, 2).try_cast("int"))
    first = F.when((digits != "") & month.between(1, 12), F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lit("01")).try_cast("date"))
    friday = F.date_add(F.next_day(F.date_sub(first, 1), "FRI"), 14)
    return F.when(exchange_of(symbol) == "CFE", friday).otherwise(F.date_add(first, 14))


def in_session(ts: Column) -> Column:
    """Weekdays 09:15 to 11:30 and 13:00 to 15:05."""
    clock = F.date_format(ts, "HH:mm:ss")
    return (F.weekday(ts) < 5) & (clock.between("09:15:00", "11:30:00") | clock.between("13:00:00", "15:05:00"))

"""Column builders that bring raw keys, days, numbers and missing marks to one form. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Full-width digits and signs, and the plain characters they stand for.
WIDE = "０１２３４５６７８９－／．，＋　：％"
PLAIN = "0123456789-/.,+ :%"

#: Exchanges a raw symbol may name.
EXCHANGES = ("SH", "SZ", "BJ")

#: Names of report periods and the month and day they end on.
PERIOD_ENDS = {"一季报": "03-31", "中报": "06-30", "半年报": "06-30", "三季报": "09-30", "年报": "12-31"}

#: Relative tolerance under which two values are the same.
TOLERANCE = 1e-5


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(name: str) -> Column:
    """A column by its exact name, even with dots or backticks in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(c: Column | str) -> Column:
    """NaN becomes NULL."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def narrow(c: Column | str) -> Column:
    """Full-width digits, signs and blanks become plain ones."""
    return F.translate(col(c), WIDE, PLAIN)


def day_text(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def canon_symbol(c: Column | str) -> Column:
    """CODE.EXCHANGE from raw spellings such as ' sh.600000', '600000Sz' or 'BJ430001'.

    NULL stays NULL; a text without a six-digit code and a known exchange is trimmed and upper-cased.
    """
    bare = F.upper(F.regexp_replace(narrow(c), r"[\s ]+", ""))
    code = F.regexp_extract(bare, r"(\d{6})", 1)
    place = F.regexp_extract(bare, "(" + "|".join(EXCHANGES) + ")", 1)
    spelled = F.when((code != "") & (place != ""), F.concat(code, F.lit("."), place)).otherwise(bare)
    return F.when(col(c).rlike(r"^\d{6}\.(?:" + "|".join(EXCHANGES) + r")\z"), col(c)).otherwise(spelled)


def canon_code(c: Column | str) -> Column:
    """Six digits, restoring leading zeros that were stripped; NULL if there are no digits."""
    digits = F.regexp_extract(narrow(c), r"(\d+)", 1)
    return F.when(digits != "", F.lpad(digits, 6, "0"))


def parse_day(c: Column | str) -> Column:
    """A date from 2024-04-18, 2024/4/8, 2024年4月8日, 20240418, '18 Apr 2024', each with or without a time after it; else NULL."""
    s = F.trim(narrow(c))
    numeric = F.regexp_replace(s, r"^(\d{4})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})(?:日)?(?:[T ].*)?$", "$1-$2-$3")
    packed = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    months = F.array(*[F.lit(m) for m in ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")])
    named = r"^(\d{1,2})[ -]([A-Za-z]{3})[a-z]*\.?[ -,]+(\d{4})$"
    month = F.array_position(months, F.lower(F.regexp_extract(s, named, 2)))
    worded = F.when(month > 0, F.concat_ws("-", F.regexp_extract(s, named, 3), month.cast("string"), F.regexp_extract(s, named, 1)))
    chosen = F.when(s.rlike(r"^\d{8}$"), packed).when(s.rlike(r"^\d{4}\s*[-/.年]"), numeric).otherwise(worded)
    return F.when(chosen.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), chosen.try_cast("date"))


def parse_period(c: Column | str) -> Column:
    """The last day of a fiscal quarter from 20190331, 2019-03-31, 2019Q1 or a named report such as 2019年报; else NULL."""
    s = F.trim(narrow(c))
    quarter = F.regexp_extract(s, r"^(\d{4})\s*[Qq]([1-4])$", 2)
    year = F.regexp_extract(s, r"^(\d{4})", 1)
    ends = F.when(quarter == "1", "03-31").when(quarter == "2", "06-30").when(quarter == "3", "09-30").when(quarter == "4", "12-31")
    for word, end in PERIOD_ENDS.items():
        ends = ends.when(s.endswith(word), end)
    return F.coalesce(parse_day(s), F.concat(F.when(year != "", year), F.lit("-"), ends).try_cast("date"))


def differ(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """TRUE if just one value is missing or they are further apart than the relative tolerance; never NULL."""
    apart = F.abs(a - b) > F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b))
    return F.when(a.isNull() | b.isNull(), a.isNull() != b.isNull()).otherwise(apart)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(a, b)

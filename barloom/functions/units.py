"""Numbers with units in text: reading them and the powers of ten that bring them to the common unit."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from barloom.functions.clean import PLAIN, WIDE, col

#: Words for a multiple (lower case, without blanks) and its power of ten. The first kind may stand before the second.
COUNTS = {"十": 1, "百": 2, "千": 3, "10": 1, "100": 2, "1000": 3, "ten": 1, "hundred": 2}
MULTIPLES = {"千": 3, "万": 4, "萬": 4, "亿": 8, "億": 8, "k": 3, "w": 4, "mn": 6, "bn": 9, "thousand": 3, "million": 6, "billion": 9}
MULTIPLIERS = COUNTS | MULTIPLES | {a + b: x + y for a, x in COUNTS.items() for b, y in MULTIPLES.items() if a != b}

#: Units (lower case, without blanks) and the power of ten to lots of 100 shares, yuan and percent.
BASES: dict[str, dict[str, int]] = {
    "volume": {"手": 0, "lot": 0, "lots": 0, "股": -2, "share": -2, "shares": -2, "shs": -2},
    "amount": {"元": 0, "yuan": 0, "cny": 0, "rmb": 0},
    "turnover_rate": {"%": 0, "pct": 0, "percent": 0, "‰": -1, "permille": -1, "bp": -2, "bps": -2, "fraction": 2, "ratio": 2},
}
#: Fields whose unit takes a multiple before it, and those where a multiple alone is enough.
MULTIPLIED, BARE = {"volume", "amount"}, {"amount"}

#: Powers among which an unstated unit is sought.
CONVERSIONS: dict[str, tuple[int, ...]] = {"volume": (-2, 0, 1, 2, 3, 4, 6), "amount": (0, 3, 4, 6, 7, 8), "turnover_rate": (-2, -1, 0, 2)}

#: A number as texts begin with it, blanks aside.
NUMBER = re.compile(r"[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?")
BLANKS = " \t\u00a0"
_NARROW = str.maketrans(WIDE, PLAIN)
_UNITS = {f: re.compile(f"(.*?)({'|'.join(sorted(b, key=len, reverse=True))}){'?' if f in BARE else ''}", re.S) for f, b in BASES.items()}


@functools.lru_cache(maxsize=1 << 14)
def power_of(field: str, unit: str) -> int | None:
    """The power of a unit text, that of its multiple included; None if the text is empty or unknown."""
    text = "".join(unit.translate(_NARROW).split()).lower()
    found = _UNITS[field].fullmatch(text) if text else None
    if not found:
        return None
    multiple, base = found[1], BASES[field][found[2]] if found[2] else 0
    if not multiple:
        return base
    return base + MULTIPLIERS[multiple] if field in MULTIPLIED and multiple in MULTIPLIERS else None


def split_number(raw: str) -> tuple[float | None, str]:
    """The number a text begins with (None if unreadable), and the text behind it ('' if none)."""
    text = (raw if raw.isascii() else raw.translate(_NARROW)).strip(BLANKS)
    found = NUMBER.match(text)
    if not found:
        return None, text
    return float(found[0].replace(",", "")), text[found.end():].strip(BLANKS)


def unit_power(field: str, unit: Column | str) -> Column:
    """The power of a unit text, that of its multiple included; NULL if the text is missing or unknown."""

    @F.pandas_udf("int")
    def run(units: pd.Series) -> pd.Series:
        return pd.Series([None if u is None else power_of(field, u) for u in units], dtype="Int32")

    return run(col(unit))


def plain_number(raw: Column | str) -> Column:
    """The value of a text that is nothing but a number in plain notation; NULL for others, which split_number may still read."""
    raw = col(raw)
    # a last character that is no digit would be a mark of type or a word for not a number; hexadecimal forms have an x
    return F.when(F.substring(raw, -1, 1).between("0", "9") & (F.instr(raw, "x") == 0) & (F.instr(raw, "X") == 0), raw.try_cast("double"))


def read_figure(field: str, raw: Column | str, unit: Column | str) -> Column:
    """Struct of ``n`` (the number a text begins with), ``readable`` (there is one, and nothing but a known unit behind it) and ``p`` (the power
    of the unit beside the number, or else of ``unit``; NULL if neither is given or known). A null text has the power of ``unit`` alone."""

    @F.pandas_udf("n double, readable boolean, p int")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for raws, units in parts:
            n, ok = np.full(len(raws), np.nan), np.zeros(len(raws), dtype=bool)
            p = np.full(len(raws), np.nan)
            raw, given = raws.to_numpy(dtype=object), units.to_numpy(dtype=object)
            for i in np.flatnonzero(units.notna().to_numpy()):
                power = power_of(field, given[i])
                p[i] = np.nan if power is None else power
            for i in np.flatnonzero(raws.notna().to_numpy()):
                number, beside = split_number(raw[i])
                power = power_of(field, beside) if beside else None
                if number is not None and (not beside or power is not None):
                    n[i], ok[i] = number, True
                    p[i] = p[i] if power is None else power
            yield pd.DataFrame({"n": pd.array(np.where(ok, n, np.nan), dtype="Float64"), "readable": ok, "p": pd.array(p, dtype="Int32")})

    return run(col(raw), col(unit))

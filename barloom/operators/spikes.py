"""Implausible readings: short excursions, frozen values, broken relations, impossible values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window

from barloom.functions.clean import quoted
from barloom.session import stage_table

#: Priced rows of a source in a block, and priced rows a block sees of its neighbours.
BLOCK, HALO = 2048, 8
#: Days in the shards that give each row its place among its source's rows.
SHARD_DAYS = 364
#: A reading is an excursion for at most so many rows; then the path resumes.
LONGEST = 3
#: A frozen value repeats at least so often.
STUCK_RUN = 5
#: Share of a source's residuals above the threshold of its tail, and the risk per reading at which the cutoff is set.
TAIL, RISK = 0.20, 1e-6
#: The path resumes if the values around an excursion differ by no more than this share of it.
RESUMES = 0.6
#: Bins of the residual histograms per factor of two.
PER_OCTAVE = 16
#: Exceedances that a tail of two parameters needs at least; with fewer a source has the tail of all, and all together have none.
FEWEST = 4
#: A tail as heavy as this has no mean; heavier ones are not fitted.
HEAVIEST = 1.0


def _placed(rows: DataFrame, values: list[str], counted: str, before: dict[str, Column], after: dict[str, Column]) -> DataFrame:
    """Deduplicated rows with ``__ord``, the place among the source's rows where ``counted`` is present, and with the last present value of
    each ``before`` up to the row and the first one of each ``after`` from the row on, without gathering a source.

    Shards are counted, counts and end values are scanned over the shards of a source, and every shard numbers its own rows. A row whose
    ``counted`` is missing has the place of the one before it.
    """
    # repeats are reduced before anything is brought together by shard: a shard then has no more rows than days
    rows = rows.groupBy("__src", "__shard", "__day").agg(F.max(F.struct("__ver", *values)).alias("__b")).select("__src", "__shard", "__day", *[F.col(f"__b.{v}").alias(v) for v in values])
    line = Window.partitionBy("__src").orderBy("__shard")
    past, future = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
    ends = rows.groupBy("__src", "__shard").agg(
        F.count(counted).alias("__n"),
        *[F.max_by(c, F.when(c.isNotNull(), F.col("__day"))).alias(f"__last_{k}") for k, c in before.items()],
        *[F.min_by(c, F.when(c.isNotNull(), F.col("__day"))).alias(f"__first_{k}") for k, c in after.items()],
    )
    starts = ends.select(
        F.col("__src").alias("__s"), F.col("__shard").alias("__sh"), F.coalesce(F.sum("__n").over(past), F.lit(0)).alias("__before"),
        *[F.last(f"__last_{k}", ignorenulls=True).over(past).alias(f"__in_{k}") for k in before],
        *[F.first(f"__first_{k}", ignorenulls=True).over(future).alias(f"__in_{k}") for k in after],
    )
    own = Window.partitionBy("__src", "__shard").orderBy("__day")
    upto, onward = own.rowsBetween(Window.unboundedPreceding, Window.currentRow), own.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    numbered = rows.select(
        "*", F.count(counted).over(upto).alias("__rn"),
        *[F.last(c, ignorenulls=True).over(upto).alias(f"__fill_{k}") for k, c in before.items()],
        *[F.first(c, ignorenulls=True).over(onward).alias(f"__fill_{k}") for k, c in after.items()],
    )
    met = numbered.join(starts, (F.col("__src") == F.col("__s")) & (F.col("__shard") == F.col("__sh")))
    place = F.greatest(F.col("__rn") + F.col("__before") - 1, F.lit(0))
    return met.select("__src", "__day", *values, place.alias("__ord"), *[F.coalesce(f"__fill_{k}", f"__in_{k}").alias(k) for k in [*before, *after]])


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows copied into their own block and, near its ends, into the neighbour's, so that windows of a block see past its ends.

    Places count priced rows, so HALO of these are seen however many rows without a price lie between.
    """
    block, at = F.floor(F.col("__ord") / BLOCK), F.pmod(F.col("__ord"), F.lit(BLOCK))
    near = F.when((at < HALO) & (block > 0), F.array(block, block - 1)).when(at >= BLOCK - HALO, F.array(block, block + 1)).otherwise(F.array(block))
    return rows.select("*", block.alias("__home"), F.explode(near).alias("__block"))


def neighbours(values: list[str], partition: str = "__src, __block", order: str = "__day") -> list[Column]:
    """The LONGEST present values before (``<value>_b1``, ...) and after (``<value>_a1``, ...) each row."""
    return [
        F.expr(f"{how}({v}, {k}) ignore nulls over (partition by {partition} order by {order})").alias(f"{v}_{mark}{k}")
        for v in values for how, mark in (("lag", "b"), ("lead", "a")) for k in range(1, LONGEST + 1)
    ]


def excursion(value: str, raw: str, center: str) -> Column:
    """How far ``center`` is from the path of the (log) ``value`` on both sides of it, where the path resumes after at most LONGEST rows; else 0.

    For each way in which the row may lie in a run, the last value before the run and the first after it give the path. The run counts if
    the row is on the same side of both and they are close to each other in comparison; and if the ``raw`` value moves too, as a wrong factor
    alone is no excursion of the price.
    """
    options = []
    for i in range(1, LONGEST + 1):
        for j in range(1, LONGEST + 2 - i):
            down, up = F.col(center) - F.col(f"{value}_b{i}"), F.col(center) - F.col(f"{value}_a{j}")
            least = F.least(F.abs(down), F.abs(up))
            moved = F.greatest(F.abs(F.col(raw) - F.col(f"{raw}_b{i}")), F.abs(F.col(raw) - F.col(f"{raw}_a{j}")))
            options.append(F.when((down * up > 0) & (F.abs(down - up) <= RESUMES * least) & (moved > 0.5 * least), least))
    return F.coalesce(F.greatest(*options), F.lit(0.0))


def generalized_pareto(excess: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(shape, scale) of the likeliest generalised Pareto law of excesses that occur n times each.

    For theta = shape / scale the likeliest shape is the mean of log(1 + theta x), so that only theta is searched. Shapes are held to
    (-1/2, HEAVIEST], where the likelihood is regular and the law has a mean.
    """
    total = n.sum()
    mean, most = (excess * n).sum() / total, excess.max()
    theta = np.concatenate([-np.geomspace(1e-3, 0.98, 24)[::-1] / most, np.geomspace(1e-3, 30.0, 24) / mean])
    shape = (np.log1p(theta[:, None] * excess[None, :]) * n).sum(axis=1) / total
    shape = np.where(np.abs(shape) < 1e-9, 1e-9, shape)
    good = np.where((shape > -0.5) & (shape <= HEAVIEST), -np.log(shape / theta) - shape - 1, -np.inf)
    k = int(np.argmax(good))
    return float(shape[k]), float(shape[k] / theta[k])


def median_excess(shape: float, scale: float) -> float:
    return scale * (2.0**shape - 1) / shape


def fit_tail(z: np.ndarray, n: np.ndarray, cutoff: float) -> tuple[int, float, float, float] | None:
    """(exceedances, threshold, median excess, shape) of the tail of ascending residuals that occur n times each, those beyond the cutoff aside."""
    normal = z <= cutoff
    z, n = z[normal], n[normal]
    upto = np.cumsum(n)
    if not len(z):
        return None
    at = int(np.searchsorted(upto, (1 - TAIL) * upto[-1]))
    over = n[at + 1:]
    if over.sum() < FEWEST or len(over) < 2 or z[at] <= 0:
        return None
    shape, scale = generalized_pareto(z[at + 1:] - z[at], over)
    return int(over.sum()), float(z[at]), median_excess(shape, scale), shape


def tail_quantile(threshold: float, median: float, shape: float) -> float:
    """The residual that a reading exceeds with probability RISK."""
    shape = shape if abs(shape) > 1e-6 else 1e-6
    return threshold + median / (2.0**shape - 1) * ((RISK / TAIL) ** -shape - 1)


def pooled_tail(z: np.ndarray, n: np.ndarray) -> tuple[int, float, float, float] | None:
    """The tail of the residuals of all sources, each in its own usual movements; None if there are too few.

    Excursions are among them. The search goes forward: the first cutoff is that of an exponential tail with the median excess, which a few
    excursions do not move; then residuals beyond the cutoff are left out and the tail is fitted by likelihood, until the cutoff stays.
    """
    upto = np.cumsum(n)
    at = int(np.searchsorted(upto, (1 - TAIL) * upto[-1])) if len(z) else 0
    over = n[at + 1:]
    if over.sum() < FEWEST or len(over) < 2:
        return None
    half = float(z[at + 1 + int(np.searchsorted(np.cumsum(over), over.sum() / 2))] - z[at])
    found = (int(over.sum()), float(z[at]), half, 0.0)
    cutoff = tail_quantile(*found[1:])
    for _ in range(20):
        fitted = fit_tail(z, n, cutoff)
        if fitted is None:
            return found
        found, before = fitted, cutoff
        cutoff = tail_quantile(*found[1:])
        if abs(cutoff - before) <= 1e-3 * before:
            break
    return found


def _middle(x: np.ndarray) -> float:
    """Median of ascending values with how often each occurs."""
    return float(x[int(np.searchsorted(np.cumsum(x[:, 1]), x[:, 1].sum() / 2)), 0])


def usual_and_seasons(moves: list[tuple[int, float, float]]) -> tuple[float, list[float], list[float], float, float] | None:
    """Of (weekday, times, sum of moves): the usual movement, per weekday the mean logarithm of moves against that of all and how many moves
    there were, and the squared deviations within weekdays with their degrees of freedom. None if nothing moves."""
    sizes = np.array(sorted((s / n, n) for _, n, s in moves)).reshape(-1, 2)
    moving = sizes[sizes[:, 0] > 0]
    if not len(moving):
        return None
    usual = 1.4826 * (_middle(sizes) or _middle(moving))
    some = [(w, n, np.log(s / n)) for w, n, s in moves if s > 0]
    day, n, x = (np.array(c) for c in zip(*some))
    count = np.bincount(day, n, 8)[1:]
    mean = np.bincount(day, n * x, 8)[1:] / np.maximum(count, 1)
    within = float((n * x * x).sum() - (count * mean * mean).sum())
    apart = np.where(count > 0, mean - (n * x).sum() / n.sum(), 0.0)
    return usual, apart.tolist(), count.tolist(), within, float(np.maximum(count - 1, 0).sum())


def tail_cutoffs(readings: DataFrame) -> DataFrame:
    """Per source (``__s``), its usual movement (``__usual``), the factor of each weekday (``__season``) and the cutoff of ``__e`` over that
    factor (``__cutoff``; null where there is no tail at all).

    Peaks over threshold on seasonal residuals: an excursion over the factor of its weekday is a residual. The residuals of a source above its own
    threshold, which TAIL of them exceed, have a generalised Pareto tail; its quantile at RISK is the cutoff. Residuals beyond the cutoff are
    no normal behaviour: the fit leaves out those beyond the pooled cutoff of all sources, and is then made again without those beyond
    its own. Histories are short or long: factors, threshold, median excess and shape of a source are drawn towards those of all as far as
    their sampling variance outweighs the variance between sources, which is estimated from all of them. So a long history has its own
    tail and a short one that of its like.

    A source is reduced to histograms of PER_OCTAVE bins per factor of two; only the histogram of all and a few variances are collected.
    """
    def binned(c: Column) -> Column:
        return F.when(c > 1e-9, F.floor(F.log2(c) * PER_OCTAVE).cast("int"))

    x = F.col("v.x")
    values = readings.select("__src", F.dayofweek("__day").alias("wd"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("__move").alias("x")), F.struct(F.lit(1).alias("kind"), F.col("__e").alias("x")))).alias("v")).where(x.isNotNull())
    bins = values.groupBy("__src", "wd", F.col("v.kind").alias("kind"), binned(x).alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.when(x > 1e-9, x).otherwise(0.0)).alias("s"))
    by_source = bins.groupBy("__src").agg(*[F.collect_list(F.when(F.col("kind") == k, F.struct("wd", "n", "s"))).alias(f"b{k}") for k in (0, 1)])

    def profile(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for src, moves, es in zip(pdf["__src"], pdf["b0"], pdf["b1"]):
                got = usual_and_seasons([(b["wd"], b["n"], b["s"]) for b in moves])
                if got and len(es):
                    out.append((src, *got, [b["wd"] for b in es], [b["s"] / b["n"] for b in es], [b["n"] for b in es]))
            yield pd.DataFrame(out, columns=["__s", "__usual", "apart", "times", "within", "free", "wd", "e", "n"])

    kind = readings.schema["__src"].dataType.simpleString()
    profiles = stage_table(by_source.mapInPandas(profile, f"__s {kind}, __usual double, apart array<double>, times array<double>, within double, free double, wd array<int>, e array<double>, n array<double>"), "tails")
    cell = F.arrays_zip("apart", "times")
    summed = {"d": lambda c: c.times * c.times * c.apart * c.apart, "t": lambda c: c.times, "tt": lambda c: c.times * c.times}
    spread = profiles.select("within", "free", *[F.aggregate(F.transform(cell, each), F.lit(0.0), lambda t, c: t + c).alias(k) for k, each in summed.items()])
    sums = spread.agg(*[F.sum(c).alias(c) for c in spread.columns]).first()
    inside = sums.within / sums.free if sums.free else 0.0
    between = max(0.0, (sums.d - inside * sums.t) / sums.tt) if sums.tt else 0.0
    # a factor counts as far as weekdays differ by more than chance
    season = F.transform(cell, lambda c: F.exp(c.apart * F.coalesce(F.try_divide(F.lit(between) * c.times, F.lit(between) * c.times + F.lit(inside)), F.lit(0.0))))
    scaled = profiles.select("__s", "__usual", season.alias("__season"), "wd", "e", "n")
    scaled = scaled.select("__s", "__usual", "__season", F.transform(F.arrays_zip("e", "wd"), lambda c: c.e / F.col("__usual") / F.element_at("__season", c.wd)).alias("z"), "n")
    each = scaled.select(F.explode(F.arrays_zip("z", "n")).alias("x")).select("x.z", "x.n")
    whole = each.groupBy(binned(F.col("z")).alias("bin")).agg(F.sum("n").alias("n"), F.sum(F.col("z") * F.col("n")).alias("s")).collect()
    z, n = np.array(sorted((r.s / r.n, r.n) for r in whole)).reshape(-1, 2).T
    pool = pooled_tail(z, n)
    if pool is None:
        return scaled.select("__s", "__usual", "__season", F.lit(None).cast("double").alias("__cutoff"))
    _, threshold, middle, shape = pool
    columns = ["__s", "__usual", "__season", "z", "n"]

    def fits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for z, n, cutoff in zip(pdf["z"], pdf["n"], pdf["cutoff"]):
                order = np.argsort(z)
                k, u, m, x = fit_tail(z[order], n[order], cutoff) or (0, threshold, middle, shape)
                out.append((float(k), np.log(u / threshold), np.log(m / middle), x - shape))
            yield pdf[columns].assign(**dict(zip(("k", "d0", "d1", "d2"), np.array(out).reshape(-1, 4).T)))

    schema = f"__s {kind}, __usual double, __season array<double>, z array<double>, n array<double>, k double, d0 double, d1 double, d2 double"
    # sampling variance of each parameter, times the number of exceedances
    noise = [(scale_of(middle, shape) / threshold) ** 2, 1 / np.log(2) ** 2, (1 + shape) ** 2]
    current = scaled.withColumn("cutoff", F.lit(tail_quantile(threshold, middle, shape)))
    for _ in range(2):
        fitted = stage_table(current.mapInPandas(fits, schema), "tails")
        k = F.col("k")
        apart = fitted.agg(*[(F.try_divide(F.sum(k * k * F.pow(f"d{i}", F.lit(2)) - k * noise[i]), F.sum(k * k))).alias(f"t{i}") for i in range(3)]).first()
        real = [F.lit(max(t or 0.0, 0.0)) * k for t in apart]
        kept = [F.col(f"d{i}") * F.coalesce(F.try_divide(real[i], real[i] + F.lit(noise[i])), F.lit(0.0)) for i in range(3)]
        x = kept[2] + F.lit(shape)
        x = F.when(F.abs(x) > 1e-6, x).otherwise(1e-6)
        quantile = F.exp(kept[0]) * threshold + F.exp(kept[1]) * middle / (F.pow(F.lit(2.0), x) - 1) * (F.pow(F.lit(RISK / TAIL), -x) - 1)
        current = fitted.select(*columns, quantile.alias("cutoff"))
    return current.select("__s", "__usual", "__season", (F.col("cutoff") * F.col("__usual")).alias("__cutoff"))


def scale_of(median: float, shape: float) -> float:
    """Scale of the law with this median excess."""
    return median * shape / (2.0**shape - 1)


def flag_bars(bars: DataFrame, source: str = "symbol", day: str = "date", *, version: str = "updated_at", prices: tuple[str, str, str, str] = ("open", "high", "low", "close"), volume: str = "volume", factor: str | None = "adj_factor", tolerance: float = 1e-6) -> DataFrame:
    """One row per (source, day, ``fault_kind``); columns source, day (date), fault_kind, ``score`` (excursion over usual movement, else null).

    ``impossible``: a price is zero or less. ``ohlc``: all positive, and high < low or open/close outside low..high by more than the tolerance.
    ``stuck``: one of STUCK_RUN or more successive rows with volume above zero and the same four prices. ``spike``: all positive, and the
    adjusted close leaves its path for at most LONGEST rows by more than the source's cutoff (see tail_cutoffs), after which the path resumes.

    Of several rows of a source and day the one of the latest version holds. A missing price is neither impossible nor a spike and breaks a
    frozen run; a missing volume counts as none; a missing factor is the last one before it (or 1), or the next, whichever shows less of a spike. Rows without source or day are
    ignored; empty input gives no rows; other columns are ignored.
    """
    kinds = dict(bars.dtypes)

    def number(name: str) -> Column:
        x = quoted(name).cast("double") if kinds[name] != "double" else quoted(name)
        return F.when(~F.isnan(x), x)

    epoch = F.lit("1970-01-01").cast("date")
    when = quoted(day).cast("date")
    o, h, low, c = (number(p) for p in prices)
    positive = (o > 0) & (h > 0) & (low > 0) & (c > 0)
    broken = positive & ((h < low - tolerance) | (o < low - tolerance) | (o > h + tolerance) | (c < low - tolerance) | (c > h + tolerance))
    impossible = F.coalesce(F.least(o, h, low, c) <= 0, F.lit(False))
    # what later steps need of a row, in few bytes: log close, a digest of the four prices where they were traded, its own faults
    quote = F.when(o.isNotNull() & h.isNotNull() & low.isNotNull() & c.isNotNull() & (number(volume) > 0), F.xxhash64(o + 0.0, h + 0.0, low + 0.0, c + 0.0))
    rows = bars.select(
        quoted(source).alias("__src"), when.alias("__day"), F.floor(F.datediff(when, epoch) / F.lit(SHARD_DAYS)).cast("int").alias("__shard"), quoted(version).alias("__ver"),
        F.when(positive, F.log(c)).alias("__raw"), quote.alias("__quote"), (number(factor) if factor else F.lit(1.0)).alias("__f"), impossible.alias("__impossible"), F.coalesce(broken, F.lit(False)).alias("__broken"),
    ).where("__src is not null and __day is not null and __shard is not null")  # all that joins will ask for, so that both uses plan alike and share a shuffle
    given = F.when(F.col("__f") > 0, F.col("__f"))
    placed = _placed(rows, ["__raw", "__quote", "__f", "__impossible", "__broken"], "__raw", {"__factor": given}, {"__next": given})
    # a row without a factor may belong to the one before or to the next: it is an excursion only if it is under both
    held = F.col("__raw") + F.round(F.log(F.coalesce("__factor", F.lit(1.0))), 9)
    other = F.when(given.isNull(), F.col("__raw") + F.round(F.log("__next"), 9))
    blocks = _in_blocks(placed.withColumns({"__p": held, "__q": other}).drop("__factor", "__next", "__f"))
    line = Window.partitionBy("__src", "__block").orderBy("__day")
    same = F.coalesce(F.col("__quote") == F.lag("__quote").over(line), F.lit(False))
    around = blocks.select("*", same.alias("__same"), *neighbours(["__p", "__raw"]))
    seen = around.select(
        *blocks.columns, "__same", excursion("__p", "__raw", "__p").alias("__e1"), F.when(F.col("__q").isNotNull(), excursion("__p", "__raw", "__q")).alias("__e2"), F.abs(F.col("__p") - F.col("__p_b1")).alias("__move"),
    )
    need = STUCK_RUN - 1
    back, ahead, run = F.lit(True), F.lit(True), F.lit(1)
    for k in range(need):
        back = back & F.coalesce(F.lag("__same", k).over(line), F.lit(False))
        ahead = ahead & F.coalesce(F.lead("__same", k + 1).over(line), F.lit(False))
        run = run + back.cast("int") + ahead.cast("int")
    marked = seen.select("__src", "__day", "__home", "__block", F.when(F.col("__p").isNotNull(), F.least("__e1", "__e2")).alias("__e"), "__move", "__impossible", "__broken", (run >= STUCK_RUN).alias("__stuck"))
    staged = stage_table(marked.where("__home = __block").drop("__home", "__block"), "flags")
    known = staged.join(tail_cutoffs(staged), F.col("__src") == F.col("__s"), "left").withColumn("__e", F.col("__e") / F.element_at("__season", F.dayofweek("__day")))
    spike = F.coalesce(F.col("__e") > F.col("__cutoff"), F.lit(False))
    kinds_found = F.array(
        F.when(F.col("__impossible"), F.struct(F.lit("impossible").alias("fault_kind"), F.lit(None).cast("double").alias("score"))),
        F.when(F.col("__broken"), F.struct(F.lit("ohlc").alias("fault_kind"), F.lit(None).cast("double").alias("score"))),
        F.when(F.col("__stuck"), F.struct(F.lit("stuck").alias("fault_kind"), F.lit(None).cast("double").alias("score"))),
        F.when(spike, F.struct(F.lit("spike").alias("fault_kind"), F.try_divide("__e", "__usual").alias("score"))),
    )
    return known.where(F.col("__impossible") | F.col("__broken") | F.col("__stuck") | spike).select(F.col("__src").alias(source), F.col("__day").alias(day), F.explode(F.filter(kinds_found, lambda x: x.isNotNull())).alias("__x")).select(quoted(source), quoted(day), "__x.fault_kind", "__x.score")

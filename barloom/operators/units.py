"""Quantities recorded in different units, brought to common ones through a graph of sources."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from barloom.functions.clean import quoted
from barloom.functions.units import CONVERSIONS, plain_number, read_figure, unit_power
from barloom.session import stage_table

#: Bins per power of ten in the histograms of pairwise ratios, and classes of size per power of ten in which they are kept apart.
BINS, CLASSES = 20, 4
#: The scale of a link snaps to a conversion if it is within so many powers of ten of it.
SNAP = 0.2
#: An offset counts if it is more than this share of the usual size of the values.
OFFSET = 0.1

#: Links of a source a with a source b, or with stated values: how much more (log10) a shows than b, in values of what size, how often.
Link = tuple[str, bool, str, bool, str, float, int, int]
#: The same once scale and offset are estimated.
Edge = tuple[str, bool, str, bool, str, float, int]


@dataclass(frozen=True)
class Relation:
    """log10(left in common units) - log10(right in common units) + offset is about zero; offset is a column expression text."""

    left: str
    right: str
    offset: str


def _median(values: np.ndarray, weights: np.ndarray) -> float:
    order = np.argsort(values)
    upto = np.cumsum(weights[order])
    return float(values[order][int(np.searchsorted(upto, upto[-1] / 2))])


def scale_and_offset(size: np.ndarray, ratio: np.ndarray, links: np.ndarray) -> tuple[float, float]:
    """(scale, offset) with a = scale * (b + offset), from the log10 ratios of a to b in classes of the size of b (log10), by robust medians.

    In a class the median ratio stands for its links; over the classes, ratio = scale + scale * offset / size is a line, whose slope is
    the weighted median of the slopes between classes. With one class there is no telling them apart, and the offset is none.
    """
    classes = np.unique(size)
    n = np.array([links[size == c].sum() for c in classes], dtype=float)
    y = np.array([10.0 ** _median(ratio[size == c], links[size == c]) for c in classes])
    x = 10.0 ** -classes
    i, j = np.triu_indices(len(classes), 1)
    slope = _median((y[i] - y[j]) / (x[i] - x[j]), n[i] * n[j]) if len(i) else 0.0
    usual = 10.0 ** _median(classes, n)
    scale = _median(y - slope * x, n)
    if scale <= 0 or abs(slope / scale) <= OFFSET * usual:
        return _median(y, n), 0.0
    return scale, slope / scale


def edges(histogram: list[Link]) -> tuple[list[Edge], dict[tuple[str, str, int], float]]:
    """One edge per pair, field and power of ten in between, with its scale (log10) freed of an offset; and the offset of each node and
    power against stated values, in common units."""
    by: dict[tuple, list] = defaultdict(list)
    for a, ka, b, kb, f, r, size, n in histogram:
        by[a, ka, b, kb, f, round(r)].append(((size + 0.5) / CLASSES, r, n))
    out, found = [], defaultdict(list)
    for (a, ka, b, kb, f, k), rows in by.items():
        size, r, n = (np.array(x, dtype=float) for x in zip(*rows))
        scale, offset = scale_and_offset(size, r - k, n)
        out.append((a, ka, b, kb, f, float(k + np.log10(scale)), int(n.sum())))
        if kb and not ka:
            found[a, f, -k].append((offset, n.sum()))
    offsets = {node: _median(*(np.array(x, dtype=float) for x in zip(*v))) for node, v in found.items()}
    return out, {node: o for node, o in offsets.items() if o}


def snap_graph(histogram: list[Edge], powers: Mapping[str, set[int]]) -> dict[tuple[str, str], dict[int, float]]:
    """Conversions of each (source, field) without stated units: power -> its links.

    ``histogram`` rows: source a, a is stated, source b, b is stated, field, log10(a / b), links. Stated nodes are in common units already.
    Starting from these, a node takes over the powers of the nodes it is linked to, shifted by each ratio that snaps to a known
    conversion; nodes linked to anchors directly come first, then those behind them. The offset left after snapping must be within SNAP.
    """
    nodes = {(a, f) for a, known, _, _, f, _, _ in histogram if not known} | {(b, f) for _, _, b, known, f, _, _ in histogram if not known}
    near: dict[tuple[str, str], list] = defaultdict(list)
    for a, ka, b, kb, f, r, n in histogram:
        if not ka:
            near[a, f].append((None if kb else (b, f), r, n))
        if not kb:
            near[b, f].append((None if ka else (a, f), -r, n))
    found: dict[tuple[str, str], dict[int, float]] = {}
    while True:
        new: dict[tuple[str, str], dict[int, float]] = {}
        for node in sorted(nodes - found.keys()):
            votes: dict[int, float] = defaultdict(float)
            for other, r, n in near[node]:
                theirs = {0: 1.0} if other is None else found.get(other, {})
                for base, links in theirs.items():
                    power = round(base - r)
                    if power in powers[node[1]] and abs(base - r - power) <= SNAP:
                        votes[power] += n * links / sum(theirs.values())
            if votes:
                new[node] = dict(votes)
        if not new:
            return found
        found |= new


class UnitHarmonizer:
    """Brings the ``fields`` of deliveries to common units.

    A unit beside the number holds first, then the row's unit column, then the units a source is known to use on the day of delivery.
    For numbers without any of these, the same entities are linked across sources: per pair of sources and power of ten in between, scale
    and offset are estimated by robust medians, snapped to known conversions and propagated from sources with stated units through the
    graph of sources. That gives the conversions each source uses. In a source that uses several, each row chooses: by its own other figures
    (``relations``) first, to half a power of ten; among what these leave, by the likelihood of the value given the values linked to the
    same entity and the source's use of the conversion. How far linked values spread is measured, not set.

    Unreadable numbers (absent marks, unknown text behind the number) and nulls stay null with a null power. A number that is zero or
    negative has no logarithm and takes its source's main conversion. A conversion that no link of a source shows counts as half a link.
    """

    def __init__(self, fields: Mapping[str, tuple[str, str]], relations: list[Relation], *, row_id: str, source: str, entity: list[str], delivered: str):
        self.fields, self.relations, self.row_id, self.source, self.entity, self.delivered = dict(fields), relations, row_id, source, entity, delivered

    def read(self, rows: DataFrame, known_units: DataFrame, keep: list[str]) -> DataFrame:
        """Numbers (``n_<field>``) and stated powers (``p_<field>``) with the row id, source, entity and ``keep`` columns."""
        span = F.struct(F.coalesce("valid_from", F.lit("0001-01-01").cast("date")).alias("a"), F.coalesce("valid_to", F.lit("9999-12-31").cast("date")).alias("z"), "p")
        spans = known_units.withColumn("p", F.coalesce(*[F.when(F.col("field") == f, unit_power(f, "unit")) for f in self.fields])).where("source is not null and p is not null")
        spans = spans.groupBy(F.col("source").alias("__us")).agg(*[F.array_sort(F.collect_set(F.when(F.col("field") == f, span))).alias(f"__spans_{f}") for f in self.fields])
        cols = {c: quoted(c) for c in dict.fromkeys([self.row_id, self.source, *self.entity, *keep])}
        names = list(cols)
        picked = rows.select(*[v.alias(k) for k, v in cols.items()], quoted(self.delivered).cast("date").alias("__on"), *[x for f, (raw, unit) in self.fields.items() for x in (quoted(raw).alias(f"__raw_{f}"), quoted(unit).alias(f"__unit_{f}"))])
        # most numbers are plain and stay in the JVM; only the others, and units where there are any, are taken apart by workers
        plain = picked.select(*names, "__on", *[x for f in self.fields for x in (F.col(f"__raw_{f}"), F.col(f"__unit_{f}"), plain_number(f"__raw_{f}").alias(f"__p_{f}"))])
        other = plain.select(*names, "__on", *[x for f in self.fields for x in (F.col(f"__p_{f}"), read_figure(f, F.when(F.col(f"__p_{f}").isNull(), F.col(f"__raw_{f}")), F.when(F.trim(f"__unit_{f}") != "", F.col(f"__unit_{f}"))).alias(f"__x_{f}"))])
        parsed = other.join(spans, F.col(self.source) == F.col("__us"), "left")
        out = []
        for f in self.fields:
            number, power = F.coalesce(f"__p_{f}", f"__x_{f}.n"), F.col(f"__x_{f}.p")
            # of the spans that hold on the day, the one that began last
            told = F.try_element_at(F.filter(f"__spans_{f}", lambda u: (F.col("__on") >= u.a) & (F.col("__on") < u.z)), F.lit(-1)).p
            out += [number.alias(f"n_{f}"), F.when(number.isNotNull(), F.coalesce(power, told)).alias(f"p_{f}")]
        return parsed.select(*names, *out)

    def log(self, f: str) -> Column:
        return F.when(F.col(f"n_{f}") > 0, F.log10(f"n_{f}"))

    def unstated(self) -> str:
        return " or ".join(f"(n_{f} is not null and p_{f} is null)" for f in self.fields)

    def links(self, read: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Per entity with an unstated number the mean logarithm of stated values (``m_<field>``), and the histogram of pairwise ratios of sources."""
        there = read.where(" and ".join(f"`{e}` is not null" for e in self.entity))
        asked = there.where(self.unstated()).select(*[quoted(e).alias(f"__a{i}") for i, e in enumerate(self.entity)]).distinct()
        there = there.join(asked, [quoted(e) == F.col(f"__a{i}") for i, e in enumerate(self.entity)], "left_semi")
        per = there.groupBy(*self.entity, self.source).agg(*[x for f in self.fields for x in (
            F.avg(self.log(f) + F.col(f"p_{f}")).alias(f"s_{f}"), F.avg(F.when(F.col(f"p_{f}").isNull(), self.log(f))).alias(f"u_{f}"))])
        means = per.groupBy(*self.entity).agg(*[F.avg(f"s_{f}").alias(f"m_{f}") for f in self.fields], F.collect_list(F.struct(self.source, *[f"{k}_{f}" for f in self.fields for k in "su"])).alias("__all"))
        return means.drop("__all"), self._pairs(means)

    def _nodes(self, name: str, known: bool) -> Column:
        there = F.filter("__all", lambda x: x[name].isNotNull())
        return F.transform(there, lambda x: F.struct(x[self.source].alias("src"), F.lit(known).alias("known"), x[name].alias("v")))

    def _pairs(self, means: DataFrame) -> DataFrame:
        """Pairs of an unstated node with others of the entity; an entity has at most one node per source and state, so few pairs."""
        each = F.array(*[F.struct(F.lit(f).alias("field"), F.concat(self._nodes(f"s_{f}", True), self._nodes(f"u_{f}", False)).alias("nodes")) for f in self.fields])
        pairs = means.select(F.explode(each).alias("x")).select("x.field", "x.nodes").where("size(nodes) > 1")
        pairs = pairs.select("field", "nodes", F.explode(F.filter("nodes", lambda x: ~x.known)).alias("a")).select("field", "a", F.explode("nodes").alias("b")).where("b.known or a.src < b.src")
        r, size = F.round((F.col("a.v") - F.col("b.v")) * BINS) / BINS, F.floor(F.col("b.v") * CLASSES).cast("int")
        pairs = pairs.select("field", F.col("a.src").alias("a"), F.col("b.src").alias("b"), F.col("b.known").alias("known"), r.alias("r"), size.alias("size"))
        return pairs.groupBy("a", "b", "known", "field", "r", "size").agg(F.count(F.lit(1)).alias("n"))

    def graph(self, histogram: DataFrame) -> tuple[dict[tuple[str, str], dict[int, float]], dict[tuple[str, str, int], float]]:
        """Conversions per (source, field), and offsets; the histogram is bounded by sources squared, fields, bins and classes of size, so the driver may hold it."""
        found, offsets = edges([(r.a, False, r.b, r.known, r.field, float(r.r), int(r["size"]), int(r.n)) for r in histogram.collect()])
        return snap_graph(found, {f: set(CONVERSIONS[f]) for f in self.fields}), offsets

    def resolve(self, unstated: DataFrame, graph: dict[tuple[str, str], dict[int, float]]) -> DataFrame:
        """``p_<field>`` for rows with a number but no stated unit; needs ``m_<field>`` and the columns the relations name."""
        names = list(self.fields)
        rows = unstated.select(quoted(self.row_id), quoted(self.source), *[F.col(f"{k}_{f}") for f in names for k in "npm"], *[F.expr(r.offset).alias(f"__r{i}") for i, r in enumerate(self.relations)])
        rows = stage_table(rows, "unstated")
        # linked values spread by so much around whole powers of ten: the likelihood of a distance falls with it
        away = [F.col(f"m_{f}") - F.when(F.col(f"p_{f}").isNull(), self.log(f)) for f in names]
        spread = rows.agg(*[F.percentile_approx(F.abs(x - F.round(x)), 0.5).alias(f) for f, x in zip(names, away)]).first()
        spread = [max(spread[f] or 0.0, 1e-3) for f in names]
        options = [CONVERSIONS[f] for f in names]
        every = np.array(list(product(*options)), dtype=float)
        relations = [(names.index(r.left), names.index(r.right)) for r in self.relations]
        uses = {}  # per source and field, what each combination costs by the links of the source
        for s in {s for s, _ in graph}:
            for i, f in enumerate(names):
                votes = graph.get((s, f), {})
                uses[s, i] = -np.log((np.array([votes.get(int(p), 0.0) for p in every[:, i]]) + 0.5) / (sum(votes.values()) + 0.5 * len(options[i])))
        none = np.zeros(len(every))
        source, row_id = self.source, self.row_id

        def choose(part: pd.DataFrame) -> np.ndarray:
            n, p, m = (part[[f"{k}_{f}" for f in names]].to_numpy(dtype=float) for k in "npm")
            with np.errstate(invalid="ignore", divide="ignore"):
                log = np.where(n > 0, np.log10(n), np.nan)
            open_ = np.isnan(p) & ~np.isnan(n)
            power = np.where(open_[:, None, :], every[None, :, :], np.where(np.isnan(p), 0.0, p)[:, None, :])
            own = np.zeros(power.shape[:2])
            for i, (a, b) in enumerate(relations):
                off = np.abs((log[:, a] - log[:, b] + part[f"__r{i}"].to_numpy(dtype=float))[:, None] + power[:, :, a] - power[:, :, b])
                own += np.nan_to_num(off)
            own = np.round(own * 2)
            linked = np.zeros(power.shape[:2])
            for i in range(len(names)):
                off = np.nan_to_num(np.abs((log[:, i] - m[:, i])[:, None] + power[:, :, i]) / spread[i])
                prior = np.array([uses.get((s, i), none) for s in part[source]]).reshape(len(part), -1)
                linked += np.where(open_[:, i, None], off + prior, 0.0)
            linked = np.where(own <= own.min(axis=1, keepdims=True), linked, np.inf)
            # fields that are not open have the same power in all combinations, so that the first of equal ones stands for them
            return every[np.argmin(linked, axis=1)]

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in parts:
                for at in range(0, len(whole), 4096):
                    part = whole.iloc[at:at + 4096]
                    best = choose(part)
                    out = {row_id: part[row_id], source: part[source]}
                    for i, f in enumerate(names):
                        n, p = part[f"n_{f}"].to_numpy(dtype=float), part[f"p_{f}"].to_numpy(dtype=float)
                        open_ = np.isnan(p) & ~np.isnan(n)
                        out[f"n_{f}"] = part[f"n_{f}"]
                        out[f"p_{f}"] = pd.array(np.where(np.isnan(n), np.nan, np.where(open_, best[:, i], p)), dtype="Int32")
                        out[f"i_{f}"], out[f"l_{f}"] = open_, open_ & ~np.isnan(part[f"m_{f}"].to_numpy(dtype=float))
                    yield pd.DataFrame(out)

        schema = T.StructType([rows.schema[self.row_id], rows.schema[self.source], *[x for f in names for x in (T.StructField(f"n_{f}", T.DoubleType()), T.StructField(f"p_{f}", T.IntegerType()), T.StructField(f"i_{f}", T.BooleanType()), T.StructField(f"l_{f}", T.BooleanType()))]])
        return rows.mapInPandas(run, schema)

    def harmonize(self, rows: DataFrame, known_units: DataFrame, context: DataFrame | None = None, context_key: str | None = None, keep: list[str] | None = None) -> DataFrame:
        """Row id, source, and per field ``n_`` (number as written), ``p_`` (power), ``i_`` (inferred rather than stated), ``l_`` (inferred,
        and other sources state a value of the entity) and ``v_`` (value in common units: n * 10^p, less the offset of its source and power
        where its links show one).

        ``context`` adds columns the relations need, by equality on ``context_key`` (a column of rows and of context)."""
        keep = [*(keep or []), *([context_key] if context_key else [])]
        read = stage_table(self.read(rows, known_units, keep), "units")  # texts are parsed once, numbers are used three times
        missing = self.unstated()
        means, pairs = self.links(read)
        graph, offsets = self.graph(pairs)
        stated = read.where(f"not ({missing})").select(quoted(self.row_id), quoted(self.source), *[x for f in self.fields for x in (F.col(f"n_{f}"), F.col(f"p_{f}"), F.lit(False).alias(f"i_{f}"), F.lit(False).alias(f"l_{f}"))])
        unstated = read.where(missing)
        linked = means.select(*[F.col(e).alias(f"__e{i}") for i, e in enumerate(self.entity)], *[f"m_{f}" for f in self.fields])
        unstated = unstated.join(linked, [F.col(e) == F.col(f"__e{i}") for i, e in enumerate(self.entity)], "left").drop(*[f"__e{i}" for i in range(len(self.entity))])
        if context is not None:
            other = context.withColumnRenamed(context_key, "__ck")
            unstated = unstated.join(other, quoted(context_key) == F.col("__ck"), "left").drop("__ck")
        out = stated.unionByName(self.resolve(unstated, graph))

        def value(f: str) -> Column:
            shift = F.lit(0.0)
            for (s, g, p), o in sorted(offsets.items()):
                if g == f:
                    shift = F.when(F.col(f"i_{f}") & (quoted(self.source) == s) & (F.col(f"p_{f}") == p), o).otherwise(shift)
            return F.col(f"n_{f}") * F.pow(F.lit(10.0), F.col(f"p_{f}")) - shift

        return out.select("*", *[value(f).alias(f"v_{f}") for f in self.fields])


def conversion_table(graph: dict[tuple[str, str], dict[int, float]]) -> list[tuple[str, str, int, float]]:
    """(source, field, power, share of its links)."""
    return [(s, f, p, round(n / sum(by.values()), 6)) for (s, f), by in sorted(graph.items()) for p, n in sorted(by.items())]

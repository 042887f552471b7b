"""Sources mixed to target weights by Pareto order sampling."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, Window

from barloom.functions.clean import quoted
from barloom.llm.tokens import VOCABULARY, token_count
from barloom.session import stage_table

#: Bits of the rank that a pass over the sizes looks at, and all of its bits.
STEP_BITS, RANK_BITS = 12, 60
#: The bucket in which a quota ends is looked into again while it holds more documents than this; what is sorted in the end is that bucket.
EDGE = 4096
#: Documents after the end of a quota that may fill it up, where the bucket has so many.
FOLLOWERS = 256
#: Weight classes per factor of two, in which inclusion odds are solved for.
PER_OCTAVE = 8


def plan_mix(targets: list[tuple[str, str, float, int]], sizes: dict[str, float], total: float | None = None) -> list[dict]:
    """Quota, whole copies and rest of each (mix, source). Without ``total``, a mix is as large as its scarcest present source allows."""
    by: dict[str, list] = defaultdict(list)
    for mix, source, share, most in targets:
        by[mix].append((source, share, most))
    out = []
    for mix, rows in sorted(by.items()):
        limits = [most * sizes[s] / share for s, share, most in rows if sizes.get(s) and share > 0]
        size = min([*limits, *([total] if total else [])], default=0.0)
        for source, share, most in rows:
            there = sizes.get(source, 0.0)
            quota = min(share * size, most * there)
            copies = min(most, math.floor(quota / there + 1e-12)) if there else 0
            rest = quota - copies * there if copies < most else 0.0
            out.append({"mix": mix, "source": source, "share": share, "most": most, "there": there, "quota": quota, "copies": copies, "rest": max(0.0, rest)})
    return out


def inclusion_scale(classes: list[tuple[float, float]], rest: float) -> float:
    """c with sum(size * min(1, c * weight)) = rest over (weight, size) classes; inf if everything must go in."""
    classes = sorted((c for c in classes if c[0] > 0), reverse=True)
    if rest >= sum(s for _, s in classes):
        return math.inf
    certain, open_ = 0.0, sum(w * s for w, s in classes)
    for w, s in classes:
        c = (rest - certain) / open_ if open_ > 0 else math.inf
        if c * w <= 1:
            return max(c, 0.0)
        certain, open_ = certain + s, open_ - w * s
    return math.inf


def fill_gap(sizes: np.ndarray, gap: float) -> np.ndarray:
    """1 for the documents taken, in order: each that still fits, at last the one that brings the sum nearest to the gap, if any does."""
    taken = np.zeros(len(sizes), dtype=np.int32)
    for i, s in enumerate(sizes.tolist()):
        if s <= gap:
            taken[i] = 1
            gap -= s
    rest = np.flatnonzero(taken == 0)
    if len(rest):
        k = rest[np.argmin(sizes[rest])]
        if sizes[k] - gap < gap:
            taken[k] = 1
    return taken


def next_buckets(sums: list[tuple[int, int, int]], rest: float) -> tuple[int, int, int, int] | None:
    """(first bucket, last bucket, tokens before, documents within) of where the rest ends, from ascending (bucket, tokens, documents).

    The last bucket is the first one by which FOLLOWERS documents follow, unless that makes more than EDGE documents. None if the rest isn't reached.
    """
    before = 0
    for i, (bucket, tokens, documents) in enumerate(sums):
        if before + tokens >= rest:
            last, within = bucket, documents
            for more, _, n in sums[i + 1:]:
                if within - documents >= FOLLOWERS or within + n > EDGE:
                    break
                last, within = more, within + n
            return bucket, last, before, within
        before += tokens
    return None


def mix_documents(docs: DataFrame, targets: DataFrame, *, row_id: str = "doc_id", source: str = "source", text: str = "text", total: float | None = None, weight: str = "sqrt(n_tokens)", seed: int = 11, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(``mix_name``, id, ``source``, ``n_tokens``, ``copies``) of the documents in each mix, and a report of the shares reached.

    A source's quota is its share of the mix. Every document first gets the whole copies its source needs of all; the rest of the quota is
    a Pareto sample: documents are ranked by (u / (1 - u)) / (p / (1 - p)), u a hash of seed, mix and id, p the inclusion probability
    proportional to ``weight`` (SQL over n_tokens), and taken in that order; documents of p = 1 are certain and come first, by u. Sizes are
    summed by the leading bits of the rank; while the bucket in which the rest ends holds more than EDGE documents, a further pass looks at
    its next bits. Only that bucket, with some followers, is sorted: there, documents that no longer fit are passed over and later ones fill
    up, so that one long document does not spoil the share. This departs from the Pareto order for documents of that bucket alone. No source
    is gathered, and each pass reads sizes only.

    A source without documents, or with texts of no tokens only, reaches a share of 0 and does not limit the mix; the others share what is
    there. No document is used more than max_repeats times; max_repeats and shares of null or less count as 0. Rows of the same id and source are one document, of its greatest size; one without source,
    id or tokens is in no mix; repeated targets of a source in a mix use the greatest of each number. Empty tables give empty results.
    """
    sized = docs.select(quoted(row_id).alias("__id"), quoted(source).alias("__source"), token_count(quoted(text), vocabulary).alias("n_tokens"))
    sized = sized.where("__id is not null and __source is not null and n_tokens > 0").groupBy("__id", "__source").agg(F.max("n_tokens").alias("n_tokens"))
    sized = stage_table(sized, "mix-sizes")
    weighted = sized.withColumn("__w", F.greatest(F.expr(weight).cast("double"), F.lit(1e-12)))
    # targets and sources of targets are configuration: a row per mix and source
    goal = targets.select("mix_name", F.col("source").alias("s"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("most")).where("mix_name is not null and s is not null")
    goal = goal.groupBy("mix_name", "s").agg(F.max("share").alias("share"), F.max("most").alias("most"))
    wanted = [(r.mix_name, r.s, float(r.share), int(r.most)) for r in goal.collect()]
    named = sorted({s for _, s, _, _ in wanted})
    of_mix = weighted.where(F.col("__source").isin(named)) if named else weighted.where("false")
    classes: dict[str, list[tuple[float, float]]] = defaultdict(list)
    for r in of_mix.groupBy("__source", F.floor(F.log2("__w") * PER_OCTAVE).alias("c")).agg(F.sum(F.col("__w") * F.col("n_tokens")).alias("ws"), F.sum("n_tokens").alias("s")).collect():
        classes[r["__source"]].append((r.ws / r.s, float(r.s)))
    plan = plan_mix(wanted, {s: sum(x for _, x in v) for s, v in classes.items()}, total)
    for p in plan:
        c = inclusion_scale(classes[p["source"]], p["rest"]) if p["rest"] > 0 else 0.0
        p["scale"] = min(c, 1e300)
    spark = docs.sparkSession
    small = spark.createDataFrame([(p["mix"], p["source"], p["share"], p["most"], p["quota"], p["copies"], p["rest"], p["scale"]) for p in plan], "mix_name string, s string, share double, most int, quota double, whole int, rest double, scale double")
    each = weighted.join(small, F.col("__source") == F.col("s"))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mix_name", "__id"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    p = F.least(F.col("scale") * F.col("__w"), F.lit(1.0))
    odds = u / (1 - u) * (1 - p) / p
    # certain documents fill the lower half of the ranks, the others the upper half by odds / (1 + odds)
    rank = F.floor(F.when(p >= 1, u / 2).otherwise(0.5 + odds / (1 + odds) / 2) * float(1 << RANK_BITS)).cast("long")
    ranked = each.withColumn("__rank", F.when(F.col("rest") > 0, F.least(rank, F.lit((1 << RANK_BITS) - 1))))

    def bounds(of: dict[tuple[str, str], tuple[int, int, float]]) -> DataFrame:
        """(mix, source, first rank, last rank, tokens before) as a small table."""
        return spark.createDataFrame([(m, s, *x) for (m, s), x in of.items()], "__m string, __s string, __from long, __to long, __before double")

    ends: dict[tuple[str, str], tuple[int, int, float]] = {}
    open_ = {(p["mix"], p["source"]): (0, (1 << RANK_BITS) - 1, 0.0) for p in plan if p["rest"] > 0}
    rests = {(p["mix"], p["source"]): p["rest"] for p in plan}
    shift = RANK_BITS
    while open_:
        shift -= STEP_BITS
        inside = ranked if shift + STEP_BITS == RANK_BITS else ranked.join(bounds(open_), (F.col("mix_name") == F.col("__m")) & (F.col("s") == F.col("__s"))).where("__rank between __from and __to")
        found: dict[tuple[str, str], list] = defaultdict(list)
        for r in inside.where("__rank is not null").groupBy("mix_name", "s", F.shiftright("__rank", shift).alias("b")).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("k")).collect():
            found[r.mix_name, r.s].append((r.b, r.t, r.k))
        going = {}
        for key, (_, _, before) in open_.items():
            at = next_buckets(sorted(found[key]), rests[key] - before)
            if at is None:
                continue  # everything goes in
            first, last, more, within = at
            if within > EDGE and shift > 0:
                going[key] = (first << shift, ((first + 1) << shift) - 1, before + more)
            else:
                ends[key] = (first << shift, ((last + 1) << shift) - 1, before + more)
        open_ = going
    cut = ranked.join(bounds(ends), (F.col("mix_name") == F.col("__m")) & (F.col("s") == F.col("__s")), "left")
    at_edge = F.coalesce(F.col("__rank").between(F.col("__from"), F.col("__to")), F.lit(False))
    kept = ["mix_name", "__id", "s", "n_tokens", "whole"]
    inside = cut.where(~at_edge).select(*kept, F.when(F.col("__rank").isNotNull() & (F.col("__from").isNull() | (F.col("__rank") < F.col("__from"))), 1).otherwise(0).alias("more"))
    edge = cut.where(at_edge).select(*kept, "__rank", (F.col("rest") - F.col("__before")).alias("__gap"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__rank", "__id"], kind="stable")
        return pdf[kept].assign(more=fill_gap(pdf["n_tokens"].to_numpy(), float(pdf["__gap"].iloc[0])))

    edge = edge.groupBy("mix_name", "s").applyInPandas(fill, inside.select(*kept, F.lit(0).alias("more")).schema)
    chosen = inside.unionByName(edge).select("mix_name", F.col("__id").alias(row_id), F.col("s").alias("source"), "n_tokens", (F.col("whole") + F.coalesce("more", F.lit(0))).cast("int").alias("copies")).where("copies > 0")
    reached = chosen.groupBy(F.col("mix_name").alias("__m"), F.col("source").alias("__s")).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    report = small.join(reached, (F.col("mix_name") == F.col("__m")) & (F.col("s") == F.col("__s")), "left")
    tokens = F.coalesce("tokens", F.lit(0))
    report = report.select("mix_name", F.col("s").alias("source"), F.col("share").alias("target_share"), F.round(F.coalesce(F.try_divide(tokens.cast("double"), F.sum(tokens).over(Window.partitionBy("mix_name"))), F.lit(0.0)), 6).alias("actual_share"), tokens.alias("tokens"), F.round("quota").cast("long").alias("quota_tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.col("most").alias("max_repeats"))
    return chosen, report
